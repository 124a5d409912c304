"""What the corpus operators share: staged tables, whole-batch word splitting and hashing.

Texts reach Python as Arrow batches. Words are found and hashed for many texts at
once from the batch's own buffers, so no text becomes a Python string here.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

#: Words are runs of anything but these bytes; A-Z are lowered, nothing else is.
SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy pass handles; a longer text is a pass of its own.
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch: texts are long, and a batch is held by Spark and by Python.
ARROW_ROWS = "2000"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(SPACES)] = False
POWERS = np.multiply.accumulate(np.full(4096, 0x9E3779B97F4A7C15, dtype=np.uint64))


def scratch(spark: SparkSession) -> str:
    """A new folder for staged tables: under spark.checkpoint.dir, which all machines
    share. Where that is unset a local folder will do on one machine; on a cluster it is an
    error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@functools.cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Whether the shuffle files of a job go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: later steps
    survive the loss of executors and nothing is computed twice. For the time of the write
    Arrow batches have ARROW_ROWS rows; its shuffles leave the disk with it."""
    conf, path = df.sparkSession.conf, folder or scratch(df.sparkSession)
    before = {key: conf.get(key) for key in (ARROW, CLEANUP)}
    conf.set(ARROW, ARROW_ROWS)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            conf.set(key, value)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back(spark: SparkSession, *folders: str) -> None:
    """Deletes staged tables after their last reader."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _give_back() -> None:
    """Free memory goes back to the system: a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    if libc and hasattr(trim := ctypes.CDLL(libc), "malloc_trim"):
        trim.malloc_trim(0)


def lean(task):
    """A function over batches that leaves no free memory behind in its worker."""

    @functools.wraps(task)
    def run(*args, **kwargs):
        try:
            yield from task(*args, **kwargs)
        finally:
            _give_back()

    return run


def by_frequent_keys(rows: DataFrame, per: DataFrame, key: str, total: int, least: int = 1000, most: int = 100_000) -> DataFrame:
    """rows left-joined with per (staged; a row for each key, n: how many of rows have it).
    Keys that many rows have, most of them at most by their counts, are broadcast, so that the
    shuffled join holds short groups only."""
    limit = max(least, total // most)
    hot, rest = F.broadcast(per.where(F.col("n") >= limit).drop("n")), per.where(F.col("n") < limit).drop("n")
    found = rows.join(hot, key)
    return found.unionByName(rows.join(hot.select(key), key, "left_anti").join(rest, key, "left").select(found.columns))


#: Rows, and elements of their arrays, that a table marked for broadcast has at most.
MAX_BROADCAST_ROWS = 500_000


def few(df: DataFrame) -> DataFrame:
    """A staged table of short rows, marked for broadcast if they and what is in their arrays
    are few by count; else as it is, for a shuffled join."""
    inner = [F.coalesce(F.sum(F.size(f.name)), F.lit(0)) for f in df.schema if isinstance(f.dataType, ArrayType)]
    return F.broadcast(df) if sum(df.agg(F.count("*"), *inner).first()) <= MAX_BROADCAST_ROWS else df


def least_count(rows: DataFrame, most: int, n: str = "n") -> int:
    """The count n from which on rows are most at most; 0 if all are."""
    total = least = 0
    for r in rows.groupBy(F.floor(F.log2(n) * 8).cast("int").alias("b")).agg(F.count("*").alias("c"), F.min(n).alias("least")).orderBy(F.desc("b")).collect():
        total += r.c
        if total > most:
            return least or 1 << 62
        least = r.least
    return 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, for arrays of uint64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most limit bytes each, or one longer row; and of so many rows."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, i + rows, max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1))
        yield i, j
        i = j


def words_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of consecutive texts raw[off[i]:off[i+1]]: the hash of each lower-cased word, in
    order, and the bounds of each text's words in that list (len(off) entries)."""
    base = off[0]
    data, own = raw[base : off[-1]], off - base
    keep = _IS_WORD[data]
    begins = keep.copy()
    begins[1:] &= ~keep[:-1]
    firsts = own[:-1][own[:-1] < own[1:]]
    begins[firsts] |= keep[firsts]
    at = np.flatnonzero(keep)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    heads = np.flatnonzero(begins[at])
    starts = at[heads]
    lengths = np.diff(np.append(heads, len(at)))
    inside = np.arange(len(at)) - np.repeat(heads, lengths)
    value = (_LOWER[data[at]].astype(np.uint64) + np.uint64(1)) * POWERS[inside & 4095]
    if lengths.max() > 4096:
        value *= ((inside >> 12).astype(np.uint64) << np.uint64(1)) + np.uint64(1)
    return mix(np.add.reduceat(value, heads)), np.searchsorted(starts, own)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; the caller drops those that span two texts."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        total += words[j : len(words) - k + 1 + j] * np.uint64(pow(0xD6E8FEB86659FD93, j, 1 << 64))
    return mix(total)


def shingles(raw: np.ndarray, off: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """Of each text: its sorted distinct k-word shingles as uint64; a shorter text is one
    shingle of all its words, one without words has none."""
    words, bound = words_of(raw, off)
    every = grams(words, k)
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        if b - a >= k:
            own = np.sort(every[a : b - k + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            yield grams(words[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield every[:0]


def crc_fold(column: str, folds: int):
    """crc32 of an id written as text, modulo folds: the fixed split of labelled rows."""
    return F.crc32(F.col(column).cast("string")) % folds


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Connected components of an edge list: columns node, component (the smallest node
    reachable). Alternates the large-star and small-star steps, each a shuffle by node,
    until a round leaves all edges as they were, which a join with the edges before tells;
    nothing is collected but counts. Spark splits the partition of a centre with very many edges.
    Nodes without an edge to another node do not occur in the result."""
    e = (
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .where("u <> v")
        .distinct()
    )
    e = staged(e)
    many = e.count()
    while many:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        smaller = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smaller, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, had = e, many
        e = staged(small.union(smaller.select("u", F.col("m").alias("v"))).distinct())
        many = e.count()
        if many == had and not e.join(before, ["u", "v"], "left_anti").limit(1).count():
            break
    tops = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
