"""N-gram Jaccard join by rare-first prefix filtering.

Two texts link when their sets of word shingles have a Jaccard similarity of
``num / den`` or more. Equal sets are one class, found by a digest. Otherwise linked
sets share a shingle of their prefixes, in one global order of shingles, rare first:
shingles that repeat within some blocks of the corpus come last by their count, all
others before them by hash. (One that is frequent over all repeats in some blocks; any
order gives the same links.) Only prefixes are shuffled. Within a posting list sets are
first compared with one typical representative for each band of sizes, which connects large
groups of near copies by as many comparisons as they have members. Then every pair
that shares a prefix shingle and still lies in two components passes the length and
positional filters. The suffix filter is a histogram of each whole set over SLOTS ranges of the
hash: it bounds how many shingles only one of two sets has, and is held against every pair before any set
is sent. What is left is verified once. So components are exact while no group is
expanded into all its pairs.

Nulls, empty texts and texts without words have the empty set and link with nothing;
a text of fewer than k words is one shingle. Repeated rows of one id count once; an id that
repeats with other texts has the links of all of them and the size of the largest. Rows
without an id link with nothing. Very long texts are hashed whole. Columns other than id and
text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, by_frequent_keys, chunks, components, few, lean, shingles, staged

#: Shingles of one block, the unit in which repeats and copies are found before a shuffle.
BLOCK = 1 << 20
#: Largest number of frequent shingles that every task gets, 16 bytes each.
MAX_FREQUENT = 1_000_000
#: Above this count a shingle's posting list is salted.
SALT_ROWS = 10_000
#: Rows of one task's part of a posting list when its pairs are made.
LIST_ROWS = 1_000
#: Ranges of the hash in a set's histogram, one byte each.
SLOTS = 64


def _blocks(batches, k):
    """Lists of (doc_id, shingles, digest) of about BLOCK shingles."""
    block, size = [], 0
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        raw, off = buffers(batch.column(1))
        for i, j in chunks(off):
            for doc, own in zip(ids[i:j].tolist(), shingles(raw, off[i : j + 1], k), strict=True):
                block.append((doc, own, hashlib.blake2b(own.tobytes(), digest_size=16).digest()))
                size += len(own)
            if size >= BLOCK:
                yield block
                block, size = [], 0
    if block:
        yield block


def _distinct(block):
    """One (doc_id, shingles) for each distinct non-empty set of a block: the smallest id."""
    best = {}
    for doc, own, digest in block:
        if len(own) and (digest not in best or doc < best[digest][0]):
            best[digest] = (doc, own)
    return best.values()


def histogram(own: np.ndarray) -> bytes:
    """How many shingles of a set fall in each range of the hash; 255 stands for more, which
    only loosens the bound."""
    return np.minimum(np.bincount((own >> np.uint64(58)).astype(np.int64), minlength=SLOTS), 255).astype(np.uint8).tobytes()


@lean
def _profile(batches, k):
    for block in _blocks(batches, k):
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([d for d, _, _ in block], pa.int64()),
                pa.array([len(s) for _, s, _ in block], pa.int64()),
                pa.array([g for _, _, g in block], pa.binary()),
                pa.array([histogram(s) for _, s, _ in block], pa.binary()),
            ],
            ["id", "n", "digest", "hist"],
        )
        sets = [s for _, s in _distinct(block)]
        if len(sets) > 1:
            every = np.sort(np.concatenate(sets))
            heads = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
            count = np.diff(np.append(heads, len(every)))
            often = count > 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(every[heads[often]].view(np.int64)), pa.array(count[often]), *[pa.nulls(int(often.sum()), pa.binary())] * 2],
                ["id", "n", "digest", "hist"],
            )


def prefix_length(n: int, num: int, den: int) -> int:
    """A set of n shares one of its first so many shingles with any set that links."""
    return n - -(-num * n // den) + 1


@lean
def _prefixes(batches, k, num, den, frequent):
    token_of, count_of = frequent.value
    for block in _blocks(batches, k):
        out, docs, sizes, lengths = [], [], [], []
        for doc, own in _distinct(block):
            n, p = len(own), prefix_length(len(own), num, den)
            if len(token_of):
                near = np.minimum(np.searchsorted(token_of, own), len(token_of) - 1)
                hot = token_of[near] == own
                rare = own[~hot]
                if len(rare) < p:
                    often = near[hot]
                    rare = np.concatenate((rare, own[hot][np.argsort(count_of[often], kind="stable")]))
                own = rare
            out.append(own[:p])
            docs.append(doc)
            sizes.append(n)
            lengths.append(min(p, n))
        if not out:
            continue
        tokens, lengths = np.concatenate(out), np.array(lengths)
        ids = np.repeat(np.array(docs, np.int64), lengths)
        position = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        salt = np.zeros(len(tokens), np.int32)
        if len(token_of):
            near = np.minimum(np.searchsorted(token_of, tokens), len(token_of) - 1)
            parts = np.where(token_of[near] == tokens, count_of[near] // SALT_ROWS + 1, 1)
            salt = np.where(parts > 1, (ids % 1_000_003 * 7919) % parts, 0).astype(np.int32) + (parts > 1)
        size = np.repeat(np.array(sizes, np.int32), lengths)
        for i in range(0, len(tokens), 1 << 16):
            cut = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(tokens[cut].view(np.int64)),
                    pa.array(salt[cut].astype(np.int32)),
                    pa.array(ids[cut]),
                    pa.array(size[cut]),
                    pa.array(position[cut].astype(np.int32)),
                ],
                ["token", "salt", "id", "n", "pos"],
            )


@lean
def _sets(batches, k):
    for batch in batches:
        raw, off = buffers(batch.column(1))
        for i, j in chunks(off):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array([s.tobytes() for s in shingles(raw, off[i : j + 1], k)], pa.binary())], ["id", "shingles"]
            )


def suffix_bound(x: np.ndarray, y: np.ndarray) -> int:
    """Lower bound of the number of shingles that only one of two sorted sets has: their
    parts between three pivots of x differ in size by as much at least."""
    cut = np.array([len(x) // 4, len(x) // 2, len(x) * 3 // 4])
    at = np.searchsorted(y, x[cut])
    mine, other = np.diff(np.concatenate(([0], cut, [len(x)]))), np.diff(np.concatenate(([0], at, [len(y)])))
    return int(np.abs(mine - other).sum())


@lean
def _verify(batches, num, den):
    for batch in batches:
        a, b, x, y = (batch.column(c) for c in range(4))
        keep = []
        for i in range(batch.num_rows):
            p, q = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
            need = -(-num * (len(p) + len(q)) // (num + den))
            if suffix_bound(p, q) > len(p) + len(q) - 2 * need:
                continue
            if len(np.intersect1d(p, q, assume_unique=True)) >= need:
                keep.append(i)
        yield pa.RecordBatch.from_arrays([a.take(pa.array(keep, pa.int64())), b.take(pa.array(keep, pa.int64()))], ["a", "b"])


@lean
def _suffix(batches, num, den):
    """Pairs (a, b, na, nb, hist of a, hist of b) whose histograms leave room for enough common
    shingles."""
    for batch in batches:
        na, nb = (batch.column(c).to_numpy().astype(np.int64) for c in (2, 3))
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SLOTS).astype(np.int16) for c in (4, 5))
        need = -(-num * (na + nb) // (num + den))
        keep = pa.array(np.abs(x - y).sum(axis=1) <= na + nb - 2 * need)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])


def _verified(pairs: DataFrame, sizes: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b), each once and a < b, that link. sizes: (id, n, hist) of all sets."""
    own = lambda c: sizes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("hist").alias(f"h{c}"))
    both = pairs.join(own("a"), "a").join(own("b"), "b").select("a", "b", "na", "nb", "ha", "hb")
    pairs = staged(both.mapInArrow(partial(_suffix, num=num, den=den), "a long, b long"))
    ids = staged(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    sets = staged(texts.join(few(ids), "id", "left_semi").mapInArrow(partial(_sets, k=k), "id long, shingles binary").where("octet_length(shingles) > 0"))
    both = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        .select("a", "b", "x", "y")
    )
    return staged(both.mapInArrow(partial(_verify, num=num, den=den), "a long, b long"))


def _frequent(repeats: DataFrame):
    """The most frequent shingles that repeat within blocks, sorted, and their counts: all
    from the least count on for which they are MAX_FREQUENT at most."""
    often = staged(repeats.groupBy("id").agg(F.sum("n").alias("n")))
    least, total, parts = 0, 0, 1
    step = F.floor(F.log2("n") * 8).cast("int")
    for row in often.groupBy(step.alias("b")).agg(F.count("*").alias("c"), F.min("n").alias("least")).orderBy(F.desc("b")).collect():
        total += row.c
        if total > MAX_FREQUENT:
            if total == row.c:  # too many of one count: as many of these as there is room for
                least, parts = row.least, -(-row.c // MAX_FREQUENT)
            break
        least = row.least
    got = often.where((F.col("n") >= least) & (F.pmod(F.xxhash64("id"), F.lit(parts)) == 0)).toArrow()
    token, count = got["id"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(token)
    return token[order], count[order]


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One row per id: id_col, n_shingles (size of its set), class_id (smallest id with
    the same set; itself for the empty set) and component_id (smallest id reachable by
    links). See the module for nulls and repeats. No rows give no rows."""
    spark = docs.sparkSession
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = every.where("id is not null")
    schema = "id long, n long, digest binary, hist binary"
    profile = staged(texts.mapInArrow(partial(_profile, k=k), schema))
    frequent = spark.sparkContext.broadcast(_frequent(profile.where("digest is null")))

    own = profile.where("digest is not null")
    sizes = staged(own.groupBy("id", "digest").agg(F.first("n").alias("n"), F.first("hist").alias("hist")))
    per = staged(sizes.where("n > 0").groupBy("digest").agg(F.min("id").alias("class_id"), F.count("*").alias("n")))
    total = sizes.count()
    rows = by_frequent_keys(sizes.select("id", "digest", F.col("n").alias("size")), per, "digest", total)
    classes = staged(rows.select("id", F.col("size").alias("n"), F.coalesce("class_id", "id").alias("class_id")))
    reps = few(staged(per.select(F.col("class_id").alias("id")).distinct()))
    sizes = sizes.where("n > 0").select("id", "n", "hist")

    rows = texts.mapInArrow(partial(_prefixes, k=k, num=num, den=den, frequent=frequent), "token long, salt int, id long, n int, pos int")
    rows = rows.withColumn("c", F.count("*").over(Window.partitionBy("token", "salt"))).where("c > 1 or salt > 0").drop("c")
    postings = staged(rows.join(reps, "id", "left_semi"))
    frequent.destroy()

    # Stars: within a band of sizes each set is compared with the most typical one, which
    # has the fewest rarer shingles of its own before the shared one.
    prefix = lambda n: F.col(n) - F.ceil(F.col(n) * num / F.lit(den)) + 1
    band = F.floor(F.log("n") / F.lit(math.log(den / num))).cast("int")
    near = Window.partitionBy("token", "salt", "band").orderBy("pos", "n", "id")
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    stars = (
        postings.withColumn("band", band)
        .withColumn("rep", F.first(F.struct("id", "n")).over(near))
        .where("id <> rep.id")
        .groupBy(F.col("id").alias("b"), F.col("rep.id").alias("a"))
        .agg(F.first("n").alias("nb"), F.first("rep.n").alias("na"), F.count("*").alias("c"))
        .where(f"{den} * na >= {num} * nb and {den} * nb >= {num} * na")
        # a star is worth trying where much of the prefix is shared; others wait for below
        .where(F.col("c") * 8 >= prefix("nb"))
    )
    # of its stars a set tries the two with which it shares most
    best = Window.partitionBy("b").orderBy(F.desc("c"), "a")
    pairs = staged(stars.withColumn("r", F.row_number().over(best)).where("r <= 2").select(*ordered).distinct())
    links = _verified(pairs, sizes, texts, k, num, den)
    joined = staged(components(links))

    # What stars left apart: pairs of two components that share a prefix shingle. Lists are
    # dealt by bands of sizes (linked sets lie in one band or in neighbours) and, where they
    # are long, by parts of the smaller sets, which the larger ones meet one by one.
    placed = staged(postings.drop("salt").join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")))
    apart = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("many")).where("lo < hi")
    open_ = staged(placed.join(apart.select("token", (F.col("many") / LIST_ROWS + 1).cast("int").alias("parts")), "token").withColumn("band", band))
    x, y = (open_.select("token", "parts", "band", *[F.col(c).alias(c + s) for c in ("id", "n", "pos", "component")]) for s in ("x", "y"))
    x = x.withColumn("part", F.pmod(F.xxhash64("idx"), "parts").cast("int")).drop("parts")
    low = F.floor(F.log(F.col("ny") * num / F.lit(den)) / F.lit(math.log(den / num)) - 1e-9).cast("int")
    y = y.withColumn("band", F.explode(F.sequence(F.least(low, "band"), "band"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    need = F.ceil((F.col("nx") + F.col("ny")) * num / F.lit(num + den) - 1e-9)
    rest = (
        x.join(y, ["token", "band", "part"])
        .where(f"(nx < ny or nx = ny and idx < idy) and componentx <> componenty and {den} * nx >= {num} * ny")
        # the first shared shingle of sets that link leaves enough behind it in both
        .where(F.least(F.col("nx") - F.col("posx"), F.col("ny") - F.col("posy")) >= need)
        .select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b"))
        .distinct()
        .join(pairs, ["a", "b"], "left_anti")
    )
    links = links.union(_verified(rest, sizes, texts, k, num, den))
    # An id with several texts links their classes.
    ids = staged(classes.groupBy("id").agg(F.max("n").alias("n"), F.min("class_id").alias("class_id"), F.max("class_id").alias("other"), F.count("*").alias("texts")))
    several = ids.where("texts > 1 and class_id <> other").select("id")
    links = links.union(classes.join(several, "id").select(F.col("id").alias("a"), F.col("class_id").alias("b")))
    found = staged(components(links).select(F.col("node").alias("class_id"), "component"))
    members = staged(ids.groupBy("class_id").agg(F.count("*").alias("n")).join(found, "class_id").select("class_id", "component", "n"))
    out = by_frequent_keys(ids.select("id", F.col("n").alias("n_shingles"), "class_id"), members, "class_id", total).select(
        F.col("id").alias(id_col), "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id")
    )
    bare = every.where("id is null").select(F.lit(0).cast("long").alias("id"), "text")
    bare = bare.mapInArrow(partial(_profile, k=k), schema).where("digest is not null")
    none = F.lit(None).cast("long")
    return out.union(bare.select(none.alias(id_col), F.col("n").alias("n_shingles"), none.alias("class_id"), none.alias("component_id")))
