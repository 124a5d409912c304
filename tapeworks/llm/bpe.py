"""Byte-level BPE encoding and decoding.

Texts are cut into words by the tokenizer's pattern. Each distinct word of the corpus is
encoded once, by Spark's higher-order functions: a fold that merges, step by step, the
leftmost pair of pieces with the lowest rank, looked up in a literal rank map. The map is
an array of small maps, chosen by crc32 of the piece, as Spark scans a map's keys. Bytes
are written as the characters U+0000..U+00FF inside the fold.

A fold copies a word's pieces at each merge, so the few words of more than LONG_BYTES bytes
are merged by a heap of ranks instead, in time n log n, to the same ids.

The encoded words then go back to the texts: the most frequent ones, a bounded number, as a
broadcast; if the corpus has more, the rest by a join on the words of each document, in
which no word is frequent. Decoding concatenates the binary pieces of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import POWERS, buffers, lean, least_count, mix, staged

#: Small maps of the literal rank map; a power of two.
MAPS = 1 << 14
#: Distinct words up to this many are broadcast (about 30 bytes each, 120 MB at most).
MAX_BROADCAST_WORDS = 4_000_000
#: No rank is as high.
NONE = 1 << 30
#: Words whose ids one pass of numpy puts together.
PASS_WORDS = 1 << 17
#: Longer words are merged by a heap.
LONG_BYTES = 200


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The literal: an array of MAPS maps from piece to rank, folded by the optimizer."""
    maps: list[dict[str, int]] = [{} for _ in range(MAPS)]
    for piece, rank in ranks.items():
        text = piece.decode("latin-1")
        maps[zlib.crc32(text.encode()) & (MAPS - 1)][text] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def encode_word(word: Column, maps: Column) -> Column:
    """array<int>: the ids of one word as byte-level BPE gives them: a word that is a piece
    is one id; else the leftmost pair of lowest rank is merged until none has one. An empty
    word has no ids. The literal stands in the plan once."""
    return _let(maps, lambda m: _encode_word(word, m))


def _encode_word(word: Column, maps: Column) -> Column:

    def rank(piece: Column) -> Column:
        small = F.get(maps, F.crc32(piece.cast("binary")).bitwiseAND(MAPS - 1).cast("int"))
        return F.element_at(small, piece)

    def pair(a: Column, b: Column) -> Column:
        return F.coalesce(rank(F.concat(a, b)), F.lit(NONE))

    def merged(state: Column) -> Column:
        parts, ranks = state["parts"], state["ranks"]

        def at(i: Column) -> Column:  # i: place of the pair, from 1
            n = F.size(parts)
            one = F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))
            before = F.when(i > 1, F.concat(F.slice(ranks, F.lit(1), i - 2), F.array(pair(F.element_at(parts, F.greatest(i - 1, F.lit(1))), one)))).otherwise(F.array().cast("array<int>"))
            after = F.when(i + 1 < n, F.concat(F.array(pair(one, F.element_at(parts, F.least(i + 2, n)))), F.slice(ranks, i + 2, n))).otherwise(F.array().cast("array<int>"))
            return F.struct(
                F.concat(F.slice(parts, F.lit(1), i - 1), F.array(one), F.slice(parts, i + 2, n)).alias("parts"),
                F.concat(before, after).alias("ranks"),
            )

        return _let(F.array_position(ranks, F.array_min(ranks)).cast("int"), at)

    bytes_ = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")

    def split(text: Column) -> Column:
        n = F.length(text)
        parts = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(1)))
        ranks = F.transform(F.sequence(F.lit(1), n - 1), lambda i: pair(F.substring(text, i, F.lit(1)), F.substring(text, i + 1, F.lit(1))))
        start = F.struct(parts.alias("parts"), ranks.alias("ranks"))
        steps = F.sequence(F.lit(1), n - 1)
        end = F.aggregate(steps, start, lambda s, _: F.when(F.coalesce(F.array_min(s["ranks"]), F.lit(NONE)) < NONE, merged(s)).otherwise(s))
        whole = rank(text)
        return F.when(n == 0, F.array().cast("array<int>")).when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(end["parts"], rank))

    return _let(bytes_, split)


def words(pattern: str, text_col: str) -> Column:
    """The matches of pattern with Unicode's meaning of \\s, as the tokenizers read it."""
    return F.regexp_extract_all(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit("(?U)" + pattern), F.lit(0))


def merge_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids that the fold gives: a heap of (rank, place) of neighbouring pieces; pieces are a
    linked list of where they begin."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    after, before, ends = list(range(1, n + 1)), list(range(-1, n)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n + 1)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or ends[j] != end:  # a piece of the pair has been merged since
            continue
        gone[j], ends[i], after[i] = 1, end, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], end), (i, ends[after[i]] if after[i] < n else 0)):
            if a >= 0 and b and (r := ranks.get(word[a:b])) is not None:
                heapq.heappush(heap, (r, a, b))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = after[i]
    return out


@lean
def _long_words(batches, ranks):
    for batch in batches:
        words = batch.column(0).to_pylist()
        ids = [merge_by_heap(w.encode(), ranks.value) for w in words]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), batch.column(1)], ["word", "ids", "n"])


def encode_words(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text") -> DataFrame:
    """One row per distinct word of the corpus, as a written table: word, ids, n (occurrences)."""
    spark = docs.sparkSession
    each = docs.select(F.explode(words(pattern, text_col)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    short = F.octet_length("word") <= LONG_BYTES
    made = staged(each.repartition(parts, "word").select("word", F.when(short, encode_word(F.col("word"), rank_map(ranks))).alias("ids"), "n"))
    shared = spark.sparkContext.broadcast(ranks)
    long = made.where("ids is null").select("word", "n").mapInArrow(partial(_long_words, ranks=shared), "word string, ids array<int>, n long")
    return made.where("ids is not null").unionByName(staged(long))


def _lists(col):
    """Values and bounds of a list array."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    off = col.offsets.to_numpy()
    return col.values.slice(off[0], off[-1] - off[0]), off - off[0]


def _repeat_ranges(starts, lengths):
    """starts[i], starts[i] + 1, ..: lengths[i] numbers for each i, in one array."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)


def _gather(ids_of, starts_of, lengths_of, code, own, pieces):
    """Rows (n_tokens, ids as bytes, decoded bytes) of texts with words code[own[i]:own[i+1]];
    word c has the ids ids_of[starts_of[c]:] of the length lengths_of[c]."""
    starts, lengths = starts_of[code].astype(np.int64), lengths_of[code].astype(np.int64)
    ids = ids_of[_repeat_ranges(starts, lengths)].astype(np.int64)
    cut = np.concatenate(([0], np.cumsum(lengths)))[own]
    raw, off = pieces
    long = off[ids + 1] - off[ids]
    data = raw[_repeat_ranges(off[ids], long)]
    at = np.concatenate(([0], np.cumsum(long)))[cut]
    little = ids.astype("<u4")
    for a, b, c, d in zip(cut[:-1].tolist(), cut[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield b - a, little[a:b].tobytes(), data[c:d].tobytes()


def _out(id_col, rows, digests):
    n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
    if digests:
        ids, decoded = ([hashlib.sha256(x).hexdigest() for x in col] for col in (ids, decoded))
    kind = pa.string() if digests else pa.binary()
    return pa.RecordBatch.from_arrays([id_col, pa.array(n, pa.int64()), pa.array(ids, kind), pa.array(decoded, kind)], ["id", "n_tokens", "ids", "decoded"])


def _pieces(ranks):
    """All pieces in order of rank, as bytes, and their bounds."""
    table = sorted(ranks.items(), key=lambda x: x[1])
    top = table[-1][1] + 1
    lengths = np.zeros(top, np.int64)
    lengths[[r for _, r in table]] = [len(p) for p, _ in table]
    return np.frombuffer(b"".join(p for p, _ in table), np.uint8), np.concatenate(([0], np.cumsum(lengths)))


def _hashes(col: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    raw, off = buffers(col)
    data, own = raw[off[0] : off[-1]], off - off[0]
    lengths = np.diff(own)
    inside = np.arange(len(data)) - np.repeat(own[:-1], lengths)
    value = (data.astype(np.uint64) + np.uint64(1)) * POWERS[inside & 4095] * ((inside >> 12).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    return mix(total[own[1:]] - total[own[:-1]] + lengths.astype(np.uint64))


@lean
def _packed(batches, kind):
    """One row for each batch of the vocabulary: hashes, numbers of ids, ids, as bytes."""
    for batch in batches:
        ids, own = _lists(batch.column(1))
        row = (_hashes(batch.column(0)).tobytes(), np.diff(own).astype(np.int32).tobytes(), ids.to_numpy().astype(kind).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], ["h", "n", "ids"])


def _collected(vocabulary: DataFrame, kind):
    """The words' hashes, sorted; where each word's ids begin, and their number; all ids in
    the type kind. Of words that share a hash none is among them."""
    parts = vocabulary.select("word", "ids").mapInArrow(partial(_packed, kind=kind), "h binary, n binary, ids binary").collect()
    hashes = np.frombuffer(b"".join(r.h for r in parts), np.uint64)
    lengths = np.frombuffer(b"".join(r.n for r in parts), np.int32)
    ids = np.frombuffer(b"".join(r.ids for r in parts), kind)
    del parts
    order = np.argsort(hashes)
    hashes = hashes[order]
    same = np.zeros(len(hashes) + 1, bool)
    same[1:-1] = hashes[1:] == hashes[:-1]
    keep = ~(same[1:] | same[:-1])
    starts = np.cumsum(lengths, dtype=np.int32) - lengths
    return hashes[keep], starts[order][keep], lengths[order][keep], ids


def _places(hashes, some):
    """Where each of some stands in the sorted hashes; -1 if it does not."""
    if not len(hashes):
        return np.full(len(some), -1)
    at = np.minimum(np.searchsorted(hashes, some), len(hashes) - 1)
    return np.where(hashes[at] == some, at, -1)


@lean
def _cold(batches, vocabulary):
    """(row, word) of the distinct words of each of (row, words) that are not broadcast."""
    hashes = vocabulary.value[0]
    for batch in batches:
        values, own = _lists(batch.column(1))
        coded = values.dictionary_encode()
        code = coded.indices.to_numpy()
        lack = np.flatnonzero(_places(hashes, _hashes(coded.dictionary))[code] < 0) if len(code) else code
        row = np.searchsorted(own, lack, "right") - 1
        both = np.unique(row * max(1, len(coded.dictionary)) + code[lack])
        row, code = np.divmod(both, max(1, len(coded.dictionary)))
        for i in range(0, len(row), 1 << 16):
            cut = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[cut])), coded.dictionary.take(pa.array(code[cut]))], ["row", "word"])


@lean
def _assemble(batches, vocabulary, pieces, digests):
    """Batches (id, words[, own words, own ids]): ids from the broadcast vocabulary, else from
    the document's own words."""
    hashes, starts, lengths, ids = vocabulary.value
    for batch in batches:
        values, own = _lists(batch.column(1))
        i, n = 0, len(own) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(own, own[i] + PASS_WORDS, "right")) - 1)
            coded = values.slice(own[i], own[j] - own[i]).dictionary_encode()
            hashed = _hashes(coded.dictionary)
            place = _places(hashes, hashed)
            ids_of, starts_of, lengths_of = ids, starts, lengths
            if (place < 0).any():  # the words that documents of this pass bring along
                mine, _ = _lists(batch.column(2).slice(i, j - i))
                lists, _ = _lists(batch.column(3).slice(i, j - i))
                extra, bounds = _lists(lists)
                known = {w: k for k, w in enumerate(mine.to_pylist())}
                lack = np.flatnonzero(place < 0)
                place[lack] = len(hashes) + np.array([known[w] for w in coded.dictionary.take(pa.array(lack)).to_pylist()])
                ids_of = np.concatenate((ids, extra.to_numpy()))
                starts_of = np.concatenate((starts, bounds[:-1] + len(ids)))
                lengths_of = np.concatenate((lengths, np.diff(bounds)))
            rows = list(_gather(ids_of, starts_of, lengths_of, place[coded.indices.to_numpy()], own[i : j + 1] - own[i], pieces.value))
            yield _out(batch.column(0).slice(i, j - i), rows, digests)
            i = j


def encode(docs: DataFrame, path: str, pattern: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text", broadcast_words: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """One row per document: id_col, n_tokens, ids (little-endian unsigned 32-bit integers)
    and decoded (the bytes that the ids stand for); with digests, the lowercase hex sha256
    of either in its place. The rows are a written table.

    path is a vocabulary file, which the driver reads. A null or empty text has no ids.
    Each document, also a repeated row, is encoded whole; ids may repeat or be null. No
    special tokens. Words of any length take time n log n. Other columns are ignored."""
    ranks, spark = read_ranks(path), docs.sparkSession
    vocabulary = encode_words(docs, ranks, pattern, text_col)
    split = docs.select(F.col(id_col).alias("id"), words(pattern, text_col).alias("words"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids {'string' if digests else 'binary'}, decoded {'string' if digests else 'binary'}"
    kind = np.uint16 if max(ranks.values(), default=0) < 1 << 16 else np.int32
    least = least_count(vocabulary, broadcast_words)
    known = _collected(vocabulary.where(F.col("n") >= least), kind)
    shared, pieces = spark.sparkContext.broadcast(known), spark.sparkContext.broadcast(_pieces(ranks))
    if least or len(known[0]) < vocabulary.count():
        split = staged(split.withColumn("row", F.monotonically_increasing_id()))
        asked = split.select("row", "words").mapInArrow(partial(_cold, vocabulary=shared), "row long, word string")
        own = asked.join(vocabulary.select("word", "ids"), "word").groupBy("row").agg(F.collect_list(F.struct("word", "ids")).alias("own"))
        split = split.join(own, "row", "left").select(
            "id", "words", F.coalesce(F.col("own.word"), F.array().cast("array<string>")).alias("mine"), F.coalesce(F.col("own.ids"), F.array().cast("array<array<int>>")).alias("lists")
        )
    out = staged(split.mapInArrow(partial(_assemble, vocabulary=shared, pieces=pieces, digests=digests), schema))
    shared.destroy()
    pieces.destroy()
    return out.withColumnRenamed("id", id_col)
