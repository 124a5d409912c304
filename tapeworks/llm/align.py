"""Alignment of two tokenizers over the same texts.

Either tokenizer cuts a text into runs of bytes. Where a token of each ends at the same byte the
text is cut into groups, and all tokens of a group are linked. The groups of a batch of texts are
found in lockstep: one numpy state vector holds a pointer into the tokens of A and of B for each
lane; a step compares where the two tokens end, emits the lanes that stand at a cut, advances
whichever pointer is behind (both at a cut) and drops the lanes that are done. A text of more than
LANE tokens is several lanes, as a cut depends on nothing before it; so a step always
advances many lanes, however long one text is.

Links of a text are kept as distinct pairs of ids and how often each occurs. Documents by pair are
counted in the tasks first and summed by Spark. The counts go back to the documents: those of the
most frequent pairs, a bounded number, as a broadcast, others by a join on the pairs of each
document, in which no pair is frequent.
"""

from __future__ import annotations

import functools
import hashlib
import json
from functools import partial

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _lists, _repeat_ranges
from .common import buffers, chunks, lean, least_count, staged

#: Tokens of A of one lane, bytes of texts of one numpy pass.
LANE, PASS_BYTES = 512, 1 << 21
#: Groups with more links are counted by how often each id occurs on either side.
BIG_GROUP = 4096
#: Pairs up to this many are broadcast (17 bytes each, 68 MB at most).
MAX_BROADCAST_PAIRS = 4_000_000
#: Ids of B in a pair: a * PAIR + b.
PAIR = 1 << 20
SPACE = "▁"


class ByteLevel:
    """A tokenizer file of the byte-level BPE kind. Its merges must be in the order of the ids that
    they make, as then the lowest id of all pairs is the next merge."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, special = model["vocab"], set()
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        alphabet = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if [vocabulary[m] for m in made] != list(range(len(alphabet), len(alphabet) + len(made))):
            raise ValueError(f"{path}: merges are not in the order of ids")
        special = set(vocabulary) - set(made) - set(alphabet)
        ranks = {bytes(alphabet[c] for c in piece): i for piece, i in vocabulary.items() if piece not in special}
        self.coder = tiktoken.Encoding("byte level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = pieces({i: p for p, i in ranks.items()})

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the bounds of each text's ids."""
        data = raw[off[0] : off[-1]].tobytes()
        at = (off - off[0]).tolist()
        each = [self.coder.encode_to_numpy(data[a:b].decode(), disallowed_special=()) for a, b in zip(at[:-1], at[1:], strict=True)]
        return np.concatenate(each).astype(np.int64), np.concatenate(([0], np.cumsum([len(x) for x in each])))


class Pieces:
    """A sentencepiece model that puts a space before a text. Where no piece has a space after
    another character, a text's runs of spaces with the word after them are encoded on their
    own, each distinct one of a pass once."""

    def __init__(self, path: str):
        self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.coder.id_to_piece(i) for i in range(self.coder.get_piece_size())]
        self.space = [self.coder.piece_to_id(SPACE)]
        self.apart = all(SPACE not in name.lstrip(SPACE) for name in names)
        plain = lambda i, name: bytes([int(name[3:5], 16)]) if self.coder.is_byte(i) else b"" if self.coder.is_unknown(i) or self.coder.is_control(i) else name.replace(SPACE, " ").encode()
        self.pieces = pieces({i: plain(i, name) for i, name in enumerate(names)})

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ByteLevel.encode, for texts that begin with the space that the model puts there."""
        data, own = raw[off[0] : off[-1]], off - off[0]
        starts = np.zeros(len(data), bool)
        if self.apart:
            space = data == 32
            starts[1:] = space[1:] & ~space[:-1]
        starts[own[:-1]] = True
        bounds = np.append(np.flatnonzero(starts), len(data))
        words = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = words.dictionary_encode()
        words = coded.dictionary.to_pylist()  # a space alone: at the end of a text, where the model puts none before it
        each = [ids if word != " " else self.space for word, ids in zip(words, self.coder.encode([w[1:] for w in words], num_threads=1), strict=True)]
        lengths = np.array([len(x) for x in each], np.int64)
        ids = np.fromiter((i for x in each for i in x), np.int64, int(lengths.sum()))
        code = coded.indices.to_numpy()
        begins = np.cumsum(lengths) - lengths
        total = np.concatenate(([0], np.cumsum(lengths[code])))
        return ids[_repeat_ranges(begins[code], lengths[code])], total[np.searchsorted(bounds, own)]


def pieces(by_id: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids, in order, and their bounds."""
    lengths = np.zeros(max(by_id, default=-1) + 1, np.int64)
    lengths[list(by_id)] = [len(p) for p in by_id.values()]
    return np.frombuffer(b"".join(by_id[i] for i in sorted(by_id)), np.uint8), np.concatenate(([0], np.cumsum(lengths)))


@functools.cache
def _tokenizers(a_path: str, b_path: str, pattern: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a_path, pattern), Pieces(b_path)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places (i, j), ascending, of all tokens of A and B that end at the same byte. Lanes take the tokens
    first[k] .. stop[k] of A; ends are ascending offsets in the joined texts."""
    a = first.copy()
    b = np.searchsorted(ends_b, np.where(a > 0, ends_a[a - 1], 0), "right")
    cuts_a, cuts_b = [], []
    while len(a):
        end_a, end_b = ends_a[a], ends_b[b]
        cut = end_a == end_b
        cuts_a.append(a[cut])
        cuts_b.append(b[cut])
        b = b + (end_b <= end_a)
        a = a + (end_a <= end_b)
        open_ = a < stop
        if not open_.all():
            a, b, stop = a[open_], b[open_], stop[open_]
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (cuts_a, cuts_b))
    order = np.argsort(i)
    return i[order], j[order]


def _same_bytes(ids, own, table, raw, off) -> np.ndarray:
    """Of each text, whether its ids' bytes are its bytes."""
    data, bounds = table
    lengths = bounds[ids + 1] - bounds[ids]
    at = np.concatenate(([0], np.cumsum(lengths)))
    right = np.diff(at[own]) == np.diff(off)
    if len(ids) and right.any():
        keep = np.repeat(right, np.diff(own))
        joined = data[_repeat_ranges(bounds[ids[keep]], lengths[keep])]
        theirs = raw[_repeat_ranges(off[:-1][right], np.diff(off)[right])]
        size = np.diff(off)[right]
        text = np.repeat(np.flatnonzero(right), size)
        right[text[joined != theirs]] = False
    return right


def _only(ids, own, keep):
    """ids and own of the texts with keep."""
    lengths = np.diff(own)
    return ids[np.repeat(keep, lengths)], np.concatenate(([0], np.cumsum(lengths[keep])))


def _ends(ids, table):
    return np.cumsum(table[1][ids + 1] - table[1][ids])


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 .. n-1, a row each with a place for a mark after them, and their number."""
    text = np.array([b"%d" % i for i in range(n)])
    width = text.dtype.itemsize
    rows = np.zeros((n, width + 1), np.uint8)
    rows[:, :width] = text.view(np.uint8).reshape(n, width)
    return rows, (rows != 0).sum(axis=1)


def _written(ids_a, ids_b, groups, digits) -> tuple[np.ndarray, np.ndarray]:
    """a1,a2|b1;a3|b2,b3; of all groups, and where each group's text ends."""
    first_a, last_a, first_b, last_b = groups
    n = len(ids_a) + len(ids_b)
    ids, mark = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[np.arange(len(ids_a)) + np.repeat(first_b, last_a - first_a + 1)] = ids_a
    ids[np.arange(len(ids_b)) + np.repeat(last_a + 1, last_b - first_b + 1)] = ids_b
    mark[last_a + first_b] = ord("|")
    mark[last_a + last_b + 1] = ord(";")
    rows, lengths = digits
    out = rows[ids]
    out[np.arange(n), lengths[ids]] = mark
    ends = np.cumsum(lengths[ids] + 1)
    return out[out != 0], ends[last_a + last_b + 1]


def _links(ids_a, ids_b, groups, text):
    """(text, pair, times) of the links of all groups; a text's pairs are distinct and ascending."""
    first_a, last_a, first_b, last_b = groups
    wide = last_b - first_b + 1
    many = (last_a - first_a + 1) * wide
    small = many <= BIG_GROUP
    which = np.repeat(np.flatnonzero(small), many[small])
    inside = _repeat_ranges(np.zeros(small.sum(), np.int64), many[small])
    pair = ids_a[first_a[which] + inside // wide[which]] * PAIR + ids_b[first_b[which] + inside % wide[which]]
    owner = text[which]
    order = np.lexsort((pair, owner))
    pair, owner = pair[order], owner[order]
    heads = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])))) if len(pair) else np.zeros(0, np.int64)
    pair, owner, times = pair[heads], owner[heads], np.diff(np.append(heads, len(pair)))
    if small.all():
        return owner, pair, times
    more = [(owner, pair, times)]
    for g in np.flatnonzero(~small).tolist():
        a, n = np.unique(ids_a[first_a[g] : last_a[g] + 1], return_counts=True)
        b, m = np.unique(ids_b[first_b[g] : last_b[g] + 1], return_counts=True)
        more.append((np.full(len(a) * len(b), text[g]), (a[:, None] * PAIR + b).ravel(), (n[:, None] * m).ravel()))
    owner, pair, times = (np.concatenate(x) for x in zip(*more, strict=True))
    order = np.lexsort((pair, owner))
    owner, pair, times = owner[order], pair[order], times[order]
    heads = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1]))))
    return owner[heads], pair[heads], np.add.reduceat(times, heads)


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


@lean
def _align(batches, tokenizers):
    """Batches (id, space and text) as rows (id, ALIGNED)."""
    a, b = _tokenizers(*tokenizers)
    digits = _digits(max(len(a.pieces[1]), len(b.pieces[1])) - 1)
    for batch in batches:
        raw, off = buffers(batch.column(1))
        for i, j in chunks(off, PASS_BYTES):
            cut = off[i : j + 1]
            (ids_a, own_a), (ids_b, own_b) = a.encode(raw, cut), b.encode(raw, cut)
            full = np.diff(cut) > 1
            keep = full & _same_bytes(ids_a, own_a, a.pieces, raw, cut) & _same_bytes(ids_b, own_b, b.pieces, raw, cut)
            (ids_a, own_a), (ids_b, own_b) = _only(ids_a, own_a, keep), _only(ids_b, own_b, keep)
            per = -(-np.diff(own_a) // LANE)
            first = _repeat_ranges(np.zeros(len(per), np.int64), per) * LANE + np.repeat(own_a[:-1], per)
            stop = np.minimum(first + LANE, np.repeat(own_a[1:], per))
            last_a, last_b = lockstep(_ends(ids_a, a.pieces), _ends(ids_b, b.pieces), first, stop)
            groups = (np.concatenate(([0], last_a[:-1] + 1))[: len(last_a)], last_a, np.concatenate(([0], last_b[:-1] + 1))[: len(last_b)], last_b)
            own = np.searchsorted(last_a, own_a)  # groups of each text: a text's last tokens end together
            text = np.repeat(np.arange(len(own) - 1), np.diff(own))
            owner, pair, times = _links(ids_a, ids_b, groups, text)
            written, ends = _written(ids_a, ids_b, groups, digits)
            ends = np.concatenate(([0], ends))[own]
            data = written.tobytes()
            many = np.concatenate(([0], np.cumsum((groups[1] - groups[0] + 1) * (groups[3] - groups[2] + 1))))
            at = np.searchsorted(owner, np.arange(len(own)))
            put = lambda x, fill, kind: pa.array(_spread(x, keep, fill), kind)
            bounds = np.concatenate(([0], np.cumsum(_spread(np.diff(at), keep, 0)))).astype(np.int32)
            sha = [hashlib.sha256(data[s : e - 1]).hexdigest() for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            sha = _spread(np.array(sha, object), keep, "")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i), put(np.diff(own_a), 0, pa.int64()), put(np.diff(own_b), 0, pa.int64()), put(np.diff(own), 0, pa.int64()),
                    put(np.diff(many[own]), 0, pa.int64()), pa.array(sha, pa.string()),
                    pa.ListArray.from_arrays(bounds, pa.array(pair)), pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int64))),
                ],
                ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            )


def _spread(values, keep, fill):
    """values at the places of keep, fill at the others."""
    out = np.full(len(keep), fill, values.dtype)
    out[keep] = values
    return out


@lean
def _counted(batches):
    """(pair, n) of the documents of some batches at a time."""
    held, size = [], 0

    def summed():
        pair, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

    for batch in batches:
        values, _ = _lists(batch.column(0))
        held.append(values.to_numpy())
        size += len(values)
        if size > 1 << 22:
            yield summed()
            held, size = [], 0
    if held:
        yield summed()


@lean
def _packed(batches):
    for batch in batches:
        row = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], ["pair", "n", "best"])


def _places(sorted_, some):
    if not len(sorted_):
        return np.zeros(len(some), np.int64), np.zeros(len(some), bool)
    at = np.minimum(np.searchsorted(sorted_, some), len(sorted_) - 1)
    return at, sorted_[at] == some


@lean
def _lacking(batches, known):
    """(row, pair, times) of the pairs that are not broadcast."""
    for batch in batches:
        (pair, own), (times, _) = _lists(batch.column(1)), _lists(batch.column(2))
        _, found = _places(known.value[0], pair.to_numpy())
        lack = np.flatnonzero(~found)
        row = np.searchsorted(own, lack, "right") - 1
        for i in range(0, len(lack), 1 << 16):
            cut = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[cut])), pair.take(pa.array(lack[cut])), times.take(pa.array(lack[cut]))], ["row", "pair", "times"])


@lean
def _summed(batches, known):
    """Rows with pairs and times as their last columns, with n_best and count_sum over those that are broadcast in
    their place."""
    pairs, n, best = known.value
    for batch in batches:
        (pair, own), (times, _) = _lists(batch.column(batch.num_columns - 2)), _lists(batch.column(batch.num_columns - 1))
        at, found = _places(pairs, pair.to_numpy())
        times = np.where(found, times.to_numpy(), 0)
        sums = [np.concatenate(([0], np.cumsum(times * (x[at] if len(x) else 0))))[own] for x in (best, n)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *[pa.array(np.diff(s), pa.int64()) for s in sums]], [*batch.schema.names[:-2], "n_best", "count_sum"])


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = MAX_BROADCAST_PAIRS) -> tuple[DataFrame, DataFrame]:
    """Two written tables: per document id_col, row, n_a, n_b, n_groups, n_links, groups_sha256, pairs (a * PAIR + b,
    distinct) and times (how often each is linked); and per pair its ids a and b, n (documents that
    have it linked) and best (no pair of that a is in more).

    a_path is a byte-level BPE file, b_path a sentencepiece model that puts a space first;
    both encode the space and the text. A null or empty text, or one that either model does not give
    back byte by byte, has no tokens: zeros and an empty digest. Rows that repeat count each; ids may
    repeat or be null. Other columns are ignored."""
    spaced = docs.select(F.col(id_col).alias("id"), F.concat(F.lit(" "), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("spaced"))
    kind = docs.schema[id_col].dataType.simpleString()
    each = spaced.mapInArrow(partial(_align, tokenizers=(a_path, b_path, pattern)), f"id {kind}, {ALIGNED}")
    aligned = staged(each.withColumn("row", F.monotonically_increasing_id()))
    counts = staged(aligned.select("pairs").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    counts = counts.withColumn("a", F.expr(f"pair div {PAIR}"))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A
    counts = staged(counts.join(F.broadcast(most), "a").select("pair", "a", (F.col("pair") % PAIR).alias("b"), "n", (F.col("n") == F.col("most")).alias("best")))
    return aligned.withColumnRenamed("id", id_col), counts


def aligned_documents(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = MAX_BROADCAST_PAIRS) -> DataFrame:
    """id_col, n_a, n_b, n_groups, n_links, groups_sha256, n_best (links whose pair no other of the same id of A is in
    more documents than) and count_sum (documents of a link's pair, over links). See align."""
    aligned, counts = align(docs, a_path, b_path, pattern, id_col, text_col)
    spark = docs.sparkSession
    least = least_count(counts, broadcast_pairs)
    parts = counts.where(F.col("n") >= least).select("pair", "n", "best").mapInArrow(_packed, "pair binary, n binary, best binary").collect()
    known = [np.frombuffer(b"".join(r[c] for r in parts), t) for c, t in enumerate((np.int64, np.int64, np.bool_))]
    order = np.argsort(known[0])
    shared = spark.sparkContext.broadcast(tuple(x[order] for x in known))
    names = [id_col, "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = ", ".join([f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in names] + ["n_best long", "count_sum long"])
    out = staged(aligned.select(*names, "pairs", "times").mapInArrow(partial(_summed, known=shared), schema))
    if least:
        lack = aligned.select("row", "pairs", "times").mapInArrow(partial(_lacking, known=shared), "row long, pair long, times long")
        more = lack.join(counts.where(F.col("n") < least).select("pair", "n", "best"), "pair")
        more = more.groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        out = out.join(more, "row", "left").select(
            *names, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum")
        )
        out = staged(out)
    shared.destroy()
    return out.drop("row")
