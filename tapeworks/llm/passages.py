"""Passages that repeat across documents, by collinear chaining.

Seeds are the minimizers of a text's k-word hashes: of any WINDOW consecutive ones the
least, so an equal run of K + WINDOW - 1 words or more always shares a seed. All occurrences
of a rare seed are joined. Those of a frequent one are joined in two steps, within a block
of documents and then across blocks, each with the first document that has it and with the
one before; each seed carries a bit of each of the words around it, which
tell whether such a match stands in an alike passage and so counts by itself. So that no exact copy is lost,
every run of min_words that has frequent seeds only is joined in the same way, by the hash of the whole run. So that no other passage
around a frequent seed is, all its places with different words around are compared, in tiles, with a byte of each of min_words words before and behind; each
that lies in a passage of an earlier document, without a shift, is matched with the first such place. The matches of two
documents are chained in order, with gap costs, through a Fenwick tree of
prefix maxima; chains, also of one match by a rare seed or in alike surroundings, are aligned word by word, between and beyond their
seeds, and split into segments, of which each that is long and alike enough is kept. Edits that
leave two passages no seed in common hide them: of passages of 52 words with random edits of 5,
10, 15 and 20 % of the words, 0, 1, 5 and 12 % share none.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, buffers, chunks, few, give_back, grams, lean, scratch, staged, words_of

K, WINDOW = 5, 10
#: A passage has this many words in the later document, and this share of them aligned.
MIN_WORDS, MIN_ALIKE = 50, 0.8
#: What a word of distance between two seeds costs, in each of the two texts.
GAP_COST = 0.1
#: Anchors farther apart, in either text, are in chains of their own.
MAX_GAP = 256
#: Spans of words that are sent begin and end at multiples of so many.
STEP = 64
#: A seed that occurs at most so often is rare.
RARE = 4
#: Of a seed that occurs more often within a block only the first occurrence leaves it.
IN_BLOCK = 16
#: Words before and behind a seed of which it carries a bit each, and how many of either side
#: may differ where surroundings are alike.
AROUND, APART = 8, 1
#: Bits of a seed's hash. Places of different words with equal hashes do not align.
SEED_BITS = 48
#: Words of one block of seeds, and runs of one block.
BLOCK, RUN_BLOCK = 1 << 21, 1 << 19
#: Bits of the table that tells frequent seeds. Seeds that share a bit with one count as frequent, too, which adds runs but loses none.
TABLE_BITS = 1 << 26
#: Places of a frequent seed that one task compares with each other, and pairs of them that it compares at a time.
TILE, PAIRS = 1 << 14, 1 << 16
#: Bits of a word's byte that all pairs are compared by; the whole byte is where these leave a chance.
PLANES = 4
#: A match, or a frequent seed.
MATCH = "id long, pos int, other long, opos int, sure boolean, seed long"


def _minima(words: np.ndarray, bound: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the least k-word hash of each run of WINDOW of them, whether the run is within
    one text of least words or more, and all hashes."""
    every = grams(words, K)
    if len(every) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, bool), every
    text = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
    at = np.lib.stride_tricks.sliding_window_view(every, WINDOW).argmin(axis=1) + np.arange(len(every) - WINDOW + 1)
    whole = text[: len(at)] == text[K + WINDOW - 2 : K + WINDOW - 2 + len(at)]
    return at, whole & (np.diff(bound)[text[: len(at)]] >= least), every


def minimizers(words: np.ndarray, bound: np.ndarray, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, seed, bits of the words around) of consecutive texts with the words
    bound[i]..bound[i+1]; of texts of fewer than least words, none. A seed that repeats in a
    text counts at each place. Beyond the ends of a text bits are 0."""
    at, whole, every = _minima(words, bound, least)
    at = np.unique(at[whole])
    own = np.searchsorted(bound, at, "right") - 1
    bits = np.zeros(len(words) + 3 * AROUND, np.uint16)
    bits[AROUND : AROUND + len(words)] = (words >> np.uint64(40)) & np.uint64(1)
    packed = np.zeros(len(words) + 2 * AROUND, np.uint16)  # at i: the AROUND words from word i - AROUND on
    for k in range(AROUND):
        packed |= bits[k : k + len(packed)] << np.uint16(k)
    before, behind = at - bound[own], bound[own + 1] - at - K
    full = (1 << AROUND) - 1
    left = packed[at] & (full << np.maximum(AROUND - before, 0) & full).astype(np.uint16)
    right = packed[at + K + AROUND] & ((1 << np.minimum(behind, AROUND)) - 1).astype(np.uint16)
    return own, before, every[at] >> np.uint64(64 - SEED_BITS), (left | right << np.uint16(AROUND)).view(np.int16)


def alike_around(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether all but APART of the words before, or of those behind, two places of a seed may be equal."""
    differ = x.view(np.uint16) ^ y.view(np.uint16)
    return np.minimum(np.bitwise_count(differ & np.uint16((1 << AROUND) - 1)), np.bitwise_count(differ >> np.uint16(AROUND))) <= APART


def runs(words: np.ndarray, bound: np.ndarray, table: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of the runs of so many words that have frequent seeds only;
    table: bits of frequent seeds. Two texts that share another run share a rare seed."""
    at, whole, seeds = _minima(words, bound, length)
    every = grams(words, length)
    bit = seeds[at] >> np.uint64(64 - SEED_BITS) & np.uint64(TABLE_BITS - 1)
    known = table[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1) > 0
    rare = np.concatenate(([0], np.cumsum(~(whole & known))))
    n = max(1, length - K - WINDOW + 2)  # windows of seeds within a run
    good = np.flatnonzero(rare[n:] == rare[: len(rare) - n])
    good = good[good < len(every)]
    own = np.searchsorted(bound, good, "right") - 1
    good, own = (v[good + length <= bound[own + 1]] for v in (good, own))
    return own, good - bound[own], every[good]


def _rows(schema: str, *cols):
    """Batches of columns; None is a column of nulls."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")), strict=True)
    kinds = [{"long": pa.int64(), "int": pa.int32(), "short": pa.int16(), "boolean": pa.bool_()}[k] for k in kinds]
    size = len(next(c for c in cols if c is not None))
    for i in range(0, size, 1 << 16):
        n = min(size - i, 1 << 16)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c[i : i + n], k) for c, k in zip(cols, kinds, strict=True)], names)


#: An occurrence of a seed, or without seed a match within a block.
SEEDS = "seed long, much boolean, id long, pos int, around short, other long, opos int, sure boolean"


def _linked(head, ids, some):
    """Of the later places some of groups (head: a group's first): pairs of each with the
    first document of its group, and with the document before."""
    first = np.flatnonzero(head)[np.cumsum(head) - 1] if len(head) else np.zeros(0, int)
    later = np.flatnonzero(some & ~head & (ids != ids[first]))
    before = later - 1
    apart = (before != first[later]) & (ids[before] != ids[later]) & (ids[before] != ids[first[later]])
    return np.concatenate((later, later[apart])), np.concatenate((first[later], before[apart]))


def _closed(parts, rare):
    """Rows (seed, much, id, pos, around) of a block: all occurrences of a seed that has at most rare
    of them; of the others the first, and (id, pos, other, opos) of the later ones' matches."""
    ids, pos, seed, around = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((pos, ids, seed))
    ids, pos, seed, around = ids[order], pos[order].astype(np.int32), seed[order], around[order]
    head = np.ones(len(seed), bool)
    head[1:] = seed[1:] != seed[:-1]
    group = np.cumsum(head) - 1
    much = np.bincount(group, minlength=1)[group] > rare if len(group) else head
    on = head | ~much
    yield from _rows(SEEDS, seed[on].view(np.int64), much[on], ids[on], pos[on], around[on], None, None, None)
    a, b = _linked(head, ids, much)
    sure = alike_around(around[a], around[b]) if rare else np.ones(len(a), bool)
    yield from _rows(SEEDS, None, None, ids[a], pos[a], None, ids[b], pos[b], sure)


@lean
def _seeds(batches):
    """Blocks of the seeds of texts (id, text)."""
    parts, size = [], 0
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        raw, off = buffers(batch.column(1))
        for i, j in chunks(off):
            words, bound = words_of(raw, off[i : j + 1])
            own, pos, seed, around = minimizers(words, bound)
            parts.append((ids[i:j][own].astype(np.int64), pos, seed, around))
            size += len(words)
            if size >= BLOCK:
                yield from _closed(parts, IN_BLOCK)
                parts, size = [], 0
    if parts:
        yield from _closed(parts, IN_BLOCK)


@lean
def _runs(batches, table, length):
    """Blocks of the runs of frequent seeds of texts (id, text)."""
    parts, size = [], 0
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        raw, off = buffers(batch.column(1))
        for i, j in chunks(off):
            words, bound = words_of(raw, off[i : j + 1])
            own, pos, seed = runs(words, bound, table.value, length)
            parts.append((ids[i:j][own].astype(np.int64), pos, seed, np.zeros(len(own), np.int16)))
            size += len(own)
            if size >= RUN_BLOCK:
                yield from _closed(parts, 0)
                parts, size = [], 0
    if parts:
        yield from _closed(parts, 0)


#: Rows that are joined at a time, but for a rare seed's.
JOINED = 1 << 16


@lean
def _joined(batches, rare, at_once):
    """Rows (seed, much, id, pos, around; see _everywhere for all other pairs of a frequent seed) sorted by seed, id and pos to matches (id, pos, other, opos,
    sure, seed): of a rare seed all occurrences with all, which is sure; of the others each with the first
    and the one before, which is sure in alike surroundings, and the seed itself in a row of its own. Rows without a seed pass through. A seed that
    goes on in the next batch is held back; of one with very many occurrences only its
    first and its last are."""
    held, size, often_held = [], 0, False

    def pairs(cols, going_on):
        """going_on: the first two rows are held back ones of the first seed and are done."""
        seed, much, ids, pos, around = cols
        head = np.ones(len(seed), bool)
        head[1:] = seed[1:] != seed[:-1]
        starts = np.flatnonzero(head)
        count = np.diff(np.append(starts, len(seed)))
        frequent = np.logical_or.reduceat(much, starts) | (count > rare)
        frequent[0] |= going_on
        often = np.repeat(frequent, count)
        place = np.arange(len(seed)) - np.repeat(starts, count)
        for d in range(1, rare):
            a = np.flatnonzero(~often & (place >= d))
            a = a[ids[a - d] != ids[a]]
            yield from _rows(MATCH, ids[a], pos[a], ids[a - d], pos[a - d], np.ones(len(a), bool), None)
        if going_on:
            often[:2] = False
        a, b = _linked(head, ids, often)
        sure = alike_around(around[a], around[b]) if rare else np.ones(len(a), bool)
        yield from _rows(MATCH, ids[a], pos[a], ids[b], pos[b], sure, None)
        if rare:
            yield from _rows(MATCH, None, None, None, None, None, seed[starts[frequent]])

    for batch in batches:
        if batch.column(0).null_count:
            done = batch.filter(batch.column(0).is_null())
            yield pa.RecordBatch.from_arrays([*(done.column(c) for c in (2, 3, 5, 6, 7)), done.column(0)], ["id", "pos", "other", "opos", "sure", "seed"])
            batch = batch.filter(batch.column(0).is_valid())
        if not batch.num_rows:
            continue
        batch = batch.select([0, 1, 2, 3, 4])
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        size += batch.num_rows
        if size < at_once:
            continue
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut:
            yield from pairs([c[:cut] for c in cols], often_held)
            often_held = False
        rest = [c[cut:] for c in cols]
        if len(rest[0]) >= max(at_once, rare + 1):
            yield from pairs(rest, often_held)
            rest, often_held = [c[[0, -1]] for c in rest], True
        held, size = [rest], len(rest[0])
    if held and sum(len(h[0]) for h in held):
        yield from pairs([np.concatenate(c) for c in zip(*held, strict=True)], often_held)


#: A place of a frequent seed: a hash of the words around it, and a byte of each (0 beyond the ends of its text).
PLACES = "seed long, around long, id long, pos int, near binary"


def _places_of(words, bound, table, reach):
    """(text, position, seed, hash of the words around, bytes of these words) of the frequent seeds of texts; around:
    reach words before a seed and behind it."""
    at, whole, every = _minima(words, bound, reach)
    at = np.unique(at[whole])
    bit = every[at] >> np.uint64(64 - SEED_BITS) & np.uint64(TABLE_BITS - 1)
    at = at[table[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1) > 0]
    own = np.searchsorted(bound, at, "right") - 1
    power = [np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(len(words), p, np.uint64)))) for p in (BASE, pow(BASE, -1, 1 << 64))]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power[0][:-1], dtype=np.uint64)))
    a, b = np.maximum(at - reach, bound[own]), np.minimum(at + K + reach, bound[own + 1])
    around = (total[b] - total[a]) * power[1][a]
    place = at[:, None] + np.concatenate((np.arange(-reach, 0), np.arange(K, K + reach)))
    short = np.maximum(words >> np.uint64(32) & np.uint64(255), np.uint64(1)).astype(np.uint8)
    near = np.where((place >= a[:, None]) & (place < b[:, None]), short[np.clip(place, 0, len(words) - 1)], 0).astype(np.uint8)
    return own, at - bound[own], every[at] >> np.uint64(64 - SEED_BITS), around, near


#: Odd, so that it has an inverse among the 64-bit numbers.
BASE = 0x9E3779B97F4A7C15


@lean
def _places(batches, table, reach):
    """Blocks of the places of frequent seeds of texts (id, text), of those with the same words around only the first."""

    def block(parts):
        ids, pos, seed, around, near = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((pos, ids, around, seed))
        seed, around = seed[order], around[order]
        first = np.append(True, (seed[1:] != seed[:-1]) | (around[1:] != around[:-1])) if len(seed) else np.zeros(0, bool)
        order, seed, around = order[first], seed[first], around[first]
        for i in range(0, len(order), 1 << 15):
            own = order[i : i + (1 << 15)]
            cut = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((2 * reach * np.arange(len(own) + 1)).astype(np.int32)), pa.py_buffer(near[own].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(v[i : i + len(own)].view(np.int64)) for v in (seed, around)] + [pa.array(ids[own]), pa.array(pos[own].astype(np.int32)), cut], ["seed", "around", "id", "pos", "near"])

    parts, size = [], 0
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        raw, off = buffers(batch.column(1))
        for i, j in chunks(off):
            words, bound = words_of(raw, off[i : j + 1])
            if len(words):
                own, *rest = _places_of(words, bound, table.value, reach)
                parts.append((ids[i:j][own].astype(np.int64), *rest))
                size += len(words)
            if size >= BLOCK:
                yield from block(parts)
                parts, size = [], 0
    if parts:
        yield from block(parts)


def _firsts(batches):
    """Of rows sorted by seed and around the first of each."""
    last = None
    for batch in batches:
        if batch.num_rows:
            seed, around = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            new = np.append(last != (seed[0], around[0]), (seed[1:] != seed[:-1]) | (around[1:] != around[:-1]))
            last = seed[-1], around[-1]
            yield batch.filter(pa.array(new))


def in_passage(x: np.ndarray, y: np.ndarray, min_words: int, min_alike: float) -> np.ndarray:
    """Whether a passage is around a seed: rows of min_words bytes of words before it and as many behind it, in two texts. A
    passage goes from an equal word to an equal one, holds the seed, and is long and alike enough without a shift. All rows take a word at a time."""
    same = np.ascontiguousarray(((x == y) & (x > 0)).T)
    share = int(100 * min_alike + 1e-9)
    worth = same * np.int16(100) - np.int16(share)
    late = ~same[:min_words] * np.int16(20_000)  # a passage does not start there
    total, least, good, lows = np.zeros(len(x), np.int16), np.full(len(x), 20_000, np.int16), np.zeros(len(x), bool), []
    for k in range(min_words):
        least = np.minimum(least, total + late[k])
        lows.append(least)
        total += worth[k]
    lows.append(np.minimum(least, total))  # from the seed on
    total += np.int16(K * (100 - share))
    good |= total >= lows[min(K, min_words)]
    for k in range(min_words):
        total += worth[min_words + k]
        good |= same[min_words + k] & (total >= lows[min(K + k + 1, min_words)])
    return good


def _planes(near: np.ndarray) -> list[list[np.ndarray]]:
    """The lowest PLANES bits of the bytes of each row, and which bytes are 0 (no word), as columns of 64 bits."""
    size = -(-near.shape[1] // 64) * 8
    out = []
    for k in range(PLANES + 1):
        bits = np.packbits(near >> k & 1 if k < PLANES else near == 0, axis=1)
        wide = np.zeros((len(near), size), np.uint8)
        wide[:, : bits.shape[1]] = bits
        out.append([np.ascontiguousarray(c) for c in wide.view(np.uint64).T])
    return out


def first_alike(near: np.ndarray, planes: list, ids: np.ndarray, part: np.ndarray, min_words: int, min_alike: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of a seed, sorted by document: each that has a passage of an earlier document around it, and the
    first such place. All are compared but those that are found already. With two parts, only places of different ones."""
    most = 2 * min_words - (int(np.ceil(min_alike * min_words - 1e-9)) - K)  # more words that differ leave no passage
    n, lo, step, found = len(ids), 0, 256, []
    left, two = np.arange(1, n), part.min() != part.max()
    while lo < n - 1 and len(left):
        hi, rest = min(n, lo + step), []
        left = left[left > lo]
        for s in range(0, len(left), max(1, PAIRS // (hi - lo))):
            u = left[s : s + max(1, PAIRS // (hi - lo))]
            differ = np.zeros((len(u), hi - lo), np.uint8)
            for w in range(len(planes[0])):
                x = planes[0][w][u][:, None] ^ planes[0][w][lo:hi]
                for plane in planes[1:-1]:
                    x |= plane[w][u][:, None] ^ plane[w][lo:hi]
                x |= planes[-1][w][u][:, None]
                differ += np.bitwise_count(x)
            hit = (differ <= most) & (ids[lo:hi] < ids[u][:, None])
            if two:
                hit &= part[lo:hi] != part[u][:, None]
            row, j = np.nonzero(hit)
            at, end = (np.searchsorted(row, np.arange(len(u)), side) for side in ("left", "right"))
            open_, take, done = np.flatnonzero(at < end), 1, np.zeros(len(u), bool)
            while len(open_):
                many = np.minimum(take, end[open_] - at[open_])
                k = np.arange(many.sum()) + np.repeat(at[open_] - (np.cumsum(many) - many), many)
                good = np.concatenate([in_passage(near[u[row[c]]], near[j[c] + lo], min_words, min_alike) for c in (k[i : i + 4096] for i in range(0, len(k), 4096))])
                rows, first = np.unique(row[k[good]], return_index=True)
                found.append((u[rows], j[k[good][first]] + lo))
                done[rows] = True
                at[open_] += many
                open_ = open_[~done[open_] & (at[open_] < end[open_])]
                take *= 4
            rest.append(u[~done])
        left = np.concatenate(rest) if rest else left[:0]
        lo, step = hi, min(4 * step, 4096)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (left[:0], left[:0])


@lean
def _compared(batches, min_words, min_alike):
    """Places (seed, a, b, part, id, pos, near) sorted by seed, a, b, id and pos, as sure matches: each place with the first
    that first_alike finds for it among those of the same seed, a and b. A group that goes on in the next batch is held back; it has 2 TILE places or about so many."""

    def matches(cols):
        *key, part, ids, pos = cols[:-1]
        near, planes = cols[-1], _planes(cols[-1])
        head = np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in key]))
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:], len(ids))
        out = []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if ids[s] != ids[e - 1]:
                u, j = first_alike(near[s:e], [[w[s:e] for w in plane] for plane in planes], ids[s:e], part[s:e], min_words, min_alike)
                out.append((u + s, j + s))
        if out:
            u, j = (np.concatenate(c) for c in zip(*out, strict=True))
            yield from _rows("id long, pos int, other long, opos int, sure boolean", ids[u], pos[u], ids[j], pos[j], np.ones(len(u), bool))

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, off = buffers(batch.column(6))
        held.append([*(c.to_numpy(zero_copy_only=False) for c in batch.columns[:6]), raw[off[0] : off[-1]].reshape(batch.num_rows, -1)])
        size += batch.num_rows
        if size >= JOINED:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in cols[:3]]))
            cut = int(cut[-1]) + 1 if len(cut) else 0
            if cut:
                yield from matches([c[:cut] for c in cols])
            held = [[c[cut:] for c in cols]]
            size = min(JOINED - 1, len(cols[0]) - cut)
    if held:
        yield from matches([np.concatenate(c) for c in zip(*held, strict=True)])


def _everywhere(texts: DataFrame, table, min_words: int, min_alike: float, folder: str) -> DataFrame:
    """Matches of the places of frequent seeds with all earlier places, not with the first and the previous only: each place that lies
    in a passage of an earlier document, unshifted, has one. Of places with the same min_words words before and
    behind only the first takes part; the others are runs. The places of a seed are dealt into tiles of
    about TILE by TILE pairs, so that memory does not grow with a seed; the pairs do, with the square of its different surroundings."""
    rows = texts.mapInArrow(partial(_places, table=table, reach=min_words), PLACES).repartition("seed", "around").sortWithinPartitions("seed", "around", "id", "pos")
    places = staged(rows.mapInArrow(_firsts, PLACES).drop("around"), folder)
    large = staged(places.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > TILE))
    parts = F.coalesce(F.ceil(F.col("n") / TILE), F.lit(1)).cast("int")
    dealt = places.join(few(large), "seed", "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id", "pos"), F.col("parts")).cast("int"))
    tiles = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("seed", F.least("part", "with").alias("a"), F.greatest("part", "with").alias("b"), "part", "id", "pos", "near")
    tiles = tiles.repartition("seed", "a", "b").sortWithinPartitions("seed", "a", "b", "id", "pos")
    return tiles.mapInArrow(partial(_compared, min_words=min_words, min_alike=min_alike), "id long, pos int, other long, opos int, sure boolean")


class Fenwick:
    """Prefix maxima of (value, index) over places 1..n."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(0.0, -1)] * (n + 1)

    def raise_to(self, place: int, value: tuple[float, int]) -> None:
        while place < len(self.best):
            if value[0] > self.best[place][0]:
                self.best[place] = value
            place += place & -place

    def upto(self, place: int) -> tuple[float, int]:
        found = (float("-inf"), -1)
        while place > 0:
            if self.best[place][1] >= 0 and self.best[place][0] > found[0]:
                found = self.best[place]
            place -= place & -place
        return found


def chains(pos: np.ndarray, opos: np.ndarray) -> list[np.ndarray]:
    """Anchors (sorted by pos, then opos) as chains: lists of indexes along which both places
    rise. An anchor scores K, a step costs GAP_COST a word on either side; a chain begins
    anew where the best one before would score less than nothing. The best chain comes
    first, each anchor is in one chain."""
    n = len(pos)
    if n == 1:
        return [np.zeros(1, np.int64)]
    step = GAP_COST * (np.diff(pos) + np.diff(opos))
    if (np.diff(opos) > 0).all() and (np.diff(pos) > 0).all():
        # Already in order: the anchor before is then always the best to come from.
        starts, score = [0], float(K)
        for i, cost in enumerate(step.tolist(), 1):
            if score <= cost:
                starts.append(i)
                score = float(K)
            else:
                score += K - cost
        return [np.arange(a, b) for a, b in zip(starts, [*starts[1:], n], strict=True)]
    places = np.searchsorted(np.unique(opos), opos) + 1
    tree, score, came = Fenwick(int(places.max())), [0.0] * n, [-1] * n
    i = 0
    while i < n:
        j = i
        while j < n and pos[j] == pos[i]:  # equal places do not follow each other
            shift = GAP_COST * float(pos[j] + opos[j])
            value, index = tree.upto(int(places[j]) - 1)
            gain = value - shift
            score[j], came[j] = (K + gain, index) if index >= 0 and gain > 0 else (float(K), -1)
            j += 1
        for m in range(i, j):
            tree.raise_to(int(places[m]), (score[m] + GAP_COST * float(pos[m] + opos[m]), m))
        i = j
    used, out = [False] * n, []
    for end in sorted(range(n), key=lambda a: -score[a]):
        chain, at = [], end
        while at >= 0 and not used[at]:
            chain.append(at)
            used[at] = True
            at = came[at]
        if chain:
            out.append(np.array(chain[::-1]))
    return out


CHAIN = "id long, other long, pos array<int>, opos array<int>"


@lean
def _chained(batches):
    """Matches sorted by id, other, pos, opos in each partition, as chains of two anchors or
    more, or of a sure one: an equal run of min_words has a sure one, whatever else it has. A
    pair of documents that goes on in the next batch is held back."""
    held = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            cols = [np.concatenate((h, c)) for h, c in zip(held, cols, strict=True)]
        ids, _, others, _, _ = cols
        if not len(ids):
            continue
        last = np.flatnonzero((ids != ids[-1]) | (others != others[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        held = [c[cut:] for c in cols]
        if cut:
            yield _chain_batch(*[c[:cut] for c in cols])
    if held is not None and len(held[0]):
        yield _chain_batch(*held)


def _chain_batch(ids, pos, others, opos, sure):
    new = np.ones(len(ids), bool)  # a match may come twice
    new[1:] = (ids[1:] != ids[:-1]) | (others[1:] != others[:-1]) | (pos[1:] != pos[:-1]) | (opos[1:] != opos[:-1])
    sure = np.logical_or.reduceat(sure, np.flatnonzero(new))
    ids, pos, others, opos = (c[new] for c in (ids, pos, others, opos))
    head = np.ones(len(ids), bool)
    head[1:] = (ids[1:] != ids[:-1]) | (others[1:] != others[:-1])
    starts = np.flatnonzero(head)
    ends = np.append(starts[1:], len(ids))
    some = (ends - starts > 1) | sure[starts]
    rows = ([], [], [], [])
    for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True):
        p, o = pos[a:b], opos[a:b]
        for chain in chains(p, o):
            far = np.flatnonzero(np.maximum(np.diff(p[chain]), np.diff(o[chain])) > MAX_GAP) + 1
            for part in np.split(chain, far) if len(far) else (chain,):
                if len(part) == 1 and not sure[a + part[0]]:
                    continue
                for col, v in zip(rows, (ids[a], others[a], p[part], o[part]), strict=True):
                    col.append(v)
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["id", "other", "pos", "opos"])


@lean
def _shortened(batches):
    """(id, text) to (id, words): 2 bytes of hash for each word, which travel in place of the text. Two
    different words are equal in them one time in 65,536, which no passage hangs on."""
    for batch in batches:
        raw, off = buffers(batch.column(1))
        for i, j in chunks(off):
            words, bound = words_of(raw, off[i : j + 1])
            short = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((2 * bound).astype(np.int32)), pa.py_buffer(words.astype(np.uint16))])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), short], ["id", "words"])


@lean
def _slices(batches):
    """(id, words, spans) to (id, first, last, own, words): the words of each span, which is clipped to the text."""
    for batch in batches:
        raw, off = buffers(batch.column(1))
        spans = batch.column(2).to_pylist()
        rows = ([], [], [], [], [])
        for k, i in enumerate(batch.column(0).to_pylist()):
            own = raw[off[k] : off[k + 1]].view(np.uint16)
            for s in spans[k]:
                for col, v in zip(rows, (i, s["first"], s["last"], s["own"], own[max(0, s["first"]) : s["last"]].tobytes()), strict=True):
                    col.append(v)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], ["id", "first", "last", "own", "words"])


#: Cells of one table of common subsequences; larger ones are halved (Hirschberg).
CELLS = 1 << 20


def _lcs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of a longest common subsequence of two word lists."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(a) * len(b) > CELLS and len(a) > 1:
        half = len(a) // 2
        cut = int((_lcs_rows(a[:half], b)[-1] + _lcs_rows(a[half:][::-1], b[::-1])[-1][::-1]).argmax())
        (x, y), (u, v) = _lcs(a[:half], b[:cut]), _lcs(a[half:], b[cut:])
        return np.concatenate((x, u + half)), np.concatenate((y, v + cut))
    rows = np.array(_lcs_rows(a, b, True))
    i, j, pairs = len(a), len(b), []
    while i and j:
        if rows[i, j] == rows[i - 1, j]:
            i -= 1
        elif rows[i, j] == rows[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return np.array([p[0] for p in pairs[::-1]], np.int64), np.array([p[1] for p in pairs[::-1]], np.int64)


def _lcs_rows(a: np.ndarray, b: np.ndarray, keep: bool = False) -> list[np.ndarray]:
    """Lengths of the common subsequences of prefixes of a (the last, or all) and of b."""
    row = np.zeros(len(b) + 1, np.int32)
    rows = [row]
    for x in a:
        old, row = row, row.copy()
        row[1:] = np.maximum.accumulate(np.maximum(old[1:], np.where(b == x, old[:-1] + 1, 0)))
        if keep:
            rows.append(row)
        else:
            rows[0] = row
    return rows


def align(a: np.ndarray, b: np.ndarray, pos: np.ndarray, opos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the equal words of two word lists along a chain of anchors
    (places in the lists). Between anchors equally far apart, and beyond the ends, the words
    are compared one by one, else by their longest common subsequence."""
    p, o = pos.tolist(), opos.tolist()
    at, bt, parts = p[0] - min(p[0], o[0]), o[0] - min(p[0], o[0]), []
    if p[0] - o[0] == p[-1] - o[-1] and (pos - opos == p[0] - o[0]).all():  # nothing is shifted
        n = min(len(a) - at, len(b) - bt)
        same = np.flatnonzero(a[at : at + n] == b[bt : bt + n])
        return same + at, same + bt

    def level(x, y, n):
        same = np.flatnonzero(a[x : x + n] == b[y : y + n])
        parts.append((same + x, same + y))

    for x, y in zip(p, o, strict=True):
        if x - at == y - bt:  # the seeds may overlap
            level(at, bt, x + K - at)
        elif x >= at and y >= bt:
            u, v = _lcs(a[at:x], b[bt:y])
            parts.append((u + at, v + bt))
            level(x, y, K)
        else:  # overlap on one side only: what is new on both
            new = min(x + K - at, y + K - bt)
            if new > 0:
                level(x + K - new, y + K - new, new)
        at, bt = x + K, y + K
    level(at, bt, min(len(a) - at, len(b) - bt))
    return np.concatenate([u for u, _ in parts]), np.concatenate([v for _, v in parts])


def _longest(x: np.ndarray, y: np.ndarray, min_words: int, min_alike: float) -> tuple[int, int] | None:
    """The most matches i..j in a row that span min_words of the one text and of which each
    text has min_alike of the words; None if there are none."""
    n, least = len(x), max(1, int(np.ceil(min_alike * min_words - 1e-9)))
    if n < least:
        return None
    i = np.arange(n)
    left, right = ([i + k - min_alike * (v + k) for v in (x, y)] for k in (0, 1))
    most = n
    for u, v in zip(left, right, strict=True):  # either text alone bounds the length
        after = np.maximum.accumulate(v[::-1])
        most = min(most, int((n - np.searchsorted(after, u - 1e-9) - i).max()))
    for m in range(most, least - 1, -1):
        ok = x[m - 1 :] - x[: n - m + 1] + 1 >= min_words
        for u, v in zip(left, right, strict=True):
            ok &= v[m - 1 :] >= u[: n - m + 1] - 1e-9
        if ok.any():
            return int(ok.argmax()), int(ok.argmax()) + m - 1
    return None


def segments(x: np.ndarray, y: np.ndarray, min_words: int, min_alike: float) -> list[tuple[int, int]]:
    """First and last match of each passage among the matches at the places x and y: the
    maximal segments by score (Ruzzo-Tompa; a match 1, a different word -2) that are
    long and alike enough, and what else is so between them."""
    if not len(x):
        return []
    gap = np.maximum(np.diff(x), np.diff(y)) - 1
    heads = np.concatenate(([0], np.flatnonzero(gap) + 1))
    tails = np.append(heads[1:], len(x)) - 1
    found: list[tuple[int, int, int, int]] = []
    total = 0
    for k, (s, e) in enumerate(zip(heads.tolist(), tails.tolist(), strict=True)):
        low = total - (2 * int(gap[s - 1]) if k else 0)
        total = low + e - s + 1
        own, j = (s, e, low, total), len(found) - 1
        while j >= 0:
            if found[j][2] >= own[2]:
                j -= 1
            elif found[j][3] >= own[3]:
                break
            else:
                own = (found[j][0], own[1], found[j][2], own[3])
                del found[j:]
                j = len(found) - 1
        found.append(own)
    good = [(s, e) for s, e, _, _ in found if x[e] - x[s] + 1 >= min_words and e - s + 1 >= min_alike * max(x[e] - x[s] + 1, y[e] - y[s] + 1) - 1e-9]
    out, rest = list(good), [(a + 1, b) for a, b in zip([-1, *(e for _, e in good)], [*(s for s, _ in good), len(x)], strict=True)]
    while rest:
        a, b = rest.pop()
        more = _longest(x[a:b], y[a:b], min_words, min_alike)
        if more:
            out.append((a + more[0], a + more[1]))
            rest += [(a, a + more[0]), (a + more[1] + 1, b)]
    return sorted(out)


PASSAGE = "id long, first int, last int, other long, other_first int, other_last int, matched int"


@lean
def _aligned(batches, min_words, min_alike):
    least = min_alike * min_words - 1e-9
    for batch in batches:
        rows = []
        ids, others, first, ofirst = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in (0, 1, 4, 5))
        (at, values), (oat, ovalues) = ((col.offsets.to_numpy().tolist(), col.values.to_numpy(zero_copy_only=False).astype(np.int64)) for col in (batch.column(2), batch.column(3)))
        (raw, off), (oraw, ooff) = (buffers(batch.column(c)) for c in (6, 7))
        for r, (i, o) in enumerate(zip(ids, others, strict=True)):
            a, b = raw[off[r] : off[r + 1]].view(np.uint16), oraw[ooff[r] : ooff[r + 1]].view(np.uint16)
            x, y = max(0, first[r]), max(0, ofirst[r])
            u, v = align(a, b, values[at[r] : at[r + 1]] - x, ovalues[oat[r] : oat[r + 1]] - y)
            if len(u) < least:
                continue
            for s, e in segments(u, v, min_words, min_alike):
                rows.append((i, u[s] + x, u[e] + 1 + x, o, v[s] + y, v[e] + 1 + y, e - s + 1))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "first", "last", "other", "other_first", "other_last", "matched"])


def _matches(texts: DataFrame, blocks, rare: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """Matches by the seeds that blocks makes of texts, and the frequent seeds; both are staged in folder."""
    rows = texts.mapInArrow(blocks, SEEDS)
    rows = rows.repartition(F.coalesce("seed", F.xxhash64("id", "pos"))).sortWithinPartitions("seed", "id", "pos")
    both = staged(rows.mapInArrow(partial(_joined, rare=rare, at_once=JOINED), MATCH), folder)
    return both.where("other is not null").drop("seed"), both.where("seed is not null").select("seed")


def _table(seeds: DataFrame) -> np.ndarray:
    """TABLE_BITS bits, of which those of the seeds are set: of one size, however many seeds there are."""
    bit = F.col("seed").bitwiseAND(F.lit(TABLE_BITS - 1))
    got = seeds.select(F.shiftright(bit, 6).alias("at"), F.expr("shiftleft(1L, cast(seed & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(TABLE_BITS // 64, np.int64)
    table[got["at"].to_numpy()] = got["bits"].to_numpy()
    return table.view(np.uint64)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_alike: float = MIN_ALIKE) -> DataFrame:
    """One row per passage of a document that aligns with a passage of a document of smaller
    id: id_col, first_word, end_word (words of the whole text, the end exclusive), other_id,
    other_first, other_end, matched (equal words). Words are lower-cased A-Z.

    Every copy of a passage but that of the smallest id is in some row; pairs of copies
    are not all listed. Null, empty and short texts have no passages; rows that repeat an id are
    one document (with the same text: if texts differ, which of them a span is cut from is
    open); repeats inside one document do not count; null ids take no part; texts of any
    length are read whole. Other columns are ignored."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    spark = docs.sparkSession
    folders = [scratch(spark) for _ in range(5)]
    matches, frequent = _matches(texts, _seeds, RARE, folders[0])
    table = spark.sparkContext.broadcast(_table(frequent))
    common, _ = _matches(texts, partial(_runs, table=table, length=min_words), 0, folders[1])
    more = staged(_everywhere(texts, table, min_words, min_alike, folders[4]), folders[3])
    table.destroy()
    give_back(spark, folders[4])
    found = staged(matches.union(common).union(more).where("other < id").repartition("id", "other").sortWithinPartitions("id", "other", "pos", "opos").mapInArrow(_chained, CHAIN))
    give_back(spark, folders[0], folders[1], folders[3])

    first = lambda c: F.get(c, F.lit(0)) - min_words
    last = lambda c: F.element_at(c, -1) + K + min_words
    # The other's spans at multiples of STEP: it has few of them, however many share its words.
    low, high = (F.floor(first("opos") / STEP) * STEP).cast("int"), (F.ceil(last("opos") / STEP) * STEP).cast("int")
    near = found.withColumns({"d0": first("pos"), "d1": last("pos"), "o0": low, "o1": high})
    asked = near.select("id", F.col("d0").alias("first"), F.col("d1").alias("last"), F.lit(True).alias("own")).union(near.select("other", "o0", "o1", F.lit(False)))
    asked = staged(asked.groupBy("id").agg(F.collect_set(F.struct("first", "last", "own")).alias("spans")), folders[2])
    cut = staged(texts.mapInArrow(_shortened, "id long, words binary").join(few(asked), "id").select("id", "words", "spans").mapInArrow(_slices, "id long, first int, last int, own boolean, words binary"))
    give_back(spark, folders[2])
    # An id may repeat; its spans are made one by the shuffle that the join needs.
    mine = cut.where("own").select("id", F.col("first").alias("d0"), F.col("last").alias("d1"), F.col("words").alias("a")).dropDuplicates(["id", "d0", "d1"])
    theirs = cut.where("not own").select(F.col("id").alias("other"), F.col("first").alias("o0"), F.col("last").alias("o1"), F.col("words").alias("b")).dropDuplicates(["other", "o0", "o1"])
    both = near.join(mine, ["id", "d0", "d1"]).join(theirs, ["other", "o0", "o1"]).select("id", "other", "pos", "opos", "d0", "o0", "a", "b")
    out = both.mapInArrow(partial(_aligned, min_words=min_words, min_alike=min_alike), PASSAGE)
    return out.select(F.col("id").alias(id_col), F.col("first").alias("first_word"), F.col("last").alias("end_word"), F.col("other").alias("other_id"), F.col("other_first"), F.col("other_last").alias("other_end"), "matched")


@lean
def _cut(batches):
    """(everything of documents, spans): texts without the words of their spans."""
    table = np.ones(256, bool)
    table[list(SPACES)] = False
    for batch in batches:
        at = batch.schema.get_field_index("text")
        raw, off = buffers(batch.column(at))
        spans = batch.column(batch.num_columns - 1).to_pylist()
        texts = batch.column(at).to_pylist()
        for k, own in enumerate(spans):
            if own:
                data = raw[off[k] : off[k + 1]]
                word = table[data]
                edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
                starts, ends = edge[::2], edge[1::2]
                keep = np.ones(len(data), bool)
                for s in own:
                    keep[starts[s["first_word"]] : ends[s["end_word"] - 1]] = False
                texts[k] = data[keep].tobytes().decode().strip()
        cols = [pa.array(texts, pa.string()) if c == at else batch.column(c) for c in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1])


def without_repeats(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """documents (doc_id, text, lang, source, n_chars) with the passages cut from their
    texts and n_chars counted anew; all rows stay."""
    spans = staged(passages.groupBy("doc_id").agg(F.collect_set(F.struct("first_word", "end_word")).alias("spans")))
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").join(few(spans), "doc_id", "left")
    cut = rows.mapInArrow(_cut, docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    return cut.withColumn("n_chars", F.length("text").cast("long"))
