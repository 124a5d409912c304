"""Scores of texts by a causal self-attention model on subword ids.

A text is its lower-cased words and an end; a word is its subword ids and an end. The
probability of a text is a product of three parts, so that over all texts they add up to 1 at most:

* the id that each word begins with, or the end, by a network over the first ids before: self-attention
  in windows of 32 that overlap by half, so that every token is scored once, with 16 to 31
  tokens before it;
* the word among those of its first id, by the corpus counts; words that training
  lacks have a share of it together (Witten-Bell);
* for a word that training lacks, all its other ids and its end, by a second network of the same
  form over the ids of one word, in windows of 16 that overlap by half.

Either network gives a distribution over groups of ids; an id within its group follows the counts.

Counts come from all training texts, and every window of them is trained on, in one of the
rounds; the second network trains on all distinct words. Training is in numpy, data-parallel: every
task makes Adam steps on its windows from the same weights, which are averaged.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, buffers, chunks, crc_fold, lean, least_count, mix, staged, words_of

END, BEGIN, PAD, IDS = 50_256, 50_257, 50_258, 50_259
#: Inputs of a window of words' first ids, and of one of a word's ids; the last half is scored.
SPAN, SPELL, WIDTH, HIDDEN = 32, 16, 16, 32
#: Groups of ids: the most frequent ids alone, the others by clusters of their contexts.
ALONE, CLUSTERS, KNOWN_IDS, CONTEXTS = 24, 40, 16_384, 128
GROUPS = ALONE + CLUSTERS
#: Windows of a task at least; tasks of the first so many windows, and one more for each so many.
TASK_WINDOWS, FEW_TASKS, MORE_WINDOWS = 4096, 64, 1 << 16
#: Rounds, windows of a step, its rate; windows of one numpy pass, small enough for a processor's cache.
ROUNDS, BATCH, RATE = 3, 512, 0.01
PIECE = 128
#: The most frequent words, this many at most, are broadcast with counts and first ids, 18 bytes each.
MAX_BROADCAST_WORDS = 5_000_000
#: Words that are encoded in one call.
AT_ONCE = 4096
#: Words that a task keeps with their ids.
CACHE_WORDS = 1_000_000
END_WORD = np.uint64(0xE0D0_E0D0_E0D0_E0D1)


#: Bytes that white space beyond ASCII begins with, in UTF-8.
_MAY_SPACE = np.isin(np.arange(256), (0xC2, 0xE1, 0xE2, 0xE3))


class Lexer:
    """Subword ids of words, by the words' hashes; a cache of first ids of a bounded size."""

    def __init__(self, ranks, pattern, known=None):
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.spaced = np.zeros(max(ranks.values()) + 1, bool)  # ids that begin with a space
        self.spaced[[i for token, i in ranks.items() if token[:1] == b" "]] = True
        self.hash, self.first = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.known = known if known and len(known[0]) else None  # sorted hashes and first ids of many words
        self.fresh = None  # a list gets the words that are new to the cache: (hash, ids, bounds)

    def look(self, raw, off, words):
        """The distinct hashes of the words of consecutive texts, each word's place among
        them, where each is first, and their first ids."""
        each, place, inverse = np.unique(words, return_index=True, return_inverse=True)
        found, lack = np.zeros(len(each), np.int32), np.ones(len(each), bool)
        if self.known:
            at = np.minimum(np.searchsorted(self.known[0], each), len(self.known[0]) - 1)
            lack = self.known[0][at] != each
            found = self.known[1][at].astype(np.int32)
        if lack.any():
            found[lack] = self._firsts(raw, off, each[lack], place[lack])
        return each, inverse, place, found

    def ids(self, raw, off, place):
        """All subword ids of the words at these places, and the bounds of each word's. Words without
        white space of their own (beyond ASCII) are encoded many at once: each begins at an id that begins with a space."""
        starts, ends = word_spans(raw, off)
        data, starts, ends = raw[off[0] : off[-1]], starts[place], ends[place]
        odd = np.concatenate(([0], np.cumsum(_MAY_SPACE[data])))
        plain = odd[ends] == odd[starts]
        text, out, count = data.tobytes().lower(), [], np.zeros(len(place), np.int64)
        many, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        cuts = list(zip(starts[many].tolist(), ends[many].tolist(), strict=True))
        for i in range(0, len(many), AT_ONCE):
            own = many[i : i + AT_ONCE]
            got = np.array(self.encoding.encode_ordinary(b"".join([b" " + text[a:b] for a, b in cuts[i : i + AT_ONCE]]).decode()), np.int64)
            count[own] = np.diff(np.append(np.flatnonzero(self.spaced[got]), len(got)))
            out.append(got)
        for k in rest.tolist():
            got = self.encoding.encode_ordinary(" " + text[starts[k] : ends[k]].decode())
            count[k] = len(got)
            out.append(np.array(got, np.int64))
        if not len(rest):
            return np.concatenate(out) if out else np.zeros(0, np.int64), np.concatenate(([0], np.cumsum(count)))
        order = np.argsort(np.concatenate((np.repeat(many, count[many]), np.repeat(rest, count[rest]))), kind="stable")
        return np.concatenate(out)[order], np.concatenate(([0], np.cumsum(count)))

    def _firsts(self, raw, off, each, place):
        """First ids of words, through the cache."""
        if len(self.hash) > CACHE_WORDS:
            self.hash, self.first = self.hash[:0], self.first[:0]
        at = np.searchsorted(self.hash, each)
        new = np.ones(len(each), bool)
        inside = at < len(self.hash)
        new[inside] = self.hash[at[inside]] != each[inside]
        if new.any():
            ids, bound = self.ids(raw, off, place[new])
            if self.fresh is not None:
                self.fresh.append((each[new], ids, bound))
            first = ids[bound[:-1]].astype(np.int32)
            self.hash, self.first = np.insert(self.hash, at[new], each[new]), np.insert(self.first, at[new], first)
            at = np.searchsorted(self.hash, each)
        return self.first[at]


def word_spans(raw, off):
    table = np.ones(256, bool)
    table[list(SPACES)] = False
    data, own = raw[off[0] : off[-1]], off - off[0]
    keep = table[data]
    before = np.concatenate(([False], keep[:-1])) if len(keep) else keep
    after = np.concatenate((keep[1:], [False])) if len(keep) else keep
    before[own[:-1][own[:-1] < own[1:]]] = False
    after[own[1:][own[:-1] < own[1:]] - 1] = False
    return np.flatnonzero(keep & ~before), np.flatnonzero(keep & ~after) + 1


def windows(ids: np.ndarray, bound: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Windows of span + 1 ids of sequences ids[bound[i]:bound[i+1]], and each window's
    sequence. Its first span ids are inputs; the targets of the last half of them are
    the ids after them. Every id and end is a target once."""
    half, count = span // 2, np.diff(bound)
    blocks = (count + 1 + half - 1) // half  # inputs: begin and the ids; targets: ids, end
    size = half + blocks * half + 1
    starts = np.cumsum(size) - size
    flat = np.full(int(size.sum()), PAD, np.uint16)
    flat[starts + half] = BEGIN
    at = np.arange(len(ids)) - np.repeat(bound[:-1], count) + np.repeat(starts + half + 1, count)
    flat[at] = ids
    flat[starts + half + 1 + count] = END
    own = np.repeat(np.arange(len(count)), blocks)
    inside = np.arange(len(own)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = starts[own] + inside * half
    return flat[begin[:, None] + np.arange(span + 1)], own


def _binary(ids: np.ndarray, bound: np.ndarray) -> pa.Array:
    """The ids of each sequence as bytes, two an id."""
    ids = np.ascontiguousarray(ids[bound[0] : bound[-1]], np.uint16)
    return pa.Array.from_buffers(pa.binary(), len(bound) - 1, [None, pa.py_buffer((2 * (bound - bound[0])).astype(np.int32)), pa.py_buffer(ids)])


def _unpacked(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and bounds of _binary's sequences."""
    raw, off = buffers(col)
    return raw[off[0] : off[-1]].view(np.uint16), (off - off[0]) // 2


@lean
def _counted(batches, ranks, pattern):
    """Rows (kind, key, n, first, ids) of training texts: 0 words by hash, 1 windows
    to train on, 2 all ids of a word, by its hash."""
    lexer = Lexer(ranks.value, pattern)
    lexer.fresh = []
    held = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))

    def out(kind, key, n, first=None, ids=None):
        for i in range(0, len(key), 1 << 16):
            cut = slice(i, i + (1 << 16))
            m = len(key[cut])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(m, kind, np.int32)),
                    pa.array(key[cut]),
                    pa.array(n[cut]),
                    pa.nulls(m, pa.int32()) if first is None else pa.array(first[cut]),
                    pa.nulls(m, pa.binary()) if ids is None else _binary(ids[0], ids[1][i : i + m + 1]),
                ],
                ["kind", "key", "n", "first", "ids"],
            )

    for batch in batches:
        ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
        raw, off = buffers(batch.column(1))
        for i, j in chunks(off):
            words, bound = words_of(raw, off[i : j + 1])
            each, inverse, _, first = lexer.look(raw, off[i : j + 1], words)
            for key, *spelled in lexer.fresh:
                yield from out(2, key.view(np.int64), np.ones(len(key), np.int64), None, spelled)
            lexer.fresh.clear()
            n = np.bincount(inverse, minlength=len(each)).astype(np.int64)
            each, n, first = np.append(each, END_WORD), np.append(n, j - i), np.append(first, np.int32(END))
            keys = np.concatenate((held[0], each))
            order = np.argsort(keys, kind="stable")
            keys, counts, firsts = keys[order], np.concatenate((held[1], n))[order], np.concatenate((held[2], first))[order]
            head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            held = (keys[head], np.add.reduceat(counts, head), firsts[head])
            if len(held[0]) > CACHE_WORDS:
                yield from out(0, held[0].view(np.int64), held[1], held[2])
                held = tuple(a[:0] for a in held)
            got, text = windows(first[:-1][inverse], bound)
            inside = np.arange(len(text)) - np.searchsorted(text, text)
            lot = mix(ids[i:j][text].astype(np.uint64) * np.uint64(1_000_003) + inside.astype(np.uint64))
            yield from out(1, lot.view(np.int64), np.ones(len(lot), np.int64), None, (got.ravel(), np.arange(len(lot) + 1) * got.shape[1]))
    yield from out(0, held[0].view(np.int64), held[1], held[2])


def _ids(batches, span):
    for batch in batches:
        if batch.num_rows:
            yield _unpacked(batch.column(batch.num_columns - 1))[0].reshape(-1, span + 1)


@lean
def _totals(batches, span):
    """How often each id is a target of windows."""
    total = np.zeros(IDS, np.int64)
    for ids in _ids(batches, span):
        total += np.bincount(ids[:, span // 2 + 1 :].ravel(), minlength=IDS)
    total[PAD] = 0
    a = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(total[a])], ["key", "n"])


@lean
def _contexts(batches, rank, span):
    """How often an id (by rank) has each of the frequent ids after it, and before it: every
    pair of neighbours once."""
    total, near = np.zeros(KNOWN_IDS * CONTEXTS, np.int64), CONTEXTS // 2
    for ids in _ids(batches, span):
        r = rank[ids[:, span // 2 :]]
        a, b = r[:, :-1].ravel(), r[:, 1:].ravel()
        for own, other, at in ((a, b, 0), (b, a, near)):
            some = (own < KNOWN_IDS) & (other < near)
            np.add.at(total, own[some] * CONTEXTS + other[some] + at, 1)
    a = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(total[a])], ["key", "n"])


@lean
def _word_windows(batches):
    """(key, ids) of words to (key, ids) of their windows."""
    for batch in batches:
        got, own = windows(*_unpacked(batch.column(1)), SPELL)
        key = batch.column(0).to_numpy().view(np.uint64)[own] + (np.arange(len(own)) - np.searchsorted(own, own)).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(mix(key).view(np.int64)), _binary(got.ravel(), np.arange(len(got) + 1) * got.shape[1])], ["key", "ids"])


def _clusters(points, weights, k, rounds=20):
    draw = np.random.default_rng(3)
    centres = points[draw.choice(len(points), min(k, len(points)), replace=False, p=weights / weights.sum())]
    for _ in range(rounds):
        own = ((points[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for c in range(len(centres)):
            if (mine := own == c).any():
                centres[c] = np.average(points[mine], axis=0, weights=weights[mine])
    return own


def _start(total: np.ndarray, table: np.ndarray, span: int = SPAN) -> tuple[dict, np.ndarray]:
    """First weights and the group of each id. total: counts of ids; table: contexts of the
    ids in order of frequency."""
    draw = np.random.default_rng(5)
    order = np.argsort(-total, kind="stable")[:KNOWN_IDS]
    share = np.sqrt(table / np.maximum(table.sum(axis=1, keepdims=True), 1))
    u, s, _ = np.linalg.svd(share - np.average(share, axis=0, weights=total[order] + 1e-9), full_matrices=False)
    points = (u * s)[:, :WIDTH]
    points = points / max(1e-9, points[: 4 * ALONE].std())
    group = np.full(IDS, GROUPS - 1, np.int64)
    seen = total[order] > 0
    group[order[:ALONE]] = np.arange(ALONE)
    some = np.flatnonzero(seen[ALONE:]) + ALONE
    if len(some):
        group[order[some]] = ALONE + _clusters(points[some], total[order[some]].astype(float), CLUSTERS)
    emb = draw.normal(0, 0.05, (IDS, WIDTH))
    emb[order] += 0.5 * points
    w = {
        "E": emb, "P": draw.normal(0, 0.02, (span, WIDTH)), "Q": draw.normal(0, 0.1, (WIDTH, WIDTH)), "K": draw.normal(0, 0.1, (WIDTH, WIDTH)), "V": np.eye(WIDTH),
        "A": draw.normal(0, 0.25, (2 * WIDTH, HIDDEN)), "a": np.zeros(HIDDEN), "B": np.zeros((HIDDEN, GROUPS)),
        "b": np.log((np.bincount(group, weights=total, minlength=GROUPS) + 0.5) / (total.sum() + 0.5 * GROUPS)),
    }
    return {k: v.astype(np.float32) for k, v in w.items()}, group


_CAUSAL = {n: np.where(np.arange(n)[None, :] <= n // 2 + np.arange(n // 2)[:, None], 0, -1e9).astype(np.float32) for n in (SPAN, SPELL)}


def _maps(w: dict) -> tuple[np.ndarray, np.ndarray]:
    """What queries and keys come to as one map, and A over what is gathered, before V, and the own input."""
    return w["Q"] @ w["K"].T * w["E"].dtype.type(WIDTH**-0.5), np.concatenate((w["V"] @ w["A"][:WIDTH], w["A"][WIDTH:]))


def _sums(a: np.ndarray) -> np.ndarray:
    """Sums over the last axis, which is kept: a product of matrices, faster than sum over a short axis."""
    return a @ np.ones((a.shape[-1], 1), a.dtype)


def _logits(w: dict, maps, x: np.ndarray, pad: int = PAD):
    """Logits of the groups after each of the last half of the inputs, the largest of each place 0: masked
    self-attention over windows x of ids. maps: _maps(w). Queries meet the inputs themselves through one map (of Q and K), and what
    they gather meets the hidden layer through one (of V and A), so that only the last half is multiplied by weights."""
    n, span = x.shape
    half = span // 2
    emb = w["E"].take(x, axis=0)
    emb += w["P"]
    both = np.empty((n, half, 2 * WIDTH), emb.dtype)  # what a place gathers, and its own
    both[..., WIDTH:] = emb[:, half:]
    q = np.ascontiguousarray(both[..., WIDTH:]).reshape(-1, WIDTH) @ maps[0]
    q = q.reshape(n, half, WIDTH)
    s = q @ emb.transpose(0, 2, 1)
    s += _CAUSAL[span]
    empty = x == pad
    some = np.flatnonzero(empty.any(axis=1))
    if len(some):
        s[some] += np.where(empty[some], np.float32(-1e9), np.float32(0))[:, None, :]
    s -= s.max(axis=2, keepdims=True)
    np.exp(s, out=s)
    s /= _sums(s.reshape(-1, span)).reshape(n, half, 1)
    both[..., :WIDTH] = s @ emb
    r = both.reshape(-1, 2 * WIDTH) @ maps[1]
    r += w["a"]
    np.maximum(r, 0, out=r)
    o = r @ w["B"]
    o += w["b"]
    o -= o.max(axis=1, keepdims=True)
    return o, (emb, q, s, both, r)


def forward(w: dict, x: np.ndarray, pad: int = PAD) -> np.ndarray:
    """Log-probabilities of the groups after each of the last half of the inputs."""
    o = _logits(w, _maps(w), x, pad)[0]
    o -= np.log(_sums(np.exp(o)))
    return o.reshape(len(x), x.shape[1] // 2, -1)


def gradients(w: dict, x: np.ndarray, group: np.ndarray, pad: int = PAD) -> tuple[float, dict]:
    """Mean loss of windows of ids (the last only a target), and its gradients; that of E as
    (ids of the inputs, their rows). Windows are taken PIECE at a time, which stay in a processor's cache."""
    span = x.shape[1] - 1
    half = span // 2
    many = max(1, int((x[:, half + 1 :] != pad).sum()))
    maps, scale = _maps(w), w["E"].dtype.type(WIDTH**-0.5)
    flat = lambda a: a.reshape(-1, a.shape[-1])
    demb, loss, sums = np.empty((len(x), span, WIDTH), w["E"].dtype), 0.0, None
    for i in range(0, len(x), PIECE):
        inputs, target = x[i : i + PIECE, :span], x[i : i + PIECE, half + 1 :]
        do, (emb, q, s, both, r) = _logits(w, maps, inputs, pad)
        real, goal, at = (target != pad).ravel(), group[target].ravel(), np.arange(target.size)
        told = do[at, goal]
        np.exp(do, out=do)
        total = _sums(do)[:, 0]
        loss -= float((told - np.log(total))[real].sum()) / many
        do *= (real / (total * many)).astype(do.dtype)[:, None]
        do[at, goal] -= (real / many).astype(do.dtype)
        dr = do @ w["B"].T
        dr *= r > 0
        dboth = (dr @ maps[1].T).reshape(both.shape)
        dgather = np.ascontiguousarray(dboth[..., :WIDTH])
        ds = dgather @ emb.transpose(0, 2, 1)
        ds -= np.einsum("ijk,ijk->ij", ds, s)[:, :, None]
        ds *= s
        dq = flat(ds @ emb)
        own = demb[i : i + PIECE]
        np.matmul(np.concatenate((s, ds), axis=1).transpose(0, 2, 1), np.concatenate((dgather, q), axis=1), out=own)
        own[:, half:] += dboth[..., WIDTH:]
        own[:, half:] += (dq @ maps[0].T).reshape(q.shape)
        one = np.ones(len(do), do.dtype)
        parts = (r.T @ do, one @ do, flat(both).T @ dr, one @ dr, flat(both[..., WIDTH:]).T @ dq)
        sums = parts if sums is None else tuple(a + b for a, b in zip(sums, parts, strict=True))
    by_b, by_bias, by_mixed, by_a, by_query = sums
    g = {"B": by_b, "b": by_bias, "a": by_a, "A": np.concatenate((w["V"].T @ by_mixed[:WIDTH], by_mixed[WIDTH:]))}
    g |= {"Q": by_query @ w["K"] * scale, "K": by_query.T @ w["Q"] * scale, "V": by_mixed[:WIDTH] @ w["A"][:WIDTH].T, "P": demb.sum(axis=0)}
    every = x[:, :span].ravel()
    order = np.argsort(every, kind="stable")
    ids = every[order]
    head = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    g["E"] = (ids[head], np.add.reduceat(flat(demb).take(order, axis=0), head, axis=0))
    return loss, g


def train(w: dict, x: np.ndarray, group: np.ndarray, rate: float = RATE) -> tuple[dict, float]:
    """One pass of Adam over windows; the mean loss of the last tenth. A step moves the rows
    of E of the ids in its windows only."""
    ids, inverse = np.unique(np.append(x, np.uint16(PAD)), return_inverse=True)
    x, pad, group, whole = inverse[:-1].astype(np.uint16).reshape(x.shape), int(inverse[-1]), group[ids], w["E"].copy()
    w = {k: (v[ids] if k == "E" else v.copy()) for k, v in w.items()}
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    losses = []
    size = min(BATCH, max(32, len(x) // 64))  # few windows make small steps, so that there are some
    for step, i in enumerate(range(0, len(x), size), 1):
        loss, g = gradients(w, x[i : i + size], group, pad)
        losses.append(loss)
        one, two = np.float32(rate / (1 - 0.9**step)), np.float32(1 / (1 - 0.99**step))
        for k, d in g.items():
            at, d = d if k == "E" else (slice(None), d)
            mk, vk = m[k][at], v[k][at]
            mk += np.float32(0.1) * (d - mk)
            vk += np.float32(0.01) * (d * d - vk)
            m[k][at], v[k][at] = mk, vk
            w[k][at] -= one * mk / (np.sqrt(two * vk) + np.float32(1e-8))
    whole[ids] = w["E"]
    return w | {"E": whole}, float(np.mean(losses[-max(1, len(losses) // 10) :])) if losses else 0.0


def _packed(w: dict, start: dict) -> tuple[bytes, bytes, bytes]:
    """What training changed: the rows of E that moved, their moves, and all other moves."""
    rows = np.flatnonzero((w["E"] != start["E"]).any(axis=1)).astype(np.int32)
    rest = b"".join((w[k] - start[k]).tobytes() for k in sorted(w) if k != "E")
    return rows.tobytes(), (w["E"][rows] - start["E"][rows]).tobytes(), rest


def _add(total: dict, n: int, rows: bytes, moves: bytes, rest: bytes) -> None:
    total["E"][np.frombuffer(rows, np.int32)] += n * np.frombuffer(moves, np.float32).reshape(-1, WIDTH)
    at = 0
    for k in sorted(total):
        if k != "E":
            size = total[k].size * 4
            total[k] += n * np.frombuffer(rest[at : at + size], np.float32).reshape(total[k].shape)
            at += size


TRAINED = "n long, loss double, rows binary, moves binary, rest binary"


@lean
def _trained(batches, weights, turn, span):
    """How this task's windows of the turn move the weights, and how many they were."""
    w, group = weights.value
    parts = list(_ids(batches, span))
    x = np.concatenate(parts) if parts else np.zeros((0, span + 1), np.uint16)
    if len(x):
        after, loss = train(w, x, group, RATE / (1 + turn))
        yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([loss]), *(pa.array([v], pa.binary()) for v in _packed(after, w))], ["n", "loss", "rows", "moves", "rest"])


class Net:
    """A trained network: weights, the group of each id, and the log share of an id in it."""

    def __init__(self, weights, group, total):
        self.weights, self.group = weights, group
        self.inside = np.log((total + 0.1) / np.bincount(group, weights=total + 0.1, minlength=GROUPS)[group])


class Model:
    """What scoring needs; of a bounded size."""

    def __init__(self, texts: Net, words: Net, types, total):
        self.texts, self.words, self.types, self.total = texts, words, types, total
        self.training, self.distinct = int(total.sum()), int(types.sum())


def fit(rows: DataFrame, span: int) -> Net:
    """The network of staged windows (key, ids), each trained on in one of the rounds."""
    spark = rows.sparkSession

    def summed(task, size):
        got, out = rows.select("ids").mapInArrow(task, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow(), np.zeros(size, np.int64)
        out[got["key"].to_numpy()] = got["n"].to_numpy()
        return out

    total = summed(partial(_totals, span=span), IDS)
    order = np.argsort(-total, kind="stable")[:KNOWN_IDS]
    rank = np.full(IDS, KNOWN_IDS, np.int64)
    rank[order] = np.arange(len(order))
    w, group = _start(total, summed(partial(_contexts, rank=rank, span=span), KNOWN_IDS * CONTEXTS).reshape(KNOWN_IDS, CONTEXTS), span)
    many = rows.count()
    tasks = max(1, min(FEW_TASKS + many // MORE_WINDOWS, many // TASK_WINDOWS))
    for turn in range(ROUNDS if many else 0):
        own = rows.where(F.pmod("key", F.lit(ROUNDS)) == turn).select("key", "ids")
        own = own.repartition(tasks, F.xxhash64("key")).sortWithinPartitions("key")
        shared = spark.sparkContext.broadcast((w, group))
        made = staged(own.mapInArrow(partial(_trained, weights=shared, turn=turn, span=span), TRAINED))
        seen, moves = 0, {k: np.zeros(v.shape) for k, v in w.items()}
        for r in made.toLocalIterator():  # one task's moves at a time
            seen += r.n
            _add(moves, r.n, r.rows, r.moves, r.rest)
        w = {k: (v + moves[k] / max(1, seen)).astype(np.float32) for k, v in w.items()}
        shared.destroy()
    return Net(w, group, total)


def learn(counted: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the staged counts of words (key, first, n)."""
    counts = staged(counted.where("kind = 0").groupBy("key").agg(F.sum("n").alias("n"), F.min("first").alias("first")))
    per = counts.groupBy("first").agg(F.sum("n").alias("n"), F.count("*").alias("types")).toArrow()
    total, types = np.zeros(IDS, np.int64), np.zeros(IDS, np.int64)
    total[per["first"].to_numpy()], types[per["first"].to_numpy()] = per["n"].to_numpy(), per["types"].to_numpy()
    texts = fit(counted.where("kind = 1").select("key", "ids"), SPAN)
    spelled = counted.where("kind = 2").groupBy("key").agg(F.first("ids").alias("ids"))  # each word once
    words = fit(staged(spelled.mapInArrow(_word_windows, "key long, ids binary")), SPELL)
    return Model(texts, words, types, total), counts


def _arrays(batches):
    for b in batches:
        key, n, first = (b.column(c).to_numpy() for c in range(3))
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (key, n, first.astype(np.uint16))], ["key", "n", "first"])


def _broadcast_counts(counts: DataFrame):
    parts = counts.select("key", "n", "first").mapInArrow(_arrays, "key binary, n binary, first binary").collect()
    key, n, first = (np.frombuffer(b"".join(r[c] for r in parts), t) for c, t in (("key", np.uint64), ("n", np.int64), ("first", np.uint16)))
    order = np.argsort(key)
    return key[order], n[order], first[order]


def _lexical(model, first, c):
    """Log-probability of words of the counts c among those with their first id; of all that
    training lacks together, for c = 0: the share of distinct words in the occurrences."""
    t, n = np.maximum(model.types[first], 1), model.total[first]
    return np.log(np.where(c > 0, c, t) / (n + t))


def attended(net: Net, ids, own, many: int, skip: bool = False) -> np.ndarray:
    """Natural-log probability of the ids and the end of each of many sequences, by their
    windows; with skip, of what follows its first id."""
    out, span, maps = np.zeros(many), ids.shape[1] - 1, _maps(net.weights)
    for i in range(0, len(ids), PIECE):
        x = ids[i : i + PIECE]
        target = x[:, span // 2 + 1 :]
        o = _logits(net.weights, maps, x[:, :span])[0]
        told = np.take_along_axis(o, net.group[target].reshape(-1, 1), 1)[:, 0].astype(float)
        told = (told - np.log(_sums(np.exp(o, out=o))[:, 0])).reshape(target.shape)
        told = np.where(target == PAD, 0.0, told + net.inside[target])
        if skip:
            told[x[:, span // 2] == BEGIN, 0] = 0
        out += np.bincount(own[i : i + PIECE], weights=told.sum(axis=1), minlength=many)
    return out


def spelled(model: Model, ids: list[list[int]]) -> np.ndarray:
    """Natural-log probability of words' ids after their first, and of their ends."""
    return spelled_flat(model, np.array([i for x in ids for i in x], np.int64), np.cumsum([0, *map(len, ids)]))


def spelled_flat(model: Model, ids: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The same of words whose ids are ids[bound[i]:bound[i+1]]."""
    return attended(model.words, *windows(ids, bound, SPELL), len(bound) - 1, skip=True) if len(bound) > 1 else np.zeros(0)


class Scorer:
    """Scores consecutive texts with the model and the counts of words at hand."""

    def __init__(self, ranks, pattern, model, counts):
        self.model = model.value
        self.key, self.n, first = counts.value
        self.lexer = Lexer(ranks.value, pattern, (self.key, first))
        self.floor = np.log10(self.model.training + self.model.distinct + 1)

    def known(self, hashes):
        if not len(self.key):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.key, hashes), len(self.key) - 1)
        return np.where(self.key[at] == hashes, self.n[at], 0)

    def read(self, raw, off):
        """Of the texts: bounds of words, the distinct words' hashes, places, first ids and
        counts, each word's place among them, and each word's text."""
        words, bound = words_of(raw, off)
        each, inverse, place, first = self.lexer.look(raw, off, words)
        return bound, each, inverse, place, first, self.known(each), np.repeat(np.arange(len(off) - 1), np.diff(bound))


SCORED = "n_tokens long, n_known long, base_score double, score double"


@lean
def _scored(batches, ranks, pattern, model, counts, complete):
    """Batches (.., text) to (.., n_tokens, n_known, base_score, score) by the broadcast counts. If these
    are complete, a word that they lack is one that training lacks; else it is left to _word_rows."""
    scorer = Scorer(ranks, pattern, model, counts)
    m, floor = scorer.model, scorer.floor
    end = int(scorer.known(np.array([END_WORD]))[0])
    for batch in batches:
        raw, off = buffers(batch.column(batch.num_columns - 1))
        for i, j in chunks(off):
            bound, each, inverse, place, first, c, text = scorer.read(raw, off[i : j + 1])
            word = np.zeros(len(each))
            told = np.ones(len(each), bool) if complete else c > 0
            word[told] = _lexical(m, first[told], c[told])
            new = np.flatnonzero(c == 0) if complete else np.zeros(0, int)
            if len(new):
                word[new] += spelled_flat(m, *scorer.lexer.ids(raw, off[i : j + 1], place[new]))
            sums = lambda v: np.bincount(text, weights=v[inverse], minlength=j - i)  # noqa: B023, E731
            got, own = windows(first[inverse], bound)
            score = (attended(m.texts, got, own, j - i) + sums(word)) / np.log(10)
            base = sums(np.where(told, np.log10(c + 1) - floor, 0.0)) + np.log10(end + 1) - floor
            known = sums((c > 0).astype(float)).astype(np.int64) + int(end > 0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).slice(i, j - i) for k in range(batch.num_columns - 1)), pa.array(np.diff(bound) + 1), pa.array(known), pa.array(base), pa.array(score)],
                [*batch.schema.names[:-1], "n_tokens", "n_known", "base_score", "score"],
            )


@lean
def _word_rows(batches, ranks, pattern, model, counts):
    """(row, key, m, first, spelled): the distinct words of each text that are not broadcast."""
    scorer = Scorer(ranks, pattern, model, counts)
    for batch in batches:
        rows = batch.column(0).to_numpy(zero_copy_only=False)
        raw, off = buffers(batch.column(1))
        for i, j in chunks(off):
            _, each, inverse, place, first, c, text = scorer.read(raw, off[i : j + 1])
            log = np.zeros(len(each))
            new = np.flatnonzero(c == 0)
            if len(new):
                log[new] = spelled_flat(scorer.model, *scorer.lexer.ids(raw, off[i : j + 1], place[new]))
            lack = c[inverse] == 0
            both, m = np.unique(text[lack] * max(1, len(each)) + inverse[lack], return_counts=True)
            t, e = np.divmod(both, max(1, len(each)))
            yield pa.RecordBatch.from_arrays([pa.array(rows[i:j][t]), pa.array(each[e].view(np.int64)), pa.array(m.astype(np.int64)), pa.array(first[e]), pa.array(log[e] / np.log(10))], ["row", "key", "m", "first", "spelled"])


def lm_scores(docs: DataFrame, ranks: dict[bytes, int], pattern: str, folds: int = 7, hold_out: int = 2, id_col: str = "doc_id", text_col: str = "text", broadcast_words: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """One row per document: id_col, held_out, n_tokens (words and the end), n_known (those
    that occur in training), train_tokens, base_score (log10, add-one unigrams of words) and
    score (log10 probability of the text under the model). The rows are a written table.

    Only texts whose crc32 of the id modulo folds is not hold_out are learned from; null
    ids are learned from. A null or empty text is only its end. Repeated rows count and
    are scored each. Texts and words of any length are scored whole. Without training texts nothing is
    known and the model is uniform over groups. Other columns are ignored.

    The counts of the most frequent words are broadcast. If there are more words, the others
    are joined by word, in which none is frequent; the scores are the same."""
    spark = docs.sparkSession
    held = F.coalesce(crc_fold("id", folds) == hold_out, F.lit(False))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("held_out", held)
    shared = spark.sparkContext.broadcast(ranks)
    counted = staged(texts.where(~F.col("held_out")).select("id", "text").mapInArrow(partial(_counted, ranks=shared, pattern=pattern), "kind int, key long, n long, first int, ids binary"))
    found, counts = learn(counted)
    model = spark.sparkContext.broadcast(found)
    least = least_count(counts, broadcast_words)
    known = spark.sparkContext.broadcast(_broadcast_counts(counts.where((F.col("n") >= least) | (F.col("first") == END))))
    parts = {"ranks": shared, "pattern": pattern, "model": model, "counts": known}
    if not least:
        out = staged(texts.select("id", "held_out", "text").mapInArrow(partial(_scored, complete=True, **parts), f"id long, held_out boolean, {SCORED}"))
    else:
        rows = staged(texts.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "text"))
        words = rows.select("row", "text").mapInArrow(partial(_word_rows, **parts), "row long, key long, m long, first int, spelled double")
        per = spark.createDataFrame([(int(i), float(found.types[i]), float(found.total[i])) for i in np.flatnonzero(found.total)], "first int, t double, total double")
        c, floor = F.coalesce("n", F.lit(0)), float(np.log10(found.training + found.distinct + 1))
        t, total = F.greatest(F.coalesce("t", F.lit(0.0)), F.lit(1.0)), F.coalesce("total", F.lit(0.0))
        sums = (
            words.join(counts.where(F.col("n") < least).select("key", "n"), "key", "left")
            .join(F.broadcast(per), "first", "left")  # a row for each id
            .groupBy("row")
            .agg(
                F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("words_known"),
                F.sum(F.col("m") * (F.log10(c + 1) - floor)).alias("words_base"),
                F.sum(F.col("m") * (F.log10(F.when(c > 0, c).otherwise(t) / (total + t)) + F.when(c > 0, 0.0).otherwise(F.col("spelled")))).alias("words_score"),
            )
        )
        apart = rows.mapInArrow(partial(_scored, complete=False, **parts), f"row long, id long, held_out boolean, {SCORED}")
        more = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        out = staged(apart.join(sums, "row", "left").select("id", "held_out", "n_tokens", more("n_known", "words_known"), more("base_score", "words_base"), more("score", "words_score")))
    for b in (shared, model, known):
        b.destroy()
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(found.training).cast("long").alias("train_tokens"), "base_score", "score")
