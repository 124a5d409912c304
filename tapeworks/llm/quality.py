"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is w . f(text) with features f of the whole text: shares of its words and
word pairs by buckets of their hash, and surface counts. Pairs of
a better and a worse labelled document are preferences; w maximises the logistic
likelihood of the differences f(better) - f(worse), by Newton steps. Strengths become
scores through a logistic curve placed so that the strength at the quantile of the share
of worse documents has the score THRESHOLD.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, chunks, crc_fold, grams, lean, staged, words_of

#: Labelled documents of each class that the fit reads at most, those with the smallest
#: hash of the id: a bound for the driver, not for what is scored.
MAX_LABELLED = 10_000
#: Preference pairs of the fit: each document of the larger class meets so many of the other.
OPPONENTS = 2
THRESHOLD = 0.3
#: Penalties of the weights of surface features and of buckets.
RIDGE, BUCKET_RIDGE = 1e-3, 3e-2
#: Buckets of words, and as many of word pairs.
BUCKETS = 128
#: Rows of one numpy pass: a row of features each.
PASS_ROWS = 2048

_CLASS = np.full(256, 8, np.uint8)  # other ASCII
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"-()?", b"!", b"#$%&*@^~|<>{}[]\\/=+_`")):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 9
SURFACE = 24
FEATURES = SURFACE + 2 * BUCKETS


def bucketed(words: np.ndarray, word_doc: np.ndarray, n: int) -> np.ndarray:
    """Of n texts, with the words' hashes in order of text: square roots of the shares of words, and of pairs
    of neighbouring words, in each bucket."""
    pairs = grams(words, 2)
    inside = word_doc[1:] == word_doc[:-1]
    shift = np.uint64(65 - BUCKETS.bit_length())
    out = []
    for hashes, doc in ((words, word_doc), (pairs[inside], word_doc[1:][inside])):
        count = np.bincount(doc * BUCKETS + (hashes >> shift).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS)
        out.append(np.sqrt(count / np.maximum(1, count.sum(axis=1, keepdims=True))))
    return np.concatenate(out, axis=1)


def features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Features of consecutive texts, a row each; an empty text has zeros but its length. The
    surface counts come first."""
    n = len(off) - 1
    own = off - off[0]
    data = raw[off[0] : off[-1]]
    size = np.diff(own)
    doc = np.repeat(np.arange(n), size)
    share = np.bincount(doc * 10 + _CLASS[data], minlength=n * 10).reshape(n, 10) / np.maximum(size, 1)[:, None]
    words, bound = words_of(raw, off)
    count = np.diff(bound)
    word_doc = np.repeat(np.arange(n), count)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (word_doc[1:] == word_doc[:-1])
    order = np.lexsort((words, word_doc))
    w, d = words[order], word_doc[order]
    fresh = np.ones(len(w), bool)
    fresh[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(fresh)
    runs = np.diff(np.append(at, len(w)))
    top = np.zeros(n)
    np.maximum.at(top, d[at], runs)
    safe = np.maximum(count, 1)
    distinct = np.bincount(d[at], minlength=n)
    repeat = np.bincount(word_doc[same], minlength=n) / safe
    lines = np.bincount(doc[data == 10], minlength=n) + 1
    length = np.log1p(size)
    out = [
        *np.sqrt(share.T),
        share[:, 7],
        share[:, 0],
        np.log1p(count),
        np.log1p(count) ** 2 / 10,
        length / 3,
        np.log1p(size / safe),
        repeat,
        np.sqrt(repeat),
        np.where(count > 0, distinct / safe, 0),
        np.where(count > 0, np.log(np.maximum(distinct, 1)) / np.log1p(safe), 0),
        top / safe,
        np.log1p(count / lines),
        np.log1p(lines),
        share[:, 6] ** 0.25,
    ]
    return np.concatenate((np.stack(out, axis=1), bucketed(words, word_doc, n)), axis=1)


@lean
def _featured(batches):
    """(label, text) to (label, features as float32)."""
    for batch in batches:
        raw, off = buffers(batch.column(1))
        for i, j in chunks(off, rows=PASS_ROWS):
            rows = features(raw, off[i : j + 1]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([r.tobytes() for r in rows], pa.binary())], ["label", "f"])


@lean
def _scored(batches, weights, base):
    """(id, text) to (id, score)."""
    for batch in batches:
        raw, off = buffers(batch.column(1))
        for i, j in chunks(off, rows=PASS_ROWS):
            strength = features(raw, off[i : j + 1]) @ weights + base
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(1 / (1 + np.exp(-np.clip(strength, -700, 700))))], ["id", "score"])


def fit_bradley_terry(better: np.ndarray, worse: np.ndarray, seed: int = 7):
    """mean, scale and weights of the features, and the strength at the quantile of the
    share of worse rows. Preference pairs are drawn between the two sets; their differences
    are made block by block."""
    n = len(better) + len(worse)
    mean = (better.sum(axis=0, dtype=np.float64) + worse.sum(axis=0, dtype=np.float64)) / n
    scale = np.sqrt(sum(((rows[i : i + PASS_ROWS] - mean) ** 2).sum(axis=0) for rows in (better, worse) for i in range(0, len(rows), PASS_ROWS)) / n)
    scale[scale == 0] = 1
    draw = np.random.default_rng(seed)
    many = max(len(better), len(worse)) * OPPONENTS
    one, two = draw.permutation(many) % len(better), draw.permutation(many) % len(worse)
    beta = np.zeros(better.shape[1])
    ridge = np.where(np.arange(len(beta)) < SURFACE, RIDGE, BUCKET_RIDGE)
    for _ in range(30):
        grad, hess = -ridge * beta, np.diag(ridge)
        for i in range(0, many, PASS_ROWS):
            x = (better[one[i : i + PASS_ROWS]].astype(np.float64) - worse[two[i : i + PASS_ROWS]]) / scale
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            grad += x.T @ (1 - p) / many
            hess += (x * (p * (1 - p))[:, None]).T @ x / many
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    weights = beta / scale
    strengths = np.concatenate([rows[i : i + PASS_ROWS].astype(np.float64) @ weights - mean @ weights for rows in (better, worse) for i in range(0, len(rows), PASS_ROWS)])
    return mean, scale, beta, float(np.quantile(strengths, (len(worse) - 0.5) / max(1, n - 1)))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, hold_out: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: id_col, held_out, score (0..1), predicted (1 if score >= 0.3).

    Labels are learned only from ids whose crc32 modulo folds is not hold_out. Null and
    empty texts get the score of a text without words; null ids are scored and not held
    out; rows that repeat are scored alike (of labelled ids that repeat, the least text is
    learned from); a very long text is read whole. Without labels of both classes every score
    is 0.5. Columns other than id and text are ignored."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    told = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null")
    told = told.where(crc_fold("id", folds) != hold_out).groupBy("id").agg(F.max("label").alias("label"))
    told = staged(told.join(texts.select("id"), "id", "left_semi"))
    some = [told.where(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(MAX_LABELLED) for v in (1, 0)]
    some = F.broadcast(staged(some[0].union(some[1])))  # twice MAX_LABELLED ids at most
    known = texts.join(some, "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    made = known.repartition(F.col("id")).sortWithinPartitions("id").select("label", "text").mapInArrow(_featured, "label int, f binary").toArrow()
    label, rows = made["label"].to_numpy(), np.frombuffer(b"".join(made["f"].to_pylist()), np.float32).reshape(-1, FEATURES)
    del made
    order = np.lexsort((*rows[:, :3].T, label))  # whatever tasks the rows came from
    label, rows = label[order], rows[order]
    held = F.coalesce(crc_fold("id", folds) == hold_out, F.lit(False))
    weights, base = np.zeros(FEATURES), 0.0
    if 0 < label.sum() < len(label):
        mean, scale, beta, cut = fit_bradley_terry(rows[label == 1], rows[label == 0])
        weights = beta / scale
        base = float(np.log(THRESHOLD / (1 - THRESHOLD)) - mean @ weights - cut)
    out = texts.mapInArrow(partial(_scored, weights=weights, base=base), "id long, score double")
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "score").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
