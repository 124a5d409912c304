"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1: straight lines between
knots. Its integral, scaled to the source's target, is the cumulative demand for its
words. A source's documents stand in a fixed hash order, read again and again; the
time at which the demand reaches the words before a document is its position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, few, staged

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No source and no document is taken more often.
MAX_REPEATS = 3
#: (time, relative weight) knots for each of WEIGHTS: early, level and late sources.
SCHEDULES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.75, 1.0), (1.0, 2.25)))


def _pieces(knots):
    """(time, weight, slope, integral before, integral after) of each piece of a schedule
    scaled to the integral 1."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    out, done = [], 0.0
    for a, b in zip(knots, knots[1:], strict=False):
        own = (b[0] - a[0]) * (a[1] + b[1]) / 2 / area
        out.append((a[0], a[1] / area, (b[1] - a[1]) / (b[0] - a[0]) / area, done, done + own))
        done += own
    return out


def schedule_inverse(share: Column, knots) -> Column:
    """The time at which the integral of a schedule, scaled to 1, reaches share (0..1)."""
    chain, pieces = None, _pieces(knots)
    for i, (t, w, slope, before, after) in enumerate(pieces):
        left = share - F.lit(before)
        at = F.lit(t) + (left / F.lit(w) if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), F.lit(w * w) + F.lit(2 * slope) * left)) - F.lit(w)) / F.lit(slope))
        last = i + 1 == len(pieces)
        chain = at if chain is None and last else F.when(share < F.lit(after), at) if chain is None else chain.otherwise(at) if last else chain.when(share < F.lit(after), at)
    return chain


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeats=MAX_REPEATS) -> DataFrame:
    """From (source, size) rows: source, rank (from 0 by code point, null last),
    source_size, weight, target. Shares of the whole by weight stop at max_repeats times
    the source's size; the excess is shared again by weight until none is above. One row
    for each source, so the windows over all of them stay small."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("rank") % len(weights) + 1))
    per = per.withColumn("cap", F.col("source_size") * max_repeats)
    by = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    per = per.withColumns(
        {
            "fill": F.row_number().over(by),
            "left": F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "heavy": F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    per = per.withColumn("level", F.col("left") / F.col("heavy"))
    per = per.withColumn("free", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("fill")))
    first = Window.partitionBy()
    per = per.withColumn("open", F.min("free").over(first)).withColumn("level", F.min_by("level", "free").over(first))
    target = F.when(F.col("fill") < F.col("open"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return per.select("source", "rank", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, max_repeats=MAX_REPEATS, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """One row per document: id, size (words), source_size, target (of its source),
    copies (how often the mix takes it), taken (copies * size), position (of its first
    copy, null if none is taken) and positions (of all copies).

    A null source is a source of its own; a null or empty text has the size 0 and is
    taken as often as its place in the order says, max_repeats times at most, for 0 words. Repeated rows are
    mixed like others. No rows give no rows. Ties of the hash order fall by id and size,
    so reruns agree. Sums over a source come from 4,096 hash ranges, so that no task
    holds a source. Other columns are ignored."""
    sized = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    )
    sized = staged(sized.withColumn("key", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))).withColumn("bin", F.substring("key", 1, 3)))
    per = targets(sized, weights, max_repeats)
    bins = sized.groupBy("source", "bin").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("total").over(before), F.lit(0))).select(F.col("source").alias("s"), F.col("bin").alias("b"), "before")
    per = few(staged(per.select(F.col("source").alias("t"), "rank", "source_size", "target")))
    inside = Window.partitionBy("source", "bin").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(bins, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
        .join(per, F.col("source").eqNullSafe(F.col("t")))
        .withColumn("start", F.col("before") + F.col("inside"))
    )
    # Whole passes over the source, then the documents whose middle lies in the rest.
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - passes * F.col("source_size")
    rows = rows.withColumn("copies", F.least((passes + (F.col("start") + F.col("size") / 2 <= rest).cast("int")).cast("int"), F.lit(max_repeats)))
    share = lambda epoch: F.least(F.lit(1.0), F.try_divide(epoch * F.col("source_size") + F.col("start"), F.col("target")))

    def at(epoch):
        kind = F.col("rank") % len(weights)
        chain = F.when(kind == 0, schedule_inverse(share(epoch), schedules[0]))
        for i in range(1, len(weights)):
            chain = chain.when(kind == i, schedule_inverse(share(epoch), schedules[i]))
        return F.coalesce(chain, F.lit(0.0))

    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), at)).otherwise(F.array().cast("array<double>"))
    return rows.withColumn("positions", positions).select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
        F.get("positions", F.lit(0)).alias("position"),
        "positions",
    )


def training_order(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The copies of mix() in training order: id, copy (from 0), position; dealt by range
    of position and sorted within each range."""
    copies = mixed.select(id_col, F.posexplode("positions").alias("copy", "position"))
    return copies.repartitionByRange(F.col("position"), F.col(id_col), F.col("copy")).sortWithinPartitions("position", id_col, "copy")
