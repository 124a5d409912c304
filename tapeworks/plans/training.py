"""Features, labels, time folds and logistic models of forward returns."""

from __future__ import annotations

import functools
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from ..functions.scoring import FEATURES, feature_columns
from ..operators.indicators import by, indicated
from ..sources.ingest import MODEL
from ..sources.shared import staged

# Horizons in days, folds and least numbers of bars, rows and samples.
HORIZONS = [3, 5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100]
DEPLOY, FOLDS = 50, 5
MIN_BARS, MIN_TRAIN, MIN_TEST, MIN_SAMPLES = 65, 100, 20, 500
C = F.col


def with_closes(bars: DataFrame, horizons: list[int] = HORIZONS) -> DataFrame:
    """ticker, trade_date, the features, the close, and for each horizon the close so many bars later and its date. Closes are
    whole numbers, which take less room than the returns that follow from them (see returned). Rows with an undefined
    feature are dropped after the look ahead."""
    ind = indicated(bars, ahead=max(horizons))
    ratio, band = F.when(C("v20") > 0, C("volume_ratio")), F.when(C("width2") > 0, C("bb_percent_b"))
    own = feature_columns(C("close"), C("ma5"), C("ma20"), C("ma60"), C("rsi"), C("macd_histogram"), band, ratio)
    ahead = {}
    for h in horizons:
        ahead[f"close_{h}"] = F.lead("close", h).over(by())
        ahead[f"target_date_{h}"] = F.lead("trade_date", h).over(by())
    rows = ind.withColumns(own | ahead).where(C("own") & (C("many") >= MIN_BARS) & (C("rn") >= 20))
    return rows.select("ticker", "trade_date", *FEATURES, "close", *ahead).dropna(subset=FEATURES)


def returned(rows: DataFrame, horizons: list[int] = HORIZONS) -> DataFrame:
    """Rows of with_closes with returns in place of closes; others as they are."""
    if f"close_{horizons[0]}" not in rows.columns:
        return rows
    ahead = [c for h in horizons for c in ((F.try_divide(C(f"close_{h}"), C("close")) - 1).alias(f"fwd_return_{h}"), C(f"target_date_{h}"))]
    return rows.select("ticker", "trade_date", *FEATURES, *ahead)


def features(bars: DataFrame, horizons: list[int] = HORIZONS) -> DataFrame:
    """ticker, trade_date, the features, and for each horizon the forward return and the date
    it refers to. Rows with an undefined feature are dropped after the look ahead."""
    return returned(with_closes(bars, horizons), horizons)


#: Rows of a day that one task takes at once; more are narrowed down, by histograms of so many buckets.
MOST_A_DAY, BUCKETS = 100_000, 1024


def _medians(day: pa.Table, horizons: list[int]) -> pa.Table:
    """The medians of one day's rows, horizon by horizon, of their returns or of those that follow from their closes."""
    found = []
    if "close" in day.column_names:
        day = day.filter(pc.fill_null(pc.not_equal(day["close"], 0), False))
    for h in horizons:
        if "close" in day.column_names:
            later = day[f"close_{h}"]
            v = later.drop_null().to_numpy() / day["close"].filter(later.is_valid()).to_numpy() - 1
        else:
            v = day[f"fwd_return_{h}"].drop_null().to_numpy()
        if len(v):
            a, b = (len(v) - 1) // 2, len(v) // 2
            v = np.partition(v, (a, b))
            found.append((h, v[a] * 0.5 + v[b] * 0.5))
    own = day["trade_date"].take(np.zeros(len(found), np.int64))  # none of a day without closes
    return pa.table([own, pa.array([h for h, _ in found], pa.int32()), pa.array([m for _, m in found], pa.float64())], ["trade_date", "horizon", "median"])


def day_medians(rows: DataFrame, horizons: list[int] = HORIZONS, most: int = MOST_A_DAY) -> DataFrame:
    """trade_date, horizon, median: the exact median forward return of each day and horizon that has one.

    Rows meet by day, each once with the returns of all horizons (rows of with_closes with their closes, which are shorter). Days of more than
    most rows are narrowed down in place of that."""
    closes = f"close_{horizons[0]}" in rows.columns
    wide = rows = rows.select("trade_date", *(["close", *[f"close_{h}" for h in horizons]] if closes else [f"fwd_return_{h}" for h in horizons]))
    long = staged(rows.groupBy(C("trade_date").alias("_day")).agg(F.count("*").alias("n")).where(C("n") > most).select("_day"))
    schema = f"trade_date {rows.schema['trade_date'].dataType.simpleString()}, horizon int, median double"
    taken = lambda own: own.groupBy("trade_date").applyInArrow(lambda day: _medians(day, horizons), schema)
    if not long.limit(1).count():
        return taken(rows)
    same = C("trade_date").eqNullSafe(C("_day"))
    if closes:
        wide = rows.select("trade_date", *[(F.try_divide(C(f"close_{h}"), C("close")) - 1).alias(f"fwd_return_{h}") for h in horizons])
    return taken(rows.join(F.broadcast(long), same, "left_anti")).unionByName(_narrowed(wide.join(F.broadcast(long), same, "left_semi"), horizons, most))


def _narrowed(rows: DataFrame, horizons: list[int], most: int) -> DataFrame:
    """The medians of days with many rows. Histograms narrow down where the middle lies: each pass counts by day, horizon and
    bucket, with partial sums, and keeps the buckets of the two middle ranks. The values between the last bounds are counted by
    value and ranked; so no task sorts a day."""
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), C(f"fwd_return_{h}").alias("value")) for h in horizons]))
    each = rows.select("trade_date", each.alias("e")).select("trade_date", "e.*").where("value is not null")
    keys = ["trade_date", "horizon"]
    ends = [F.min("value").alias("lo"), F.max("value").alias("hi")]
    bounds = staged(each.groupBy(*keys).agg(F.count("*").alias("n"), *ends).withColumns({"inside": C("n"), "below": F.lit(0).cast("long")}))
    first, second = F.floor((C("n") + 1) / 2) - C("below"), F.floor(C("n") / 2) + 1 - C("below")  # the middle ranks, from 1
    wide, solved = (C("lo") < C("hi")) & (C("inside") > most), []
    narrow = [bounds.where(~wide)]
    bounds = bounds.where(wide)
    while bounds.limit(1).count():
        bucket = F.least(F.floor((C("value") - C("lo")) / (C("hi") - C("lo")) * BUCKETS), F.lit(BUCKETS - 1))  # the first has lo, the last hi
        inside = each.join(bounds, keys).where("value >= lo and value <= hi").groupBy(*keys, "n", "below", bucket.alias("bucket")).agg(F.count("*").alias("many"), *ends)
        upto = F.sum("many").over(Window.partitionBy(*keys).orderBy("bucket"))  # at most BUCKETS rows
        inside = inside.withColumn("upto", upto).where((C("upto") >= first) & (C("upto") - C("many") < second))
        bounds = inside.groupBy(*keys, "n").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max_by("hi", -C("bucket")).alias("a"), F.max_by("lo", "bucket").alias("b"), F.sum("many").alias("inside"), F.min(C("below") + C("upto") - C("many")).alias("below"), F.count("*").alias("buckets"))
        bounds = staged(bounds)
        solved.append(bounds.where("buckets = 2").select(*keys, (C("a") * 0.5 + C("b") * 0.5).alias("median")))  # the last of one and the first of the next
        bounds = bounds.where("buckets = 1").drop("a", "b", "buckets")
        narrow.append(bounds.where(~wide))
        bounds = bounds.where(wide)
    left = functools.reduce(DataFrame.unionByName, narrow)
    if solved:
        each = each.join(left.select(*keys, "lo", "hi"), keys).where("value >= lo and value <= hi")
    values = each.groupBy(*keys, "value").agg(F.count("*").alias("many")).join(left.select(*keys, "n", "below"), keys)
    upto = F.sum("many").over(Window.partitionBy(*keys).orderBy("value"))
    values = values.withColumn("upto", upto).where((C("upto") >= first) & (C("upto") - C("many") < second))
    found = values.groupBy(*keys).agg((F.min("value") * 0.5 + F.max("value") * 0.5).alias("median"))
    return functools.reduce(DataFrame.unionByName, [found, *solved])


def labelled(rows: DataFrame, horizons: list[int] = HORIZONS, most: int = MOST_A_DAY) -> DataFrame:
    """Features with label_abs (return above 0) and label_rel (above the day's median). The features are made
    once, in a written table, with closes in place of returns if rows are of with_closes; medians, a row for each day, come
    back as a broadcast while they are few."""
    rows = staged(rows)
    medians = day_medians(rows, horizons, most).groupBy("trade_date").agg(*[F.max(F.when(C("horizon") == h, C("median"))).alias(f"median_{h}") for h in horizons])
    medians = staged(medians)
    out = returned(rows, horizons).join(F.broadcast(medians) if medians.count() <= MOST_A_DAY else medians, "trade_date", "left")
    label = lambda test: F.when(test, 1.0).when(~test, 0.0)
    for h in horizons:
        r = C(f"fwd_return_{h}")
        out = out.withColumns({f"label_abs_{h}": label(r > 0), f"label_rel_{h}": label(r > C(f"median_{h}"))})
    return out.select("ticker", *[c for c in out.columns if c != "ticker" and not c.startswith("median_")])


def long_form(rows: DataFrame, horizons: list[int] = HORIZONS, mode: str = "rel") -> DataFrame:
    """One row per horizon with a known label: horizon, label, target_date."""
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), C(f"label_{mode}_{h}").alias("label"), C(f"target_date_{h}").alias("target_date")) for h in horizons]))
    return rows.select("ticker", "trade_date", *FEATURES, each.alias("e")).select("ticker", "trade_date", *FEATURES, "e.*").where("label is not null")


def dataset_for_horizon(rows: DataFrame, horizon: int, mode: str = "rel") -> DataFrame:
    return long_form(rows, [horizon], mode)


def time_folds(rows: DataFrame, k: int = FOLDS) -> DataFrame:
    """horizon, fold, train_end, test_end by the dates with a label of each horizon; none for
    fewer than 10 (k + 1) dates. Dates are few, so one array of a horizon's holds them."""
    days = rows.select("horizon", "trade_date").distinct().groupBy("horizon").agg(F.array_sort(F.collect_list("trade_date")).alias("d"))
    days = days.withColumn("n", F.size("d")).where(C("n") >= (k + 1) * 10)
    edge = lambda i: F.element_at("d", F.least(F.floor(C("n") * i / (k + 1)), C("n") - 1).cast("int") + 1)
    each = days.select("horizon", "d", "n", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("fold"))
    last = F.date_add(F.element_at("d", -1), 1)
    return each.select("horizon", "fold", edge(C("fold")).alias("train_end"), F.when(C("fold") == k, last).otherwise(edge(C("fold") + 1)).alias("test_end"))


def fold_rows(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows with the folds they take part in, and their role: train, purged or test."""
    both = rows.join(F.broadcast(folds), "horizon")
    role = F.when(C("trade_date") >= C("train_end"), "test").when(C("target_date") < C("train_end"), "train").otherwise("purged")
    return both.where("trade_date < test_end").withColumn("role", role)


def day_sizes(rows: DataFrame, horizons: list[int] = HORIZONS) -> DataFrame:
    """horizon, trade_date, target_date, n: how many rows of features() have a label, of either mode, as a written table. A row of a
    date has one if it has a return (the day then has a median), so neither labels nor medians are made."""
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), C(f"fwd_return_{h}").isNotNull().alias("known"), C(f"target_date_{h}").alias("target_date")) for h in horizons]))
    known = rows.where("trade_date is not null").select("trade_date", each.alias("e")).where("e.known")
    return staged(known.groupBy("e.horizon", "trade_date", "e.target_date").agg(F.count("*").alias("n")))


def purge_counts(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Sizes of folds. Rows are counted by their dates before they meet the folds, unless they come counted (see day_sizes)."""
    per = rows if "n" in rows.columns else rows.groupBy("horizon", "trade_date", "target_date").agg(F.count("*").alias("n"))
    count = lambda *r: F.coalesce(F.sum(F.when(C("role").isin(*r), C("n"))), F.lit(0))
    return fold_rows(per, folds).groupBy("horizon", "fold").agg(count("train", "purged").alias("before_purge"), count("train").alias("train_size"), count("test").alias("test_size"))


def scaler_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation of each feature; a deviation of 0 is 1."""
    aggs = [F.avg(f).alias(f"mean_{f}") for f in FEATURES] + [F.coalesce(F.nullif(F.stddev_pop(f), F.lit(0.0)), F.lit(1.0)).alias(f"std_{f}") for f in FEATURES]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *aggs)


def majority_baseline(parts: DataFrame) -> DataFrame:
    """The more frequent label of a fold's training rows (a tie: 0) and its share in test."""
    share = lambda r, v: F.count_if((C("role") == r) & (C("label") == v))
    per = parts.groupBy("horizon", "fold").agg(share("train", 1.0).alias("a"), share("train", 0.0).alias("b"), share("test", 1.0).alias("c"), share("test", 0.0).alias("d"))
    return per.select("horizon", "fold", F.when(C("a") > C("b"), 1.0).otherwise(0.0).alias("majority"), F.round(F.try_divide(F.when(C("a") > C("b"), C("c")).otherwise(C("d")), C("c") + C("d")), 8).alias("baseline_accuracy"))


def auc(rows: DataFrame, keys: list[str], score: str = "score", label: str = "label", parts: int | None = None) -> DataFrame:
    """Exact ROC AUC with ties by half and accuracy at score > 0.5; null for one class. Rows are summed by score
    and dealt by ranges of (keys, score), so that one fold is in many tasks; each adds up its own range, and the sums of
    ranges, a row for each task and key, are put together."""
    per = staged(rows.groupBy(*keys, score).agg(F.count_if(C(label) == 1).alias("p"), F.count_if(C(label) == 0).alias("q")))
    by = [*keys, score]
    ranged = per.repartitionByRange(parts, *by) if parts else per.repartitionByRange(*by)
    placed = staged(ranged.sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())).withColumn("task", F.shiftright("at", 33))
    inner = Window.partitionBy("task", *keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("below", F.coalesce(F.sum("q").over(inner), F.lit(0)))
    right = F.sum(F.when(C(score) > 0.5, C("p")).otherwise(C("q"))).alias("right")
    local = placed.groupBy("task", *keys).agg(F.sum("p").alias("P"), F.sum("q").alias("Q"), F.sum(C("p") * (C("below") + C("q") / 2)).alias("u"), right)
    return _auc_of(local, keys)


def _auc_of(local: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy and AUC from the sums of ranges of scores, which follow each other by task."""
    before = F.coalesce(F.sum("Q").over(Window.partitionBy(*keys).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = local.withColumn("u", C("u") + before * C("P"))
    out = local.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("P", "Q", "u", "right")])
    both = (C("P") > 0) & (C("Q") > 0)
    return out.select(*keys, F.when(both, C("right") / (C("P") + C("Q"))).alias("accuracy"), F.when(both, C("u") / (C("P") * C("Q"))).alias("auc"))


def fold_dates(rows: DataFrame, horizons: list[int] = HORIZONS, mode: str = "rel") -> dict[tuple[int, int], tuple]:
    """(horizon, fold) -> (train_end, test_end) of labelled() rows: five of each horizon."""
    has = [F.max(C(f"label_{mode}_{h}").isNotNull()).alias(f"h{h}") for h in horizons]
    per = rows.groupBy("trade_date").agg(*has)
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), C(f"h{h}").alias("has")) for h in horizons]))
    days = per.select("trade_date", each.alias("e")).where("e.has").select("e.horizon", "trade_date")
    return {(r.horizon, r.fold): (r.train_end, r.test_end) for r in time_folds(days).collect()}


PACKED = ["labels", "train", "before", "test"]
BLOCKS = "n int, x binary, labels binary, train binary, before binary, test binary"
#: Rows of a block, which take about 100 bytes each. Spark's reader takes up to 4,096 blocks of a row group at once, so row groups are short.
BLOCK_ROWS = 2048
SHORT_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "10"}


def packed(rows: DataFrame, horizons: list[int] = HORIZONS, mode: str = "rel", dates: dict | None = None) -> DataFrame:
    """Blocks of n rows, each a row of matrices as bytes: features (doubles), and over the horizons (a byte each) the
    labels (-1: none), as bits of fold numbers in which folds a row trains and which it comes before; and in which one it is
    tested (0: none). Bit 0 of train is for all labelled rows. So no row is repeated by horizon,
    fold or model, and the passes over them take matrices as they are."""
    dates = dates or {}
    day = F.unix_date if isinstance(rows.schema["trade_date"].dataType, DateType) else lambda c: F.unix_micros(c.cast("timestamp"))
    keys = [(h, k) for h in horizons for k in range(1, FOLDS + 1) if (h, k) in dates]
    ends = rows.sparkSession.range(1).select(*[day(F.lit(d)) for key in keys for d in dates[key]]).first() if keys else []
    edges = {key: (ends[2 * i], ends[2 * i + 1]) for i, key in enumerate(keys)}
    each = lambda name, of: [of(C(f"{name}_{h}")).cast("double").alias(f"{name}_{h}") for h in horizons]
    own = rows.select(*FEATURES, day(C("trade_date")).cast("double").alias("day"), *each(f"label_{mode}", lambda c: c), *each("target_date", day))
    return own.mapInArrow(partial(_bits, horizons=horizons, edges=edges), BLOCKS)


def _bits(batches, horizons, edges):
    """Blocks of rows. edges: (horizon, fold) -> where its train rows and its test rows end."""
    for batch in (whole.slice(i, BLOCK_ROWS) for whole in batches for i in range(0, whole.num_rows, BLOCK_ROWS)):
        n, width, first = batch.num_rows, len(horizons), len(FEATURES) + 1
        cols = [c.to_numpy(zero_copy_only=False).astype(float, copy=False) for c in batch.columns]
        x, day, labels, targets = np.column_stack(cols[: first - 1]), cols[first - 1], np.column_stack(cols[first : first + width]), np.column_stack(cols[first + width :])
        train, before, test = np.ones((n, width), np.int8), np.zeros((n, width), np.int8), np.zeros((n, width), np.int8)
        for i, h in enumerate(horizons):
            for k in range(1, FOLDS + 1):
                if (h, k) in edges:
                    a, b = edges[h, k]
                    train[:, i] |= (targets[:, i] < a).astype(np.int8) << k
                    before[:, i] |= (day < a).astype(np.int8) << k
                    test[:, i] += ((day >= a) & (day < b)).astype(np.int8) * np.int8(k)
        known = ~np.isnan(labels)
        bits = [np.where(known, labels, -1).astype(np.int8), *[v * known for v in (train, before, test)]]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (x, *bits)]], ["n", "x", *PACKED])


def _columns(batch: pa.RecordBatch):
    """Features, and labels and bits by horizon, of each block of a batch; rows outside blocks (features, and PACKED as
    arrays) are one."""
    if "x" in batch.schema.names:
        for r in range(batch.num_rows):
            x, labels, *bits = (np.frombuffer(batch[c][r].as_buffer(), kind).reshape(batch["n"][r].as_py(), -1) for c, kind in (("x", float), *[(c, np.int8) for c in PACKED]))
            yield x, np.where(labels < 0, np.nan, labels), *bits
    elif batch.num_rows:
        x = np.column_stack([batch[c].to_numpy(zero_copy_only=False).astype(float, copy=False) for c in FEATURES])
        yield x, *(batch[c].flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) for c in PACKED)


SUMS = "horizon int, fold int, variant int, v array<double>"


def _summed(batches, horizons, of):
    """Sums of the vectors that of(columns) gives by key, a row for each key and task."""
    total: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for block in _columns(batch):
            for key, v in of(horizons, *block):
                total[key] = total[key] + v if key in total else v
    keys = [pa.array([key[i] for key in total], pa.int32()) for i in range(3)]
    yield pa.RecordBatch.from_arrays([*keys, pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["horizon", "fold", "variant", "v"])


def sums_by_key(rows: DataFrame, horizons: list[int], of, width: int) -> dict[tuple, np.ndarray]:
    """(horizon, fold, variant) -> sum of the vectors of all rows; a few hundred keys."""
    part = rows.mapInArrow(partial(_summed, horizons=horizons, of=of), SUMS)
    sums = part.groupBy("horizon", "fold", "variant").agg(*[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(width)]).collect()
    return {tuple(r[:3]): np.array(r[3:], float) for r in sums}


def _counts(horizons, x, labels, train, before, test):
    """Rows before, train and test rows, of these the positive ones, sums and squares of the features of
    the train rows."""
    for i, h in enumerate(horizons):
        for k in range(FOLDS + 1):
            own, late, y = train[:, i] >> k & 1 > 0, (test[:, i] == k) & (k > 0), np.nan_to_num(labels[:, i])
            if own.any() or late.any():
                few = [(before[:, i] >> k & 1).sum(), own.sum(), y[own].sum(), late.sum(), y[late].sum()]
                yield (h, k, 0), np.concatenate((few, x[own].sum(axis=0), (x[own] ** 2).sum(axis=0)))


COUNTS = 5 + 2 * len(FEATURES)
#: Models of a fold: with all features, and without volume.
VARIANTS = (np.ones(len(FEATURES)), np.array([f != "logVolumeRatio" for f in FEATURES], float))


#: Places of the upper half of a Hessian.
UPPER = np.triu_indices(len(FEATURES) + 1)


def _steps(horizons, x, labels, train, before, test, state):
    """Gradient and upper half of the Hessian of the log-loss of each model, over features of one common scale: so all models of a
    horizon are one product of matrices."""
    center, scale, weights = state.value
    u = np.column_stack(((x - center) / scale, np.ones(len(x))))
    pairs = u[:, UPPER[0]] * u[:, UPPER[1]]
    for i, h in enumerate(horizons):
        keys = [key for key in weights if key[0] == h]
        if keys and train[:, i].any():
            takes = (train[:, i, None] >> np.array([k for _, k, _ in keys], np.int8)) & 1  # 0 without a label
            p = 1 / (1 + np.exp(-np.clip(u @ np.column_stack([weights[key] for key in keys]), -35, 35)))
            first, second = u.T @ ((p - np.nan_to_num(labels[:, i, None])) * takes), pairs.T @ (p * (1 - p) * takes)
            for j, key in enumerate(keys):
                yield key, np.concatenate((first[:, j], second[:, j]))


def fit_logistic(rows: DataFrame, horizons: list[int], counts: dict[tuple, np.ndarray], keys: list[tuple[int, int, int]], rounds: int = 25) -> dict:
    """Standardised L2 logistic models (C = 1, free intercept) of all keys (horizon, fold,
    variant) at once by Newton steps over packed rows: each step is one pass that sums gradients and
    Hessians by key, and small solves here. Returns key -> (weights with bias, means,
    deviations, used features)."""
    spark, size, models = rows.sparkSession, len(FEATURES) + 1, {}
    for h, k, v in keys:
        c = counts[h, k, 0]
        mean = c[5 : 5 + len(FEATURES)] / c[1]
        std = np.sqrt(np.maximum(0, c[5 + len(FEATURES) :] / c[1] - mean**2))
        models[h, k, v] = (np.zeros(size), mean, np.where(std > 1e-12, std, 1.0), VARIANTS[v])
    widest = max((c for (_, k, _), c in counts.items() if k == 0), key=lambda c: c[1], default=None)
    for _ in range(rounds if models else 0):
        center = widest[5 : 5 + size - 1] / widest[1]
        scale = np.sqrt(np.maximum(0, widest[5 + size - 1 :] / widest[1] - center**2))
        scale = np.where(scale > 1e-12, scale, 1.0)
        maps = {}  # from the common scale to a model's own
        for key, (_, mean, std, use) in models.items():
            maps[key] = np.diag(np.append(use * scale / std, 1.0))
            maps[key][:-1, -1] = use * (center - mean) / std
        state = spark.sparkContext.broadcast((center, scale, {key: maps[key].T @ models[key][0] for key in models}))
        sums = sums_by_key(rows, horizons, partial(_steps, state=state), size + len(UPPER[0]))
        state.unpersist()
        largest = 0.0
        for key, v in sums.items():
            beta, mean, std, use = models[key]
            penal = np.append(np.ones(size - 1), 0)
            half = np.zeros((size, size))
            half[UPPER] = v[size:]
            hess = maps[key] @ (half + np.triu(half, 1).T) @ maps[key].T + np.diag(penal) + np.diag(np.append(1 - use, 0))
            step = np.linalg.solve(hess, maps[key] @ v[:size] + penal * beta)
            models[key] = (beta - step, mean, std, use)
            largest = max(largest, float(np.abs(step).max()))
        if largest < 1e-8:
            break
    return models


def _tested(batch: pa.RecordBatch, horizons, models):
    """(key, labels, scores) of the test rows of each model's fold."""
    for x, labels, _, _, test in _columns(batch):
        for i, h in enumerate(horizons):
            for k in range(1, FOLDS + 1):
                own = np.flatnonzero(test[:, i] == k)
                for v in range(len(VARIANTS)):
                    if len(own) and (h, k, v) in models:
                        beta, mean, std, use = models[h, k, v]
                        yield (h, k, v), labels[own, i], 1 / (1 + np.exp(-((x[own] - mean) / std * use @ beta[:-1] + beta[-1])))


#: Test rows of a model that one task puts in order, about; scores that a task holds; rows by which ranges are cut.
MOST_RANKED, MOST_HELD, SAMPLE = 250_000, 1_000_000, 20_000
RANGED = "horizon int, fold int, variant int, part int, score array<double>, p array<int>, q array<int>"


def _by_score(score: np.ndarray, p: np.ndarray, q: np.ndarray):
    """Scores in order, each once, with sums of p and q."""
    order = np.argsort(score, kind="stable")
    score = score[order]
    at = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
    return score[at], np.add.reduceat(p[order], at), np.add.reduceat(q[order], at)


def _ranged(batches, horizons, models, marks):
    """Scores of test rows with their positive and negative rows, a row for each model and range of scores. What is held is
    counted block by block: a batch has many blocks, and a row of a block up to a score for each model of a fold."""

    def flush(held):
        out = []
        for key, found in held.items():
            label, score = (np.concatenate(v) for v in zip(*found, strict=True))
            sums = _by_score(score, (label == 1).astype(np.int32), (label == 0).astype(np.int32))
            edges = [0, *np.searchsorted(sums[0], marks.get(key, [])), len(sums[0])]
            out += [(*key, part, *[v[a:b] for v in sums]) for part, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
        kinds = [pa.int32()] * 4 + [pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = [c.split()[0] for c in RANGED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)

    held, many = {}, 0
    for batch in batches:
        for key, label, score in _tested(batch, horizons, models):
            held.setdefault(key, []).append((label, score))
            many += len(score)
            if many >= MOST_HELD:
                yield flush(held)
                held, many = {}, 0
    yield flush(held)


def _picked(batches, horizons, models, share):
    """A share of the scores of each model, a row for each model and batch: they tell where to cut."""
    rng = np.random.default_rng(1)
    for batch in batches:
        out = [(*key, score[rng.random(len(score)) < share]) for key, _, score in _tested(batch, horizons, models)]
        kinds = [pa.int32()] * 3 + [pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], ["horizon", "fold", "variant", "score"])


def _ranked(part: pa.Table) -> pa.Table:
    """Sums of one model's range of scores: rows of either label, pairs in order (ties by half), and rows with score > 0.5 told right."""
    score, p, q = (part[c].combine_chunks().flatten().to_numpy() for c in ("score", "p", "q"))
    score, p, q = _by_score(score, p.astype(np.int64), q.astype(np.int64))
    u = float((p * (np.cumsum(q) - q + q / 2)).sum())
    right = int(np.where(score > 0.5, p, q).sum())
    sums = pa.table([pa.array([v]) for v in (int(p.sum()), int(q.sum()), u, right)], ["P", "Q", "u", "right"])
    return pa.table([*[part[c].slice(0, 1) for c in ("horizon", "fold", "variant", "part")], *sums.columns], ["horizon", "fold", "variant", "task", *sums.column_names])


def model_auc(own: DataFrame, horizons: list[int], models: dict, sizes: dict[tuple[int, int], int], most: int = MOST_RANKED) -> DataFrame:
    """auc of each model over the test rows of its fold (sizes: how many). Tasks send scores as arrays by model and range of scores, so
    that equal ones meet and no task holds all of a large fold; a sample of rows tells only where to cut."""
    parts = {key: -(-sizes[key[:2]] // most) for key in models}
    marks: dict[tuple, np.ndarray] = {}
    if max(parts.values(), default=1) > 1:
        seen: dict[tuple, list] = {}
        share = min(1.0, SAMPLE / max(sizes.values()))
        for r in own.mapInArrow(partial(_picked, horizons=horizons, models=models, share=share), "horizon int, fold int, variant int, score array<double>").toArrow().to_batches():
            for h, k, v, score in zip(*(c.to_pylist() for c in r.columns[:3]), r.column(3), strict=True):
                seen.setdefault((h, k, v), []).append(score.values.to_numpy(zero_copy_only=False))
        marks = {key: np.unique(np.quantile(np.concatenate(v), np.arange(1, parts[key]) / parts[key])) for key, v in seen.items() if parts[key] > 1 and sum(map(len, v))}
    keys = ["horizon", "fold", "variant"]
    ranges = own.mapInArrow(partial(_ranged, horizons=horizons, models=models, marks=marks), RANGED)
    local = ranges.groupBy(*keys, "part").applyInArrow(lambda part: _ranked(part), "horizon int, fold int, variant int, task int, P long, Q long, u double, right long")
    return _auc_of(local, keys)


FOLD = "horizon int, fold int, baseline_accuracy double, before_purge long, train_size long, test_size long"


def walk_forward(rows: DataFrame, horizons: list[int], mode: str = "rel") -> DataFrame:
    """Per horizon and fold of labelled() rows: sizes, baseline, and accuracy and AUC of the
    model with all features (full) and without volume. Folds with few rows are skipped."""
    return evaluated(*prepared(rows, horizons, mode), horizons)


def prepared(rows: DataFrame, horizons: list[int], mode: str = "rel") -> tuple[DataFrame, dict]:
    """Blocks of rows as a written table, and their counts: what all models below read. Rows are read twice."""
    own = staged(packed(rows, horizons, mode, fold_dates(rows, horizons, mode)), **SHORT_GROUPS)
    return own, sums_by_key(own, horizons, _counts, COUNTS)


def evaluated(own: DataFrame, counts: dict, horizons: list[int], fixed: tuple | None = None) -> DataFrame:
    """Folds with the metrics of models fitted to each, or of one fixed model (weights with bias, means, deviations)."""
    folds = []
    for (h, k, _), c in sorted(counts.items()):
        if k and c[1] >= MIN_TRAIN and c[3] >= MIN_TEST:
            right = c[4] if c[2] > c[1] - c[2] else c[3] - c[4]  # of the more frequent label (a tie: 0)
            folds.append((h, k, round(float(right / c[3]), 8), int(c[0]), int(c[1]), int(c[3])))
    keys = [(h, k, v) for h, k, *_ in folds for v in range(len(VARIANTS))]
    models = {key: (*fixed, VARIANTS[key[2]]) for key in keys} if fixed else fit_logistic(own, horizons, counts, keys)
    found = model_auc(own, horizons, models, {(h, k): n for h, k, _, _, _, n in folds})
    pick = lambda v, c, n: F.max(F.when(C("variant") == v, C(c))).alias(n)
    wide = found.groupBy("horizon", "fold").agg(pick(0, "accuracy", "full_accuracy"), pick(0, "auc", "full_auc"), pick(1, "accuracy", "no_volume_accuracy"), pick(1, "auc", "no_volume_auc"))
    return wide.join(F.broadcast(own.sparkSession.createDataFrame(folds, FOLD)), ["horizon", "fold"])


METRICS = ["baseline_accuracy", "no_volume_accuracy", "no_volume_auc", "full_accuracy", "full_auc"]


def walk_forward_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation of the metrics over a horizon's folds, nulls left out."""
    aggs = [a for m in METRICS for a in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))]
    return folds.groupBy("horizon").agg(F.count("*").alias("n_folds"), *aggs)


def sweep_table(rows: DataFrame, horizons: list[int] = HORIZONS) -> DataFrame:
    """Mean metrics by horizon of labelled() rows; horizons with few rows are left out."""
    return _swept(*prepared(rows, horizons), horizons)[0]


def _swept(own: DataFrame, counts: dict, horizons: list[int], fixed: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    folds = staged(evaluated(own, counts, horizons, fixed))
    many = [(h, int(c[1])) for (h, k, _), c in sorted(counts.items()) if k == 0 and c[1] >= MIN_SAMPLES]
    samples = own.sparkSession.createDataFrame(many, "horizon int, samples long")
    found = walk_forward_summary(folds).join(F.broadcast(samples), "horizon")
    return found.select("horizon", "samples", C("baseline_accuracy_mean").alias("baseline_acc"), C("no_volume_auc_mean").alias("no_volume_auc"), C("full_auc_mean").alias("full_auc")), folds


def sweep_with_folds(rows: DataFrame, horizons: list[int] = HORIZONS, fixed: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """The sweep and the folds it is made of."""
    return _swept(*prepared(rows, horizons), horizons, fixed)


def best_horizon(sweep: DataFrame) -> DataFrame:
    """The horizon of the best AUC (null as 0, a tie: the lowest), and whether it has none."""
    best = F.max_by(F.struct("horizon", "full_auc"), F.struct(F.coalesce("full_auc", F.lit(0.0)), -C("horizon")))
    return sweep.agg(best.alias("b")).select("b.horizon", "b.full_auc", (F.coalesce("b.full_auc", F.lit(0.0)) < 0.52).alias("no_signal"))


def train_final_model(rows: DataFrame, horizon: int = DEPLOY, trained_at: str = "") -> DataFrame:
    """One row: the model of all rows of a horizon with its walk-forward means, as save_model
    takes it; none for few rows or without a valid fold."""
    own, counts = prepared(rows, [horizon])
    n, positive = counts[horizon, 0, 0][1:3] if counts else (0, 0)
    spark = rows.sparkSession
    means = walk_forward_summary(evaluated(own, counts, [horizon])).first() if n >= MIN_SAMPLES else None
    if means is None:
        return spark.createDataFrame([], MODEL)
    tested = [means[f"{m}_mean"] for m in ("full_accuracy", "full_auc", "baseline_accuracy", "no_volume_accuracy", "no_volume_auc")]
    key = (horizon, 0, 0)
    beta, mean, std, _ = fit_logistic(own, [horizon], counts, [key])[key]
    return spark.createDataFrame([(FEATURES, mean.tolist(), std.tolist(), beta[:-1].tolist(), float(beta[-1]), int(n), float(positive / n), horizon, "relative", trained_at, *tested, means.n_folds)], MODEL)
