"""Steps of training and backtests whose cost must grow no faster than their rows."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from tapeworks.plans import training as T


def returns(spark, days, tickers):
    rng = random.Random(3)
    rows = [(dt.date(2023, 1, 1) + dt.timedelta(d), *[rng.choice([None, round(rng.gauss(0, 1), 2)]) if d != 2 else None for _ in (3, 50)]) for d in range(days) for _ in range(tickers + d)]
    return spark.createDataFrame(rows, "trade_date date, fwd_return_3 double, fwd_return_50 double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_medians_take_a_row_once_for_all_horizons(spark):
    rows = returns(spark, 5, 7)
    found = T.day_medians(rows, [3, 50])
    assert "Generate" not in plan(found)
    want = {}
    for r in rows.collect():
        for h in (3, 50):
            if r[f"fwd_return_{h}"] is not None:
                want.setdefault((r.trade_date, h), []).append(r[f"fwd_return_{h}"])
    want = {k: float(np.median(v)) for k, v in want.items()}
    for most in (100_000, 9, 2):  # all days at once, some narrowed down, all
        got = {(r.trade_date, r.horizon): r.median for r in T.day_medians(rows, [3, 50], most).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_scores_meet_as_arrays_by_range(spark):
    """The AUC of a model by ranges of scores, with ties, is that of all rows at once."""
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, size=(3000, 7)).astype(float)
    rows = [(*map(float, r), [float(y)], [1], [0], [1 + i % 2]) for i, (r, y) in enumerate(zip(x, rng.random(3000) < 0.5, strict=True))]
    own = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in T.FEATURES) + ", labels array<double>, train array<tinyint>, before array<tinyint>, test array<tinyint>").repartition(3)
    models = {(5, k, v): (np.append(np.round(rng.normal(size=7), 1), 0.1 * k), np.zeros(7), np.ones(7), T.VARIANTS[v]) for k in (1, 2) for v in (0, 1)}
    got = {tuple(r)[:3]: (r.accuracy, r.auc) for r in T.model_auc(own, [5], models, {(5, 1): 1500, (5, 2): 1500}, most=200).collect()}
    assert got.keys() == models.keys()
    for (_, k, v), (beta, _, _, use) in models.items():
        score, y = (1 / (1 + np.exp(-((x - np.zeros(7)) / np.ones(7) * use @ beta[:-1] + beta[-1]))))[k - 1 :: 2], np.array([r[7][0] for r in rows])[k - 1 :: 2]
        pos, neg = score[y == 1], score[y == 0]
        brute = np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None]))
        assert abs(got[5, k, v][1] - brute) < 1e-9 and abs(got[5, k, v][0] - np.mean((score > 0.5) == (y == 1))) < 1e-9


def test_passes_over_rows_take_blocks(spark):
    """Packed rows are few blocks, whose sums are those of the rows, also without a label or a target date."""
    rng = random.Random(6)
    day = lambda i: dt.date(2023, 1, 1) + dt.timedelta(i)
    rows = [(day(i % 70), *[rng.gauss(0, 1) for _ in T.FEATURES], rng.choice([None, 0.0, 1.0]), day(i % 70 + 5) if i % 3 else None) for i in range(700)]
    df = spark.createDataFrame(rows, "trade_date date, " + ", ".join(f"{f} double" for f in T.FEATURES) + ", label_rel_5 double, target_date_5 date").coalesce(1)
    own = T.packed(df, [5], dates={(5, 1): (day(20), day(40))})
    assert own.count() == 1
    got = T.sums_by_key(own, [5], T._counts, T.COUNTS)[5, 1, 0]
    known = [r for r in rows if r[-2] is not None]
    train, test = [r for r in known if r[-1] and r[-1] < day(20)], [r for r in known if day(20) <= r[0] < day(40)]
    assert got[:5].tolist() == [sum(r[0] < day(20) for r in known), len(train), sum(r[-2] for r in train), len(test), sum(r[-2] for r in test)]
    assert np.allclose(got[5:12], np.sum([r[1:8] for r in train], axis=0))


def test_a_ticker_is_composed_once(spark):
    """The scan over a ticker's chunks stands once in the plan, not in a filter, too."""
    from tapeworks.operators import indicators as N

    bars = spark.createDataFrame([("A", dt.date(2023, 1, 1) + dt.timedelta(i), 100 + i, 5) for i in range(9)], "ticker string, trade_date date, close int, volume long")
    found = N.with_ema(bars, span=2)
    assert "size(aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 9


def test_folds_are_sized_without_labels(spark, monkeypatch):
    """Counts by date are those of labelled rows, with returns or dates that are not known, and make no medians."""
    rows = returns(spark, 90, 3).withColumn("ticker", F.lit("A")).withColumns({f: F.lit(0.0) for f in T.FEATURES})
    for h in (3, 50):
        rows = rows.withColumn(f"target_date_{h}", F.when(F.col("fwd_return_50").isNotNull(), F.date_add("trade_date", h)))
    rows = rows.unionByName(rows.limit(2).withColumn("trade_date", F.lit(None).cast("date")))
    long = T.long_form(T.labelled(rows, [3, 50]), [3, 50])
    want = sorted(map(tuple, T.purge_counts(long, T.time_folds(long)).collect()))
    monkeypatch.setattr(T, "day_medians", None)
    per = T.day_sizes(rows, [3, 50])
    assert len(want) == 10 and sorted(map(tuple, T.purge_counts(per, T.time_folds(per)).collect())) == want


def test_purge_counts_makes_no_medians(spark, sf, monkeypatch):
    from tapeworks import registry

    monkeypatch.setattr(T, "day_medians", None)
    assert registry.queries()["purge_counts"](spark, sf).columns == ["horizon", "fold", "before_purge", "train_size", "test_size"]


def test_scores_are_held_block_by_block(spark, tmp_path, monkeypatch):
    """One batch of many blocks is not scored as a whole before its scores leave the task, and blocks and row groups are short."""
    import glob

    import pyarrow as pa
    import pyarrow.parquet as pq

    rng, n = np.random.default_rng(7), 30_000
    cols = {f: rng.normal(size=n) for f in T.FEATURES} | {"day": np.arange(n) % 60.0, "label_rel_5": rng.integers(0, 2, n).astype(float), "target_date_5": np.arange(n) % 60 + 5.0}
    blocks = pa.Table.from_batches(T._bits([pa.RecordBatch.from_pydict(cols)], [5], {(5, 1): (20.0, 60.0)})).combine_chunks().to_batches()
    assert len(blocks) == 1 and max(blocks[0]["n"].to_pylist()) <= 4096 and sum(blocks[0]["n"].to_pylist()) == n
    models = {(5, 1, v): (rng.normal(size=8), np.zeros(7), np.ones(7), T.VARIANTS[v]) for v in (0, 1)}
    monkeypatch.setattr(T, "MOST_HELD", 1000)
    most = [sum(map(len, b["score"].to_pylist())) for b in T._ranged(iter(blocks), [5], models, {})]
    assert sum(most) == 2 * (n - n // 3) and max(most) <= 1000 + 4096
    T.staged(spark.createDataFrame(blocks[0].to_pandas().loc[lambda d: d.index.repeat(8)], T.BLOCKS).coalesce(1), **T.SHORT_GROUPS).write.options(**T.SHORT_GROUPS).parquet(str(tmp_path / "b"))
    for f in glob.glob(str(tmp_path / "b" / "*.parquet")):
        own = pq.read_metadata(f)
        assert max(own.row_group(i).total_byte_size for i in range(own.num_row_groups)) < 12 << 20


def test_shuffles_of_a_written_table_leave_the_disk(spark):
    import glob
    import time

    local = spark.sparkContext.getConf().get("spark.local.dir")
    files = lambda: set(glob.glob(f"{local}/**/shuffle_*.data", recursive=True))
    before = files()
    found = T.staged(spark.range(100_000).repartition(3, "id"))
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert found.count() == 100_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_rows_are_written_with_closes(spark, monkeypatch):
    """Medians and labels from closes (null, 0 or none to come) are those from returns, and no return is written."""
    rng = random.Random(8)
    day = lambda i: dt.date(2023, 1, 1) + dt.timedelta(i)
    rows = [(f"T{t}", day(d), *[0.5 for _ in T.FEATURES], rng.choice([None, 0, 7, 9, 11]), *[v for h in (3, 50) for v in (rng.choice([None, 0, 7, 8, 13]), day(d + h))]) for d in range(6) for t in range(9 + d)]
    rows += [("T", day(7), *[0.5 for _ in T.FEATURES], 0, 7, day(8), 7, day(9))]
    df = spark.createDataFrame(rows, "ticker string, trade_date date, " + ", ".join(f"{f} double" for f in T.FEATURES) + ", close int, close_3 int, target_date_3 date, close_50 int, target_date_50 date")
    plain = T.returned(df, [3, 50])
    assert plain.columns == ["ticker", "trade_date", *T.FEATURES, "fwd_return_3", "target_date_3", "fwd_return_50", "target_date_50"]
    written, keep = [], T.staged
    monkeypatch.setattr(T, "staged", lambda df, **options: written.append(df.columns) or keep(df, **options))
    for most in (100_000, 11, 2):
        want, got = (sorted(map(tuple, T.day_medians(x, [3, 50], most).collect())) for x in (plain, df))
        assert len(want) == 12 and got == want
        written.clear()
        order = lambda x: sorted(map(str, T.labelled(x, [3, 50], most).collect()))
        assert order(df) == order(plain)
    written.clear()
    T.labelled(df, [3, 50])
    assert not any(c.startswith("fwd_return") for c in written[0])
