"""Chunked series, the store and the incremental refresh."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import indicators as N
from tapeworks.plans import recommend as R
from tapeworks.plans import training as T
from tapeworks.sources import ingest as I
from tapeworks.sources.adapters import bars_of, ticks_of
from tapeworks.sources.store import Store, month_of
from tapeworks.streaming import refresh
from tapeworks.streaming.refresh import KINDS, apply_ticks, incremental_refresh

BARS = "ticker string, trade_date date, close int, volume long"


def walk(spark, days, tickers=("A",), seed=1, gap=3):
    rng, rows = random.Random(seed), []
    for t in tickers:
        day, price = dt.date(2020, 1, 1), 5000
        for _ in range(days):
            day += dt.timedelta(rng.randint(1, gap))
            price = max(50, price + rng.randint(-90, 90))
            rows.append((t, day, price, rng.randint(0, 9) * 1000))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, BARS)


def by_key(rows):
    return {(r.ticker, r.trade_date): r.asDict() for r in rows.collect()}


@pytest.mark.parametrize("span", [7, 40, 333])
def test_chunks_give_what_whole_series_give(spark, span):
    bars = walk(spark, 400, ("A", "B")).union(spark.createDataFrame([("C", dt.date(2020, 5, 5), 10, None)], BARS))
    whole, cut = by_key(N.with_indicators(bars)), by_key(N.with_indicators(bars, span))
    assert whole.keys() == cut.keys() and len(whole) == 801
    for k, r in whole.items():
        for c, v in r.items():
            if isinstance(v, float) and c in ("ema12", "ema26", "ema9", "macd", "macd_signal", "macd_histogram"):
                assert cut[k][c] == pytest.approx(v, abs=1e-9)
            else:
                assert cut[k][c] == v, (k, c)


def test_a_series_that_does_not_move_stays_exact(spark):
    bars = walk(spark, 300).withColumn("close", F.lit(777))
    assert all(r.macd == r.macd_signal == 0 and r.ema26 == 777 for r in N.with_ema(bars, 20).collect())


def test_looking_ahead_across_chunks(spark):
    bars = walk(spark, 90)
    rows = N.indicated(bars, ahead=30, span=9)
    rows = rows.withColumn("next", F.lead("close", 30).over(N.by())).where("own").orderBy("trade_date").collect()
    closes = [r.close for r in rows]
    assert [r.next for r in rows] == closes[30:] + [None] * 30


def test_long_series_of_one_ticker(spark):
    """60,000 bars a minute apart in chunks of half a day: each row of the shuffle is a chunk."""
    n = 60_000
    close = F.pmod(F.hash("id"), F.lit(900)) + 100
    bars = spark.range(n).select(F.lit("A").alias("ticker"), F.timestamp_seconds(F.col("id") * 60).alias("trade_date"), close.alias("close"), F.lit(5).cast("long").alias("volume"))
    got = N.with_ema(bars, span=0.5).select("rn", "close", "ema12", "ema26", "macd_signal").orderBy("rn").toPandas()
    f = s = float(got.close[0])
    g, want = 0.0, np.empty((n, 3))
    for i, x in enumerate(got.close.astype(float)):
        f, s = (x - f) * (2 / 13) + f, (x - s) * (2 / 27) + s
        g = (f - s - g) * 0.2 + g
        want[i] = f, s, g
    assert (got.rn == np.arange(1, n + 1)).all()
    assert np.abs(got[["ema12", "ema26", "macd_signal"]].to_numpy() - want).max() < 1e-9


def test_no_window_or_list_of_a_whole_ticker(spark):
    plan = N.with_indicators(walk(spark, 10))._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(ticker" in plan.replace("#", " ").replace("ticker ", "ticker") or "Window" in plan
    import re

    for spec in re.findall(r"windowspecdefinition\(([^)]*)\)", plan):
        assert re.match(r"ticker#\d+, chunk#\d+", spec), spec


def test_snapshots_as_of_dates(spark):
    bars = walk(spark, 150, ("A", "B", "C"))
    dates = ["2020-01-01", "2020-03-31", "2020-06-30", "2020-06-30", "2020-09-30", "2030-01-01"]
    got = {(r.as_of, r.ticker): r.asDict() for r in R.snapshots(bars, dates).collect()}
    want = {}
    for d in set(dates):
        for r in R.technical_snapshot(bars.where(F.col("trade_date") <= F.lit(d).cast("date"))).collect():
            want[dt.date.fromisoformat(d), r.ticker] = {"as_of": dt.date.fromisoformat(d)} | r.asDict()
    assert got == want


# ---- medians and ranks across tasks


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_exact_medians(spark, most):
    rng = np.random.default_rng(4)
    rows = [(dt.date(2024, 1, 1 + i % 5), float(v), None if i % 9 == 0 else float(round(w, 1))) for i, (v, w) in enumerate(zip(np.exp(rng.normal(0, 4, 801)), rng.normal(size=801), strict=True))]
    rows += [(dt.date(2024, 2, 1), 2.0, None), (dt.date(2024, 2, 2), None, None)] + [(dt.date(2024, 2, 3), 7.5, float(i > 20)) for i in range(40)]
    df = spark.createDataFrame(rows, "trade_date date, fwd_return_1 double, fwd_return_2 double")
    got = {(r.trade_date, r.horizon): r.median for r in T.day_medians(df, [1, 2], most).collect()}
    want = {}
    for h in (1, 2):
        for d in {r[0] for r in rows}:
            v = [r[h] for r in rows if r[0] == d and r[h] is not None]
            if v:
                want[d, h] = float(np.median(v))
    assert got == want


def test_auc_in_few_and_in_many_ranges(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i % 3), float(round(s, 2)), float(y)) for i, (s, y) in enumerate(zip(rng.random(2000), rng.integers(0, 2, 2000), strict=True))]
    df = spark.createDataFrame(rows, "k int, score double, label double")
    few, many = ({r.k: (r.accuracy, r.auc) for r in T.auc(df, ["k"], parts=p).collect()} for p in (2, 60))
    assert few == many
    for k, (_, auc) in few.items():
        pos, neg = (np.array([s for q, s, y in rows if q == k and y == v]) for v in (1, 0))
        assert auc == pytest.approx(((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean(), abs=1e-12)


# ---- store


def files_of(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_upsert_touches_its_months_only(spark, tmp_path):
    kinds = {"bars": (BARS, "month")}
    store = Store(spark, f"file://{tmp_path}", kinds)
    bars = walk(spark, 200).withColumn("month", month_of())
    store.upsert("bars", bars, I.BAR_KEY, [F.col("close")])
    before = files_of(tmp_path)
    day = bars.orderBy("trade_date").first().trade_date
    news = spark.createDataFrame([("A", day, 1, 1), ("A", day, 2, 1), ("Z", day, 3, None)], BARS).withColumn("month", month_of())
    store.upsert("bars", news, I.BAR_KEY, [F.col("close")])
    after = files_of(tmp_path)
    assert before.items() <= after.items()  # nothing is rewritten in place
    assert {f.split("month=")[1].split("/")[0] for f in after.keys() - before.keys() if "month=" in f} == {day.strftime("%Y-%m")}
    rows = {(r.ticker, r.trade_date): r.close for r in store.read("bars").collect()}
    assert len(rows) == 201 and rows["A", day] == 2 and rows["Z", day] == 3
    month = day.strftime("%Y-%m")
    store.write("bars", store.next_batch(), bars.where(F.col("month") == month).withColumn("close", F.lit(-1)), [month])  # a crash before the mark
    assert {(r.ticker, r.trade_date): r.close for r in store.read("bars").collect()} == rows
    assert store.drop_old() == 1 and {(r.ticker, r.trade_date): r.close for r in store.read("bars").collect()} == rows
    store.upsert("bars", news.where("false"), I.BAR_KEY, [F.col("close")])
    assert Store(spark, f"file://{tmp_path}/none", kinds).read("bars").count() == 0


def test_insert_new_takes_nulls_as_equal(spark):
    schema = "ticker string, headline string, seq int"
    stored = spark.createDataFrame([("A", None, 1), ("A", "x", 2), (None, "x", 3)], schema)
    batch = spark.createDataFrame([("A", None, 9), ("A", "x", 8), (None, "x", 7), ("A", "y", 6), ("A", "y", 5), ("B", None, 4), ("B", None, 3), (None, None, 2)], schema)
    once = I.insert_new(stored, batch, ["ticker", "headline"], ["seq"])
    assert sorted(map(tuple, once.collect()), key=str) == sorted([("A", "y", 5), ("B", None, 3), (None, None, 2)], key=str)
    assert I.insert_new(stored.unionByName(once), batch, ["ticker", "headline"], ["seq"]).collect() == []


def test_balanced_ranges(spark, tmp_path):
    url, options = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    skewed = spark.range(2000).select(F.date_add(F.lit("2020-01-01").cast("date"), F.floor(F.sqrt("id")).cast("int")).alias("D"), F.col("id").alias("V"))
    skewed.union(spark.range(3).select(F.lit(None).cast("date"), "id")).coalesce(1).write.jdbc(url, "T", properties=options)
    got = I.read_balanced(spark, url, "T", "D", 6, **options)
    sizes = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == 6 and max(sizes) <= 2 * sorted(sizes)[3] and got.count() == 2003
    assert I.balanced_ranges(spark, url, "(SELECT * FROM T WHERE D IS NULL) E", "D", 4, **options) == ["1 = 1"]


# ---- refresh


def tidy(rows):
    return sorted(map(tuple, rows.select("ticker", "technical_score", "rise_probability").collect()))


@pytest.fixture(scope="module")
def snapshot(spark, sf):
    return tidy(R.technical_snapshot(bars_of(ticks_of(spark.read.parquet(f"{sf}/lineitem.parquet")))))


@pytest.mark.parametrize("deal", ["hash", "reversed"])
def test_files_may_split_days(spark, sf, tmp_path, snapshot, deal):
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    if deal == "hash":
        line.repartition(12, "l_orderkey", "l_linenumber").write.parquet(f"{tmp_path}/ticks")
    else:  # late days first, and days across the bounds
        line.withColumn("n", F.pmod(F.hash("l_partkey"), F.lit(2))).repartitionByRange(6, F.col("l_shipdate").desc(), "n").drop("n").write.parquet(f"{tmp_path}/ticks")
    got = incremental_refresh(spark, f"file://{tmp_path}/ticks", f"file://{tmp_path}/state", files=6 if deal == "hash" else 2)
    assert tidy(got) == snapshot


def test_a_new_day_reads_months_and_late_ticks_restart(spark, sf, tmp_path, snapshot, monkeypatch):
    ticks = ticks_of(spark.read.parquet(f"{sf}/lineitem.parquet"))
    store, read = Store(spark, f"file://{tmp_path}", KINDS), []
    last, late = F.lit("2001-06-01").cast("date"), (F.col("trade_date") == F.lit("1999-03-03").cast("date")) & (F.col("qty") > 10)
    apply_ticks(store, ticks.where((F.col("trade_date") < last) & ~late), 0)
    whole = Store.read

    def noted(self, kind, parts=None, below=None):
        read.append((kind, parts))
        return whole(self, kind, parts, below)

    monkeypatch.setattr(refresh.Store, "read", noted)
    apply_ticks(store, ticks.where(F.col("trade_date") >= last), 1)
    months = sorted({m for kind, parts in read if kind == "bars" for m in parts})
    assert len(months) < 20 and months[0] >= "2000-06"  # of 83 months; windows reach back 61 bars of the sparsest ticker
    apply_ticks(store, ticks.where(late), 2)
    assert tidy(store.read("scores")) == snapshot
    apply_ticks(store, ticks.where(late), 2)  # a batch that is tried again replaces itself
    assert tidy(store.read("scores")) == snapshot
