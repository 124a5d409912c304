"""Golden cases of rules, merges, folds and backtests."""

import datetime as dt
import functools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.functions import scoring as S
from tapeworks.operators import views as V
from tapeworks.operators.indicators import with_ema, with_indicators
from tapeworks.plans import backtest as B
from tapeworks.plans import recommend as R
from tapeworks.plans import training as T
from tapeworks.sources import ingest as I
from tapeworks.sources.adapters import bars_of, ticks_of
from tapeworks.sources.shared import shared_folder
from tapeworks.streaming.refresh import incremental_refresh

BARS = "ticker string, trade_date date, open int, high int, low int, close int, volume long"


def series(spark, days, start, step, ticker="A"):
    day = dt.date(2024, 1, 1)
    rows = [(ticker, day + dt.timedelta(i), p, p + 50, p - 50, p, 100000) for i in range(days) for p in [start + step * i]]
    return spark.createDataFrame(rows, BARS)


@pytest.mark.parametrize(
    ("start", "step", "want"),
    [
        (10000, 100, (18700, 17950, 15950, 100, 698.68, 698.05, 0.62, 19103.26, 16796.74, 0.91, 1.0, "RISING", 63.30, 64.23)),
        (50000, -100, (41300, 42050, 44050, 0, -698.68, -698.05, -0.62, 43203.26, 40896.74, 0.09, 1.0, "FALLING", 39.45, 38.60)),
    ],
)
def test_linear_series(spark, start, step, want):
    r = R.technical_snapshot(series(spark, 90, start, step)).first()
    got = (r.ma5, r.ma20, r.ma60, r.rsi, r.macd, r.macd_signal, r.macd_histogram, r.bb_upper, r.bb_lower, r.bb_percent_b, r.volume_ratio, r.obv_trend, r.technical_score, r.rise_probability)
    for a, b in zip(got, want, strict=True):
        assert a == b if isinstance(b, str) else a == pytest.approx(b, abs=0.011)
    assert (S.PHRASES["ma"][0] in r.technical_reason) == (step > 0)
    assert 0 <= r.technical_score <= 100


def test_short_series_is_neutral(spark):
    r = R.technical_snapshot(series(spark, 10, 10000, 100)).first()
    assert (r.ma5, r.rsi, r.obv_trend, r.probability_horizon_days) == (None, None, None, None)
    assert (r.technical_score, r.rise_probability, r.probability_source, r.technical_reason) == (50.0, 50.0, "HEURISTIC", S.PHRASES["short"])


def test_model_probability(spark):
    means = [0.1] * 7
    r = spark.range(1).select(S.predict([F.lit(m) for m in means], means, [1.0] * 7, [3.0] * 7, -0.005117160823).alias("p")).first()
    assert round(r.p, 2) == 49.87
    snap = R.technical_snapshot(series(spark, 90, 10000, 100), {"means": means, "stds": [0.0] * 7, "weights": [0.0] * 7, "bias": 50.0, "forwardDays": 50}).first()
    assert (snap.rise_probability, snap.probability_source, snap.probability_horizon_days) == (99.0, "MODEL", 50)


def test_final_score_and_grade(spark):
    final = S.final_score(F.lit(80.0), F.lit(0.8))
    r = spark.range(1).select(final.alias("f"), S.grade(final).alias("g"), S.grade(F.lit(24.9)).alias("h"), S.round2(F.lit(1.005)).alias("u"), S.round2(F.lit(-0.125)).alias("v")).first()
    assert (r.f, r.g, r.h) == (83.5, "STRONG_BUY", "STRONG_SELL")
    assert r.v == -0.12


def test_last_row_of_series_is_the_snapshot(spark):
    bars = series(spark, 80, 20000, 37).union(series(spark, 70, 9000, -11, "B"))
    last = {r.ticker: r for r in with_indicators(bars).collect() if r.rn == (80 if r.ticker == "A" else 70)}
    for r in R.technical_snapshot(bars).collect():
        for c in ("ma5", "rsi", "macd", "bb_upper"):
            assert r[c] == math.floor(last[r.ticker][c] * 100 + 0.5) / 100


def test_ema_recursion(spark):
    rows = with_ema(series(spark, 30, 100, 7)).orderBy("trade_date").collect()
    e = 100.0
    for i, r in enumerate(rows):
        x = 100.0 + 7 * i
        e = e if i == 0 else (x - e) * (2.0 / 13) + e
        assert r.ema12 == e


def test_merge_is_idempotent_and_last_wins(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "ticker string, v int")
    u = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "ticker string, v int, seq int")
    once = I.merge(t, u, ["ticker"], [F.col("seq")])
    twice = I.merge(once, u, ["ticker"], [F.col("seq")])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", 1), ("b", 4), ("c", 5)]
    none = spark.createDataFrame([(None, 7, 1)], "ticker string, v int, seq int")
    again = I.merge(I.merge(t, none, ["ticker"], [F.col("seq")]), none, ["ticker"], [F.col("seq")])
    assert sorted(map(tuple, again.collect()), key=str) == [("a", 1), ("b", 2), (None, 7)]
    with pytest.raises(TypeError):
        I.merge(t, u, ["ticker"])


def test_ranked_numbers_all_rows(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = V.ranked(rows.repartition(5), F.col("v").desc()).collect()
    assert {r.v: r.pos for r in got} == {v: 1000 - v for v in range(1000)} and V.ranked(rows.where("false"), F.col("v")).count() == 0


def test_long_series_equals_the_recursion(spark):
    bars = series(spark, 200, 5000, 13).withColumn("close", F.expr("close + pmod(hash(trade_date), 500)"))
    f = s = g = e = None
    for r in with_ema(bars).orderBy("trade_date").collect():
        x = float(r.close)
        f, s, e = ((x, x, x) if f is None else ((x - f) * (2.0 / 13) + f, (x - s) * (2.0 / 27) + s, (x - e) * 0.2 + e))
        g = 0.0 if g is None else (f - s - g) * 0.2 + g
        assert (r.ema12, r.ema26, r.ema9, r.macd_signal, r.macd) == (f, s, e, g, f - s)
    assert with_ema(bars.where("false")).count() == 0


def test_refresh_goes_on_where_it_stopped(spark, tmp_path):
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date, l_extendedprice double, l_quantity double"
    day = dt.date(2024, 1, 1)
    rows = lambda t, lo, hi: spark.createDataFrame([(i, 1, 1, t, day + dt.timedelta(i), 100.0 + i * (t + 1), 1.0) for i in range(lo, hi)], schema)
    ticks, folder = f"file://{tmp_path}/ticks", f"file://{tmp_path}/state"
    tidy = lambda df: sorted(map(tuple, df.select("ticker", "technical_score", "rise_probability").collect()))
    whole = lambda *parts: tidy(R.technical_snapshot(bars_of(ticks_of(functools.reduce(lambda a, b: a.union(b), parts)))))
    rows(1, 0, 70).union(rows(2, 0, 80)).coalesce(1).write.parquet(ticks)
    first = tidy(incremental_refresh(spark, ticks, folder))
    assert first == whole(rows(1, 0, 70), rows(2, 0, 80))
    assert tidy(incremental_refresh(spark, ticks, folder)) == first  # nothing new
    rows(2, 80, 120).union(rows(3, 0, 90)).coalesce(1).write.mode("append").parquet(ticks)
    assert tidy(incremental_refresh(spark, ticks, folder)) == whole(rows(1, 0, 70), rows(2, 0, 120), rows(3, 0, 90))


def test_jdbc_in_ranges(spark, tmp_path):
    url, options = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(20).select(F.col("id").cast("int").alias("K"), (F.col("id") * 2).cast("int").alias("V")).write.jdbc(url, "T", properties=options)
    got = I.read_jdbc(spark, url, "T", "K", "0", "20", 4, **options)
    assert got.rdd.getNumPartitions() == 4 and sorted(map(tuple, got.collect())) == [(i, 2 * i) for i in range(20)]


def test_shared_folder_on_a_cluster_must_be_set():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared_folder(Session)


def test_listing_page(spark):
    page = """<table><tr><td class="title"><a href="/x">no</a></td><td class="date">2024.01.02</td></tr></table>
    <table class="type5"><tr><td class="title"><a href="/a?x=1&amp;y=2"> One &amp; <b>two</b> </a></td><td class="date">2024.01.02</td></tr>
    <tr><td class="title"><a href="http://b">B</a></td><td class="date">2024.01.02 09:30</td></tr>
    <tr><td class="title"><a href="/c"> </a></td><td class="date">2024.01.03</td></tr><tr><td class="title"><a href="/d">D</a></td></tr></table>"""
    rows = I.extract_news_listing(spark.createDataFrame([("T", page), ("U", None), ("V", "<p>none</p>")], "ticker string, html string"), "2024-02-01", "https://s").orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [("T", 1, "One & two", "https://s/a?x=1&y=2", dt.date(2024, 1, 2)), ("T", 2, "B", "http://b", dt.date(2024, 2, 1))]


def test_trade_summary(spark):
    rows = spark.createDataFrame([(2.0, True), (-1.0, False), (4.5, True)], "returns double, win boolean")
    r = B.summarize_trades(rows, "x").first()
    assert (r.trades, r.win_rate, r.avg_return, r.median_return, r.std_return, r.min_return, r.max_return) == ("3", 66.7, 1.83, 2.0, 2.75, -1.0, 4.5)
    none = B.summarize_trades(rows.where("false"), "x").first()
    assert none.trades == "0" and none.avg_return is None


def test_fold_edges(spark):
    def folds(n):
        days = spark.createDataFrame([(50, dt.date(2024, 1, 1) + dt.timedelta(i)) for i in range(n)], "horizon int, trade_date date")
        return T.time_folds(days).orderBy("fold").collect()

    got = folds(60)
    assert [(r.train_end - dt.date(2024, 1, 1)).days for r in got] == [10, 20, 30, 40, 50]
    assert [(r.test_end - dt.date(2024, 1, 1)).days for r in got] == [20, 30, 40, 50, 60]
    assert folds(59) == []


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(0)
    rows = [(1, float(round(s, 1)), float(y)) for s, y in zip(rng.random(200), rng.integers(0, 2, 200), strict=True)]
    r = T.auc(spark.createDataFrame(rows, "k int, score double, label double"), ["k"]).first()
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    assert r.auc == pytest.approx(np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]))
    one = T.auc(spark.createDataFrame([(1, 0.3, 1.0)], "k int, score double, label double"), ["k"]).first()
    assert one.auc is None and one.accuracy is None


def test_logistic_has_no_gradient_left(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 7))
    y = (x @ [1, -1, 0.5, 0, 0, 2, 0] + rng.normal(size=300) > 0).astype(float)
    rows = [(*map(float, r), [float(v)], [1], [0], [0]) for r, v in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in S.FEATURES) + ", labels array<double>, train array<int>, before array<int>, test array<int>")
    counts = T.sums_by_key(df, [1], T._counts, T.COUNTS)
    beta, mean, std, _ = T.fit_logistic(df, [1], counts, [(1, 0, 0)])[(1, 0, 0)]
    z = np.column_stack(((x - mean) / std, np.ones(300)))
    grad = z.T @ (1 / (1 + np.exp(-z @ beta)) - y) + np.append(beta[:-1], 0)
    assert np.abs(grad).max() < 1e-6


def test_model_file(spark, tmp_path):
    row = [(list(S.FEATURES), [0.0] * 7, [1.0] * 7, [0.1] * 7, 0.2, None, 0.5, None, "relative", "now", *[None] * 6)]
    I.save_model(spark.createDataFrame(row, I.MODEL), f"{tmp_path}/m")
    r = I.load_model(spark, f"{tmp_path}/m").first()
    assert (r.forwardDays, r.sampleCount, r.weights) == (5, 0, [0.1] * 7)
    assert I.load_model(spark, f"{tmp_path}/none") is None


def test_failing_ticker_does_not_stop_others(spark):
    stocks = spark.createDataFrame([("A",), ("B",)], "ticker string")
    bars = series(spark, 3, 100, 1).union(spark.createDataFrame([("B", None, 1, 1, 1, None, 1)], BARS))
    assert tuple(R.analysis_run_counts(stocks, bars).first()) == (2, 1)
