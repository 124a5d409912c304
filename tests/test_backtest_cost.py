"""Backtests: picks by a bound of their hashes, and files that are gathered last."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from tapeworks.plans import backtest as B
from tapeworks.sources import ingest as I


def test_random_picks_below_a_bound_are_those_of_all(spark, monkeypatch):
    rows = [(dt.date(2023, m, 1), f"{i:06d}") for m in (1, 2, 3) for i in range(3 if m == 3 else 40 * m)]
    found = spark.createDataFrame(rows, "entry_date date, ticker string")
    lot = lambda trial, r: hashlib.md5(f"{trial}:{r[0]}:{r[1]}".encode()).hexdigest()
    want = {(t, *r) for t in range(6) for m in (1, 2, 3) for r in sorted([r for r in rows if r[0].month == m], key=lambda r: lot(t, r))[:5]}
    for near in (8, 1, 0.1):  # all found below the bound, some, hardly any
        monkeypatch.setattr(B, "NEAR", near)
        got = [(r.trial, r.entry_date, r.ticker) for r in B.random_picks(found, 6).collect()]
        assert len(got) == len(want) and set(got) == want


def test_files_are_gathered_after_they_are_made(spark, tmp_path):
    rows = spark.range(0, 40, 1, 4).select("id", F.spark_partition_id().alias("task"))
    for write, name in ((I.write_trades_csv, "a"), (I.write_comparison, "b")):
        write(rows, str(tmp_path / name))
        got = spark.read.csv(str(tmp_path / name), header=True)
        assert got.count() == 40 and got.select("task").distinct().count() == 4 and len(list((tmp_path / name).glob("part-*"))) == 1


def test_candidates_stay_where_bars_are(spark):
    """Bars wait for entry dates in their chunk: no window by ticker; before and behind the edge of a chunk they hold alike."""
    import re

    days = [dt.date(1992, 1, 2) + dt.timedelta(i) for i in range(260) if i % 7 < 5]  # a chunk ends on 1992-06-05
    rows = [(t, d, 1, 2, 1, 100 + (i * 7 + k) % 13, 10 + i % 3) for k, t in enumerate(("A", "B")) for i, d in enumerate(days) if t == "A" or i % 4 != 3 and not dt.date(1992, 6, 1) <= d <= dt.date(1992, 6, 7)]
    bars = spark.createDataFrame(rows, "ticker string, trade_date date, open int, high int, low int, close int, volume long")
    stocks = spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "c")], "ticker string, name string")
    found = B.candidates(bars, stocks)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"windowspecdefinition\(ticker#\d+, trade_date", plan)
    scores = {(r.ticker, r.trade_date): (r.close, r.score_v1, r.score_v2) for r in B.backtest_scores(bars).collect()}
    dates = [r for r in B.rebalance_dates(bars).collect() if r.exit_date]
    want = {}
    for r in dates:
        for t in ("A", "B"):
            own = sorted(d for u, d in scores if u == t and d <= r.entry_date)
            if len(own) >= B.LEAST:
                want[t, r.entry_date] = scores[t, own[-1]]
    got = {(r.ticker, r.entry_date): (r.entry_price, r.score_v1, r.score_v2) for r in found.collect()}
    assert got == want and len({d for _, d in got}) > 2 and ("B", dt.date(1992, 6, 1)) in got
