"""Monthly top-n backtests over daily bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators.indicators import held_until, indicated, with_indicators
from ..sources.shared import staged

HOLD, TOP, LEAST, TRIALS = 30, 5, 60, 50
#: Tickers that are sent to all tasks at most.
MOST_SENT = 200_000
C = F.col


def backtest_scores(bars: DataFrame) -> DataFrame:
    """Every bar with score_v1 and score_v2. Three rules differ from the live ones: the
    MACD is held against the 9-day average of the close, the bands take the sample deviation,
    and OBV starts at minus the first volume."""
    return scored(with_indicators(bars))


def scored(ind: DataFrame) -> DataFrame:
    """Any bars with indicators, with their scores."""
    moved = (C("obv") - C("obv5")) / (F.abs(C("obv") - C("first_volume")) + 1.0)
    trend = F.when(moved > 0.02, "RISING").when(moved < -0.02, "FALLING").otherwise("FLAT")
    std = F.sqrt(C("width2") / 380.0)
    low, high = C("ma20") - 2 * std, C("ma20") + 2 * std
    band = F.when(C("width2") == 0, 0.5).when(C("width2") > 0, F.try_divide(C("close") - low, high - low))
    ind = ind.withColumns({"band": band, "trend": trend})
    ma, rsi, macd, bb = S.score_ma(C("close"), C("ma5"), C("ma20"), C("ma60")), S.score_rsi(C("rsi")), S.score_macd(C("macd"), C("ema9")), S.score_bb(C("band"))
    volume = S.score_volume(C("change"), C("volume_ratio"), C("trend"))
    enough = C("rn") >= LEAST
    return ind.withColumns(
        {"score_v1": F.when(enough, S.weighted_v1(ma, rsi, macd, bb)).otherwise(50.0), "score_v2": F.when(enough, S.weighted(ma, rsi, macd, bb, volume)).otherwise(50.0)}
    )


def calendar(bars: DataFrame) -> DataFrame:
    return bars.select("trade_date").distinct()


def rebalance_dates(bars: DataFrame) -> DataFrame:
    """entry_date and exit_date (HOLD trading days later): dates of the calendar whose month
    number differs from that of the date before. The calendar has a row per day, so its
    window is small."""
    by = Window.orderBy("trade_date")
    days = calendar(bars).withColumns({"before": F.lag(F.month("trade_date")).over(by), "exit_date": F.lead("trade_date", HOLD).over(by)})
    return days.where("before is null or before <> month(trade_date)").select(C("trade_date").alias("entry_date"), "exit_date")


def _months(lo: Column, hi: Column) -> Column:
    return F.explode(F.sequence(F.trunc(lo, "month"), F.trunc(hi, "month"), F.expr("interval 1 month")))


def entry_asof(ind: DataFrame, dates: DataFrame) -> DataFrame:
    """For each entry date and ticker of LEAST bars by then, the last bar on or before it, of laid bars with indicators and one
    bar ahead. A bar holds until the next one, which lies in its chunk or right behind it, so that bars stay where they are; it
    meets the dates by month, without a theta join."""
    end = dates.agg(F.max("entry_date").alias("end"))
    held = ind.withColumn("next", held_until(ind)).where(C("own") & (C("rn") >= LEAST)).join(F.broadcast(end)).where("trade_date <= end")
    spans = held.withColumn("m", _months(C("trade_date"), F.greatest(C("trade_date"), F.coalesce("next", "end"))))
    found = spans.join(F.broadcast(dates.withColumn("m", F.trunc("entry_date", "month"))), "m")
    return found.where("entry_date >= trade_date and (next is null or entry_date < next)").drop("m", "next", "end")


def exit_asof(bars: DataFrame, exits: DataFrame) -> DataFrame:
    """(ticker, exit_date, exit_price): the first bar on or after each exit date."""
    by = Window.partitionBy("ticker").orderBy("trade_date")
    start = exits.agg(F.min("exit_date").alias("start"))
    held = bars.select("ticker", "trade_date", "close").withColumn("before", F.lag("trade_date").over(by)).join(F.broadcast(start)).where("trade_date >= start")
    spans = held.withColumn("m", _months(F.least(C("trade_date"), F.coalesce("before", "start")), C("trade_date")))
    found = spans.join(F.broadcast(exits.select("exit_date").distinct().withColumn("m", F.trunc("exit_date", "month"))), "m")
    return found.where("exit_date <= trade_date and (before is null or exit_date > before)").select("ticker", "exit_date", C("close").alias("exit_price"))


def named_bars(bars: DataFrame, stocks: DataFrame) -> DataFrame:
    """Bars of stocks as a written table: calendar, scores and prices are all made of its closes and volumes."""
    return staged(bars.select("ticker", "trade_date", "close", "volume").join(stocks.select("ticker"), "ticker"))


def candidates(bars: DataFrame, stocks: DataFrame) -> DataFrame:
    return of_named(named_bars(bars, stocks), stocks)


def made_once(bars: DataFrame, stocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates and the bars they are made of, both as written tables for picks and prices."""
    named = named_bars(bars, stocks)
    return staged(of_named(named, stocks)), named


def of_named(named: DataFrame, stocks: DataFrame) -> DataFrame:
    """Scored candidates of every entry date that has an exit date. Only bars that are entered are scored."""
    dates = rebalance_dates(named).where("exit_date is not null")
    names = stocks.select("ticker", "name")
    many = calendar(named).agg(F.count("*").alias("days"))
    held = scored(entry_asof(indicated(named, ahead=1), dates)).join(names, "ticker").join(F.broadcast(many)).where(C("days") >= HOLD + LEAST)
    return held.select("entry_date", "exit_date", "ticker", "name", C("close").alias("entry_price"), "score_v1", "score_v2")


def top_n(found: DataFrame, score: Column, n: int = TOP) -> DataFrame:
    best = Window.partitionBy("entry_date").orderBy(score.desc(), C("ticker"))
    return found.withColumn("score", score).withColumn("_r", F.row_number().over(best)).where(C("_r") <= n).drop("_r")


def priced(picked: DataFrame, bars: DataFrame) -> DataFrame:
    """Picks with their unrounded return; picks without a later bar are dropped. picked is read more than once; of bars only
    those of picked tickers travel, which are few: n a date and trial."""
    tickers = staged(picked.select("ticker").distinct())
    own = bars.join(F.broadcast(tickers) if tickers.count() <= MOST_SENT else tickers, "ticker", "left_semi")
    exits = exit_asof(own, picked.select("exit_date").distinct())
    return picked.join(exits, ["ticker", "exit_date"]).withColumn("ret", (C("exit_price") - C("entry_price")) / C("entry_price") * 100)


def trades(picked: DataFrame, bars: DataFrame) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return priced(picked, bars).select(day("entry_date"), day("exit_date"), "ticker", "name", F.bround("score", 1).alias("score"), F.bround("ret", 2).alias("returns"), (C("ret") > 0).alias("win"))


def run_backtest(bars: DataFrame, stocks: DataFrame, score: Column) -> DataFrame:
    """Trades of the best TOP by any column of the candidates. Bars and candidates are made once."""
    named = named_bars(bars, stocks)
    return trades(staged(top_n(of_named(named, stocks), score)), named)


#: Candidates of a trial and date that are ranked at first, for each one picked.
NEAR = 8


def random_picks(found: DataFrame, trials: int = TRIALS, n: int = TOP) -> DataFrame:
    """For every trial and entry date n candidates by a hash, so reruns agree. found is read more than once.

    The hashes of a date's candidates lie evenly, so only those are ranked that are below a bound which about NEAR * n of them are; a
    trial and date that has fewer than n below it is ranked as a whole."""
    sizes = staged(found.groupBy("entry_date").agg(F.count("*").alias("_many")))  # a row for each date
    share = C("_many").cast("double") / (NEAR * n)
    bound = F.when(share > 1, F.lpad(F.lower(F.hex(F.floor((1 << 32) / share))), 8, "0")).otherwise("g")  # after all digits
    key = F.md5(F.concat_ws(":", C("trial").cast("string"), F.date_format("entry_date", "yyyy-MM-dd"), C("ticker")))
    lot = Window.partitionBy("trial", "entry_date").orderBy("_key")
    best = lambda rows: rows.withColumn("_r", F.row_number().over(lot)).where(C("_r") <= n).select(*found.columns, "trial")
    each = sizes.withColumns({"trial": F.explode(F.sequence(F.lit(0), F.lit(trials - 1))), "_bound": bound})
    keyed = found.join(F.broadcast(each), "entry_date").withColumn("_key", key)
    near = staged(best(keyed.where(C("_key") < C("_bound"))))
    had = near.groupBy("trial", "entry_date").agg(F.count("*").alias("_had"))
    short = staged(each.join(had, ["trial", "entry_date"], "left").where(F.coalesce("_had", F.lit(0)) < F.least(F.lit(n), C("_many"))).select("entry_date", "trial"))
    if not short.limit(1).count():
        return near
    rest = best(found.join(F.broadcast(short), "entry_date").withColumn("_key", key))
    return near.join(F.broadcast(short), ["entry_date", "trial"], "left_anti").select(*found.columns, "trial").unionByName(rest)


def random_trials(picks: DataFrame, bars: DataFrame) -> DataFrame:
    return trial_means(priced(picks, bars).withColumn("returns", F.bround("ret", 2)))


def trial_means(rows: DataFrame) -> DataFrame:
    """Of priced picks (trial, ret, returns): rates and averages by trial."""
    return rows.groupBy("trial").agg(F.avg((C("ret") > 0).cast("int")).alias("w"), F.avg("returns").alias("a"), F.median("returns").alias("m")).select(
        "trial", F.bround(C("w") * 100, 6).alias("win_rate"), F.round("a", 6).alias("avg_return"), F.round("m", 6).alias("median_return")
    )


def summarize_trades(rows: DataFrame, label: str) -> DataFrame:
    n = F.count("*")
    two = lambda c: F.bround(F.round(c, 8), 2)
    return rows.agg(
        F.lit(label).alias("label"), n.cast("string").alias("trades"), F.bround(F.round(F.avg(C("win").cast("int")) * 100, 8), 1).alias("win_rate"), two(F.avg("returns")).alias("avg_return"),
        two(F.median("returns")).alias("median_return"), two(F.stddev_samp("returns")).alias("std_return"), F.min("returns").alias("min_return"), F.max("returns").alias("max_return"),
    )


def random_summary(per_trial: DataFrame) -> DataFrame:
    two = lambda c: F.bround(F.round(c, 8), 2)
    return per_trial.agg(
        F.lit("random").alias("label"), F.concat(F.count("*").cast("string"), F.lit(" trials")).alias("trades"), F.bround(F.round(F.avg("win_rate"), 8), 1).alias("win_rate"), two(F.avg("avg_return")).alias("avg_return"),
        two(F.avg("median_return")).alias("median_return"), two(F.stddev_samp("avg_return")).alias("std_return"), two(F.min("avg_return")).alias("min_return"), two(F.max("avg_return")).alias("max_return"),
    )


def comparison(bars: DataFrame, stocks: DataFrame) -> DataFrame:
    """Summaries of both scores and of random picks. Candidates are made once and all picks
    are priced in one join."""
    found, bars = made_once(bars, stocks)
    own = ["entry_date", "exit_date", "ticker", "entry_price", "trial"]
    picks = [top_n(found, C(k)).withColumn("trial", F.lit(t)).select(*own) for t, k in ((-1, "score_v1"), (-2, "score_v2"))]
    picked = staged(picks[0].unionByName(picks[1]).unionByName(random_picks(found).select(*own)))
    every = staged(priced(picked, bars).withColumn("returns", F.bround("ret", 2)).withColumn("win", C("ret") > 0))
    v1, v2 = (summarize_trades(every.where(C("trial") == t), label) for t, label in ((-1, "v1"), (-2, "v2")))
    return v1.unionByName(v2).unionByName(random_summary(trial_means(every.where("trial >= 0"))))
