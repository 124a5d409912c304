"""From bars and news to graded recommendations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators.indicators import held_until, indicated, with_indicators
from ..sources.ingest import NEWS_KEY, insert_new, parse_sentiment

LEAST_BARS = 60
C = F.col


RULES = ("ma", "rsi", "macd", "bb", "volume")


def rule(name: str) -> Column:
    """The score of one rule; only that of macd needs the exponential averages."""
    return {
        "ma": lambda: S.score_ma(C("close"), C("ma5"), C("ma20"), C("ma60")),
        "rsi": lambda: S.score_rsi(C("rsi")),
        "macd": lambda: S.score_macd(C("macd"), C("macd_signal")),
        "bb": lambda: S.score_bb(C("bb_percent_b")),
        "volume": lambda: S.score_volume(C("change"), C("volume_ratio"), C("obv_trend")),
    }[name]()


def with_scores(ind: DataFrame) -> DataFrame:
    """Indicator rows with the five rule scores and the unrounded technical score."""
    out = ind.withColumns({f"{r}_score": rule(r) for r in RULES})
    five = [C(f"{r}_score") for r in RULES]
    return out.withColumns({"raw_score": S.clamp(S.weighted(*five)), "heuristic": S.heuristic_probability(*five)})


def technical_snapshot(bars: DataFrame, model: dict | None = None) -> DataFrame:
    """One row per ticker at its last bar: rounded indicators, score, probability, reason. A
    ticker of fewer than 60 bars is neutral. model: means, stds, weights, bias, forwardDays."""
    return snapshot_rows(with_scores(with_indicators(bars).where("rn = many")), model)


def snapshot_rows(ind: DataFrame, model: dict | None = None, *keep: str) -> DataFrame:
    """Scored indicator rows as a snapshot shows them."""
    enough = C("rn") >= LEAST_BARS
    rounded = lambda c: F.when(enough, S.round2(C(c))).alias(c)
    probability, source, horizon = C("heuristic"), F.lit("HEURISTIC"), F.lit(None).cast("int")
    if model:
        features = S.feature_columns(C("close"), C("ma5"), C("ma20"), C("ma60"), C("rsi"), C("macd_histogram"), C("bb_percent_b"), C("volume_ratio"))
        probability = S.predict(list(features.values()), model["means"], model["stds"], model["weights"], model["bias"])
        source, horizon = F.lit("MODEL"), F.lit(int(model["forwardDays"]))
    reason = S.technical_reason(C("ma5"), C("ma20"), C("ma60"), C("rsi"), C("macd"), C("macd_signal"), C("bb_percent_b"), C("change"), C("volume_ratio"), C("obv_trend"))
    return ind.select(
        *keep, "ticker", C("trade_date").alias("last_date"), *[rounded(c) for c in ("ma5", "ma20", "ma60", "rsi", "macd", "macd_signal", "macd_histogram", "bb_upper", "bb_lower", "bb_percent_b", "volume_ratio")],
        F.when(enough, C("obv_trend")).alias("obv_trend"), F.when(enough, S.round2(C("raw_score"))).otherwise(50.0).alias("technical_score"),
        F.when(enough, S.round2(probability)).otherwise(50.0).alias("rise_probability"), F.when(enough, source).otherwise("HEURISTIC").alias("probability_source"),
        F.when(enough, horizon).alias("probability_horizon_days"), F.when(enough, reason).otherwise(S.PHRASES["short"]).alias("technical_reason"),
    )


def snapshots(bars: DataFrame, dates: list[str], model: dict | None = None) -> DataFrame:
    """technical_snapshot as of each of some dates, in one pass: as_of and the snapshot of the bars up to it. A bar is the last
    one of all dates from its own until the next bar's; no later bar has influence. Tickers without a bar by a
    date have no row for it."""
    ind = indicated(bars, ahead=1)
    ind = ind.withColumn("until", held_until(ind)).where("own")
    asked = F.filter(F.array(*[F.lit(d).cast("date") for d in sorted(set(dates))]), lambda d: (d >= C("trade_date")) & (C("until").isNull() | (d < C("until"))))
    ind = ind.withColumn("as_of", F.explode(asked))
    return snapshot_rows(with_scores(ind), model, "as_of")


def top_news(news: DataFrame, most: int = 5) -> DataFrame:
    first = Window.partitionBy("ticker").orderBy("seq")
    return news.withColumn("_r", F.row_number().over(first)).where(C("_r") <= most).drop("_r")


def news_since(news: DataFrame, run_date: str, days: int) -> DataFrame:
    return news.where(C("news_date") >= F.date_sub(F.lit(run_date).cast("date"), days))


def avg_sentiment(stored: DataFrame, fetched: DataFrame, run_date: str, lookback: int = 7) -> DataFrame:
    """ticker, sentiment of tickers with fetched articles: the mean of the new ones; if none
    is new, of the stored ones within the lookback; if there are none, 0."""
    # exact sums, so that the mean does not hang on the order of the rows
    mean = F.sum(C("sentiment_score").cast("decimal(12,6)")).cast("double") / F.count("sentiment_score")
    fresh = insert_new(stored, fetched, NEWS_KEY, ["seq"]).groupBy("ticker").agg(mean.alias("new"))
    old = news_since(stored, run_date, lookback).groupBy("ticker").agg(mean.alias("old"))
    every = fetched.select("ticker").distinct()
    return every.join(fresh, "ticker", "left").join(old, "ticker", "left").select("ticker", F.coalesce("new", "old", F.lit(0.0)).alias("sentiment"))


def scored_by_responses(responses: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A scorer of articles by the response bodies (seq, body) of a sentiment service."""

    def scorer(news: DataFrame) -> DataFrame:
        told = responses.select("seq", parse_sentiment(C("body")).alias("p")).select("seq", C("p.score").alias("sentiment_score"), C("p.label").alias("sentiment_label"))
        return news.drop("sentiment_score", "sentiment_label").join(told, "seq")

    return scorer


def recommend(
    stocks: DataFrame, bars: DataFrame, stored: DataFrame, fetched: DataFrame, run_date: str, model: dict | None = None, scorer: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """One row per stock. Grades follow the unrounded final score. scorer: gives the fetched
    articles their sentiment_score; without one they bring it along."""
    snap = technical_snapshot(bars, model)
    newest = top_news(fetched)
    mood = avg_sentiment(stored, scorer(newest) if scorer else newest, run_date)
    rows = stocks.select("ticker", "name", "market").join(snap, "ticker", "left").join(mood, "ticker", "left")
    technical, mood = F.coalesce("technical_score", F.lit(50.0)), F.coalesce("sentiment", F.lit(0.0))
    final = S.final_score(technical, mood)
    return rows.select(
        "ticker", F.lit(run_date).cast("date").alias("rec_date"), "name", "market", S.round2(technical).alias("technical_score"), S.round2(mood).alias("sentiment_score"), S.round2(final).alias("final_score"),
        F.coalesce("rise_probability", F.lit(50.0)).alias("rise_probability"), F.coalesce("probability_source", F.lit("HEURISTIC")).alias("probability_source"), "probability_horizon_days",
        S.grade(final).alias("recommendation"), F.concat_ws(" ", F.coalesce("technical_reason", F.lit(S.PHRASES["short"])), S.sentiment_reason(mood)).alias("reason"),
    )


def indicators_with_scores(bars: DataFrame) -> DataFrame:
    return with_scores(with_indicators(bars))


def analysis_run_counts(stocks: DataFrame, bars: DataFrame) -> DataFrame:
    """total stocks and processed ones; a stock with a bar without close or date fails."""
    bad = bars.groupBy("ticker").agg(F.count_if(C("close").isNull() | C("trade_date").isNull()).alias("bad"))
    return stocks.join(bad, "ticker", "left").agg(F.count("*").alias("total"), F.count_if(F.coalesce("bad", F.lit(0)) == 0).alias("processed"))
