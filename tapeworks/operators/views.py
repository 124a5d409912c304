"""Reader-facing selections of bars and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import staged

C = F.col


def positioned(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with pos, their place from 1 in an order of all of them: for short lists that a
    reader sees as a whole."""
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with pos, as positioned, for tables of any length: dealt by range of the order,
    numbered within each range, and moved on by the sizes of the ranges before."""
    dealt = staged(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    own = dealt.withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return own.join(F.broadcast(shifts), "_range").withColumn("pos", (C("_place") + C("_shift")).cast("int")).drop("_range", "_place", "_shift")


def chart_range(bars: DataFrame, days: int | None) -> DataFrame:
    """Bars of each ticker's last days (of the calendar); all without days."""
    if days is None:
        return bars
    last = F.max("trade_date").over(Window.partitionBy("ticker"))
    return bars.withColumn("_last", last).where(C("trade_date") >= F.date_sub("_last", days)).drop("_last")


def chart_summary(bars: DataFrame, days: int | None) -> DataFrame:
    rows = chart_range(bars, days)
    per = rows.groupBy("ticker").agg(
        F.min("close").alias("lo"), F.max("close").alias("hi"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"),
        (F.max_by("close", "trade_date") >= F.min_by("close", "trade_date")).alias("up"), F.count("*").alias("n"),
    )
    return per.where("n >= 2").drop("n")


def history_window(bars: DataFrame, run_date: str, days: int) -> DataFrame:
    return bars.where(C("trade_date") >= F.date_sub(F.lit(run_date).cast("date"), days))


def price_view(bars: DataFrame) -> DataFrame:
    return bars.select(F.date_format("trade_date", "yyyy-MM-dd").alias("date"), "ticker", "open", "high", "low", "close", "volume")


def recommendation_view(rows: DataFrame) -> DataFrame:
    return rows.select("ticker", F.date_format("rec_date", "yyyy-MM-dd").alias("rec_date"), "name", "market", "final_score", "recommendation")


def latest_recommendations(rows: DataFrame, grade: str | None = None) -> DataFrame:
    """Rows of the last date, best first; of one grade, in any case of letters, if given."""
    last = rows.agg(F.max("rec_date").alias("rec_date"))
    found = rows.join(F.broadcast(last), "rec_date", "left_semi")
    if grade:
        found = found.where(C("recommendation") == grade.upper())
    return found.orderBy(C("final_score").desc(), "ticker")


def search(rows: DataFrame, keyword: str) -> DataFrame:
    word = keyword.strip().lower()
    return rows.where(F.lower("name").contains(word) | F.lower("ticker").contains(word))


def recommendation_history(rows: DataFrame, chart: bool = False) -> DataFrame:
    """Newest first; for a chart oldest first and scored only."""
    return rows.where("final_score is not null").orderBy("ticker", "rec_date") if chart else rows.orderBy("ticker", C("rec_date").desc())
