"""Screening inputs derived from the tables at hand: an instrument is a supplier, a tick a
line item, an article a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_DATE = "2001-11-04"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticker_of(key: Column) -> Column:
    return F.lpad(key.cast("string"), 6, "0")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_of(table(spark, sf_dir, "lineitem"))


def ticks_of(line: DataFrame) -> DataFrame:
    return line.select(
        ticker_of(F.col("l_suppkey")).alias("ticker"),
        F.col("l_shipdate").cast("date").alias("trade_date"),
        F.floor(F.col("l_extendedprice") / F.col("l_quantity") + 0.5).cast("int").alias("px"),
        F.col("l_quantity").cast("long").alias("qty"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
    )


def bars_of(tick: DataFrame) -> DataFrame:
    """Daily bars: the first tick opens, the last closes; partial sums before the shuffle."""
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "px", "qty")
    return tick.groupBy("ticker", "trade_date").agg(
        F.min_by("px", seq).alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", seq).alias("close"),
        F.sum("qty").alias("volume"),
    )


def bar_states(tick: DataFrame) -> DataFrame:
    """Daily bars that can be merged: the first and the last tick by sequence, high, low and sum. Ticks of a day may
    come in any number of parts and in any order."""
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "px", "qty")
    return tick.groupBy("ticker", "trade_date").agg(F.min(seq).alias("first"), F.max(seq).alias("last"), F.max("px").alias("high"), F.min("px").alias("low"), F.sum("qty").alias("volume"))


def merged_states(states: DataFrame, *keys: str) -> DataFrame:
    """One state for each bar."""
    return states.groupBy("ticker", "trade_date", *keys).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"))


def bars_from(states: DataFrame, *keys: str) -> DataFrame:
    return states.select("ticker", "trade_date", *keys, F.col("first.px").alias("open"), "high", "low", F.col("last.px").alias("close"), "volume")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_of(ticks(spark, sf_dir))


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return (
        table(spark, sf_dir, "supplier")
        .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            ticker_of(F.col("s_suppkey")).alias("ticker"),
            F.col("s_name").alias("name"),
            F.when(F.col("n_regionkey") % 2 == 0, "KOSPI").otherwise("KOSDAQ").alias("market"),
            F.floor((F.col("s_acctbal") + 1000) * 1000000).cast("long").alias("market_cap"),
            F.lit("20011104").alias("base_date"),
        )
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with seq as page order; the headline is a text's first line; stored tells those
    that are already known. Scores are made up from the length."""
    many = table(spark, sf_dir, "supplier").agg(F.count("*").alias("many"))
    score = ((F.col("n_chars") % 201) - 100) / 100.0
    return (
        table(spark, sf_dir, "documents")
        .join(F.broadcast(many))
        .select(
            ticker_of(F.col("doc_id") % F.col("many")).alias("ticker"),
            F.date_add(F.lit("2001-10-01").cast("date"), (F.col("doc_id") % 35).cast("int")).alias("news_date"),
            F.trim(F.substring_index("text", "\n", 1)).alias("headline"),
            F.concat(F.lit("/item/news_read?id="), F.col("doc_id").cast("string")).alias("url"),
            score.alias("sentiment_score"),
            F.when(score > 0.3, "POSITIVE").when(score < -0.3, "NEGATIVE").otherwise("NEUTRAL").alias("sentiment_label"),
            (F.col("doc_id") % 3 == 0).alias("stored"),
            F.col("doc_id").alias("seq"),
        )
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentiment service's response body for each document, with the document's whole text as
    summary: plain, fenced, out of range, as text, without label, broken or empty."""
    score, kind = F.coalesce(((F.col("n_chars") % 201) - 100) / 100.0, F.lit(0.0)), F.col("doc_id") % 8
    parts = [F.lit("UPBEAT").alias("label"), F.col("text").alias("summary")]
    inner = (
        F.when(kind == 1, F.concat(F.lit("```json\n"), F.to_json(F.struct(score.alias("score"), *parts)), F.lit("\n```")))
        .when(kind == 2, F.to_json(F.struct(F.lit(12).alias("score"), *parts)))
        .when(kind == 3, F.to_json(F.struct(score.cast("string").alias("score"), *parts)))
        .when(kind == 4, F.to_json(F.struct(score.alias("score"), parts[1])))
        .when(kind == 5, F.concat(F.lit("I would say: "), F.col("text")))
        .when(kind == 6, F.to_json(F.struct(F.lit(-3.5).alias("score"), *parts)))
        .otherwise(F.to_json(F.struct(score.alias("score"), *parts)))
    )
    part = F.struct(F.lit("text").alias("type"), inner.alias("text"))
    body = F.when(kind == 7, F.lit('{"content":[]}')).otherwise(F.to_json(F.struct(F.array(part).alias("content"))))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), body.alias("body"))


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing page per ticker, with rows that lack a date or a title."""
    rows = news(spark, sf_dir)
    day = F.date_format("news_date", "yyyy.MM.dd")
    kind = F.col("seq") % 7
    date = F.when(kind == 1, "").when(kind == 2, F.concat(F.lit('<td class="date">'), day, F.lit(" 09:30</td>"))).otherwise(F.concat(F.lit('<td class="date">'), day, F.lit("</td>")))
    title = F.when(kind == 3, " ").otherwise(F.regexp_replace(F.regexp_replace("headline", "&", "&amp;"), "<", "&lt;"))
    tr = F.concat(F.lit('<tr><td class="title"><a href="'), "url", F.lit('">'), title, F.lit("</a></td>"), date, F.lit("</tr>"))
    per = rows.select("ticker", F.struct("seq", tr.alias("tr")).alias("r")).groupBy("ticker").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return per.select("ticker", F.concat(F.lit('<html><table class="type5">'), F.array_join("r.tr", ""), F.lit("</table></html>")).alias("html"))
