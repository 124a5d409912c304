"""Normalising, merging and reading of screening data."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STOCK_KEY, BAR_KEY = ["ticker"], ["ticker", "trade_date"]
SCORE_KEY, RECOMMENDATION_KEY = ["ticker", "calc_date"], ["ticker", "rec_date"]
NEWS_KEY = ["ticker", "headline", "news_date"]


def load_bars(bars: DataFrame) -> DataFrame:
    return bars.select("ticker", "trade_date", F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume"))


def load_bars_named(bars: DataFrame, stocks: DataFrame) -> DataFrame:
    """Bars with the name of their stock; tickers without one vanish."""
    return load_bars(bars).join(stocks.select("ticker", "name"), "ticker")


def normalize_listing(rows: DataFrame, market: str) -> DataFrame:
    """A market's listing (code, name, cap): trimmed, unnamed stocks by their code, no cap
    as 0, blank codes dropped."""
    code, name = F.trim("code"), F.trim("name")
    return rows.select(
        code.alias("ticker"), F.when(F.coalesce(name, F.lit("")) == "", code).otherwise(name).alias("name"), F.lit(market).alias("market"), F.coalesce(F.col("cap").cast("long"), F.lit(0)).alias("market_cap")
    ).where("ticker is not null and ticker <> ''")


def union_markets(*markets: DataFrame) -> DataFrame:
    out = markets[0]
    for m in markets[1:]:
        out = out.unionByName(m)
    return out


def normalize_bars(rows: DataFrame) -> DataFrame:
    """Prices and volume without gaps: missing is 0, fractions are cut toward zero."""
    whole = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    return rows.select("ticker", F.col("trade_date").cast("date").alias("trade_date"), *[whole(c, "int") for c in ("open", "high", "low", "close")], whole("volume", "long"))


def merge(target: DataFrame, updates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """target with the last update of each key, by order, in place of its row. Keys without
    updates are untouched. A null key part equals a null, so that reruns change nothing."""
    last = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    updates = updates.withColumn("_r", F.row_number().over(last)).where("_r = 1").select(target.columns)
    new = updates.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return target.join(new, same, "left_anti").select(target.columns).unionByName(updates)


def insert_new(stored: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of the batch whose key is not stored, each key once, the first in order. A null key part equals a null, so that
    reruns add nothing. Keys are hashed: stored rows are first held against the batch's hashes, eight bytes each, so of the stored
    table only what the batch may have travels; equality is checked then."""
    hashed = F.xxhash64(*keys).alias("_h")
    first = Window.partitionBy("_h").orderBy(*keys, *order)
    fresh = batch.select("*", hashed)
    same = functools.reduce(Column.__and__, [F.lag(k).over(first).eqNullSafe(F.col(k)) for k in keys])
    fresh = fresh.withColumns({"_r": F.row_number().over(first), "_same": same}).where("_r = 1 or not _same")
    old = stored.select(*[F.col(k).alias(f"_{k}") for k in keys], hashed).join(fresh.select("_h").distinct(), "_h", "left_semi").withColumnRenamed("_h", "_old")
    known = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("_h") == F.col("_old"))
    return fresh.join(old, known, "left_anti").select(batch.columns)


#: Fixed value: the summary of a response that cannot be read.
BROKEN = "응답 파싱 실패"


def parse_sentiment(body: Column) -> Column:
    """struct(score, label, summary) of a response body; a broken one is neutral."""
    text = F.trim(F.regexp_replace(F.get_json_object(body, "$.content[0].text"), "```json|```", ""), F.lit(" \n\r\t"))
    good = F.get_json_object(text, "$").isNotNull()
    score = F.coalesce(F.get_json_object(text, "$.score").try_cast("double"), F.lit(0.0))
    return F.struct(
        F.when(good, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score))).otherwise(0.0).alias("score"),
        F.when(good, F.coalesce(F.get_json_object(text, "$.label"), F.lit("NEUTRAL"))).otherwise("NEUTRAL").alias("label"),
        F.when(good, F.coalesce(F.get_json_object(text, "$.summary"), F.lit(""))).otherwise(BROKEN).alias("summary"),
    )


class _Rows(HTMLParser):
    """(title, href, date) of the rows of tables of class type5 that have all cells."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.table, self.row, self.cell, self.link = [], 0, None, "", False

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        classes = (own.get("class") or "").split()
        if tag == "table":
            self.table += 1 if self.table or "type5" in classes else 0
        elif self.table and tag == "tr":
            self.row = {"title": None, "href": "", "date": None}
        elif self.row is not None and tag == "td":
            self.cell = next((c for c in ("title", "date") if c in classes), "")
            if self.cell == "date" and self.row["date"] is None:
                self.row["date"] = ""
        elif self.row is not None and tag == "a" and self.cell == "title" and self.row["title"] is None:
            self.row["title"], self.row["href"], self.link = "", own.get("href") or "", True

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
        elif tag == "td":
            self.cell = ""
        elif tag == "tr" and self.row is not None:
            if self.row["title"] is not None and self.row["date"] is not None and self.row["title"].strip():
                self.rows.append((" ".join(self.row["title"].split()), self.row["href"], self.row["date"].strip()))
            self.row = None
        elif tag == "table" and self.table:
            self.table -= 1

    def handle_data(self, data):
        if self.row is not None:
            if self.link:
                self.row["title"] += data
            elif self.cell == "date":
                self.row["date"] += data


def _listing(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for ticker, page in zip(f["ticker"], f["html"], strict=True):
            parser = _Rows()
            parser.feed(page or "")
            parser.close()
            out += [(ticker, i, *row) for i, row in enumerate(parser.rows)]
        yield pd.DataFrame(out, columns=["ticker", "pos", "headline", "href", "day"])


def parse_news_date(day: Column, run_date: str) -> Column:
    """Strictly yyyy.MM.dd, anything else is the run date."""
    strict = F.when(day.rlike(r"^\d{4}\.\d{2}\.\d{2}$"), F.try_to_timestamp(day, F.lit("yyyy.MM.dd")).cast("date"))
    return F.coalesce(strict, F.lit(run_date).cast("date"))


def absolutize_url(url: Column, site: str) -> Column:
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit(site), url))


def extract_news_listing(pages: DataFrame, run_date: str, site: str = "https://finance.example.com", most: int = 5) -> DataFrame:
    """The first articles of listing pages (ticker, html) in page order."""
    rows = pages.select("ticker", "html").mapInPandas(_listing, "ticker string, pos int, headline string, href string, day string")
    first = Window.partitionBy("ticker").orderBy("pos")
    rows = rows.withColumn("pos", F.row_number().over(first)).where(F.col("pos") <= most)
    return rows.select("ticker", "pos", "headline", absolutize_url(F.col("href"), site).alias("url"), parse_news_date(F.col("day"), run_date).alias("news_date"))


def write_trades_csv(trades: DataFrame, path: str) -> None:
    """One file with a header; trades of all months are few. They are gathered after they are made, so that what makes them
    stays in many tasks."""
    trades.repartition(1).write.mode("overwrite").csv(path, header=True)


def write_comparison(summaries: DataFrame, path: str) -> None:
    """The summaries of the variants, as one file with a header."""
    summaries.repartition(1).write.mode("overwrite").csv(path, header=True)


# The fields of a model file.
MODEL = (
    "featureNames array<string>, featureMeans array<double>, featureStds array<double>, weights array<double>, bias double, sampleCount long,"
    " positiveRate double, forwardDays int, labelMode string, trainedAt string, holdoutAccuracy double, holdoutAuc double, baselineAccuracy double,"
    " noVolumeAccuracy double, noVolumeAuc double, walkForwardFolds long"
)


def save_model(model: DataFrame, path: str) -> None:
    model.coalesce(1).write.mode("overwrite").json(path)


def load_model(spark: SparkSession, path: str) -> DataFrame | None:
    """The model's row; no forwardDays is 5, no sampleCount 0. Unreadable: None."""
    try:
        rows = spark.read.schema(MODEL).json(path).where("weights is not null and size(weights) = size(featureNames)")
        rows = rows.withColumns({"forwardDays": F.coalesce("forwardDays", F.lit(5)), "sampleCount": F.coalesce("sampleCount", F.lit(0))})
        return rows if rows.limit(1).count() else None
    except Exception as e:  # an absent file is no model, anything else is an error
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def save_walk_forward(folds: DataFrame, sweep: DataFrame, path: str) -> None:
    """Folds and sweep of a run as one nested JSON object."""
    one = folds.agg(F.sort_array(F.collect_list(F.struct(*folds.columns))).alias("folds"))
    two = sweep.agg(F.sort_array(F.collect_list(F.struct(*sweep.columns))).alias("results"))
    one.join(two).coalesce(1).write.mode("overwrite").json(path)


#: Distinct keys from which ranges of a database's table are made; the database counts them.
MAX_KEYS = 200_000


def balanced_ranges(spark: SparkSession, url: str, table: str, column: str, parts: int, **options: str) -> list[str]:
    """Conditions that cut a table of a database into ranges of about as many rows each, by the counts of
    the column's values, which the database sums up. The column must have MAX_KEYS values at most, such as dates; one value is one range at least."""
    counts = spark.read.jdbc(url, f"(SELECT {column} AS K, COUNT(*) AS N FROM {table} GROUP BY {column}) COUNTED", properties=options)
    rows = counts.limit(MAX_KEYS + 1).collect()
    if len(rows) > MAX_KEYS:
        raise ValueError(f"{column} has more than {MAX_KEYS} values")
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    total, seen, starts = sum(r[1] for r in known), 0, []
    for r in known:
        if seen >= total * len(starts) / parts:
            starts.append(r[0])
        seen += r[1]
    text = [str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'" for x in starts[1:]]
    if not text:
        return ["1 = 1"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(text[:-1], text[1:], strict=True)]
    return [f"{column} < {text[0]} OR {column} IS NULL", *inner, f"{column} >= {text[-1]}"]


def read_balanced(spark: SparkSession, url: str, table: str, column: str, parts: int, **options: str) -> DataFrame:
    """A table of a database, a task for each of its balanced ranges; filters and columns are pushed down."""
    return spark.read.jdbc(url, table, predicates=balanced_ranges(spark, url, table, column, parts, **options), properties=options)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: str, upper: str, parts: int, **options: str) -> DataFrame:
    """A table of a database, read in parallel ranges of a column."""
    return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=parts, properties=options)
