"""All screening queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sql
from .functions import scoring as S
from .operators import views as V
from .operators.indicators import min_history, numbered, with_ema, with_windows
from .plans import backtest as B
from .plans import recommend as R
from .plans import training as T
from .sources import adapters as A
from .sources import ingest as I
from .sources.shared import shared_folder, staged
from .sources.store import Store, month_of
from .streaming.refresh import incremental_refresh

C = F.col
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle:
            SQL[key] = oracle if oracle.startswith("WITH") else sql.WITH + oracle
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def on_bars(oracle: str | None = None):
    """A query over the daily bars."""

    def add(f):
        @functools.wraps(f)
        def run(spark, sf_dir):
            return f(A.bars(spark, sf_dir))

        return query(oracle, f.__name__)(run)

    return add


def six(*names):
    return [F.round(n, 6).alias(n) for n in names]


# Sources, sinks and merges


@on_bars("SELECT ticker, trade_date, close::DOUBLE AS close, volume::DOUBLE AS volume FROM bars")
def load_bars(bars):
    return I.load_bars(bars)


@on_bars("SELECT ticker, trade_date, close::DOUBLE AS close, volume::DOUBLE AS volume FROM bars")
def load_bars_jdbc(bars):
    """Bars written to a database and read back in balanced ranges. The database lives in the driver's JVM,
    so this entry is for a local master; read_balanced itself is for any."""
    spark, options = bars.sparkSession, {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    named = bars.select("ticker", "trade_date", "close", "volume").toDF("TICKER", "TRADE_DATE", "CLOSE_", "VOLUME")
    named.coalesce(1).write.option("createTableColumnTypes", "TICKER VARCHAR(32)").jdbc(url, "BARS", properties=options)
    return I.load_bars(I.read_balanced(spark, url, "BARS", "TRADE_DATE", 8, **options).toDF("ticker", "trade_date", "close", "volume"))


@query("SELECT ticker, trade_date, close::DOUBLE AS close, volume::DOUBLE AS volume, name FROM bars JOIN stocks USING (ticker)")
def load_bars_named(spark, sf):
    return I.load_bars_named(A.bars(spark, sf), A.stocks(spark, sf))


def _listing(spark, sf):
    s = A.stocks(spark, sf)
    return s.select("market", F.concat(F.lit(" "), "ticker", F.lit("  ")).alias("code"), F.when(C("market_cap") % 5 == 0, " ").otherwise(F.concat(F.lit(" "), "name")).alias("name"), F.when(C("market_cap") % 7 != 0, C("market_cap")).alias("cap"))


LISTING = "SELECT ticker, CASE WHEN market_cap % 5 = 0 THEN ticker ELSE name END AS name, market, CASE WHEN market_cap % 7 <> 0 THEN market_cap ELSE 0 END AS market_cap FROM stocks"


@query(LISTING + " WHERE market = 'KOSPI'")
def normalize_listing(spark, sf):
    return I.normalize_listing(_listing(spark, sf).where("market = 'KOSPI'"), "KOSPI")


def _markets(spark, sf):
    rows = _listing(spark, sf)
    return I.union_markets(*[I.normalize_listing(rows.where(C("market") == m), m) for m in ("KOSPI", "KOSDAQ")])


@query(LISTING)
def union_markets(spark, sf):
    return _markets(spark, sf)


@query(f"SELECT *, row_number() OVER (ORDER BY market_cap DESC, ticker) AS pos FROM ({LISTING}) ORDER BY market_cap DESC, ticker LIMIT 100")
def top_n_by_market_cap(spark, sf):
    return V.positioned(_markets(spark, sf).orderBy(C("market_cap").desc(), "ticker").limit(100), C("market_cap").desc(), C("ticker"))


@query("SELECT ticker, name, market, market_cap, base_date FROM stocks ORDER BY market_cap DESC, ticker")
def stocks_by_cap(spark, sf):
    return A.stocks(spark, sf).orderBy(C("market_cap").desc(), "ticker")


def _raw_bars(spark, sf):
    b = A.bars(spark, sf)
    gap = C("volume") % 11 == 0
    return b.select("ticker", F.date_format("trade_date", "yyyy-MM-dd").alias("trade_date"), *[F.when(~gap, C(c) + 0.75).alias(c) for c in ("open", "high", "low", "close")], F.when(C("volume") % 13 != 0, C("volume")).alias("volume"))


@query(
    "SELECT ticker, trade_date, " + ", ".join(f"CASE WHEN volume % 11 = 0 THEN 0 ELSE {c} END AS {c}" for c in ("open", "high", "low", "close"))
    + ", CASE WHEN volume % 13 = 0 THEN 0 ELSE volume END AS volume FROM bars"
)
def normalize_bars(spark, sf):
    return I.normalize_bars(_raw_bars(spark, sf))


@query("SELECT ticker, CASE WHEN market_cap % 3 = 0 THEN 'new ' || name ELSE name END AS name, market, CASE WHEN market_cap % 3 = 0 THEN market_cap + 1 ELSE market_cap END AS market_cap, base_date FROM stocks")
def upsert_stocks(spark, sf):
    s = A.stocks(spark, sf)
    new = s.where("market_cap % 3 = 0").withColumns({"name": F.concat(F.lit("new "), "name"), "market_cap": C("market_cap") + 1})
    return I.merge(s, new, I.STOCK_KEY, [C("base_date"), C("market_cap")])


@query("""SELECT ticker, trade_date, open, high, low, close, volume FROM bars WHERE (ticker, trade_date) NOT IN (SELECT ticker, trade_date FROM ticks WHERE qty >= 25)
UNION ALL SELECT ticker, trade_date, px, px, px, px, qty FROM (SELECT *, row_number() OVER (PARTITION BY ticker, trade_date ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, px DESC, qty DESC) AS r FROM ticks WHERE qty >= 25) WHERE r = 1""")
def upsert_bars(spark, sf):
    """Late bars merged into a table laid out by month: only months with late bars are read and written again."""
    late = A.ticks(spark, sf).where("qty >= 25").select("ticker", "trade_date", *[C("px").alias(c) for c in ("open", "high", "low", "close")], C("qty").alias("volume"), "l_orderkey", "l_linenumber", "l_partkey")
    store = Store(spark, shared_folder(spark), {"bars": ("ticker string, trade_date date, open int, high int, low int, close int, volume long", "month")})
    store.upsert("bars", A.bars(spark, sf).withColumn("month", month_of()), I.BAR_KEY, [C("close")])
    store.upsert("bars", late.withColumn("month", month_of()), I.BAR_KEY, [C(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "close", "volume")])
    return store.read("bars").drop("month")


def _snap(spark, sf):
    return R.technical_snapshot(A.bars(spark, sf))


SNAP_COLUMNS = ["ticker", "ma5", "ma20", "ma60", "rsi", "macd", "macd_signal", "macd_histogram", "bb_upper", "bb_lower", "bb_percent_b", "volume_ratio", "obv_trend", "technical_score", "rise_probability", "probability_source", "technical_reason"]


@query(f"SELECT {', '.join(SNAP_COLUMNS)}, last_date FROM snap")
def technical_snapshot(spark, sf):
    return _snap(spark, sf).select(*SNAP_COLUMNS, "last_date")


#: The ends of twelve months, the last of them beyond some tickers' last bar.
AS_OF = ["2000-11-30", "2000-12-31", "2001-01-31", "2001-02-28", "2001-03-31", "2001-04-30", "2001-05-31", "2001-06-30", "2001-07-31", "2001-08-31", "2001-09-30", "2001-10-31"]


@query(f"""SELECT d.as_of, ticker, trade_date AS last_date, CASE WHEN rn >= 60 THEN {sql.R2.format('ma20')} END AS ma20, CASE WHEN rn >= 60 THEN {sql.R2.format('rsi')} END AS rsi, CASE WHEN rn >= 60 THEN {sql.R2.format('macd')} END AS macd,
CASE WHEN rn >= 60 THEN {sql.R2.format('raw_score')} ELSE 50.0 END AS technical_score, CASE WHEN rn >= 60 THEN {sql.R2.format('heuristic')} ELSE 50.0 END AS rise_probability
FROM scored JOIN (SELECT unnest({AS_OF})::DATE AS as_of) d ON trade_date <= d.as_of QUALIFY row_number() OVER (PARTITION BY d.as_of, ticker ORDER BY trade_date DESC) = 1""")
def technical_snapshot_as_of(spark, sf):
    return R.snapshots(A.bars(spark, sf), AS_OF).select("as_of", "ticker", "last_date", "ma20", "rsi", "macd", "technical_score", "rise_probability")


@query("SELECT ticker, DATE '2001-11-03' AS calc_date, 50.0::DOUBLE AS technical_score FROM stocks UNION ALL SELECT ticker, DATE '2001-11-04', technical_score FROM snap")
def upsert_technical_scores(spark, sf):
    old = A.stocks(spark, sf).select("ticker", F.explode(F.array(*[F.lit(d).cast("date") for d in ("2001-11-03", "2001-11-04")])).alias("calc_date"), F.lit(50.0).alias("technical_score"))
    known = A.bars(spark, sf).select("ticker").distinct()
    old = old.where("calc_date = date '2001-11-03'").unionByName(old.where("calc_date = date '2001-11-04'").join(known, "ticker", "left_semi"))
    return I.merge(old, _snap(spark, sf).select("ticker", F.lit(A.RUN_DATE).cast("date").alias("calc_date"), "technical_score"), I.SCORE_KEY, [C("technical_score")])


def _news(spark, sf):
    n = A.news(spark, sf)
    return n.where("stored").drop("stored"), n.where("not stored").drop("stored")


@query("SELECT ticker, headline, news_date, url FROM fresh")
def insert_new_news(spark, sf):
    stored, batch = _news(spark, sf)
    return I.insert_new(stored, batch, I.NEWS_KEY, ["seq"]).select("ticker", "headline", "news_date", "url")


@query("SELECT ticker, headline, news_date, url FROM news WHERE NOT stored QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY seq) <= 5")
def top_news_per_ticker(spark, sf):
    return R.top_news(_news(spark, sf)[1]).select("ticker", "headline", "news_date", "url")


@query("""SELECT * FROM (SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY seq)::INT AS pos, trim(regexp_replace(headline, '\\s+', ' ', 'g')) AS headline, 'https://finance.example.com' || url AS url,
CASE WHEN seq % 7 = 2 THEN DATE '2001-11-04' ELSE news_date END AS news_date FROM news WHERE seq % 7 NOT IN (1, 3) AND trim(regexp_replace(headline, '\\s+', ' ', 'g')) <> '') WHERE pos <= 5""")
def extract_news_listing(spark, sf):
    return I.extract_news_listing(A.listing_pages(spark, sf), A.RUN_DATE)


@query("SELECT * FROM told")
def parse_sentiment_response(spark, sf):
    return A.responses(spark, sf).select("seq", I.parse_sentiment(C("body")).alias("p")).select("seq", "p.*")


@query("SELECT seq, CASE WHEN seq % 3 = 0 THEN news_date ELSE DATE '2001-11-04' END AS news_date, CASE WHEN seq % 2 = 0 THEN url ELSE 'https://finance.example.com' || url END AS url FROM (SELECT seq, news_date, CASE WHEN seq % 2 = 0 THEN 'http://x' || url ELSE url END AS url FROM news)")
def parse_news_date(spark, sf):
    n = A.news(spark, sf)
    day = F.date_format("news_date", "yyyy.MM.dd")
    day = F.when(C("seq") % 3 == 0, day).when(C("seq") % 3 == 1, F.concat(day, F.lit(" 09:30"))).otherwise("?")
    url = F.when(C("seq") % 2 == 0, F.concat(F.lit("http://x"), "url")).otherwise(C("url"))
    return n.select("seq", I.parse_news_date(day, A.RUN_DATE).alias("news_date"), I.absolutize_url(url, "https://finance.example.com").alias("url"))


# Filters and views


@query("SELECT * FROM bars WHERE ticker = (SELECT min(ticker) FROM stocks) AND trade_date >= DATE '1998-01-01' ORDER BY trade_date")
def bars_since(spark, sf):
    first = A.stocks(spark, sf).agg(F.min("ticker").alias("ticker"))
    return A.bars(spark, sf).join(F.broadcast(first), "ticker").where("trade_date >= date '1998-01-01'").orderBy("trade_date")


@on_bars("SELECT ticker, trade_date, close FROM bars QUALIFY trade_date >= max(trade_date) OVER (PARTITION BY ticker) - 365")
def chart_range(bars):
    return V.chart_range(bars, 365).select("ticker", "trade_date", "close")


@on_bars("""SELECT ticker, min(close) AS lo, max(close) AS hi, min(trade_date) AS first_date, max(trade_date) AS last_date, arg_max(close, trade_date) >= arg_min(close, trade_date) AS up
FROM (SELECT * FROM bars QUALIFY trade_date >= max(trade_date) OVER (PARTITION BY ticker) - 365) GROUP BY ticker HAVING count(*) >= 2""")
def chart_summary(bars):
    return V.chart_summary(bars, 365)


@on_bars("SELECT * FROM bars WHERE trade_date >= DATE '2001-11-04' - 365")
def history_window(bars):
    return V.history_window(bars, A.RUN_DATE, 365)


@on_bars("SELECT strftime(trade_date, '%Y-%m-%d') AS date, ticker, open, high, low, close, volume FROM bars")
def price_view(bars):
    return V.price_view(bars)


@query("SELECT ticker, news_date, headline, sentiment_score FROM news WHERE news_date >= DATE '2001-11-04' - 7 ORDER BY news_date DESC, seq")
def news_since(spark, sf):
    return R.news_since(A.news(spark, sf), A.RUN_DATE, 7).orderBy(C("news_date").desc(), "seq").select("ticker", "news_date", "headline", "sentiment_score")


def _recommend(spark, sf):
    return R.recommend(A.stocks(spark, sf), A.bars(spark, sf), *_news(spark, sf), A.RUN_DATE)


RECOMMENDED = "ticker, rec_date, name, market, technical_score, sentiment_score, final_score, rise_probability, probability_source, recommendation, reason"


@query(f"SELECT {RECOMMENDED} FROM rec")
def recommend(spark, sf):
    return _recommend(spark, sf).drop("probability_horizon_days")


@query("SELECT ticker, sentiment_score, final_score, recommendation FROM rec2")
def recommend_with_scorer(spark, sf):
    """Recommendations whose fetched articles are scored by a service's responses."""
    scorer = R.scored_by_responses(A.responses(spark, sf))
    rows = R.recommend(A.stocks(spark, sf), A.bars(spark, sf), *_news(spark, sf), A.RUN_DATE, scorer=scorer)
    return rows.select("ticker", "sentiment_score", "final_score", "recommendation")


@query("SELECT ticker, strftime(rec_date, '%Y-%m-%d') AS rec_date, name, market, final_score, recommendation FROM rec")
def recommendation_view(spark, sf):
    return V.recommendation_view(_recommend(spark, sf))


HISTORY = "(SELECT ticker, rec_date, name, final_score, recommendation FROM rec UNION ALL SELECT ticker, DATE '2001-11-03', name, CASE WHEN final_score > 50 THEN 50.0 END, 'HOLD' FROM rec)"


def _history(spark, sf):
    r = _recommend(spark, sf).select("ticker", "rec_date", "name", "final_score", "recommendation")
    old = r.withColumns({"rec_date": F.lit("2001-11-03").cast("date"), "final_score": F.when(C("final_score") > 50, 50.0), "recommendation": F.lit("HOLD")})
    return r, old


@query(f"SELECT * FROM {HISTORY}")
def upsert_recommendations(spark, sf):
    r, old = _history(spark, sf)
    stale = old.unionByName(r.withColumn("final_score", F.lit(0.0)))
    return I.merge(stale, r, I.RECOMMENDATION_KEY, [C("final_score")])


@query(f"SELECT * FROM {HISTORY} WHERE rec_date = (SELECT max(rec_date) FROM {HISTORY}) AND recommendation = 'HOLD' ORDER BY final_score DESC, ticker")
def latest_recommendations(spark, sf):
    r, old = _history(spark, sf)
    return V.latest_recommendations(r.unionByName(old), "hold")


@query(f"SELECT * FROM {HISTORY} WHERE final_score IS NOT NULL ORDER BY ticker, rec_date")
def recommendation_history(spark, sf):
    r, old = _history(spark, sf)
    return V.recommendation_history(r.unionByName(old), chart=True)


@query("SELECT ticker, name FROM rec WHERE contains(lower(name), '00001') OR contains(lower(ticker), '00001')")
def search_recommendations(spark, sf):
    return V.search(_recommend(spark, sf), " 00001 ").select("ticker", "name")


@query(f"SELECT ticker, rec_date, final_score, row_number() OVER (ORDER BY final_score DESC NULLS LAST, ticker, rec_date) AS pos FROM {HISTORY}")
def sort_recommendations(spark, sf):
    r, old = _history(spark, sf)
    return V.ranked(r.unionByName(old), C("final_score").desc_nulls_last(), C("ticker"), C("rec_date")).select("ticker", "rec_date", "final_score", "pos")


@on_bars("SELECT ticker, trade_date FROM bars QUALIFY count(*) OVER (PARTITION BY ticker) >= 65")
def min_history_gate(bars):
    return min_history(bars, 65).select("ticker", "trade_date")


@query("SELECT ticker, technical_score, rise_probability, probability_source, technical_reason FROM shortsnap")
def insufficient_row(spark, sf):
    """The snapshot over each ticker's first 50 bars: none has enough."""
    early = numbered(A.bars(spark, sf)).where("rn <= 50").drop("rn", "change")
    return R.technical_snapshot(early).select("ticker", "technical_score", "rise_probability", "probability_source", "technical_reason")


# Windows


@on_bars("SELECT ticker, trade_date, ma5, ma20, ma60 FROM ind")
def sma(bars):
    return with_windows(bars).select("ticker", "trade_date", "ma5", "ma20", "ma60")


@on_bars("SELECT ticker, trade_date, rsi FROM ind")
def rsi14(bars):
    return with_windows(bars).select("ticker", "trade_date", "rsi")


@on_bars("SELECT ticker, trade_date, ema12, ema26 FROM ema")
def ema(bars):
    return with_ema(bars).select("ticker", "trade_date", "ema12", "ema26")


@on_bars("SELECT ticker, trade_date, macd, macd_signal, macd_histogram FROM ema")
def macd(bars):
    return with_ema(bars).select("ticker", "trade_date", "macd", "macd_signal", "macd_histogram")


@on_bars("SELECT ticker, trade_date, bb_upper, bb_lower, bb_percent_b FROM ind")
def bollinger(bars):
    return with_windows(bars).select("ticker", "trade_date", "bb_upper", "bb_lower", "bb_percent_b")


@on_bars("SELECT ticker, trade_date, volume_ratio FROM ind")
def volume_ratio(bars):
    return with_windows(bars).select("ticker", "trade_date", "volume_ratio")


@on_bars("SELECT ticker, trade_date, obv, obv_trend FROM ind")
def obv_trend(bars):
    return with_windows(bars).select("ticker", "trade_date", "obv", "obv_trend")


@on_bars("SELECT ticker, trade_date, lead(close, 5) OVER w / close::DOUBLE - 1 AS fwd_return, lead(trade_date, 5) OVER w AS target_date FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)")
def forward_return(bars):
    w = Window.partitionBy("ticker").orderBy("trade_date")
    return bars.select("ticker", "trade_date", (F.try_divide(F.lead("close", 5).over(w), C("close")) - 1).alias("fwd_return"), F.lead("trade_date", 5).over(w).alias("target_date"))


# Scores


@on_bars("SELECT ticker, trade_date, ma_score, rsi_score, macd_score, bb_score, volume_score, raw_score FROM scored WHERE rn >= 60")
def rule_scores(bars):
    return R.indicators_with_scores(bars).where("rn >= 60").select("ticker", "trade_date", "ma_score", "rsi_score", "macd_score", "bb_score", "volume_score", "raw_score")


@on_bars("SELECT ticker, trade_date, floor(raw_score * 100 + 0.5) / 100 AS technical_score FROM scored WHERE rn >= 60")
def technical_score(bars):
    return R.indicators_with_scores(bars).where("rn >= 60").select("ticker", "trade_date", S.round2(C("raw_score")).alias("technical_score"))


@on_bars("SELECT ticker, trade_date, round(heuristic, 6) AS heuristic FROM scored WHERE rn >= 60")
def heuristic_probability(bars):
    return R.indicators_with_scores(bars).where("rn >= 60").select("ticker", "trade_date", *six("heuristic"))


# A made-up model of the seven features, for prediction queries.
MODEL = {
    "means": [0.0, 0.0, 0.0, 0.0, 0.0, 0.5, 0.0],
    "stds": [0.05, 0.05, 0.1, 0.25, 0.02, 0.25, 0.5],
    "weights": [-0.25, 0.125, 0.25, 0.0625, -0.125, 0.375, -0.0625],
    "bias": 0.03125,
    "forwardDays": 50,
}
_Z = " + ".join(f"({f} - ({m})) / {s} * ({w})" for f, m, s, w in zip(S.FEATURES, MODEL["means"], MODEL["stds"], MODEL["weights"], strict=True))


_HEAD = "SELECT ticker, last_date, CASE WHEN rn >= 60 THEN floor(p * 100 + 0.5) / 100 ELSE 50.0 END::DOUBLE AS rise_probability, CASE WHEN rn >= 60 THEN 'MODEL' ELSE 'HEURISTIC' END AS probability_source, CASE WHEN rn >= 60 THEN 50 END AS probability_horizon_days"


@on_bars(f"""{_HEAD} FROM (SELECT ticker, last_date, rn, greatest(1, least(99, 100 / (1 + exp(-({MODEL['bias']} + {_Z}))))) AS p FROM (
SELECT ticker, trade_date AS last_date, rn, (close - ma5) / close AS priceVsMa5, (ma5 - ma20) / nullif(ma20, 0) AS ma5VsMa20, (ma20 - ma60) / nullif(ma60, 0) AS ma20VsMa60, (rsi - 50) / 50 AS rsiNorm, macd_histogram / close AS macdHistNorm,
bb_percent_b AS bbPercentB, ln(greatest(volume_ratio, 0.01)) AS logVolumeRatio FROM ind JOIN ema USING (ticker, trade_date, rn) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY trade_date DESC) = 1))""")
def technical_snapshot_model(bars):
    """The snapshot with a model's probability in place of the heuristic one."""
    return R.technical_snapshot(bars, MODEL).select("ticker", "last_date", "rise_probability", "probability_source", "probability_horizon_days")


@on_bars("SELECT ticker, trade_date, " + ", ".join(S.FEATURES[:-1]) + ", round(logVolumeRatio, 9) AS logVolumeRatio FROM feat")
def feature_vector(bars):
    return T.features(bars, [5]).select("ticker", "trade_date", *S.FEATURES[:-1], F.round("logVolumeRatio", 9).alias("logVolumeRatio"))


@on_bars(f"SELECT ticker, trade_date, round(greatest(1, least(99, 100 / (1 + exp(-({MODEL['bias']} + {_Z}))))), 6) AS probability FROM feat")
def predict_model(bars):
    p = S.predict([C(f) for f in S.FEATURES], MODEL["means"], MODEL["stds"], MODEL["weights"], MODEL["bias"])
    return T.features(bars, [5]).select("ticker", "trade_date", F.round(p, 6).alias("probability"))


@query("SELECT ticker, sentiment FROM mood")
def avg_sentiment(spark, sf):
    stored, fetched = _news(spark, sf)
    return R.avg_sentiment(stored, R.top_news(fetched), A.RUN_DATE).select("ticker", *six("sentiment"))


@query("SELECT count(*) AS total, count(*) FILTER (ticker NOT IN (SELECT ticker FROM bars WHERE volume % 97 = 0)) AS processed FROM stocks")
def analysis_run_counts(spark, sf):
    broken = A.bars(spark, sf).withColumn("close", F.when(C("volume") % 97 != 0, C("close")))
    return R.analysis_run_counts(A.stocks(spark, sf), broken)


# Training data and evaluation


def _wide(bars, horizons=T.HORIZONS):
    """Bars are written first, so that the ticks' shuffle is gone when rows are made of them."""
    bars = staged(bars.select("ticker", "trade_date", "close", "volume"))
    return T.labelled(T.with_closes(bars, list(horizons)), list(horizons))


def _long(bars, horizons=(3, 50), mode="rel"):
    return T.long_form(_wide(bars, horizons), list(horizons), mode)


@on_bars("SELECT trade_date, round(median(fwd_return_3), 8) AS median_3, round(median(fwd_return_50), 8) AS median_50 FROM feat GROUP BY trade_date")
def market_median(bars):
    rows = staged(T.features(bars, [3, 50]))
    per = T.day_medians(rows, [3, 50]).join(rows.select("trade_date").distinct(), "trade_date", "right")
    return per.groupBy("trade_date").agg(*[F.round(F.max(F.when(C("horizon") == h, C("median"))), 8).alias(f"median_{h}") for h in (3, 50)])


@on_bars("SELECT ticker, trade_date, horizon, target_date, label_abs, label FROM long")
def labels_by_horizon(bars):
    rows = _wide(bars, [3, 50])
    both = T.long_form(rows, [3, 50], "rel").select("ticker", "trade_date", "horizon", "target_date", "label")
    return both.join(T.long_form(rows, [3, 50], "abs").select("ticker", "trade_date", "horizon", C("label").alias("label_abs")), ["ticker", "trade_date", "horizon"])


@on_bars("SELECT ticker, trade_date, target_date, label FROM long WHERE horizon = 50")
def dataset_for_horizon(bars):
    return _long(bars, [50]).select("ticker", "trade_date", "target_date", "label")


@query(sql.DATASET)
def build_dataset(spark, sf):
    """All features, and for all twelve horizons the forward return, its date and both labels."""
    rows = _wide(A.bars(spark, sf))
    cols = [c for h in T.HORIZONS for c in (F.round(f"fwd_return_{h}", 9).alias(f"fwd_return_{h}"), f"target_date_{h}", f"label_abs_{h}", f"label_rel_{h}")]
    return rows.select("ticker", "trade_date", *S.FEATURES[:-1], F.round("logVolumeRatio", 9).alias("logVolumeRatio"), *cols)


@on_bars("SELECT horizon, count(*) AS samples, round(avg(label), 8) AS positive_rate FROM long GROUP BY horizon")
def positive_rate(bars):
    return _long(bars).groupBy("horizon").agg(F.count("*").alias("samples"), F.round(F.avg("label"), 8).alias("positive_rate"))


@on_bars("SELECT horizon, count(*) AS n, " + ", ".join(f"round(avg({f}), 6) AS mean_{f}, round(stddev_pop({f}), 6) AS std_{f}" for f in S.FEATURES) + " FROM long GROUP BY horizon")
def scaler_stats(bars):
    stats = T.scaler_stats(_long(bars), ["horizon"])
    return stats.select("horizon", "n", *six(*[c for c in stats.columns if c[:4] in ("mean", "std_")]))


@on_bars("SELECT horizon, fold, train_end, test_end FROM folds")
def time_folds(bars):
    return T.time_folds(_long(bars))


@on_bars("SELECT ticker, trade_date, horizon, fold, role FROM parts")
def fold_assign(bars):
    long = _long(bars)
    return T.fold_rows(long, T.time_folds(long)).select("ticker", "trade_date", "horizon", "fold", "role")


@on_bars("SELECT horizon, fold, count(*) FILTER (role <> 'test') AS before_purge, count(*) FILTER (role = 'train') AS train_size, count(*) FILTER (role = 'test') AS test_size FROM parts GROUP BY horizon, fold")
def purge_counts(bars):
    per = T.day_sizes(T.features(bars, [3, 50]), [3, 50])
    return T.purge_counts(per, T.time_folds(per))


@on_bars("""SELECT horizon, fold, CASE WHEN a > b THEN 1.0 ELSE 0.0 END::DOUBLE AS majority, round(CASE WHEN a > b THEN c ELSE d END / (c + d), 8) AS baseline_accuracy FROM (SELECT horizon, fold,
count(*) FILTER (role = 'train' AND label = 1) AS a, count(*) FILTER (role = 'train' AND label = 0) AS b, count(*) FILTER (role = 'test' AND label = 1) AS c, count(*) FILTER (role = 'test' AND label = 0) AS d FROM parts GROUP BY ALL)""")
def majority_baseline(bars):
    long = _long(bars)
    return T.majority_baseline(T.fold_rows(long, T.time_folds(long)))


def _rated(bars):
    long = _long(bars)
    p = F.round(S.predict([C(f) for f in S.FEATURES], MODEL["means"], MODEL["stds"], MODEL["weights"], MODEL["bias"]) / 100, 6)
    return T.fold_rows(long, T.time_folds(long)).where("role = 'test'").withColumn("score", p)


@on_bars(f"""SELECT horizon, fold, round(avg((label = (score > 0.5)::INT)::INT), 8) AS accuracy,
round((sum(CASE WHEN label = 1 THEN r END) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 8) AS auc
FROM (SELECT *, rank() OVER (PARTITION BY horizon, fold ORDER BY score) + (count(*) OVER (PARTITION BY horizon, fold, score) - 1) / 2.0 AS r
FROM (SELECT *, round(greatest(1, least(99, 100 / (1 + exp(-({MODEL['bias']} + {_Z}))))) / 100, 6) AS score FROM parts WHERE role = 'test')) GROUP BY horizon, fold""")
def fold_auc(bars):
    return T.auc(_rated(bars), ["horizon", "fold"]).select("horizon", "fold", F.round("accuracy", 8).alias("accuracy"), F.round("auc", 8).alias("auc"))


@on_bars()
def walk_forward(bars):
    return T.walk_forward(_wide(bars, [50]), [50])


@on_bars()
def sweep_horizons(bars):
    return T.sweep_table(_wide(bars))


@on_bars()
def best_horizon(bars):
    return T.best_horizon(T.sweep_table(_wide(bars)))


@on_bars()
def walk_forward_summary(bars):
    return T.walk_forward_summary(T.walk_forward(_wide(bars, [50]), [50]))


def _swept(bars, horizons=(3, 50)):
    """The sweep of two horizons and its folds, with the made-up model in place of fitted ones: a 256th of its
    weights, which ranks alike and has no two scores so near 1 that they are one."""
    fixed = (np.array([*MODEL["weights"], MODEL["bias"]]) / 256, np.array(MODEL["means"]), np.array(MODEL["stds"]))
    return T.sweep_with_folds(_wide(bars, horizons), list(horizons), fixed)


_NO_VOLUME = _Z.rsplit(" + ", 1)[0]
_VARIANTS = {"no_volume": _NO_VOLUME, "full": _Z}
_METRICS = ", ".join(
    f"avg((label = (s_{v} > 0)::INT)::INT) FILTER (role = 'test') AS {v}_accuracy, (sum(r_{v}) FILTER (role = 'test' AND label = 1) - p * (p + 1) / 2.0) / nullif(p * q, 0) AS {v}_auc" for v in _VARIANTS
)
_RANKS = ", ".join(f"rank() OVER (PARTITION BY horizon, fold, role ORDER BY s_{v}) + (count(*) OVER (PARTITION BY horizon, fold, role, s_{v}) - 1) / 2.0 AS r_{v}" for v in _VARIANTS)
_FOLDS = f"""(SELECT horizon, fold, CASE WHEN a > b THEN p ELSE q END / (p + q)::DOUBLE AS baseline_accuracy, {_METRICS} FROM (SELECT *, {_RANKS},
count(*) FILTER (role = 'train' AND label = 1) OVER f AS a, count(*) FILTER (role = 'train' AND label = 0) OVER f AS b, count(*) FILTER (role = 'test' AND label = 1) OVER f AS p, count(*) FILTER (role = 'test' AND label = 0) OVER f AS q
FROM (SELECT *, {", ".join(f"{MODEL['bias']} + {z} AS s_{v}" for v, z in _VARIANTS.items())} FROM parts) WINDOW f AS (PARTITION BY horizon, fold)) WHERE a + b >= {T.MIN_TRAIN} AND p + q >= {T.MIN_TEST} GROUP BY horizon, fold, a, b, p, q)"""
_SWEEP = f"""(SELECT horizon, samples, round(avg(baseline_accuracy), 6) AS baseline_acc, round(avg(no_volume_auc), 6) AS no_volume_auc, round(avg(full_auc), 6) AS full_auc FROM {_FOLDS}
JOIN (SELECT horizon, count(*) AS samples FROM long GROUP BY horizon HAVING count(*) >= {T.MIN_SAMPLES}) USING (horizon) GROUP BY horizon, samples)"""


@on_bars("SELECT horizon, count(*) AS n_folds, " + ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_pop({m}), 6) AS {m}_std" for m in T.METRICS) + f" FROM {_FOLDS} GROUP BY horizon")
def walk_forward_summary_fixed(bars):
    out = T.walk_forward_summary(_swept(bars)[1])
    return out.select("horizon", "n_folds", *six(*[f"{m}_{k}" for m in T.METRICS for k in ("mean", "std")]))


@on_bars(f"SELECT * FROM {_SWEEP}")
def sweep_table_fixed(bars):
    return _swept(bars)[0].select("horizon", "samples", *six("baseline_acc", "no_volume_auc", "full_auc"))


@on_bars(f"SELECT horizon, full_auc, coalesce(full_auc, 0) < 0.52 AS no_signal FROM {_SWEEP} ORDER BY coalesce(full_auc, 0) DESC, horizon LIMIT 1")
def best_horizon_fixed(bars):
    return T.best_horizon(_swept(bars)[0]).select("horizon", *six("full_auc"), "no_signal")


@on_bars()
def train_final_model(bars):
    return T.train_final_model(_wide(bars, [50]))


# Backtests


@on_bars("SELECT trade_date FROM bars GROUP BY trade_date")
def trading_calendar(bars):
    return B.calendar(bars)


@on_bars("SELECT entry_date, exit_date FROM rebal")
def rebalance_dates(bars):
    return B.rebalance_dates(bars)


@on_bars("SELECT ticker, trade_date, score_v1, score_v2 FROM btscore")
def backtest_scores(bars):
    return B.backtest_scores(bars).select("ticker", "trade_date", "score_v1", "score_v2")


@query("SELECT entry_date, exit_date, ticker, name, entry_price, score_v1, score_v2 FROM cand")
def entry_asof(spark, sf):
    return B.candidates(A.bars(spark, sf), A.stocks(spark, sf))


@on_bars("""SELECT b.ticker, e.exit_date, arg_min(b.close, b.trade_date) AS exit_price FROM (SELECT DISTINCT exit_date FROM rebal WHERE exit_date IS NOT NULL) e JOIN bars b ON b.trade_date >= e.exit_date GROUP BY ALL""")
def exit_asof(bars):
    return B.exit_asof(bars, B.rebalance_dates(bars).where("exit_date is not null"))


def _backtest(key):
    def run(spark, sf):
        return B.run_backtest(A.bars(spark, sf), A.stocks(spark, sf), C(key))

    return run


TRADES = "SELECT strftime(entry_date, '%Y-%m-%d') AS entry_date, strftime(exit_date, '%Y-%m-%d') AS exit_date, ticker, name, round_even({s}, 1) AS score, round_even(ret, 2) AS returns, ret > 0 AS win FROM ({t})"
for _v in ("score_v1", "score_v2"):
    query(TRADES.format(s=_v, t=sql.priced(f"(SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY entry_date ORDER BY {_v} DESC, ticker) <= 5)")), f"run_backtest_{_v[-2:]}")(_backtest(_v))


@query("SELECT trial, entry_date, ticker FROM picks")
def random_pick(spark, sf):
    return B.random_picks(B.made_once(A.bars(spark, sf), A.stocks(spark, sf))[0]).select("trial", "entry_date", "ticker")


def _random_trials(spark, sf):
    found, bars = B.made_once(A.bars(spark, sf), A.stocks(spark, sf))
    return B.random_trials(B.random_picks(found), bars)


@query("SELECT * FROM trials")
def random_trials(spark, sf):
    return _random_trials(spark, sf)


@query(sql.COMPARISON)
def backtest_comparison(spark, sf):
    return B.comparison(A.bars(spark, sf), A.stocks(spark, sf))


def _top(bars, stocks, key="score_v2"):
    return B.top_n(B.candidates(bars, stocks), C(key))


def _top_and_bars(spark, sf):
    """Picks, and the bars that give their prices, as written tables."""
    named = B.named_bars(A.bars(spark, sf), A.stocks(spark, sf))
    return staged(B.top_n(B.of_named(named, A.stocks(spark, sf)), C("score_v2"))), named


TOP = "(SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY entry_date ORDER BY score_v2 DESC, ticker) <= 5)"


@query(f"SELECT entry_date, ticker, score_v2 AS score FROM {TOP}")
def topn_per_date(spark, sf):
    return _top(A.bars(spark, sf), A.stocks(spark, sf)).select("entry_date", "ticker", "score")


@query(f"SELECT entry_date, ticker, ret, ret > 0 AS win FROM ({sql.priced(TOP)})")
def trade_return(spark, sf):
    return B.priced(*_top_and_bars(spark, sf)).select("entry_date", "ticker", "ret", (C("ret") > 0).alias("win"))


@query(sql.summary("score_v2", "v2"))
def summarize_trades(spark, sf):
    return B.summarize_trades(B.trades(*_top_and_bars(spark, sf)), "v2")


@query(sql.RANDOM)
def random_summary(spark, sf):
    return B.random_summary(_random_trials(spark, sf))


@query(TRADES.format(s="score_v2", t=sql.priced(TOP)))
def write_trades_csv(spark, sf):
    """Trades as they come back from the CSV file."""
    rows = B.run_backtest(A.bars(spark, sf), A.stocks(spark, sf), C("score_v2"))
    path = shared_folder(spark)
    I.write_trades_csv(rows, path)
    return spark.read.schema(rows.schema).csv(path, header=True)


@query(sql.COMPARISON)
def write_comparison(spark, sf):
    """The comparison as it comes back from its CSV file."""
    rows = B.comparison(A.bars(spark, sf), A.stocks(spark, sf))
    path = shared_folder(spark)
    I.write_comparison(rows, path)
    return spark.read.schema(rows.schema).csv(path, header=True)


@on_bars()
def save_and_load_model(bars):
    path = shared_folder(bars.sparkSession)
    I.save_model(T.train_final_model(_wide(bars, [50])), path)
    return I.load_model(bars.sparkSession, path)


@on_bars()
def save_walk_forward_detail(bars):
    path = shared_folder(bars.sparkSession)
    sweep, folds = T.sweep_with_folds(_wide(bars))
    I.save_walk_forward(folds.where(C("horizon") == T.DEPLOY), sweep, path)
    return bars.sparkSession.read.json(path)


for _rule in R.RULES:

    def _score(spark, sf, r=_rule):
        bars = A.bars(spark, sf).select("ticker", "trade_date", "close", "volume")
        ind = with_ema(bars) if r == "macd" else with_windows(bars)
        return ind.where("rn >= 60").select("ticker", "trade_date", R.rule(r).alias(f"{r}_score"))

    query(f"SELECT ticker, trade_date, {_rule}_score FROM scored WHERE rn >= 60", f"score_{_rule}")(_score)


@query("SELECT ticker, round((sentiment + 1) / 2 * 100, 6) AS scaled FROM mood0")
def sentiment_scale(spark, sf):
    stored, fetched = _news(spark, sf)
    return R.avg_sentiment(stored, R.top_news(fetched), A.RUN_DATE).select("ticker", F.round(S.sentiment_scale(C("sentiment")), 6).alias("scaled"))


for _part, _columns in (("final_score", "final_score"), ("grade", "recommendation"), ("reason_text", "reason"), ("recommend_join", "name, technical_score, sentiment_score")):

    def _of(spark, sf, c=_columns):
        return _recommend(spark, sf).select("ticker", *c.split(", "))

    query(f"SELECT ticker, {_columns} FROM rec", _part)(_of)


@on_bars("SELECT ticker, trade_date, round_even(close / 8.0, 2) AS even, floor(close / 8.0 * 100 + 0.5) / 100 AS up FROM bars")
def rounding_rules(bars):
    return bars.select("ticker", "trade_date", F.bround(C("close") / 8.0, 2).alias("even"), S.round2(C("close") / 8.0).alias("up"))


# Streaming


@query("SELECT ticker, DATE '2001-11-04' AS calc_date, technical_score, rise_probability FROM snap")
def incremental_refresh_scores(spark, sf):
    return incremental_refresh(spark, f"{sf}/lineitem.parquet")
