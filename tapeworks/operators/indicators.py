"""Indicators of daily bars. All windows share one partitioning (ticker and chunk of time, see
series) and order, so bars are shuffled once. Closes and volumes are whole numbers, so window sums are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import SPAN, dealt

#: What bars bring along for windows over their chunk.
INNER = ["chunk", "own", "many", "first_volume", "obv_before", "place", "v20", "width2", "obv5"]


def by():
    return Window.partitionBy("ticker", "chunk").orderBy("place")


def _own(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.where("own").drop(*[c for c in INNER if c not in keep])


def changed(rows: DataFrame) -> DataFrame:
    """Laid bars with rn (place of the bar in its series) and change (of the close; null on the first)."""
    close = F.col("close").cast("long")
    return rows.withColumns({"rn": F.col("place").cast("int"), "change": close - F.lag(close).over(by())})


def summed(rows: DataFrame, of: dict[str, tuple[Column, list[int]]]) -> DataFrame:
    """rows with, for each name, column and lengths: name_all, the column's sum over all rows so far, and name_n, over the last n,
    as the difference of two running sums. The columns are whole and not null, so that this is exact, at a cost that does not grow with n."""
    upto = by().rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"{k}_all": F.sum(c).over(upto) for k, (c, _) in of.items()})
    return out.withColumns({f"{k}_{n}": F.col(f"{k}_all") - F.coalesce(F.lag(f"{k}_all", n).over(by()), F.lit(0)) for k, (_, ns) in of.items() for n in ns})


def sma(n: int):
    return F.when((F.col("rn") >= n) & (F.col(f"known_{n}") > 0), F.col(f"close_{n}") / float(n))


def rsi(n: int = 14):
    gain, loss = F.col(f"gain_{n}"), F.col(f"loss_{n}")
    value = F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(gain / float(n), loss / float(n))))
    return F.when(F.col("rn") > n, value)


def windowed(rows: DataFrame) -> DataFrame:
    """Laid bars with averages, RSI, Bollinger bands, volume ratio and OBV; what they say of bars that are not own is
    incomplete. width2 is 20 * sum(x*x) - sum(x)^2, an exact integer that is 0 for a band without width; obv5 is
    the OBV five bars before (null: none)."""
    c, v, zero = F.col("close").cast("long"), F.coalesce(F.col("volume"), F.lit(0)).cast("long"), F.lit(0).cast("long")
    signed = F.coalesce(F.signum(F.col("change").cast("double")).cast("long") * v, zero)
    sums = {
        "known": (F.when(c.isNull(), 0).otherwise(1), [5, 20, 60]), "close": (F.coalesce(c, zero), [5, 20, 60]), "square": (F.coalesce(c * c, zero), [20]), "volume": (v, [20]),
        "gain": (F.greatest(F.col("change"), zero), [14]), "loss": (F.greatest(-F.col("change"), zero), [14]), "signed": (signed, [5]), "moved": (F.when(F.col("own"), signed).otherwise(zero), []),
    }
    out = summed(changed(rows), sums)
    out = out.withColumns(
        {
            "ma5": sma(5), "ma20": sma(20), "ma60": sma(60), "rsi": rsi(),
            "width2": F.when((F.col("rn") >= 20) & (F.col("known_20") > 0), 20 * F.col("square_20") - F.col("close_20") * F.col("close_20")),
            "v20": F.col("volume_20"),
            "obv": F.col("obv_before") + F.col("moved_all"),
            "obv5": F.when(F.col("rn") > 5, F.col("signed_5")),
        }
    ).drop(*[f"{k}_{n}" for k, (_, ns) in sums.items() for n in (*ns, "all")])
    std = F.sqrt(F.col("width2") / 400.0)
    out = out.withColumns({"bb_upper": F.col("ma20") + 2 * std, "bb_lower": F.col("ma20") - 2 * std, "obv5": F.col("obv") - F.col("obv5")})
    width = F.col("bb_upper") - F.col("bb_lower")
    moved = (F.col("obv") - F.coalesce("obv5", F.lit(0))) / (F.abs("obv") + 1.0)
    return out.withColumns(
        {
            "bb_percent_b": F.when(F.col("width2") == 0, 0.5).when(F.col("width2") > 0, F.try_divide(c - F.col("bb_lower"), width)),
            "volume_ratio": F.when(F.col("v20") > 0, v / (F.col("v20") / F.least(F.col("rn"), F.lit(20)))).otherwise(1.0),
            "obv_trend": F.when(moved > 0.02, "RISING").when(moved < -0.02, "FALLING").otherwise("FLAT"),
        }
    )


def averaged(rows: DataFrame) -> DataFrame:
    macd = F.col("ema12") - F.col("ema26")
    return rows.withColumn("macd", macd).withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))


def numbered(bars: DataFrame, span: float = SPAN) -> DataFrame:
    """bars with rn and change."""
    return _own(changed(dealt(bars, averages=False, span=span)))


def with_windows(bars: DataFrame, span: float = SPAN) -> DataFrame:
    """bars with the indicators of windowed."""
    return _own(windowed(dealt(bars, averages=False, span=span)), "v20", "width2", "obv5")


def with_ema(bars: DataFrame, span: float = SPAN) -> DataFrame:
    """bars with rn, ema12, ema26, ema9, macd, macd_signal and macd_histogram. A series of more than span days is run in
    chunks; it then agrees with the recursion in about twelve digits, else in all."""
    return _own(averaged(dealt(bars, span=span)).withColumn("rn", F.col("place").cast("int")))


def indicated(bars: DataFrame, ahead: int = 0, span: float = SPAN) -> DataFrame:
    """All indicators on laid bars; with so many bars after each chunk."""
    return windowed(averaged(dealt(bars.select("ticker", "trade_date", "close", "volume"), ahead=ahead, span=span)))


def with_indicators(bars: DataFrame, span: float = SPAN) -> DataFrame:
    return _own(indicated(bars, span=span), "v20", "width2", "obv5", "many", "first_volume")


def min_history(bars: DataFrame, least: int) -> DataFrame:
    """Bars of tickers with at least so many."""
    return bars.withColumn("_n", F.count("*").over(Window.partitionBy("ticker"))).where(F.col("_n") >= least).drop("_n")


def held_until(rows: DataFrame) -> Column:
    """The date of the bar after each laid bar (null: there is none); needs one bar ahead."""
    return F.lead("trade_date").over(by())
