"""Rule scores, probabilities and grades, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the features, as in model files.
FEATURES = ["priceVsMa5", "ma5VsMa20", "ma20VsMa60", "rsiNorm", "macdHistNorm", "bbPercentB", "logVolumeRatio"]

# Phrases of the reasons.
PHRASES = {
    "ma": ("이동평균 정배열(상승추세).", "이동평균 역배열(하락추세).", "단기 이평선이 중기 이평선 상회.", "단기 이평선이 중기 이평선 하회."),
    "rsi": ("과매도(반등 가능).", "과매수(조정 위험).", "중립~강세.", "중립~약세."),
    "macd": ("MACD 시그널선 상회(상승 모멘텀).", "MACD 시그널선 하회(하락 모멘텀)."),
    "bb": ("볼린저밴드 하단 근접(저평가 가능).", "볼린저밴드 상단 근접(과열 가능).", "볼린저밴드 중간 구간."),
    "volume": ("급증(상승 확인).", "거래량 동반 상승.", "급증(하락 확인).", "거래량 동반 하락.", "거래량 평이."),
    "obv": ("OBV 상승추세(매집 신호).", "OBV 하락추세(분산 신호)."),
    "news": ("최근 뉴스 흐름은 긍정적입니다.", "최근 뉴스 흐름은 부정적입니다.", "최근 뉴스 흐름은 중립적입니다."),
    "short": "가격 데이터 부족으로 중립 처리",
}


def clamp(c: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def round2(c: Column) -> Column:
    """Two places, halves up."""
    return F.floor(c * 100 + 0.5) / 100


def trend_of(ma5: Column, ma20: Column, ma60: Column, values: tuple) -> Column:
    a, b, c, d = (F.lit(v) for v in values)
    return F.when((ma5 > ma20) & (ma20 > ma60), a).when((ma5 < ma20) & (ma20 < ma60), b).when(ma5 > ma20, c).otherwise(d)


def score_ma(price: Column, ma5: Column, ma20: Column, ma60: Column) -> Column:
    return clamp(trend_of(ma5, ma20, ma60, (80.0, 20.0, 60.0, 40.0)) + F.when(price > ma5, 10.0).otherwise(-10.0))


def by_rsi(rsi: Column, values: tuple) -> Column:
    a, b, c, d = (F.lit(v) for v in values)
    return F.when(rsi <= 30, a).when(rsi >= 70, b).when(rsi >= 50, c).otherwise(d)


def score_rsi(rsi: Column) -> Column:
    return by_rsi(rsi, (75.0, 30.0, 60.0, 45.0))


def score_macd(macd: Column, signal: Column) -> Column:
    return F.when(macd > signal, 75.0).otherwise(30.0)


def by_band(percent_b: Column, values: tuple) -> Column:
    a, b, c = (F.lit(v) for v in values)
    return F.when(percent_b <= 0.2, a).when(percent_b >= 0.8, b).otherwise(c)


def score_bb(percent_b: Column) -> Column:
    return by_band(percent_b, (70.0, 35.0, 50.0))


def by_volume(change: Column, ratio: Column, values: tuple) -> Column:
    a, b, c, d, e = (v if isinstance(v, Column) else F.lit(v) for v in values)
    return F.when((change > 0) & (ratio >= 1.5), a).when((change > 0) & (ratio >= 1), b).when((change < 0) & (ratio >= 1.5), c).when((change < 0) & (ratio >= 1), d).otherwise(e)


def score_volume(change: Column, ratio: Column, trend: Column) -> Column:
    shift = F.when(trend == "RISING", 5.0).when(trend == "FALLING", -5.0).otherwise(0.0)
    return clamp(by_volume(change, ratio, (80.0, 62.0, 20.0, 38.0, 50.0)) + shift)


def weighted(ma: Column, rsi: Column, macd: Column, bb: Column, volume: Column) -> Column:
    return ma * 0.30 + rsi * 0.20 + macd * 0.20 + bb * 0.15 + volume * 0.15


def weighted_v1(ma: Column, rsi: Column, macd: Column, bb: Column) -> Column:
    return ma * 0.35 + rsi * 0.25 + macd * 0.25 + bb * 0.15


def heuristic_probability(ma: Column, rsi: Column, macd: Column, bb: Column, volume: Column) -> Column:
    """A logistic curve of the scores' distances from 50, in percent."""
    part = lambda c, w: (c - 50) / 50 * w
    return 100 / (1 + F.exp(-2.2 * (part(ma, 0.30) + part(rsi, 0.20) + part(macd, 0.20) + part(bb, 0.15) + part(volume, 0.15))))


def feature_columns(price: Column, ma5: Column, ma20: Column, ma60: Column, rsi: Column, hist: Column, percent_b: Column, ratio: Column) -> dict[str, Column]:
    """The seven model inputs, from unrounded indicators; null where one is undefined."""
    return {
        "priceVsMa5": F.try_divide(price - ma5, price),
        "ma5VsMa20": F.try_divide(ma5 - ma20, ma20),
        "ma20VsMa60": F.try_divide(ma20 - ma60, ma60),
        "rsiNorm": (rsi - 50) / 50,
        "macdHistNorm": F.try_divide(hist, price),
        "bbPercentB": percent_b,
        "logVolumeRatio": F.log(F.greatest(ratio, F.lit(0.01))),
    }


def predict(features: list[Column], means: list[float], stds: list[float], weights: list[float], bias: float) -> Column:
    """Probability in percent of a standardised logistic model, within 1..99."""
    z = F.lit(float(bias))
    for f, m, s, w in zip(features, means, stds, weights, strict=True):
        z = z + (f - m) / (s or 1.0) * w
    return clamp(100 / (1 + F.exp(-z)), 1.0, 99.0)


def sentiment_scale(score: Column) -> Column:
    return (score + 1) / 2 * 100


def final_score(technical: Column, sentiment: Column, w_technical: float = 0.65, w_sentiment: float = 0.35) -> Column:
    return clamp(technical * w_technical + sentiment_scale(sentiment) * w_sentiment)


def grade(final: Column) -> Column:
    return F.when(final >= 75, "STRONG_BUY").when(final >= 60, "BUY").when(final >= 40, "HOLD").when(final >= 25, "SELL").otherwise("STRONG_SELL")


def one_place(c: Column) -> Column:
    """The text of a number with one decimal place, halves up."""
    return F.format_string("%.1f", F.floor(c * 10 + 0.5) / 10)


def technical_reason(ma5, ma20, ma60, rsi, macd, signal, percent_b, change, ratio, trend) -> Column:
    p = PHRASES
    surge = lambda tail: F.concat(F.lit("거래량 평균 대비 "), one_place(ratio), F.lit("배 " + tail))
    volume = by_volume(change, ratio, (surge(p["volume"][0]), p["volume"][1], surge(p["volume"][2]), *p["volume"][3:]))
    obv = F.when(trend == "RISING", p["obv"][0]).when(trend == "FALLING", p["obv"][1])
    rsi_text = F.concat(F.lit("RSI "), one_place(rsi), F.lit(" "), by_rsi(rsi, p["rsi"]))
    return F.concat_ws(" ", trend_of(ma5, ma20, ma60, p["ma"]), rsi_text, F.when(macd > signal, p["macd"][0]).otherwise(p["macd"][1]), by_band(percent_b, p["bb"]), volume, obv)


def sentiment_reason(score: Column) -> Column:
    good, bad, flat = PHRASES["news"]
    return F.when(score > 0.3, good).when(score < -0.3, bad).otherwise(flat)
