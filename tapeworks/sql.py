"""SQL of the same views that the queries read, for comparison by another engine."""

from __future__ import annotations

from .functions.scoring import PHRASES

_P = {k: [f"'{x}'" for x in v] if isinstance(v, tuple) else f"'{v}'" for k, v in PHRASES.items()}
HORIZONS = (3, 50)
FEATURES = "priceVsMa5, ma5VsMa20, ma20VsMa60, rsiNorm, macdHistNorm, bbPercentB, logVolumeRatio"


def _one(x: str) -> str:
    return f"printf('%.1f', floor({x} * 10 + 0.5) / 10)"


def _volume_text(tail: str) -> str:
    return f"'거래량 평균 대비 ' || {_one('volume_ratio')} || '배 ' || {tail}"


def _windows(source: str) -> str:
    return f"""
SELECT *, CASE WHEN width2 = 0 THEN 0.5 WHEN width2 > 0 THEN (close - bb_lower) / (bb_upper - bb_lower) END AS bb_percent_b,
  CASE WHEN v20 > 0 THEN volume / (v20 / least(rn, 20)) ELSE 1.0 END::DOUBLE AS volume_ratio,
  CASE WHEN (obv - obv5) / (abs(obv) + 1.0::DOUBLE) > 0.02 THEN 'RISING' WHEN (obv - obv5) / (abs(obv) + 1.0::DOUBLE) < -0.02 THEN 'FALLING' ELSE 'FLAT' END AS obv_trend
FROM (SELECT *, ma20 + 2 * sqrt(width2 / 400.0::DOUBLE) AS bb_upper, ma20 - 2 * sqrt(width2 / 400.0::DOUBLE) AS bb_lower, coalesce(lag(obv, 5) OVER (PARTITION BY ticker ORDER BY trade_date), 0) AS obv5
FROM (SELECT ticker, trade_date, close, volume, rn, change,
  CASE WHEN rn >= 5 THEN (sum(close) OVER (w ROWS 4 PRECEDING))::BIGINT / 5.0::DOUBLE END AS ma5,
  CASE WHEN rn >= 20 THEN (sum(close) OVER (w ROWS 19 PRECEDING))::BIGINT / 20.0::DOUBLE END AS ma20,
  CASE WHEN rn >= 60 THEN (sum(close) OVER (w ROWS 59 PRECEDING))::BIGINT / 60.0::DOUBLE END AS ma60,
  CASE WHEN rn > 14 THEN CASE WHEN sum(greatest(-change, 0)) OVER (w ROWS 13 PRECEDING) = 0 THEN 100.0::DOUBLE ELSE
    100 - 100 / (1 + ((sum(greatest(change, 0)) OVER (w ROWS 13 PRECEDING))::BIGINT / 14.0::DOUBLE) / ((sum(greatest(-change, 0)) OVER (w ROWS 13 PRECEDING))::BIGINT / 14.0::DOUBLE)) END END AS rsi,
  CASE WHEN rn >= 20 THEN 20 * (sum(close * close) OVER (w ROWS 19 PRECEDING))::BIGINT - (sum(close) OVER (w ROWS 19 PRECEDING))::BIGINT * (sum(close) OVER (w ROWS 19 PRECEDING))::BIGINT END AS width2,
  (sum(volume) OVER (w ROWS 19 PRECEDING))::BIGINT AS v20,
  (sum(coalesce(sign(change) * volume, 0)) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS obv
FROM (SELECT ticker, trade_date, close::BIGINT AS close, volume, row_number() OVER v AS rn, close::BIGINT - lag(close::BIGINT) OVER v AS change FROM {source} WINDOW v AS (PARTITION BY ticker ORDER BY trade_date))
WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)))"""


def _emas(source: str, name: str) -> str:
    return f"""
{name}ix AS (SELECT ticker, trade_date, close::DOUBLE AS c, row_number() OVER (PARTITION BY ticker ORDER BY trade_date) AS rn FROM {source}),
{name}em AS (SELECT ticker, rn, c AS f, c AS s, 0.0::DOUBLE AS g, c AS e FROM {name}ix WHERE rn = 1 UNION ALL
  SELECT ticker, rn, f, s, ((f - s) - g) * 0.2::DOUBLE + g, e FROM (SELECT i.ticker, i.rn, (i.c - m.f) * (2.0::DOUBLE / 13) + m.f AS f, (i.c - m.s) * (2.0::DOUBLE / 27) + m.s AS s, m.g, (i.c - m.e) * 0.2::DOUBLE + m.e AS e
  FROM {name}em m JOIN {name}ix i ON i.ticker = m.ticker AND i.rn = m.rn + 1)),
{name}ema AS (SELECT i.ticker, i.trade_date, i.rn, f AS ema12, s AS ema26, f - s AS macd, g AS macd_signal, f - s - g AS macd_histogram, e AS ema9 FROM {name}em JOIN {name}ix i USING (ticker, rn))"""


_MA = "CASE WHEN ma5 > ma20 AND ma20 > ma60 THEN {0} WHEN ma5 < ma20 AND ma20 < ma60 THEN {1} WHEN ma5 > ma20 THEN {2} ELSE {3} END"
_RSI = "CASE WHEN rsi <= 30 THEN {0} WHEN rsi >= 70 THEN {1} WHEN rsi >= 50 THEN {2} ELSE {3} END"
_BAND = "CASE WHEN {b} <= 0.2 THEN {0} WHEN {b} >= 0.8 THEN {1} ELSE {2} END"
_VOL = "CASE WHEN change > 0 AND volume_ratio >= 1.5 THEN {0} WHEN change > 0 AND volume_ratio >= 1 THEN {1} WHEN change < 0 AND volume_ratio >= 1.5 THEN {2} WHEN change < 0 AND volume_ratio >= 1 THEN {3} ELSE {4} END"


def _rules(source: str, signal: str, band: str, trend: str) -> str:
    return f"""SELECT *, greatest(0, least(100, {_MA.format(80, 20, 60, 40)} + CASE WHEN close > ma5 THEN 10 ELSE -10 END))::DOUBLE AS ma_score, ({_RSI.format(75, 30, 60, 45)})::DOUBLE AS rsi_score,
  CASE WHEN macd > {signal} THEN 75 ELSE 30 END::DOUBLE AS macd_score, ({_BAND.format(70, 35, 50, b=band)})::DOUBLE AS bb_score,
  greatest(0, least(100, {_VOL.format(80, 62, 20, 38, 50)} + CASE {trend} WHEN 'RISING' THEN 5 WHEN 'FALLING' THEN -5 ELSE 0 END))::DOUBLE AS volume_score FROM {source}"""


_SUM = "ma_score * 0.30::DOUBLE + rsi_score * 0.20::DOUBLE + macd_score * 0.20::DOUBLE + bb_score * 0.15::DOUBLE + volume_score * 0.15::DOUBLE"
_HEUR = "100 / (1 + exp(-2.2::DOUBLE * ({}))) ".format(" + ".join(f"({c}_score - 50) / 50 * {w}::DOUBLE" for c, w in (("ma", 0.30), ("rsi", 0.20), ("macd", 0.20), ("bb", 0.15), ("volume", 0.15))))
_R2 = R2 = "floor({} * 100 + 0.5) / 100"
_NUMBERS = ("ma5", "ma20", "ma60", "rsi", "macd", "macd_signal", "macd_histogram", "bb_upper", "bb_lower", "bb_percent_b", "volume_ratio")
_REASON = " || ' ' || ".join(
    [
        _MA.format(*_P["ma"]),
        f"'RSI ' || {_one('rsi')} || ' ' || " + _RSI.format(*_P["rsi"]),
        f"CASE WHEN macd > macd_signal THEN {_P['macd'][0]} ELSE {_P['macd'][1]} END",
        _BAND.format(*_P["bb"], b="bb_percent_b"),
        _VOL.format(_volume_text(_P["volume"][0]), _P["volume"][1], _volume_text(_P["volume"][2]), *_P["volume"][3:]),
    ]
) + f" || CASE obv_trend WHEN 'RISING' THEN ' ' || {_P['obv'][0]} WHEN 'FALLING' THEN ' ' || {_P['obv'][1]} ELSE '' END"


def _snapshot(ind: str, ema: str) -> str:
    return f"""SELECT ticker, trade_date AS last_date, {', '.join(f"CASE WHEN rn >= 60 THEN {_R2.format(c)} END AS {c}" for c in _NUMBERS)}, CASE WHEN rn >= 60 THEN obv_trend END AS obv_trend,
  CASE WHEN rn >= 60 THEN {_R2.format('greatest(0, least(100, ' + _SUM + '))')} ELSE 50.0 END AS technical_score, CASE WHEN rn >= 60 THEN {_R2.format(_HEUR)} ELSE 50.0 END AS rise_probability,
  'HEURISTIC' AS probability_source, CASE WHEN rn >= 60 THEN {_REASON} ELSE {_P['short']} END AS technical_reason
FROM ({_rules(f"(SELECT * FROM {ind} JOIN {ema} USING (ticker, trade_date, rn))", "macd_signal", "bb_percent_b", "obv_trend")}) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY trade_date DESC) = 1"""


def priced(picks: str) -> str:
    """Picks with the close of the first bar on or after their exit date, and the return."""
    return f"SELECT *, (exit_price - entry_price) / entry_price::DOUBLE * 100 AS ret FROM (SELECT p.*, b.close AS exit_price FROM {picks} p ASOF JOIN bars b ON p.ticker = b.ticker AND p.exit_date <= b.trade_date)"


def _mood(score: str) -> str:
    """Mean sentiment by ticker: of the new articles by a score of theirs, else of the stored."""
    stored = "SELECT sum(sentiment_score::DECIMAL(12, 6))::DOUBLE / count(*) FROM news s WHERE s.stored AND s.ticker = t.ticker AND news_date >= DATE '2001-11-04' - 7"
    return f"SELECT ticker, coalesce((SELECT sum(c)::DOUBLE / count(*) FROM (SELECT ticker, ({score})::DECIMAL(12, 6) AS c FROM fresh5 f) f WHERE f.ticker = t.ticker), ({stored}), 0.0) AS sentiment FROM (SELECT DISTINCT ticker FROM best5) t"


def _rec(mood: str) -> str:
    return f"""SELECT ticker, DATE '2001-11-04' AS rec_date, name, market, technical_score, {_R2.format('s')} AS sentiment_score, {_R2.format('f')} AS final_score, rise_probability, 'HEURISTIC' AS probability_source,
  CASE WHEN f >= 75 THEN 'STRONG_BUY' WHEN f >= 60 THEN 'BUY' WHEN f >= 40 THEN 'HOLD' WHEN f >= 25 THEN 'SELL' ELSE 'STRONG_SELL' END AS recommendation,
  reason || ' ' || CASE WHEN s > 0.3 THEN {_P['news'][0]} WHEN s < -0.3 THEN {_P['news'][1]} ELSE {_P['news'][2]} END AS reason
  FROM (SELECT *, greatest(0, least(100, technical_score * 0.65::DOUBLE + (s + 1) / 2 * 100 * 0.35::DOUBLE)) AS f
  FROM (SELECT k.ticker, name, market, coalesce(technical_score, 50.0) AS technical_score, coalesce(rise_probability, 50.0) AS rise_probability, coalesce(technical_reason, {_P['short']}) AS reason, coalesce(sentiment, 0.0) AS s FROM stocks k LEFT JOIN snap USING (ticker) LEFT JOIN {mood} USING (ticker)))"""


_FWD = ", ".join(f"lead(close, {h}) OVER z / close::DOUBLE - 1 AS fwd_return_{h}, lead(trade_date, {h}) OVER z AS target_date_{h}" for h in HORIZONS)
_LONG = " UNION ALL ".join(
    f"SELECT ticker, trade_date, {FEATURES}, {h} AS horizon, target_date_{h} AS target_date, (fwd_return_{h} > 0)::INT::DOUBLE AS label_abs, (fwd_return_{h} > median(fwd_return_{h}) OVER (PARTITION BY trade_date))::INT::DOUBLE AS label FROM feat"
    for h in HORIZONS
)
_EDGE = "d[least(floor(n * {} / 6.0), n - 1)::BIGINT + 1]"

WITH = f"""WITH RECURSIVE
ticks AS (SELECT lpad(l_suppkey::VARCHAR, 6, '0') AS ticker, l_shipdate::DATE AS trade_date, floor(l_extendedprice / l_quantity + 0.5)::INT AS px, l_quantity::BIGINT AS qty, l_orderkey, l_linenumber, l_partkey FROM lineitem),
bars AS MATERIALIZED (SELECT ticker, trade_date, first(px ORDER BY l_orderkey, l_linenumber, l_partkey, px, qty) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY l_orderkey, l_linenumber, l_partkey, px, qty) AS close, sum(qty)::BIGINT AS volume FROM ticks GROUP BY ALL),
stocks AS (SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS ticker, s_name AS name, CASE WHEN n_regionkey % 2 = 0 THEN 'KOSPI' ELSE 'KOSDAQ' END AS market, floor((s_acctbal + 1000) * 1000000)::BIGINT AS market_cap, '20011104' AS base_date FROM supplier JOIN nation ON s_nationkey = n_nationkey),
news AS (SELECT lpad((doc_id % (SELECT count(*) FROM supplier))::VARCHAR, 6, '0') AS ticker, DATE '2001-10-01' + (doc_id % 35)::INT AS news_date, trim(split_part(text, chr(10), 1)) AS headline, '/item/news_read?id=' || doc_id AS url,
  ((n_chars % 201) - 100) / 100.0::DOUBLE AS sentiment_score, doc_id % 3 = 0 AS stored, doc_id AS seq FROM documents),
fresh AS (SELECT * FROM (SELECT * FROM news WHERE NOT stored QUALIFY row_number() OVER (PARTITION BY ticker, headline, news_date ORDER BY seq) = 1) f WHERE NOT EXISTS (SELECT 1 FROM news s WHERE s.stored AND s.ticker = f.ticker AND s.headline IS NOT DISTINCT FROM f.headline AND s.news_date = f.news_date)),
best5 AS (SELECT * FROM news WHERE NOT stored QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY seq) <= 5),
fresh5 AS (SELECT * FROM (SELECT * FROM best5 QUALIFY row_number() OVER (PARTITION BY ticker, headline, news_date ORDER BY seq) = 1) f WHERE NOT EXISTS (SELECT 1 FROM news s WHERE s.stored AND s.ticker = f.ticker AND s.headline IS NOT DISTINCT FROM f.headline AND s.news_date = f.news_date)),
mood0 AS ({_mood("sentiment_score")}),
mood AS (SELECT ticker, round(sentiment, 6) + 0.0 AS sentiment FROM mood0),
told AS (SELECT doc_id AS seq, CASE WHEN doc_id % 8 = 2 THEN 1 WHEN doc_id % 8 = 6 THEN -1 WHEN doc_id % 8 IN (5, 7) THEN 0 ELSE coalesce(((n_chars % 201) - 100) / 100.0::DOUBLE, 0) END::DOUBLE AS score,
  CASE WHEN doc_id % 8 IN (4, 5, 7) THEN 'NEUTRAL' ELSE 'UPBEAT' END AS label, CASE WHEN doc_id % 8 IN (5, 7) THEN '응답 파싱 실패' ELSE coalesce(text, '') END AS summary FROM documents),
mood2 AS ({_mood("(SELECT score FROM told WHERE told.seq = f.seq)")}),
ind AS (SELECT * FROM ({_windows('bars')})),{_emas('bars', '')},
scored AS (SELECT *, greatest(0, least(100, {_SUM})) AS raw_score, {_HEUR} AS heuristic FROM ({_rules("(SELECT * FROM ind JOIN ema USING (ticker, trade_date, rn))", "macd_signal", "bb_percent_b", "obv_trend")})),
snap AS ({_snapshot('ind', 'ema')}),
early AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY trade_date) <= 50),
shortsnap AS (SELECT ticker, 50.0::DOUBLE AS technical_score, 50.0::DOUBLE AS rise_probability, 'HEURISTIC' AS probability_source, {_P['short']} AS technical_reason FROM early GROUP BY ticker),
rec AS ({_rec("mood0")}),
rec2 AS ({_rec("mood2")}),
feat AS (SELECT * FROM (SELECT ticker, trade_date, rn, (close - ma5) / close AS priceVsMa5, (ma5 - ma20) / nullif(ma20, 0) AS ma5VsMa20, (ma20 - ma60) / nullif(ma60, 0) AS ma20VsMa60, (rsi - 50) / 50 AS rsiNorm, macd_histogram / close AS macdHistNorm,
  CASE WHEN width2 > 0 THEN bb_percent_b END AS bbPercentB, ln(greatest(CASE WHEN v20 > 0 THEN volume_ratio END, 0.01)) AS logVolumeRatio, {_FWD}
  FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS many FROM ind JOIN ema USING (ticker, trade_date, rn)) WHERE many >= 65 WINDOW z AS (PARTITION BY ticker ORDER BY trade_date))
  WHERE rn >= 20 AND priceVsMa5 IS NOT NULL AND ma5VsMa20 IS NOT NULL AND ma20VsMa60 IS NOT NULL AND rsiNorm IS NOT NULL AND macdHistNorm IS NOT NULL AND bbPercentB IS NOT NULL AND logVolumeRatio IS NOT NULL),
long AS (SELECT * FROM ({_LONG}) WHERE label IS NOT NULL),
folds AS (SELECT horizon, fold, {_EDGE.format('fold')} AS train_end, CASE WHEN fold = 5 THEN d[-1] + 1 ELSE {_EDGE.format('(fold + 1)')} END AS test_end
  FROM (SELECT horizon, list(trade_date ORDER BY trade_date) AS d, count(*) AS n FROM (SELECT DISTINCT horizon, trade_date FROM long) GROUP BY horizon HAVING count(*) >= 60), (SELECT unnest(range(1, 6))::INT AS fold)),
parts AS (SELECT l.*, fold, CASE WHEN trade_date >= train_end THEN 'test' WHEN target_date < train_end THEN 'train' ELSE 'purged' END AS role FROM long l JOIN folds USING (horizon) WHERE trade_date < test_end),
cal AS (SELECT trade_date, lag(month(trade_date)) OVER (ORDER BY trade_date) AS pm, lead(trade_date, 30) OVER (ORDER BY trade_date) AS exit_date, count(*) OVER () AS days FROM (SELECT DISTINCT trade_date FROM bars)),
rebal AS (SELECT trade_date AS entry_date, exit_date, days FROM cal WHERE pm IS NULL OR pm <> month(trade_date)),
bt AS (SELECT *, obv - v0 AS obvb, ma20 - 2 * sqrt(width2 / 380.0::DOUBLE) AS lowb, ma20 + 2 * sqrt(width2 / 380.0::DOUBLE) AS highb FROM (SELECT *, first_value(volume) OVER (PARTITION BY ticker ORDER BY trade_date) AS v0, lag(obv, 5) OVER (PARTITION BY ticker ORDER BY trade_date) AS ob5 FROM ind JOIN ema USING (ticker, trade_date, rn))),
btrules AS ({_rules("(SELECT *, CASE WHEN width2 = 0 THEN 0.5 WHEN width2 > 0 THEN (close - lowb) / (highb - lowb) END AS band, CASE WHEN (obv - ob5) / (abs(obvb) + 1.0::DOUBLE) > 0.02 THEN 'RISING' WHEN (obv - ob5) / (abs(obvb) + 1.0::DOUBLE) < -0.02 THEN 'FALLING' ELSE 'FLAT' END AS trend FROM bt)", "ema9", "band", "trend")}),
btscore AS (SELECT ticker, trade_date, rn, close, CASE WHEN rn >= 60 THEN ma_score * 0.35::DOUBLE + rsi_score * 0.25::DOUBLE + macd_score * 0.25::DOUBLE + bb_score * 0.15::DOUBLE ELSE 50.0 END AS score_v1, CASE WHEN rn >= 60 THEN {_SUM} ELSE 50.0 END AS score_v2 FROM btrules),
cand AS (SELECT r.entry_date, r.exit_date, b.ticker, name, close AS entry_price, score_v1, score_v2 FROM rebal r JOIN btscore b ON b.trade_date <= r.entry_date JOIN stocks USING (ticker) WHERE r.exit_date IS NOT NULL AND days >= 90 QUALIFY row_number() OVER (PARTITION BY r.entry_date, b.ticker ORDER BY b.trade_date DESC) = 1 AND rn >= 60),
picks AS (SELECT trial, c.* FROM cand c, (SELECT unnest(range(50))::INT AS trial) QUALIFY row_number() OVER (PARTITION BY trial, entry_date ORDER BY md5(trial || ':' || strftime(entry_date, '%Y-%m-%d') || ':' || ticker)) <= 5),
trials AS (SELECT trial, round_even(avg((ret > 0)::INT) * 100, 6) AS win_rate, round(avg(round_even(ret, 2)), 6) AS avg_return, round(median(round_even(ret, 2)), 6) AS median_return FROM ({priced('picks')}) GROUP BY trial)
"""


def _two(x: str) -> str:
    return f"round_even(round({x}, 8), 2)"


def summary(score: str, label: str) -> str:
    top = f"(SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY entry_date ORDER BY {score} DESC, ticker) <= 5)"
    return f"""SELECT '{label}' AS label, count(*)::VARCHAR AS trades, round_even(round(avg(win::INT) * 100, 8), 1) AS win_rate, {_two('avg(r)')} AS avg_return, {_two('median(r)')} AS median_return, {_two('stddev_samp(r)')} AS std_return, min(r) AS min_return, max(r) AS max_return
FROM (SELECT round_even(ret, 2) AS r, ret > 0 AS win FROM ({priced(top)}))"""


RANDOM = f"""SELECT 'random' AS label, count(*) || ' trials' AS trades, round_even(round(avg(win_rate), 8), 1) AS win_rate, {_two('avg(avg_return)')} AS avg_return, {_two('avg(median_return)')} AS median_return, {_two('stddev_samp(avg_return)')} AS std_return, {_two('min(avg_return)')} AS min_return, {_two('max(avg_return)')} AS max_return FROM trials"""
COMPARISON = f"{summary('score_v1', 'v1')} UNION ALL {summary('score_v2', 'v2')} UNION ALL {RANDOM}"


#: All of SURVEY's horizons, in place of the two of the shared views.
_ALL = (3, 5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100)
_LEADS = ", ".join(f"lead(close, {h}) OVER z / close::DOUBLE - 1 AS fwd_return_{h}, lead(trade_date, {h}) OVER z AS target_date_{h}" for h in _ALL)
_LABELS = ", ".join(
    f"round(fwd_return_{h}, 9) AS fwd_return_{h}, target_date_{h}, (fwd_return_{h} > 0)::INT::DOUBLE AS label_abs_{h}, (fwd_return_{h} > m{h})::INT::DOUBLE AS label_rel_{h}" for h in _ALL
)
_MEDIANS = ", ".join(f"median(fwd_return_{h}) AS m{h}" for h in _ALL)
_FEATURES = ", ".join(f if f != "logVolumeRatio" else "round(logVolumeRatio, 9) AS logVolumeRatio" for f in FEATURES.split(", "))
DATASET = WITH.replace(_FWD, _LEADS) + f"SELECT ticker, trade_date, {_FEATURES}, {_LABELS} FROM feat JOIN (SELECT trade_date, {_MEDIANS} FROM feat GROUP BY trade_date) USING (trade_date)"
