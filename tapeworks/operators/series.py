"""Series of bars dealt by ticker and chunk of time, so that no task holds a whole ticker.

A chunk is one row with its bars in order. Each is summed up by itself: how many bars it has, what it
adds to OBV, and the affine maps that it applies to the exponential averages (for the signal line,
which follows the others, a lower-triangular one). The summaries of a ticker, a few numbers and the
last bars of each chunk, are then composed in order; this gives the state before each chunk, from which its bars are run
again. With the state come the bars before and after a chunk that windows over it read.

The maps are taken relative to the chunk's first close, so a series that does not move stays exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

#: Days of a chunk; bars before it that its windows read.
SPAN, BACK = 4096, 61
#: Averages of the close over so many days, and of the MACD.
FAST, SLOW, SIGNAL, SHORT = 12, 26, 9, 9
RATES = {"f": 2.0 / (FAST + 1), "s": 2.0 / (SLOW + 1), "e": 2.0 / (SHORT + 1)}
RATE_G = 2.0 / (SIGNAL + 1)
#: What is known of a ticker before a bar: bars, averages, OBV and the last close.
STATE = "struct<n:bigint,f:double,s:double,e:double,g:double,obv:bigint,last:bigint>"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunk_of(bars: DataFrame, span: float = SPAN) -> Column:
    """The chunk of a bar by its date or time."""
    day = F.unix_date("trade_date") if isinstance(bars.schema["trade_date"].dataType, DateType) else F.unix_micros("trade_date") / 86_400_000_000
    return F.coalesce(F.floor(day / span), F.lit(-(1 << 40)))


def chunks(bars: DataFrame, key: Column) -> DataFrame:
    """ticker, chunk, rows: the bars of each chunk in order of date."""
    row = F.struct("trade_date", *[c for c in bars.columns if c not in ("ticker", "trade_date")])
    return bars.where("ticker is not null").select("ticker", key.alias("chunk"), row.alias("row")).groupBy("ticker", "chunk").agg(F.array_sort(F.collect_list("row")).alias("rows"))


def _close(r: Column) -> Column:
    return r["close"].cast("long")


def _signed(close: Column, before: Column, volume: Column) -> Column:
    """What a bar adds to OBV."""
    return F.coalesce(F.signum((close - before).cast("double")).cast("long") * F.coalesce(volume, F.lit(0)).cast("long"), F.lit(0))


def _lockstep(closes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, now: dict[str, np.ndarray]):
    """The recursion e + (x - e) k of all averages, over many series at once: one step takes the next close of each. Yields
    what is longer than the step, where its close lies, and the averages after it."""
    order = np.argsort(-sizes, kind="stable")
    falling, starts, now = -sizes[order], starts[order], {k: v[order] for k, v in now.items()}
    for t in range(int(-falling[0]) if len(falling) else 0):
        m = int(np.searchsorted(falling, -t))  # those of more than t closes
        at = starts[:m] + t
        x = closes[at]
        new = {k: (x - now[k][:m]) * rate + now[k][:m] for k, rate in RATES.items()}
        g = now["g"][:m]
        now = new | {"g": ((new["f"] - new["s"]) - g) * RATE_G + g}
        yield order[:m], at, now


def _lists(a: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The values of a list array, and where each list starts and how long it is."""
    offsets = a.offsets.to_numpy().astype(np.int64)
    return a.flatten(), offsets[:-1] - offsets[0], np.diff(offsets)


def _doubles(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), mask=np.isnan(values))


def _added(closes: pa.Array, volumes: pa.Array) -> pa.Array:
    """What each chunk adds: its last close, OBV, and the averages of closes less the first, from zero."""
    values, starts, sizes = _lists(closes)
    volume = _lists(volumes)[0].fill_null(0).to_numpy()
    known, close = values.is_valid().to_numpy(zero_copy_only=False), values.fill_null(0).to_numpy()
    moved = np.zeros(len(close) + 1, np.int64)
    if len(close):
        moved[1:-1] = np.sign(close[1:] - close[:-1]) * volume[1:] * (known[1:] & known[:-1])
        moved[starts] = 0
    own = np.where(known, close, np.nan) - np.repeat(np.where(known[starts], close[starts], np.nan), sizes)
    out = {k: np.zeros(len(sizes)) for k in (*RATES, "g")}
    for which, _, now in _lockstep(own, starts, sizes, {k: np.zeros(len(sizes)) for k in out}):
        for k in out:
            out[k][which] = now[k]
    ends = starts + sizes - 1
    last = pa.array(close[ends], pa.int64(), mask=~known[ends])
    return pa.StructArray.from_arrays([last, pa.array(np.add.reduceat(moved, starts) if len(sizes) else moved[:0]), *[_doubles(out[k]) for k in out]], ["last", "obv", *out])


def _runs(closes: pa.Array, f: pa.Array, s: pa.Array, e: pa.Array, g: pa.Array) -> pa.Array:
    """The averages after each close of each chunk, from the state before it."""
    values, starts, sizes = _lists(closes)
    start = {k: v.to_numpy(zero_copy_only=False).astype(float) for k, v in zip("fseg", (f, s, e, g), strict=True)}
    out = {k: np.full(len(values), np.nan) for k in start}
    for _, at, now in _lockstep(values.to_numpy(zero_copy_only=False).astype(float), starts, sizes, start):
        for k in out:
            out[k][at] = now[k]
    offsets = pa.array(np.append(starts, len(values)).astype(np.int32))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, _doubles(v)) for v in out.values()], list(out))


def summaries(parts: DataFrame, ahead: int = 0) -> DataFrame:
    """ticker, chunk and what composing needs of each chunk."""
    rows = F.col("rows")
    n = F.size(rows)
    return parts.select(
        "ticker", "chunk", n.cast("long").alias("n"), _close(rows[0]).alias("first"), rows[0]["volume"].cast("long").alias("first_volume"),
        F.arrow_udf(_added, "struct<last:bigint,obv:bigint,f:double,s:double,e:double,g:double>")(F.col("rows.close").cast("array<bigint>"), F.col("rows.volume").cast("array<bigint>")).alias("add"),
        F.slice(rows, F.greatest(n - BACK + 1, F.lit(1)), F.lit(BACK)).alias("tail"), F.slice(rows, F.lit(1), F.lit(ahead)).alias("head"),
    )


def _composed(now: Column, p: Column) -> Column:
    """The state after chunk p from the one before it."""
    n, x = p["n"].cast("double"), p["first"].cast("double")
    kept = {k: F.pow(F.lit(1 - r), n) for k, r in {**RATES, "g": RATE_G}.items()}
    out = {k: x + kept[k] * (now[k] - x) + p["add"][k] for k in RATES}
    reach = lambda k: RATE_G * (1 - RATES[k]) / (RATE_G - RATES[k]) * (kept[k] - kept["g"]) * (now[k] - x)
    g = kept["g"] * now["g"] + reach("f") - reach("s") + p["add"]["g"]
    obv = now["obv"] + p["add"]["obv"] + _signed(p["first"], now["last"], p["first_volume"])
    cols = {"n": now["n"] + p["n"], **out, "g": g, "obv": obv, "last": p["add"]["last"]}
    return F.struct(*[cols[k].alias(k) for k in ("n", "f", "s", "e", "g", "obv", "last")])


def states(summed: DataFrame, row: str, ahead: int = 0, start: DataFrame | None = None) -> DataFrame:
    """ticker, chunk, state (before the chunk), back and after (bars before and after it), many
    (bars of the ticker) and first_volume of each chunk. row: type of a bar. A ticker's summaries are one
    array: a few numbers a chunk.

    start: ticker, from_chunk, state: chunks before from_chunk only give bars to back, and the state before it is
    given; a ticker without one starts from nothing."""
    names = ["chunk", "n", "first", "first_volume", "add", "tail", "head"]
    per = summed.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("parts"))
    if start is None:
        given, later = F.lit(None).cast(STATE), lambda p: F.lit(True)
    else:
        per = per.join(start.select("ticker", "from_chunk", F.col("state").alias("given")), "ticker", "left")
        given, later = F.col("given"), lambda p: F.col("from_chunk").isNull() | (p["chunk"] >= F.col("from_chunk"))

    def begun(now, p):  # before its first bar a ticker's averages are that bar's close
        x = p["first"].cast("double")
        return F.coalesce(now, F.struct(F.lit(0).cast("long").alias("n"), x.alias("f"), x.alias("s"), x.alias("e"), F.lit(0.0).alias("g"), F.lit(0).cast("long").alias("obv"), F.lit(None).cast("long").alias("last")))

    def part(a, p):  # out grows with the chunks, so it stays out of let, which copies
        state, rows = begun(a["now"], p), F.concat(a["back"], p["tail"])
        seen = F.array_append(a["out"], F.struct(p["chunk"].alias("chunk"), state.alias("state"), a["back"].alias("back")))
        kept = F.slice(rows, F.greatest(F.size(a["back"]) + F.size(p["tail"]) - BACK + 1, F.lit(1)), F.lit(BACK))
        now = F.when(later(p), let(state, lambda now: _composed(now, p))).otherwise(a["now"])
        return F.struct(now.alias("now"), kept.alias("back"), F.when(later(p), seen).otherwise(a["out"]).alias("out"))

    key = summed.schema["chunk"].dataType.simpleString()
    none = F.struct(given.alias("now"), F.array().cast(f"array<{row}>").alias("back"), F.array().cast(f"array<struct<chunk:{key},state:{STATE},back:array<{row}>>>").alias("out"))
    per = per.withColumn("scan", F.aggregate("parts", none, part))

    def before(a, p):
        return F.struct(F.slice(F.concat(p["head"], a["after"]), F.lit(1), F.lit(ahead)).alias("after"), F.array_append(a["out"], a["after"]).alias("out"))

    empty = F.struct(F.array().cast(f"array<{row}>").alias("after"), F.array().cast(f"array<array<{row}>>").alias("out"))
    afters = F.reverse(F.aggregate(F.reverse("parts"), empty, before)["out"]) if ahead else F.lit(None).cast(f"array<array<{row}>>")
    out = per.select("ticker", F.col("scan.now.n").alias("many"), F.col("parts")[0]["first_volume"].alias("first_volume"), F.size("parts").alias("size"), afters.alias("afters"), F.posexplode_outer("scan.out").alias("at", "o")).where("at is not null")  # an inner one has the scan run again, as a filter
    skipped = F.col("size") - F.max("at").over(Window.partitionBy("ticker")) - 1 if start is not None else F.lit(0)
    after = F.coalesce(F.get("afters", F.col("at") + skipped), F.array().cast(f"array<{row}>"))
    return out.select("ticker", "o.chunk", "o.state", "o.back", after.alias("after"), "many", "first_volume")


def laid(both: DataFrame, averages: bool = True) -> DataFrame:
    """Chunks with their states (see chunks, states) as one row for each bar: those of the chunk (own) and those before
    and after it that its windows read. place is the bar's number in its series. With averages: ema12, ema26,
    ema9 and macd_signal of own bars. Rows stay dealt by ticker and chunk."""
    ema = {"f": "ema12", "s": "ema26", "e": "ema9", "g": "macd_signal"} if averages else {}
    if averages:
        runs = F.arrow_udf(_runs, "struct<f:array<double>,s:array<double>,e:array<double>,g:array<double>>")
        both = both.withColumn("run", runs(F.col("rows.close").cast("array<double>"), *[F.col(f"state.{k}") for k in ema]))
    own = F.arrays_zip(F.col("rows").alias("bar"), *[F.col(f"run.{k}").alias(k) for k in ema])
    other = lambda rows: F.transform(rows, lambda r: F.struct(r.alias("bar"), *[F.lit(None).cast("double").alias(k) for k in ema]))
    back, size = F.size("back"), F.size("rows")
    every = both.select("ticker", "chunk", "many", "first_volume", F.col("state.obv").alias("obv_before"), (F.col("state.n") - back).alias("before"), back.alias("from"), (back + size).alias("to"), F.posexplode(F.concat(other("back"), own, other("after"))).alias("at", "r"))
    inside = (F.col("at") >= F.col("from")) & (F.col("at") < F.col("to"))
    return every.select("ticker", "chunk", "many", "first_volume", "obv_before", (F.col("before") + F.col("at") + 1).alias("place"), "r.bar.*", inside.alias("own"), *[F.col(f"r.{k}").alias(c) for k, c in ema.items()])


def dealt(bars: DataFrame, averages: bool = True, ahead: int = 0, span: float = SPAN) -> DataFrame:
    """All bars, laid. Bars without a ticker are left out. States, a short row for each chunk, are the hashed side of the join, so
    that chunks stay where they are and are dealt to as many tasks as before."""
    parts = chunks(bars, chunk_of(bars, span))
    row = parts.schema["rows"].dataType.elementType.simpleString()
    own = states(summaries(parts, ahead), row, ahead).hint("shuffle_hash")
    return laid(parts.join(own, ["ticker", "chunk"]), averages)
