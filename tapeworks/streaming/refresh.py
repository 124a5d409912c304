"""Incremental refresh: new files of ticks update the bars and the scores they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.indicators import averaged, windowed
from ..operators.series import STATE, chunks, laid, states, summaries
from ..plans.recommend import snapshot_rows, with_scores
from ..sources.adapters import RUN_DATE, bar_states, bars_from, merged_states, ticks_of
from ..sources.ingest import SCORE_KEY, merge
from ..sources.shared import shared_folder, staged
from ..sources.store import Store, month_of

TICK = "struct<l_orderkey:bigint,l_linenumber:int,l_partkey:bigint,px:int,qty:bigint>"
#: Bars that can be merged, by month; the state of a ticker before each month with bars of it, and
#: the month from which the bars that windows read come; scores by bucket of tickers.
KINDS = {
    "bars": (f"ticker string, trade_date date, first {TICK}, last {TICK}, high int, low int, volume long", "month"),
    "points": (f"ticker string, state {STATE}, back_month string", "month"),
    "scores": ("ticker string, calc_date date, technical_score double, rise_probability double", "bucket"),
}
#: Buckets of scores; months in which the last point of a ticker is looked for first.
SCORE_BUCKETS, RECENT = 16, 3


def _points(store: Store, touched: DataFrame, since: list[str], below: int) -> DataFrame:
    """Of each touched ticker (since: its first month with news) the last point at or before that month. A
    ticker is looked for in the latest months first, then in all."""
    months = sorted(m for m in store.versions("points", below) if m <= max(since))

    def latest(parts, who):
        own = store.read("points", parts, below).join(who, "ticker").where("month <= since")
        return own.groupBy("ticker").agg(F.max_by(F.struct(F.col("month").alias("from_chunk"), "state", "back_month"), "month").alias("p")).select("ticker", "p.*")

    # Only months right before since are the latest ones; a ticker with late news is looked for there, too.
    first = sorted({m for s in since for m in [x for x in months if x <= s][-RECENT:]})
    found = staged(latest(first, touched))
    rest = [m for m in months if m not in first]
    lack = touched.join(found, "ticker", "left_anti")
    if rest and lack.limit(1).count():
        found = staged(found.unionByName(latest(rest, lack)))
    return found


def apply_ticks(store: Store, ticks: DataFrame, number: int, run_date: str = RUN_DATE) -> None:
    """One batch: its bars are merged into their months, and the tickers it touches are run again from the last point
    before the first month with news, over the months since then and those that windows reach back to. Late ticks
    restart a ticker from the point before them. Nothing is seen by readers before the commit."""
    new = staged(bar_states(ticks).withColumn("month", month_of()))
    months = sorted(r.month for r in new.select("month").distinct().collect())
    if not months:
        return
    touched = staged(new.groupBy("ticker").agg(F.min("month").alias("since")))
    since = sorted(r.since for r in touched.select("since").distinct().collect())
    fresh = store.write("bars", number, merged_states(store.read("bars", months, number).unionByName(new), "month"), months)

    start = _points(store, touched, since, number)
    asked = staged(touched.join(start, "ticker", "left").withColumn("reach", F.coalesce("back_month", "since")))
    reach = asked.agg(F.min("reach")).first()[0]
    before = [m for m in store.versions("bars", number) if m >= reach and m not in months]
    every = store.read("bars", before, number).unionByName(fresh).join(asked.select("ticker", "reach"), "ticker").where("month >= reach")
    parts = staged(chunks(bars_from(every, "month").select("ticker", "trade_date", "close", "volume", "month"), F.col("month")))
    row = parts.schema["rows"].dataType.elementType.simpleString()
    run = staged(states(summaries(parts), row, start=asked.where("from_chunk is not null").select("ticker", "from_chunk", "state")))

    back = F.coalesce(F.get("back", F.lit(0))["month"], F.col("chunk"))
    points = run.join(touched, "ticker").where("chunk >= since").select("ticker", "state", back.alias("back_month"), F.col("chunk").alias("month"))
    changed = sorted(r.chunk for r in run.join(touched, "ticker").where("chunk >= since").select("chunk").distinct().collect())
    store.write("points", number, merge(store.read("points", changed, number), points, ["ticker", "month"], [F.col("back_month")]), changed)

    last = run.groupBy("ticker").agg(F.max("chunk").alias("chunk"))
    rows = windowed(averaged(laid(parts.join(run.join(last, ["ticker", "chunk"]), ["ticker", "chunk"])))).where("own and place = many")
    snap = snapshot_rows(with_scores(rows)).select("ticker", F.lit(run_date).cast("date").alias("calc_date"), "technical_score", "rise_probability")
    snap = staged(snap.withColumn("bucket", F.lpad(F.pmod(F.xxhash64("ticker"), F.lit(SCORE_BUCKETS)).cast("string"), 2, "0")))
    buckets = sorted(r.bucket for r in snap.select("bucket").distinct().collect())
    store.write("scores", number, merge(store.read("scores", buckets, number), snap, SCORE_KEY, [F.col("technical_score")]), buckets)
    store.commit(number, {"bars": months, "points": changed, "scores": buckets})


def incremental_refresh(spark: SparkSession, ticks_path: str, folder: str | None = None, run_date: str = RUN_DATE, files: int = 4) -> DataFrame:
    """Streams the files of ticks_path, so many a batch, through to the end of what is there (see apply_ticks). Returns the scores.

    A batch reads what is committed below its number, so one that is tried again replaces itself. A later call with the
    same folder goes on after the last file; without new files it gives the same scores. The ticks of a day may lie in any files and
    batches: bars are merged by the sequence of their ticks, so the order of files does not matter and there is no watermark."""
    store = Store(spark, folder or shared_folder(spark), KINDS)

    def refresh(batch: DataFrame, number: int) -> None:
        apply_ticks(store, ticks_of(batch), number, run_date)

    there = spark.read.parquet(ticks_path)
    parent, _, name = ticks_path.rstrip("/").rpartition("/")
    inputs = there.inputFiles()
    reader = spark.readStream.schema(there.schema).option("maxFilesPerTrigger", files)
    if len(inputs) == 1 and inputs[0].endswith(f"/{name}"):  # a file source watches a folder: the file is picked in it by name
        stream = reader.option("pathGlobFilter", name).parquet(parent)
    else:
        stream = reader.parquet(ticks_path)
    job = stream.writeStream.foreachBatch(refresh).option("checkpointLocation", f"{store.folder}/progress").trigger(availableNow=True).start()
    job.awaitTermination()
    return store.read("scores").drop("bucket")
