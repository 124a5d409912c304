"""Tables in a folder, in parts, with commits: a commit touches the parts it changes and no other file."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import merge


class Store:
    """Tables by kind, each in parts by a text column. A batch writes new versions of the parts that it
    changes, then one mark that names them all. Readers take the newest marked version of each part, so what
    is not marked is not there, and a batch that is tried again replaces itself. Parts are few (months,
    buckets): the driver holds their names."""

    def __init__(self, spark: SparkSession, folder: str, kinds: dict[str, tuple[str, str]]):
        """kinds: schema and part column of each."""
        self.spark, self.folder, self.kinds = spark, folder.rstrip("/"), kinds

    def _marks(self) -> DataFrame:
        schema = "kind string, part string, batch int"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/marks")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return self.spark.createDataFrame([], schema)

    def versions(self, kind: str, below: int | None = None) -> dict[str, int]:
        """The batch that holds the newest version of each part; of batches below a number only."""
        rows = self._marks().where(F.col("kind") == kind)
        rows = rows if below is None else rows.where(F.col("batch") < below)
        return {r.part: r.batch for r in rows.groupBy("part").agg(F.max("batch").alias("batch")).collect()}

    def next_batch(self) -> int:
        return (self._marks().agg(F.max("batch")).first()[0] or 0) + 1

    def _of(self, kind: str, batches: dict[str, int]) -> DataFrame:
        schema, part = self.kinds[kind]
        if not batches:
            return self.spark.createDataFrame([], f"{schema}, {part} string")
        paths = [f"{self.folder}/{kind}/batch={b}/{part}={p}" for p, b in sorted(batches.items())]
        return self.spark.read.schema(f"{schema}, batch int, {part} string").option("basePath", f"{self.folder}/{kind}").parquet(*paths).drop("batch")

    def read(self, kind: str, parts: list[str] | None = None, below: int | None = None) -> DataFrame:
        """Rows of the parts (all, if none are named): only their files are listed and read."""
        there = self.versions(kind, below)
        return self._of(kind, there if parts is None else {p: there[p] for p in parts if p in there})

    def write(self, kind: str, batch: int, rows: DataFrame, parts: list[str]) -> DataFrame:
        """A new version of the parts, which rows holds whole; not seen by readers before the commit. Returns what was written."""
        schema, part = self.kinds[kind]
        rows.hint("rebalance", part).write.mode("overwrite").partitionBy(part).parquet(f"{self.folder}/{kind}/batch={batch}")
        return self._of(kind, dict.fromkeys(parts, batch))

    def commit(self, batch: int, parts: dict[str, list[str]]) -> None:
        rows = [(kind, p) for kind, names in parts.items() for p in names]
        self.spark.createDataFrame(rows, "kind string, part string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/marks/batch={batch}")

    def upsert(self, kind: str, updates: DataFrame, keys: list[str], order: list[Column]) -> int:
        """Merges updates (with the part column, to which the keys must belong) into the parts they touch, as merge
        does, and commits. Returns the batch."""
        part = self.kinds[kind][1]
        batch, parts = self.next_batch(), sorted(r[0] for r in updates.select(part).distinct().collect())
        if parts:
            self.write(kind, batch, merge(self.read(kind, parts, batch), updates, keys, order), parts)
            self.commit(batch, {kind: parts})
        return batch

    def drop_old(self) -> int:
        """Deletes versions that a newer marked one of their part replaces. Not while others read or write. Returns their number."""
        jvm, gone = self.spark._jvm, 0
        for kind, (_, part) in self.kinds.items():
            newest = self.versions(kind)
            for r in self._marks().where(F.col("kind") == kind).distinct().collect():
                if r.batch < newest[r.part]:
                    path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}/batch={r.batch}/{part}={r.part}")
                    gone += path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return gone


def month_of(day: str = "trade_date") -> Column:
    return F.date_format(day, "yyyy-MM")
