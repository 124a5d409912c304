"""Token counts as delta-maintained rollups.

Changes of documents are signed: an insert adds a document and its tokens, a delete takes
them away, a revision adds the difference of the counts. A batch of changes is summed by
source, language and tokenizer version and written to a folder of its own; a new version of
the manifest, which lists the folder of each batch, then makes it visible. A batch that is committed
again gets another folder and its entry is replaced, so retries and replays count once,
and a crash at any point leaves the last manifest as it was. Totals are the sums of all
deltas; compacting folds committed batches into one, which knows what it is made of.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, by_frequent_keys, scratch, staged

KEY = ["source", "lang", "tokenizer"]
#: Tokenizer versions: the pattern whose matches are tokens.
TOKENIZERS = {"words-1": WORD, "pieces-1": r"[A-Za-z]+|[0-9]{1,3}|[^A-Za-z0-9\x20\x09-\x0D]"}


def count_tokens(docs: DataFrame, tokenizers: dict[str, str] = TOKENIZERS, text_col: str = "text") -> DataFrame:
    """docs with a column tokens: array of (tokenizer, tokens); a null text has 0."""
    each = [F.struct(F.lit(name).alias("tokenizer"), F.coalesce(F.regexp_count(text_col, F.lit(p)), F.lit(0)).cast("long").alias("tokens")) for name, p in tokenizers.items()]
    return docs.withColumn("tokens", F.array(*each))


def inserts(rows: DataFrame) -> DataFrame:
    """Changes of new documents: rows with KEY and tokens."""
    return rows.select(*KEY, F.lit(1).cast("long").alias("d_docs"), F.col("tokens").cast("long").alias("d_tokens"))


def deletes(rows: DataFrame) -> DataFrame:
    return rows.select(*KEY, F.lit(-1).cast("long").alias("d_docs"), (-F.col("tokens")).cast("long").alias("d_tokens"))


def revisions(rows: DataFrame) -> DataFrame:
    """Changes of counts: rows with KEY, old_tokens and tokens."""
    return rows.select(*KEY, F.lit(0).cast("long").alias("d_docs"), (F.col("tokens") - F.col("old_tokens")).cast("long").alias("d_tokens"))


class Rollup:
    """A table of deltas in a folder that all machines share."""

    SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
    #: One row for each batch: its folder, and the batches that it was compacted from.
    MANIFEST = "batch int, path string, made_of array<int>"

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or scratch(spark)

    def manifest(self) -> tuple[int, dict[int, tuple[str, list[int]]]]:
        """The last version, and of each batch its folder and what it was compacted from."""
        try:
            rows = self.spark.read.schema(self.MANIFEST + ", version int").parquet(f"{self.folder}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, {}
        last = rows.agg(F.max("version")).first()[0] or 0
        return last, {r.batch: (r.path, r.made_of) for r in rows.where(F.col("version") == last).collect()}

    def _publish(self, batch: int, sums: DataFrame, made_of: list[int]) -> None:
        """Writes the sums in a new folder, then a manifest of the next version with it. Of two
        writers of one version the second fails."""
        path = f"data/{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.folder}/{path}")
        version, known = self.manifest()
        known = known | {int(batch): (path, made_of)}
        rows = self.spark.createDataFrame([(b, p, m) for b, (p, m) in sorted(known.items())], self.MANIFEST)
        rows.coalesce(1).write.parquet(f"{self.folder}/manifest/version={version + 1}")

    def commit(self, batch: int, *changes: DataFrame) -> None:
        """Sums the changes and publishes them as this batch, in place of an earlier try.
        Partial sums are made before the shuffle; nulls are keys of their own; a batch
        without changes has no rows."""
        every = changes[0]
        for c in changes[1:]:
            every = every.unionByName(c)
        sums = every.groupBy(*KEY).agg(F.coalesce(F.sum("d_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("d_tokens"), F.lit(0)).alias("n_tokens"))
        self._publish(batch, sums, [])

    def deltas(self, batches: Iterable[int]) -> DataFrame:
        """The rows of the given batches, each batch once, also if a compacted one and what it
        was made of are both given."""
        _, known = self.manifest()
        wanted = set(batches)
        wanted -= {m for b in wanted for m in known[b][1]}
        return self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.folder}/{known[b][0]}" for b in sorted(wanted)])

    def totals(self, batches: Iterable[int]) -> DataFrame:
        """KEY, n_docs, n_tokens over the given batches, each once; keys whose documents are
        all gone stay with 0."""
        return self.deltas(batches).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def compact(self, batches: Iterable[int], into: int) -> list[int]:
        """Publishes the totals of some batches as a new batch; returns what replaces them.
        The old folders stay until their readers are done, so a crash loses nothing."""
        _, known = self.manifest()
        batches = set(batches)
        if into in batches:
            raise ValueError("compact into a batch of a new number")
        self._publish(into, self.totals(batches), sorted(batches | {m for b in batches for m in known[b][1]}))
        return [into]


def corpus_rollup(docs: DataFrame, tokenizers: dict[str, str] = TOKENIZERS, folder: str | None = None) -> DataFrame:
    """Token totals of a corpus of distinct texts, through four commits: all documents enter
    with the count estimated from n_chars (a quarter, null: 0); all counts are revised to
    the real ones; copies of a text but the one with the smallest id are deleted (null texts
    are no copies); the revision is committed again, which changes nothing."""
    spark = docs.sparkSession
    rows = count_tokens(docs.select("doc_id", "source", "lang", "n_chars", "text"), tokenizers)
    rows = rows.select("doc_id", "source", "lang", F.floor(F.coalesce("n_chars", F.lit(0)) / 4).cast("long").alias("guess"), "tokens", F.sha2("text", 256).alias("digest"))
    rows = staged(rows)
    first = staged(rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("kept"), F.count("*").alias("n")).where("n > 1"))
    copies = by_frequent_keys(rows, first, "digest", rows.count()).where("doc_id > kept")
    per = lambda r: r.select("source", "lang", F.col("guess").alias("old_tokens"), F.inline("tokens"))
    rollup = Rollup(spark, folder)
    rollup.commit(1, inserts(per(rows).drop("tokens").withColumnRenamed("old_tokens", "tokens")))
    rollup.commit(2, revisions(per(rows)))
    rollup.commit(3, deletes(per(copies)))
    rollup.commit(2, revisions(per(rows)))
    return rollup.totals(rollup.compact([1, 2, 3], 4))
