"""Tables that one job writes for its own later steps, in a folder that all machines share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset a local folder will do on
    one machine only; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@functools.cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


#: Whether the shuffle files of a job go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, **options: str) -> DataFrame:
    """Writes df in a new shared folder and reads it again, so that what follows neither
    computes it twice nor loses it with an executor. options: of the Parquet writer. The shuffles that made
    it leave the disk at once."""
    conf, path = df.sparkSession.conf, shared_folder(df.sparkSession)
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
