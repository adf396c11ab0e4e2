"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder of this machine takes its place, but only if the executors
    are on this machine too; on a cluster that would lose data, so it's an error.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir")
    if not found:
        option = context._jsc.sc().getCheckpointDir()
        if not option.isDefined():
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="storelens-"))
            option = context._jsc.sc().getCheckpointDir()
        found = option.get()
    return found.rstrip("/")


def materialized(df: DataFrame, name: str, counted: bool = False) -> DataFrame:
    """``df`` written as Parquet and read again: its lineage is cut, and any executor may be lost.

    If ``counted``, the write keeps the number of rows as ``n_rows``, which saves a job.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    seen = Observation()
    (df.observe(seen, F.count(F.lit(1)).alias("n")) if counted else df).write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out.stored_at = path
    if counted:
        out.n_rows = int(seen.get["n"])
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more: all that was made of them is written itself."""
    for df in tables:
        if not hasattr(df, "stored_at"):
            continue
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
