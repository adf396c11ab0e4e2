"""Change records and introductions as streams.

Validation is stateless and the same as in batch; introductions are summed by month in windows of
event time, closed by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.operators.scoring import change_records


def records(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Validated records of the TSV files that arrive in ``folder``; a header line is left out wherever it stands."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)
    return change_records(lines.select(F.lit(1).alias("line_no"), F.col("value").alias("line"))).drop("line_no")


def introduced_by_window(events: DataFrame, window: str = "30 days", late: str = "7 days") -> DataFrame:
    """(begin, introduced_bytes, blobs) of a stream of (ts, blob, size); rows later than ``late`` are left out.

    A blob counts once within the watermark, whichever commit brought it.
    """
    first = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["blob"])
    per = first.groupBy(F.window("ts", window)).agg(F.sum("size").alias("introduced_bytes"), F.count("*").alias("blobs"))
    return per.select(F.col("window.start").alias("begin"), "introduced_bytes", "blobs")
