"""Ingest as a stream: scraped pages to new contents, once each.

The state of the de-duplication is unbounded by design: a content that was ever seen
must not come again.  Where an age bounds it, give ``within`` and an event time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.text import content_hash


def read_pages(spark: SparkSession, path: str, schema: str | StructType, files: int = 64) -> DataFrame:
    """A folder of Parquet files as a stream, or a single file."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def dedup_contents(pages: DataFrame, text: str = "text", event_time: str | None = None, within: str | None = None) -> DataFrame:
    """Pages with a content hash, the first of each hash only."""
    hashed = pages.withColumn("content_hash", content_hash(F.col(text)))
    if event_time and within:
        return hashed.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["content_hash"])
    return hashed.dropDuplicates(["content_hash"])


def append_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that keeps each batch in a folder of its own: a batch that is run again replaces itself, and the table is never read."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def run_ingest(pages: DataFrame, out: str, checkpoint: str, text: str = "text") -> StreamingQuery:
    return dedup_contents(pages, text).writeStream.foreachBatch(append_batch(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
