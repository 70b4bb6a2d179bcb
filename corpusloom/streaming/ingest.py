"""Incremental ingestion: a file-source stream into tables, with merges by key. The checkpoint makes it start where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.text import native_quality, needs_ocr
from corpusloom.sources import sinks


def page_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """JSON lines as they arrive, at most ``files`` files a batch, with quality columns."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)
    return rows.withColumn("quality", native_quality(F.coalesce("text", F.lit("")))).withColumn("needs_ocr", needs_ocr(F.coalesce("text", F.lit(""))))


def upsert(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: str) -> StreamingQuery:
    """Keep in ``path`` the last row of each key: every batch is merged and the table swapped; a batch that comes again changes nothing."""

    def merge(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        new = sinks.latest(batch, key, [order])
        both = new
        if sinks.recover(spark, path):  # also after a batch that ended between renames
            both = sinks.latest(spark.read.schema(batch.schema).parquet(path).unionByName(new), key, [order])
        done = sinks.written(both, "upsert")
        sinks.replace_table(done, path)
        sinks.discard(done)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append as JSON lines, exactly once."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
