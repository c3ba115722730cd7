"""The stateless stages over a stream: records become extractions as files arrive; linkage runs per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recordloom.sources import records


def json_stream(spark: SparkSession, folder: str, id_col: str = "rec_id", payload: str = "payload", schema: str = "rec_id bigint, payload string") -> DataFrame:
    """Extractions of parquet files of JSON records as they arrive in a folder."""
    raw = spark.readStream.schema(schema).parquet(folder)
    return records.from_json_records(raw, id_col, payload)


def to_table(stream: DataFrame, folder: str, checkpoint_dir: str) -> StreamingQuery:
    """Append extractions; what is there is taken once and the query ends."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint_dir: str) -> StreamingQuery:
    """Run linkage and fusion (or anything else that is not stateless) on every batch."""
    return stream.withColumn("arrived", F.current_timestamp()).writeStream.foreachBatch(work).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
