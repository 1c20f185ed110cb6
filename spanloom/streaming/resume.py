"""Files of records as a stream that resumes where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def distinct_stream(spark: SparkSession, path: str, schema: str, key: list[str], to: str, checkpoint: str) -> StreamingQuery:
    """Append each key's first record of the Parquet files under ``path``, new files only at each run."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.dropDuplicates(key).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unseen(records: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Records whose key no finished one has."""
    return records.join(done.select(key).distinct(), key, "left_anti")
