"""A stream that keeps as many records of each source as asked for, over any number of runs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def quota_stream(spark: SparkSession, path: str, schema: str, source: str, targets: dict[str, int], other: int, to: str, checkpoint: str, once: str | None = None, order: str | None = None, files: int = 1) -> StreamingQuery:
    """Append the records of the Parquet files under ``path`` until each source has its target (``other`` for those not named).

    State holds each source's count, so a run that stops anywhere goes on where it
    was; files count in the order in which they came, ``files`` of them at a time,
    and within them records by ``order``.  ``once``: of records alike in it, over
    all sources, the first alone counts.  A null source is one of its own.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    if once:
        rows = rows.dropDuplicates([once])
    limit = F.create_map(*[x for k, n in targets.items() for x in (F.lit(k), F.lit(n))])[F.col(source)] if targets else F.lit(None)
    out_schema = rows.schema

    def keep(key: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        have = state.get[0] if state.exists else 0
        most = key[1]
        if have < most:
            # Frames of one batch come in any order; only the rows that can still count are held.
            held = None
            for f in frames:
                held = f if held is None else pd.concat([held, f])
                held = (held.sort_values(order, kind="stable") if order else held).head(most - have)
            if held is not None and len(held):
                have += len(held)
                yield held[list(out_schema.names)]
        else:
            for _ in frames:
                pass
        state.update((have,))

    counted = rows.withColumn("limit_", F.coalesce(limit, F.lit(other)).cast("long")).groupBy(source, "limit_").applyInPandasWithState(keep, out_schema, "n long", "append", "NoTimeout")
    return counted.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(sink: DataFrame, source: str) -> DataFrame:
    """How many records of each source a sink holds."""
    return sink.groupBy(source).agg(F.count("*").alias("n"))
