"""Running sums of a whole table, and draws by them, without a task that holds it.

Rows are dealt by ranges of their order and written; the ranges' sums, one row
each, place every range behind those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import scratch


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """``df`` dealt by ranges of ``order``, written, with range_: the number of each row's range."""
    spark, at = df.sparkSession, scratch(df.sparkSession, "ranges")
    df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()).write.parquet(at)
    return spark.read.schema(df.withColumn("range_", F.lit(0)).schema).parquet(at)


def running_sum(df: DataFrame, weight: str, *order: str) -> DataFrame:
    """``df`` with before and upto: the sum of ``weight``, a whole number, over all rows before each row by ``order``, and with it.

    Null and negative weights count 0.  ``order`` must tell rows apart for the
    sums of equal ones to be the same in every run.
    """
    own = ranged(df.withColumn("weight_", F.greatest(F.coalesce(F.col(weight).cast("long"), F.lit(0)), F.lit(0))), *order)
    sums = own.groupBy("range_").agg(F.sum("weight_").alias("s"))
    #: As many rows as there are ranges.
    places = sums.select(F.col("range_").alias("of_"), F.coalesce(F.sum("s").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start_"))
    inner = F.sum("weight_").over(Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = own.withColumn("inner_", inner).join(places, F.col("range_") == F.col("of_"))
    upto = F.col("start_") + F.col("inner_")
    return joined.select(*df.columns, (upto - F.col("weight_")).alias("before"), upto.alias("upto"))


def drawn(rows: DataFrame, key: str, draws: DataFrame, u: str) -> DataFrame:
    """``draws`` with the ``key`` of the row of ``running_sum`` whose part of the sum holds ``u``, a whole number; null outside of all.

    Rows and draws are put in one order of places and dealt by its ranges; each
    draw takes the last row before it, from an earlier range if its own has none.
    """
    kind = rows.select(key).schema[0].dataType
    starts = rows.where("upto > before").select(F.col("before").alias("place_"), F.lit(0).alias("later_"), F.struct(F.col(key).alias("k"), F.col("upto").alias("upto")).alias("row_"), F.lit(None).cast(draws.select(F.struct("*")).schema[0].dataType).alias("draw_"))
    asked = draws.select(F.col(u).cast("long").alias("place_"), F.lit(1).alias("later_"), F.lit(None).cast(starts.schema["row_"].dataType).alias("row_"), F.struct("*").alias("draw_"))
    own = ranged(starts.unionByName(asked), "place_", "later_")
    in_range = Window.partitionBy("range_").orderBy("place_", "later_").rowsBetween(Window.unboundedPreceding, 0)
    last = own.groupBy("range_").agg(F.max(F.when(F.col("later_") == 0, F.struct("place_", "row_"))).alias("top"))
    #: As many rows as there are ranges.
    carried = last.select(F.col("range_").alias("of_"), F.last("top", ignorenulls=True).over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))["row_"].alias("carried_"))
    found = own.withColumn("found_", F.last("row_", ignorenulls=True).over(in_range)).where("later_ = 1").join(carried, F.col("range_") == F.col("of_"))
    row = F.coalesce("found_", "carried_")
    return found.select("draw_.*", F.when(F.col("place_") < row["upto"], row["k"]).cast(kind).alias(key))
