"""Values by the prefixes of a table: an equality join on length and beginning instead of a chain of comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_prefix(values: DataFrame, value: str, prefixes: DataFrame) -> DataFrame:
    """``values`` with prefix: of the ``prefixes`` (prefix, rank) that the value begins with, the one of the lowest rank, else null.

    Only as many beginnings of a value are looked up as prefixes have lengths.
    Values are met by their different ones, each with all its prefixes' best rank,
    so a frequent value weighs no more than a rare one.  Null values and prefixes
    meet nothing; the empty prefix begins every value; of equal prefixes the first
    counts.
    """
    known = prefixes.where("prefix is not null").groupBy("prefix").agg(F.min("rank").alias("rank"))
    #: A short list: there are no more lengths than the longest prefix has characters.
    lengths = [r.n for r in known.select(F.length("prefix").alias("n")).distinct().collect()]
    different = values.where(F.col(value).isNotNull()).select(F.col(value).alias("v")).distinct()
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("v"))
    begun = different.select("v", F.explode(F.transform(cuts, lambda n: F.substring("v", F.lit(1), n))).alias("prefix"))
    best = begun.join(known, "prefix").groupBy("v").agg(F.min(F.struct("rank", "prefix")).alias("x")).select("v", F.col("x.prefix").alias("prefix"))
    return values.drop("prefix").join(best, F.col(value) == F.col("v"), "left").drop("v")


def counted_by_prefix(values: DataFrame, value: str, prefixes: DataFrame) -> DataFrame:
    """prefix, different, n: how many values, different and in all, begin with each prefix, null for those with none."""
    counted = values.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return with_prefix(counted, value, prefixes).groupBy("prefix").agg(F.count("*").alias("different"), F.sum("n").alias("n"))


def audit(rows: DataFrame, fields: dict[str, Column], prefixes: DataFrame) -> DataFrame:
    """field, missing, unknown of each of ``fields``: null or empty values, and those that no prefix (field, prefix) of the field begins."""
    listed = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.coalesce(c.cast("string"), F.lit("")).alias("value")) for k, c in fields.items()])).alias("x")).select("x.*")
    counted = listed.groupBy("field", "value").agg(F.count("*").alias("n"))
    mark = F.lit("\u0001")
    known = prefixes.select(F.concat("field", mark, "prefix").alias("prefix"), F.lit(0).alias("rank"))
    met = with_prefix(counted.withColumn("key", F.concat("field", mark, "value")), "key", known)
    return met.groupBy("field").agg(F.coalesce(F.sum(F.when(F.col("value") == "", F.col("n"))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.when((F.col("value") != "") & F.col("prefix").isNull(), F.col("n"))), F.lit(0)).alias("unknown"))
