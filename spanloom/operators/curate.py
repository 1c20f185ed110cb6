"""Quality, duplicates, splits and validation of documents and their spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import normal, redact


def quality_reason(text: Column, low: int = 30, high: int = 5000) -> Column:
    """First reason against a text, in a fixed order, or ok."""
    return (
        F.when(F.trim(text) == "", "empty_text").when(F.length(text) < low, "too_short").when(F.length(text) > high, "too_long")
        .when(text.rlike("[%]{3}|[$]{3}|[#]{3}"), "artifact:marks").when(text.rlike("[<][a-zA-Z/]"), "artifact:tag").otherwise("ok")
    )


def first_of(docs: DataFrame, key: Column, order: str = "doc_id") -> DataFrame:
    """The row that comes first by ``order`` (an id, or ``seq`` of files read in order) of each key."""
    firsts = docs.select(order, key.alias("k")).groupBy("k").agg(F.min(order).alias(order))
    return docs.join(firsts.select(order), order, "left_semi")


def skeleton_rank(docs: DataFrame, most: int = 300) -> DataFrame:
    """Documents kept when each redacted template may occur ``most`` times, first ones first."""
    w = Window.partitionBy("skeleton").orderBy("doc_id")
    return docs.select("doc_id", F.md5(normal(redact(F.col("text")))).alias("skeleton")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def draw(seed: int, *key: str) -> Column:
    """A digest that orders rows alike on every cluster."""
    return F.md5(F.concat(F.lit(f"{seed}:"), *[F.col(k).cast("string") for k in key]))


def digest_rank(docs: DataFrame, group: str, seed: int, *carry: str) -> DataFrame:
    """doc_id, ``group``, rn, the row's place in its group in digest order, and the columns ``carry``.

    A group is ranked in 65,536 parts by the digest's beginning, each behind
    the count of those before it, so that no task holds a whole group.
    """
    d = docs.select("doc_id", group, *carry, draw(seed, "doc_id").alias("o")).withColumn("part", F.substring("o", 1, 4))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    n = d.groupBy(group, "part").agg(F.count("*").alias("n"))
    n = n.select(F.col(group).alias("of"), F.col("part").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(group, "part").orderBy("o", "doc_id"))
    return d.withColumn("own", own).join(n, (F.col("part") == F.col("at")) & F.col(group).eqNullSafe(F.col("of"))).select("doc_id", group, *carry, (F.col("own") + F.col("before")).alias("rn"))


def check_ratios(ratios: dict[str, float], off: float = 1e-6) -> None:
    """Ratios that are negative or don't add up to 1 are an error."""
    if min(ratios.values(), default=0) < 0 or abs(sum(ratios.values()) - 1) > off:
        raise ValueError(f"ratios, none of them negative, add up to {sum(ratios.values())}, not to 1: {ratios}")


def stratified_split(docs: DataFrame, stratum: str, ratios: dict[str, float], seed: int) -> DataFrame:
    """Largest-remainder quotas of each stratum, filled in digest order; ties go to the earlier bucket."""
    check_ratios(ratios)
    names = list(ratios)
    n = docs.groupBy(stratum).agg(F.count("*").alias("n"))
    quota = n.select(stratum, "n", F.posexplode(F.array(*[F.struct(F.lit(k).alias("split"), F.lit(r).cast("double").alias("ratio")) for k, r in ratios.items()])).alias("ix", "b"))
    quota = quota.select(stratum, "n", "ix", "b.split", F.floor(F.col("n") * F.col("b.ratio")).alias("q"), (F.col("n") * F.col("b.ratio") - F.floor(F.col("n") * F.col("b.ratio"))).alias("rest"))
    by = Window.partitionBy(stratum)
    quota = quota.withColumn("left", F.col("n") - F.sum("q").over(by)).withColumn("r", F.row_number().over(by.orderBy(F.desc("rest"), "ix"))).withColumn("q", F.col("q") + (F.col("r") <= F.col("left")).cast("int"))
    quota = quota.withColumn("upto", F.sum("q").over(by.orderBy("ix")))
    cuts = quota.groupBy(stratum).agg(F.sort_array(F.collect_list(F.struct("ix", "upto"))).alias("cuts"))
    cuts = cuts.withColumnRenamed(stratum, "of")
    ranked = digest_rank(docs, stratum, seed).join(cuts, F.col(stratum).eqNullSafe(F.col("of")))
    split = F.element_at(F.array(*[F.lit(k) for k in names]), F.element_at(F.filter("cuts", lambda c: F.col("rn") <= c["upto"]), 1)["ix"] + 1)
    return ranked.select("doc_id", stratum, split.alias("split"))


def ratio_split(docs: DataFrame, train: float, validation: float, seed: int, *carry: str) -> DataFrame:
    """doc_id, split and the columns ``carry``: int(n * train) rows and int(n * validation) rows in digest order, the rest test."""
    check_ratios({"train": train, "validation": validation, "test": 1 - train - validation})
    n = docs.count()
    first = int(n * train)
    second = first + int(n * validation)
    ranked = digest_rank(docs.select("doc_id", F.lit(0).alias("every"), *carry), "every", seed, *carry)
    return ranked.select("doc_id", *carry, F.when(F.col("rn") <= first, "train").when(F.col("rn") <= second, "validation").otherwise("test").alias("split"))


def dedup_splits(rows: DataFrame, splits: tuple[str, ...], order: str = "doc_id") -> DataFrame:
    """The first row of each text, by split in the order of ``splits``, base before add, then ``order``.

    ``rows`` has text, split and origin (base or add); those of other splits go.
    """
    at = F.array_position(F.array(*[F.lit(s) for s in splits]), F.col("split"))
    known = rows.withColumn("h", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)).withColumn("place", F.struct(at.alias("at"), (F.col("origin") != "base").alias("later"), F.col(order).alias("o"))).where(at > 0)
    first = known.groupBy("h").agg(F.min("place").alias("place"))
    return known.join(first, ["h", "place"], "left_semi").drop("h", "place")


def text_digest(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def leaks(rows: DataFrame) -> DataFrame:
    """leaked: for each text digest h, in how many splits besides its first it stands."""
    return rows.groupBy("h").agg(F.countDistinct("split").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("leaked"))


def curation_report(docs: DataFrame, spans: DataFrame, splits: DataFrame) -> DataFrame:
    """stage, name, n: reasons of rejection, what duplicates took away, and documents and spans of each split."""
    row = lambda df, stage, name: df.select(F.lit(stage).alias("stage"), name.alias("name"), "n")
    why = docs.select("doc_id", quality_reason(F.col("text")).alias("reason"), F.md5(normal(F.col("text"))).alias("h"))
    one = row(why.groupBy("reason").agg(F.count("*").alias("n")), "quality", F.col("reason"))
    left = why.where("reason = 'ok'").agg(F.countDistinct("h").alias("kept"), F.count("*").alias("all"))
    two = left.select(F.inline(F.array(F.struct(F.lit("dedup").alias("stage"), F.lit("kept").alias("name"), F.col("kept").alias("n")), F.struct(F.lit("dedup").alias("stage"), F.lit("removed").alias("name"), (F.col("all") - F.col("kept")).alias("n")))))
    three = row(splits.groupBy("split").agg(F.count("*").alias("n")), "split", F.col("split"))
    four = row(spans.join(splits, "doc_id").groupBy("split", "category").agg(F.count("*").alias("n")), "spans", F.concat("split", F.lit("/"), "category"))
    return one.unionByName(two).unionByName(three).unionByName(four)


def span_violations(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans whose offsets don't lie in their text or whose value differs from it, with the rule broken."""
    j = spans.join(docs.select("doc_id", "text"), "doc_id")
    rule = F.when((F.col("start") < 0) | (F.col("start") >= F.col("end")), "offset_order").when(F.col("end") > F.length("text"), "offset_range").when(F.expr("substring(text, start + 1, end - start)") != F.col("value"), "value")
    return j.withColumn("rule", rule).where("rule is not null").select("doc_id", "category", "start", "end", "rule")
