"""Greedy quota split: documents of a class fill proportional places, hard ones the hard test first, the rest is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .curate import check_ratios, draw


def quota_split(docs: DataFrame, group: str, hard: str, target: int, seed: int, shares: tuple[float, ...] = (0.7, 0.15, 0.1)) -> DataFrame:
    """doc_id, group, split: ``target`` places of each group.

    The hard test has what ``shares`` of train, validation and test leave; rows
    for which ``hard`` is true fill it first, in digest order, and those that
    don't fit join the others, who fill train, validation and test.
    """
    check_ratios({str(k): x for k, x in enumerate((*shares, 1 - sum(shares)))})
    cuts = [int(target * s) for s in shares]
    spare = target - sum(cuts)
    w = Window.partitionBy(group)
    first = docs.select("doc_id", group, F.coalesce(F.expr(hard), F.lit(False)).alias("hard"), draw(seed, "doc_id").alias("o"))
    edges = [sum(cuts[: k + 1]) for k in range(3)]
    # Limits on the ranks, so that each input task keeps only the rows of a group that can have a place.
    h = first.where("hard").withColumn("r", F.row_number().over(w.orderBy("o", "doc_id"))).where(F.col("r") <= spare + edges[2])
    rest = first.where("not hard").unionByName(h.where(F.col("r") > spare).drop("r"))
    rest = rest.withColumn("r", F.row_number().over(w.orderBy("o", "doc_id"))).where(F.col("r") <= edges[2])
    split = F.when(F.col("r") <= edges[0], "train").when(F.col("r") <= edges[1], "validation").otherwise("test")
    hard_test = h.where(F.col("r") <= spare).select("doc_id", group, F.lit("hard_test").alias("split"))
    return hard_test.unionByName(rest.select("doc_id", group, split.alias("split")))
