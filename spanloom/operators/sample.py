"""Draws that are the same on every cluster: from a seed and a key alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .curate import draw


def uniform(seed: int, *key: str) -> Column:
    """In [0, 1), from the first eight digits of a digest."""
    return F.conv(F.substring(draw(seed, *key), 1, 8), 16, 10).cast("double") / 4294967296.0


def weighted_choice(u: Column, weights: dict[str, float]) -> Column:
    """The choice in whose part of the weights' running sum ``u`` lies."""
    total, upto, out = sum(weights.values()), 0.0, F
    for name, weight in weights.items():
        upto += weight
        out = out.when(u * total < upto, name)
    return out.otherwise(list(weights)[-1])


def weighted_sample(df: DataFrame, weight: str, group: str, n: int, seed: int, key: str = "doc_id") -> DataFrame:
    """``n`` rows of each group without replacement, likelier by weight; rows without a positive weight never."""
    order = -F.ln(F.lit(1.0) - uniform(seed, key)) / F.col(weight)
    w = Window.partitionBy(group).orderBy("o", key)
    return df.where(F.col(weight) > 0).withColumn("o", order).withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("o", "r")


def empty_dropout(df: DataFrame, empty: Column, p: float, seed: int, key: str = "doc_id") -> DataFrame:
    """Without a share ``p`` of the rows for which ``empty`` is true."""
    return df.where(~F.coalesce(empty, F.lit(True)) | (uniform(seed, key) >= p))


def scaled_quotas(targets: dict[str, int], total: int) -> dict[str, int]:
    """``targets`` in proportion to ``total``, one at least; what rounding leaves goes, one each, to the largest first."""
    out = {k: max(1, round(n * total / (sum(targets.values()) or 1))) for k, n in targets.items()}
    off = total - sum(out.values())
    step = 1 if off > 0 else -1
    able = [k for k in sorted(out, key=out.get, reverse=True) if out[k] + step >= 1]
    for k in able[: abs(off)]:
        out[k] += step
    return out


def first_sentences(docs: DataFrame, sentences: Column, usable, most_docs: int | None, most: int, order: str = "doc_id") -> DataFrame:
    """doc_id, ix, sentence: usable ones of the first ``most_docs`` documents by ``order``, empty ones included, and of those the first ``most``.

    ``sentences`` is an array column and ``usable`` a function of one of them.
    Both limits are ranks that each task cuts for itself before it hands rows on.
    """
    some = docs.select("doc_id", order, "text") if order != "doc_id" else docs.select("doc_id", "text")
    if most_docs is not None:
        some = some.orderBy(order).limit(most_docs)
    own = some.select("doc_id", *([order] if order != "doc_id" else []), F.posexplode(F.coalesce(sentences, F.array().cast("array<string>"))).alias("ix", "sentence")).where(usable(F.col("sentence")))
    return own.orderBy(order, "ix").limit(most).select("doc_id", "ix", "sentence")
