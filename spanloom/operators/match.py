"""Predicted against expected spans, rows of one table told apart by ``side`` (0 expected, 1 and up predicted)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sweep
from .greedy import by_run

KEY = ["doc_id", "category", "start", "end"]


def rates(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1; 0 where a denominator is."""
    p = F.coalesce(tp / F.nullif(tp + fp, F.lit(0)), F.lit(0.0))
    r = F.coalesce(tp / F.nullif(tp + fn, F.lit(0)), F.lit(0.0))
    f = F.coalesce(2.0 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0))
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1")]


def _counted(spans: DataFrame, key: list[str], side: int = 1) -> DataFrame:
    """g and p: how often each key is expected and predicted."""
    return spans.where(F.col("side").isin(0, side)).groupBy(*key).agg(F.count_if(F.col("side") == 0).alias("g"), F.count_if(F.col("side") == side).alias("p"))


def exact(spans: DataFrame, side: int = 1) -> DataFrame:
    """Counts and rates by category for equal category and offsets; repeated spans match one for one."""
    c = _counted(spans, KEY, side).groupBy("category").agg(F.sum(F.least("g", "p")).alias("tp"), F.sum("p").alias("np"), F.sum("g").alias("ng"))
    c = c.select("category", "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("ng") - F.col("tp")).alias("fn"))
    return c.select("*", *rates(F.col("tp"), F.col("fp"), F.col("fn")))


def overlaps(spans: DataFrame) -> DataFrame:
    """Pairs of an expected and a predicted span of one document whose ranges meet."""

    def one(categories, g: sweep.Side, p: sweep.Side) -> dict:
        a, b = sweep.pairs(g, p)
        return {f"{n}_{c}": [str(categories[v]) for v in x[2][at]] if c == "category" else x[k][at].tolist() for n, x, at in (("gold", g, a), ("pred", p, b)) for k, c in ((2, "category"), (0, "start"), (1, "end"))}

    return sweep.by_run(by_run(spans, "g", "p"), ("g", "p"), one, "gold_category string, gold_start int, gold_end int, pred_category string, pred_start int, pred_end int")


def multiset(spans: DataFrame) -> DataFrame:
    """tp, fp and fn over (category, value) of each document, repeats counted."""
    n = _counted(spans, ["doc_id", "category", "value"])
    return n.agg(F.sum(F.least("g", "p")).alias("tp"), F.sum(F.greatest(F.col("p") - F.col("g"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("g") - F.col("p"), F.lit(0))).alias("fn"))


def sets(spans: DataFrame) -> DataFrame:
    """category (and (all)), tp, fp, fn over each document's set of (category, value), white space collapsed and case kept."""
    value = F.trim(F.regexp_replace("value", r"(?U)\s+", " "))
    own = spans.where("side in (0, 1)").groupBy("doc_id", "category", value.alias("v")).agg(F.max(F.col("side") == 0).alias("g"), F.max(F.col("side") == 1).alias("p"))
    c = own.rollup("category").agg(F.grouping("category").alias("every"), F.count_if(F.col("g") & F.col("p")).alias("tp"), F.count_if(~F.col("g") & F.col("p")).alias("fp"), F.count_if(F.col("g") & ~F.col("p")).alias("fn"))
    return c.select(F.when(F.col("every") == 1, "(all)").otherwise(F.col("category")).alias("category"), "tp", "fp", "fn")


def regressions(spans: DataFrame) -> DataFrame:
    """Expected spans that side 1 found and side 2 lost: doc_id, category, start, end, and the category of side 2's first span there or <NOTHING>."""

    def one(categories, g: sweep.Side, p: sweep.Side, q: sweep.Side) -> dict:
        at = np.flatnonzero(sweep.same_met(g, p) & ~sweep.same_met(g, q))
        there = sweep.first_met(g, q)[at]
        return {"category": [str(categories[c]) for c in g[2][at]], "start": g[0][at].tolist(), "end": g[1][at].tolist(), "instead": [str(categories[q[2][k]]) if k >= 0 else "<NOTHING>" for k in there]}

    return sweep.by_run(by_run(spans, "g", "p", "q"), ("g", "p", "q"), one, "category string, start int, end int, instead string")


def recalls(spans: DataFrame) -> DataFrame:
    """category, first, second, lost: expected spans that sides 1 and 2 found, and those found by side 1 alone."""

    def one(categories, g: sweep.Side, p: sweep.Side, q: sweep.Side) -> dict:
        return {"category": [str(categories[c]) for c in g[2]], "one": sweep.same_met(g, p).tolist(), "two": sweep.same_met(g, q).tolist()}

    rows = sweep.by_run(by_run(spans, "g", "p", "q"), ("g", "p", "q"), one, "category string, one boolean, two boolean")
    return rows.groupBy("category").agg(F.count_if("one").alias("first"), F.count_if("two").alias("second"), F.count_if(F.col("one") & ~F.col("two")).alias("lost"))
