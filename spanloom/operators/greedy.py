"""Order-dependent span matching: three named rules, never merged.

Expected spans (side 0) and predicted ones (side 1) are rows of one table.  Only
spans that meet can match, so a document's spans fall into runs without a gap,
and each rule is a sweep over a run.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sweep


def sides(*spans: DataFrame) -> DataFrame:
    """Tables of spans as one: doc_id, side (the table's place), category, start, end, value."""
    out = None
    for k, df in enumerate(spans):
        one = df.select("doc_id", F.lit(k).alias("side"), "category", "start", "end", "value")
        out = one if out is None else out.unionByName(one)
    return out


def runs(spans: DataFrame, *within: str) -> DataFrame:
    """``spans`` with a number for each stretch of a document, and of the columns ``within``, that its spans, touching ones included, cover without a gap."""
    order = Window.partitionBy("doc_id", *within).orderBy("start", "end")
    new = F.coalesce(F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    return spans.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def by_run(spans: DataFrame, *names: str, within: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, run and for each side an array of structs start, end, category in order."""
    one = lambda k: F.sort_array(F.collect_list(F.when(F.col("side") == k, F.struct("start", "end", "category"))))
    return runs(spans, *within).groupBy("doc_id", *within, "run").agg(*[one(k).alias(n) for k, n in enumerate(names)])


_PAIR = "kind string, gold_category string, gold_start int, gold_end int, pred_category string, pred_start int, pred_end int"


def _parted(categories: np.ndarray, side: sweep.Side, at: np.ndarray, name: str) -> dict:
    """Columns of the spans at the places ``at``; -1 gives nulls."""
    some = at >= 0
    pick = lambda x: [int(v) if s else None for v, s in zip(x[np.maximum(at, 0)] if len(x) else np.zeros(len(at), int), some, strict=True)]
    codes = pick(side[2])
    return {f"{name}_category": [None if c is None else str(categories[c]) for c in codes], f"{name}_start": pick(side[0]), f"{name}_end": pick(side[1])}


def triage(spans: DataFrame, rule: str) -> DataFrame:
    """doc_id, kind (tp, boundary, confusion, missed, hallucinated), the expected and the predicted span's category, start and end."""
    side, *how = sweep.RULES[rule]

    def one(categories: np.ndarray, g: sweep.Side, p: sweep.Side) -> dict:
        ours, theirs = (g, p) if side == 0 else (p, g)
        took = sweep.matched(ours, theirs, *how)
        left = np.setdiff1d(np.arange(len(theirs[0])), took)
        a, b = np.concatenate([np.arange(len(took)), np.full(len(left), -1)]), np.concatenate([took, left])
        at = (a, b) if side == 0 else (b, a)
        out = _parted(categories, g, at[0], "gold") | _parted(categories, p, at[1], "pred")
        both = zip(out["gold_category"], out["gold_start"], out["gold_end"], out["pred_category"], out["pred_start"], out["pred_end"], strict=True)
        kind = ["missed" if pc is None else "hallucinated" if gc is None else "tp" if (gc, gs, ge) == (pc, ps, pe) else "boundary" if gc == pc else "confusion" for gc, gs, ge, pc, ps, pe in both]
        return {"kind": kind, **out}

    return sweep.by_run(by_run(spans, "g", "p"), ("g", "p"), one, _PAIR)


def discard_overlaps(spans: DataFrame, *within: str) -> DataFrame:
    """doc_id, category, start, end of the spans that overlap no earlier one that stays; earlier by start, the longer of equals first.

    Only spans that agree in the columns ``within`` compete.
    """

    def one(categories: np.ndarray, s: sweep.Side) -> dict:
        at = sweep.kept_apart(s)
        return {"category": [str(categories[c]) for c in s[2][at]], "start": s[0][at].tolist(), "end": s[1][at].tolist()}

    return sweep.by_run(by_run(spans.withColumn("side", F.lit(0)), "s", within=within), ("s",), one, "category string, start int, end int")


def detected_by(docs: DataFrame, detector: Callable[[list[str]], list[list[tuple[str, int, int]]]], at_once: int = 8) -> DataFrame:
    """doc_id, category, start, end, value from a detector outside of Spark, such as a model.

    ``detector`` gets up to ``at_once`` texts and returns each one's spans; it is
    called in the executors, batch after batch, and a null text counts as empty.
    """

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for lo in range(0, len(f), at_once):
                texts = [t or "" for t in f["text"].iloc[lo : lo + at_once]]
                for i, t, spans in zip(f["doc_id"].iloc[lo : lo + at_once], texts, detector(texts), strict=True):
                    rows.extend((i, c, a, b, t[a:b]) for c, a, b in spans)
            yield pd.DataFrame(rows, columns=["doc_id", "category", "start", "end", "value"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, category string, start int, end int, value string")


def answered_by(prompts: DataFrame, answer: Callable[[list[str]], list[str]], at_once: int = 10) -> DataFrame:
    """``prompts`` (key, prompt) with the content that a text generator outside of Spark gives for each, ``at_once`` at a time."""

    def run(frames):
        import pandas as pd

        for f in frames:
            out = [x for lo in range(0, len(f), at_once) for x in answer(list(f["prompt"].iloc[lo : lo + at_once]))]
            yield pd.DataFrame({"key": f["key"], "prompt": f["prompt"], "content": out})

    return prompts.select("key", "prompt").mapInPandas(run, "key long, prompt string, content string")
