"""Spans of two sides that meet, by sweeps over runs: of the other side only spans that are still open are looked at.

A run's spans are arrays in the order of their start, end and category.  Going
through one side by start, a span of the other can be left behind for good once
every later one begins behind its end, so each step looks at a window that both
ends move forward in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Of one run and side: starts, ends and category numbers.
Side = tuple[np.ndarray, np.ndarray, np.ndarray]


def first_behind(x: Side, starts: np.ndarray) -> np.ndarray:
    """The first span of ``x`` that ends behind each of ``starts``."""
    return np.searchsorted(np.maximum.accumulate(x[1]), starts, "right") if len(x[1]) else np.zeros(len(starts), np.int64)


def windows(ours: Side, theirs: Side) -> tuple[np.ndarray, np.ndarray]:
    """Where the spans of ``theirs`` that may meet each of ``ours`` begin and stop."""
    return first_behind(theirs, ours[0]), np.searchsorted(theirs[0], ours[1], "left")


def overlap(ours: Side, theirs: Side, k: int, lo: int, hi: int) -> np.ndarray:
    return np.minimum(theirs[1][lo:hi], ours[1][k]) - np.maximum(theirs[0][lo:hi], ours[0][k])


def first_overlap(ours: Side, theirs: Side, k: int, lo: int, hi: int, free: np.ndarray) -> int:
    """The first free one that overlaps."""
    met = free[lo:hi] & (overlap(ours, theirs, k, lo, hi) > 0)
    return lo + int(met.argmax()) if met.any() else -1


def pred_first(ours: Side, theirs: Side, k: int, lo: int, hi: int, free: np.ndarray) -> int:
    """A prediction takes the first free expected span that it shares half of the shorter one with."""
    n = overlap(ours, theirs, k, lo, hi)
    met = free[lo:hi] & (n > 0) & (2 * n >= np.minimum(ours[1][k] - ours[0][k], theirs[1][lo:hi] - theirs[0][lo:hi]))
    return lo + int(met.argmax()) if met.any() else -1


def max_overlap(ours: Side, theirs: Side, k: int, lo: int, hi: int, free: np.ndarray) -> int:
    """An expected span takes the free prediction that overlaps most, the first of equals."""
    n = np.where(free[lo:hi], overlap(ours, theirs, k, lo, hi), 0)
    best = int(n.argmax()) if len(n) else 0
    return lo + best if len(n) and n[best] > 0 else -1


Pick = Callable[[Side, Side, int, int, int, np.ndarray], int]
#: Which side is gone through, whether one of its spans takes an equal one first, and how it picks among the other side's free ones.
RULES: dict[str, tuple[int, bool, Pick]] = {"gold_first": (0, True, first_overlap), "pred_first": (1, False, pred_first), "max_overlap": (0, False, max_overlap)}


def matched(ours: Side, theirs: Side, equal_first: bool, pick: Pick) -> np.ndarray:
    """Of each of ``ours`` the one of ``theirs`` that it takes, or -1."""
    out = np.full(len(ours[0]), -1, np.int64)
    lows, highs = windows(ours, theirs)
    free = np.ones(len(theirs[0]), bool)
    equal: dict[tuple, list[int]] = {}
    if equal_first:
        for j, key in reversed(list(enumerate(zip(*(x.tolist() for x in theirs), strict=True)))):
            equal.setdefault(key, []).append(j)
    head = 0
    for k, (lo, hi, key) in enumerate(zip(lows.tolist(), highs.tolist(), zip(*(x.tolist() for x in ours), strict=True), strict=True)):
        same = equal.get(key, [])
        while same and not free[same[-1]]:
            same.pop()
        while head < len(free) and not free[head]:
            head += 1
        j = same[-1] if same else pick(ours, theirs, k, max(lo, head), hi, free) if max(lo, head) < hi else -1
        if j >= 0:
            out[k], free[j] = j, False
    return out


def pairs(ours: Side, theirs: Side) -> tuple[np.ndarray, np.ndarray]:
    """All pairs that meet: places in both sides."""
    lows, highs = windows(ours, theirs)
    a, b = [], []
    for k, (lo, hi) in enumerate(zip(lows.tolist(), highs.tolist(), strict=True)):
        if lo < hi:
            met = lo + np.flatnonzero(overlap(ours, theirs, k, lo, hi) > 0)
            b.append(met)
            a.append(np.full(len(met), k))
    none = np.zeros(0, np.int64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def first_met(ours: Side, theirs: Side) -> np.ndarray:
    """Of each of ``ours`` the first of ``theirs`` that meets it, or -1; empty spans meet none."""
    real = np.flatnonzero(theirs[1] > theirs[0])
    own = tuple(x[real] for x in theirs)
    at = first_behind(own, ours[0])
    inside = np.minimum(at, max(0, len(real) - 1))
    there = (at < len(real)) & (own[0][inside] < ours[1]) & (ours[1] > ours[0]) if len(real) else np.zeros(len(ours[0]), bool)
    return np.where(there, real[inside] if len(real) else -1, -1)


def same_met(ours: Side, theirs: Side) -> np.ndarray:
    """Whether a span of ``theirs`` of the same category meets each of ``ours``."""
    out = np.zeros(len(ours[0]), bool)
    for c in np.unique(ours[2]):
        own, other = ours[2] == c, theirs[2] == c
        out[own] = first_met(tuple(x[own] for x in ours), tuple(x[other] for x in theirs)) >= 0
    return out


def kept_apart(x: Side) -> np.ndarray:
    """Spans that overlap no earlier one that stays; earlier by start, the longer of equals first, then by category."""
    order = np.lexsort((x[2], -x[1], x[0]))
    out, end = [], -1
    for k in order.tolist():
        if not out or x[0][k] >= end or x[1][k] <= x[0][k]:
            out.append(k)
            end = max(end, int(x[1][k]))
    return np.array(out, np.int64)


def by_run(listed: DataFrame, names: tuple[str, ...], one: Callable[..., dict], schema: str) -> DataFrame:
    """``one(categories, *sides)`` of each run: a dict of columns, without doc_id, which is added.

    ``listed``: doc_id and for each name an array of structs start, end, category
    in order.  ``categories`` names the numbers in the sides; they are in the
    order of the names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    to = to_arrow_schema(StructType.fromDDL(f"doc_id long, {schema}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [batch.column(n).flatten() for n in names]
            categories, code = np.unique(np.array(sum((f.field("category").to_pylist() for f in flat), []), object).astype(str), return_inverse=True)
            cuts = np.cumsum([0, *map(len, flat)])
            cols = [(np.asarray(f.field("start")).astype(np.int64), np.asarray(f.field("end")).astype(np.int64), code[a:b]) for f, a, b in zip(flat, cuts, cuts[1:], strict=False)]
            offs = [np.concatenate([[0], np.cumsum(np.nan_to_num(np.asarray(batch.column(n).value_lengths(), float)).astype(np.int64))]) for n in names]
            rows: list[dict] = []
            for k, i in enumerate(batch.column("doc_id").to_pylist()):
                got = one(categories, *[tuple(x[o[k] : o[k + 1]] for x in c) for c, o in zip(cols, offs, strict=True)])
                rows.append({"doc_id": [i] * len(next(iter(got.values()))), **got})
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([v for r in rows for v in r[f.name]], type=f.type) for f in to], schema=to)

    return listed.select("doc_id", *names).mapInArrow(run, f"doc_id long, {schema}")
