"""Spans from label scores of tokens: the best label of each token, the best allowed sequence, and the best set of spans without overlap.

A window's scores are whole numbers in one list, token after token, in the order
of ``labels``.  Windows of a batch are decoded side by side: each step is an
array operation over all of them.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .greedy import runs



def labels(classes: tuple[str, ...]) -> list[str]:
    return ["O", *[f"{p}-{c}" for c in classes for p in "BI"]]


def argmax_labels(scores: np.ndarray) -> np.ndarray:
    """Windows x tokens: the label with the highest score, the first of equals."""
    return scores.argmax(axis=2)


def viterbi_labels(scores: np.ndarray) -> np.ndarray:
    """Windows x tokens: the labels with the highest sum in which I-x follows only B-x or I-x.

    ``scores``: windows x tokens x (O, B-, I- of each class).  Of equal ways to a
    label the one by the first previous label wins, at the end too.
    """
    scores = scores if scores.dtype.kind == "i" else scores.astype(np.int64)
    n, size, k = scores.shape
    back = np.zeros((n, size, k), np.int16)
    best = scores[:, 0].copy() if size else np.zeros((n, k), scores.dtype)
    inside = np.arange(2, k, 2)
    best[:, inside] = np.iinfo(scores.dtype).min // 4
    for t in range(1, size):
        prev = best.argmax(axis=1)
        top = np.take_along_axis(best, prev[:, None], 1)
        now = top + scores[:, t]
        back[:, t] = prev[:, None]
        again = best[:, inside] > best[:, inside - 1]
        now[:, inside] = np.where(again, best[:, inside], best[:, inside - 1]) + scores[:, t, inside]
        back[:, t, inside] = np.where(again, inside, inside - 1)
        best = now
    out = np.zeros((n, size), np.int64)
    if size:
        out[:, -1] = best.argmax(axis=1)
        for t in range(size - 1, 0, -1):
            out[:, t - 1] = np.take_along_axis(back[:, t], out[:, t][:, None], 1)[:, 0]
    return out


def spans_of(label: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window, first token, last token and class of every stretch of one class; an I- that nothing of its class precedes begins one."""
    n, size = label.shape
    own = (label + 1) // 2
    own = np.where(np.arange(size) < length[:, None], own, 0)
    before = np.concatenate([np.zeros((n, 1), np.int64), own[:, :-1]], axis=1) if size else own
    starts = (own > 0) & ((label % 2 == 1) | (own != before))
    ends = np.zeros_like(starts)
    if size:
        ends[:, :-1] = (own[:, :-1] > 0) & (starts[:, 1:] | (own[:, 1:] != own[:, :-1]))
        ends[:, -1] = own[:, -1] > 0
    w, a = np.nonzero(starts)
    _, b = np.nonzero(ends)
    return w, a, b, own[w, a] - 1


def _padded(values: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows x tokens x ``width`` (nought behind a window's end) and the windows' numbers of tokens."""
    sizes = np.diff(np.asarray(values.offsets)) // width
    flat = np.asarray(values.flatten()).reshape(-1, width)
    out = np.zeros((len(sizes), int(sizes.max(initial=0)), width), flat.dtype)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out, sizes


def _decode(batch: pa.RecordBatch, classes: tuple[str, ...], variants: tuple[str, ...]) -> Iterator[dict]:
    width = 2 * len(classes) + 1
    scores, length = _padded(batch.column("score"), width)
    starts, ends = (_padded(batch.column(c), 1)[0][:, :, 0] for c in ("start", "end"))
    ids = np.asarray(batch.column("doc_id"))
    there = np.arange(scores.shape[1]) < length[:, None]
    # Small scores add up in 32 bits; behind a window's end every label but O is out of reach.
    wide = np.int32 if scores.dtype.itemsize <= 2 and scores.shape[1] < 1 << 12 else np.int64
    scores = np.where(there[:, :, None], scores.astype(wide), np.iinfo(wide).min >> 16)
    scores[:, :, 0] = np.where(there, scores[:, :, 0], 0)

    def found(variant: str, w, a, b, c, gain) -> dict:
        return {"variant": [variant] * len(w), "doc_id": ids[w], "category": np.array(classes, object)[c], "start": starts[w, a], "end": ends[w, b], "gain": gain}

    if "argmax" in variants:
        w, a, b, c = spans_of(argmax_labels(scores), length)
        yield found("argmax", w, a, b, c, np.zeros(len(w), np.int64))
    if "viterbi" in variants:
        w, a, b, c = spans_of(viterbi_labels(scores), length)
        yield found("viterbi", w, a, b, c, np.zeros(len(w), np.int64))
    if "by_class" in variants:
        for k in range(len(classes)):
            # Where no token scores the class above O, all are O.
            some = np.flatnonzero((scores[:, :, 1 + 2 * k : 3 + 2 * k].max(axis=2) > scores[:, :, 0]).any(axis=1)) if scores.shape[1] else np.zeros(0, np.int64)
            own = scores[some][:, :, [0, 1 + 2 * k, 2 + 2 * k]]
            label = viterbi_labels(own)
            w, a, b, _ = spans_of(label, length[some])
            more = np.take_along_axis(own, label[:, :, None], 2)[:, :, 0] - own[:, :, 0]
            sums = np.concatenate([np.zeros((len(own), 1), np.int64), np.cumsum(np.where(there[some], more, 0), axis=1)], axis=1)
            yield found("by_class", some[w], a, b, np.full(len(w), k), sums[w, b + 1] - sums[w, a])


SPANS = "variant string, doc_id long, category string, start int, end int, gain long"


def decoded(
    scored: DataFrame,
    classes: tuple[str, ...],
    variants: tuple[str, ...] = ("argmax", "viterbi", "by_class"),
    at_once: int = 1 << 20,
    scorer: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None,
) -> DataFrame:
    """variant, doc_id, category, start, end, gain: spans of every window by each of ``variants``.

    ``scored``: rows of doc_id, start and end (lists of offsets, an entry for each
    token of the window) and score (2 x classes + 1 entries for each token).
    by_class decodes every class against O alone, so that its spans may overlap
    those of other classes; gain is what a span's labels score above O.  Windows
    without tokens give no spans; about ``at_once`` scores are decoded at a time.
    With ``scorer``, ``scored`` is what it makes such rows from: it gets a task's
    batches in the worker that decodes, so a task has one Python worker, not two.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    to = to_arrow_schema(StructType.fromDDL(SPANS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scorer(batches) if scorer else batches:
            step = max(1, at_once * batch.num_rows // max(1, len(batch.column("score").flatten())))
            for lo in range(0, batch.num_rows, step):
                for cols in _decode(batch.slice(lo, step), classes, variants):
                    yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in to], schema=to)

    return (scored if scorer else scored.select("doc_id", "start", "end", "score")).mapInArrow(run, SPANS)


def chosen(spans: list[tuple[int, int, int]]) -> list[int]:
    """Indices of the spans (start, end, gain), sorted by end, whose gains add up to most without overlap; a span that adds nothing is left out."""
    ends, best, take = [], [0], []
    for start, end, gain in spans:
        before = bisect_right(ends, start)
        take.append(best[before] + gain > best[-1])
        best.append(max(best[-1], best[before] + gain))
        ends.append(end)
    out, k = [], len(spans)
    while k:
        if take[k - 1]:
            out.append(k - 1)
            k = bisect_right(ends, spans[k - 1][0], 0, k - 1)
        else:
            k -= 1
    return out[::-1]


def best_disjoint(spans: DataFrame) -> DataFrame:
    """``spans`` (doc_id, category, start, end, gain) without overlaps, with the greatest sum of gains in each document.

    Only spans that meet compete, so each run of them is settled by itself, sorted
    by end, start and category.  Of equal sums the one without the later span wins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
            kept = [[s[k] for k in chosen([(x["start"], x["end"], x["gain"]) for x in s])] for s in batch.column("s").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, type=batch.column("s").type)], ["doc_id", "s"])

    one = "array<struct<end:int,start:int,category:string,gain:long>>"
    listed = runs(spans).groupBy("doc_id", "run").agg(F.sort_array(F.collect_list(F.struct("end", "start", "category", "gain"))).cast(one).alias("s"))
    alone, met = listed.where("size(s) = 1 and s[0].gain > 0").select("doc_id", "s"), listed.where("size(s) > 1").select("doc_id", "s")
    out = alone.unionByName(met.mapInArrow(run, f"doc_id long, s {one}"))
    return out.select("doc_id", F.inline("s")).select("doc_id", "category", "start", "end", "gain")
