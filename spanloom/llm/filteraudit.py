"""What each of five filters removes, keeps for others or shares with them, in all 120 orders of applying them.

A document's failures are five bits.  A table of 32 rows and 120 columns holds
the step at which a document with those bits first fails in each order, so one
lookup per document and one ``np.bincount`` give the removals of a whole batch
by part, label, order and step.  Tasks hand on small arrays, which are summed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, dropped, per_batch, table, written
from .kernels import pieces, utf8

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
_MARK = np.zeros(256, bool)
_MARK[list(b"#$%&*|")] = True


def first_failures() -> np.ndarray:
    """By failure bits (A is 1, E is 16) and order: the step, from 0, of the first filter that fails; 5 where none does."""
    out = np.full((32, len(ORDERS)), 5, np.int64)
    for bits in range(32):
        for k, order in enumerate(ORDERS):
            out[bits, k] = next((s for s, x in enumerate(order) if bits >> LETTERS.index(x) & 1), 5)
    return out


TABLE = first_failures()
#: Removals by label (2 bits: good, toxic), order and step (5: kept), then documents by failure bits.
_CELLS = 4 * len(ORDERS) * 6
SIZE = _CELLS + 32


def text_bits(texts: pa.Array) -> np.ndarray:
    """Failure bits A to D of each text; a null is empty."""
    data, offs = utf8(texts)
    out = np.zeros(len(offs) - 1, np.int64)
    for a, b in pieces(offs):
        own, at = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]

        def count(which: np.ndarray, at: np.ndarray = at) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(which, dtype=np.int64)])
            return sums[at[1:]] - sums[at[:-1]]

        points, capitals, marks = count((own & 0xC0) != 0x80), count((own >= 65) & (own <= 90)), count(_MARK[own])
        for k in range(b - a):
            ws = own[at[k] : at[k + 1]].tobytes().split()
            out[a + k] = (len(ws) < 100) + 2 * (100 * len(set(ws)) < 80 * len(ws))
        out[a:b] += 4 * (100 * capitals > 10 * points) + 8 * (marks > 0)
    return out


def _bits(batch: pa.RecordBatch) -> Iterator[dict]:
    yield {"doc_id": batch.column("doc_id"), "part": batch.column("part"), "digest": batch.column("digest"), "bits": text_bits(batch.column("text")).astype(np.int32)}


def _tallies(at_once: int):
    """Arrays of removals and failure bits for each part of a task, at most ``at_once`` parts held."""
    to = arrow_schema("part string, tally array<long>")

    def out(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        values = np.concatenate(list(held.values()))
        return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.ListArray.from_arrays(np.arange(len(held) + 1, dtype=np.int32) * SIZE, pa.array(values))], schema=to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column("part").dictionary_encode()
            for lo in range(0, batch.num_rows, 8192):
                part = np.asarray(names.indices[lo : lo + 8192])
                bits, label = (np.asarray(batch.column(c)[lo : lo + 8192]).astype(np.int64) for c in ("bits", "label"))
                seen, part = np.unique(part, return_inverse=True)
                for a in range(0, len(seen), at_once):
                    own = (part >= a) & (part < a + at_once)
                    n, row = min(at_once, len(seen) - a), part[own] - a
                    cell = (((row * 4 + label[own])[:, None] * len(ORDERS) + np.arange(len(ORDERS))) * 6 + TABLE[bits[own]]).ravel()
                    removed = np.bincount(cell, minlength=n * _CELLS).reshape(n, _CELLS)
                    failing = np.bincount(row * 32 + bits[own], minlength=n * 32).reshape(n, 32)
                    for k in range(n):
                        name, one = names.dictionary[int(seen[a + k])].as_py(), np.concatenate([removed[k], failing[k]])
                        held[name] = held[name] + one if name in held else one
                    if len(held) >= at_once:
                        yield out(held)
                        held = {}
        if held:
            yield out(held)

    return run


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def reported(part: str, tally: np.ndarray) -> dict:
    """The 600 rows of one part from its summed array."""
    by = tally[:_CELLS].reshape(4, len(ORDERS), 6)
    bits, removed = tally[_CELLS:], by.sum(axis=0)
    which = np.array([[LETTERS.index(x) for x in order] for order in ORDERS])
    fails = np.array([bits[[m for m in range(32) if m >> f & 1]].sum() for f in range(5)])
    shapley = np.zeros(5, np.int64)
    np.add.at(shapley, which.ravel(), removed[:, :5].ravel())
    flat = lambda x: x.ravel().astype(np.int64)
    return {
        "part": [part] * which.size, "filter_order": np.repeat(ORDERS, 5).tolist(), "step": np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS)),
        "kept": flat(bits.sum() - np.cumsum(removed[:, :5], axis=1)), "removed": flat(removed[:, :5]), "redundant": flat(fails[which] - removed[:, :5]), "unique_fails": flat(bits[1 << which]),
        "good_lost": flat(by[[1, 3]].sum(axis=0)[:, :5]), "toxic_lost": flat(by[[2, 3]].sum(axis=0)[:, :5]), "shapley": flat(shapley[which]),
    }


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", at_once: int = 64) -> DataFrame:
    """A row for each part, order of the five filters and step: what it removes, shares with earlier ones and alone rejects.

    Filters: A under 100 words; B under 80 distinct words in 100; C over 10
    capitals A-Z in 100 characters; D any of ``#$%&*|``; E the text of a smaller
    doc_id.  ``shapley`` is a filter's removals summed over all orders.

    A null text is empty and equals empty ones, a null part is the empty string.
    Rows that repeat count each; of rows with one doc_id and one text none is
    smaller; a row with a null doc_id has no smaller one and is none, and has no
    label.  A document is good (quality 1) or toxic if any of its labels says so.
    An empty table gives no rows; other columns are ignored.  Texts are read once;
    equal ones are found by SHA-256, and only rows of a few numbers are shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"), text.alias("text"))
    facts = written(per_batch(rows, _bits, "doc_id long, part string, digest binary, bits int"), "facts")
    firsts = written(facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "firsts")
    marks = written(labels.where("doc_id is not null").groupBy("doc_id").agg((F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).cast("int") + 2 * F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).cast("int")).alias("label")), "marks")
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    known = facts.join(firsts, "digest", "left").join(marks, "doc_id", "left").select("part", (F.col("bits") + 16 * again).alias("bits"), F.coalesce("label", F.lit(0)).alias("label"))
    tallies = known.mapInArrow(_tallies(at_once), "part string, tally array<long>")
    sums = written(tallies.select("part", F.posexplode("tally").alias("at", "n")).groupBy("part", "at").agg(F.sum("n").alias("n")), "tallies")
    dropped(facts, firsts, marks)
    whole = sums.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("tally"))
    return per_batch(whole, lambda b: (reported(name, np.asarray(tally.values)) for name, tally in zip(b.column("part").to_pylist(), b.column("tally"), strict=True)), REPORT)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents in every order, by language; ``audit`` says how odd rows count."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
