"""Product codes of integer vectors: each part's nearest codebook entry, found in a kd-tree.

Codebooks are small and broadcast as kd-trees in every round.  A search goes
down the nearer side first and visits a node whenever its box is not farther
than the best entry so far: at equal bounds too, since an entry of a lower index
may lie there.  Sums and counts are whole numbers, so the order in which tasks
add them up doesn't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, per_batch, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components beyond this have squared distances that a long can't hold.
LARGEST = 1 << 26


class Tree:
    """A kd-tree over the entries of one codebook."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        #: Box, entries of a leaf or None, and both sides with the axis and value that divide them.
        self.nodes: list[tuple] = []
        if len(entries):
            self._grow(np.arange(len(entries)))

    def _grow(self, own: np.ndarray) -> int:
        low, high = self.entries[own].min(axis=0), self.entries[own].max(axis=0)
        at = len(self.nodes)
        self.nodes.append((low, high, own, None))
        if len(own) > 1 and (high > low).any():
            axis = int((high - low).argmax())
            order = own[np.argsort(self.entries[own, axis], kind="stable")]
            half = len(order) // 2
            # Equal values stay on one side, so that the sides' boxes differ.
            values = self.entries[order, axis]
            cut = values[half] if values[half] > values[0] else values[np.searchsorted(values, values[0], "right")]
            left, right = (self._grow(np.sort(order[side])) for side in (values < cut, values >= cut))
            self.nodes[at] = (low, high, None, (axis, int(cut), left, right))
        return at

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry, the lowest of equals, and its squared distance."""
        queries = queries.astype(np.int64)
        index, best = np.full(len(queries), len(self.entries), np.int64), np.full(len(queries), np.iinfo(np.int64).max)
        if len(queries) and self.nodes:
            self._visit(0, queries, np.arange(len(queries)), index, best)
        return index, best

    def _visit(self, at: int, queries: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        low, high, leaf, split = self.nodes[at]
        q = queries[rows]
        off = np.maximum(np.maximum(low - q, q - high), 0)
        rows = rows[np.einsum("ij,ij->i", off, off) <= best[rows]]
        if not len(rows):
            return
        if leaf is not None:
            # A leaf's entries are equal: the lowest index stands for them.
            d = queries[rows] - self.entries[leaf[0]]
            d = np.einsum("ij,ij->i", d, d)
            closer = (d < best[rows]) | ((d == best[rows]) & (leaf[0] < index[rows]))
            best[rows[closer]], index[rows[closer]] = d[closer], leaf[0]
            return
        axis, cut, left, right = split
        near = queries[rows, axis] < cut
        for side, first, second in ((near, left, right), (~near, right, left)):
            if side.any():
                self._visit(first, queries, rows[side], index, best)
                self._visit(second, queries, rows[side], index, best)


def cuts(size: int, parts: int = PARTS) -> list[int]:
    return [size * k // parts for k in range(parts + 1)]


def _matrix(col: pa.Array) -> np.ndarray:
    """Rows of equally long lists."""
    flat = np.asarray(col.flatten())
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """(key, label, v): each component x of a sound vector as floor(scale * x)."""
    v, k, by = F.col(vector), F.col(key).alias("key"), F.col(label).alias("label")
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale))
    sound = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) >= LARGEST))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(k, by, F.transform(whole, lambda x: x.cast("int")).alias("v"))


def _sums(trees: list[Tree]):
    """Of each part position and entry of a batch: how many parts fell to it, and their componentwise sum."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        v = _matrix(batch.column("v"))
        if not len(v):
            return
        at, out = cuts(v.shape[1]), {"part": [], "entry": [], "n": [], "sums": []}
        for p, tree in enumerate(trees):
            own = v[:, at[p] : at[p + 1]].astype(np.int64)
            index, _ = tree.nearest(own)
            n = np.bincount(index, minlength=len(tree.entries))
            order = np.argsort(index, kind="stable")
            for e, rows in zip(np.flatnonzero(n), np.split(order, np.cumsum(n[n > 0])[:-1]), strict=True):
                out["part"].append(p)
                out["entry"].append(int(e))
                out["n"].append(int(n[e]))
                out["sums"].append(own[rows].sum(axis=0))
        yield out

    return run


def _next(ready: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks after one round: entries become the floor of their parts' mean, unused ones stay."""
    trees = ready.sparkSession.sparkContext.broadcast([Tree(b) for b in books])
    partial = per_batch(ready.select("v"), lambda b: _sums(trees.value)(b), "part int, entry int, n long, sums array<long>")
    # A row for each entry and component: as many as the codebooks have numbers.
    sums = partial.select("part", "entry", "n", F.posexplode("sums").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = [b.copy() for b in books]
    for r in sums.collect():
        out[r.part][r.entry, r.at] = r.s // r.n
    trees.unpersist()
    return out


def codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of every sound vector, by codebooks learned from all of them.

    Vectors that are null or empty, or hold null or non-finite components, or one
    of 2^26 / 4096 or more, are dropped; so are those of another length than the
    vector that comes first by key, null keys last, then by its components.  Its
    length is cut at multiples of an eighth, rounded down.  Rows that repeat count
    each, in the first codebook too; with fewer vectors than entries the codebooks
    are smaller.  Null labels are summed together.  An empty table gives no rows;
    other columns are ignored.
    """
    spark = vectors.sparkSession
    ready = written(quantised(vectors, key, vector, label), "quantised")
    order = [F.col("key").asc_nulls_last(), "v"]
    first = ready.orderBy(*order).select(F.size("v").alias("n")).first()
    size = first.n if first else PARTS
    ready = ready.where(F.size("v") == size)
    start = np.array([r.v for r in ready.orderBy(*order).limit(entries).select("v").collect()], np.int64).reshape(-1, size)
    at = cuts(size)
    books = [start[:, a:b] for a, b in zip(at, at[1:], strict=False)]
    for _ in range(rounds if len(start) else 0):
        books = _next(ready, books)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    trees = spark.sparkContext.broadcast([Tree(b) for b in books])
    kind = dict(ready.dtypes)
    schema = f"key {kind['key']}, label {kind['label']}, code string, error long"

    def assign(batch: pa.RecordBatch) -> Iterator[dict]:
        v = _matrix(batch.column("v"))
        if len(v):
            found = [t.nearest(v[:, a:b]) for t, a, b in zip(trees.value, at, at[1:], strict=False)]
            index = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
            yield {"key": batch.column("key"), "label": batch.column("label"), "code": [r.tobytes().hex() for r in index], "error": np.sum([d for _, d in found], axis=0)}

    coded = written(per_batch(ready, assign, schema), "codes")
    sums = written(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "errors")
    dropped(ready)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(F.col("key").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: 8 parts, 16 entries each, 6 rounds; ``codes`` says what is dropped and how ties fall."""
    return codes(table(spark, sf_dir, "embeddings"))
