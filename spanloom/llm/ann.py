"""Approximate nearest neighbours over shifted space-filling curves.

Each curve projects the vectors onto a few random orthogonal directions, shifts
them and orders them by their Hilbert key, range-partitioned.  Places in an order
make windows of like size; a query is scored against the windows around its own
place, and the best of all curves are merged.  Scores are exact inner products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, as_batch, table, written


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of integer points (n, d), each coordinate of ``bits`` bits; d * bits is 62 at most."""
    x = points.T.astype(np.int64).copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            on = (x[i] & q) > 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curves:
    """Axes, centres, scales and shifts of the curves for vectors of one length.

    Projections are centred and scaled by a bounded sample and squeezed into (0, 1);
    a length that the sample lacks takes a centre of 0 and a scale of 1.
    """

    def __init__(self, width: int, sample: np.ndarray, n: int, dims: int, bits: int, seed: int):
        rng = np.random.default_rng([seed, width])
        dims = min(dims, width)
        self.bits = bits
        self.axes = np.stack([np.linalg.qr(rng.normal(size=(width, width)))[0][:, :dims] for _ in range(n)])
        self.shift = rng.random((n, 1, dims)) / 4
        if len(sample):
            made = sample @ self.axes
            self.centre, spread = made.mean(axis=1, keepdims=True), made.std(axis=1, keepdims=True)
            self.scale = np.where(spread > 0, spread, 1.0)
        else:
            self.centre, self.scale = np.zeros((n, 1, dims)), np.ones((n, 1, dims))

    def keys(self, x: np.ndarray) -> np.ndarray:
        """Hilbert keys (curves, vectors)."""
        top = (1 << self.bits) - 1
        u = 1 / (1 + np.exp(np.clip(-1.7 * (x @ self.axes - self.centre) / self.scale, -50, 50)))
        at = np.clip((u + self.shift) / 1.25 * (top + 1), 0, top).astype(np.int64)
        return hilbert(at.reshape(-1, at.shape[2]), self.bits).reshape(at.shape[:2])


def _by_length(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of like length and their matrix, in double precision."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = col.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        on = np.flatnonzero(size == n)
        yield on, col.take(pa.array(on)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(on), n)


def _best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and exact scores of the ``k`` candidates nearest to each query, ties to the smaller id."""
    for lo in range(0, len(q), 256):
        s = q[lo : lo + 256] @ x.T
        edge = np.partition(s, -min(k, s.shape[1]), axis=1)[:, -min(k, s.shape[1])]
        for r in range(len(s)):
            on = np.flatnonzero(s[r] >= edge[r] - 1e-9 * (1 + abs(edge[r])))
            exact = (x[on] * q[lo + r]).sum(axis=1)
            top = np.lexsort((ids[on], -exact))[:k]
            yield on[top], exact[top]


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition with their place in its part of each curve."""
    from pyspark import TaskContext

    part, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        order = batch.column("width").to_numpy().astype(np.int64) << 16 | batch.column("curve").to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]])) if len(order) else np.zeros(0, np.int64)
        at = np.arange(len(order)) - np.repeat(edge, np.diff(np.append(edge, len(order))))
        if len(order):
            if order[0] == last:
                at[: edge[1] if len(edge) > 1 else len(at)] += n
            last, n = order[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("width"), batch.column("curve"), pa.array(np.full(len(at), part, np.int32)), pa.array(at)], ["cls", "width", "curve", "part", "at"])


def _score(k: int):
    """Scores a window's candidates, which come first, against the queries that meet it."""
    schema = "query long, cls array<long>, scores array<double>, ids array<array<long>>, met long"
    to = arrow_schema(schema)

    def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        ask = t["ask"].to_numpy()
        if not ask.any() or ask.all():
            return
        (_, v), cls = next(_by_length(t["v"])), t["cls"].to_numpy()
        x, names, ids = v[~ask], cls[~ask], t["ids"].filter(pa.array(~ask)).to_pylist()
        asked = cls[ask]
        for lo in range(0, len(asked), 1024):
            rows = list(_best(v[ask][lo : lo + 1024], x, names, k))
            yield as_batch({"query": asked[lo : lo + 1024], "cls": [names[p] for p, _ in rows], "scores": [s for _, s in rows], "ids": [[ids[i] for i in p] for p, _ in rows], "met": np.full(len(rows), len(names))}, to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            group = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("width", "curve", "window")], axis=1)
            edge = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(axis=1)])) if len(group) else []
            for a, b in zip(edge, [*edge[1:], len(group)], strict=True):
                if tuple(group[a]) != now and held:
                    yield from out(held)
                    held = []
                now = tuple(group[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from out(held)

    return run, schema


def _merge(k: int):
    """Merges a query's windows: its ``k`` nearest classes with their ids, and how many candidates it met, some of them more than once."""
    schema = "query long, found array<struct<vec_id:long,score:double>>, met long"
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for q, met, windows in zip(*(batch.column(c).to_pylist() for c in ("query", "met", "found")), strict=True):
                best = {c: (s, ids) for w in windows for c, s, ids in zip(w["cls"], w["scores"], w["ids"], strict=True)}
                top = sorted(best.items(), key=lambda x: (-x[1][0], x[0]))[:k]
                flat = sorted(((s, i) for _, (s, ids) in top for i in ids), key=lambda x: (-x[0], x[1]))[:k]
                rows.append((q, [{"vec_id": i, "score": s} for s, i in flat], met))
            if rows:
                yield as_batch(dict(zip(to.names, zip(*rows), strict=True)), to)

    return run, schema


def windows_met(vectors: DataFrame, is_query, k: int = 20, curves: int = 42, dims: int = 8, bits: int = 6, reach: float = 0.0335, power: float = 0.85, part_rows: int = 2048, sample: int = 5000, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(asked, found): query_id and class of each query; (query, found, met) of each class of queries; see ``nearest``."""
    spark = vectors.sparkSession
    element = vectors.schema["embedding"].dataType.elementType.typeName()
    v = F.col("embedding") if element in ("float", "double") else F.col("embedding").cast("array<double>")
    sound = F.expr("vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("ask")).where(sound).dropDuplicates(["vec_id"])
    #: Equal vectors are one class, named by its smallest id, so a copied vector is one row of each curve.
    rows = written(rows.select("*", F.xxhash64("v").alias("h1"), F.xxhash64(F.reverse("v"), F.size("v")).alias("h2")), "vectors")
    of = rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("cls"), F.max("ask").alias("ask"), F.any_value("v").alias("v"))
    first = rows.select("h1", "h2", "vec_id").withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    ids = first.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = written(of.join(ids, ["h1", "h2"]).select("h1", "h2", "cls", "ask", "v", "ids", F.size("v").alias("width")), "classes")
    #: One row for each length of vectors.
    count = {r.width: r["count"] for r in classes.groupBy("width").count().collect()}
    taken = classes.orderBy(F.xxhash64("cls"), "cls").limit(sample).select("v").toArrow()
    fitted = {x.shape[1]: x for _, x in _by_length(taken["v"])} if len(taken) else {}
    made = spark.sparkContext.broadcast({n: Curves(n, fitted.get(n, np.zeros((0, n))), curves, dims, bits, seed) for n in count})
    to = arrow_schema("cls long, width int, curve int, key long")

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls = batch.column("cls").to_numpy()
            for on, x in _by_length(batch.column("v")):
                for lo in range(0, len(on), 512):
                    keys, some = made.value[x.shape[1]].keys(x[lo : lo + 512]), cls[on[lo : lo + 512]]
                    yield as_batch({"cls": np.tile(some, len(keys)), "width": np.full(keys.size, x.shape[1]), "curve": np.repeat(np.arange(len(keys)), len(some)), "key": keys.ravel()}, to)

    keyed = classes.select("cls", "v").mapInArrow(order, "cls long, width int, curve int, key long")
    dealt = keyed.withColumn("tie", F.xxhash64("cls")).repartitionByRange("width", "curve", "key", "tie").sortWithinPartitions("width", "curve", "key", "tie", "cls")
    placed = written(dealt.mapInArrow(_number, "cls long, width int, curve int, part int, at long"), "curves")
    #: At most one row for each partition and curve.
    sizes = placed.groupBy("width", "curve", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("width", "curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("width", "curve", "part", F.coalesce(before, F.lit(0)).alias("start"))
    reaches = {n: max(1, round(reach * c**power)) for n, c in count.items()}
    windows = {n: -(-r // -(-r // part_rows)) for n, r in reaches.items()}
    by = lambda values: F.create_map(*[F.lit(x) for n in values for x in (n, values[n])])[F.col("width")] if values else F.lit(1)
    places = placed.join(starts, ["width", "curve", "part"]).groupBy("cls").agg(F.collect_list(F.struct("curve", (F.col("at") + F.col("start")).alias("place"))).alias("places"))
    full = classes.join(places, "cls").withColumns({"reach": by(reaches), "rows": by(windows)})
    own = full.select("width", "cls", "ids", "v", F.lit(False).alias("ask"), "rows", F.explode("places").alias("p")).select("width", "p.curve", F.expr("p.place div rows").alias("window"), "ask", "cls", "v", "ids")
    near = F.explode(F.sequence(F.expr("greatest(0, p.place - reach + rows div 2) div rows"), F.expr("(p.place + reach - rows div 2) div rows")))
    asks = full.where("ask").select("width", "cls", "v", "reach", "rows", F.explode("places").alias("p")).select("width", "p.curve", near.alias("window"), F.lit(True).alias("ask"), "cls", "v", F.lit(None).cast("array<long>").alias("ids"))
    run, schema = _score(k + 1)
    scored = own.unionByName(asks).repartition("width", "curve", "window").sortWithinPartitions("width", "curve", "window", "ask").mapInArrow(run, schema)
    run, schema = _merge(k + 1)
    merged = scored.groupBy("query").agg(F.sum("met").alias("met"), F.collect_list(F.struct("cls", "scores", "ids")).alias("found")).mapInArrow(run, schema)
    asked = rows.where("ask").join(classes.select("h1", "h2", "cls"), ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), F.col("cls").alias("query"))
    return asked, merged


def nearest(vectors: DataFrame, is_query, k: int = 20, **how) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each query.

    ``vectors`` has vec_id and embedding; rows for which ``is_query`` holds ask,
    and every other row answers.  Null and zero vectors, those with null or
    non-finite components and rows with a null vec_id take no part; of rows that
    repeat a vec_id one counts; vectors meet those of their own length.  Equal
    vectors are one row of each order and come back as all their ids.  Other
    columns don't matter, whatever their names; an empty table gives no rows.

    Of each of ``curves`` orders a query meets the ``reach`` * n ** ``power``
    rows (n: different vectors of its length) before and after its place, in
    windows of a bounded number of rows, at every size of table.  Curves are
    fitted to the ``sample`` vectors that come first by a hash of their id; all
    are ordered.
    """
    asked, found = windows_met(vectors, is_query, k, **how)
    best = asked.join(found, "query").select("query_id", F.slice(F.filter("found", lambda x: x.vec_id != F.col("query_id")), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every row of embeddings whose vec_id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
