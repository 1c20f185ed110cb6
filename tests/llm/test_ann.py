import itertools

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm.ann import hilbert, nearest, op9_nearest, windows_met


def test_hilbert_steps_to_neighbours():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        p = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        key = hilbert(p, bits)
        assert sorted(key) == list(range(len(p)))
        assert (np.abs(np.diff(p[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def brute(ids, x, k=20):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % 20 == 0:
            s = (x * q).sum(axis=1)
            s[ids == i] = -np.inf
            top = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
            out[int(i)] = list(zip(ids[top].tolist(), s[top].tolist(), strict=True))
    return out


def test_recall_against_brute_force(spark):
    """The query's own parameters; fewer rows are met, with all that are met more than once, than brute force meets."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float32).astype(float)
    want = brute(ids, x)
    got = op9_nearest(spark, "/root/testdata/sf0.1").collect()
    score = {(i, v): s for i, w in want.items() for v, s in w}
    hit = sum((r.query_id, r.vec_id) in score for r in got)
    assert hit >= 0.9 * len(score) and all(abs(score[r.query_id, r.vec_id] - r.score) < 1e-12 for r in got if (r.query_id, r.vec_id) in score)
    met = windows_met(table, F.col("vec_id") % 20 == 0)[1].agg(F.sum("met")).first()[0]
    print("recall", hit / len(score), "met", met / (len(want) * len(rows)))
    assert met < 0.9 * len(want) * len(rows)


def test_windows_of_several_parts(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, 6)), 2)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(1000 + i, x[7].tolist()) for i in range(60)], "vec_id long, embedding array<double>")
    ids = np.array([r.vec_id for r in df.collect()])
    every = np.array([r.embedding for r in df.collect()])
    want = {(q, n + 1): (v, s) for q, w in brute(ids, every).items() for n, (v, s) in enumerate(w)}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in nearest(df, F.col("vec_id") % 20 == 0, reach=1.0, power=1.0, part_rows=50, curves=2).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.5], 1), (20, [0.5, 1.0], 2), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [None, 1.0], 1), (7, [float("inf"), 1.0], 1), (8, [1.0], 1), (1, [1.0, 0.5], 1), (None, [1.0, 1.0], 1), (9, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = sorted(map(tuple, nearest(df, F.col("vec_id") % 20 == 0).collect()))
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.5), (20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 0, 0.5)]
    both = df.select("*", *[F.lit(1).alias(n) for n in ("v", "cls", "ask", "ids", "width", "h1", "query", "found", "place", "window", "r")])
    assert sorted(map(tuple, nearest(both, F.col("vec_id") % 20 == 0).collect())) == got
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
