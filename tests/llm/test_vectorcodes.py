import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm.vectorcodes import Tree, codes, cuts


def brute(rows, entries=16, rounds=6):
    """Every part against every entry, with Python's whole numbers."""
    kept = [(k, lab, [math.floor(4096 * x) for x in v]) for k, v, lab in rows if v and all(x is not None and math.isfinite(x) and abs(x) < 16384 for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    at = cuts(len(kept[0][2]))
    part = lambda v, p: v[at[p] : at[p + 1]]
    books = [[part(r[2], p) for r in kept[:entries]] for p in range(8)]

    def near(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(part(v, p), e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        fell = [[near(r[2], p)[1] for r in kept] for p in range(8)]
        for p in range(8):
            for k in range(len(books[p])):
                own = [part(r[2], p) for r, f in zip(kept, fell[p], strict=True) if f == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(r[0], r[1], [near(r[2], p) for p in range(8)]) for r in kept]
    errors = [(k, lab, "".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f)) for k, lab, f in found]
    return sorted(((k, c, e, sum(x[3] for x in errors if x[1] == lab), digest) for k, lab, c, e in errors), key=str)


def test_tree_against_all_entries():
    rng = np.random.default_rng(3)
    for trial in range(60):
        k, d, span = int(rng.integers(1, 20)), int(rng.integers(0, 5)), int(rng.choice([2, 5, 1 << 26]))
        entries, queries = rng.integers(-span, span, (k, d)), rng.integers(-span, span, (300, d))
        index, best = Tree(entries).nearest(queries)
        all_of = ((queries[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2) if d else np.zeros((300, k), object)
        assert (best == all_of.min(axis=1)).all() and (index == np.array([min(range(k), key=lambda e, r=r: (r[e], e)) for r in all_of])).all(), trial
    assert Tree(np.zeros((0, 3), int)).nearest(np.zeros((0, 3), int))[0].tolist() == []


def test_odd_rows_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [round(float(x), 2) for x in rng.normal(size=16)], int(i) % 3 if i % 5 else None) for i in range(200)]
    rows += [(7, rows[7][1], 1), (7, [0.5] * 16, None), (None, [0.25] * 16, 2), (-4, [1.0] * 16, None), (-4, [1.0] * 16, None)] + [(300 + i, [0.125] * 16, 9) for i in range(100)]
    rows += [(900, None, 1), (901, [], 1), (902, [1.0] * 8, 1), (903, [1.0, None] * 8, 1), (904, [float("nan")] * 16, 1), (905, [float("inf")] * 16, 1), (906, [-float("inf")] * 16, 1), (907, [20000.0] * 16, 1)]
    single = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for k, v, lab in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = lambda df: sorted((tuple(r) for r in codes(df).collect()), key=str)
    assert got(df) == brute(single) and len(brute(single)) == 305
    more = [F.lit("x").alias(c) for c in ("key", "v", "part", "entry", "code", "error", "of", "n", "sums", "at")]
    assert got(df.select("*", *more).repartition(5)) == brute(single)
    assert got(df.where("vec_id between 10 and 14")) == brute([r for r in single if r[0] in range(10, 15)])
    assert codes(df.limit(0)).collect() == []
    short = [(i, [float(i), 2.0 - i, 0.5], None) for i in range(40)]
    assert got(spark.createDataFrame(short, "vec_id long, embedding array<float>, label int")) == brute(short)
