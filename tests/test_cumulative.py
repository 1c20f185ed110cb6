import bisect
import random
from itertools import accumulate

from spanloom.operators.cumulative import drawn, running_sum


def test_against_loops(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice([0, 1, 5, 1000, None, -3])) for k in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, w int")
    order = sorted(rows)
    sums = list(accumulate(max(0, w or 0) for _, w in order))
    got = running_sum(df, "w", "id").orderBy("id").collect()
    assert [(r.id, r.w, r.upto) for r in got] == [(k, w, s) for (k, w), s in zip(order, sums, strict=True)] and all(r.before == r.upto - max(0, r.w or 0) for r in got)
    draws = [(k, rng.randrange(-5, sums[-1] + 5)) for k in range(2000)] + [(9001, None), (9002, 0), (9003, sums[-1] - 1), (9004, sums[-1])]
    want = [(k, u, None if u is None or not 0 <= u < sums[-1] else order[bisect.bisect_right(sums, u)][0]) for k, u in draws]
    out = drawn(running_sum(df, "w", "id"), "id", spark.createDataFrame(draws, "k long, u long"), "u")
    assert out.columns == ["k", "u", "id"] and sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nothing(spark):
    none = spark.createDataFrame([], "id long, w int")
    draws = spark.createDataFrame([(1, 0)], "k long, u long")
    assert running_sum(none, "w", "id").collect() == [] and [tuple(r) for r in drawn(running_sum(none, "w", "id"), "id", draws, "u").collect()] == [(1, 0, None)]
    flat = spark.createDataFrame([(1, 0), (2, 0)], "id long, w int")
    assert [tuple(r)[2] for r in drawn(running_sum(flat, "w", "id"), "id", draws, "u").collect()] == [None] and drawn(running_sum(flat, "w", "id"), "id", draws.limit(0), "u").collect() == []
