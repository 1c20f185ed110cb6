import random
import time

import numpy as np
import pytest

from spanloom.operators import greedy, match, sweep

SPAN = "doc_id long, side int, category string, start int, end int"


def side(rows):
    rows = sorted(rows)
    return tuple(np.array([r[k] for r in rows], np.int64) for k in range(3))


def over(a, b):
    return min(a[1], b[1]) - max(a[0], b[0])


def test_meetings_against_loops():
    rng = random.Random(6)
    for _ in range(200):
        g, p = ([(a := rng.randrange(30), a + rng.choice([0, 1, 2, 9, 25]), rng.randrange(2)) for _ in range(rng.randrange(9))] for _ in range(2))
        x, y = sorted(g), sorted(p)
        met = [[j for j, b in enumerate(y) if over(a, b) > 0] for a in x]
        a, b = sweep.pairs(side(g), side(p))
        assert list(zip(a.tolist(), b.tolist(), strict=True)) == [(k, j) for k, js in enumerate(met) for j in js]
        assert sweep.first_met(side(g), side(p)).tolist() == [js[0] if js else -1 for js in met]
        assert sweep.same_met(side(g), side(p)).tolist() == [any(y[j][2] == a[2] for j in js) for a, js in zip(x, met, strict=True)]
        kept = []
        for s in sorted(g, key=lambda s: (s[0], -s[1], s[2])):
            if not any(over(s, k) > 0 for k in kept):
                kept.append(s)
        order = sorted(g)
        assert sorted(order[k] for k in sweep.kept_apart(side(g))) == sorted(kept)


@pytest.mark.parametrize("rule", list(sweep.RULES))
def test_a_long_run(spark, rule):
    """50,000 spans that overlap, some of them all with each other, in one run."""
    n = 25_000
    df = spark.range(n).selectExpr("1L doc_id", "0 side", "concat('c', id % 3) category", "cast(id * 2 as int) start", "cast(id * 2 + 60 + id % 40 as int) end").unionAll(
        spark.range(n).selectExpr("1L doc_id", "1 side", "concat('c', id % 2) category", "cast(if(id % 5 = 0, 0, id * 2 + 1) as int) start", "cast(if(id % 5 = 0, 60000, id * 2 + 30) as int) end")
    )
    began = time.time()
    got = {r["kind"]: r["count"] for r in greedy.triage(df, rule).groupBy("kind").count().collect()}
    assert time.time() - began < 60
    hit = got.get("tp", 0) + got.get("boundary", 0) + got.get("confusion", 0)
    assert hit + got.get("missed", 0) == n and hit + got.get("hallucinated", 0) == n and hit > n / 2


def test_long_runs_of_other_operators(spark):
    df = spark.range(50_000).selectExpr("1L doc_id", "cast(id % 3 as int) side", "concat('c', id % 2) category", "cast(id as int) start", "cast(id + 20 as int) end")
    began = time.time()
    assert match.overlaps(df).count() > 100_000 and match.recalls(df).count() == 2 and match.regressions(df).count() >= 0
    assert greedy.discard_overlaps(df.drop("side")).count() == 2500 and time.time() - began < 90


def test_nothing(spark):
    df = spark.createDataFrame([], SPAN)
    assert greedy.triage(df, "gold_first").collect() == match.overlaps(df).collect() == match.regressions(df).collect() == match.recalls(df).collect() == []
    one = spark.createDataFrame([(1, 1, "x", 3, 3), (2, 0, "y", 1, 2)], SPAN)
    assert sorted((r.doc_id, r.kind) for r in greedy.triage(one, "max_overlap").collect()) == [(1, "hallucinated"), (2, "missed")]
