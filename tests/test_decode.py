from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pytest

from spanloom.operators.decode import argmax_labels, best_disjoint, chosen, decoded, labels, spans_of, viterbi_labels
from spanloom.plans import decoders
from spanloom.plans.decoders import CLASSES, _scores, true_labels

NAMES = labels(("x", "y"))


def allowed(path):
    return all(k % 2 == 1 or k == 0 or before in (k, k - 1) for before, k in zip([0, *path], path, strict=False))


@pytest.mark.parametrize("size", [1, 2, 4])
def test_viterbi_against_all_labellings(size):
    rng = np.random.default_rng(size)
    scores = rng.integers(0, 6, (60, size, 5))
    got = viterbi_labels(scores)
    for s, path in zip(scores, got.tolist(), strict=True):
        total = lambda p, s=s: sum(s[t, k] for t, k in enumerate(p))
        best = max(total(p) for p in product(range(5), repeat=size) if allowed(p))
        assert allowed(path) and total(path) == best
    assert (argmax_labels(scores) == [[max(range(5), key=lambda k, t=t: (t[k], -k)) for t in s] for s in scores]).all()


def test_spans_of_labels():
    own = {n: k for k, n in enumerate(NAMES)}
    rows = ["O B-x I-x O", "I-x I-x B-x I-y", "B-x B-x I-x I-x", "B-y O O I-y", "O O O O"]
    label = np.array([[own[x] for x in r.split()] for r in rows])
    w, a, b, c = spans_of(label, np.array([4, 4, 3, 4, 4]))
    assert list(zip(w.tolist(), a.tolist(), b.tolist(), c.tolist(), strict=True)) == [(0, 1, 2, 0), (1, 0, 1, 0), (1, 2, 2, 0), (1, 3, 3, 1), (2, 0, 0, 0), (2, 1, 2, 0), (3, 0, 0, 1), (3, 3, 3, 1)]
    assert all(len(x) == 0 for x in spans_of(np.zeros((3, 0), np.int64), np.zeros(3, np.int64)))


def test_best_set_against_all_sets(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for i in range(40):
        own = {(int(a), int(a + n), int(g)) for a, n, g in zip(rng.integers(0, 12, 7), rng.integers(1, 6, 7), rng.integers(-1, 9, 7), strict=True)}
        rows += [(i, f"c{k}", *s) for k, s in enumerate(sorted(own))]
        disjoint = lambda x: all(p[1] <= q[0] or q[1] <= p[0] for p, q in combinations(x, 2))
        want[i] = max(sum(s[2] for s in x) for n in range(len(own) + 1) for x in combinations(own, n) if disjoint(x))
    got = best_disjoint(spark.createDataFrame(rows, "doc_id long, category string, start int, end int, gain long")).collect()
    for i in range(40):
        own = [(r.start, r.end, r.gain) for r in got if r.doc_id == i]
        assert sum(s[2] for s in own) == want[i] and all(p[1] <= q[0] or q[1] <= p[0] for p, q in combinations(own, 2)) and all(s[2] > 0 for s in own)
    assert chosen([(0, 1, 5), (0, 2, 5)]) == [0] and chosen([]) == []


def test_many_overlapping_spans():
    """Time grows with the logarithm of what went before."""
    spans = sorted(((k, k + 40, 1 + k % 7) for k in range(100_000)), key=lambda s: s[1])
    assert len(chosen(spans)) > 2000


def test_variants_of_one_table(spark):
    rng = np.random.default_rng(4)
    rows = [(i, list(range(0, 2 * n, 2)), list(range(1, 2 * n, 2)), rng.integers(-9, 9, 5 * n).tolist()) for i, n in enumerate([3, 1, 0, 4, 2] * 5)]
    df = spark.createDataFrame(rows, "doc_id long, start array<int>, end array<int>, score array<short>")
    for at_once in (1, 1 << 20):
        got = sorted(tuple(r) for r in decoded(df, ("x", "y"), at_once=at_once).collect())
        want = []
        for i, starts, ends, flat in rows:
            s = np.array(flat).reshape(1, -1, 5)
            n = np.array([s.shape[1]])
            for name, label in (("argmax", argmax_labels(s)), ("viterbi", viterbi_labels(s))):
                want += [(name, i, "xy"[c], starts[a], ends[b], 0) for _, a, b, c in zip(*spans_of(label, n), strict=True)]
            for k in range(2):
                own = s[:, :, [0, 1 + 2 * k, 2 + 2 * k]]
                label = viterbi_labels(own)
                want += [("by_class", i, "xy"[k], starts[a], ends[b], int(sum(own[0, t, label[0, t]] - own[0, t, 0] for t in range(a, b + 1)))) for _, a, b, _ in zip(*spans_of(label, n), strict=True)]
        assert got == sorted(want)
    assert decoded(df.limit(0), ("x", "y")).collect() == []


def test_true_labels():
    text = "to a.b@c.com, 1234567812345678 x"
    starts, ends = np.array([0, 3, 14, 31]), np.array([2, 13, 30, 32])
    assert [labels(CLASSES)[k] for k in true_labels(text, starts, ends)] == ["O", "B-email", "B-card", "O"]
    secret = 'token = "' + "0a" * 20 + '"'
    assert [labels(CLASSES)[k] for k in true_labels(secret, np.array([0, 6, 8]), np.array([5, 7, 50]))] == ["B-secret", "I-secret", "I-secret"]


def test_scoring_holds_a_bounded_share_of_a_batch():
    """Nor all words of a batch nor all its texts and scores at once."""
    import tracemalloc

    texts = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(8000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8000), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    try:
        sizes = [b.num_rows for b in _scores(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(sizes) == 8000 and max(sizes) <= 2000 and peak < 30e6


def test_one_worker_scores_and_decodes(spark):
    d = "/root/testdata/sf0.001"
    plan = decoders.found(spark, d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    texts = decoders.docs(spark, d).where("doc_id is not null").select("doc_id", "text")
    two = decoded(texts.mapInArrow(decoders._scores, "doc_id long, start array<int>, end array<int>, score array<short>"), decoders.CLASSES)
    got = decoders.found(spark, d)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, two.collect())) and got.count() > 100
