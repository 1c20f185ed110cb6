import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import neardup
from spanloom.llm.common import components
from spanloom.llm.kernels import U64, mix, utf8
from spanloom.llm.neardup import bag_min_hash, near_duplicates


def bag(text, k=5):
    w = (text or "").split()
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])


def alike(a, b):
    both = sum((a & b).values())
    return both / max(1, sum((a | b).values()))


def brute(docs):
    bags = [bag(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if docs[i][0] == docs[j][0] or (docs[i][1] or "") == (docs[j][1] or "") or (bags[i] and alike(bags[i], bags[j]) >= 0.8):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, least[find(i)]) for i, (d, _) in enumerate(docs))


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    for hi in (2, 9, 200):
        w = rng.integers(0, hi, (2, 300))
        want = np.minimum(*w).sum() / np.maximum(*w).sum()
        items = mix(np.arange(300, dtype=U64))
        rows = np.repeat([0, 1], 300)
        got = bag_min_hash(rows[w.ravel() > 0], np.tile(items, 2)[w.ravel() > 0], w.ravel()[w.ravel() > 0], 2, 4096)
        assert np.isfinite(got).all()
        assert abs((got[0] == got[1]).mean() - want) < 0.035


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5, 5)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in {y for e in edges for y in e if e[0] != e[1]}}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(want) and {r.id: r.comp for r in got} == want


def test_classes_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    docs, n = [], 0
    for _ in range(40):
        base = [word() for _ in range(rng.choice([0, 2, 5, 30, 200]))]
        for _ in range(rng.choice([1, 1, 2, 8])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                if w:
                    w[rng.randrange(len(w))] = word()
            docs.append((n, " ".join(w)))
            n += 1
    docs += [(900, None), (901, ""), (902, " \n "), (903, "ab " * 4), (904, "ab " * 300), (905, "ab " * 290), (906, "one"), (907, "one")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs] + [(907, "one", "y")], "doc_id long, text string, h string").repartition(5)
    got = sorted(map(tuple, near_duplicates(df).collect()))
    assert got == sorted(brute(docs) + [(907, 906)])


def test_chain_in_a_bucket(spark):
    """A text that is near to others of its bucket but not to the bucket's smallest id."""
    rng = random.Random(1)
    w = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(12):
        docs.append((i, " ".join(w)))
        for j in range(3):
            w[i * 30 + 10 * j] = f"n{rng.random()}"
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    assert got == brute(docs)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark):
    from spanloom.llm.neardup import op8_near_duplicates

    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op8_near_duplicates(spark, "/root/testdata/sf0.001").collect())) == brute(docs)


def test_links_to_the_smallest_take_no_round(spark):
    edges = spark.createDataFrame([(i, i % 3) for i in range(3, 60)], "a long, b long")
    got = {r.id: r.comp for r in components(edges, rounds=1).collect()}
    assert got == {i: i % 3 for i in range(60)}


def test_a_large_bucket_of_classes_in_bounded_memory():
    """2,000 texts of as many classes, each like its neighbours alone: what is held grows with the texts, not with their pairs."""
    rng = random.Random(5)
    words, texts = [f"w{i}" for i in range(120)], []
    for i in range(2000):
        if i % 4 == 0:
            for j in range(0, 120, 6 if i % 200 else 1):
                words[j] = f"n{rng.random()}"
        texts.append(" ".join([*words, f"own{i}"]))
    batch = pa.RecordBatch.from_pydict({"key": [7] * 2000, "comp": list(range(5000, 7000)), "text": texts})
    tracemalloc.start()
    try:
        links = [x for b in neardup._decide(5, 0.8)[0](iter([batch])) for x in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    bags = [bag(t) for t in texts]
    now = list(range(2000))
    for i in range(2000):
        for j in range(max(0, i - 8), i):
            if alike(bags[i], bags[j]) >= 0.8:
                now[i] = now[j]
                break
    assert len(set(now)) > 9 and sorted(links) == [(5000 + i, 5000 + c) for i, c in enumerate(now) if c != i]
    assert most < 120e6


def test_bags_with_repeats_join_as_brute_force_does():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(150)]
    bags = [bag(t) for t in texts]
    root = list(range(150))
    for i in range(150):
        for j in range(i):
            if bags[i] and alike(bags[i], bags[j]) >= 0.5:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    got = neardup.join_classes([neardup.multisets(*neardup.shingles(*utf8(pa.array([t])), 5))[1:] for t in texts], np.arange(150), 0.5, cells=1000)
    assert got.tolist() == root
