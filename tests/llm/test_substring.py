import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from spanloom.llm.substring import FMIndex, WaveletMatrix, remove_repeats, repeated_windows

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(docs, k):
    split = [WORD.findall(t or "") for _, t in docs]
    count = Counter(tuple(w[i : i + k]) for w in split for i in range(len(w) - k + 1))
    out = []
    for (i, _), w in zip(docs, split, strict=True):
        gone = {j for s in range(len(w) - k + 1) if count[tuple(w[s : s + k])] > 1 for j in range(s, s + k)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def test_fm_index_counts():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 4, 500)
    text[[100, 300, 499]] = 0
    index = FMIndex(text, 6)
    starts = np.array([i for i in range(494) if (text[i : i + 6] > 0).all()])
    got = starts + 6 - index.reach(text, starts, starts + 6)
    s = text.tolist()
    for i, g in zip(starts, got, strict=True):
        m = 0
        while m < 6 and sum(s[j : j + m + 1] == s[i + 5 - m : i + 6] for j in range(500)) >= 2:
            m += 1
        assert m == g


def test_repeated_windows_of_a_segment():
    rng = np.random.default_rng(7)
    for top in (2, 4, 30):
        text = rng.integers(1, top + 1, 1500)
        for _ in range(6):
            i, j = rng.integers(0, 1400, 2)
            text[i : i + 50] = text[j : j + 50]
        text[[0, 600, 1499]] = 0
        begin = np.array([i for i in range(1, 1400, 13) if (text[i : i + 40] > 0).all()])
        n = rng.integers(1, 29, len(begin))
        n = np.array([k if (text[b : b + k + 11] > 0).all() else 1 for b, k in zip(begin, n, strict=True)])
        count = Counter(tuple(text[i : i + 12]) for i in range(1489))
        want = [sum(1 << i for i in range(k) if count[tuple(text[b + i : b + i + 12])] > 1) for b, k in zip(begin, n, strict=True)]
        assert FMIndex(text, 12).repeated(text, begin, n, 12).tolist() == want and any(want)


def test_wavelet_ranks():
    rng = np.random.default_rng(2)
    for top in (1, 2, 5, 60, 3000):
        text = np.minimum(rng.integers(0, top, 2000), rng.integers(0, top, 2000))
        tree = WaveletMatrix(text, np.bincount(text))
        symbols, ends = np.repeat(text[:50], 4), rng.integers(0, 2001, 200)
        got = tree.rank(symbols, ends) - tree.rank(symbols, np.zeros(200, np.int64))
        assert got.tolist() == [(text[:e] == x).sum() for x, e in zip(symbols, ends, strict=True)]
        p = np.bincount(text) / len(text)
        assert tree.length[text].mean() <= -(p[p > 0] * np.log2(p[p > 0])).sum() + 1


def test_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice(["", "é", "x", " ", "日"])
    shared = [[word() for _ in range(n)] for n in (34, 35, 36, 60, 90)]
    docs = []
    for i in range(150):
        w = [word() for _ in range(rng.choice([0, 3, 34, 35, 80, 200]))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            p = rng.randint(0, len(w))
            w[p:p] = rng.choice(shared)
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    docs += [(500, "a " * 36), (501, "b " * 35), (502, "ab " * 90), (503, None), (504, ""), (505, " \n"), (506, docs[7][1]), (507, " ".join(shared[4])), (7, "other text"), (507, " ".join(shared[4]))]
    docs += [(600 + i, " ".join(shared[3] + [f"end{i}"])) for i in range(40)]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, key int, hits string").repartition(4)
    got = sorted(map(tuple, remove_repeats(df).select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)
    assert got == brute(docs, 35)
    keyed = df.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    #: Anchors of many classes are split and shards are small: the windows found are the same.
    both = [sorted(map(tuple, repeated_windows(keyed, 35, **how).collect())) for how in ({}, {"most_classes": 2, "shard_words": 300})]
    assert both[0] and both[0] == both[1]


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark):
    from spanloom.llm.substring import op10_substring_dedup

    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in brute(docs, 35))
    assert sorted(map(tuple, op10_substring_dedup(spark, "/root/testdata/sf0.001").collect())) == want


def test_words_decide(spark, monkeypatch):
    """Where different segments have one digest the index sees that their words differ: nothing unique goes, whatever the digests say."""
    import pyarrow as pa

    from spanloom.llm import substring

    rng = random.Random(8)
    own = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(n))
    same = own(60)
    docs = [(1, same), (2, "x " + same), (3, own(80)), (4, own(80)), (5, own(35)), (6, own(35))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    plain = {r.doc_id: r.n_removed for r in remove_repeats(df).collect()}
    assert plain == {1: 60, 2: 60, 3: 0, 4: 0, 5: 0, 6: 0}
    before = substring._segments

    def forged(window, gram):
        one = before(window, gram)
        return lambda batch: ({**cols, "anchor": np.zeros(len(cols["anchor"]), np.int64), "digest": np.zeros(len(cols["digest"]), np.int64)} for cols in one(batch))

    monkeypatch.setattr(substring, "_segments", forged)
    got = {r.doc_id: r.n_removed for r in remove_repeats(df).collect()}
    assert all(got[k] <= plain[k] for k in plain) and not any(got[k] for k in (3, 4, 5, 6))

    # In a shard itself: two places of one class are found by their words, one place or different words aren't.
    run, _ = substring._search(3, 1000)
    rows = lambda *xs: pa.RecordBatch.from_pydict({"anchor": [x[0] for x in xs], "digest": [x[1] for x in xs], "place": pa.array([x[2] for x in xs], pa.int32()), "n_windows": pa.array([len(x[3]) - 2 for x in xs], pa.int32()), "words": pa.array([" ".join(map(str, x[3])).encode() for x in xs], pa.binary())})
    found = lambda *xs: [tuple(r.values()) for b in run([rows(*xs)]) for r in b.to_pylist()]
    assert found((1, 5, 0, [1, 2, 3, 4]), (1, 5, 1, [1, 2, 3, 4])) == [(1, 5, 3)]
    assert found((1, 5, 0, [1, 2, 3, 4])) == [] and found((1, 5, 0, [1, 2, 3, 4]), (1, 5, 1, [1, 2, 9, 4])) == []
    assert found((1, 5, 0, [1, 2, 3, 4]), (1, 6, 0, [7, 2, 3, 4])) == [(1, 5, 2), (1, 6, 2)]
