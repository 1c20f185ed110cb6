import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm.kernels import utf8
from spanloom.llm.lmscore import END, _packed, _unpacked, buckets, improved, levels, op13_lm_scores, parts, scores, tokens

DOCS = "doc_id long, text string"


def words(text):
    return [w.decode() for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()] + ["</s>"]


def brute(docs, deleted):
    """The model with dictionaries and a loop for each token; ``deleted`` are ids whose texts only teach the weights."""
    held = {i: i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}

    def counted(rows):
        one, two = Counter(), Counter()
        for _, t in rows:
            ws = words(t)
            one.update(ws)
            two.update(zip(["</s>", *ws], ws, strict=False))
        return one, two, sum(one.values()), len(one)

    def estimates(model, v, w):
        one, two, n, different = model
        even = 1 / (different + 1)
        word = one[w] / n if n else even
        return one[v].bit_length(), [two[v, w] / one[v] if one[v] else word, word, even]

    train = [r for r in docs if not held[r[0]]]
    kept = counted([r for r in train if r[0] not in deleted])
    seen = [estimates(kept, v, w) for i, t in train if i in deleted for v, w in zip(["</s>", *words(t)], words(t), strict=False)]
    weights = [[1 / 3] * 3 for _ in range(65)]
    for _ in range(20):
        sums = defaultdict(lambda: [0.0] * 3)
        for level, p in seen:
            total = sum(a * b for a, b in zip(weights[level], p, strict=True))
            for k in range(3):
                sums[level][k] += weights[level][k] * p[k] / total
        new = []
        for level in range(65):
            at = max((x for x in sums if x <= level), default=min(sums, default=None))
            own = sums[at] if at is not None else [0.0] * 3
            new.append([(x + 1) / (sum(own) + 3) for x in own])
        off = max(abs(a - b) for x, y in zip(weights, new, strict=True) for a, b in zip(x, y, strict=True))
        weights = new
        if off < 1e-4:
            break
    every = counted(train)
    out = []
    for i, t in docs:
        ws = words(t)
        base = sum(math.log10((every[0][w] + 1) / (every[2] + every[3] + 1)) for w in ws)
        score = 0.0
        for v, w in zip(["</s>", *ws], ws, strict=False):
            level, p = estimates(every, v, w)
            score += math.log10(sum(a * b for a, b in zip(weights[level], p, strict=True)))
        out.append((i, held[i], len(ws), sum(every[0][w] > 0 for w in ws), every[2], base, score))
    return sorted(out, key=str)


def same(got, want):
    got = sorted((tuple(r) for r in got), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-6, abs_tol=1e-9), (g, w)


def deleted_of(df):
    return {r[0] for r in df.where("doc_id is not null and pmod(xxhash64(doc_id), 10) = 0").select("doc_id").collect()}


def test_documents_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = [tuple(r) for r in df.collect()]
    same(scores(df, 1 << 16, 1 << 14).collect(), brute(docs, deleted_of(df)))


def test_odd_rows_against_brute_force(spark):
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(rng.choice(["a", "B", "c\x1fd", "É", "é", "Ab", "aB\x0bx"], size=int(rng.integers(0, 30))))) for i in range(-20, 100)]
    docs += [(100, None), (101, ""), (102, " \n\t"), (None, "a b"), (None, None), (7, docs[27][1]), (7, "other A B"), (103, "a b " * 100_000), (104, "x" * 200_000)]
    df = spark.createDataFrame(docs, DOCS)
    want = brute(docs, deleted_of(df))
    same(scores(df).collect(), want)
    more = [F.lit("x").alias(c) for c in ("kind", "batch", "body", "n", "bucket", "seen", "pair", "context", "one", "ids", "bytes")]
    same(scores(df.select("*", *more).repartition(5), 1000, 300).collect(), want)
    assert scores(df.limit(0)).collect() == []
    none = [(i, "a b") for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = scores(spark.createDataFrame(none, DOCS)).collect()
    same(got, brute(none, set()))
    assert all(r.base_score == 0 and r.train_tokens == r.n_known == 0 for r in got)


def test_probabilities_sum_to_one():
    """Over all words and the unknown one, after a word seen and one never seen."""
    ws = [w for i in range(200) for w in words(f"a b{i % 5} c d{i % 7}")]
    one, two = Counter(ws), Counter(zip([ws[-1], *ws], ws, strict=False))
    weights = improved(np.random.default_rng(3).integers(0, 50, (65, 3)).astype(float))
    for v in (*one, "never"):
        context = np.full(len(one) + 1, one[v])
        p = parts(np.array([two[v, w] for w in [*one, "unseen"]]), context, np.array([one[w] for w in [*one, "unseen"]]), len(ws), len(one))
        assert math.isclose((weights[levels(context)] * p).sum(), 1)


def test_held_out_beats_the_base(spark):
    rows = [r for r in op13_lm_scores(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows) and all(r.score < 0 for r in rows)


def test_parts_and_weights():
    for total, different in ((0, 0), (7, 3)):
        p = parts(np.array([2, 0]), np.array([4, 0]), np.array([3, 0]), total, different)
        assert (p[1, 0] == p[1, 1]) and (p[:, 2] == 1 / (different + 1)).all()
    w = improved(np.array([[0, 0, 0], [6, 1, 2]] + [[0, 0, 0]] * 63, float))
    assert np.allclose(w.sum(axis=1), 1) and np.allclose(w, [7 / 12, 2 / 12, 3 / 12])
    assert levels(np.array([0, 1, 2, 3, 4, 7, 8])).tolist() == [0, 1, 2, 2, 3, 3, 4]


def test_kernels():
    rng = np.random.default_rng(1)
    for a in ([], [0], [5, 300, 2**40 - 1], rng.integers(0, 1 << 63, 1000)):
        for x in _unpacked(_packed(np.array(a, np.uint64), np.zeros(3, np.uint64)))[:1]:
            assert x.tolist() == list(a)
    h, at = tokens(*utf8(pa.array(["A b", None, "a  B\n"])))
    assert at.tolist() == [0, 3, 4, 7] and (h[[2, 3, 6]] == END).all() and h[:2].tolist() == h[4:6].tolist()
    keys = np.sort(rng.integers(0, 1 << 64, 5000, dtype=np.uint64))
    got = buckets(keys, 37)
    assert (np.diff(got) >= 0).all() and got.min() >= 0 and got.max() == 36


@pytest.mark.parametrize("size", [1, 1 << 30])
def test_batches_do_not_matter(spark, size):
    df = spark.createDataFrame([(i, f"a b{i % 3} c{i % 11}") for i in range(80)], DOCS)
    same(scores(df, size, 100).collect(), brute([tuple(r) for r in df.collect()], deleted_of(df)))


def test_words_are_told_apart_by_their_bytes(spark):
    """Long words without periods, whose polynomial hashes of 64 bits are equal."""
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
    docs = [(i, f"{a} x" if i < 30 else f"{b} y" if i < 40 else f"{a}{i} {b}") for i in range(60)]
    got = scores(spark.createDataFrame(docs, DOCS), 1 << 15, 1 << 13).collect()
    want = brute(docs, deleted_of(spark.createDataFrame(docs, DOCS)))
    same(got, want)
    assert len({r.n_known for r in got if r.held_out}) > 1
