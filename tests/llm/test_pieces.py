import hashlib
import random
import time

import numpy as np
import pyarrow as pa

from spanloom.llm.kernels import utf8
from spanloom.llm.pieces import MARK, DoubleArray, Pieces, encode


def brute(m: Pieces, text: str) -> float:
    """The best sum of scores, by plain dynamic programming over characters."""
    t = (" " + text).replace(" ", MARK) if text else ""
    score = {m.names[k]: float(s) for k, s in zip(m.ids, m.scores, strict=True)}
    best = [0.0] + [-1e30] * len(t)
    for i in range(len(t)):
        for j in range(i + 1, min(len(t), i + 20) + 1):
            if t[i:j] in score:
                best[j] = max(best[j], best[i] + score[t[i:j]])
        if t[i] not in score:
            best[i + 1] = max(best[i + 1], best[i] + float(m.unknown_score))
    return best[-1]


def total(m: Pieces, ids: list[int], text: str) -> float:
    of = dict(zip(m.ids.tolist(), m.scores.tolist(), strict=True))
    out, k = 0.0, 0
    while k < len(ids):
        if ids[k] in of:
            out, k = out + of[ids[k]], k + 1
        else:
            b = next(x for x, y in m.byte_ids.items() if y == ids[k])
            out, k = out + float(m.unknown_score), k + (1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4)
    return out


def test_trie():
    rng = random.Random(1)
    keys = sorted({bytes(rng.choice(b"abc\xff\x00") for _ in range(rng.randint(1, 5))) for _ in range(400)})
    t = DoubleArray(keys)
    for k, key in enumerate(keys):
        s = 0
        for c in key:
            n = t.base[s] + c
            assert t.check[n] == s
            s = n
        assert t.value[s] == k


def test_best_scores_and_round_trip():
    m, rng = Pieces.load(), random.Random(2)
    texts = ["", " ", "a", "Hello world", "  two  spaces\n\nnew\tline ", "日本語 \U0001f600 x", "naïve café"] + ["".join(rng.choice(["th", "e ", "ing", "é", "\n", "  ", "日", "1", "#"]) for _ in range(60)) for _ in range(60)]
    d, o = utf8(pa.array(texts))
    ids, by = m.encode_batch(d, o, {})
    assert [x.decode() for x in m.decode_batch(ids, by)] == texts
    for k, t in enumerate(texts):
        assert abs(total(m, ids[by[k] : by[k + 1]].tolist(), t) - brute(m, t)) < 1e-6


def test_long_strings_without_spaces():
    """Cut at safe places or searched place by place: as good as the plain search, and fast."""
    m, rng = Pieces.load(), random.Random(5)
    texts = ["".join(rng.choice(["日本", "語", "ab", "ing", "aaaa", "é", "....", "12"]) for _ in range(120)) for _ in range(20)] + ["a" * 3000, "-" * 1500, "日" * 2000]
    d, o = utf8(pa.array(texts))
    ids, by = m.encode_batch(d, o, {})
    assert [x.decode() for x in m.decode_batch(ids, by)] == texts
    for k, t in enumerate(texts):
        assert abs(total(m, ids[by[k] : by[k + 1]].tolist(), t) - brute(m, t)) < 1e-6
    began = time.time()
    d, o = utf8(pa.array(["".join(rng.choice("日本語の文章") for _ in range(200000)), "ab" * 200000, "=" * 400000]))
    ids, by = m.encode_batch(d, o, {})
    assert b"".join(m.decode_batch(ids, by)) == d.tobytes() and time.time() - began < 60


def test_rows(spark):
    docs = [(1, None, 2), (2, "", 2), (3, "a b " * 20000, 2), (3, "a b " * 20000, 2), (4, "x" * 3000, 1), (None, "é", 1)]
    got = encode(spark.createDataFrame(docs, "doc_id long, text string, n_tokens int")).collect()
    assert len(got) == 6 and all(r.round_trip and len(r.ids) == r.n_tokens for r in got)
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in docs)
    assert encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert all(r.round_trip for r in encode(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), with_ids=False).collect())
