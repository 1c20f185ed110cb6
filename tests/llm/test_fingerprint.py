import hashlib
import random

import numpy as np

from spanloom.llm.fingerprint import LEAST, MOST, WINDOW, _GEAR, chunks, containment, digests, fingerprints, from_string, gear


def test_gear_and_chunks():
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    h, want = gear(data), []
    for i in range(len(data)):
        want.append(sum(int(_GEAR[data[i - k]]) << k for k in range(min(WINDOW, i + 1))) & 0xFFFFFFFF)
    assert h.tolist() == want
    ends = chunks(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == 5000 and sizes.max() <= MOST and sizes[:-1].min() >= LEAST and 40 < sizes.mean() < 120
    a = data.tobytes()
    assert containment(digests(a), digests(b"some words before " + a)) > 0.9 and chunks(np.zeros(0, np.uint8)) == []


def test_rows_against_brute_force(spark):
    rng = random.Random(3)
    docs = [(i * i, "".join(rng.choice("abc é日\n") for _ in range(rng.choice([0, 1, 5, 400, 3000])))) for i in range(80)]
    docs += [(-5, None), (10**9, "end" * 5000), (10**9, "end" * 5000)]
    got = sorted(map(tuple, fingerprints(spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, slot int").repartition(3)).collect()))
    order = sorted([(i, t or "") for i, t in docs], reverse=True)
    want = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        own, other = digests(t.encode()), digests(e.encode())
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), own, other, containment(own, other), containment(own, digests(nxt.encode()))))
    assert [(*g[:3], from_string(g[3]), from_string(g[4]), *g[5:]) for g in got] == sorted(want, key=lambda x: x[:3])
    assert fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = fingerprints(spark.createDataFrame([(1, "alone")], "doc_id long, text string")).collect()
    assert one[0].n_chars == 5 and one[0].near_next == 1.0
