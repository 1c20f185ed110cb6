import math

import numpy as np

from spanloom.llm.langid import DIM, Coder, codewords, learn, minimise, op6_language_id, predict, vectors


def test_codewords():
    for k in (2, 4, 6, 9, 30):
        c = codewords(k)
        d = (c[:, None] != c[None]).sum(axis=2)
        assert c.shape[0] == k and d[~np.eye(k, dtype=bool)].min() >= (1 if k == 2 else 2)


def test_decoding_rule():
    """The nearest codeword by summed logistic loss, worked out bit by bit."""
    rng = np.random.default_rng(4)
    for k in (3, 9):
        codes = codewords(k)
        coder = Coder([f"l{i}" for i in range(k)], codes, rng.normal(size=(DIM + 1, codes.shape[1])).astype(np.float32) * 5)
        texts = ["the cat", "der Hund und die Katze", "日本語 text", "x"]
        lang, score, odd = coder.predict(texts)
        x = vectors(texts)[0].astype(float)
        for t in range(len(texts)):
            loss = []
            for i in range(k):
                margins = [sum(x[t, j] * coder.weights[j, b] for j in np.flatnonzero(x[t])) + coder.weights[DIM, b] for b in range(codes.shape[1])]
                loss.append(sum(math.log1p(math.exp(-codes[i, b] * m)) for b, m in enumerate(margins)))
            p = np.exp(-np.array(loss))
            p /= p.sum()
            assert lang[t] == f"l{int(np.argmax(p))}" and abs(score[t] - p.max()) < 1e-3 and odd[t] == (score[t] < 0.75)


def test_minimise():
    rng = np.random.default_rng(6)
    a = rng.normal(size=(30, 8))
    q, c = a.T @ a, rng.normal(size=(8, 2))
    w = minimise(lambda w: (float((w * (q @ w)).sum() / 2 - (c * w).sum()), q @ w - c), np.zeros((8, 2)), 100)
    assert np.abs(w - np.linalg.solve(q, c)).max() < 1e-3


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.01"
    got = op6_language_id(spark, at).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_more_than_64_languages(spark):
    """Every language is learned, those of few documents too."""
    docs = [(i, " ".join([chr(0x4E00 + 3 * (i % 70) + k) * 3 for k in range(3)] * 4), f"l{i % 70:02}") for i in range(700)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    coder = learn(frame)
    assert coder.langs == sorted({d[2] for d in docs})
    truth = {d[0]: d[2] for d in docs}
    got = predict(frame, coder).collect()
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.95 * len(got)


def test_odd_rows(spark):
    docs = [(i, ["the cat and the dog", "der Hund und die Katze"][i % 2], ["en", "de"][i % 2], "k") for i in range(60)]
    coder = learn(spark.createDataFrame(docs, "doc_id long, text string, lang string, h string"))
    odd = spark.createDataFrame([(1, None), (2, "123 !"), (3, ""), (4, "der Hund " * 9000), (4, "der Hund " * 9000), (None, "the dog \U00020000")], "doc_id long, text string")
    got = sorted(((r.doc_id or 9, r.lang_pred) for r in predict(odd, coder).collect()))
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de"), (9, "en")]
    assert predict(odd.limit(0), coder).collect() == []
    assert [r.lang_pred for r in predict(odd, learn(odd.withColumn("lang", odd.text).where("1=0"))).collect()] == ["und"] * 6
