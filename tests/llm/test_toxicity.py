import binascii
import random
import time

import numpy as np
import pyarrow as pa

from spanloom.llm.kernels import utf8, words
from spanloom.llm.toxicity import AGAIN, GAP, LEET, REPEAT, SIGN, STANDS, Weights, _short_runs, character_model, decode, learn, op3_toxicity, restore, score, short_runs


def corpus(rng, n, plain):
    bad = ["idiot", "pathetic", "moron"]
    disguise = lambda w: rng.choice([w, w.replace("i", "1").replace("o", "0"), w[0] + w[1] * 4 + w[2:], " ".join(w), ".".join(w)]) if not plain else w
    docs, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice(["th", "er", "in", "on", "at", "es", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(40)]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), disguise(rng.choice(bad)))
        docs.append((i, " ".join(w), "labels"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_disguised_words_are_restored_and_scored(spark):
    rng = random.Random(2)
    docs, labels = corpus(rng, 900, True)
    hidden, truth = corpus(rng, 300, False)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    seen = frame(docs).repartition(4)
    model = learn(seen, spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id long, toxic int"))
    chars = model.characters
    assert restore("1d10t", chars) == ["idiot"] and restore("iiiidiot!", chars) == ["idiot"] and restore("m.o.r.o.n", chars) == ["moron"]
    assert restore("l'eau", chars) == ["l", "eau"] and restore("2024", chars) == [] and restore("", chars) == []
    weights = Weights(chars, model.odds)
    assert weights.spaced("i d i o t")["idiot"] > 0 and weights.spaced("id io t")["idiot"] > 0 and weights.spaced("1 2 3") == {}
    got = {r.doc_id: r.score for r in score(frame(hidden), model).collect()}
    right = sum((got[i] >= 0.5) == bool(t) for i, t in truth)
    assert right >= 0.97 * len(truth)
    odd = [(1, None, ""), (2, "", ""), (3, "!!! $$$", ""), (4, "idiot " * 30000, ""), (5, "x" * 50000 + "1", ""), (4, "idiot " * 30000, "")]
    s = sorted((r.doc_id, r.score) for r in score(frame(odd), model).collect())
    assert s[0][1] == s[1][1] == s[2][1] < 0.5 <= s[3][1] == s[4][1] and len(s) == 6


def paths(token):
    """Every reading of a token with its cost, without the language model."""
    out = [("", 0.0)]
    for k, c in enumerate(token):
        run = len(token[: k + 1]) - len(token[: k + 1].rstrip(c))
        ways = [(c, 0.0)] if c.isalpha() or c == " " else []
        ways += [(x, STANDS) for x in LEET.get(c, "")]
        if c == " ":
            ways.append(("", GAP))
        elif not c.isalpha():
            ways.append(("", AGAIN if run > 1 else SIGN))
        elif run > 1:
            ways.append(("", REPEAT if run > 2 or token[k + 1 : k + 2] == c else AGAIN))
        out = [(a + x, s + cost) for a, s in out for x, cost in ways]
    return out


def read(word, model):
    """Log likelihood of a reading, its end included."""
    s, total = [0, 0, 0], 0.0
    for c in [*word, " "]:
        y = 0 if c == " " else ord(c) - 96 if "a" <= c <= "z" else 27
        total += float(model[s[0], s[1], s[2], y])
        s = [s[1], s[2], y]
    return total


def test_decode_is_the_best_of_all_readings():
    rng = np.random.default_rng(8)
    model = np.log(rng.dirichlet(np.full(28, 0.3), size=28**3) + 1e-6).reshape(28, 28, 28, 28).astype(np.float32)
    pick = random.Random(3)
    for _ in range(120):
        token = "".join(pick.choice("abcs1063$@é  ") for _ in range(pick.randint(1, 7)))
        token = pick.choice([token, token + token[-1] * 2])
        best = max(read(w, model) - s for w, s in paths(token))
        assert abs(max(read(w, model) - s for w, s in paths(token) if w == decode(token, model)) - best) < 1e-3, token


def test_long_tokens_take_seconds(spark):
    rng = random.Random(1)
    model = character_model(spark.createDataFrame([("the cat sat on the mat " * 50,)], "text string"))
    began = time.time()
    for token in ("x" * 200000 + "1", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(100000)), "a " * 100000):
        assert decode(token, model)
    assert time.time() - began < 60


def test_runs_are_found_alike():
    texts = ["a b c", "", "ab | c d é", "x y | z", "long word", "à é î\tô û n o", "a b", "日 本 語 ok"]
    data, offs = utf8(pa.array(texts))
    got = list(_short_runs(data, *words(data, offs)))
    assert got == [(r, x) for r, t in enumerate(texts) for x in short_runs(t.split())] and got


def test_few_labels_still_tell_texts_apart(spark):
    assert op3_toxicity(spark, "/root/testdata/sf0.001").select("score").distinct().count() > 1


def test_character_model_sums_to_one(spark):
    p = np.exp(character_model(spark.createDataFrame([("Été à la plage",), (None,), ("ab",)], "text string")))
    assert np.allclose(p.sum(axis=-1), 1, atol=1e-4)


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score < 0.5 for r in score(docs, model).collect()] == [True]
    assert score(docs.limit(0), model).collect() == []


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op3_toxicity(spark, at).collect()}
    assert len(got) == spark.read.parquet(f"{at}/documents.parquet").count()
    truth = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{at}/labels.parquet").collect() if r.doc_id in got and got[r.doc_id].held_out]
    hit = [(got[i].predicted, t) for i, t in truth]
    caught = sum(p and t for p, t in hit) / max(1, sum(t for _, t in hit))
    wrong = sum(p and not t for p, t in hit) / max(1, sum(not t for _, t in hit))
    print("recall", caught, "false", wrong)
    assert caught >= 0.85 and wrong <= 0.01


def test_words_of_few_toxic_documents_count(spark):
    """A word in 5 of 45 toxic documents and no clean one, as in a language with few labels."""
    rng = random.Random(4)
    plain = lambda: ["".join(rng.choice(["th", "er", "in", "on", "at", "es"]) for _ in range(rng.randint(1, 4))) for _ in range(30)]
    ids = [i for i in range(2000) if binascii.crc32(str(i).encode()) % 5][:329]
    words = ["cretin"] * 5 + ["idiot"] * 40 + [""] * 284
    docs = spark.createDataFrame([(i, " ".join([*plain(), w])) for i, w in zip(ids, words, strict=True)], "doc_id long, text string")
    model = learn(docs, spark.createDataFrame([(i, int(w != "")) for i, w in zip(ids, words, strict=True)], "doc_id long, toxic int"))
    new = spark.createDataFrame([(1, " ".join([*plain(), "cretin"])), (2, " ".join(plain()))], "doc_id long, text string")
    assert {r.doc_id: r.score >= 0.5 for r in score(new, model).collect()} == {1: True, 2: False}
