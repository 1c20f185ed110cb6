"""Language of texts by error-correcting output codes.

Each language has a codeword; for every bit a linear classifier over hashed
character n-grams tells which half of the languages a text belongs to.  The
language whose codeword has the least logistic loss over all bits is chosen, and
the loss's distance to the runner-up flags ambiguous texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, as_batch, table
from .kernels import pieces, utf8

DIM = 1 << 12
_CASE = np.arange(65536, dtype=np.uint32)
for _c in range(65536):
    _x = chr(_c).lower() if not 0xD800 <= _c < 0xE000 else " "
    _CASE[_c] = ord(_x) if len(_x) == 1 else _c
_LETTER = np.array([chr(_c).isalpha() if not 0xD800 <= _c < 0xE000 else False for _c in range(65536)])


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised square roots of hashed 1-, 2- and 3-gram counts, and letters by text; what isn't a letter is a space."""
    out, letters = np.zeros((len(texts), DIM), np.float32), np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        c = np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32)
        low = c < 65536
        s = np.where(low, _CASE[np.where(low, c, 0)], c)
        letter = np.where(low, _LETTER[np.where(low, s, 0)], True)
        if (~low).any():
            letter[~low] = [chr(x).isalpha() for x in c[~low]]
        letters[k] = letter.sum()
        if not letters[k]:
            continue
        s = np.where(letter, s, np.uint32(32))
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        s = np.concatenate([[np.uint32(32)], s[keep], [np.uint32(32)]]).astype(np.uint32)
        a = s * np.uint32(0x9E3779B1)
        b = (a[:-1] ^ (s[1:] + np.uint32(0x7F4A7C15))) * np.uint32(0x85EBCA6B)
        d = (b[:-1] ^ (s[2:] + np.uint32(0x165667B1))) * np.uint32(0xC2B2AE35)
        n = np.bincount(np.concatenate([a, b, d]) >> np.uint32(20), minlength=DIM)
        v = np.sqrt(n)
        out[k] = v / np.sqrt(n.sum())
    return out, letters


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """+1 and -1 by language and bit: all distinct divisions up to six languages, else balanced random ones."""
    if k <= 6:
        rows = [[1 if (b >> i) & 1 else -1 for b in range(1, 1 << (k - 1))] for i in range(k - 1)] + [[-1] * ((1 << (k - 1)) - 1)] if k > 1 else [[]]
        return np.array(rows, np.float32).reshape(k, -1)
    rng = np.random.default_rng(seed)
    bits = 4 * int(np.ceil(np.log2(k))) + 16
    return np.stack([rng.permutation(np.where(np.arange(k) < k // 2, 1, -1)) for _ in range(bits)], axis=1).astype(np.float32)


class Coder:
    """Languages, codewords and a linear classifier for each bit."""

    def __init__(self, langs: list[str], codes: np.ndarray, weights: np.ndarray):
        self.langs, self.codes, self.weights = langs, codes, weights

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is ambiguous (the score is under 0.75)."""
        x, letters = vectors(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        margin = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1) @ self.weights
        loss = np.logaddexp(0, -margin) @ (self.codes.T > 0) + np.logaddexp(0, margin) @ (self.codes.T < 0)
        p = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        some = letters > 0
        score = np.where(some, p[np.arange(len(p)), best], 0.0)
        return [self.langs[b] if s else "und" for b, s in zip(best, some, strict=True)], score, score < 0.75


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2


def _examples():
    """Vectors of each text and of two short stretches anywhere in it, since short texts must be told too."""
    schema = "lang string, at binary, value binary"
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "replace")))
                cuts = [text] + [text[(a := int(rng.integers(0, len(text)))) : a + int(rng.integers(20, 200))] for _ in range(2)]
                x, letters = vectors(cuts)
                at = [np.flatnonzero(v).astype("<u2") for v, n in zip(x, letters, strict=True) if n]
                if at:
                    yield as_batch({"lang": [lang] * len(at), "at": [i.tobytes() for i in at], "value": [v[i].tobytes() for v, i in zip(x[letters > 0], at, strict=True)]}, to)

    return run, schema


def minimise(f, w: np.ndarray, passes: int, memory: int = 8) -> np.ndarray:
    """L-BFGS for a convex ``f`` that gives its value and gradient."""
    value, g = f(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(passes):
        d, alphas = -g.copy(), []
        for s, y, r in reversed(past):
            alphas.append(a := r * np.vdot(s, d))
            d -= a * y
        if past:
            s, y, r = past[-1]
            d *= 1 / (r * np.vdot(y, y))
        for (s, y, r), a in zip(past, reversed(alphas), strict=True):
            d += s * (a - r * np.vdot(y, d))
        slope, step = float(np.vdot(g, d)), 1.0 if past else 1.0 / max(1e-12, float(np.linalg.norm(g)))
        while True:
            new = w + np.float32(step) * d
            value2, g2 = f(new)
            if value2 <= value + 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        s, y = new - w, g2 - g
        if (sy := float(np.vdot(s, y))) > 1e-12:
            past = [*past[-(memory - 1) :], (s, y, 1 / sy)]
        done = value - value2 < 1e-7 * max(1.0, abs(value))
        w, value, g = new, value2, g2
        if done:
            break
    return w


def _train(names: list[str], codes: np.ndarray, passes: int, penalty: float):
    """Weights of all bits, in one task, from the examples of a bounded number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {n: k for k, n in enumerate(names)}
        rows, own = [], []
        for batch in batches:
            for lang, at, value in zip(*(batch.column(c).to_pylist() for c in ("lang", "at", "value")), strict=True):
                own.append(place[lang])
                rows.append((at, value))
        order = sorted(range(len(rows)), key=lambda k: (own[k], *rows[k]))
        own = np.array([own[k] for k in order], np.int64)
        x = np.zeros((len(order), DIM + 1), np.float32)
        x[:, DIM] = 1
        for r, k in enumerate(order):
            x[r, np.frombuffer(rows[k][0], "<u2")] = np.frombuffer(rows[k][1], np.float32)
        del rows
        w = np.zeros((DIM + 1, codes.shape[1]), np.float32)
        if len(own):
            y = codes[own]
            share = (1 / np.bincount(own)[own])[:, None].astype(np.float32)
            share /= share.sum()

            def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
                margin = np.clip(y * (x @ w), -60, 60)
                value = float((share * np.logaddexp(0, -margin)).sum()) + penalty / 2 * float(np.vdot(w, w))
                return value, x.T @ (-share * y / (1 + np.exp(margin))) + np.float32(penalty) * w

            w = minimise(loss, w, passes)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f4").tobytes()], pa.binary())], ["weights"])

    return run


def learn(docs: DataFrame, each: int = 1500, most: int = 6000, passes: int = 120, penalty: float = 1e-5) -> Coder:
    """Learn every language, from up to ``each`` whole texts of each, those first by a hash of doc_id.

    With many languages each has fewer texts, ``most`` in all, but always one.
    Only rows whose crc32(doc_id as text) mod 4 is not 2, with a language and a
    text that has a letter; rows with a null doc_id, lang or text are left out,
    rows that repeat count each.  Texts and their vectors stay in the executors;
    one task fits the weights, which alone reach the driver.  An empty table
    gives a coder that knows no language; other columns are ignored.
    """
    rows = docs.where("lang is not null and doc_id is not null").where(~held_out()).where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    #: One row for each language, as the coder itself has.
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    names = sorted(r.lang for r in counts.select("lang").collect())
    codes = codewords(len(names)) if names else np.zeros((0, 0), np.float32)
    if codes.shape[1] == 0:
        return Coder(names, codes, np.zeros((DIM + 1, codes.shape[1]), np.float32))
    k = max(1, min(each, most // len(names)))
    #: Twice as many as wanted pass the first sieve, so no task sorts more than that of a language.
    u = F.xxhash64("doc_id", "lang").bitwiseAND((1 << 63) - 1) / float(1 << 63)
    sieve = F.broadcast(counts.select("lang", F.least(F.lit(1.0), (2.0 * k + 50) / F.col("n")).alias("top")))
    near = rows.withColumn("u", u).join(sieve, "lang").where(F.col("u") < F.col("top"))
    chosen = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id"))).where(F.col("r") <= k)
    run, schema = _examples()
    made = chosen.select("lang", "text").mapInArrow(run, schema).repartition(1).mapInArrow(_train(names, codes, passes, penalty), "weights binary").first()
    return Coder(names, codes, np.frombuffer(made.weights, "<f4").reshape(DIM + 1, -1))


def predict(docs: DataFrame, coder: Coder) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every row; und, 0 and true where text is null or has no letter.

    Rows that repeat are predicted each, whole texts of any length are read; an
    empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(coder)
    schema = "doc_id long, lang_pred string, score double, ambiguous boolean"
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offs = utf8(batch.column("text"))
            for a, b in pieces(offs):
                for lo in range(a, b, 512):
                    n = min(512, b - lo)
                    lang, score, odd = shared.value.predict([t or "" for t in batch.column("text").slice(lo, n).to_pylist()])
                    yield as_batch({"doc_id": batch.column("doc_id").slice(lo, n), "lang_pred": lang, "score": score, "ambiguous": odd}, to)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
