"""Toxicity of texts whose words may be disguised.

Words are restored first: digits and signs that stand for letters, stretched
letters and spaces between short parts form a lattice, in which an exact Viterbi search
under a character 4-gram model of the whole corpus finds the likeliest reading
(the noisy channel).  Restored words are scored by log odds that labelled documents
give to words and their beginnings, and a document by a logistic curve over the
sum for its distinct words.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, as_batch, table
from .kernels import pieces, slice_hashes, utf8, words

#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
_A = 28
_SYMBOL = {chr(97 + i): i + 1 for i in range(26)}
_PART = re.compile(r"[^\W_]|[" + re.escape("".join(c for c in LEET if not c.isalnum())) + "]")
_STRETCH = re.compile(r"(.)\1\1")
_DOUBLE = re.compile(r"(.)\1+")
_EDGE = re.compile(r"^[^\w@$]+|[\W_]+$")
_BREAK = re.compile(r"[^\w@$!|+(€£]+|_+")

_FOLD = np.zeros((2, 256), np.int64)
for _c in range(128):
    _FOLD[0, _c] = _SYMBOL.get(chr(_c).lower(), 0)
_FOLD[0, 192:] = 27
for _c in range(64):
    _FOLD[1, 128 + _c] = _SYMBOL.get(unicodedata.normalize("NFD", chr(192 + _c).lower())[0], 27 if chr(192 + _c).isalpha() else 0)


def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def _grams():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_A**4, np.int64)
        for batch in batches:
            data, offs = utf8(batch.column("text"))
            for lo, hi in pieces(offs, 1 << 20):
                d = data[offs[lo] : offs[hi]]
                s = _FOLD[0][d]
                after = np.flatnonzero(d[:-1] == 0xC3)
                s[after + 1] = _FOLD[1][d[after + 1]]
                keep = (d < 0x80) | (d > 0xC3)
                keep[after + 1] = True
                s = s[keep]
                if len(s) > 3:
                    total += np.bincount(((s[:-3] * _A + s[1:-2]) * _A + s[2:-1]) * _A + s[3:], minlength=_A**4)
        on = np.flatnonzero(total)
        if len(on):
            yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], ["gram", "n"])

    return run


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of a symbol after three, from the 4-grams of all texts; at most 28**4 counts reach the driver."""
    rows = docs.select("text").mapInArrow(_grams(), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(_A**4)
    n[rows["gram"].to_numpy()] = rows["n"].to_numpy()
    n = n.reshape(_A, _A, _A, _A)
    p = np.full(_A, 1 / _A)
    for at in ((0, 1, 2), (0, 1), (0,), ()):
        c = n.sum(axis=at) if at else n
        p = (c + 4 * p) / (c.sum(axis=-1, keepdims=True) + 4)
    return np.log(p).astype(np.float32)


#: What it costs to read over the space between two short parts, over one of several equal letters, an equal sign, another sign, and to read a sign as a letter.
GAP, REPEAT, AGAIN, SIGN, STANDS = 1.0, 0.4, 3.0, 4.0, 1.0
#: A run of words of at most two characters each, three at least, may be one word set apart.
SHORT, RUN = 2, 3
#: The most that one word weighs.
TOP = 8.0
_ARCS: dict[str, list[tuple[int, str, float]]] = {" ": [(0, " ", 0.0)]}


def _arcs(c: str) -> list[tuple[int, str, float]]:
    if c not in _ARCS:
        _ARCS[c] = [(_SYMBOL.get(c, 27), c, 0.0)] * c.isalpha() + [(_SYMBOL[x], x, STANDS) for x in LEET.get(c, "")]
    return _ARCS[c]


class FlatModel:
    """A character model for lookups one by one; ``reach`` is what three symbols can differ by at most."""

    def __init__(self, model: np.ndarray):
        self.values = np.ascontiguousarray(model, np.float32).ravel().tolist()
        self.reach = 3 * float(np.max(model) - np.min(model))


def flat_model(model: np.ndarray | FlatModel) -> FlatModel:
    return model if isinstance(model, FlatModel) else FlatModel(model)


def decode(token: str, model: np.ndarray | FlatModel) -> str:
    """The likeliest reading of a folded token, by exact Viterbi over its lattice.

    A state is the last three symbols read.  A state falls out only if it is
    further behind the best than three symbols can ever make good, after which
    both have the same context.  Spaces stay or are read over.  Time and memory
    are linear in the token's length.
    """
    model = flat_model(model)
    flat, reach = model.values, model.reach
    states: dict[int, tuple[float, int]] = {0: (0.0, 0)}
    parents, letters = [0], [""]
    run, last = 0, ""
    for k, c in enumerate(token):
        run, last = run + 1 if c == last else 1, c
        arcs = _arcs(c)
        if c == " ":
            skip = GAP
        elif c.isalpha():
            skip = None if run == 1 else REPEAT if run > 2 or token[k + 1 : k + 2] == c else AGAIN
        else:
            skip = AGAIN if run > 1 else SIGN
        new: dict[int, tuple[float, int, str]] = {}
        for code, (score, node) in states.items():
            if skip is not None and (code not in new or score - skip > new[code][0]):
                new[code] = (score - skip, node, "")
            base, tail = code * _A, code % (_A * _A) * _A
            for y, x, cost in arcs:
                v, t = score - cost + flat[base + y], tail + y
                if t not in new or v > new[t][0]:
                    new[t] = (v, node, x)
        if not new:
            return ""
        least = max(v[0] for v in new.values()) - reach if len(new) > 8 else -math.inf
        states = {}
        for t, (v, node, x) in new.items():
            if v >= least:
                if x:
                    parents.append(node)
                    letters.append(x)
                    node = len(parents) - 1
                states[t] = (v, node)
    node = max(states.items(), key=lambda i: i[1][0] + flat[i[0] * _A])[1][1]
    out = []
    while node:
        out.append(letters[node])
        node = parents[node]
    return "".join(reversed(out))


def restore(token: str, model: np.ndarray | FlatModel) -> list[str]:
    """Words of one token as they would be written plainly; letters only, doubled letters once."""
    token = _EDGE.sub("", fold(token))
    if token.isalpha() and not _STRETCH.search(token):
        return [_DOUBLE.sub(r"\1", token)]
    parts = [p for p in _BREAK.split(token) if p]
    if len(parts) >= RUN and sum(len(p) <= SHORT for p in parts) >= RUN:
        return joined(" ".join(parts), model)
    out = []
    for p in parts:
        if not any(c.isalpha() for c in p):
            continue
        if not p.isalpha() or _STRETCH.search(p):
            p = decode(p, model)
        if p:
            out.append(_DOUBLE.sub(r"\1", p))
    return out


def joined(parts: str, model: np.ndarray | FlatModel) -> list[str]:
    """Words of parts between single spaces, where spaces may be part of the disguise."""
    parts = fold(parts)
    return [_DOUBLE.sub(r"\1", w) for w in decode(parts, model).split(" ") if w] if any(c.isalpha() for c in parts) else []


def features(word: str) -> list[str]:
    return ["=" + word, *(word[:k] for k in (4, 5, 6) if len(word) >= k)]


class Weights:
    """Weight of a token: the highest log odds of a feature of its restored words."""

    def __init__(self, model: np.ndarray, odds: dict[str, float]):
        self.model, self.odds = flat_model(model), odds
        self.longest = max(map(len, odds), default=1)

    def word(self, word: str) -> float:
        odds = self.odds
        return max(odds.get("=" + word, 0.0), odds.get(word[:4], 0.0), odds.get(word[:5], 0.0), odds.get(word[:6], 0.0)) if len(word) > 3 else odds.get("=" + word, 0.0)

    def token(self, token: str) -> float:
        return max((self.word(w) for w in restore(token, self.model)), default=0.0)

    def spaced(self, parts: str) -> dict[str, float]:
        """Weights of the words that short parts make together; a word may begin at any of their letters."""
        plain, out = set(fold(parts).split(" ")), {}
        for w in joined(parts, self.model):
            if w not in plain and w not in out:
                n = len(w)
                found = max((self.word(w[k:] if n - k <= self.longest else w[k : k + 6]) for k in range(n)), default=0.0)
                if found:
                    out[w] = found
        return out


_WORD = re.compile("[^\x20\x09-\x0d]+")


def short_runs(words_: list[str]) -> Iterator[str]:
    """Runs of ``RUN`` or more words of at most ``SHORT`` characters, joined by spaces; a bar alone ends a run."""
    held: list[str] = []
    for w in [*words_, "   "]:
        if len(w) <= SHORT and w != "|":
            held.append(w)
        else:
            if len(held) >= RUN:
                yield " ".join(held)
            held = []


def _short_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray, by_row: np.ndarray) -> Iterator[tuple[int, str]]:
    """Row and text of every run, as ``short_runs`` finds them."""
    if not len(start):
        return
    letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    short = (letters[end] - letters[start] <= SHORT) & ~((end - start == 1) & (data[start] == 0x7C))
    row = np.searchsorted(by_row, np.arange(len(start)), "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (short[1:] != short[:-1]) | (row[1:] != row[:-1])]))
    size = np.diff(np.append(new, len(start)))
    for x, n in zip(*(v[short[new] & (size >= RUN)].tolist() for v in (new, size)), strict=True):
        yield int(row[x]), " ".join(_WORD.findall(data[start[x] : end[x + n - 1]].tobytes().decode()))


def _sums(shared):
    """Sum of the weights of each text's distinct tokens and of the distinct words of its short runs, each at most ``TOP``."""

    def sums():
        known: dict[int, float] = {}
        runs: dict[str, dict[str, float]] = {}
        weights = Weights(*shared.value)

        def of(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
            data, offs = utf8(col)
            for lo, hi in pieces(offs, 1 << 20):
                d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                start, end, by_row = words(d, o)
                u, first, inv = np.unique(slice_hashes(d, start, end), return_index=True, return_inverse=True)
                blob, w = d.tobytes(), np.zeros(len(u))
                for k, (h, s, e) in enumerate(zip(u.tolist(), start[first].tolist(), end[first].tolist(), strict=True)):
                    x = known.get(h)
                    if x is None:
                        x = known[h] = weights.token(blob[s:e].decode())
                    if x:
                        w[k] = x
                if len(known) > 1 << 19:
                    known.clear()
                hit = np.flatnonzero(w[inv] > 0)
                row = np.searchsorted(by_row, hit, "right") - 1
                pair = np.unique(row * len(u) + inv[hit])
                total = np.bincount(pair // max(1, len(u)), np.minimum(w[pair % max(1, len(u))], TOP), hi - lo)
                of_row: dict[int, dict[str, float]] = {}
                for r, parts in _short_runs(d, start, end, by_row):
                    made = runs.get(parts)
                    if made is None:
                        made = weights.spaced(parts)
                        if len(parts) < 200:
                            runs[parts] = made
                    if made:
                        of_row.setdefault(r, {}).update(made)
                for r, made in of_row.items():
                    total[r] += sum(min(TOP, x) for x in made.values())
                if len(runs) > 1 << 17:
                    runs.clear()
                yield lo, hi, total

        return of

    return sums


def _count_features(shared):
    schema = "feature string, toxic long, clean long"
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen, counts = flat_model(shared.value), {}, (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                found: set[str] = set()
                tokens = _WORD.findall(text or "")
                for t in set(tokens):
                    f = seen.get(t)
                    if f is None:
                        f = seen[t] = [x for w in restore(t, model) for x in features(w)]
                    found.update(f)
                for parts in short_runs(tokens):
                    found.update(x for w in joined(parts, model) for x in features(w))
                counts[0 if toxic else 1].update(found)
                if len(seen) > 1 << 19:
                    seen.clear()
            if sum(map(len, counts)) > 1 << 20:
                yield out(counts)
                counts = (Counter(), Counter())
        yield out(counts)

    def out(counts):
        both = list(counts[0].keys() | counts[1].keys())
        return as_batch({"feature": both, "toxic": [counts[0][f] for f in both], "clean": [counts[1][f] for f in both]}, to)

    return run, schema


class Model:
    """What learning gives: the character model, log odds and the logistic curve."""

    def __init__(self, characters: np.ndarray, odds: dict[str, float], slope: float, base: float):
        self.characters, self.odds, self.slope, self.base = characters, odds, slope, base


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5 == 0


def evidence(toxic, clean, of_toxic: int, of_clean: int, doubt: float):
    """Log odds of a feature in so many of the toxic and of the clean documents, shrunken where chance may explain them.

    One document's worth is added at the common rate, and the odds are taken times
    log(1 + exp(ratio - ``doubt``)) / ratio, ratio the likelihood ratio statistic:
    1 - doubt / ratio far above ``doubt``, little below it; 0 where they are negative.
    """
    share = of_toxic / (of_toxic + of_clean)
    t, c = toxic + share, clean + (1 - share)
    odds = F.log(t / of_toxic) - F.log(c / of_clean)
    ratio = 2 * (t * F.log(t / ((t + c) * share)) + c * F.log(c / ((t + c) * (1 - share))))
    return F.when(odds > 0, odds * F.log1p(F.exp(F.least(ratio - doubt, F.lit(500.0)))) / F.greatest(ratio, F.lit(1e-3))).otherwise(0.0)


def learn(docs: DataFrame, labels: DataFrame, most: int = 12000, doubt: float = 10.83) -> Model:
    """Learn from up to ``most`` labelled documents, those first by a hash of their id.

    Rows whose crc32(doc_id as text) mod 5 is 0 and null labels are left out; a
    doc_id with several labels is toxic if one is 1.  The character model counts
    all texts.  A feature weighs its shrunken log odds (``evidence``; 10.83 is the
    statistic's 0.1 % point), whatever share of the toxic documents has it;
    those above 0 are all kept, and only words of the labelled sample can be.  The
    logistic curve is fitted to sums from which each document's own counts are taken out.  Without
    labels of both kinds, or without a labelled document, every text scores the
    share of toxic labels, or 0.
    """
    spark = docs.sparkSession
    characters = character_model(docs)
    chosen = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", F.col("toxic").cast("int").alias("toxic")).toArrow()
    toxic = int(np.sum(chosen["toxic"].to_numpy())) if len(chosen) else 0
    clean = len(chosen) - toxic
    if not toxic or not clean:
        share = toxic / max(1, toxic + clean)
        return Model(characters, {}, 0.0, math.log(share / (1 - share)) if 0 < share < 1 else 40.0 * (2 * share - 1))
    #: At most ``most`` rows of two numbers, so they can go to every task.
    rows = docs.select("doc_id", "text").join(F.broadcast(spark.createDataFrame(chosen)), "doc_id").select("text", "toxic")
    run, schema = _count_features(spark.sparkContext.broadcast(characters))
    counted = rows.mapInArrow(run, schema).groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    t, c = F.col("toxic"), F.col("clean")
    fewer = lambda n: F.greatest(n - 1, F.lit(0))
    weighed = counted.select("feature", "toxic", evidence(t, c, toxic, clean, doubt).alias("odds"), evidence(fewer(t), c, max(1, toxic - 1), clean, doubt).alias("if_toxic"), evidence(t, fewer(c), toxic, max(1, clean - 1), doubt).alias("if_clean"))
    kept = weighed.where("odds > 0 or if_clean > 0").collect()
    found = {r.feature: r.odds for r in kept if r.odds > 0}
    others = [_sums(spark.sparkContext.broadcast((characters, {r.feature: r[k] for r in kept if r[k] > 0}))) for k in ("if_clean", "if_toxic")]

    to = arrow_schema("total double, toxic int")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_label = [sums() for sums in others]
        for batch in batches:
            for label, of in enumerate(by_label):
                part = batch.filter(pa.compute.equal(batch.column("toxic"), label))
                for _, _, total in of(part.column("text")):
                    yield as_batch({"total": total, "toxic": np.full(len(total), label, np.int32)}, to)

    seen = rows.mapInArrow(totals, "total double, toxic int").toArrow()
    x, y = seen["total"].to_numpy(), seen["toxic"].to_numpy().astype(float)
    if not len(y):
        return Model(characters, {}, 0.0, math.log(toxic / clean))
    beta = np.array([math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)), 0.0])
    z = np.stack([np.ones(len(x)), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(2), z.T @ (y - p) - 0.05 * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(characters, found, float(beta[1]), float(beta[0]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; null and empty texts score like texts without any toxic word.

    Whole texts are read, tokens of any length in linear time.  Rows that repeat
    are scored each; an empty table gives no rows; other columns are ignored.
    """
    sums = _sums(docs.sparkSession.sparkContext.broadcast((model.characters, model.odds)))

    to = arrow_schema("doc_id long, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sums()
        for batch in batches:
            for lo, hi, total in of(batch.column("text")):
                yield as_batch({"doc_id": batch.column("doc_id").slice(lo, hi - lo), "score": 1 / (1 + np.exp(-np.clip(model_of[0] * total + model_of[1], -40, 40)))}, to)

    model_of = (model.slope, model.base)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs``, all columns, without rows that score ``threshold`` or more.

    Null and empty texts score like texts without any toxic word; rows that repeat
    or lack a doc_id are judged each; an empty table gives no rows.
    """
    sums = _sums(docs.sparkSession.sparkContext.broadcast((model.characters, model.odds)))
    slope, base = model.slope, model.base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sums()
        for batch in batches:
            for lo, hi, total in of(batch.column("text")):
                yield batch.slice(lo, hi - lo).filter(pa.array(1 / (1 + np.exp(-np.clip(slope * total + base, -40, 40))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learned from the labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
