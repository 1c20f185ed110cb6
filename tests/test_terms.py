import random
import time

import ahocorasick
from pyspark.sql import functions as F

from spanloom.operators.terms import find_terms, longest_first

DOCS = "doc_id long, text string"


def brute(docs, terms):
    """Every place of every term, by comparison."""
    inside = lambda c: c.isalnum() or c == "_"
    out = []
    for i, t in docs:
        for term in terms:
            for a in range(len(t or "")):
                b = a + len(term)
                if t.startswith(term, a) and not (a and inside(t[a - 1])) and not (b < len(t) and inside(t[b])):
                    out.append((i, term, a, b))
    return out


def test_both_ways_against_brute_force(spark):
    rng = random.Random(7)
    words = ["a", "ab", "É", "x_1", "βγ", "9", "日本"]
    docs = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "-", "  ", "\n", ""]) for _ in range(rng.randrange(20)))) for i in range(60)] + [(60, None), (61, ""), (7, "ab a"), (62, "a " * 60_000)]
    terms = ["a", "ab", "a ab", "ab a ab", "É", "x_1", "βγ-9", "日本", "ab  a", "a\nab", "never"]
    d = spark.createDataFrame(docs, DOCS)
    t = spark.createDataFrame([(x,) for x in [*terms, *terms, None, "", "-", "a-", " a"]], "term string")
    want = sorted(brute(docs, terms))
    firsts = {}
    for i, term, a, b in want:
        firsts.setdefault(i, []).append((a, b, term))
    # Rows with one id are one text's after the join; the automaton sees each by itself.
    single = sorted((i, term, a, b) for i, s in firsts.items() if i != 7 for a, b, term in longest_first(s))
    for most in (1 << 20, 0):
        assert sorted(map(tuple, find_terms(d, t, longest=False, most_bytes=most).collect())) == want, most
        assert sorted(tuple(r) for r in find_terms(d, t, most_bytes=most).collect() if r.doc_id != 7) == single, most
        assert find_terms(d, t.limit(0), most_bytes=most).collect() == find_terms(d.limit(0), t, most_bytes=most).collect() == []
    more = [F.lit("x").alias(c) for c in ("term", "start", "end", "n", "h", "s")]
    assert sorted(map(tuple, find_terms(d.select("*", *more), t.select("*", *more[1:]), longest=False).collect())) == want


def test_ten_thousand_terms(spark):
    rng = random.Random(3)
    terms = ["".join(rng.choices("abcdefgh", k=8)) for _ in range(10_000)]
    docs = spark.createDataFrame([(k, " ".join(rng.choices(terms, k=500)) + " none") for k in range(400)], DOCS)
    began = time.time()
    assert find_terms(docs, spark.createDataFrame([(t,) for t in terms], "term string")).count() == 200_000 and time.time() - began < 40


def test_longest_first():
    assert longest_first([(0, 1, "a"), (0, 4, "a bc"), (2, 4, "bc"), (4, 5, "d")]) == [(0, 4, "a bc"), (4, 5, "d")] and longest_first([]) == [] and ahocorasick.unicode
