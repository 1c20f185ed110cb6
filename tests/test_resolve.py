import random
import time

import pytest
from pyspark.sql import functions as F

from spanloom.operators.resolve import apart, checked_cases, json_spans, places, resolve, resolved_cases

VALUES = "array<struct<label:string,value:string>>"


def plain(text, values, cursor, fall_back):
    """str.find with cursors."""
    out, behind, by = [], 0, {}
    for label, v in values:
        if not v or text is None:
            continue
        start = {"all": behind, "each": by.get(v, 0), "none": 0}[cursor]
        at = text.find(v, start)
        if at < 0 and fall_back:
            at = text.find(v)
        if at >= 0:
            behind = by[v] = at + len(v)
            out.append((label, at, behind))
    return out


def test_cursors_against_find(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("abé ", k=rng.randrange(40))), [(str(k), "".join(rng.choices("abé", k=rng.randrange(3)))) for k in range(rng.randrange(30))]) for i in range(80)]
    rows += [(100, None, [("0", "a")]), (101, "", []), (102, "aaaa", [("0", "aa"), ("1", "aa"), ("2", "aa"), ("3", None)])]
    df = spark.createDataFrame(rows, f"i int, t string, v {VALUES}")
    for cursor in ("all", "each", "none"):
        for fall_back in (False, True):
            got = {r.i: (r.a, r.b) for r in df.select("i", resolve(F.col("t"), F.col("v"), cursor, fall_back).alias("a"), resolve(F.col("t"), F.col("v"), cursor, fall_back, strict=True, ordered=True).alias("b")).collect()}
            for i, t, v in rows:
                want = plain(t, v, cursor, fall_back)
                assert [tuple(x) for x in got[i][0]] == want
                assert (got[i][1] is None) == (len(want) < len(v)) and (got[i][1] is None or [tuple(x) for x in got[i][1]] == sorted(want, key=lambda s: s[1]))
    assert spark.sql(f"select 'a' t, cast(null as {VALUES}) v").select(resolve(F.col("t"), F.col("v")).alias("x")).first().x is None


def test_ten_thousand_values(spark):
    text = " ".join(f"v{k % 4000:04}" for k in range(10_000))
    df = spark.createDataFrame([(text, [("x", f"v{k % 4000:04}") for k in range(10_000)])], f"t string, v {VALUES}")
    began = time.time()
    for cursor in ("all", "each"):
        got = df.select(resolve(F.col("t"), F.col("v"), cursor, strict=True).alias("x")).first().x
        assert [r.start for r in got] == [6 * k for k in range(10_000)]
    assert time.time() - began < 30


def test_places():
    text = "abababa xx"
    many = {"aba", "ba", "x", "xx", "q", *"cdefgh"}
    assert places(text, many) == {v: [k for k in range(len(text)) if text.startswith(v, k)] for v in many} and places(text, {"aba", ""}) == {"aba": [0, 2, 4]}
    assert apart([0, 2, 4], 3) == [0, 4]


def test_cases_fail_at_the_first_fault(spark):
    rows = [(1, "a b a", [("p", "a"), ("q", "b"), ("p", "a")]), (2, "a", [("p", "a"), ("q", "a"), ("z", "a")]), (3, "ab", [("z", "b"), ("p", "c")]), (4, "ab", []), (5, "ab", [(None, "b")])]
    df = spark.createDataFrame(rows, f"id int, text string, v {VALUES}")
    got = {r.id: (r.problem, r.spans and [tuple(s) for s in r.spans]) for r in resolved_cases(df, ("p", "q")).collect()}
    assert got == {1: (None, [("p", 0, 1), ("q", 2, 3), ("p", 4, 5)]), 2: ("not_found: a", None), 3: ("unknown_label: z", None), 4: (None, []), 5: ("unknown_label: ", None)}
    assert checked_cases(df.where("id in (1, 4)"), ("p", "q")).count() == 2
    with pytest.raises(Exception, match="case 2: not_found: a"):
        checked_cases(df.where("id = 2"), ("p", "q")).collect()


def test_answers(spark):
    good = '{"label": "a", "value": "b"}'
    rows = [
        (f"[{good}]", [("a", "b")]), (f"noise [1] then [{good}]", [("a", "b")]), ('so [{"label": "a", "value": "x]y"}] ok', [("a", "x]y")]), (f"[{good}, 5, null]", [("a", "b"), (None, None), (None, None)]),
        (f'{{"spans": [{good}]}}', [("a", "b")]), ("none", None), ("[]", []), ("x [ ] y", []), ('[{"label": "", "value": "b"}]', [(None, None)]), ('[{"label": "a", "value": 5}]', [("a", None)]), (None, None), ("[1", None), (f"[1] and [{good}]", [("a", "b")]), (f"[1], [{good}]", [("a", "b")]), (f"see [x] [{good}", None),
    ]
    df = spark.createDataFrame([(c,) for c, _ in rows], "c string")
    got = df.select(json_spans(F.col("c")).alias("x"), json_spans(F.col("c"), objects=True).alias("y")).collect()
    for (content, want), r in zip(rows, got, strict=True):
        assert (r.x and [tuple(v) for v in r.x]) == want, content
    assert [tuple(v) for v in got[3].y] == [("a", "b")]
