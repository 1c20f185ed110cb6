import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions.generate import NAMES, SURNAMES
from spanloom.operators import render


def test_parsed():
    assert render.parsed("a {phone} b {~vin}") == [{"literal": "a "}, {"slot": "phone", "category": "private_phone"}, {"literal": " b "}, {"slot": "vin"}]
    assert render.parsed("plain") == [{"literal": "plain"}] and render.parsed("") == []


@pytest.mark.parametrize("name", sorted(render.PACKS))
def test_packs(spark, name):
    rows = render.pack(spark, name, 400, 5).collect()
    assert len(rows) == 400 and rows == render.pack(spark, name, 400, 5).collect()
    kinds, total = {}, sum(render.PACKS[name].values())
    for r in rows:
        kind = r.info["strategy"].removeprefix("template/")
        kinds[kind] = kinds.get(kind, 0) + 1
        assert "{" not in r.text and all(0 <= s.start < s.end <= len(r.text) for s in r.label)
        fits = [t for t in render.TEMPLATES[kind] if sorted(p["category"] for p in render.parsed(t) if p.get("category")) == sorted(s.category for s in r.label)]
        assert fits, r
        for s in r.label:
            if s.category == "amka":
                assert re.fullmatch(r"\d{11}", r.text[s.start : s.end])
            if s.category == "private_email":
                assert r.text[s.start : s.end].endswith("@example.gr")
        if kind == "hard_negative":
            assert not r.label and r.info["difficulty"] == "hard_negative"
    for kind, w in render.PACKS[name].items():
        assert abs(kinds.get(kind, 0) / 400 - w / total) < 0.1


def test_people(spark):
    rows = render.pack(spark, "people", 300, 1).select(F.explode("label").alias("s"), "text").collect()
    stems = [x[:-2] for x in [*NAMES["m"], *NAMES["f"]]]
    for r in rows:
        value = r.text[r.s.start : r.s.end]
        assert any(x in value for x in stems) and any(x[:-2] in value for x in SURNAMES)


def test_appended(spark):
    docs = spark.createDataFrame([(1, "Ένα κείμενο."), (2, ""), (3, None), (3, "a 😀 b")], "doc_id long, text string")
    rows = render.appended(docs, 2).collect()
    assert len(rows) == 4
    for r in rows:
        assert r.text.startswith(("Ένα κείμενο. ", "a 😀 b ", " ")) and 1 <= len(r.label) <= 3
        assert all(r.text[s.start : s.end].strip() == r.text[s.start : s.end] for s in r.label)
    assert render.appended(docs.limit(0), 2).collect() == []
    with pytest.raises(ValueError):
        render.render(docs.select(F.col("doc_id").alias("ix")), {"easy": 1.0}, 1)


def test_announced(spark):
    rows = render.announced(spark, 200, 3).collect()
    assert len(rows) == 200 * len(render.WORDS)
    modes = {}
    for r in rows:
        (s,) = r.label
        value, word = r.text[s.start : s.end], render.WORDS[r.category].get(r.mode, "")
        assert r.text == r.text[: s.start] + value + "." and r.text.startswith(word) and (s.start == 0) == (r.mode == "no_prefix")
        if r.category == "cvv":
            assert r.mode != "no_prefix" and re.fullmatch(r"\d{3}", value)
        else:
            modes[r.mode] = modes.get(r.mode, 0) + 1
    for m, w in render.ANNOUNCED.items():
        assert abs(modes[m] / sum(modes.values()) - w) < 0.06
