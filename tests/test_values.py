import re

from pyspark.sql import functions as F

from spanloom.functions.values import GREEK_CAPITALS, PLATE_LETTERS, TOKEN_PREFIXES, value_table
from spanloom.operators import greedy, render

FORMS = {
    "amka": r"\d{6}[- ]?\d{5}", "afm": r"(EL|Α\.Φ\.Μ\.: |ΑΦΜ )?[1-9]\d{8}", "adt": rf"[{GREEK_CAPITALS}]{{2,3}}[ -]?\d{{6}}", "iban_gr": r"GR\d{2}([ -]?)(\d{4}\1){5}\d{3}",
    "phone": r"(\+30 )?(69|21|231|241)\d+|(69|21|231|241)\d+([ .])\d{3}\4\d{3}", "email": r"[^@ ]+\d{1,3}@[a-z.]+", "url": r"(https?://|www)\S+", "deep_url": r"https?://[a-z.]+/\S+", "address": r"\S+ \d+(,| -) .+",
    "boundary_address": r".+ \d+[ΑΒΓαβ]?(, .+)?", "old_address": r"\S+ \d+(, \S+)?", "date": r"\d\d([/-])\d\d\1\d{4}|\d+ \S+ \d{4}|\d{4}", "greek_date": r"\d+ \S+ \d{4}", "account": r"\d{10}|\d{12}|\d{14}",
    "secret": r"sk-[A-Z0-9]{16,32}", "token": "(" + "|".join(map(re.escape, TOKEN_PREFIXES)) + r")[\w-]{20,64}", "password": r"\S{6,}", "passport": r"[A-Z]{2}\d{7}", "plate": rf"[{PLATE_LETTERS}]{{3}}[- ]?\d{{4}}", "vin": r"[A-HJ-NPR-Z0-9]{17}",
    "gemi": r"\d{12}", "ama": r"\d{9}|\d{7}", "cvv": r"\d{3,4}", "loose_imei": r"\d{15}", "ip": r"\d+(\.\d+){3}|([0-9a-f]{4}:){7}[0-9a-f]{4}", "mac": r"[0-9a-f]{2}([:-])([0-9a-f]{2}\1){4}[0-9a-f]{2}", "licence": r"\d{9}|[A-Z]{2}\d{6}",
    "pcn": r"\d{9}[A-Z]\d{2}", "titled_person": r"\S+ .+", "foreign_person": r"[A-Z][a-z]+ [A-Z][a-z]+", "amount": r"\d+,\d\d€", "room": r"Δωμάτιο \d{3}", "office": r"Γραφείο \d{3}",
}


def luhn(value):
    d = [int(c) for c in value if c.isdigit()][::-1]
    return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])


def test_forms(spark):
    rows = value_table(spark, 300, 5).collect()
    for r in rows:
        for c, p in FORMS.items():
            assert re.fullmatch(p, r[c]), (c, r[c])
        assert all(luhn(r[c]) % 10 == 0 for c in ("card", "brand_card", "imei"))
    assert set(FORMS) | {"card", "brand_card", "imei", "ix"} == set(rows[0].asDict())
    for c in ("amka", "adt", "plate", "iban_gr"):
        assert len({re.sub(r"\w", "", r[c]) for r in rows}) == 3
    latin = sum(r.email.isascii() for r in rows)
    assert 0.7 < latin / len(rows) < 0.9 and any(":" in r.ip for r in rows) and len({r.vin for r in rows}) == 300
    assert rows == value_table(spark, 300, 5).collect()


def test_new_packs(spark):
    for name in ("early", "boundaries", "people_and_places", "recall", "alike"):
        for r in render.pack(spark, name, 60, 3).collect():
            assert all(0 <= s.start < s.end <= len(r.text) for s in r.label)
            if r["info"]["strategy"] == "template/dense":
                assert [s.category for s in r.label] == ["private_person"]


def test_detectors_and_generators_from_outside(spark):
    docs = spark.createDataFrame([(1, "ab ab"), (2, None), (3, "b")], "doc_id long, text string")
    find = lambda texts: [[("x", m.start(), m.end()) for m in re.finditer("b", t)] for t in texts]
    assert sorted(map(tuple, greedy.detected_by(docs, find, 2).collect())) == [(1, "x", 1, 2, "b"), (1, "x", 4, 5, "b"), (3, "x", 0, 1, "b")]
    out = greedy.answered_by(docs.select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("prompt")), lambda ps: [p.upper() for p in ps], 2).collect()
    assert sorted((r.key, r.content) for r in out) == [(1, "AB AB"), (2, ""), (3, "B")]


def test_overlapping_predictions_go(spark):
    rows = [(1, "a", 0, 5), (1, "b", 3, 8), (1, "c", 6, 9), (1, "d", 0, 2), (2, "a", 0, 1), (2, "b", 1, 2)]
    got = sorted(map(tuple, greedy.discard_overlaps(spark.createDataFrame(rows, "doc_id long, category string, start int, end int")).collect()))
    assert got == [(1, "a", 0, 5), (1, "c", 6, 9), (2, "a", 0, 1), (2, "b", 1, 2)]
