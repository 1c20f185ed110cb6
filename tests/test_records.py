import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import greek
from spanloom.functions.generate import greek_identifiers, inflected
from spanloom.operators import report, sample

LABEL = "array<struct<category:string,start:int,end:int>>"
GOOD = "Ο πελάτης με αριθμό 123456789 κάλεσε σήμερα το πρωί."


def col(spark, values, f, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in df.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_scripts(spark):
    texts = ["", "123", "abc", "αβγ", "ab γδ", None]
    assert col(spark, texts, greek.greek_share) == [1.0, 1.0, 0.0, 1.0, 0.5, 1.0]
    assert col(spark, texts, greek.latin_share) == [0.0, 0.0, 1.0, 0.0, 0.5, 0.0]
    assert col(spark, ["αβγδε12345", "αβγδεζ1234", "", None], greek.greek_enough) == [False, True, False, False]


def test_record_reasons(spark):
    rows = [
        (None, []), (" \n", []), ("short", []), ("α" * 301, []), (GOOD + " <think>", []), ("Φυσικά! " + GOOD, []), ("12345. " * 5 + "a plain english line", []),
        (GOOD, [("afm", 20, 29)]), (GOOD, [(None, 1, 2)]), (GOOD, [("a", None, 2)]), (GOOD, [("a", 5, 5)]), (GOOD, [("a", 0, 999)]), (GOOD, [("a", 1, 2)]), (GOOD, [("a", 3, 5), ("b", 3, 5), ("a", 3, 5)]), (GOOD, None),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, t string, l {LABEL}")
    got = [r.x for r in df.select("k", greek.record_reason(F.col("t"), F.col("l")).alias("x")).orderBy("k").collect()]
    assert got[:4] == ["empty_text", "empty_text", "too_short", "too_long"]
    assert got[4] == "artifact:<think\\b" and got[5].startswith("artifact:^\\s*(παράδειγμα")
    assert got[6:] == ["low_greek_high_latin", "ok", "bad_category", "bad_offsets", "invalid_offsets", "invalid_offsets", "empty_span", "duplicate_span", "ok"]


def test_leaks_and_conflicts(spark):
    assert col(spark, ["το afm του", "afmx", "ένα SECRET εδώ", "secretο", "iban_gr", "x_afm"], greek.leaks_label) == [True, False, True, False, False, False]
    rows = [("6912345678 και 12", [("account_number", 0, 10)]), ("6912345678 και 12", [("account_number", 0, 10), ("cvv", 15, 17)]), ("x", [])]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, t string, l {LABEL}")
    got = [r.x for r in df.select("k", greek.without_phone_accounts(F.col("t"), F.col("l")).alias("x")).orderBy("k").collect()]
    assert got[0] is None and [s.category for s in got[1]] == ["cvv"] and got[2] == []


def test_values(spark):
    assert [tuple(x) for x in col(spark, ["123456789", "ΑΦΜ: 123456789", "EL123456789 ", "1234567890", "X 123456789"], greek.nine_digits)] == [(0, "clean"), (5, "relabelled"), (2, "relabelled"), (None, "unparseable"), (None, "unparseable")]
    assert col(spark, ["AB-12 γδΕ.", "Άλφα1", ""], greek.run_shape) == ["A2-d2 a2A1.", "A1a3d1", ""]
    check = lambda c: lambda v: greek.value_problem(F.lit(c), v)
    assert col(spark, ["Α.Φ.Μ.: 123 456 789", "EL12"], check("afm")) == [None, "afm_format"]
    assert col(spark, ["AMKA 010190-12345", "1"], check("amka")) == [None, "amka_format"]
    assert col(spark, ["GR" + "1" * 25, "GR1"], check("iban_gr")) == [None, "iban_format"]
    assert col(spark, ["B-afm", "I-afm", "afm"], greek.without_bio) == ["afm"] * 3
    assert col(spark, ["Ορίστε:\n\n- «Καλημέρα σας»\nάλλο", "  ", None], greek.unwrapped) == ["Καλημέρα σας", "", ""]


@pytest.mark.parametrize(("category", "value", "count"), [("amka", "01019012345", 3), ("afm", "123456789", 3), ("adt", "ΑΒ 123456", 4), ("iban_gr", "GR" + "1234567890" * 2 + "12345", 2), ("private_phone", "6912345678", 3), ("amka", "1", 1), ("cvv", "123", 1)])
def test_other_spellings(spark, category, value, count):
    got = {r.x for r in spark.range(12).select(greek.reformatted(F.lit(category), F.lit(value), F.col("id")).alias("x")).collect()}
    assert len(got) == count
    for x in got - {None}:
        assert re.sub("[^0-9]", "", value) == re.sub("[^0-9]", "", x.replace("+30", ""))


def test_sentences(spark):
    text = "Πρώτη πρόταση εδώ.  Δεύτερη;\nΤρίτη"
    assert col(spark, [text, ""], greek.sentences) == [["Πρώτη πρόταση εδώ.", "Δεύτερη;", "Τρίτη"], []]
    assert col(spark, ["μία δύο τρεις.", "μία δύο", "one two three."], lambda s: greek.usable(s, 5, 40, 3, 0.7, ".!;·")) == [True, False, False]


def test_reports(spark):
    t = spark.createDataFrame([("tp", "a", "a"), ("boundary", "a", "a"), ("hallucinated", None, "b"), ("missed", "b", None)], "kind string, gold_category string, pred_category string")
    got = {r.category: r for r in report.class_report(t).collect()}
    assert (got["a"].precision, got["a"].recall, got["b"].f1) == (0.5, 0.5, 0.0)
    assert (got["(all)"].tp, got["(all)"].missed, round(got["(all)"].f1, 6)) == (1, 1, 0.333333)
    assert report.class_report(t.where("false")).collect() == []
    m = spark.createDataFrame([("detection.f1", "a", 0.5), ("detection.f1", "b", 0.75), ("other", "b", 1.0)], "metric string, variant string, value double")
    d = {r.metric: r.delta for r in report.metric_delta(m, "a", "b").collect()}
    assert len(d) == 6 and d["detection.f1"] == 0.25 and d["detection.span.f1"] == 0.0
    text = report.markdown(spark.createDataFrame([("a", "b", 3)], "gold string, pred string, n int"), spark.createDataFrame([("a", 9)], "category string, score int"))
    assert "| a | 9 |" in text and "| a | b | 3 |" in text


def test_merged_rows(spark):
    kind = "id int, ix int, text string, category string, start int, end int, info map<string,string>"
    rows = [(1, 2, "xy", "b", 1, 2, {"s": "2"}), (1, 1, "xy", "a", 0, 1, {"s": "1"}), (2, 1, "z", "c", 0, 1, None)]
    got = {r.id: r for r in report.merged_rows(spark.createDataFrame(rows, kind), "id", "ix").collect()}
    assert [s.category for s in got[1].label] == ["a", "b"] and got[1].info == {"s": "1"} and got[2].info is None
    with pytest.raises(Exception, match="different texts"):
        report.merged_rows(spark.createDataFrame([*rows, (2, 2, "other", "c", 0, 1, None)], kind), "id", "ix").collect()


def test_merged_rows_keeps_every_entry(spark):
    kind = "id int, ix int, text string, category string, start int, end int, info map<string,string>"
    rows = [(1, 1, "x", "a", 0, 1, {"s": "1"}), (1, 2, "x", "a", 0, 1, {"s": "2", "t": "3"})]
    assert report.merged_rows(spark.createDataFrame(rows, kind), "id", "ix").first().info == {"s": "1", "t": "3"}


def test_labels_and_draws(spark):
    df = spark.createDataFrame([([("b", 5, 6), ("a", 1, 2)],), ([],), (None,)], f"l {LABEL}")
    got = df.select(report.primary_label(F.col("l"), True, "-").alias("s"), report.primary_label(F.col("l"), False, "-").alias("o")).collect()
    assert [tuple(r) for r in got] == [("a", "b"), ("-", "-"), ("-", "-")]
    assert sample.scaled_quotas({"a": 10, "b": 5, "c": 1}, 8) == {"a": 5, "b": 2, "c": 1}
    assert sum(sample.scaled_quotas({"a": 1200, "b": 1800, "c": 700}, 1000).values()) == 1000
    u = spark.range(2000).select(sample.weighted_choice(sample.uniform(1, "id"), {"x": 3, "y": 1}).alias("c")).groupBy("c").count().collect()
    assert 1400 < {r["c"]: r["count"] for r in u}["x"] < 1600


def test_generated(spark):
    rows = greek_identifiers(spark, 200, 4).collect()
    forms = {"amka": r"\d{11}", "afm": r"(EL|ΑΦΜ |Α\.Φ\.Μ\.: )?\d{9}", "adt": r"[Α-Ω]{2} \d{6}", "iban_gr": r"GR\d{25}", "phone": r"(69|21|23)\d{8}", "account": r"\d{10}|\d{12}|\d{14}", "passport": r"[A-Z]{2}\d{7}", "plate": r"[Α-Ω]{3}-\d{4}", "vin": r"[A-HJ-NPR-Z]{10}\d{7}", "gemi": r"\d{12}", "cvv": r"\d{3}", "date": r"\d\d/\d\d/19\d\d", "secret": r"sk-[0-9a-f]{24}"}
    for r in rows:
        for c, p in forms.items():
            assert re.fullmatch(p, r[c]), (c, r[c])
    assert len({r.iban_gr for r in rows}) == 200
    assert col(spark, ["Γιώργος", "Μαρία", "Γιάννης", "Άννα", "Ελένη", "X"], lambda v: inflected(v, "genitive")) == ["Γιώργου", "Μαρίας", "Γιάννη", "Άννας", "Ελένης", "X"]
    assert col(spark, ["Νίκος"], lambda v: inflected(v, "vocative")) == ["Νίκε"]
