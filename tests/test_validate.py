import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import greek
from spanloom.operators import curate, report, transform, validate
from spanloom.sources import records

#: JSON records and the rule that each breaks.
LINES = (
    ('{"text": "abc", "label": [{"category": "x", "start": 0, "end": 3}], "info": {"a": 1}}', None),
    ('{"text": "abc", "label": [{"category": "x", "start": true, "end": 3}]}', "label_offsets"),
    ('{"text": "abc", "label": [{"category": "x", "start": 0, "end": 4}]}', "label_range"),
    ('{"text": "abc", "label": [{"category": " ", "start": 0, "end": 3}]}', "label_category"),
    ('{"text": "abc", "spans": {"x: ab": [[0, 2]]}}', None),
    ('{"text": "abc", "spans": {"x: ab": [[0, 2.5]]}}', "span_offsets"),
    ('{"text": "abc", "spans": {"x: ab": [[2, 2]]}}', "span_range"),
    ('{"text": "abc"}', "no_labels"),
    ('{"text": "  ", "label": []}', "text"),
    ('{"text": 5, "label": []}', "text"),
    ('{"text": "abc", "label": {}}', "label"),
    ('{"text": "abc", "label": [], "info": []}', "info"),
    ("not json", "json"),
    ('{"text": "abc", "label": []}}', "json"),
    ('{"text": "abc", "label": []} 1', "json"),
    ('{"text": "abc", "label": []}, 1', "json"),
)

LABEL = "array<struct<category:string,start:int,end:int>>"


def test_lines_and_datasets(spark):
    df = spark.createDataFrame([(x,) for x, _ in LINES], "value string")
    assert [r.rule for r in validate.line_rules(df).collect()] == [r for _, r in LINES]
    more = [('{"text": "abc", "spans": []}', "spans"), ('{"text": "abc", "spans": {"x": [[0, true]]}}', "span_offsets"), ('{"text": "abc", "spans": {" ": []}}', "span_key"), ('{"text": "abc", "spans": {"x": 1}}', "span_list"), ('{"text": "abc", "label": [1]}', "label_entry"), ('{"text": "abc", "label": null, "spans": null}', "no_labels")]
    assert [r.rule for r in validate.line_rules(spark.createDataFrame([(x,) for x, _ in more], "value string")).collect()] == [r for _, r in more]
    good = spark.createDataFrame([(LINES[0][0],), (" ",)], "value string")
    assert validate.validated(good).count() == 1
    with pytest.raises(ValueError, match="blank"):
        validate.validated(good.where("trim(value) = ''"))
    with pytest.raises(Exception, match="label_range"):
        validate.validated(spark.createDataFrame([(LINES[2][0],)], "value string")).collect()


def test_spans_and_assertions(spark):
    rows = [("x EL123456789", [("afm", 2, 13)], "EL123456789"), ("ab", [("zzz", 0, 1)], "a"), ("ab", [("afm", 0, 1)], "b"), ("ab", [("afm", 1, 9)], "b"), ("GR12", [("iban_gr", 0, 4)], "GR12")]
    df = spark.createDataFrame(rows, f"text string, label {LABEL}, value string")
    got = {(r.measure, r.name): r.n for r in validate.dataset_report(df, ("afm", "iban_gr")).collect()}
    assert got[("problem", "unknown_label")] == got[("problem", "offsets")] == got[("problem", "afm_format")] == got[("problem", "iban_format")] == 1 and got[("total", "spans")] == 5
    assert validate.asserted(df.limit(1), ("ΑΦΜ",)).count() == 1
    for k, why in ((0, "prefix"), (2, "isn't its value")):
        with pytest.raises(Exception, match=why):
            validate.asserted(spark.createDataFrame([rows[k]], df.schema), ("EL",)).collect()
    assert validate.empty_values(spark.createDataFrame([("ab", [("x", 2, 3)]), ("ab", [("x", 0, 1)])], f"text string, label {LABEL}")).count() == 1
    v = spark.createDataFrame([('{"label":[{"category":"a"}],"spans":{"b: x":[]}}',), ('{"spans":[{"label":"c"},{"category":"d"}]}',)], "j string").select(validate.record_labels(F.parse_json("j")).alias("x"))
    assert [sorted(r.x) for r in v.collect()] == [["a", "b"], ["c", "d"]]
    assert validate.readiness({"a": True, "b": False}) == ([("a", "OK"), ("b", "MISSING")], False)
    with pytest.raises(ValueError, match="not to 1"):
        curate.check_ratios({"a": 0.5, "b": 0.4})


def test_sources_and_sinks(spark, tmp_path):
    at = str(tmp_path)
    for k in (2, 1):
        (tmp_path / f"cases_batch{k}.jsonl").write_text(json.dumps({"id": f"c{k}", "register": "r", "text": "ab", "spans": [{"label": "x", "text": "a"}]}) + "\n")
    got = records.read_batches(spark, at).orderBy("batch").collect()
    assert [(r.id, r.batch) for r in got] == [("c1", "cases_batch1.jsonl"), ("c2", "cases_batch2.jsonl")]
    assert records.read_cases(spark, f"{at}/cases_batch1.jsonl").first().spans[0].text == "a"
    (tmp_path / "r.json").write_text('{\n "a": {"b": 1}\n}')
    assert records.read_document(spark, f"{at}/r.json").select("a.b").first().b == 1
    assert records.read_config(spark, f"{at}/r.json") == {"a": {"b": 1}}
    for k, (content, want) in enumerate((('["O", "b", "a"]', ["a", "b"]), ('{"classes": ["b"]}', ["b"]), ('{"span_class_names": ["O", "c"]}', ["c"]), ('{"labels": ["d"]}', ["d"]))):
        (tmp_path / f"l{k}.json").write_text(content)
        assert records.read_label_space(spark, f"{at}/l{k}.json") == want
    assert records.read_label_space(spark, f"{at}/l0.json", strict=True) == ["O", "b", "a"]
    with pytest.raises(ValueError):
        records.read_label_space(spark, f"{at}/l1.json", strict=True)
    chat = spark.createDataFrame([([("user", "é")],), ([("user", "b")],)], records.CHAT)
    records.write_jsonl(chat, f"{at}/chat", 1)
    assert records.read_chat(spark, f"{at}/chat").count() == 2 and records.read_chat(spark, f"{at}/chat", 1).count() == 1
    assert "é" in next((tmp_path / "chat").glob("*.json")).read_text()
    m = {r.path.split("/")[-1]: r for r in records.manifest(spark, [f"{at}/r.json", f"{at}/gone.json"]).collect()}
    assert m["r.json"].line_count == 2 and m["gone.json"].error == "missing"
    assert records.sibling("/a/b.jsonl") == "/a/b_clean.jsonl" and records.sibling("/a.b/c") == "/a.b/c_clean"
    assert set(records.commit_state(at)) == {"commit", "dirty"}
    df = spark.createDataFrame([("a", 1)], "k string, n int")
    assert json.loads(records.report_json(x=df)) == {"x": [{"k": "a", "n": 1}]} and report.as_tsv(df) == "k\tn\na\t1\n"
    (tmp_path / "rows.csv").write_text('text,start\n"a\nb",1\n')
    assert records.read_rows(spark, f"{at}/rows.csv").first().text == "a\nb"
    with pytest.raises(ValueError):
        records.read_rows(spark, f"{at}/rows.txt")
    records.write_splits(df.withColumn("split", F.lit("train")), f"{at}/splits")
    assert (tmp_path / "splits" / "split=train").is_dir()


def test_rewriting(spark):
    rows = [(1, "tel 2101234567, ab", [("private_phone", 4, 14), ("x", 16, 18)]), (2, "plain", []), (3, "x ΑΦΜ 123456789!", [("afm", 6, 15)])]
    df = spark.createDataFrame(rows, f"id int, text string, label {LABEL}")
    out = transform.augmented(df, "id", 4, 1).collect()
    texts = {i: t for i, t, _ in rows}
    assert out and {r.id for r in out} <= {1, 3}
    for r in out:
        assert r.text != texts[r.id]
        values = [r.text[s.start : s.end] for s in r.label]
        assert "".join(c for c in values[0] if c.isdigit()).endswith("2101234567" if r.id == 1 else "123456789") and (r.id == 3 or values[1] == "ab")
    l = spark.createDataFrame([("γράψε στο μαρία@x.gr ή β", [("private_email", 10, 20), ("x", 23, 24)])], f"text string, label {LABEL}").select(transform.latinised(F.col("text"), F.col("label"), F.lit(1), 1, 0.0).alias("x")).first().x
    assert l.text == "γράψε στο maria@x.gr ή β" and [tuple(s) for s in l.spans] == [("private_email", 10, 20), ("x", 23, 24)]
    assert spark.range(1).select(transform.transliterate(F.lit("ἀρχὴ Ὀδός ΰ")).alias("x")).first().x == "archi Odos y"
    bad = spark.createDataFrame([("x", [None])], f"text string, label {LABEL}").select(greek.record_reason(F.lit("Αυτή είναι μια πρόταση αρκετά μεγάλη"), F.col("label")).alias("r")).first().r
    assert bad == "bad_span_shape"


def test_markdown_has_misses(spark):
    t = spark.createDataFrame([("missed", "a", 1, 1, "v", None, None, "around v")], "kind string, label string, r int, doc_id long, expected string, predicted string, overlap_ratio double, context string")
    text = report.markdown(spark.createDataFrame([("a", "b", 3)], "g string, p string, n int"), spark.createDataFrame([("a", 9)], "category string, score int"), t)
    assert "### a" in text and "`v` in `around v`" in text
