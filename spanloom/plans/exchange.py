"""Queries that write tables in the formats that records are handed on in and read them again, with their SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from ..functions import greek
from ..functions.spans import NEEDED, PATTERNS, all_spans
from ..operators import render, report, sample, validate
from ..operators.greedy import detected_by
from ..sources import records
from ..sources.blocks import digests
from ..sources.storage import scratch
from .catalogue import W, docs, query, ratio_split, read
from .curation import labelled
from .matching import matched, walk

_SAFE = r"replace(replace(text, chr(13), ' '), chr(0), ' ')"


@query(f"SELECT doc_id, lang, md5({_SAFE}) AS text_md5, 'csv' AS form FROM documents WHERE text <> '' UNION ALL SELECT doc_id, lang, md5({_SAFE}), 'jsonl' FROM documents WHERE text <> ''")
def exchanged_rows(spark, d):
    """Documents as CSV with a header, line breaks and quotes in their texts, and as JSON lines."""
    at = scratch(spark, "rows")
    rows = docs(spark, d).where("text <> ''").select("doc_id", "lang", F.translate("text", "\r\0", "  ").alias("text"))
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(f"{at}/rows.csv")
    rows.write.json(f"{at}/rows.jsonl")
    one = lambda form: records.read_rows(spark, f"{at}/rows.{form}").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.md5("text").alias("text_md5"), F.lit(form).alias("form"))
    return one("csv").unionByName(one("jsonl"))


@query(r"""WITH l AS (SELECT trim(replace(unnest(string_split(text, chr(10))), chr(13), ' ')) AS line FROM documents) SELECT md5(line) AS line_md5, count(*) AS n FROM l WHERE line <> '' GROUP BY 1""")
def exchanged_sentences(spark, d):
    """Lines of documents as plain text, as objects with text and as objects with sentence, read alike."""
    at = scratch(spark, "sentences")
    line = docs(spark, d).select("doc_id", F.posexplode(F.split(F.translate("text", "\r", " "), "\n")).alias("k", "line")).select("k", F.trim("line").alias("line"))
    kind = F.when(F.col("line").startswith("{"), 1).otherwise(F.col("k") % 3)
    shown = F.when(kind == 0, F.col("line")).when(kind == 1, F.to_json(F.struct(F.col("line").alias("text")))).otherwise(F.to_json(F.struct(F.lit(1).alias("id"), F.col("line").alias("sentence"))))
    line.select(shown.alias("value")).write.text(at)
    return records.read_sentences(spark, at).groupBy(F.md5("text").alias("line_md5")).agg(F.count("*").alias("n"))


@query(W + """SELECT concat('cases_batch', CAST(n_chars % 3 AS VARCHAR)) AS batch, CAST(doc_id AS VARCHAR) AS id, lang AS register, count(*) AS spans, CAST(sum("end" - "start") AS BIGINT) AS characters FROM gold JOIN documents USING (doc_id) GROUP BY ALL""")
def exchanged_cases(spark, d):
    """Benchmark cases in three batches with the spans' texts and offsets; other files beside them aren't read."""
    at = scratch(spark, "cases")
    s = docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("register"), "text", (F.col("n_chars") % 3).alias("b"), all_spans(F.col("text")).alias("s")).where("size(s) > 0")
    cases = s.select("id", "register", "text", "b", F.transform("s", lambda x: F.struct(x["category"].alias("label"), x["value"].alias("text"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))
    cases.write.partitionBy("b").json(at)
    got = None
    for b in range(3):
        one = records.read_cases(spark, f"{at}/b={b}").withColumn("batch", F.lit(f"cases_batch{b}"))
        got = one if got is None else got.unionByName(one)
    return got.select("batch", "id", "register", F.size("spans").cast("long").alias("spans"), F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("characters"))


@query("""SELECT conv_id, CAST(turn AS INTEGER) AS turn, role, md5(text) AS text_md5 FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text FROM conversations)""")
def exchanged_chats(spark, d):
    """Conversations as chat records of JSON lines."""
    at = scratch(spark, "chats")
    m = read(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    turns = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    first = F.array(F.struct(F.lit("id").alias("role"), F.col("conv_id").cast("string").alias("content")))
    records.write_jsonl(m.select(F.concat(first, turns).alias("messages")), at)
    got = records.read_chat(spark, at)
    return got.select(F.get("messages", F.lit(0))["content"].cast("long").alias("conv_id"), F.posexplode(F.slice("messages", F.lit(2), F.size("messages"))).alias("turn", "x")).select("conv_id", "turn", "x.role", F.md5("x.content").alias("text_md5"))


@query("SELECT split, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS characters FROM (SELECT doc_id, n_chars, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (ORDER BY md5(concat('42:', doc_id)), doc_id) AS rn, count(*) OVER () AS n FROM documents)) GROUP BY 1")
def exchanged_splits(spark, d):
    """A folder of JSON lines for each split, read again with the clean folder beside it left alone."""
    at = records.sibling(scratch(spark, "splits"), "_clean")
    t = docs(spark, d).select("doc_id", "n_chars", "text")
    records.write_splits(t.join(ratio_split(spark, d), "doc_id"), at)
    return spark.read.schema("doc_id long, n_chars long, split string").json(at).groupBy("split").agg(F.count("*").alias("n"), F.sum("n_chars").alias("characters"))


@query("""SELECT lang, CAST(sum(octet_length(encode(t)) + 1) AS BIGINT) AS size_bytes, CAST(sum(length(t) - length(replace(t, chr(10), '')) + 1) AS BIGINT) AS line_count, 0::BIGINT AS missing FROM (SELECT lang, text AS t FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL) GROUP BY 1""")
def exchanged_files(spark, d):
    """Sizes and lines of files of text, a folder for each language, read by blocks."""
    at = scratch(spark, "files")
    docs(spark, d).where("text is not null and lang is not null").select("lang", F.col("text").alias("value")).write.partitionBy("lang").text(at)
    found = [f for lang in spark.read.text(at).select("lang").distinct().collect() for f in spark.read.text(f"{at}/lang={lang.lang}").inputFiles()]
    got = digests(spark, found)
    return got.groupBy(F.regexp_extract("path", "/lang=([^/]*)/", 1).alias("lang")).agg(F.sum("size_bytes").alias("size_bytes"), F.sum("line_count").alias("line_count"), F.count_if(F.col("sha256").isNull() | F.col("error").isNotNull()).alias("missing"))


@query("SELECT 'lang' AS part, lang AS name, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL")
def exchanged_report(spark, d):
    """Counts as one JSON document over many lines, read again."""
    at = scratch(spark, "report")
    count = lambda c: docs(spark, d).groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n"))
    text = records.report_json(lang=count("lang"), source=count("source"))
    spark.createDataFrame([(text,)], "value string").write.text(at)
    entry = "array<struct<name:string,n:long>>"
    got = records.read_document(spark, at, f"lang {entry}, source {entry}")
    return got.select(F.lit("lang").alias("part"), F.inline("lang")).unionByName(got.select(F.lit("source").alias("part"), F.inline("source")))


@query(W + "SELECT DISTINCT category AS label, 'sorted' AS form FROM gold UNION ALL SELECT DISTINCT category, 'strict' FROM gold UNION ALL SELECT 'O', 'strict'")
def exchanged_label_space(spark, d):
    """The classes that the documents' spans have as a label space, read sorted without O and strictly as it stands."""
    at = scratch(spark, "space")
    found = sorted(r.category for r in docs(spark, d).select(F.explode(all_spans(F.col("text"))).alias("s")).select("s.category").distinct().collect())
    spark.createDataFrame([(json.dumps({"span_class_names": ["O", *found]}),)], "value string").write.text(f"{at}.json")
    rows = [(x, "sorted") for x in records.read_label_space(spark, f"{at}.json")] + [(x, "strict") for x in records.read_label_space(spark, f"{at}.json", strict=True)]
    return spark.createDataFrame(rows, "label string, form string")


@query(walk("pred_first", "SELECT concat_ws(chr(9), category, tp, boundary, confusion, missed, hallucinated, tp + boundary + confusion + missed, tp + boundary + confusion + hallucinated) AS line FROM (SELECT coalesce(gc, pc) AS category, count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'boundary') AS boundary, count(*) FILTER (kind = 'confusion') AS confusion, count(*) FILTER (kind = 'missed') AS missed, count(*) FILTER (kind = 'hallucinated') AS hallucinated FROM t GROUP BY 1)"))
def report_lines(spark, d):
    """Counters of every class as lines of values between tabs."""
    c = report.counters(matched(spark, d, "pred_first")).select("category", *report.KINDS, "n_gold", "n_pred")
    return spark.createDataFrame([(x,) for x in report.as_tsv(c).split("\n")[1:] if x], "line string")


@query(W + """SELECT lang, count(*) AS records, count(*) FILTER (n > 0 AND n_chars % 3 = 0) AS empty FROM (SELECT doc_id, lang, n_chars, count(*) AS n FROM gold JOIN documents USING (doc_id) GROUP BY ALL) GROUP BY lang""")
def empty_spans(spark, d):
    """Records with a span that holds nothing: the last of a third of the records is cut to nothing."""
    x = labelled(spark, d).join(docs(spark, d).select("doc_id", "lang", "n_chars"), "doc_id")
    cut = F.transform("label", lambda s, k: F.struct(s["category"].alias("category"), s["start"].alias("start"), F.when((F.col("n_chars") % 3 == 0) & (k == F.size("label") - 1), s["start"]).otherwise(s["end"]).alias("end")))
    x = x.withColumn("label", cut)
    bad = validate.empty_values(x).select("doc_id", F.lit(True).alias("bad"))
    return x.join(bad, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("records"), F.count("bad").alias("empty"))


@query(W + """SELECT doc_id, CASE kind WHEN 0 THEN 'ok' WHEN 1 THEN 'bad_category' WHEN 2 THEN 'bad_offsets' WHEN 3 THEN 'invalid_offsets' WHEN 4 THEN 'duplicate_span' WHEN 5 THEN 'empty_span' ELSE 'bad_span_shape' END AS reason
FROM (SELECT DISTINCT doc_id, n_chars % 7 AS kind FROM gold JOIN documents USING (doc_id))""")
def span_reasons(spark, d):
    """The first reason against records whose first span is broken in one of six ways, their texts set in Greek."""
    x = labelled(spark, d).join(docs(spark, d).select("doc_id", "n_chars"), "doc_id")
    kind, first = F.col("n_chars") % 7, F.get("label", F.lit(0))
    span = lambda c, a, b: F.struct(c.alias("category"), a.alias("start"), b.alias("end"))
    none = F.lit(None).cast("int")
    broken = (
        F.when(kind == 1, span(F.lit(None).cast("string"), first["start"], first["end"])).when(kind == 2, span(first["category"], none, first["end"])).when(kind == 3, span(first["category"], first["end"], first["start"]))
        .when(kind == 4, first).when(kind == 5, span(first["category"], F.lit(0), F.lit(1))).when(kind == 6, F.lit(None))
    )
    label = F.when(kind == 0, F.col("label")).when(kind == 4, F.concat(F.array(first), F.col("label"))).otherwise(F.concat(F.array(broken), F.col("label")))
    # A space before a Greek text of the same length, in which the offsets still lie.
    text = F.concat(F.lit(" "), F.repeat(F.lit("α"), F.length("text") - 1))
    return x.select("doc_id", greek.record_reason(text, label, 1, 10**9).alias("reason"))


@query(W + 'SELECT doc_id, category, "start", "end", value FROM gold')
def detected_outside(spark, d):
    """Spans from a detector that runs in the executors, a few texts at a time."""
    patterns = {c: re.compile(p) for c, p in PATTERNS.items()}
    find = lambda texts: [[(c, m.start(), m.end()) for c, p in patterns.items() if NEEDED.get(c, "") in t for m in p.finditer(t)] for t in texts]
    return detected_by(docs(spark, d), find, 64)


@query("""WITH n AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1), s AS (SELECT lang, n, greatest(1, round_even(n * 100.0::DOUBLE / sum(n) OVER (), 0)) AS q FROM n),
o AS (SELECT *, 100 - sum(q) OVER () AS off, row_number() OVER (ORDER BY q DESC, lang) AS r FROM s) SELECT lang, CAST(q + CASE WHEN off > 0 AND r <= off THEN 1 WHEN off < 0 AND r <= -off THEN -1 ELSE 0 END AS BIGINT) AS quota FROM o""")
def language_quotas(spark, d):
    """A hundred places in proportion to the languages' documents."""
    n = {r.lang: r.n for r in docs(spark, d).where("lang is not null").groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    return spark.createDataFrame(list(sample.scaled_quotas(n, 100).items()), "lang string, quota long")


@query(W + """SELECT doc_id, string_agg(category, ',' ORDER BY category, "start") AS labels, coalesce(arg_min(category, (category, "start")), '_no_label') AS first_listed FROM documents LEFT JOIN (SELECT doc_id, category, "start" FROM gold) USING (doc_id) GROUP BY doc_id""")
def listed_label(spark, d):
    """The label that is listed first, whatever its place in the text."""
    s = F.array_sort(all_spans(F.col("text")), lambda a, b: F.when(a["category"] < b["category"], -1).when(a["category"] > b["category"], 1).otherwise(a["start"] - b["start"]))
    return docs(spark, d).select("doc_id", F.when(F.size(s) > 0, F.array_join(F.transform(s, lambda x: x["category"]), ",")).alias("labels"), report.primary_label(s, False, "_no_label").alias("first_listed"))




_WORDS = {"email": {"long": "e-mail address", "short": "mail"}, "phone": {"long": "telephone", "short": "tel."}, "ipv4": {"long": "address"}, "card": {"long": "card number", "short": "card"}}
_SHARES = {"long": 0.5, "short": 0.3, "bare": 0.2}


@query(W + """, w(category, mode, word) AS (VALUES ('email', 'long', 'e-mail address'), ('email', 'short', 'mail'), ('phone', 'long', 'telephone'), ('phone', 'short', 'tel.'), ('ipv4', 'long', 'address'), ('card', 'long', 'card number'), ('card', 'short', 'card')),
x AS (SELECT concat(doc_id, '-', "start") AS ix, category, value, CAST(('0x' || left(md5(concat('51:', category, doc_id, '-', "start")), 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u, CAST(('0x' || left(md5(concat('52:', category, ':', doc_id, '-', "start")), 12)) AS BIGINT) % 3 AS s FROM gold WHERE category <> 'secret'),
y AS (SELECT *, CASE WHEN u < 0.5 THEN 'long' WHEN u < 0.8 THEN 'short' ELSE 'bare' END AS mode FROM x),
z AS (SELECT y.*, coalesce(word || [': ', ' ', ' - '][s + 1], '') AS before FROM y LEFT JOIN w USING (category, mode))
SELECT ix, category, mode, before || value || '.' AS text, CAST(length(before) AS INTEGER) AS "start", CAST(length(before) + length(value) AS INTEGER) AS "end" FROM z""")
def announced_spans(spark, d):
    """Every value found in the documents behind a word that announces one of its class, or none."""
    s = docs(spark, d).select("doc_id", F.explode(all_spans(F.col("text"))).alias("s"))
    rows = s.select(F.concat(F.col("doc_id").cast("string"), F.lit("-"), F.col("s.start").cast("string")).alias("ix"), "s.category", "s.value")
    a = render.announced_values(rows, _WORDS, _SHARES, 51)
    return a.select("ix", "category", "mode", "text", F.get("label", F.lit(0))["start"].alias("start"), F.get("label", F.lit(0))["end"].alias("end"))
