import hashlib
import random
import time

from pyspark.sql import functions as F

from spanloom.functions.spans import detect
from spanloom.operators import greedy, match, report, sweep
from spanloom.operators.curate import digest_rank, stratified_split
from spanloom.operators.quota import quota_split
from spanloom.operators.resolve import json_spans, numbered_lines, resolve
from spanloom.operators.transform import chunks, splice, transliterate
from spanloom.sources import records
from spanloom.streaming.resume import distinct_stream

VALUES = "array<struct<label:string,value:string>>"


def one(spark, schema, row, *cols):
    return spark.createDataFrame([row], schema).select(*cols).first()


def test_resolve_rules(spark):
    row = ("ab x ab y", [("p", "ab"), ("p", "ab"), ("q", "x"), ("r", "zz")])
    t, v = F.col("t"), F.col("v")
    r = one(spark, f"t string, v {VALUES}", row, resolve(t, v).alias("a"), resolve(t, v, fall_back=True).alias("b"), resolve(t, v, strict=True).alias("c"), resolve(t, v, cursor="none").alias("d"))
    assert [tuple(x) for x in r.a] == [("p", 0, 2), ("p", 5, 7)]
    assert [tuple(x) for x in r.b] == [("p", 0, 2), ("p", 5, 7), ("q", 3, 4)]
    assert r.c is None and [x.start for x in r.d] == [0, 0, 3]


def test_parse(spark):
    good = '[{"label":"a","value":"b"}]'
    for content, want in ((good, [("a", "b")]), (f"so: {good} done", [("a", "b")]), ("none", None)):
        r = one(spark, "c string", (content,), json_spans(F.col("c")).alias("x")).x
        assert (None if r is None else [tuple(y) for y in r]) == want
    assert [tuple(x) for x in one(spark, "c string", ("1. one\nno\n2) two",), numbered_lines(F.col("c")).alias("x")).x] == [(1, "one"), (2, "two")]


def test_transform(spark):
    r = one(spark, "t string, s array<struct<category:string,start:int,end:int,value:string>>", ("call 123 or 4", [("b", 12, 13, "four"), ("a", 5, 8, "9")]), splice(F.col("t"), F.col("s")).alias("x")).x
    assert r.text == "call 9 or four" and [r.text[s.start : s.end] for s in r.spans] == ["9", "four"]
    assert one(spark, "t string", ("Θέση ψ-Ωχ a",), transliterate(F.col("t")).alias("x")).x == "Thesi ps-Och a"
    assert one(spark, "t string", ("One two. Three four! Five",), chunks(F.col("t"), 5, 12).alias("x")).x == ["One two.", "Three four!"]


SPAN = "doc_id long, side int, category string, start int, end int"


def python_rule(gold, pred, rule):
    """The three rules by plain loops over (category, start, end)."""
    over = lambda a, b: max(0, min(a[2], b[2]) - max(a[1], b[1]))
    own, other, used, out = (pred, gold, set(), []) if rule == "pred_first" else (gold, pred, set(), [])
    for i, x in enumerate(own):
        free = [k for k in range(len(other)) if k not in used]
        if rule == "gold_first":
            found = [k for k in free if other[k] == x] or [k for k in free if over(x, other[k])]
        elif rule == "pred_first":
            found = [k for k in free if over(x, other[k]) and 2 * over(x, other[k]) >= min(x[2] - x[1], other[k][2] - other[k][1])]
        else:
            found = sorted((k for k in free if over(x, other[k])), key=lambda k: (-over(x, other[k]), k))
        used.update(found[:1])
        out.append((x, other[found[0]] if found else None))
    out += [(None, other[k]) for k in range(len(other)) if k not in used]
    return [(b, a) if rule == "pred_first" else (a, b) for a, b in out]


def test_greedy_rules_against_loops(spark):
    rng = random.Random(3)
    docs = {}
    for i in range(60):
        one = lambda: (rng.choice("xy"), a := rng.randrange(40), a + rng.choice([0, 1, 3, 8]))
        docs[i] = tuple(sorted((one() for _ in range(rng.randrange(7))), key=lambda s: (s[1], s[2], s[0])) for _ in range(2))
    rows = [(i, side, *s) for i, both in docs.items() for side in (0, 1) for s in both[side]]
    spans = spark.createDataFrame(rows, SPAN)
    for rule in sweep.RULES:
        got = sorted(((r.doc_id, r.gold_category, r.gold_start, r.gold_end, r.pred_category, r.pred_start, r.pred_end) for r in greedy.triage(spans, rule).collect()), key=str)
        want = sorted(((i, *(g or (None,) * 3), *(p or (None,) * 3)) for i, (gold, pred) in docs.items() for g, p in python_rule(gold, pred, rule)), key=str)
        assert got == want, rule
    pairs = sorted(tuple(r) for r in match.overlaps(spans).collect())
    assert pairs == sorted((i, *g, *p) for i, (gold, pred) in docs.items() for g in gold for p in pred if min(g[2], p[2]) > max(g[1], p[1]))


def test_boundary_errors_are_booked(spark):
    spans = spark.createDataFrame([(1, 0, "x", 0, 10), (1, 0, "y", 20, 30), (1, 0, "z", 40, 50), (1, 1, "x", 0, 9), (1, 1, "y", 20, 30), (1, 1, "w", 60, 70)], SPAN)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(report.confusion(greedy.triage(spans, "gold_first"))) == [("(hallucinated)", "w", 1), ("x", "x*boundary", 1), ("y", "y", 1), ("z", "(missed)", 1)]
    p = report.priorities(greedy.triage(spans, "pred_first")).collect()
    assert [(r.category, r.score, r.missed, r.confusion, r.boundary, r.hallucinated) for r in p] == [("z", 3, 1, 0, 0, 0), ("x", 2, 0, 0, 1, 0), ("w", 1, 0, 0, 0, 1)]


def test_hints(spark):
    df = spark.createDataFrame([("mac_address", "x"), ("afm", None), ("cvv", "y"), ("other", "z"), ("other", None)], "a string, b string")
    got = [r.h.split(":")[0] for r in df.select(report.hint(F.col("a"), F.col("b")).alias("h")).collect()]
    assert got == ["qwen_contrastive/mac_vs_ip_vs_vin", "qwen_narrative/afm_administrative", "qwen_contrastive/cvv_technical_or_payment", "contrastive", "small_qwen_narrative_pack"]


def test_many_matches_in_one_text(spark):
    n = 100000
    began = time.time()
    df = spark.createDataFrame([(1, "é1.2.3.4 " * n), (2, None), (3, "none"), (4, "")], "doc_id long, text string")
    got = detect(df, categories=("ipv4",)).agg(F.count("*").alias("n"), F.max("start").alias("last"), F.sum(F.expr("start - 1") % 9).alias("off")).first()
    assert tuple(got) == (n, 9 * (n - 1) + 1, 0) and time.time() - began < 60


def test_records_and_stream(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text":"x","label":[{"category":"c","start":0,"end":1}]}\n\nbad\n')
    assert records.read_jsonl(spark, str(tmp_path / "a.jsonl"), bad="skip").count() == 1
    m = records.manifest(spark, str(tmp_path / "a.jsonl")).first()
    data = (tmp_path / "a.jsonl").read_bytes()
    assert (m.size_bytes, m.line_count, m.sha256) == (len(data), 3, hashlib.sha256(data).hexdigest())
    (tmp_path / "s.txt").write_text('{"sentence":"a"}\nplain\n\n')
    assert [r.text for r in records.read_sentences(spark, str(tmp_path / "s.txt")).collect()] == ["a", "plain"]
    for k in range(2):
        spark.createDataFrame([(1,), (2 + k,)], "id long").write.mode("append").parquet(str(tmp_path / "in"))
        distinct_stream(spark, str(tmp_path / "in"), "id long", ["id"], str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_ranks_and_splits_keep_rows_without_stratum(spark):
    docs = spark.range(500).selectExpr("id as doc_id", "if(id % 10 = 0, null, concat('s', id % 3)) as s", "id % 4 = 0 as hard")
    got = sorted(digest_rank(docs, "s", 3).collect(), key=lambda r: (r.s or "", r.rn))
    for s in (None, "s0", "s1", "s2"):
        own = [r for r in got if r.s == s]
        assert [r.rn for r in own] == list(range(1, len(own) + 1))
        assert [r.doc_id for r in own] == sorted((r.doc_id for r in own), key=lambda i: hashlib.md5(f"3:{i}".encode()).hexdigest())
    split = stratified_split(docs, "s", {"train": 0.8, "test": 0.2}, 3).collect()
    assert len(split) == 500 and sum(r.split == "train" for r in split if r.s is None) == 40
    places = quota_split(docs, "s", "hard", 40, 3).groupBy("s", "split").count().collect()
    assert {r.split: r["count"] for r in places if r.s is None} == {"train": 28, "validation": 6, "test": 4, "hard_test": 2}
    few = quota_split(docs.where("doc_id < 8"), "s", "hard", 40, 3).collect()
    assert len(few) == 8


def test_rank_limit_reaches_the_input(spark):
    docs = spark.range(50).selectExpr("id as doc_id", "'a' as s", "false as hard")
    plan = quota_split(docs, "s", "hard", 20, 1)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2
