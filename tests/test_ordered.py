import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import curate
from spanloom.sources.ordered import numbered, placed, read_ordered
from spanloom.sources.records import write_jsonl


@pytest.fixture
def lines(spark, tmp_path):
    """Three files of many splits, with empty, blank and bad lines; their paths and lines in the order of the list."""
    rng, paths, want = random.Random(4), [], []
    for name in ("b", "a", "c"):
        own = [rng.choice(["", "  ", "not json", json.dumps({"text": "τ" * rng.randint(0, 60)}, ensure_ascii=False)]) for _ in range(2000)]
        (tmp_path / f"{name}.jsonl").write_text("".join(x + "\n" for x in own))
        paths.append(str(tmp_path / f"{name}.jsonl"))
        want += own
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    yield paths, want
    spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_same_numbers_as_enumerate(spark, lines):
    paths, want = lines
    df = numbered(spark, paths)
    assert spark.read.text(paths).rdd.getNumPartitions() >= 12
    got = sorted((r.seq, r.value, r.line, r.file) for r in df.collect())
    assert [(s, v) for s, v, *_ in got] == list(enumerate(want))
    assert [line for *_, line, _ in got] == [k for _ in range(3) for k in range(2000)] and [f[-7:] for *_, f in got] == [p[-7:] for p in paths for _ in range(2000)]
    by_name = [x for p in sorted(paths) for x in open(p).read().split("\n")[:-1]]
    assert [r.value for r in numbered(spark, paths[0].rsplit("/", 1)[0]).orderBy("seq").collect()] == by_name


def test_records(spark, lines):
    paths, want = lines
    records = [(k, json.loads(x)["text"]) for k, x in enumerate(want) if x.startswith("{")]
    assert [tuple(r) for r in read_ordered(spark, paths, "text string", "skip").select("seq", "text").orderBy("seq").collect()] == records
    kept = read_ordered(spark, paths, "text string", "keep").orderBy("seq").collect()
    assert [(r.seq, r.text) for r in kept] == [(k, json.loads(x)["text"] if x.startswith("{") else None) for k, x in enumerate(want) if x.strip()]
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        read_ordered(spark, paths, "text string").collect()
    with pytest.raises(ValueError, match="skip"):
        read_ordered(spark, paths, bad="other")
    firsts = {}
    for k, t in records:
        firsts.setdefault(t, k)
    got = curate.first_of(read_ordered(spark, paths, "text string", "skip"), F.col("text"), "seq")
    assert sorted((r.seq, r.text) for r in got.collect()) == sorted((k, t) for t, k in firsts.items())


def test_written_in_order(spark, lines, tmp_path):
    paths, want = lines
    write_jsonl(read_ordered(spark, paths, "text string", "skip").select("seq", "text"), str(tmp_path / "out"), 7, order="seq")
    assert len(list((tmp_path / "out").glob("part-*"))) == 7
    assert [json.loads(r.value) for r in numbered(spark, str(tmp_path / "out")).orderBy("seq").collect()] == [json.loads(x) for x in want if x.startswith("{")]
    df = spark.createDataFrame([(k, k % 3, f"t{k}") for k in range(50)], "seq long, b long, text string")
    write_jsonl(df, str(tmp_path / "two"), 2, order=["b", "seq"])
    assert [json.loads(r.value)["seq"] for r in numbered(spark, str(tmp_path / "two")).orderBy("seq").collect()] == sorted(range(50), key=lambda k: (k % 3, k))


def test_no_lines(spark, tmp_path):
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "one.jsonl").write_text("a\n\nb")
    got = numbered(spark, [str(tmp_path / n) for n in ("empty.jsonl", "one.jsonl", "empty.jsonl", "one.jsonl")]).orderBy("seq").collect()
    assert [(r.seq, r.line, r.value) for r in got] == [(0, 0, "a"), (1, 1, ""), (2, 2, "b"), (3, 0, "a"), (4, 1, ""), (5, 2, "b")]
    with pytest.raises(ValueError, match="no path"):
        numbered(spark, [])


def test_placed(spark):
    """Blocks out of order, numbers that jump between blocks."""
    rows = [("f", 100, 9), ("f", 100, 10), ("f", 0, 500), ("e", 7, 0), ("f", 100, 11)]
    got = placed(spark.createDataFrame(rows, "file string, block long, x long"), ["file"], "block", "x").orderBy("seq").collect()
    assert [(r.file, r.x, r.line, r.seq) for r in got] == [("e", 0, 0, 0), ("f", 500, 0, 1), ("f", 9, 1, 2), ("f", 10, 2, 3), ("f", 11, 3, 4)]


def test_first_sentences(spark):
    from spanloom.operators.sample import first_sentences

    docs = spark.createDataFrame([(3, "d e. f."), (1, "a b. c. x."), (2, None), (0, "")], "doc_id long, text string").repartition(3)
    parts, usable = F.split("text", " (?=[a-z])"), lambda s: F.length(s) > 1
    got = lambda docs_, n: [tuple(r) for r in first_sentences(docs, parts, usable, docs_, n).orderBy("doc_id", "ix").collect()]
    assert got(None, 9) == [(1, 1, "b."), (1, 2, "c."), (1, 3, "x."), (3, 1, "e."), (3, 2, "f.")] and got(None, 4)[-1] == (3, 1, "e.") and got(2, 9) == got(None, 3) and got(1, 9) == []
