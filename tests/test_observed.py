import pytest
from pyspark.sql import functions as F

from spanloom.operators.observed import answer_counts, filter_counts, relabel_counts, unparseable_gate, written_with_counts
from spanloom.operators.resolve import accounted
from spanloom.streaming.quota import progress, quota_stream


def test_counts_of_the_pass_that_writes(spark, tmp_path):
    rows = [(k, [1] if k % 3 else None, [2] if k % 3 and k % 5 else None) for k in range(1000)]
    df = spark.createDataFrame(rows, "id long, v array<int>, s array<int>").repartition(8)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def once(k):
        seen.add(1)
        return k

    got = written_with_counts(df.withColumn("id", once("id").alias("id")), answer_counts("v", "s"), lambda x: x.write.parquet(str(tmp_path / "a")), F.col("s").isNotNull())
    assert got == accounted(df, "v", "s").first().asDict() and spark.read.parquet(str(tmp_path / "a")).count() == got["kept"] and seen.value == 1000
    got = written_with_counts(df, filter_counts(F.col("s").isNotNull(), F.col("v"), F.col("s")), lambda x: x.write.parquet(str(tmp_path / "b")))
    assert got == {"records": 1000, "dropped": sum(r[2] is None for r in rows), "spans": sum(r[1] is not None for r in rows), "removed": sum(r[1] is not None and r[2] is None for r in rows)}
    none = written_with_counts(df.limit(0), answer_counts("v", "s"), lambda x: x.write.parquet(str(tmp_path / "c")))
    assert none == {"records": 0, "parse_drop": 0, "offset_drop": 0, "kept": 0}


def test_gate(spark, tmp_path):
    df = spark.createDataFrame([("clean",)] * 98 + [("unparseable",)] * 2, "status string")
    write = lambda name: lambda x: x.write.parquet(str(tmp_path / name))
    with pytest.raises(ValueError, match="2 of 100"):
        written_with_counts(df, relabel_counts(F.col("status")), write("a"), gate=unparseable_gate())
    assert written_with_counts(df, relabel_counts(F.col("status")), write("b"), gate=unparseable_gate(0.02))["clean"] == 98


def test_a_stream_that_stops_gives_the_same_rows(spark, tmp_path):
    """One uninterrupted run over five files against a run of two files and another of the rest, and one that is stopped while it goes."""
    schema = "id long, source string, text string"
    rows = [(k, ["a", "b", None, "c"][k % 4], f"t{k % 150}") for k in range(1000)]

    def put(folder, *parts):
        for p in parts:
            spark.createDataFrame(rows[200 * p : 200 * p + 200], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / folder))

    def run(folder, name, **more):
        return quota_stream(spark, str(tmp_path / folder), schema, "source", {"a": 30, "b": 10_000}, 20, str(tmp_path / name), str(tmp_path / f"{name}-state"), order="id", **more)

    def result(name):
        return sorted((tuple(r) for r in spark.read.schema(schema).parquet(str(tmp_path / name)).collect()), key=str)

    put("in", 0, 1)
    put("all", 0, 1, 2, 3, 4)
    run("all", "whole").awaitTermination(300)
    run("in", "cut").awaitTermination(300)
    put("in", 2, 3, 4)
    run("in", "cut").awaitTermination(300)
    want = sorted((r for s, n in (("a", 30), ("b", 10_000), (None, 20), ("c", 20)) for r in [x for x in rows if x[1] == s][:n]), key=str)
    assert result("whole") == result("cut") == want
    q = run("all", "stopped")
    q.stop()
    run("all", "stopped").awaitTermination(300)
    assert result("stopped") == want
    assert {r.source: r.n for r in progress(spark.read.schema(schema).parquet(str(tmp_path / "cut")), "source").collect()} == {"a": 30, "b": 250, None: 20, "c": 20}
    run("all", "once", once="text").awaitTermination(300)
    got = result("once")
    assert len({r[2] for r in got}) == len(got) and sum(r[1] == "a" for r in got) <= 30
