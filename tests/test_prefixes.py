import random
import time

from pyspark.sql import functions as F

from spanloom.operators.prefixes import audit, counted_by_prefix, with_prefix


def test_first_prefix_in_table_order(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choices("abé", k=rng.randrange(n)))
    values = [(word(7),) for _ in range(400)] + [(None,), ("",)] + [("abab",)] * 300
    for table in ([(word(5), k) for k in range(30)] + [(None, 99)], [("", 5), ("ab", 7), ("ab", 1)], []):
        df = spark.createDataFrame(values, "v0 string")
        p = spark.createDataFrame(table, "prefix string, rank int")
        want = lambda v, table=table: min(((k, x) for x, k in table if x is not None and v is not None and v.startswith(x)), default=(0, None))[1]
        got = with_prefix(df, "v0", p).collect()
        assert sorted(((r.v0, r.prefix) for r in got), key=str) == sorted(((v, want(v)) for (v,) in values), key=str)
        counted = {r.prefix: (r.different, r.n) for r in counted_by_prefix(df, "v0", p).collect()}
        assert counted == {x: (len({v for (v,) in values if v is not None and want(v) == x}), sum(v is not None and want(v) == x for (v,) in values)) for x in {want(v) for (v,) in values if v is not None}}


def test_five_thousand_prefixes(spark):
    p = spark.range(5000).selectExpr("concat('p', id, '-') prefix", "id rank")
    v = spark.range(200_000).selectExpr("concat('p', id % 10000, '-', id) value", "'x' prefix")
    df = with_prefix(v, "value", p)
    began = time.time()
    assert df.where("prefix is not null").count() == 100_000 and time.time() - began < 40
    plan = df._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_audit(spark):
    rows = [("en", "s1"), ("", "s2x"), (None, "q"), ("de", None), ("fr", "s2")]
    known = spark.createDataFrame([("a", "e"), ("a", "de"), ("b", "s")], "field string, prefix string")
    got = {r.field: (r.missing, r.unknown) for r in audit(spark.createDataFrame(rows, "x string, y string"), {"a": F.col("x"), "b": F.col("y"), "c": F.lit(5)}, known).collect()}
    assert got == {"a": (2, 1), "b": (1, 1), "c": (0, 5)}
