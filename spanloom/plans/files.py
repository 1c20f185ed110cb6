"""Queries that write the documents as files of JSON lines and read them in file order, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.spans import normal
from ..operators import curate
from ..sources.ordered import read_ordered
from ..sources.storage import scratch
from .catalogue import _NORM, docs, query

#: Lines of each document in digest order: itself, for some an empty line, for some one that isn't JSON.
_LINES = """lines AS (SELECT doc_id, text, k, row_number() OVER (ORDER BY md5(concat('21:', doc_id)), k) - 1 AS seq FROM documents, (VALUES (0), (1), (2)) v(k) WHERE k = 0 OR k = 1 AND n_chars % 5 = 0 OR k = 2 AND n_chars % 7 = 0)"""


@query(f"WITH {_LINES} SELECT doc_id, seq, row_number() OVER (PARTITION BY md5({_NORM.format('text')}) ORDER BY seq) = 1 AS first FROM lines WHERE k = 0")
def file_order(spark, d):
    """Every document's line number in files that also hold empty and bad lines, and whether its text is the first of its like there."""
    at = scratch(spark, "lines")
    own = F.array(F.to_json(F.struct("doc_id", "text")), F.when(F.col("n_chars") % 5 == 0, ""), F.when(F.col("n_chars") % 7 == 0, "not json"))
    rows = docs(spark, d).select(curate.draw(21, "doc_id").alias("o"), F.posexplode(own).alias("k", "value")).where("value is not null")
    rows.repartitionByRange("o").sortWithinPartitions("o", "k").select("value").write.text(at)
    read = read_ordered(spark, at, "doc_id long, text string", "skip")
    firsts = curate.first_of(read, F.md5(normal(F.col("text"))), "seq").select("seq", F.lit(True).alias("first"))
    return read.select("doc_id", "seq").join(firsts, "seq", "left").select("doc_id", "seq", F.coalesce("first", F.lit(False)).alias("first"))


_SPLIT = "CASE WHEN n_chars % 4 = 0 THEN 2 WHEN n_chars % 4 = 3 THEN 1 ELSE 0 END"


@query(f"""WITH s AS (SELECT doc_id, text, {_SPLIT} AS place, source LIKE '%1' AS added, md5(concat('22:', doc_id)) AS o FROM documents),
n AS (SELECT *, row_number() OVER (ORDER BY place, added, o) - 1 AS seq FROM s)
SELECT doc_id, ['train', 'validation', 'test'][place + 1] AS split, seq FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY seq) AS r FROM n) WHERE r = 1""")
def assembled_files(spark, d):
    """Files of three splits, base before added records, put together: the first of each text in file order stays."""
    at = scratch(spark, "splits")
    rows = docs(spark, d).select("doc_id", "text", F.expr(_SPLIT).alias("at"), F.when(F.col("source").like("%1"), "add").otherwise("base").alias("origin"), curate.draw(22, "doc_id").alias("o"))
    names = ("train", "validation", "test")
    rows = rows.withColumn("split", F.element_at(F.array(*[F.lit(s) for s in names]), F.col("at") + 1)).drop("at")
    dealt = rows.repartitionByRange("split", "origin", "o").sortWithinPartitions("split", "origin", "o").drop("o")
    dealt.write.partitionBy("split", "origin").json(at)
    read = read_ordered(spark, [f"{at}/split={s}/origin={o}" for s in names for o in ("base", "add")], "doc_id long, text string")
    known = read.withColumn("split", F.regexp_extract("file", "/split=([a-z]+)/", 1)).withColumn("origin", F.regexp_extract("file", "/origin=([a-z]+)/", 1))
    return curate.dedup_splits(known, names, "seq").select("doc_id", "split", "seq")
