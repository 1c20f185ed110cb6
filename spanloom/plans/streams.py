"""Queries that write in one pass with counts, or as streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import greek
from ..operators.observed import answer_counts, relabel_counts, unparseable_gate, written_with_counts
from ..sources.storage import scratch
from ..streaming.quota import quota_stream
from .catalogue import NUMBERS, greek_values, query
from .curation import _accounts, answers


@query(_accounts(""" SELECT doc_id, n AS n_spans, (SELECT count(*) FROM a) AS records, (SELECT count(*) FROM a WHERE kind = 4) AS parse_drop, (SELECT count(*) FROM a WHERE kind <> 4 AND (found < n OR kind = 3)) AS offset_drop,
 (SELECT count(*) FROM a WHERE kind NOT IN (3, 4) AND found = n) AS kept FROM a WHERE kind NOT IN (3, 4) AND found = n"""))
def kept_answers(spark, d):
    """Answers whose values could all be placed, with the counts that writing them took along."""
    at = scratch(spark, "answers")
    counts = written_with_counts(answers(spark, d), answer_counts("v", "s"), lambda df: df.select("doc_id", F.size("s").cast("long").alias("n_spans")).write.parquet(at), F.col("s").isNotNull())
    kept = spark.read.schema("doc_id long, n_spans long").parquet(at)
    return kept.select("*", *[F.lit(counts[k]).cast("long").alias(k) for k in ("records", "parse_drop", "offset_drop", "kept")])


@query(f"""WITH {NUMBERS}, c AS (SELECT count(*) AS spans, count(*) FILTER (status = 'clean') AS clean, count(*) FILTER (status = 'relabelled') AS relabelled, count(*) FILTER (status = 'unparseable') AS unparseable FROM sized)
SELECT doc_id, k, CAST(shift AS INTEGER) AS shift, c.*, unparseable > 0.01 * spans AS over FROM sized, c WHERE status <> 'unparseable'""")
def relabelled_numbers(spark, d):
    """Tax numbers that can be read, written in one pass with the counts of all, and whether those are over the gate."""
    at, fault = scratch(spark, "numbers"), []
    rows = greek_values(spark, d).select("doc_id", "k", greek.nine_digits(F.col("value")).alias("x")).select("doc_id", "k", "x.shift", "x.status")
    counts = written_with_counts(rows, relabel_counts(F.col("status")), lambda df: df.drop("status").write.parquet(at), F.col("shift").isNotNull(), lambda c: fault.append(unparseable_gate()(c)))
    kept = spark.read.schema("doc_id long, k int, shift int").parquet(at)
    return kept.select("*", *[F.lit(counts[c]).cast("long").alias(c) for c in ("spans", "clean", "relabelled", "unparseable")], F.lit(fault[0] is not None).alias("over"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= CASE source WHEN 'src0' THEN 7 WHEN 'src3' THEN 100000 ELSE 20 END")
def quota_by_stream(spark, d):
    """The first documents of each source up to its target, as a stream that remembers counts."""
    at = scratch(spark, "quota")
    # A pattern, as the stream's reader takes a plain path for a folder.
    quota_stream(spark, f"{d}/documents.parque[t]", "doc_id long, source string", "source", {"src0": 7, "src3": 100000}, 20, f"{at}/out", f"{at}/state", order="doc_id", files=1000).awaitTermination()
    return spark.read.schema("doc_id long, source string").parquet(f"{at}/out")
