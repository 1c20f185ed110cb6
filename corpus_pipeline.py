"""A corpus pipeline of five operators: rejected, repeated and overlapping text goes, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again before the next one; all but the last return the columns of docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import shared_path, table
from spanloom.llm.linededup import remove_lines
from spanloom.llm.neardup import distinct_texts
from spanloom.llm.packing import pack_documents
from spanloom.llm.substring import remove_repeats
from spanloom.llm.toxicity import learn, without_toxic

#: Texts that a task takes to Python at once; Spark's own 64 MB, in the JVM and in the worker of each core, is much of an executor here.
ARROW_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of the session's Arrow batches, unless it has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, ARROW_BYTES)


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars as the text now has them."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, learned from the labels.

    Null and empty texts stay, repeated rows are judged each, by their text alone;
    labels without a document, null ones and an empty table of them teach nothing.
    Whole texts of any length are read.  An empty table gives no rows; columns of
    any name stay.
    """
    small_batches(spark)
    return without_toxic(docs, learn(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that are like an earlier one.

    Every row stays, null texts as they are.  Rows that repeat, with one id and one
    text, are the same document: neither is earlier than the other.  An empty table
    gives no rows; columns of any name stay.
    """
    small_batches(spark)
    return _sized(remove_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays.

    Equal texts are one group, null and empty ones together; different texts of
    one id are different documents, and of rows that repeat one stays.  A row with
    a null id goes if its text, or one like it, has an id.  An empty table gives
    no rows; columns of any name stay.
    """
    small_batches(spark)
    return distinct_texts(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand elsewhere too.

    Every row stays, null texts become empty; what stands in several places goes
    from all of them, in rows that repeat as well.  An empty table gives no rows;
    columns of any name stay.
    """
    small_batches(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = remove_repeats(docs, plain=False, carry=["doc_id", *others])
    return _sized(out.select("doc_id", F.col("kept").alias("text"), *[F.col(f"carried.`{c}`").alias(c) for c in others]).select(*docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document; null and empty texts are one id long.

    Rows that repeat are packed each; an empty table gives no rows; columns other
    than doc_id and text are left out.
    """
    small_batches(spark)
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
