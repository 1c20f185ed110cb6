"""Lines of text files with the number that reading them one after another gives, found without reading them one after another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .records import MODES, RECORD


def numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, line (from 0 in its file), seq (from 0 over all files) and value of every line, empty ones too.

    Files are in the order of ``path`` where that is a list, and by name within
    each entry.  Every split of a file counts its own lines; sums of the splits
    before it, a small table, place them.
    """
    rows = None
    for k, p in enumerate([path] if isinstance(path, str) else path):
        one = spark.read.text(p).select(F.lit(k).alias("entry"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        raise ValueError("no path")
    return placed(rows, ["entry", "file"], "block", "at").select("file", "line", "seq", "value")


def placed(rows: DataFrame, file: list[str], block: str, at: str) -> DataFrame:
    """``rows`` with line and seq, by the order of their files, of a file's blocks and of ``at`` within a block.

    ``at`` rises by one from row to row of a block.
    """
    splits = rows.groupBy(*file, block).agg(F.count("*").alias("n"), F.min(at).alias("first"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = splits.groupBy(*file).agg(F.sum("n").alias("n"))
    files = files.select(*[F.col(c).alias(f"{c}_f") for c in file], before(Window.orderBy(*file)).alias("files_before"))
    inside = splits.select(*file, F.col(block).alias("block_s"), "first", before(Window.partitionBy(*file).orderBy(block)).alias("lines_before"))
    starts = inside.join(files, [F.col(c) == F.col(f"{c}_f") for c in file]).select(*[F.col(c).alias(f"{c}_s") for c in file], "block_s", (F.col("lines_before") - F.col("first")).alias("to_line"), "files_before")
    line = F.col(at) + F.col("to_line")
    joined = rows.join(starts, [*[F.col(c) == F.col(f"{c}_s") for c in file], F.col(block) == F.col("block_s")])
    return joined.select(*rows.columns, line.alias("line"), (line + F.col("files_before")).alias("seq"))


def blank(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " ")) == ""


def read_ordered(spark: SparkSession, path: str | list[str], schema: str = RECORD, bad: str = "strict") -> DataFrame:
    """Records of JSON lines with seq, file and line; blank lines are skipped but counted.

    Bad lines fail, are skipped or are kept with null fields, as ``bad`` says
    (strict, skip or keep); they are counted too.
    """
    rows = numbered(spark, path).where(~blank(F.col("value")))
    mode = {"mode": "FAILFAST" if bad == "strict" else "PERMISSIVE", "columnNameOfCorruptRecord": "bad_line_"}
    if bad not in MODES:
        raise ValueError(f"bad is one of {', '.join(MODES)}")
    parsed = rows.select("seq", "file", "line", F.from_json("value", f"{schema}, bad_line_ string", mode).alias("r"))
    if bad == "skip":
        parsed = parsed.where("r.bad_line_ is null")
    return parsed.select("seq", "file", "line", "r.*").drop("bad_line_")
