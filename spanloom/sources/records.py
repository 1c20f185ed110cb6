"""Readers and writers of labelled records."""

from __future__ import annotations

import json
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import digests

RECORD = "text string, label array<struct<category:string,start:int,end:int>>, info map<string,string>"
MODES = {"strict": "FAILFAST", "skip": "DROPMALFORMED", "keep": "PERMISSIVE"}


def read_jsonl(spark: SparkSession, path: str, schema: str = RECORD, bad: str = "strict") -> DataFrame:
    """JSON lines; blank lines are skipped, bad ones fail, are skipped or are kept as nulls."""
    return spark.read.schema(schema).option("mode", MODES[bad]).json(path)


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header or JSON lines, by suffix."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if path.endswith((".jsonl", ".json")):
        return spark.read.json(path)
    raise ValueError(f"neither CSV nor JSON lines: {path}")


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are JSON objects with text or sentence, or plain text; empty ones go."""
    v = F.trim("value")
    text = F.coalesce(F.get_json_object(v, "$.text"), F.get_json_object(v, "$.sentence"), v)
    return spark.read.text(path).select(text.alias("text")).where("text <> ''")


#: A benchmark case and a triage result's spans.
CASE = "id string, register string, text string, spans array<struct<label:string,text:string,start:int,end:int>>"
CHAT = "messages array<struct<role:string,content:string>>"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASE).json(path)


def read_batches(spark: SparkSession, folder: str, pattern: str = "cases_batch*.jsonl", schema: str = CASE) -> DataFrame:
    """All batches of a folder whose names match, with the batch's name."""
    rows = spark.read.schema(schema).option("pathGlobFilter", pattern).json(folder)
    return rows.withColumn("batch", F.element_at(F.split(F.input_file_name(), "/"), -1))


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A report: one JSON document over many lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_label_space(spark: SparkSession, path: str, strict: bool = False) -> list[str]:
    """Labels of a label space without O, sorted: an object with classes, span_class_names or labels, or a bare list.

    ``strict``: the list as it stands, which must begin with O and hold each name once.
    """
    content = spark.read.text(path, wholetext=True).first().value
    found = json.loads(content)
    if isinstance(found, dict):
        found = next((found[k] for k in ("classes", "span_class_names", "labels") if k in found), None)
    if not isinstance(found, list) or not all(isinstance(x, str) and x.strip() for x in found):
        raise ValueError(f"no list of labels: {path}")
    if strict:
        if not found or found[0] != "O" or len(set(found)) < len(found):
            raise ValueError(f"labels must begin with O and differ: {path}")
        return found
    return sorted({x for x in found if x != "O"})


def read_chat(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Chat records, the first ``most`` if given."""
    rows = spark.read.schema(CHAT).json(path)
    return rows.limit(most) if most else rows


def read_config(spark: SparkSession, path: str) -> dict:
    """A configuration as JSON, or as YAML where that can be parsed here."""
    content = spark.read.text(path, wholetext=True).first().value
    if path.endswith(".json"):
        return json.loads(content)
    try:
        import yaml
    except ImportError as error:
        raise ValueError(f"no YAML parser for {path}") from error
    return yaml.safe_load(content)


def manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, size_bytes, sha256, line_count and error of each file; a named file that isn't there has only its path and an error.

    Patterns and folders stand for the files in them.  Each file is one task, which
    reads it by blocks, so files may be of any size.
    """
    found = []
    for p in [path] if isinstance(path, str) else path:
        here = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.globStatus(here) or []:
            own = [s for s in fs.listStatus(status.getPath()) if s.isFile()] if status.isDirectory() else [status]
            found += [s.getPath().toString() for s in own if not s.getPath().getName().startswith(("_", "."))]
        if not fs.globStatus(here):
            found.append(p)
    return digests(spark, found)


def commit_state(folder: str) -> dict:
    """The commit of a git folder and whether it has changes; nulls outside of git."""
    run = lambda *args: subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True)
    head, changes = run("rev-parse", "HEAD"), run("status", "--porcelain")
    return {"commit": head.stdout.strip() or None, "dirty": bool(changes.stdout.strip()) if changes.returncode == 0 else None}


def write_jsonl(df: DataFrame, path: str, files: int | None = None, order: str | list[str] | None = None) -> None:
    """JSON lines in UTF-8, nulls left out; in ``files`` files if given.

    With ``order`` the files, by name, hold the rows in it: rows are dealt by its
    ranges and sorted in each, so no task holds them all.  A column ``seq`` that
    alone gives the order is not written.
    """
    if order:
        by = [order] if isinstance(order, str) else list(order)
        dealt = df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)
        df = dealt.sortWithinPartitions(*by)
        df = df.drop("seq") if by == ["seq"] else df
    elif files:
        df = df.coalesce(files)
    df.write.mode("errorifexists").json(path)


def sibling(path: str, suffix: str = "_clean") -> str:
    """The path beside ``path`` with ``suffix`` before its extension."""
    head, dot, tail = path.rpartition(".")
    return f"{head}{suffix}.{tail}" if dot and "/" not in tail else path + suffix


def report_json(**parts: DataFrame) -> str:
    """Report tables as one JSON document; for tables of a fixed number of rows."""
    out = {name: [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).collect()] for name, df in parts.items()}
    return json.dumps(out, ensure_ascii=False, indent=2)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder of JSON lines per split."""
    df.write.partitionBy("split").mode("errorifexists").json(path)
