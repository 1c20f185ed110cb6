"""Checks of records, cases and datasets: what is wrong, as columns and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.greek import value_problem

_KIND = "coalesce(schema_of_variant({}), '')"
_TEXT = "variant_get(v, '$.text', 'variant')"
_FIRST = "get(filter(transform({}, {}), y -> y IS NOT NULL), 0)"
_SPAN = _FIRST.format(
    "map_entries(variant_get(v, '$.spans', 'map<string,variant>'))",
    "x -> CASE WHEN trim(x.key) = '' THEN 'span_key' WHEN NOT startswith(" + _KIND.format("x.value") + ", 'ARRAY') THEN 'span_list' ELSE "
    + _FIRST.format(
        "variant_get(x.value, '$', 'array<variant>')",
        "o -> CASE WHEN NOT startswith(" + _KIND.format("o") + ", 'ARRAY') THEN 'span_offsets' WHEN size(variant_get(o, '$', 'array<variant>')) <> 2 THEN 'span_offsets' WHEN "
        + _KIND.format("variant_get(o, '$[0]', 'variant')") + " <> 'BIGINT' OR " + _KIND.format("variant_get(o, '$[1]', 'variant')") + " <> 'BIGINT' THEN 'span_offsets'"
        " WHEN NOT (variant_get(o, '$[0]', 'long') >= 0 AND variant_get(o, '$[0]', 'long') < variant_get(o, '$[1]', 'long') AND variant_get(o, '$[1]', 'long') <= n) THEN 'span_range' END",
    ) + " END",
)
_LABEL = _FIRST.format(
    "variant_get(v, '$.label', 'array<variant>')",
    "x -> CASE WHEN NOT startswith(" + _KIND.format("x") + ", 'OBJECT') THEN 'label_entry' WHEN " + _KIND.format("variant_get(x, '$.category', 'variant')") + " <> 'STRING' THEN 'label_category'"
    " WHEN trim(variant_get(x, '$.category', 'string')) = '' THEN 'label_category' WHEN " + _KIND.format("variant_get(x, '$.start', 'variant')") + " <> 'BIGINT' OR " + _KIND.format("variant_get(x, '$.end', 'variant')") + " <> 'BIGINT' THEN 'label_offsets'"
    " WHEN NOT (variant_get(x, '$.start', 'long') >= 0 AND variant_get(x, '$.start', 'long') < variant_get(x, '$.end', 'long') AND variant_get(x, '$.end', 'long') <= n) THEN 'label_range' END",
)
#: Absent and null are alike.
_THERE = "(variant_get(v, '$.{0}', 'variant') IS NOT NULL AND NOT is_variant_null(variant_get(v, '$.{0}', 'variant')))"
_RULE = f"""CASE WHEN v IS NULL THEN 'json' WHEN {_KIND.format(_TEXT)} <> 'STRING' OR trim(regexp_replace(variant_get(v, '$.text', 'string'), '(?U)\\\\s+', ' ')) = '' THEN 'text'
 WHEN NOT {_THERE.format("spans")} AND NOT {_THERE.format("label")} THEN 'no_labels'
 WHEN {_THERE.format("spans")} AND NOT startswith({_KIND.format("variant_get(v, '$.spans', 'variant')")}, 'OBJECT') THEN 'spans' WHEN {_THERE.format("spans")} AND {_SPAN} IS NOT NULL THEN {_SPAN}
 WHEN {_THERE.format("label")} AND NOT startswith({_KIND.format("variant_get(v, '$.label', 'variant')")}, 'ARRAY') THEN 'label' WHEN {_THERE.format("label")} AND {_LABEL} IS NOT NULL THEN {_LABEL}
 WHEN {_THERE.format("info")} AND NOT startswith({_KIND.format("variant_get(v, '$.info', 'variant')")}, 'OBJECT') THEN 'info' END"""


def whole_json(text: Column) -> Column:
    """A text that is one JSON value and nothing more, as a variant; else null."""
    v = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant"))


def line_rules(lines: DataFrame, line: str = "value") -> DataFrame:
    """``lines`` and rule: the first rule that a JSON record breaks, null if it breaks none.

    A record has a text that isn't blank, spans (an object of ``[start, end]``
    lists) or label (a list of objects category, start, end) and perhaps an object
    info; offsets are whole numbers, not booleans, with 0 <= start < end <= length.
    """
    v = lines.withColumn("v", whole_json(F.col(line)))
    n = v.withColumn("n", F.expr("length(variant_get(v, '$.text', 'string'))"))
    return n.withColumn("rule", F.expr(_RULE)).drop("v", "n")


def validated(lines: DataFrame, line: str = "value") -> DataFrame:
    """The lines that aren't blank; a query fails on the first that breaks a rule, and here if there is none at all."""
    some = lines.where(F.trim(line) != "")
    if some.isEmpty():
        raise ValueError("no record besides blank lines")
    ruled = line_rules(some, line)
    bad = F.raise_error(F.concat(F.lit("record breaks rule "), F.col("rule"), F.lit(": "), F.substring(line, 1, 80)))
    return ruled.withColumn(line, F.when(F.col("rule").isNotNull(), bad).otherwise(F.col(line))).drop("rule")


def span_problem(text: Column, span: Column, known: tuple[str, ...]) -> Column:
    """What is wrong with a labelled span: an unknown label, invalid offsets or a malformed value; null if nothing."""
    value = F.substr(text, span["start"] + 1, span["end"] - span["start"])
    return (
        F.when(span["category"].isNull(), "category").when(~span["category"].isin(*known), "unknown_label").when(span["start"].isNull() | span["end"].isNull(), "offset_type")
        .when((span["start"] < 0) | (span["end"] > F.length(text)) | (span["start"] >= span["end"]), "offsets").otherwise(value_problem(span["category"], value))
    )


def dataset_report(records: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """measure, name, n: records, empty ones, spans, spans by label and problems by kind; ``records`` has text and label."""
    s = records.select("text", F.explode("label").alias("s")).select(F.col("s.category").alias("category"), span_problem(F.col("text"), F.col("s"), known).alias("problem"))
    totals = records.agg(F.count("*").alias("records"), F.count_if(F.coalesce(F.size("label"), F.lit(0)) <= 0).alias("empty"), F.sum(F.greatest(F.coalesce(F.size("label"), F.lit(0)), F.lit(0))).cast("long").alias("spans"))
    one = totals.select(F.inline(F.array(*[F.struct(F.lit("total").alias("measure"), F.lit(c).alias("name"), F.coalesce(c, F.lit(0)).alias("n")) for c in ("records", "empty", "spans")])))
    by = lambda c, m: s.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).select(F.lit(m).alias("measure"), F.col(c).alias("name"), "n")
    return one.unionByName(by("category", "label")).unionByName(by("problem", "problem"))


def outside_labels(labels: DataFrame, by: str, known: tuple[str, ...]) -> DataFrame:
    """Per ``by``: the labels that the label space lacks, sorted; all offenders at once."""
    return labels.where(F.col("category").isNotNull() & ~F.col("category").isin(*known)).groupBy(by).agg(F.sort_array(F.collect_set("category")).alias("unknown"))


def record_labels(v: Column) -> Column:
    """Labels of a record as a variant, from label, spans as an object and spans as a list of label or category."""
    of = lambda c: F.coalesce(F.try_variant_get(v, f"$.{c}", "array<struct<category:string,label:string>>"), F.array().cast("array<struct<category:string,label:string>>"))
    listed = F.transform(F.concat(of("label"), of("spans")), lambda x: F.coalesce(x["label"], x["category"]))
    keys = F.coalesce(F.map_keys(F.try_variant_get(v, "$.spans", "map<string,variant>")), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.filter(listed, lambda x: x.isNotNull()), F.transform(keys, lambda k: F.trim(F.substring_index(k, ":", 1)))))


def case_problems(cases: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """id, problem, n of cases (id, text, spans as structs label, text): duplicate_id, not_found or unknown_label."""
    twice = cases.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate_id").alias("problem"), "n")
    s = cases.select("id", "text", F.explode("spans").alias("s")).select("id", F.when(~F.col("s.label").isin(*known), "unknown_label").when(F.col("s.text").isNull() | (F.expr("locate(s.text, text)") == 0), "not_found").alias("problem"))
    return twice.unionByName(s.where("problem is not null").groupBy("id", "problem").agg(F.count("*").alias("n")))


def empty_values(records: DataFrame) -> DataFrame:
    """Records with a span whose value is empty."""
    return records.where(F.exists("label", lambda s: F.coalesce(F.length(F.substr(F.col("text"), s["start"] + 1, s["end"] - s["start"])), F.lit(0)) == 0))


def histograms(rows: DataFrame, by: str, fields: tuple[str, ...]) -> DataFrame:
    """by, field, value, n: how often each value of each field stands in each group, from one scan; null is (missing)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("(missing)")).alias("value")) for c in fields])
    return rows.select(by, F.inline(pairs)).groupBy(by, "field", "value").agg(F.count("*").alias("n"))


def asserted(records: DataFrame, prefixes: tuple[str, ...]) -> DataFrame:
    """Generated records (text, label, value); the query fails where a span isn't its value or the value begins with a prefix."""
    first = F.get("label", F.lit(0))
    same = F.substr(F.col("text"), first["start"] + 1, first["end"] - first["start"]) == F.col("value")
    leak = F.lit(False)
    for p in prefixes:
        leak = leak | F.col("value").startswith(p)
    text = F.when(~same, F.raise_error(F.concat(F.lit("span isn't its value: "), "value"))).when(leak, F.raise_error(F.concat(F.lit("prefix in value: "), "value"))).otherwise(F.col("text"))
    return records.withColumn("text", text)


def readiness(checks: dict[str, bool]) -> tuple[list[tuple[str, str]], bool]:
    """Named checks as OK or MISSING, and whether all are met."""
    return [(name, "OK" if ok else "MISSING") for name, ok in checks.items()], all(checks.values())


def share_within(rows: DataFrame, group: str, mode: str) -> DataFrame:
    """group, mode, n and its percentage within the group, rounded to one place."""
    from pyspark.sql import Window

    n = rows.groupBy(group, mode).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(group)), 1))


def acceptance(rows: DataFrame, group: str, accepted: Column) -> DataFrame:
    """Per group and, as (all), of all: total, accepted and the percentage accepted, rounded to one place."""
    c = rows.rollup(group).agg(F.grouping(group).alias("every"), F.count("*").alias("total"), F.count_if(accepted).alias("accepted"))
    return c.select(F.when(F.col("every") == 1, "(all)").otherwise(F.col(group)).alias(group), "total", "accepted", F.round(100.0 * F.col("accepted") / F.col("total"), 1).alias("pct"))


def licensed(rows: DataFrame, sources: tuple[tuple[str, str, bool], ...], risky: bool = False) -> DataFrame:
    """Rows of known sources with their licence; those not safe for commercial use only if ``risky``."""
    spark = rows.sparkSession
    dim = spark.createDataFrame(list(sources), "source string, license string, commercial_safe boolean")
    kept = dim if risky else dim.where("commercial_safe")
    return rows.join(F.broadcast(kept.select("source", "license")), "source")
