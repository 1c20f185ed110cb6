"""Reports over labelled records and matched spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .match import rates

KINDS = ("tp", "boundary", "confusion", "missed", "hallucinated")
#: The metrics that two runs are compared by.
METRICS = ("detection.precision", "detection.recall", "detection.f1", "detection.span.precision", "detection.span.recall", "detection.span.f1")


def class_report(triage: DataFrame) -> DataFrame:
    """Counts by kind and rates of each class and, as (all), of all.

    A boundary or confusion is a false positive and a false negative.  The
    class is the expected one, for hallucinations the predicted one.  Nothing
    matched gives no rows.
    """
    t = triage.select(F.coalesce("gold_category", "pred_category").alias("category"), "kind")
    c = t.rollup("category").agg(F.grouping("category").alias("all"), *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
    wrong = F.col("boundary") + F.col("confusion")
    return c.select(F.when(F.col("all") == 1, "(all)").otherwise(F.col("category")).alias("category"), *KINDS, *rates(F.col("tp"), F.col("hallucinated") + wrong, F.col("missed") + wrong))


def confusion(triage: DataFrame) -> DataFrame:
    """gold_category, pred_category, n with (missed), (hallucinated) and, where only the ends are wrong, '<class>*boundary'."""
    found = F.when(F.col("kind") == "boundary", F.concat("gold_category", F.lit("*boundary"))).otherwise(F.coalesce("pred_category", F.lit("(missed)")))
    return triage.select(F.coalesce("gold_category", F.lit("(hallucinated)")).alias("gold_category"), found.alias("pred_category")).groupBy("gold_category", "pred_category").agg(F.count("*").alias("n"))


def least_f1(triage: DataFrame) -> DataFrame:
    """category, f1 of the class with the lowest F1 among those that are expected at all, the first by name of equals."""
    return class_report(triage).where("category <> '(all)' and tp + boundary + confusion + missed > 0").orderBy("f1", "category").limit(1).select("category", "f1")


def gate_f1(triage: DataFrame, least: float) -> DataFrame:
    """Classes whose F1 is under ``least``; a run passes where there are none."""
    return class_report(triage).where((F.col("category") != "(all)") & (F.col("f1") < least)).select("category", "f1")


def counters(triage: DataFrame) -> DataFrame:
    """A class's five counters, with what they come to as expected and as predicted spans."""
    c = triage.groupBy(F.coalesce("gold_category", "pred_category").alias("category")).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
    own = F.col("tp") + F.col("boundary") + F.col("confusion")
    return c.select("*", (own + F.col("missed")).alias("n_gold"), (own + F.col("hallucinated")).alias("n_pred"))


#: What to record more of, by class and by kind of failure.
HINTS = {
    "private_person": "qwen_narrative/person_vocative_polytonic: surnames, vocatives, titles, two-person messages",
    "private_email": "qwen_contrastive/email_vs_secret: normal email plus adjacent token/key-like strings",
    "private_phone": "qwen_contrastive/phone_vs_account: phone markers and account markers in the same record",
    "mac_address": "qwen_contrastive/mac_vs_ip_vs_vin: network logs with MAC, IP, VIN-like device ids",
}
_PROSE = ("amka", "afm", "ama", "driver_license")
_TECHNICAL = ("ip_address", "imei", "card_pan", "cvv")


def hint(category: Column, other: Column) -> Column:
    """What records a failing class needs; ``other`` is what it is most often taken for, null if nothing."""
    out = F
    for name, text in HINTS.items():
        out = out.when(category == name, text)
    return (
        out.when(category.isin(*_PROSE), F.concat(F.lit("qwen_narrative/"), category, F.lit("_administrative: dense Greek admin prose with nearby numeric confusables")))
        .when(category.isin(*_TECHNICAL), F.concat(F.lit("qwen_contrastive/"), category, F.lit("_technical_or_payment: same-record positive plus numeric confusable")))
        .when(other.isNotNull(), F.concat(F.lit("contrastive: same record contains "), category, F.lit(" and "), other, F.lit(" with explicit local context")))
        .otherwise("small_qwen_narrative_pack: 300-1000 local Qwen records, then ablate")
    )


def priorities(triage: DataFrame) -> DataFrame:
    """Classes by failure score: three for a miss or confusion, two for wrong ends, one for a hallucination.

    Ordered by score, F1 and name; those without failures drop out.  top_confusion
    is what a class is most often taken for, the first by name of equals.
    """
    r = class_report(triage).where("category <> '(all)'")
    w = Window.partitionBy("gold_category").orderBy(F.desc("n"), "pred_category")
    pairs = triage.where("kind = 'confusion'").groupBy("gold_category", "pred_category").agg(F.count("*").alias("n"))
    top = pairs.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("gold_category").alias("category"), F.col("pred_category").alias("top_confusion"))
    score = 3 * F.col("missed") + 3 * F.col("confusion") + 2 * F.col("boundary") + F.col("hallucinated")
    out = r.withColumn("score", score).where("score > 0").join(top, "category", "left")
    return out.select("category", "score", "f1", "precision", "recall", "missed", "confusion", "boundary", "hallucinated", "top_confusion", hint(F.col("category"), F.col("top_confusion")).alias("pack")).orderBy(F.desc("score"), "f1", "category")


def examples(triage: DataFrame, docs: DataFrame, most: int = 8, around: int = 42) -> DataFrame:
    """Up to ``most`` failures of each kind and class in document order, with the texts and what stands around them."""
    own = F.coalesce("gold_start", "pred_start")
    label = F.when(F.col("kind") == "confusion", F.concat("gold_category", F.lit("->"), "pred_category")).otherwise(F.coalesce("gold_category", "pred_category"))
    bad = triage.where("kind <> 'tp'").withColumns({"label": label, "start": own, "end": F.coalesce("gold_end", "pred_end")})
    w = Window.partitionBy("kind", "label").orderBy("doc_id", "start", "end", "pred_start", "pred_end")
    some = bad.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    j = some.join(docs.select("doc_id", "text"), "doc_id")
    cut = lambda a, b: F.expr(f"substring(text, {a} + 1, {b} - {a})")
    context = F.replace(F.expr(f"substring(text, greatest(0, start - {around}) + 1, end + {around} - greatest(0, start - {around}))"), F.lit("\n"), F.lit("\\n"))
    meet = F.greatest(F.lit(0), F.least("gold_end", "pred_end") - F.greatest("gold_start", "pred_start"))
    ratio = F.when(F.col("kind").isin("boundary", "confusion"), F.round(F.try_divide(meet, F.least(F.expr("gold_end - gold_start"), F.expr("pred_end - pred_start"))), 6))
    return j.select("kind", "label", "r", "doc_id", cut("gold_start", "gold_end").alias("expected"), cut("pred_start", "pred_end").alias("predicted"), ratio.alias("overlap_ratio"), context.alias("context"))


def metric_delta(metrics: DataFrame, first: str, second: str, keys: tuple[str, ...] = METRICS) -> DataFrame:
    """metric, baseline, other, delta for each of ``keys`` from rows metric, variant, value; a metric that a run lacks counts 0."""
    k = metrics.sparkSession.createDataFrame([(x,) for x in keys], "metric string")
    of = lambda v: F.max(F.when(F.col("variant") == v, F.col("value")))
    j = k.join(metrics.groupBy("metric").agg(of(first).alias("baseline"), of(second).alias("other")), "metric", "left").na.fill(0.0)
    return j.withColumn("delta", F.round(F.col("other") - F.col("baseline"), 6))


def _first_entries(listed: str) -> Column:
    """Map of the first value of each key in ordered arrays of entries; null without entries."""
    e = F.flatten(F.filter(F.transform(listed, lambda x: x["e"]), lambda x: x.isNotNull()))
    keys = F.transform(e, lambda x: x["key"])
    first = F.filter(e, lambda x, k: F.array_position(keys, x["key"]) == k + 1)
    return F.when(F.size(first) > 0, F.map_from_entries(first))


def merged_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One record per key from a row per span (text, category, start, end, info): spans in order, each info entry's first value.

    Rows of a key whose texts differ fail the query.
    """
    entry = F.struct(order, "category", "start", "end")
    g = rows.groupBy(key).agg(F.min_by("text", order).alias("text"), F.count_distinct(F.coalesce("text", F.lit(""))).alias("texts"), F.sort_array(F.collect_list(entry)).alias("s"), F.sort_array(F.collect_list(F.struct(F.col(order), F.map_entries("info").alias("e")))).alias("i"))
    text = F.when(F.col("texts") > 1, F.raise_error(F.concat(F.lit(f"rows of one {key} have different texts: "), F.col(key).cast("string")))).otherwise(F.col("text"))
    return g.select(key, text.alias("text"), F.transform("s", lambda x: F.struct(x["category"].alias("category"), x["start"].alias("start"), x["end"].alias("end"))).alias("label"), _first_entries("i").alias("info"))


def value_audit(df: DataFrame, known: dict[str, tuple[str, ...]], prefixes: dict[str, tuple[str, ...]]) -> DataFrame:
    """field, missing, unknown: values of each field that are null or empty, or neither known nor begin with a known prefix."""
    out = []
    for c, values in known.items():
        ok = F.col(c).isin(list(values))
        for p in prefixes.get(c, ()):
            ok = ok | F.col(c).startswith(p)
        gone = F.coalesce(F.col(c), F.lit("")) == ""
        out.append(F.struct(F.lit(c).alias("field"), F.count_if(gone).alias("missing"), F.count_if(~gone & ~ok).alias("unknown")))
    return df.agg(F.array(*out).alias("x")).select(F.inline("x"))


def primary_label(label: Column, by_start: bool, without: str) -> Column:
    """Category of the span that starts first, the first listed of equals, or of the first listed; ``without`` where there is none."""
    first = F.array_sort(label, lambda a, b: a["start"] - b["start"]) if by_start else label
    return F.coalesce(F.get(first, F.lit(0))["category"], F.lit(without))


def markdown(confusions: DataFrame, priorities: DataFrame, misses: DataFrame | None = None, most: int = 20) -> str:
    """The tables' top rows and up to five misses of each class as Markdown; at most ``most`` rows, or five a class, reach the driver."""
    out = []
    for title, df, by in (("Priorities", priorities, "score"), ("Top Confusions", confusions, "n")):
        rows = df.orderBy(F.desc(by), *[c for c in df.columns if c != by]).limit(most).collect()
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *("| " + " | ".join(str(x) for x in r) + " |" for r in rows), ""]
    if misses is not None:
        out += ["## Example Misses", ""]
        last = None
        for r in misses.where("kind = 'missed' and r <= 5").orderBy("label", "r").collect():
            out += ([] if r.label == last else [f"### {r.label}"]) + [f"- `{r.doc_id}`: `{r.expected}` in `{r.context}`"]
            last = r.label
        out.append("")
    return "\n".join(out)


def as_tsv(df: DataFrame) -> str:
    """A report's rows as lines of values between tabs, its header first; for reports of a fixed number of rows."""
    return "\n".join(["\t".join(df.columns), *("\t".join("" if x is None else str(x) for x in r) for r in df.collect())]) + "\n"
