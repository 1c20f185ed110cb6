"""Offsets of values that come without them, and the answers of models that list them."""

from __future__ import annotations

from bisect import bisect_left

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .validate import whole_json

_SPANS = "array<struct<label:string,start:int,end:int>>"
_ARROW = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def places(text: str, values: set[str]) -> dict[str, list[int]]:
    """Every place of each value, overlapping ones too; many values are found in one pass."""
    out: dict[str, list[int]] = {v: [] for v in values if v}
    if len(out) > 8:
        automaton = ahocorasick.Automaton()
        for v in out:
            automaton.add_word(v, v)
        automaton.make_automaton()
        for end, v in automaton.iter(text):
            out[v].append(end + 1 - len(v))
        return out
    for v, at in out.items():
        k = text.find(v)
        while k >= 0:
            at.append(k)
            k = text.find(v, k + 1)
    return out


def apart(starts: list[int], size: int) -> list[int]:
    """Places that don't overlap one before."""
    out: list[int] = []
    for s in starts:
        if not out or s >= out[-1] + size:
            out.append(s)
    return out


def _resolved(text: str | None, values: list[dict], cursor: str, fall_back: bool) -> tuple[list[dict], bool]:
    """Spans of one record, and whether every value was found."""
    found = places(text or "", {v["value"] for v in values if v["value"]})
    if cursor == "each":
        found = {v: apart(at, len(v)) for v, at in found.items()}
    out, behind, rank, own = [], 0, dict.fromkeys(found, 0), {}
    for x in values:
        v = x["value"]
        at = found.get(v) if v else None
        if not at:
            continue
        if cursor == "each":
            # The r-th listing of a value takes its r-th place.
            k, rank[v] = rank[v], rank[v] + 1
            if fall_back:
                k %= len(at)
        else:
            k = bisect_left(at, own.get(x["label"], 0) if cursor == "label" else behind) if cursor != "none" else 0
            if k == len(at) and fall_back:
                k = 0
        if k < len(at):
            behind = own[x["label"]] = at[k] + len(v)
            out.append({"label": x["label"], "start": at[k], "end": behind})
    return out, len(out) == len(values)


def resolve(text: Column, values: Column, cursor: str = "all", fall_back: bool = False, strict: bool = False, ordered: bool = False) -> Column:
    """Spans of ``values`` (array of struct label, value) in ``text``.

    ``cursor``: all: each value is sought behind the one before; each: behind the
    last place of the same value; label: behind the one before of the same label,
    so that values of different labels may overlap; none: its first place is taken.
    ``fall_back``:
    what isn't found behind is sought anywhere.  ``strict``: null if a value isn't
    found; else such values are left out.  ``ordered``: by start instead of as
    listed.  Null and empty values are never found, in a null text none is; null
    ``values`` give null.  A text is searched once for all its values.
    """

    @F.arrow_udf(_SPANS)
    def spans(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for t, v in zip(texts.to_pylist(), lists.to_pylist(), strict=True):
            got, whole = ([], False) if v is None else _resolved(t, v, cursor, fall_back)
            if v is None or strict and not whole:
                out.append(None)
            else:
                out.append(sorted(got, key=lambda x: x["start"]) if ordered else got)
        return pa.array(out, _ARROW)

    return spans(text, F.transform(values, lambda x: F.struct(x["label"].cast("string").alias("label"), x["value"].cast("string").alias("value"))))


def resolved_cases(cases: DataFrame, space: tuple[str, ...], key: str = "id") -> DataFrame:
    """``cases`` (key, text, v: array of struct label, value) with spans and problem.

    Every value is sought behind its own last place.  problem is null, or names the
    first listed value that isn't found (not_found) or whose label ``space`` lacks
    (unknown_label), the miss first; spans is null then.
    """
    spans = cases.withColumn("spans", resolve(F.col("text"), F.transform("v", lambda x, k: F.struct(k.cast("string").alias("label"), x["value"].alias("value"))), "each"))
    known = F.transform("spans", lambda s: s["label"].cast("int"))
    why = F.transform("v", lambda x, k: F.when(~F.array_contains(known, k), F.concat(F.lit("not_found: "), F.coalesce(x["value"], F.lit("")))).when(~F.coalesce(x["label"].isin(*space), F.lit(False)), F.concat(F.lit("unknown_label: "), F.coalesce(x["label"], F.lit("")))))
    problem = F.get(F.filter(why, lambda w: w.isNotNull()), F.lit(0))
    labelled = F.transform("spans", lambda s: F.struct(F.get("v", s["label"].cast("int"))["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end")))
    return spans.withColumn("problem", problem).withColumn("spans", F.when(F.col("problem").isNull(), labelled))


def checked_cases(cases: DataFrame, space: tuple[str, ...], key: str = "id") -> DataFrame:
    """``resolved_cases`` without problem; running it fails at a case that has one."""
    out = resolved_cases(cases, space, key)
    fault = F.raise_error(F.concat(F.lit("case "), F.col(key).cast("string"), F.lit(": "), F.col("problem")))
    return out.withColumn("spans", F.when(F.col("problem").isNull(), F.col("spans")).otherwise(fault.cast(_SPANS))).drop("problem")


# Fixed value: where an answer's list of objects begins and ends.
ANSWER_LIST = r"(?s)(\[\s*(?:\{.*?\})?\s*(?:,\s*\{.*?\}\s*)*\])"


def json_spans(content: Column, objects: bool = False) -> Column:
    """Array of struct label, value: the content as a JSON list, else the first list of objects in it, else null.

    Items that are no objects, or without a label or a value, have a null value,
    which ``resolve`` never finds; with ``objects`` items that are none are left out.
    """
    whole, part = whole_json(F.trim(content)), F.try_parse_json(F.regexp_extract(content, ANSWER_LIST, 1))
    listed = lambda v: F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    items = F.try_variant_get(F.when(listed(whole), whole).when(listed(part), part), "$", "array<variant>")
    if objects:
        items = F.filter(items, lambda i: F.schema_of_variant(i).startswith("OBJECT"))
    word = lambda i, k: F.when(F.schema_of_variant(F.try_variant_get(i, f"$.{k}", "variant")) == "STRING", F.nullif(F.try_variant_get(i, f"$.{k}", "string"), F.lit("")))
    return F.transform(items, lambda i: F.struct(word(i, "label").alias("label"), F.when(word(i, "label").isNotNull(), word(i, "value")).alias("value")))


def numbered_lines(content: Column, most: int | None = None) -> Column:
    """Array of struct number, line for lines that begin ``N.`` or ``N)``, in their order.

    The first line of a number counts if it isn't empty; with ``most`` only 1 to ``most`` count.
    """
    p = r"^\s*([0-9]{1,9})[.)]\s*(.*)$"
    lines = F.transform(F.split(content, "\r?\n"), lambda x: F.struct(F.try_to_number(F.regexp_extract(x, p, 1), F.lit("999999999")).cast("int").alias("number"), F.trim(F.regexp_extract(x, p, 2)).alias("line")))
    ok = lambda x: x["number"].isNotNull() & (x["line"] != "") & (x["number"].between(1, most) if most else F.lit(True))
    return F.aggregate(
        F.filter(lines, ok), F.array().cast("array<struct<number:int,line:string>>"), lambda s, x: F.when(F.exists(s, lambda y: y["number"] == x["number"]), s).otherwise(F.concat(s, F.array(x)))
    )


def accounted(df: DataFrame, parsed: str, resolved: str) -> DataFrame:
    """records, parse_drop, offset_drop, kept: answers that aren't JSON, those with a value that isn't in the text, and the rest."""
    return df.agg(
        F.count("*").alias("records"), F.count_if(F.col(parsed).isNull()).alias("parse_drop"), F.count_if(F.col(parsed).isNotNull() & F.col(resolved).isNull()).alias("offset_drop"), F.count_if(F.col(resolved).isNotNull()).alias("kept")
    )
