"""Detection and offset algebra of character spans, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Detectors by category; no groups and only ``[0-9]`` so that engines agree.
PATTERNS = {
    "card": "[0-9]{16}",
    "email": "[A-Za-z0-9.]+@[a-z0-9.]+[.]com",
    "ipv4": "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}",
    "phone": "[+]1 [(][0-9]{3}[)] 555-[0-9]{4}",
    "secret": 'token = "[0-9a-f]{40}"',
}

#: What every value of a category holds; texts without it need no pattern search.
NEEDED = {"email": "@", "ipv4": ".", "phone": "+1 (", "secret": 'token = "'}


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, though the body names it often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda s, x: s + x)


def find_spans(text: Column, category: str) -> Column:
    """Array of (category, start, end, value): half-open offsets in code points.

    A start is the sum of what stands before it: whole blocks of 64 matches, whose
    sums are added up once, and the rest of its own block.
    """
    kind = "struct<sum:int,before:array<int>>"
    zero = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("before")).cast(kind)

    def sums(x: Column) -> Column:
        step = lambda s, k: F.struct((s["sum"] + _total(F.slice(x["size"], k * 64 + 1, F.lit(64)))).alias("sum"), F.concat(s["before"], F.array(s["sum"])).alias("before")).cast(kind)
        return F.when(F.size(x["found"]) > 0, F.aggregate(F.sequence(F.lit(0), F.shiftright(F.size(x["found"]) - 1, 6)), zero, step)["before"]).otherwise(F.array().cast("array<int>"))

    def starts(x: Column) -> Column:
        at = lambda k: F.get(x["before"], F.shiftright(k, 6)) + _total(F.slice(x["size"], F.shiftright(k, 6) * 64 + 1, k.bitwiseAND(63))) + F.length(F.get(x["gaps"], k))
        return F.transform(F.transform(x["found"], lambda v, k: F.struct(at(k).alias("start"), v.alias("value"))), one)

    one = lambda x: F.struct(F.lit(category).alias("category"), x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end"), x["value"].alias("value"))
    both = F.struct(F.regexp_extract_all(text, F.lit(PATTERNS[category]), 0).alias("found"), F.split(text, PATTERNS[category], -1).alias("gaps"))
    sized = lambda x: F.struct(x["found"].alias("found"), x["gaps"].alias("gaps"), F.transform(x["found"], lambda v, k: F.length(v) + F.length(F.get(x["gaps"], k))).alias("size"))
    spans = let(both, lambda x: let(sized(x), lambda y: let(F.struct(y["found"].alias("found"), y["gaps"].alias("gaps"), y["size"].alias("size"), sums(y).alias("before")), starts)))
    none = F.array().cast("array<struct<category:string,start:int,end:int,value:string>>")
    there = F.contains(text, F.lit(NEEDED[category])) if category in NEEDED else F.lit(True)
    return F.when(text.isNotNull(), F.when(there, spans).otherwise(none))


def all_spans(text: Column, categories: tuple[str, ...] = tuple(PATTERNS)) -> Column:
    """The spans of the categories in one array; null for a null text."""
    return F.concat(*[find_spans(text, c) for c in categories])


def detect(docs: DataFrame, *keep: str, categories: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """One row per span of the categories: doc_id, kept columns, category, start, end, value."""
    return docs.select("doc_id", *keep, F.explode(all_spans(F.col("text"), categories)).alias("s")).select("doc_id", *keep, "s.*")


def redact(text: Column) -> Column:
    """Spans replaced by their category in upper case, secrets first; a pattern is run where its mark is."""
    out = text
    for c in ("secret", "email", "ipv4", "phone", "card"):
        done = F.regexp_replace(out, PATTERNS[c], f"<{c.upper()}>")
        # Replacing one category puts no mark of another in, so the marks are sought in the text itself.
        out = F.when(F.contains(text, F.lit(NEEDED[c])), done).otherwise(out) if c in NEEDED else done
    return out


def normal(text: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[ \\t\\r\\n\\f]+", " "))


def share(text: Column, characters: str) -> Column:
    """Share of ASCII and Latin-1 letters that ``characters`` has; null without letters."""
    n = lambda p: F.length(F.regexp_replace(text, f"[^{p}]", ""))
    return n(characters) / F.nullif(n("A-Za-zÀ-ÖØ-öø-ÿ"), F.lit(0))


def shape(value: Column) -> Column:
    """Digits as 9, capitals as A, small letters as a, other characters as they are."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9")


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)
