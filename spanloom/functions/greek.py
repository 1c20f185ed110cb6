"""Rules for Greek records: scripts, quality, label leaks, value formats, shapes and rewriting, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
ARTIFACTS = (
    "(?i)here['’]?s a",
    "(?i)thinking process",
    r"<think\b",
    "</think>",
    "```",
    r"^\s*(παράδειγμα|σίγουρα|φυσικά|βεβαίως)[:!]?",
    r"^\s*(ορίστε|ιδού|εδώ είναι|ένα παράδειγμα)",
    r"^\s*\d+\.\s*$",
    r"<[a-z]+[\s>]",
)
LABEL_IDS = (
    "mac_address", "ip_address", "vehicle_vin", "account_number", "private_phone", "private_email", "private_person", "private_address", "private_url", "private_date",
    "driver_license", "license_plate", "card_pan", "amka", "afm", "adt", "gemi", "ama", "imei", "cvv", "pcn", "passport",
)
AFM_PREFIXES = ("Α.Φ.Μ.:", "Α.Φ.Μ.", "ΑΦΜ", "Α Φ Μ", "A.F.M.:", "AFM", "EL")
AMKA_PREFIXES = ("Α.Μ.Κ.Α.:", "Α.Μ.Κ.Α.", "ΑΜΚΑ", "AMKA")
AFM_TOKENS = ("Α.Φ.Μ.:", "Α.Φ.Μ.", "ΑΦΜ:", "ΑΦΜ.", "ΑΦΜ", "AFM:", "AFM.", "AFM", "VAT:", "VAT", "EL")
LOOKALIKES = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX")
LEADERS = (
    "Παράδειγμα:", "Παράδειγμα", "Σίγουρα!", "Φυσικά!", "Βεβαίως!", "Συγχαρητήρια!", "Ορίστε:", "Ιδού:", "Εδώ είναι:", "Ναι!",
    "Ένα παράδειγμα πρότασης είναι:", "Ένα παράδειγμα είναι:",
)

GREEK = r"\x{370}-\x{3FF}\x{1F00}-\x{1FFF}"
GREEK_LETTERS = r"\x{391}-\x{3A9}\x{3B1}-\x{3C9}\x{386}-\x{38F}\x{3AC}-\x{3CE}\x{1F00}-\x{1FFE}"
SPACE = "[ \\t\\r\\n\\f]+"


def _any(words) -> str:
    return "|".join(w.replace(".", "[.]") for w in words)


def _n(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{characters}]", ""))


def letter_share(text: Column, characters: str, without: float) -> Column:
    """Share of all letters that ``characters`` has; ``without`` where there is no letter."""
    letters = F.regexp_replace(text, r"[^\p{L}]", "")
    return F.coalesce(_n(letters, characters) / F.nullif(F.length(letters), F.lit(0)), F.lit(without))


def greek_share(text: Column) -> Column:
    return letter_share(text, GREEK, 1.0)


def latin_share(text: Column) -> Column:
    return letter_share(text, "A-Za-z", 0.0)


def greek_enough(text: Column, least: float = 0.55) -> Column:
    """Greek letters among all characters; false for empty texts."""
    return F.coalesce(_n(text, GREEK_LETTERS) / F.nullif(F.length(text), F.lit(0)) >= least, F.lit(False))


def flat(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def sentences(text: Column, ends: str = ".!;·") -> Column:
    return F.filter(F.transform(F.split(text, f"(?<=[{ends}]){SPACE}"), flat), lambda s: s != "")


def usable(sentence: Column, low: int, high: int, words: int, share: float, ends: str | None = None, letters: str = GREEK) -> Column:
    """Length, number of words, last character and share of ``letters`` are as asked."""
    ok = F.length(sentence).between(low, high) & (F.length(sentence) - F.length(F.replace(sentence, F.lit(" "))) + 1 >= words) & (letter_share(sentence, letters, 0.0) >= share)
    return ok & sentence.rlike(f"[{ends}]$") if ends else ok


def record_reason(text: Column, label: Column, low: int = 30, high: int = 300) -> Column:
    """First reason against a record, in a fixed order, or ok; ``label`` holds structs category, start, end."""
    out = F.when(F.coalesce(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit("")) == "", "empty_text").when(F.length(text) < low, "too_short").when(F.length(text) > high, "too_long")
    for p in ARTIFACTS:
        out = out.when(text.rlike("(?iU)" + p if not p.startswith("(?i)") else "(?iU)" + p[4:]), f"artifact:{p[:30]}")
    out = out.when((greek_share(text) < 0.4) & (latin_share(text) > 0.3), "low_greek_high_latin")
    bad = lambda s: (
        F.when(s.isNull(), "bad_span_shape").when(s["category"].isNull(), "bad_category").when(s["start"].isNull() | s["end"].isNull(), "bad_offsets")
        .when((s["start"] < 0) | (s["end"] > F.length(text)) | (s["start"] >= s["end"]), "invalid_offsets")
        .when(F.trim(F.regexp_replace(F.substr(text, s["start"] + 1, s["end"] - s["start"]), r"(?U)\s+", " ")) == "", "empty_span")
    )
    why = F.transform(label, lambda s, k: F.coalesce(bad(s), F.when((k > 0) & F.array_contains(F.slice(label, F.lit(1), F.greatest(k, F.lit(1))), s), "duplicate_span")))
    return out.otherwise(F.coalesce(F.get(F.filter(why, lambda w: w.isNotNull()), F.lit(0)), F.lit("ok")))


def leaks_label(text: Column) -> Column:
    """A label's name or the English word secret stands in the text as a word."""
    edge = r"[\p{L}\p{N}_]"
    return text.rlike(f"(?<!{edge})(?:{'|'.join(LABEL_IDS)}|(?i:secret))(?!{edge})")


def without_phone_accounts(text: Column, label: Column) -> Column:
    """``label`` without account numbers that are phone numbers; null where that leaves none of some."""
    value = lambda s: F.substr(text, s["start"] + 1, s["end"] - s["start"])
    kept = F.filter(label, lambda s: ~((s["category"] == "account_number") & value(s).rlike("^(69|2[1-8])[0-9]{8}$")))
    return F.when((F.size(label) > 0) & (F.size(kept) == 0), None).otherwise(kept)


def strip_prefix(value: Column, prefixes: tuple[str, ...]) -> Column:
    """Without the first of ``prefixes`` that it begins with and the marks after it."""
    v = F.trim(value)
    return F.when(v.rlike(f"^(?:{_any(prefixes)})"), F.regexp_replace(F.regexp_replace(v, f"^(?:{_any(prefixes)})[ :\\t-]*", ""), "[ :\\t-]+$", "")).otherwise(v)


def value_problem(category: Column, value: Column) -> Column:
    """What is wrong with a tax, insurance or account number's form; null if nothing."""
    bare = lambda v: F.regexp_replace(v, "[\\s.-]", "")
    return (
        F.when((category == "afm") & ~bare(strip_prefix(value, AFM_PREFIXES)).rlike("^[0-9]{9}$"), "afm_format")
        .when((category == "amka") & ~bare(strip_prefix(value, AMKA_PREFIXES)).rlike("^[0-9]{11}$"), "amka_format")
        .when((category == "iban_gr") & ~F.upper(F.regexp_replace(value, "[\\s-]", "")).rlike("^GR.{25}$"), "iban_format")
    )


def nine_digits(value: Column) -> Column:
    """Struct shift, status: where in a tax number's span its nine digits begin.

    status is clean, relabelled or unparseable; shift is null for the last.
    """
    p = f"^(\\s*(?:(?:{_any(AFM_TOKENS)})[\\s:.-]*)?)[0-9]{{9}}\\s*$"
    shift = F.when(value.rlike(p), F.length(F.regexp_extract(value, p, 1)))
    return F.struct(shift.alias("shift"), F.when(shift.isNull(), "unparseable").when((shift == 0) & (F.length(value) == 9), "clean").otherwise("relabelled").alias("status"))


def run_shape(value: Column) -> Column:
    """Runs of digits, capitals and other letters as d, A and a with their lengths; other characters as they are."""
    runs = F.regexp_extract_all(value, F.lit(r"(?s)\p{Nd}+|\p{Lu}+|[\p{L}&&[^\p{Lu}]]+|."), 0)
    kind = lambda x: F.when(x.rlike(r"^\p{Nd}"), "d").when(x.rlike(r"^\p{Lu}"), "A").when(x.rlike(r"^\p{L}"), "a")
    return F.array_join(F.transform(runs, lambda x: F.coalesce(F.concat(kind(x), F.length(x).cast("string")), x)), "")


def unwrapped(content: Column) -> Column:
    """The first line of an answer behind lines that only lead to it, without bullet and quotes."""
    lines = F.transform(F.split(F.trim(content), "\n"), lambda x: F.trim(x))
    own = F.get(F.filter(lines, lambda x: ~x.rlike(f"^(?:$|{_any(LEADERS)})")), F.lit(0))
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(own, "^(?:[-•—*] |[\"«'`])+\\s*", ""), "[\"»'`]+$", "")), F.lit(""))


def without_bio(label: Column) -> Column:
    return F.regexp_replace(label, "^[BI]-", "")


def reformatted(category: Column, value: Column, draw: Column) -> Column:
    """Another spelling of a value, chosen by ``draw`` (a whole number); null where its form isn't known."""
    d, compact = F.regexp_replace(value, "[^0-9]", ""), F.upper(F.regexp_replace(value, "[\\s-]", ""))
    pick = lambda *forms: F.element_at(F.array(*forms), (F.pmod(draw, F.lit(len(forms))) + 1).cast("int"))
    cut = lambda s, *sizes: [F.substring(s, sum(sizes[:k]) + 1, n) for k, n in enumerate(sizes)]
    p = "^\\s*([Α-ΩA-Z]{1,3})[\\s-]*([0-9]{5,7})\\s*$"
    letters, number = F.regexp_extract(value, p, 1), F.regexp_extract(value, p, 2)
    fours = cut(compact, *[4] * 6, 3)
    return (
        F.when((category == "amka") & (F.length(d) == 11), pick(F.concat_ws("-", *cut(d, 6, 5)), F.concat_ws(" ", *cut(d, 3, 3, 5)), F.concat_ws(" ", *cut(d, 6, 5))))
        .when((category == "afm") & (F.length(d) == 9), pick(*[F.concat(F.lit(x), d) for x in ("EL", "ΑΦΜ ", "Α.Φ.Μ.: ")]))
        .when((category == "adt") & value.rlike(p), pick(F.concat(letters, number), F.concat_ws("-", letters, number), F.concat_ws(" ", letters, number), F.concat_ws(" ", F.translate(letters, *LOOKALIKES), number)))
        .when((category == "iban_gr") & compact.rlike("^GR[0-9]{25}$"), pick(F.concat_ws(" ", *fours), F.concat_ws("-", *fours)))
        .when((category == "private_phone") & (F.length(d) == 10), pick(F.concat_ws(" ", *cut(d, 4, 3, 3)), F.concat_ws(".", *cut(d, 4, 3, 3)), F.concat(F.lit("+30 "), d)))
    )


#: Words near which a number may be something else than a phone.
CONFUSABLE = "λογαριασμ|μισθοδοσ|IBAN|account|χρέωση"
#: Text sources, their licences and whether those are safe for commercial use.
SOURCES = (("greek_pd", "public-domain", True), ("common_voice", "CC0-1.0", True), ("greek_legal", "CC-BY-4.0", True), ("wiki_el", "CC-BY-SA-4.0", False), ("mc4_el", "ODC-BY-1.0", False))


def confusable(text: Column) -> Column:
    """A word that makes a number ambiguous stands in the text."""
    return text.rlike(f"(?iu){CONFUSABLE}")


def acceptable(line: Column, low: int = 30, high: int = 260, words: int = 5) -> Column:
    """A generated line of the length and number of words asked for."""
    return F.length(line).between(low, high) & (F.size(F.filter(F.split(line, r"(?U)\s+"), lambda w: w != "")) >= words)


def relabelled(text: Column, label: Column) -> Column:
    """``label`` with each tax number's span on its nine digits alone; what can't be read stays."""

    def one(s: Column) -> Column:
        shift = nine_digits(F.substr(text, s["start"] + 1, s["end"] - s["start"]))["shift"]
        own = (s["category"] == "afm") & shift.isNotNull()
        start = F.when(own, s["start"] + shift).otherwise(s["start"])
        return F.struct(s["category"].alias("category"), start.alias("start"), F.when(own, start + 9).otherwise(s["end"]).alias("end"))

    return F.transform(label, one)


def relabel_report(values: DataFrame, by: str = "split", most: int = 10) -> DataFrame:
    """Per ``by``: spans, clean, relabelled, unparseable, clean_pct (null without spans), up to ``most`` unparseable samples and counts of their shapes.

    ``values`` has ``by`` and value, a row for each tax number's span.
    """
    x = values.select(by, "value", nine_digits(F.col("value"))["status"].alias("status"))
    n = lambda s: F.count_if(F.col("status") == s)
    counted = x.groupBy(by).agg(F.count("*").alias("spans"), n("clean").alias("clean"), n("relabelled").alias("relabelled"), n("unparseable").alias("unparseable"))
    bad = x.where("status = 'unparseable'").select(by, "value").withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy("value"))).where(F.col("r") <= most)
    samples = bad.groupBy(by).agg(F.sort_array(F.collect_list("value")).alias("samples"))
    shapes = x.where("status = 'relabelled'").groupBy(by, run_shape(F.col("value")).alias("shape")).agg(F.count("*").alias("n"))
    shapes = shapes.groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("shape", "n")))).alias("shapes"))
    pct = F.round(F.try_divide(100.0 * (F.col("clean") + F.col("relabelled")), F.col("spans")), 2)
    return counted.withColumn("clean_pct", pct).join(samples, by, "left").join(shapes, by, "left")


def over_unparseable(report: DataFrame, most: float = 0.01) -> DataFrame:
    """Rows of a relabel report with more than a share ``most`` of unparseable spans; a run passes where there are none."""
    return report.where((F.col("spans") > 0) & (F.col("unparseable") / F.col("spans") > most))
