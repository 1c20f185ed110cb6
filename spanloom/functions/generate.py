"""Values with check digits, from a seed and a row number alone."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def digits(seed: int, ix: Column, n: int) -> Column:
    """``n`` decimal digits, the same on every cluster."""
    draws = [F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{k}:"), ix.cast("string"))), 1, 12), 16, 10).cast("decimal(20,0)") % 10 for k in range(n)]
    return F.concat(*[d.cast("string") for d in draws])


def with_luhn(body: Column, n: int) -> Column:
    """``body`` of ``n`` digits and the digit that makes it valid."""
    total = F.lit(0)
    for k in range(n):
        d = F.substring(body, k + 1, 1).cast("int")
        total = total + (F.when(d > 4, 2 * d - 9).otherwise(2 * d) if (n - k) % 2 else d)
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def cards_and_devices(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """ix, card (16 digits), imei (15), ipv4 and mac."""
    ix = F.col("id")
    hexes = F.md5(F.concat(F.lit(f"{seed}:mac:"), ix.cast("string")))
    mac = F.concat_ws(":", *[F.substring(hexes, 2 * k + 1, 2) for k in range(6)])
    part = lambda k: (F.conv(F.substring(hexes, 13 + 2 * k, 2), 16, 10).cast("int") % 254 + 1).cast("string")
    card = with_luhn(F.concat(F.lit("4"), digits(seed, ix, 14)), 15)
    return spark.range(n).select(ix.alias("ix"), card.alias("card"), with_luhn(digits(seed + 1, ix, 14), 14).alias("imei"), F.concat_ws(".", *[part(k) for k in range(4)]).alias("ipv4"), mac.alias("mac"))


#: Case endings by the nominative's: genitive, accusative, vocative. The first that fits counts.
ENDINGS = {"ος": ("ου", "ο", "ε"), "ός": ("ού", "ό", "έ"), "ης": ("η", "η", "η"), "ής": ("ή", "ή", "ή"), "ας": ("α", "α", "α"), "άς": ("ά", "ά", "ά"), "α": ("ας", "α", "α"), "ά": ("άς", "ά", "ά"), "η": ("ης", "η", "η"), "ή": ("ής", "ή", "ή")}


def inflected(name: Column, case: str, endings: dict[str, tuple[str, str, str]] = ENDINGS) -> Column:
    """A nominative in another case (genitive, accusative, vocative); names with other endings stay."""
    k, out = ("genitive", "accusative", "vocative").index(case), F
    for end, to in endings.items():
        out = out.when(name.endswith(end), F.concat(F.substr(name, F.lit(1), F.length(name) - len(end)), F.lit(to[k])))
    return out.otherwise(name)


def chosen(seed: int, ix: Column, values: list[str] | str) -> Column:
    """One of ``values`` by digest."""
    at = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), ix.cast("string"))), 1, 12), 16, 10).cast("decimal(20,0)") % len(values)
    return F.element_at(F.array(*[F.lit(v) for v in values]), at.cast("int") + 1)


def identifiers(ix: Column, seed: int) -> dict[str, Column]:
    """A value of each kind for the row numbered ``ix``."""
    d = lambda k, m: digits(seed * 100 + k, ix, m)
    letters = lambda k, m, a: F.concat(*[chosen(seed * 1000 + 10 * k + j, ix, a) for j in range(m)])
    two = lambda k, low, high: F.lpad((d(k, 6).cast("int") % (high - low + 1) + low).cast("string"), 2, "0")
    capitals, vin = "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "ABCDEFGHJKLMNPRSTUVWXYZ0123456789"
    name = letters(9, 8, "abcdefghijklmnopqrstuvwxyz")
    return {
        "amka": F.concat(two(1, 1, 28), two(2, 1, 12), two(3, 40, 99), d(4, 5)),
        "afm": F.concat(chosen(seed + 1, ix, ["", "EL", "ΑΦΜ ", "Α.Φ.Μ.: "]), d(5, 9)),
        "adt": F.concat(letters(1, 2, capitals), F.lit(" "), d(6, 6)),
        "iban_gr": F.concat(F.lit("GR"), d(7, 25)),
        "phone": F.concat(chosen(seed + 2, ix, ["69", "21", "23"]), d(8, 8)),
        "account": F.substr(d(9, 14), F.lit(1), chosen(seed + 3, ix, ["10", "12", "14"]).cast("int")),
        "passport": F.concat(letters(2, 2, "ABEZHIKMNOPTYX"), d(10, 7)),
        "plate": F.concat(letters(3, 3, "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"), F.lit("-"), d(11, 4)),
        "vin": F.concat(letters(4, 10, vin[:23]), d(12, 7)),
        "gemi": d(13, 12),
        "cvv": d(14, 3),
        "date": F.concat_ws("/", two(15, 1, 28), two(16, 1, 12), F.concat(F.lit("19"), two(17, 40, 99))),
        "secret": F.concat(F.lit("sk-"), F.substring(F.md5(F.concat(F.lit(f"{seed}:sk:"), ix.cast("string"))), 1, 24)),
        "email": F.concat(name, F.lit("@example.gr")),
        "url": F.concat(F.lit("https://www.example.gr/"), name),
    }


def greek_identifiers(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """ix and one value of each kind: amka, afm, adt, iban_gr, phone, account, passport, plate, vin, gemi, cvv, date, secret, email, url."""
    return spark.range(n).select(F.col("id").alias("ix"), *[v.alias(k) for k, v in identifiers(F.col("id"), seed).items()])


NAMES = {"m": ["Γιώργος", "Νίκος", "Κώστας", "Δημήτρης", "Ανδρέας", "Παύλος", "Στέφανος"], "f": ["Μαρία", "Ελένη", "Κατερίνα", "Σοφία", "Άννα", "Ιωάννα", "Δέσποινα"]}
SURNAMES = ["Παπαδάκης", "Γεωργίου", "Αλεξάκης", "Μαρκόπουλος", "Λαμπρινός", "Ιωάννου", "Καλλέργης", "Ρήγας"]
TITLES = {"m": ["κ. ", "Δρ. ", "κύριος "], "f": ["κα ", "Δρ. ", "κυρία "]}


def in_case(name: str, case: str) -> str:
    """``inflected`` for one name; the nominative stays."""
    k = ("genitive", "accusative", "vocative", "nominative").index(case)
    end = next((e for e in ENDINGS if name.endswith(e)), "")
    return name if k == 3 or not end else name[: -len(end)] + ENDINGS[end][k]


def person(ix: Column, seed: int, titled: float = 0.2, turned: float = 0.2) -> Column:
    """A name: gender, case and order drawn, a title on a share ``titled``; a woman's surname is her family's genitive."""
    forms = [
        {"first": in_case(first, case), "last": in_case(last, case if g == "m" else "genitive"), "titles": TITLES[g]}
        for g in "mf" for case in ("nominative", "genitive", "accusative", "vocative") for first in NAMES[g] for last in SURNAMES
    ]
    share = lambda k: digits(seed + k, ix, 6).cast("int") / 1000000
    of = F.from_json(F.lit(json.dumps(forms, ensure_ascii=False)), "array<struct<first:string,last:string,titles:array<string>>>")[(share(0) * len(forms)).cast("int")]
    name = F.when(share(1) < turned, F.concat(of["last"], F.lit(" "), of["first"])).otherwise(F.concat(of["first"], F.lit(" "), of["last"]))
    return F.concat(F.when(share(2) < titled, F.element_at(of["titles"], (share(3) * 3).cast("int") + 1)).otherwise(""), name)


STREETS = ("Κυκλαμίνων", "Αμυγδαλιάς", "Ρεματιάς", "Πευκώνα", "Δελφινιών", "Ανεμώνας")
CITIES = ("Νάουσα", "Άμφισσα", "Λεωνίδιο", "Μέτσοβο", "Ύδρα")


def address(ix: Column, seed: int) -> Column:
    street, city = chosen(seed, ix, list(STREETS)), chosen(seed + 1, ix, list(CITIES))
    number, code = (digits(seed + 2, ix, 4).cast("int") % 199 + 1).cast("string"), digits(seed + 3, ix, 3)
    return F.concat(street, F.lit(" "), number, F.lit(", "), F.lit("1"), F.substr(code, F.lit(1), F.lit(2)), F.lit(" "), F.substr(code, F.lit(2), F.lit(2)), F.lit(" "), city)
