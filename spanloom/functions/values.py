"""Values of every kind in the spellings they have in records, from a seed and a row number alone."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .generate import CITIES, NAMES, STREETS, SURNAMES, person, with_luhn
from .spans import let

# Fixed values.
GREEK_CAPITALS = "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"
PLATE_LETTERS = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
VIN_LETTERS = "ABCDEFGHJKLMNPRSTUVWXYZ" + string.digits
TOKEN_PREFIXES = ("tk_live_", "tk_test_", "gpat_", "ghs_", "AKIA", "ASIA", "tok_", "key_", "whsec_", "xoxb-", "xoxp-", "Bearer ", "ya29.", "EAA", "")
SHORT_MONTHS = ("Ιαν", "Φεβ", "Μαρ", "Απρ", "Μαϊ", "Ιουν", "Ιουλ", "Αυγ", "Σεπ", "Οκτ", "Νοε", "Δεκ")

#: Own lists; streets and cities of old spellings have the same names with their old marks.
OLD_STREETS = ("Κυκλαμίνων", "Ἀμυγδαλιᾶς", "Ῥεματιᾶς", "Ἀνεμώνας")
OLD_CITIES = ("Ἄμφισσα", "Ὕδρα", "Λεωνίδιον")
MONTHS = ("Ιανουαρίου", "Μαρτίου", "Μαΐου", "Ιουλίου", "Οκτωβρίου")
WORDS = ("Marble", "Kite", "Violet", "Harbour", "Quince")
HOSTS = ("example.gr", "shop.example.gr", "portal.example.gr", "docs.example.com")
LATIN = string.ascii_lowercase + string.digits


def drawn(seed: int, ix: Column) -> Column:
    """A whole number from 0 to 2**40 - 1."""
    return F.pmod(F.xxhash64(F.lit(seed), ix), F.lit(1 << 40))


def whole(seed: int, ix: Column, low: int, high: int) -> Column:
    return (F.pmod(drawn(seed, ix), F.lit(high - low + 1)) + low).cast("int")


def share(seed: int, ix: Column, p: float) -> Column:
    """True for a share ``p`` of the rows."""
    return drawn(seed, ix) < int(p * (1 << 40))


def pick(seed: int, ix: Column, *options) -> Column:
    """One of the options, evenly."""
    return F.element_at(F.array(*[o if isinstance(o, Column) else F.lit(o) for o in options]), whole(seed, ix, 1, len(options)))


def signs(seed: int, ix: Column, n: Column | int, alphabet: str = string.digits) -> Column:
    """``n`` characters of the alphabet."""
    one = lambda k: F.substr(F.lit(alphabet), (F.pmod(F.xxhash64(F.lit(seed), ix, k), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), n if isinstance(n, Column) else F.lit(n)), one), "")


def cut(value: Column, sep: str, *sizes: int) -> Column:
    return F.concat_ws(sep, *[F.substring(value, sum(sizes[:k]) + 1, n) for k, n in enumerate(sizes)])


def cut_by(value: Column, sep: Column, *sizes: int) -> Column:
    return F.call_function("array_join", F.array(*[F.substring(value, sum(sizes[:k]) + 1, n) for k, n in enumerate(sizes)]), sep)


def two(value: Column) -> Column:
    return F.lpad(value.cast("string"), 2, "0")


def values(ix: Column, seed: int) -> dict[str, Column]:
    """A value of each kind for the row numbered ``ix``."""
    from ..operators.transform import transliterate

    s = seed * 1000
    n = lambda k, m: signs(s + k, ix, m)
    born = F.concat(two(whole(s + 1, ix, 1, 28)), two(whole(s + 2, ix, 1, 12)), whole(s + 3, ix, 40, 99).cast("string"))
    letters, six = signs(s + 5, ix, pick(s + 6, ix, 2, 3), GREEK_CAPITALS), n(7, 6)
    iban = F.concat(F.lit("GR"), n(8, 25))
    area = pick(s + 10, ix, "69", "21", "231", "241")
    phone = F.substring(F.concat(area, n(11, 8)), 1, 10)
    first, last = (F.lower(pick(s + k, ix, *names)) for k, names in ((12, NAMES["m"] + NAMES["f"]), (13, SURNAMES)))
    latin = lambda k, v: F.when(share(s + k, ix, 0.8), transliterate(v)).otherwise(v)
    street, number, city, code = pick(s + 20, ix, *STREETS), whole(s + 21, ix, 1, 250).cast("string"), pick(s + 22, ix, *CITIES), whole(s + 23, ix, 10000, 85999).cast("string")
    suffixed = F.concat(number, F.when(share(s + 24, ix, 0.3), pick(s + 25, ix, "Α", "Β", "Γ", "α", "β")).otherwise(""))
    day, month, year = whole(s + 26, ix, 1, 28), whole(s + 27, ix, 1, 12), whole(s + 28, ix, 1960, 2024).cast("string")
    valid = lambda body, m: let(body, lambda b: with_luhn(b, m))
    sep = pick(s + 34, ix, " ", "-")
    groups = lambda v, *sizes: let(v, lambda x: F.when(share(s + 33, ix, 0.5), cut_by(x, sep, *sizes)).otherwise(x))
    brand = valid(F.substring(F.concat(pick(s + 36, ix, "4", "5", "37"), n(37, 15)), 1, 15), 15)
    part = lambda k: signs(s + k, ix, pick(s + k + 1, ix, 4, 6, 8, 12), LATIN)
    path = F.concat(F.lit("/"), part(40), F.when(share(s + 42, ix, 0.6), F.concat(F.lit("/"), part(43))).otherwise(""), F.when(share(s + 45, ix, 0.3), F.concat(F.lit("?"), pick(s + 46, ix, "id", "token", "ref", "q"), F.lit("="), signs(s + 47, ix, 8, LATIN))).otherwise(""))
    mark = lambda k: pick(s + k, ix, "#", "$", "!", "&", "@", "?", "*", "_", "")
    name = person(ix, seed + 11, 0.0)
    return {
        "amka": F.concat(born, pick(s + 4, ix, "", "-", " "), n(9, 5)),
        "afm": F.concat(pick(s + 14, ix, "", "EL", "Α.Φ.Μ.: ", "ΑΦΜ "), whole(s + 15, ix, 100000000, 999999999).cast("string")),
        "adt": F.concat(letters, pick(s + 16, ix, " ", "-", ""), six),
        "iban_gr": let(iban, lambda x: pick(s + 17, ix, x, cut(x, " ", 4, 4, 4, 4, 4, 4, 3), cut(x, "-", 4, 4, 4, 4, 4, 4, 3))),
        "phone": let(phone, lambda x: pick(s + 18, ix, x, cut(x, " ", 4, 3, 3), F.concat(F.lit("+30 "), x), cut(x, ".", 4, 3, 3))),
        "email": F.concat(latin(19, first), pick(s + 29, ix, ".", "_", ""), latin(19, last), whole(s + 35, ix, 1, 999).cast("string"), F.lit("@"), pick(s + 38, ix, *HOSTS)),
        "url": pick(s + 39, ix, *[F.concat(F.lit(a), latin(48, first), whole(s + 49, ix, 10, 99).cast("string"), F.lit(b)) for a, b in (("https://www.example.gr/", ""), ("http://", ".example.gr"), ("https://example.gr/user/", "/"), ("www.example.gr/~", ""), ("https://example.com/in/", ""))]),
        "deep_url": F.concat(pick(s + 50, ix, "https://", "http://"), pick(s + 51, ix, *HOSTS), path),
        "address": pick(s + 52, ix, F.concat_ws(" ", street, F.concat(number, F.lit(",")), city, code), F.concat_ws(" ", street, F.concat(number, F.lit(",")), code, city), F.concat_ws(" ", street, number, F.lit("-"), city)),
        # A street and a number that may have a letter, alone or before a city with its code.
        "boundary_address": F.concat(street, F.lit(" "), suffixed, F.when(share(s + 53, ix, 0.5), F.concat(F.lit(", Τ.Κ. "), code, F.lit(" "), city)).otherwise("")),
        "old_address": F.concat(pick(s + 54, ix, *OLD_STREETS), F.lit(" "), whole(s + 55, ix, 1, 99).cast("string"), F.when(share(s + 56, ix, 0.5), F.concat(F.lit(", "), pick(s + 57, ix, *OLD_CITIES))).otherwise("")),
        "date": pick(s + 58, ix, F.concat_ws("/", two(day), two(month), year), F.concat_ws("-", two(day), two(month), year), F.concat_ws(" ", day.cast("string"), F.element_at(F.array(*[F.lit(m) for m in SHORT_MONTHS]), month), year), year),
        "greek_date": F.concat_ws(" ", day.cast("string"), pick(s + 59, ix, *MONTHS), year),
        "account": signs(s + 60, ix, pick(s + 61, ix, 10, 12, 14)),
        "secret": F.concat(F.lit("sk-"), signs(s + 62, ix, pick(s + 63, ix, 16, 20, 24, 32), string.ascii_uppercase + string.digits)),
        "token": F.concat(pick(s + 64, ix, *TOKEN_PREFIXES), signs(s + 65, ix, pick(s + 66, ix, 20, 24, 28, 32, 36, 40, 48, 56, 64), string.ascii_letters + string.digits + "_-")),
        # A word and six to ten signs with a mark between or behind.
        "password": let(F.struct(pick(s + 70, ix, *WORDS).alias("w"), signs(s + 71, ix, whole(s + 72, ix, 6, 10), string.ascii_letters + string.digits).alias("x"), mark(74).alias("m")), lambda v: pick(s + 73, ix, F.concat(v["w"], v["m"], v["x"]), F.concat(v["x"], v["w"], v["m"]))),
        "passport": F.concat(signs(s + 83, ix, 2, string.ascii_uppercase), n(84, 7)),
        "plate": F.concat(signs(s + 85, ix, 3, PLATE_LETTERS), pick(s + 86, ix, "-", " ", ""), n(87, 4)),
        "vin": signs(s + 88, ix, 17, VIN_LETTERS),
        "gemi": n(89, 12),
        "ama": signs(s + 90, ix, F.when(share(s + 91, ix, 0.8), 9).otherwise(7)),
        "card": F.when(share(s + 32, ix, 0.85), groups(valid(n(30, 15), 15), 4, 4, 4, 4)).otherwise(groups(valid(n(31, 14), 14), 4, 6, 5)),
        "brand_card": let(brand, lambda x: pick(s + 92, ix, x, cut(x, " ", 4, 4, 4, 4), cut(x, "-", 4, 4, 4, 4))),
        "cvv": signs(s + 93, ix, F.when(share(s + 94, ix, 0.8), 3).otherwise(4)),
        "imei": valid(n(95, 14), 14),
        "loose_imei": n(96, 15),
        "ip": F.when(share(s + 97, ix, 0.85), F.concat_ws(".", *[whole(s + 100 + k, ix, 1, 254).cast("string") for k in range(4)])).otherwise(F.concat_ws(":", *[signs(s + 110 + k, ix, 4, "0123456789abcdef") for k in range(8)])),
        "mac": F.call_function("array_join", F.array(*[signs(s + 120 + k, ix, 2, "0123456789abcdef") for k in range(6)]), pick(s + 121, ix, ":", "-")),
        "licence": F.when(share(s + 98, ix, 0.8), n(99, 9)).otherwise(F.concat(signs(s + 130, ix, 2, string.ascii_uppercase), n(131, 6))),
        "pcn": F.concat(n(132, 9), signs(s + 133, ix, 1, string.ascii_uppercase), n(134, 2)),
        "titled_person": F.concat(pick(s + 135, ix, "ο ", "η ", "ο κ. ", "η κα ", "Δρ. "), name),
        "foreign_person": F.concat_ws(" ", pick(s + 136, ix, "John", "Anna", "Marco", "Elena"), pick(s + 137, ix, "Smith", "Rossi", "Novak", "Weber")),
        "amount": F.concat(whole(s + 138, ix, 10, 99999).cast("string"), F.lit(","), two(whole(s + 139, ix, 0, 99)), F.lit("€")),
        "room": F.concat(F.lit("Δωμάτιο "), whole(s + 140, ix, 100, 999).cast("string")),
        "office": F.concat(F.lit("Γραφείο "), whole(s + 141, ix, 100, 999).cast("string")),
    }


def value_table(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """ix and a value of each kind."""
    return spark.range(n).select(F.col("id").alias("ix"), *[v.alias(k) for k, v in values(F.col("id"), seed).items()])
