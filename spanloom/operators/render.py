"""Records of sentence templates: text, labels and origin, from a seed and a row number alone.

A template names the columns that fill it: ``{phone}`` is shown and labelled,
``{~phone}`` shown without a label, as in sentences that only look personal.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.generate import address, cards_and_devices, chosen, digits, identifiers, person, with_luhn
from ..functions.values import values
from .sample import uniform, weighted_choice

_SLOT = re.compile(r"\{(~?)(\w+)\}")
LABEL = "array<struct<category:string,start:int,end:int>>"

#: Categories by slot where the two differ.
CATEGORY = {
    "person": "private_person", "other": "private_person", "phone": "private_phone", "email": "private_email", "url": "private_url", "address": "private_address", "date": "private_date", "account": "account_number", "token": "secret", "password": "secret", "ip": "ip_address", "mac": "mac_address", "licence": "driver_license", "deep_url": "private_url",
    "boundary_address": "private_address", "old_address": "private_address", "titled_person": "private_person", "foreign_person": "private_person", "greek_date": "private_date", "vin": "vehicle_vin", "plate": "license_plate", "brand_card": "card_pan", "card": "card_pan",
}

TEMPLATES = {
    "easy": ["Το ΑΦΜ μου είναι {afm}.", "Με λένε {person}.", "Καλέστε με στο {phone}.", "Στείλτε το αρχείο στο {email}.", "Μένω στη διεύθυνση {address}."],
    "medium": ["Ασφαλισμένος με ΑΜΚΑ {amka} ζητά κλήση στο {phone}.", "Το όχημα {plate} δηλώθηκε με την ταυτότητα {adt}.", "Ραντεβού για {person} στις {date}, {address}."],
    "hard": [
        "Η πληρωμή από {iban_gr} έγινε στις {date}, με αριθμό δέματος {~gemi} και τηλέφωνο {phone}· το ΑΦΜ {afm} δεν άλλαξε.",
        "Φάκελος {~account}: {person}, διαβατήριο {passport}, λογαριασμός {account}, {email}.",
    ],
    "hard_negative": ["Η παραγγελία {~account} έφυγε από την αποθήκη.", "Ο κωδικός προϊόντος είναι {~gemi}.", "Η σελίδα άλλαξε στις {~date} και δεν αφορά κάποιον."],
    "confusable": ["Το δέμα {~gemi} δεν είναι αριθμός μητρώου, το {gemi} είναι.", "Ο κωδικός {~account} θυμίζει λογαριασμό· ο σωστός είναι {account}.", "Το {~phone} είναι αριθμός σελίδας."],
    "cvv": ["Ο κωδικός στο πίσω μέρος της κάρτας είναι {cvv}.", "Κάρτα {card}, CVV {cvv}."],
    "url": ["Το προφίλ μου είναι στο {url}.", "Δείτε τα στοιχεία στο {url} πριν απαντήσετε."],
    "secret": ["Το κλειδί του συστήματος είναι {secret}.", "API_KEY={secret}"],
    "one_name": ["Μίλησα με {person} για τη σύμβαση.", "Υπογραφή: {person}."],
    "two_names": ["Παρόντες: {person} και {other}.", "{person} έγραψε σε {other} χθες."],
    "token": ["Το διακριτικό είναι {token}", "export KEY={token};", "(«{token}»)"],
    "password": ["Ο κωδικός πρόσβασης είναι {password}.", "login: admin / {password}"],
    "network": ["Σύνδεση από {ip} στις {~date}.", "Η συσκευή {mac} πήρε τη διεύθυνση {ip}."],
    "pcn": ["Ο αριθμός επικοινωνίας είναι {pcn}.", "PCN: {pcn}"],
    "licence": ["Η άδεια οδήγησης {licence} έληξε.", "Άδεια {licence}, ΑΦΜ {afm}."],
    "boundary": ["Διεύθυνση: {boundary_address}; ώρα {~cvv}.", "({boundary_address})", "Παράδοση: {boundary_address}."],
    "called": ["Αγαπητέ {person}, σας περιμένουμε.", "Καλημέρα {titled_person}!"],
    "foreign": ["Η συνάντηση με {foreign_person} αναβλήθηκε.", "From: {foreign_person}"],
    "dense": ["{person}, φάκελος {~gemi}, {~amount}, κωδικός {~account}, {~room}."],
    "addresses": ["Από {address} προς {boundary_address}.", "Έδρα: {address}· υποκατάστημα: {boundary_address}."],
    "old": ["Ἐν τῇ ὁδῷ {old_address} κατοικεῖ.", "Γράμμα πρὸς {old_address}."],
    "brief": ["Στο {boundary_address}.", "{address}"],
    "no_address": ["{person}, {~room}, {~amount}, {greek_date}.", "{~office}: {person}, {amka}."],
    "ama": ["Αριθμός μητρώου ασφαλισμένου {ama}.", "ΑΜΑ: {ama}, όχι {~account}."],
    "amka": ["ΑΜΚΑ {amka}.", "Ο ασφαλισμένος {amka} ζητά ραντεβού στις {~date}."],
    "afm": ["ΑΦΜ {afm} και κωδικός {~licence}.", "Τιμολόγιο προς {afm}."],
    "gemi": ["ΓΕΜΗ {gemi}.", "Η εταιρεία με αριθμό {gemi} έχει κωδικό {~account}."],
    "looks_alike": ["Το {~loose_imei} δεν είναι συσκευή, το {imei} είναι.", "Ο κωδικός {~pcn} και το ΑΦΜ {afm}.", "Πλαίσιο {vin}, πινακίδα {plate}, δέμα {~gemi}."],
    "plain": ["Με λένε {person} και μένω στη διεύθυνση {address}.", "ΑΦΜ {afm}, ΑΔΤ {adt}, IBAN {iban_gr}.", "Γράψτε στο {email} ή στο {deep_url}."],
    "one": [" Τηλέφωνο: {phone}.", " Γράψτε στο {email}.", " ΑΦΜ {afm}."],
    "two": [" {person}, τηλέφωνο {phone}.", " ΑΜΚΑ {amka}, ταυτότητα {adt}."],
    "three": [" {person}, {address}, {phone}.", " IBAN {iban_gr}, ΑΦΜ {afm}, {email}."],
}

#: Shares of the kinds of template in each pack (fixed values).
PACKS = {
    "curriculum": {"easy": 0.34, "medium": 0.33, "hard": 0.23, "hard_negative": 0.10},
    "hard_eval": {"easy": 0.10, "medium": 0.30, "hard": 0.60},
    "golden": {"easy": 12.0, "medium": 15.0, "hard": 8.0, "hard_negative": 7.0},
    "confusables": {"confusable": 0.7, "hard_negative": 0.3},
    "cvv_url_secret": {"cvv": 0.4, "url": 0.3, "secret": 0.3},
    "people": {"one_name": 0.85, "two_names": 0.15},
    "early": {"plain": 0.8, "hard_negative": 0.2},
    "boundaries": {"token": 0.10, "network": 0.10, "pcn": 0.08, "called": 0.40, "licence": 0.16, "boundary": 0.16},
    "people_and_places": {"called": 0.22, "foreign": 0.10, "dense": 0.22, "addresses": 0.12, "old": 0.07, "brief": 0.09, "no_address": 0.06, "password": 0.12},
    "recall": {"ama": 0.25, "amka": 0.20, "afm": 0.15, "gemi": 0.15, "licence": 0.13, "network": 0.12},
    "alike": {"looks_alike": 0.7, "confusable": 0.3},
}
#: How many values a carrier sentence gets (fixed values).
APPENDED = {"one": 0.5, "two": 0.35, "three": 0.15}
#: How a value is announced (fixed values); a card's check number always is.
ANNOUNCED = {"no_prefix": 0.25, "greek": 0.35, "greeklish": 0.20, "english": 0.20}

WORDS = {
    "passport": {"greek": "διαβατήριο", "greeklish": "diavatirio", "english": "passport"},
    "plate": {"greek": "πινακίδα", "greeklish": "pinakida", "english": "plate"},
    "vin": {"greek": "αριθμός πλαισίου", "greeklish": "arithmos plaisiou", "english": "VIN"},
    "gemi": {"greek": "ΓΕΜΗ", "greeklish": "GEMI", "english": "registry no"},
    "card": {"greek": "κάρτα", "greeklish": "karta", "english": "card"},
    "cvv": {"greek": "κωδικός ασφαλείας", "greeklish": "kodikos asfaleias", "english": "CVV"},
    "imei": {"greek": "ΙΜΕΙ συσκευής", "greeklish": "imei syskevis", "english": "IMEI"},
    "ipv4": {"greek": "διεύθυνση IP", "greeklish": "dieuthinsi IP", "english": "IP address"},
    "mac": {"greek": "διεύθυνση MAC", "greeklish": "dieuthinsi MAC", "english": "MAC"},
}


def parsed(template: str) -> list[dict]:
    """Pieces of a template: literal text, or a slot and the category of its label if it has one."""
    out, at = [], 0
    for m in _SLOT.finditer(template):
        if m.start() > at:
            out.append({"literal": template[at : m.start()]})
        out.append({"slot": m[2]} if m[1] else {"slot": m[2], "category": CATEGORY.get(m[2], m[2])})
        at = m.end()
    return [*out, {"literal": template[at:]}] if at < len(template) else out


def filled(said: Column, lead: Column | None = None) -> Column:
    """Struct text and label of an array of struct category, value; an empty value has no label."""
    kind = f"struct<text:string,label:{LABEL}>"
    zero = F.struct(F.coalesce(lead, F.lit("")) if lead is not None else F.lit(""), F.array().cast(LABEL)).cast(kind)

    def step(s: Column, p: Column) -> Column:
        one = F.array(F.struct(p["category"], F.length(s["text"]), F.length(s["text"]) + F.length(p["value"]))).cast(LABEL)
        return F.struct(F.concat(s["text"], p["value"]), F.when(p["category"].isNotNull() & (p["value"] != ""), F.concat(s["label"], one)).otherwise(s["label"])).cast(kind)

    return F.aggregate(said, zero, step)


def render(values: DataFrame, weights: dict[str, float], seed: int, templates: dict[str, list[str]] = TEMPLATES, key: str = "ix", lead: str | None = None) -> DataFrame:
    """``key``, text, label and info (difficulty, strategy, source) of a record for each row of ``values``.

    A kind of template is drawn by ``weights`` and one of its templates evenly;
    the other columns of ``values`` fill the slots, null as nothing.  ``lead``:
    a column whose text comes first.  A slot without a column is an error.
    """
    known = {k: [parsed(t) for t in templates[k]] for k in weights}
    slots = sorted({p["slot"] for ts in known.values() for t in ts for p in t if "slot" in p})
    if absent := [s for s in slots if s not in values.columns]:
        raise ValueError(f"no values for {', '.join(absent)}")
    shape = "map<string,array<array<struct<literal:string,slot:string,category:string>>>>"
    of_kind = F.from_json(F.lit(json.dumps(known, ensure_ascii=False)), shape)[F.col("kind")]
    shown = F.create_map(*[c for s in slots for c in (F.lit(s), F.col(s).cast("string"))]) if slots else F.create_map().cast("map<string,string>")
    #: A generator's output is computed once, however often it is used afterwards.
    r = values.select(key, *([lead] if lead else []), F.explode(F.array(F.struct(weighted_choice(uniform(seed, key), weights).alias("kind"), shown.alias("shown")))).alias("v"))
    r = r.select(key, *([lead] if lead else []), "v.*").withColumn("all", of_kind)
    pieces = F.col("all")[(uniform(seed + 1, key) * F.size("all")).cast("int")]
    said = F.transform(pieces, lambda p: F.struct(p["category"].alias("category"), F.coalesce(F.when(p["slot"].isNull(), p["literal"]).otherwise(F.col("shown")[p["slot"]]), F.lit("")).alias("value")))
    r = r.withColumn("r", filled(said, F.col(lead) if lead else None))
    difficulty = F.when(F.col("kind").isin("easy", "medium", "hard", "hard_negative"), F.col("kind")).otherwise(F.when(F.size("r.label") > 0, "medium").otherwise("hard_negative"))
    info = F.create_map(F.lit("difficulty"), difficulty, F.lit("strategy"), F.concat(F.lit("template/"), F.col("kind")), F.lit("source"), F.lit("synthetic"))
    return r.select(key, "r.text", "r.label", info.alias("info"))


def slots_of(kinds, templates: dict[str, list[str]] = TEMPLATES) -> list[str]:
    """Names of the columns that the templates of some kinds need."""
    return sorted({p["slot"] for k in kinds for t in templates[k] for p in parsed(t) if "slot" in p})


def with_values(rows: DataFrame, seed: int, key: str = "ix", only: list[str] | None = None) -> DataFrame:
    """``key`` and a value for each slot of the templates, or for those in ``only``, beside ``rows``' own columns."""
    ix = F.col(key)
    drawn = values(ix, seed + 30) | identifiers(ix, seed) | {"person": person(ix, seed + 50), "other": person(ix, seed + 70), "address": address(ix, seed + 90)}
    drawn["card"] = with_luhn(F.concat(F.lit("4"), digits(seed + 95, ix, 14)), 15)
    return rows.select("*", *[v.alias(k) for k, v in drawn.items() if only is None or k in only])


def pack(spark: SparkSession, name: str, n: int, seed: int) -> DataFrame:
    """``n`` records of a pack: ix, text, label, info."""
    return render(with_values(spark.range(n).withColumnRenamed("id", "ix"), seed, only=slots_of(PACKS[name])), PACKS[name], seed)


def appended(carriers: DataFrame, seed: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, text, label and info: every carrier's text with a clause of one to three values after it."""
    lead = carriers.select(key, F.col(text).alias("lead"))
    return render(with_values(lead, seed, key, slots_of(APPENDED)), APPENDED, seed, key=key, lead="lead")


def announced_values(rows: DataFrame, words: dict[str, dict[str, str]], shares: dict[str, float], seed: int) -> DataFrame:
    """ix, category, mode, text, label of rows ix, category, value: each value behind a word of its class, drawn by ix and class.

    ``words`` has a word for each class and mode, ``shares`` how often a mode is
    drawn; the word isn't in the value's span.  A mode without a word for a class
    announces nothing, and a class without words has no row.
    """
    listed = F.from_json(F.lit(json.dumps(words, ensure_ascii=False)), "map<string,map<string,string>>")
    rows = rows.withColumn("words_", listed[F.col("category")]).where("words_ is not null").withColumn("mode", weighted_choice(uniform(seed, "category", "ix"), shares))
    before = F.coalesce(F.concat(F.col("words_")[F.col("mode")], chosen(seed + 1, F.concat_ws(":", "category", "ix"), [": ", " ", " - "])), F.lit(""))
    ends = F.struct(F.col("category"), F.length(before), F.length(before) + F.length("value"))
    return rows.select("ix", "category", "mode", F.concat(before, F.col("value"), F.lit(".")).alias("text"), F.array(ends).cast(LABEL).alias("label"))


def announced(spark: SparkSession, per_class: int, seed: int) -> DataFrame:
    """``per_class`` records for each class of ``WORDS``: ix, category, mode, text, label; the word that announces a value isn't in its span."""
    rows = cards_and_devices(spark, per_class, seed)
    made = identifiers(F.col("ix"), seed)
    values = {c: F.col(c) if c in rows.columns else made[c] for c in WORDS}
    rows = rows.select("ix", F.explode(F.create_map(*[x for c, v in values.items() for x in (F.lit(c), v)])).alias("category", "value"))
    forced = {m: w for m, w in ANNOUNCED.items() if m != "no_prefix"}
    u = uniform(seed, "category", "ix")
    rows = rows.withColumn("mode", F.when(F.col("category") == "cvv", weighted_choice(u, forced)).otherwise(weighted_choice(u, ANNOUNCED)))
    words = F.from_json(F.lit(json.dumps(WORDS, ensure_ascii=False)), "map<string,map<string,string>>")
    word = words[F.col("category")][F.col("mode")]
    before = F.coalesce(F.concat(word, chosen(seed + 1, F.concat_ws(":", "category", "ix"), [": ", " ", " - "])), F.lit(""))
    ends = F.struct(F.col("category"), F.length(before), F.length(before) + F.length("value"))
    return rows.select("ix", "category", "mode", F.concat(before, F.col("value"), F.lit(".")).alias("text"), F.array(ends).cast(LABEL).alias("label"))
