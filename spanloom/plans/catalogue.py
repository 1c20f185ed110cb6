"""Registered queries of the library itself, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import greek
from ..functions.spans import PATTERNS, all_spans, detect, luhn, normal, redact, shape, share
from ..operators import curate, report, sample

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

RATIOS = {"train": 0.8, "validation": 0.1, "test": 0.05, "hard_test": 0.05}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, d):
    return read(spark, d, "documents")


def gold(spark, d, *categories):
    return detect(docs(spark, d), categories=categories or tuple(PATTERNS)).select("doc_id", "category", "start", "end", "value")


#: Stand-ins for models see no ids: what they miss, cut short or confuse hangs on the value alone.
MISSED, CONFUSED, SHORT, MISSED_BY_OTHER = (f"substring(md5(value), {k}, 1) < '{x}'" for k, x in ((1, "2"), (2, "2"), (3, "3"), (4, "4")))


_ONE = """SELECT doc_id, lang, text, '{c}' AS category, regexp_extract_all(text, '{p}', 0) AS m, string_split_regex(text, '{p}') AS g FROM documents"""
SPANS = "f AS (" + " UNION ALL ".join(_ONE.format(c=c, p=p) for c, p in PATTERNS.items()) + """),
k AS (SELECT *, unnest(range(0, len(m))) AS i FROM f),
spans AS (SELECT doc_id, lang, category, value, CAST(s AS INTEGER) AS "start", CAST(s + length(value) AS INTEGER) AS "end" FROM
  (SELECT doc_id, lang, category, m[i+1] AS value, list_sum(list_transform(g[1:i+1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS s FROM k)),
gold AS (SELECT doc_id, category, "start", "end", value FROM spans),
""" + f"""pred AS (SELECT doc_id, CASE WHEN {CONFUSED} THEN 'phone' ELSE category END AS category, "start", CASE WHEN {SHORT} THEN "end" - 1 ELSE "end" END AS "end",
  CASE WHEN {SHORT} THEN left(value, length(value) - 1) ELSE value END AS value FROM gold WHERE NOT {MISSED})
"""
W = "WITH " + SPANS
_REDACT = "text"
for _c in ("secret", "email", "ipv4", "phone", "card"):
    _REDACT = f"regexp_replace({_REDACT}, '{PATTERNS[_c]}', '<{_c.upper()}>', 'g')"
_NORM = r"trim(regexp_replace(lower({}), '[ \t\r\n\f]+', ' ', 'g'))"


@query(W + 'SELECT doc_id, category, "start", "end", value FROM gold')
def span_detect(spark, d):
    return gold(spark, d)


@query(W + """SELECT category, count(*) AS n FROM (SELECT coalesce(s.category, '_hard_negative') AS category FROM documents d LEFT JOIN spans s USING (doc_id)) GROUP BY 1""")
def span_counts_per_class(spark, d):
    """Spans by class and documents without any."""
    s = docs(spark, d).select(F.explode_outer(all_spans(F.col("text"))).alias("s"))
    return s.groupBy(F.coalesce("s.category", F.lit("_hard_negative")).alias("category")).agg(F.count("*").alias("n"))


@query(W + "SELECT lang, category, count(*) AS n FROM spans GROUP BY ROLLUP (lang, category)")
def span_counts_by_lang_class(spark, d):
    return detect(docs(spark, d), "lang").rollup("lang", "category").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, sha256({_REDACT}) AS redacted_sha256 FROM documents")
def redact_documents(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(F.encode(redact(F.col("text")), "UTF-8"), 256).alias("redacted_sha256"))


@query(f"SELECT doc_id, skeleton, n FROM (SELECT doc_id, skeleton, CAST(row_number() OVER (PARTITION BY skeleton ORDER BY doc_id) AS INTEGER) AS n FROM (SELECT doc_id, md5({_NORM.format(_REDACT)}) AS skeleton FROM documents)) WHERE n <= 300")
def skeleton_cap(spark, d):
    return curate.skeleton_rank(docs(spark, d))


_REASON = """CASE WHEN trim(text) = '' THEN 'empty_text' WHEN length(text) < 30 THEN 'too_short' WHEN length(text) > 5000 THEN 'too_long'
 WHEN regexp_matches(text, '[%]{3}|[$]{3}|[#]{3}') THEN 'artifact:marks' WHEN regexp_matches(text, '[<][a-zA-Z/]') THEN 'artifact:tag' ELSE 'ok' END"""


@query(f"SELECT doc_id, {_REASON} AS reason FROM documents")
def quality_reasons(spark, d):
    return docs(spark, d).select("doc_id", curate.quality_reason(F.col("text")).alias("reason"))


@query(f"SELECT reason, count(*) AS n FROM (SELECT {_REASON} AS reason FROM documents) GROUP BY 1 ORDER BY n DESC, reason")
def quality_hist(spark, d):
    """The commonest first."""
    return quality_reasons(spark, d).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


@query("SELECT doc_id, round(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / nullif(length(regexp_replace(text, '[^A-Za-zÀ-ÖØ-öø-ÿ]', '', 'g')), 0), 6) AS ascii_share FROM documents")
def script_ratios(spark, d):
    return docs(spark, d).select("doc_id", F.round(share(F.col("text"), "A-Za-z"), 6).alias("ascii_share"))


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5({_NORM.format('text')})")
def dedup_exact_norm(spark, d):
    return curate.first_of(docs(spark, d), F.md5(normal(F.col("text")))).select("doc_id")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def dedup_raw(spark, d):
    return docs(spark, d).groupBy(F.sha2(F.encode("text", "UTF-8"), 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


SPLIT = """r AS (SELECT *, row_number() OVER (ORDER BY md5(concat('42:', doc_id)), doc_id) AS rn, count(*) OVER () AS n FROM documents),
split AS (SELECT *, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM r)"""


@query(f"WITH {SPLIT} SELECT doc_id, split FROM split")
def ratio_split(spark, d):
    return curate.ratio_split(docs(spark, d), 0.8, 0.1, 42)


@query(f"WITH {SPLIT} SELECT coalesce(sum(n - 1), 0)::BIGINT AS leaked FROM (SELECT count(DISTINCT split) AS n FROM split GROUP BY text)")
def cross_split_leakage(spark, d):
    """Texts in several splits; a text's digest goes along with its rank, so texts are read once and not shuffled."""
    rows = docs(spark, d).select("doc_id", curate.text_digest(F.col("text")).alias("h"))
    return curate.leaks(curate.ratio_split(rows, 0.8, 0.1, 42, "h"))


_QUOTA = "VALUES (0,'train',0.8::DOUBLE),(1,'validation',0.1::DOUBLE),(2,'test',0.05::DOUBLE),(3,'hard_test',0.05::DOUBLE)"


@query(f"""WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), b(ix, split, w) AS ({_QUOTA}),
q AS (SELECT lang, n, ix, split, floor(n*w) AS q, n*w - floor(n*w) AS rest FROM n, b),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY rest DESC, ix) AS r, n - sum(q) OVER (PARTITION BY lang) AS extra FROM q),
u AS (SELECT lang, split, ix, q + CASE WHEN r <= extra THEN 1 ELSE 0 END AS q FROM r),
c AS (SELECT lang, split, sum(q) OVER (PARTITION BY lang ORDER BY ix) AS upto, q FROM u),
d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat('1337:', doc_id))) AS rn FROM documents)
SELECT doc_id, d.lang, split FROM d JOIN c ON d.lang IS NOT DISTINCT FROM c.lang AND rn <= upto AND rn > upto - q""")
def stratified_split(spark, d):
    return curate.stratified_split(docs(spark, d), "lang", RATIOS, 1337)


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat('7:', doc_id))) AS r FROM documents) WHERE r <= 20")
def source_quota(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(curate.draw(7, "doc_id"))
    return docs(spark, d).select("doc_id", "source", F.row_number().over(w).alias("r")).where("r <= 20").drop("r")


@query("""SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) l
JOIN (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark) b ON l.line = b.line WHERE length(l.line) >= 40""")
def benchmark_contamination(spark, d):
    lines = lambda t, k: t.select(k, F.explode(F.split("text", "\n")).alias("line")).where("length(line) >= 40")
    return lines(docs(spark, d), "doc_id").join(lines(read(spark, d, "benchmark"), "item_id"), "line").select("doc_id", "item_id").distinct()


@query("SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(^|[^A-Za-z0-9_])(card|email|ipv4|phone|token)($|[^A-Za-z0-9_])')")
def label_leakage_filter(spark, d):
    return docs(spark, d).where(~F.col("text").rlike("(^|[^A-Za-z0-9_])(card|email|ipv4|phone|token)($|[^A-Za-z0-9_])")).select("doc_id")


@query(W + """SELECT doc_id, count(*) AS kept FROM gold WHERE NOT (category = 'card' AND regexp_matches(value, '^[4-6]')) GROUP BY doc_id""")
def value_conflict_filter(spark, d):
    return gold(spark, d).where("not (category = 'card' and value rlike '^[4-6]')").groupBy("doc_id").agg(F.count("*").alias("kept"))


@query(W + """SELECT doc_id, category, "start", "end", rule FROM (SELECT s.*, CASE WHEN "start" < 0 OR "start" >= "end" THEN 'offset_order' WHEN "end" > length(text) THEN 'offset_range'
 WHEN substring(text, "start" + 1, "end" - "start") <> value THEN 'value' END AS rule FROM (SELECT doc_id, category, CASE WHEN doc_id % 3 = 0 THEN "end" ELSE "start" END AS "start", "end" + CASE WHEN doc_id % 4 = 0 THEN 100000 ELSE 0 END AS "end", value FROM gold) s JOIN documents USING (doc_id)) WHERE rule IS NOT NULL""")
def schema_violations(spark, d):
    bad = gold(spark, d).withColumn("start", F.expr("if(doc_id % 3 = 0, end, start)")).withColumn("end", F.expr("end + if(doc_id % 4 = 0, 100000, 0)"))
    return curate.span_violations(docs(spark, d), bad)


@query(W + "SELECT category, count(*) AS n FROM gold WHERE category NOT IN ('card', 'email', 'phone') GROUP BY 1")
def label_space_coverage(spark, d):
    space = spark.createDataFrame([("card",), ("email",), ("phone",)], "category string")
    return gold(spark, d).join(space, "category", "left_anti").groupBy("category").agg(F.count("*").alias("n"))


@query(W + "SELECT c.category, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) >= 8 THEN 'OK' ELSE 'LOW' END AS status FROM (VALUES ('card'),('email'),('ipv4'),('iban'),('phone'),('secret')) c(category) LEFT JOIN (SELECT category, count(*) AS n FROM gold GROUP BY 1) g USING (category)")
def class_coverage(spark, d):
    space = spark.createDataFrame([(c,) for c in ("card", "email", "ipv4", "iban", "phone", "secret")], "category string")
    n = space.join(gold(spark, d).groupBy("category").agg(F.count("*").alias("n")), "category", "left").na.fill(0)
    return n.withColumn("status", F.when(F.col("n") >= 8, "OK").otherwise("LOW"))


@query("SELECT lang, source, count(*) AS n, count(*) FILTER (source NOT LIKE 'src1%') AS unknown_source FROM documents GROUP BY GROUPING SETS ((lang), (source))")
def provenance_audit(spark, d):
    t = docs(spark, d)
    unknown = F.count_if(~F.col("source").startswith("src1")).alias("unknown_source")
    one = lambda c, other: t.groupBy(c).agg(F.count("*").alias("n"), unknown).withColumn(other, F.lit(None).cast("string")).select("lang", "source", "n", "unknown_source")
    return one("lang", "source").unionByName(one("source", "lang"))


_LUHN = "(list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN (2 * CAST(value[i] AS INTEGER)) // 10 + (2 * CAST(value[i] AS INTEGER)) % 10 ELSE CAST(value[i] AS INTEGER) END)) % 10) = 0"


@query(W + f"SELECT doc_id, value, {_LUHN} AS valid FROM gold WHERE category = 'card'")
def value_format_check(spark, d):
    return gold(spark, d, "card").select("doc_id", "value", luhn(F.col("value")).alias("valid"))


@query(W + """SELECT doc_id, category, replace(substring(text, greatest(0, "start" - 42) + 1, "end" + 42 - greatest(0, "start" - 42)), chr(10), '\\n') AS context, "start" FROM gold JOIN documents USING (doc_id)""")
def context_window(spark, d):
    return detect(docs(spark, d), "text").select("doc_id", "category", F.replace(F.expr("substring(text, greatest(0, start - 42) + 1, end + 42 - greatest(0, start - 42))"), F.lit("\n"), F.lit("\\n")).alias("context"), "start")


@query(W + """SELECT doc_id, "start" + 9 AS "start", "end" - 1 AS "end", substring(value, 10, 40) AS value FROM gold WHERE category = 'secret'""")
def boundary_relabel(spark, d):
    """Secrets without the assignment around them."""
    return gold(spark, d, "secret").select("doc_id", (F.col("start") + 9).alias("start"), (F.col("end") - 1).alias("end"), F.substring("value", 10, 40).alias("value"))


@query(W + """SELECT category, regexp_replace(regexp_replace(regexp_replace(value, '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g'), '[0-9]', '9', 'g') AS shape, count(*) AS n FROM gold GROUP BY 1, 2""")
def value_shapes(spark, d):
    return gold(spark, d).groupBy("category", shape(F.col("value")).alias("shape")).agg(F.count("*").alias("n"))


@query(W + """SELECT doc_id, category, value, CAST(strpos(text, value) - 1 AS INTEGER) AS first_start FROM gold JOIN documents USING (doc_id)""")
def resolve_first(spark, d):
    return detect(docs(spark, d), "text").select("doc_id", "category", "value", (F.expr("locate(value, text)") - 1).alias("first_start"))


@query("""SELECT conv_id, count(*) AS turns, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS thread_md5 FROM conversations GROUP BY conv_id""")
def chat_threads(spark, d):
    t = read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sort_array(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line")))).alias("x"))
    return t.select("conv_id", "turns", F.md5(F.array_join("x.line", "\n")).alias("thread_md5"))


@query("""SELECT page_id, regexp_matches(html, '[<]script') AS has_script, CAST(len(regexp_extract_all(html, '[<][a-z]+', 0)) AS INTEGER) AS tags FROM pages""")
def artifact_pages(spark, d):
    return read(spark, d, "pages").select("page_id", F.col("html").rlike("[<]script").alias("has_script"), F.size(F.regexp_extract_all("html", F.lit("[<][a-z]+"), 0)).alias("tags"))


@query("""SELECT origin, count(*) AS n, sum(length(text))::BIGINT AS characters FROM (SELECT 'documents' AS origin, text FROM documents UNION ALL SELECT 'conversations', text FROM conversations UNION ALL SELECT 'benchmark', text FROM benchmark) GROUP BY 1""")
def union_sources(spark, d):
    parts = [read(spark, d, t).select(F.lit(t).alias("origin"), "text") for t in ("documents", "conversations", "benchmark")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("origin").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("characters"))


#: Sentence after sentence: where its chunk begins and how long it counts by then.
CHUNKS = r"""f AS (SELECT doc_id, source, trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL),
s0 AS (SELECT doc_id, source, string_split(regexp_replace(t, '([.!?·;]) +', '\1' || chr(1), 'g'), chr(1)) AS xs FROM f WHERE length(t) > 220),
s AS MATERIALIZED (SELECT doc_id, source, unnest(range(1, len(xs) + 1)) AS i, unnest(xs) AS x FROM s0),
w(doc_id, i, n, first) AS (SELECT DISTINCT doc_id, 0::BIGINT, 0::BIGINT, 1::BIGINT FROM s UNION ALL
 SELECT s.doc_id, s.i, CASE WHEN n + length(x) + 1 > 220 THEN length(x) ELSE n + length(x) + 1 END, CASE WHEN n + length(x) + 1 > 220 THEN s.i ELSE first END FROM w JOIN s ON s.doc_id = w.doc_id AND s.i = w.i + 1),
c0 AS (SELECT doc_id, any_value(source) AS source, first, string_agg(x, ' ' ORDER BY i) AS chunk, max(n) AS n FROM w JOIN s USING (doc_id, i) GROUP BY doc_id, first),
chunks AS MATERIALIZED (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS ix, chunk FROM c0 WHERE n >= 40 UNION ALL SELECT doc_id, source, 0, t FROM f WHERE length(t) BETWEEN 40 AND 220)"""


@query(f"WITH RECURSIVE {CHUNKS} SELECT doc_id, CAST(ix AS INTEGER) AS ix, chunk FROM chunks")
def greedy_chunks(spark, d):
    from ..operators.transform import chunks

    return docs(spark, d).select("doc_id", F.posexplode(chunks(F.col("text"), 40, 220)).alias("ix", "chunk"))


@query(W + """SELECT doc_id, count(s.category) AS n_spans FROM documents d LEFT JOIN spans s USING (doc_id) GROUP BY doc_id""")
def to_chat(spark, d):
    from ..operators.transform import to_chat as chat

    c = chat(docs(spark, d), gold(spark, d), "List the spans.", 10**6)
    return c.select("doc_id", F.size(F.from_json(F.element_at("messages", 3)["content"], "array<struct<label:string,value:string>>")).cast("long").alias("n_spans"))


@query(W + 'SELECT doc_id, category AS label, "start", "end" FROM gold')
def resolve_cursor_strict(spark, d):
    """Offsets found again from ordered values, a cursor for each class, as the classes' spans may overlap; the detected ones come back."""
    from ..operators.resolve import resolve

    v = gold(spark, d).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("start", "category", "value"))), lambda x: F.struct(x["category"].alias("label"), x["value"].alias("value"))).alias("v"))
    j = docs(spark, d).select("doc_id", "text").join(v, "doc_id")
    return j.select("doc_id", F.inline(resolve(F.col("text"), F.col("v"), "label", strict=True))).select("doc_id", "label", "start", "end")


@query("""WITH a AS (SELECT doc_id, source, n_chars > 3000 AS hard, md5(concat('9:', doc_id)) AS o FROM documents),
b AS (SELECT *, hard AND row_number() OVER (PARTITION BY source ORDER BY hard DESC, o) <= 2 AS in_hard FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY in_hard, o) AS r FROM b)
SELECT doc_id, source, split FROM (SELECT doc_id, source, CASE WHEN in_hard THEN 'hard_test' WHEN r <= 28 THEN 'train' WHEN r <= 34 THEN 'validation' WHEN r <= 38 THEN 'test' END AS split FROM c) WHERE split IS NOT NULL""")
def quota_split(spark, d):
    from ..operators.quota import quota_split as split

    return split(docs(spark, d), "source", "n_chars > 3000", 40, 9)


@query(W + """SELECT doc_id, category, value, CASE category WHEN 'card' THEN concat(value[1:4], ' ', value[5:8], ' ', value[9:12], ' ', value[13:16]) ELSE regexp_replace(value, '[^0-9]', '', 'g') END AS rewritten FROM gold WHERE category IN ('card', 'phone')""")
def format_augment(spark, d):
    """Cards in groups of four and phones as bare digits."""
    four = F.concat_ws(" ", *[F.substring("value", 4 * k + 1, 4) for k in range(4)])
    return gold(spark, d, "card", "phone").select("doc_id", "category", "value", F.when(F.col("category") == "card", four).otherwise(F.regexp_replace("value", "[^0-9]", "")).alias("rewritten"))


@query(None)
def gen_tier1(spark, d):
    """Generated values with check digits; tested by their properties."""
    from ..functions.generate import cards_and_devices

    return cards_and_devices(spark, 1000, 17)


_SENTENCES = r"""SELECT doc_id, trim(regexp_replace(unnest(string_split(regexp_replace(text, '([.!;·])[ \t\r\n\f]+', '\1' || chr(1), 'g'), chr(1))), '[ \t\r\n\f]+', ' ', 'g')) AS sentence FROM documents"""


@query(rf"""SELECT doc_id, sentence FROM ({_SENTENCES}) WHERE length(sentence) BETWEEN 40 AND 220 AND length(sentence) - length(replace(sentence, ' ', '')) + 1 >= 6
 AND regexp_matches(sentence, '[.!;·]$') AND length(regexp_replace(sentence, '[^A-Za-z]', '', 'g')) / nullif(length(regexp_replace(sentence, '[^\p{{L}}]', '', 'g')), 0) >= 0.9""")
def usable_sentences(spark, d):
    """Whole sentences of 40 to 220 characters and six words, nine letters in ten unaccented."""
    s = docs(spark, d).select("doc_id", F.explode(greek.sentences(F.col("text"))).alias("sentence"))
    return s.where(greek.usable(F.col("sentence"), 40, 220, 6, 0.9, ".!;·", "A-Za-z"))


_LETTERS = r"length(regexp_replace(text, '[^\p{L}]', '', 'g'))"


@query(rf"""SELECT conv_id, turn, CASE WHEN trim(regexp_replace(coalesce(text, ''), '[ \t\r\n\f]+', ' ', 'g')) = '' THEN 'empty_text' WHEN length(text) < 30 THEN 'too_short' WHEN length(text) > 300 THEN 'too_long'
 WHEN regexp_matches(text, '(?i)here[''’]?s a') THEN 'artifact:(?i)here[''’]?s a' WHEN regexp_matches(text, '(?i)thinking process') THEN 'artifact:(?i)thinking process' WHEN contains(text, '```') THEN 'artifact:```'
 WHEN regexp_matches(text, '(?i)<[a-z]+[\s>]') THEN 'artifact:<[a-z]+[\s>]' WHEN length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / nullif({_LETTERS}, 0) > 0.3 THEN 'low_greek_high_latin' ELSE 'ok' END AS reason FROM conversations""")
def record_reasons(spark, d):
    """The whole cascade over turns without spans; tests/test_records.py has the spans' reasons."""
    none = F.array().cast("array<struct<category:string,start:int,end:int>>")
    return read(spark, d, "conversations").select("conv_id", "turn", greek.record_reason(F.col("text"), none).alias("reason"))


@query(r"""SELECT doc_id FROM documents WHERE NOT regexp_matches(replace(text, 'license', 'private_person'), '(^|[^\p{L}\p{N}_])(""" + "|".join(greek.LABEL_IDS) + r"""|(?i:secret))($|[^\p{L}\p{N}_])')""")
def label_id_leakage(spark, d):
    """Texts without a label's name, over texts that name one wherever they name a license."""
    return docs(spark, d).where(~greek.leaks_label(F.replace("text", F.lit("license"), F.lit("private_person")))).select("doc_id")


MARKS = ("", "EL", "ΑΦΜ ", "Α.Φ.Μ.: ", "X ")


def spelled(value, size: int, hard=None):
    """Struct value, mark, long of a number in one of five spellings by its digest, too long for some; ``hard`` says where it may be wrong."""
    sign = lambda k: F.conv(F.substring(F.md5(value), k, 1), 16, 10).cast("int")
    own = F.lpad(F.substring(value, 1, size), size, "0")
    wrong = F.lit(True) if hard is None else hard
    mark = F.element_at(F.array(*[F.lit(m) for m in MARKS]), F.when(wrong, sign(1) % 5).otherwise(sign(1) % 4) + 1)
    return F.concat(mark, own, F.when(wrong & (sign(2) < 3), "1").otherwise(""))


def numbers(spark, d):
    """doc_id, k, lang and v: every number of three digits or more in the texts."""
    return docs(spark, d).select("doc_id", "lang", F.posexplode(F.regexp_extract_all("text", F.lit("[0-9]{3,}"), 0)).alias("k", "v"))


def greek_values(spark, d):
    """A tax number made from each number of the texts; English ones are sound."""
    return numbers(spark, d).select("doc_id", "k", "lang", spelled(F.col("v"), 9, F.coalesce(F.col("lang") != "en", F.lit(True))).alias("value"))


_HEX = "CAST(('0x' || substring(md5(v), {}, 1)) AS INTEGER)"
NUMBERS = f"""x0 AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '[0-9]{{3,}}')) AS v, unnest(range(len(regexp_extract_all(text, '[0-9]{{3,}}')))) AS k FROM documents),
x AS (SELECT doc_id, CAST(k AS INTEGER) AS k, lang, v, CASE WHEN lang = 'en' THEN {_HEX.format(1)} % 4 ELSE {_HEX.format(1)} % 5 END AS m, coalesce(lang <> 'en', true) AND {_HEX.format(2)} < 3 AS long FROM x0),
sized AS (SELECT *, [0, 2, 4, 8, 2][m + 1] AS shift, CASE WHEN m = 4 OR long THEN 'unparseable' WHEN m = 0 THEN 'clean' ELSE 'relabelled' END AS status FROM x)"""


@query(f"WITH {NUMBERS} SELECT doc_id, k, CASE WHEN status <> 'unparseable' THEN CAST(shift AS INTEGER) END AS shift, status FROM sized")
def afm_relabel(spark, d):
    return greek_values(spark, d).select("doc_id", "k", greek.nine_digits(F.col("value")).alias("x")).select("doc_id", "k", "x.*")


@query(f"""WITH {NUMBERS}, k AS (SELECT ['afm', 'amka', 'iban_gr'][{_HEX.format(3)} % 3 + 1] AS category, *, {_HEX.format(2)} < 3 AS odd FROM x)
SELECT category, coalesce(problem, 'ok') AS problem, count(*) AS n FROM (SELECT category, CASE category WHEN 'afm' THEN CASE WHEN {_HEX.format(1)} % 5 = 4 OR odd THEN 'afm_format' END WHEN 'amka' THEN CASE WHEN {_HEX.format(1)} % 5 > 0 OR odd THEN 'amka_format' END
 ELSE CASE WHEN odd THEN 'iban_format' END END AS problem FROM k) GROUP BY ALL""")
def greek_value_check(spark, d):
    """Tax, insurance and account numbers made from the numbers of the texts, by what is wrong with them."""
    v = F.col("v")
    sign = lambda k: F.conv(F.substring(F.md5(v), k, 1), 16, 10).cast("int")
    category = F.element_at(F.array(*[F.lit(c) for c in ("afm", "amka", "iban_gr")]), sign(3) % 3 + 1)
    iban = F.concat(F.lit("gr"), F.lpad(v, 16, "0"), F.when(sign(1) < 8, " ").otherwise("-"), F.lpad(v, 9, "1"), F.when(sign(2) < 3, "0").otherwise(""))
    value = F.when(category == "iban_gr", iban).when(category == "amka", spelled(v, 11)).otherwise(spelled(v, 9))
    return numbers(spark, d).select(category.alias("category"), F.coalesce(greek.value_problem(category, value), F.lit("ok")).alias("problem")).groupBy("category", "problem").agg(F.count("*").alias("n"))


@query(W + """SELECT category, shape, count(*) AS n FROM (SELECT category, array_to_string(list_transform(regexp_extract_all(value, '[0-9]+|[A-Z]+|[a-z]+|.', 0),
 lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN concat('d', length(x)) WHEN regexp_matches(x, '^[A-Z]') THEN concat('A', length(x)) WHEN regexp_matches(x, '^[a-z]') THEN concat('a', length(x)) ELSE x END), '') AS shape FROM gold) GROUP BY 1, 2""")
def run_shapes(spark, d):
    return gold(spark, d).groupBy("category", greek.run_shape(F.col("value")).alias("shape")).agg(F.count("*").alias("n"))


@query(W + """SELECT doc_id, md5(text) AS text_md5, string_agg(category || ':' || "start" || '-' || "end", ' ' ORDER BY "start") AS spans, lang FROM documents JOIN (SELECT doc_id, category, "start", "end" FROM gold) USING (doc_id) GROUP BY ALL""")
def merged_rows(spark, d):
    rows = detect(docs(spark, d), "text", "lang").withColumn("info", F.create_map(F.lit("lang"), "lang")).withColumn("ix", F.col("start"))
    m = report.merged_rows(rows, "doc_id", "ix")
    show = F.transform("label", lambda s: F.concat(s["category"], F.lit(":"), s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))
    return m.select("doc_id", F.md5("text").alias("text_md5"), F.array_join(show, " ").alias("spans"), F.col("info")["lang"].alias("lang"))


@query("""SELECT 'lang' AS field, count(*) FILTER (coalesce(lang, '') = '') AS missing, count(*) FILTER (lang <> '' AND lang NOT IN ('en', 'fr')) AS unknown FROM documents
UNION ALL SELECT 'source', count(*) FILTER (coalesce(source, '') = ''), count(*) FILTER (source <> '' AND source NOT LIKE 'src1%') FROM documents""")
def value_audit(spark, d):
    return report.value_audit(docs(spark, d), {"lang": ("en", "fr"), "source": ()}, {"source": ("src1",)})


@query(W + """SELECT doc_id, coalesce(arg_min(category, "start"), '_hard_negative') AS label FROM documents LEFT JOIN (SELECT doc_id, category, "start" FROM gold) USING (doc_id) GROUP BY 1""")
def primary_label(spark, d):
    return docs(spark, d).select("doc_id", report.primary_label(all_spans(F.col("text")), True, "_hard_negative").alias("label"))


_DRAW = "CAST(('0x' || left(md5(concat('{}:', doc_id)), 8)) AS BIGINT) / 4294967296.0::DOUBLE"


@query(f"SELECT doc_id, CASE WHEN u < 0.5 THEN 'one' WHEN u < 0.85 THEN 'two' ELSE 'three' END AS spans FROM (SELECT doc_id, {_DRAW.format(5)} AS u FROM documents)")
def weighted_choice(spark, d):
    return docs(spark, d).select("doc_id", sample.weighted_choice(sample.uniform(5, "doc_id"), {"one": 0.5, "two": 0.35, "three": 0.15}).alias("spans"))


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY -ln(1 - {_DRAW.format(6)}) / n_chars, doc_id) AS r FROM documents WHERE n_chars > 0) WHERE r <= 25")
def weighted_sample(spark, d):
    return sample.weighted_sample(docs(spark, d).select("doc_id", "lang", "n_chars"), "n_chars", "lang", 25, 6).select("doc_id", "lang")


@query(W + f"SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM gold) OR {_DRAW.format(8)} >= 0.6")
def empty_dropout(spark, d):
    return sample.empty_dropout(docs(spark, d), F.size(all_spans(F.col("text"))) <= 0, 0.6, 8).select("doc_id")


@query("""SELECT event_id, CAST(nullif(regexp_extract(props, '"k": *(-?[0-9]+)', 1), '') AS BIGINT) AS k FROM events""")
def parse_props(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    """The final state of a stream over the table's files."""
    from ..sources.storage import scratch
    from ..streaming.resume import distinct_stream

    at = scratch(spark, "stream")
    schema = "user_id long, event_type string"
    # A pattern, as the stream's reader takes a plain path for a folder.
    distinct_stream(spark, f"{d}/events.parque[t]", schema, ["user_id", "event_type"], f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out")


@query(None)
def gen_greek(spark, d):
    """Generated identifiers; tested by their properties."""
    from ..functions.generate import greek_identifiers

    return greek_identifiers(spark, 1000, 3)


@query(None)
def gen_records(spark, d):
    """Records of sentence templates in every pack; tested by their properties."""
    from ..operators import render

    out = None
    for name in sorted(render.PACKS):
        one = render.pack(spark, name, 500, 11).select(F.lit(name).alias("pack"), "ix", "text", F.to_json("label").alias("label"), F.col("info")["difficulty"].alias("difficulty"))
        out = one if out is None else out.unionByName(one)
    return out


@query(None)
def gen_announced(spark, d):
    """Values announced by a word of one of three languages or none; tested by their properties."""
    from ..operators import render

    return render.announced(spark, 500, 7).withColumn("label", F.to_json("label"))


@query(None)
def append_values(spark, d):
    """Every document's text with a clause of one to three labelled values after it; tested by their properties."""
    from ..operators import render

    return render.appended(docs(spark, d), 13).select("doc_id", "text", F.to_json("label").alias("label"))


from . import curation, decoders, exchange, files, lookups, matching, streams  # noqa: E402, F401
