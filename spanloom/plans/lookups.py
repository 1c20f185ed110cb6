"""Queries that look terms and prefixes of a table up in texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.cumulative import drawn, running_sum
from ..operators.prefixes import audit, counted_by_prefix
from ..operators.sample import uniform
from ..operators.terms import WORD, find_terms
from .catalogue import docs, query, read

#: Phrases of one to three words of the benchmark's texts, of eight characters or more, with single spaces between.
_BENCH = r"""b AS (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+( [\p{L}\p{N}_]+)*')) AS stretch FROM benchmark),
bw AS (SELECT string_split(stretch, ' ') AS ws FROM b),
terms AS MATERIALIZED (SELECT DISTINCT term FROM (SELECT unnest(list_transform(range(1, len(ws) + 2 - n), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS term FROM bw, (VALUES (1), (2), (3)) v(n)) WHERE length(term) >= 8)"""
#: Words of the documents with their places.
_WORDS = r"""w0 AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS word, unnest(string_split_regex(text, '[\p{L}\p{N}_]+')[1:-2]) AS gap, unnest(range(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')))) AS ix FROM documents),
w1 AS (SELECT doc_id, ix, word, gap, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY ix) AS INTEGER) AS e FROM w0),
w2 AS (SELECT *, lead(word) OVER o AS word2, lead(gap) OVER o AS gap2, lead(e) OVER o AS e2, lead(word, 2) OVER o AS word3, lead(gap, 2) OVER o AS gap3, lead(e, 2) OVER o AS e3 FROM w1 WINDOW o AS (PARTITION BY doc_id ORDER BY ix)),
all_found AS MATERIALIZED (SELECT doc_id, term, e - length(word) AS "start", CASE n WHEN 1 THEN e WHEN 2 THEN e2 ELSE e3 END AS "end" FROM
 (SELECT doc_id, e, e2, e3, word, n, CASE n WHEN 1 THEN word WHEN 2 THEN CASE WHEN gap2 = ' ' THEN word || ' ' || word2 END ELSE CASE WHEN gap2 = ' ' AND gap3 = ' ' THEN word || ' ' || word2 || ' ' || word3 END END AS term FROM w2, (VALUES (1), (2), (3)) v(n)) JOIN terms USING (term))"""


def bench_terms(spark, d):
    """term: phrases of the benchmark."""
    stretch = read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(f"{WORD}(?: {WORD})*"), 0)).alias("s")).select(F.split("s", " ").alias("ws"))

    def grams(n: int):
        windows = F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.array_join(F.slice("ws", i, F.lit(n)), " "))
        return F.when(F.size("ws") >= n, windows).otherwise(F.array().cast("array<string>"))

    return stretch.select(F.explode(F.concat(*map(grams, (1, 2, 3)))).alias("term")).where("length(term) >= 8").distinct()


@query(f"WITH {_BENCH}, {_WORDS} SELECT term, count(*) AS n, count(DISTINCT doc_id) AS documents FROM all_found GROUP BY term")
def term_counts(spark, d):
    """How often every phrase of the benchmark stands in the documents, in whole words, overlaps counted each."""
    found = find_terms(docs(spark, d), bench_terms(spark, d), longest=False)
    return found.groupBy("term", "doc_id").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("documents"))


@query(f"""WITH RECURSIVE {_BENCH}, {_WORDS},
best AS (SELECT doc_id, "start", max("end") AS "end" FROM all_found GROUP BY ALL),
go(doc_id, "start", behind) AS (SELECT DISTINCT doc_id, -1, 0 FROM best UNION ALL SELECT b.doc_id, b."start", b."end" FROM go JOIN best b ON b.doc_id = go.doc_id AND b."start" = (SELECT min(x."start") FROM best x WHERE x.doc_id = go.doc_id AND x."start" >= go.behind))
SELECT f.doc_id, f.term, f."start", f."end" FROM all_found f JOIN go ON go.doc_id = f.doc_id AND go."start" = f."start" AND go.behind = f."end" """)
def term_spans(spark, d):
    """Phrases of the benchmark in the documents: from the left, the longest at each place."""
    return find_terms(docs(spark, d), bench_terms(spark, d))


_DRAWS = """r AS (SELECT doc_id, sum(n) OVER (ORDER BY doc_id) - n AS before, sum(n) OVER (ORDER BY doc_id) AS upto, sum(n) OVER () AS total FROM (SELECT doc_id, greatest(coalesce(n_chars, 0), 0) AS n FROM documents)),
a AS (SELECT doc_id AS drawer, CAST(floor(CAST(('0x' || left(md5(concat('31:', doc_id)), 8)) AS BIGINT) / 4294967296.0::DOUBLE * total) AS BIGINT) AS u FROM r)"""


@query(f"WITH {_DRAWS} SELECT drawer, u, doc_id FROM a JOIN r ON u >= before AND u < upto")
def weighted_draws(spark, d):
    """A draw for each document, with replacement: every document as likely as it is long."""
    t = docs(spark, d).select("doc_id", "n_chars")
    rows = running_sum(t, "n_chars", "doc_id")
    total = t.agg(F.coalesce(F.sum(F.greatest(F.coalesce("n_chars", F.lit(0)), F.lit(0))), F.lit(0))).first()[0]
    return drawn(rows, "doc_id", t.select(F.col("doc_id").alias("drawer"), F.floor(uniform(31, "doc_id") * total).alias("u")), "u")


#: The first four to seven letters of the benchmark's words, in digest order.
_PREFIXES = r"""bl AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\p{L}{4,}')) AS w FROM benchmark),
pre AS (SELECT prefix, md5(prefix) AS rank FROM (SELECT DISTINCT left(w, n) AS prefix FROM bl, (VALUES (4), (5), (6), (7)) v(n)) WHERE length(prefix) >= 4)"""


@query(rf"""WITH {_PREFIXES}, w AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\p{{L}}{{3,}}')) AS word FROM documents) GROUP BY 1),
m AS (SELECT word, n, arg_min(prefix, rank) AS prefix FROM w LEFT JOIN pre ON starts_with(word, prefix) GROUP BY ALL) SELECT prefix, count(*) AS different, sum(n)::BIGINT AS n FROM m GROUP BY prefix""")
def prefix_counts(spark, d):
    """Words of the documents by the beginnings of the benchmark's words, the first in digest order where several fit."""
    bench = read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}{4,}"), 0)).alias("w")).distinct()
    known = bench.select(F.explode(F.array(*[F.substring("w", 1, n) for n in (4, 5, 6, 7)])).alias("prefix")).distinct().withColumn("rank", F.md5("prefix"))
    words = docs(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}{3,}"), 0)).alias("word"))
    return counted_by_prefix(words, "word", known)


@query("""SELECT 'lang' AS field, count(*) FILTER (coalesce(lang, '') = '') AS missing, count(*) FILTER (lang <> '' AND lang NOT LIKE 'e%') AS unknown FROM documents
UNION ALL SELECT 'source', count(*) FILTER (coalesce(source, '') = ''), count(*) FILTER (source <> '' AND source NOT LIKE 'src1%' AND source NOT LIKE 'src2%') FROM documents
UNION ALL SELECT 'text', count(*) FILTER (coalesce(text, '') = ''), count(*) FILTER (text <> '') FROM documents""")
def prefix_audit(spark, d):
    known = spark.createDataFrame([("lang", "e"), ("source", "src1"), ("source", "src2"), ("text", "\u0002")], "field string, prefix string")
    return audit(docs(spark, d), {"lang": F.col("lang"), "source": F.col("source"), "text": F.substring("text", 1, 1)}, known)
