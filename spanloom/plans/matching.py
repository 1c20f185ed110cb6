"""Queries that hold predicted against expected spans, with their SQL.

Expected and predicted spans come from one scan and one search of the documents,
as rows that ``side`` tells apart.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.spans import all_spans
from ..operators import match, report
from ..operators.greedy import triage
from .catalogue import CONFUSED, MISSED, MISSED_BY_OTHER, SHORT, SPANS, W, docs, query

_PRED = f"if(NOT {MISSED}, struct(1 AS side, if({CONFUSED}, 'phone', s.category) AS category, s.start AS start, if({SHORT}, s.end - 1, s.end) AS end, if({SHORT}, left(s.value, length(s.value) - 1), s.value) AS value), null)"
_OTHER = f"if(NOT {MISSED_BY_OTHER}, struct(2 AS side, s.category AS category, s.start AS start, s.end AS end, s.value AS value), null)"
#: Predictions that lie across an expected span's end and ones that lie before it.
_ACROSS = "if(substring(md5(value), 5, 1) < '6', struct(1 AS side, 'phone' AS category, s.start + 3 AS start, s.end + 2 AS end, s.value AS value), null)"
_BEFORE = "if(substring(md5(value), 6, 1) < '4' AND s.start >= 6, struct(1 AS side, s.category AS category, s.start - 6 AS start, s.start - 1 AS end, s.value AS value), null)"
_GOLD = "struct(0 AS side, s.category AS category, s.start AS start, s.end AS end, s.value AS value)"


def sided(spark, d, *predicted: str):
    """doc_id, side, category, start, end, value: the detected spans as side 0 and stand-in predictions."""
    found = docs(spark, d).select("doc_id", F.explode(all_spans(F.col("text"))).alias("s")).select("doc_id", "s", F.col("s.value").alias("value"))
    rows = F.expr("filter(array(" + ", ".join([_GOLD, *predicted]) + "), x -> x is not null)")
    return found.select("doc_id", F.inline(rows))


_EXACT = """c AS (SELECT category, sum(least(g, p)) AS tp, sum(p) AS np, sum(g) AS ng FROM (SELECT category, coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM
 (SELECT doc_id, category, "start", "end", count(*) AS g FROM gold GROUP BY ALL) FULL JOIN (SELECT doc_id, category, "start", "end", count(*) AS p FROM pred GROUP BY ALL) USING (doc_id, category, "start", "end")) GROUP BY 1)"""


@query(W + f", {_EXACT} SELECT category, tp::BIGINT AS tp, (np - tp)::BIGINT AS fp, (ng - tp)::BIGINT AS fn, round(coalesce(tp / nullif(np, 0), 0), 6) AS precision, round(coalesce(tp / nullif(ng, 0), 0), 6) AS recall, round(coalesce(2.0 * tp::DOUBLE / nullif(np + ng, 0), 0), 6) AS f1 FROM c")
def span_match_exact(spark, d):
    return match.exact(sided(spark, d, _PRED))


_RIVAL = """, rival AS (SELECT * FROM pred UNION ALL SELECT doc_id, 'phone', "start" + 3, "end" + 2, value FROM gold WHERE substring(md5(value), 5, 1) < '6'
 UNION ALL SELECT doc_id, category, "start" - 6, "start" - 1, value FROM gold WHERE substring(md5(value), 6, 1) < '4' AND "start" >= 6)"""


@query(W + _RIVAL + """ SELECT doc_id, g.category AS gold_category, g."start" AS gold_start, g."end" AS gold_end, p.category AS pred_category, p."start" AS pred_start, p."end" AS pred_end
FROM gold g JOIN rival p USING (doc_id) WHERE g."start" < p."end" AND p."start" < g."end" """)
def span_match_overlap(spark, d):
    return match.overlaps(sided(spark, d, _PRED, _ACROSS, _BEFORE))


#: Each document's spans are gone through one after another; ``used`` holds the other side's numbers that are taken.
_NUMBERED = """, g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end", category) AS i FROM gold), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "start", "end", category) AS i FROM rival)"""
_MEET = """least(x."end", y."end") - greatest(x."start", y."start")"""
_SAME = """x.category = y.category AND x."start" = y."start" AND x."end" = y."end" """
_PICKS = {
    "gold_first": ("g", "p", f"coalesce(min(y.i) FILTER ({_SAME}), min(y.i) FILTER ({_MEET} > 0))"),
    "pred_first": ("p", "g", f"""min(y.i) FILTER ({_MEET} > 0 AND 2 * ({_MEET}) >= least(x."end" - x."start", y."end" - y."start"))"""),
    "max_overlap": ("g", "p", f"arg_max(y.i, ({_MEET})::BIGINT * 1000000 - y.i) FILTER ({_MEET} > 0)"),
}


def walk(rule: str, then: str) -> str:
    """SQL that ends in ``then`` over t: doc_id, kind, gc, gs, ge, pc, ps, pe."""
    own, other, pick = _PICKS[rule]
    out = f"""WITH RECURSIVE {SPANS}{_RIVAL}{_NUMBERED},
w(doc_id, i, used, hit) AS (SELECT DISTINCT doc_id, 0::BIGINT, []::BIGINT[], NULL::BIGINT FROM {own}
 UNION ALL SELECT doc_id, i + 1, CASE WHEN h IS NULL THEN used ELSE list_append(used, h) END, h FROM
 (SELECT w.doc_id, w.i, w.used, (SELECT {pick} FROM {other} y WHERE y.doc_id = w.doc_id AND NOT list_contains(w.used, y.i)) AS h FROM w JOIN {own} x ON x.doc_id = w.doc_id AND x.i = w.i + 1)),
m AS (SELECT doc_id, i AS {own}i, hit AS {other}i FROM w WHERE i > 0 UNION ALL SELECT doc_id, NULL, i FROM {other} y WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.doc_id = y.doc_id AND w.hit = y.i)),
t AS (SELECT m.doc_id, g.category AS gc, g."start" AS gs, g."end" AS ge, p.category AS pc, p."start" AS ps, p."end" AS pe,
 CASE WHEN p.i IS NULL THEN 'missed' WHEN g.i IS NULL THEN 'hallucinated' WHEN g.category = p.category AND g."start" = p."start" AND g."end" = p."end" THEN 'tp' WHEN g.category = p.category THEN 'boundary' ELSE 'confusion' END AS kind
 FROM m LEFT JOIN g ON g.doc_id = m.doc_id AND g.i = m.gi LEFT JOIN p ON p.doc_id = m.doc_id AND p.i = m.pi)"""
    return f"{out} {then}"


def matched(spark, d, rule):
    return triage(sided(spark, d, _PRED, _ACROSS, _BEFORE), rule)


_COUNTED = "SELECT kind, gc AS gold_category, pc AS pred_category, count(*) AS n FROM t GROUP BY ALL"


@query(walk("gold_first", _COUNTED))
def span_triage_gold_first(spark, d):
    return matched(spark, d, "gold_first").groupBy("kind", "gold_category", "pred_category").agg(F.count("*").alias("n"))


@query(walk("pred_first", _COUNTED))
def span_triage_pred_first(spark, d):
    return matched(spark, d, "pred_first").groupBy("kind", "gold_category", "pred_category").agg(F.count("*").alias("n"))


@query(walk("max_overlap", _COUNTED))
def span_triage_max_overlap(spark, d):
    return matched(spark, d, "max_overlap").groupBy("kind", "gold_category", "pred_category").agg(F.count("*").alias("n"))


_SUMS = ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in report.KINDS)
_RATES = """round(coalesce(tp / nullif(tp + boundary + confusion + hallucinated, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + boundary + confusion + missed, 0), 0), 6) AS recall,
 round(coalesce(2.0::DOUBLE * tp / nullif(2 * (tp + boundary + confusion) + missed + hallucinated, 0), 0), 6) AS f1"""


@query(walk("max_overlap", f"SELECT *, {_RATES} FROM (SELECT coalesce(category, '(all)') AS category, {_SUMS} FROM (SELECT coalesce(gc, pc) AS category, kind FROM t) GROUP BY ROLLUP (category))"))
def class_report(spark, d):
    return report.class_report(matched(spark, d, "max_overlap"))


@query(walk("gold_first", f"SELECT category, f1 FROM (SELECT *, {_RATES} FROM (SELECT coalesce(gc, pc) AS category, {_SUMS} FROM t GROUP BY 1)) WHERE tp + boundary + confusion + missed > 0 ORDER BY f1, category LIMIT 1"))
def weakest_class(spark, d):
    return report.least_f1(matched(spark, d, "gold_first"))


@query(walk("gold_first", f"SELECT category, f1 FROM (SELECT *, {_RATES} FROM (SELECT coalesce(gc, pc) AS category, {_SUMS} FROM t GROUP BY 1)) WHERE f1 < 0.9"))
def classes_under_gate(spark, d):
    return report.gate_f1(matched(spark, d, "gold_first"), 0.9)


@query(walk("pred_first", f"SELECT *, tp + boundary + confusion + missed AS n_gold, tp + boundary + confusion + hallucinated AS n_pred FROM (SELECT coalesce(gc, pc) AS category, {_SUMS} FROM t GROUP BY 1)"))
def class_counters(spark, d):
    return report.counters(matched(spark, d, "pred_first"))


_CELLS = "SELECT coalesce(gc, '(hallucinated)') AS gold_category, CASE kind WHEN 'missed' THEN '(missed)' WHEN 'boundary' THEN gc || '*boundary' ELSE pc END AS pred_category, count(*) AS n FROM t GROUP BY ALL"


@query(walk("gold_first", _CELLS + " ORDER BY n DESC, gold_category, pred_category"))
def confusion_matrix(spark, d):
    """An equal prediction first, else the first free one that overlaps; the commonest cells first."""
    return report.confusion(matched(spark, d, "gold_first")).orderBy(F.desc("n"), "gold_category", "pred_category")


_PAIRS = "(SELECT gc AS category, arg_min(pc, (-n, pc)) AS top_confusion FROM (SELECT gc, pc, count(*) AS n FROM t WHERE kind = 'confusion' GROUP BY ALL) GROUP BY 1)"


@query(walk("pred_first", f"""SELECT category, 3 * missed + 3 * confusion + 2 * boundary + hallucinated AS score, f1, precision, recall, missed, confusion, boundary, hallucinated, top_confusion,
 CASE WHEN top_confusion IS NOT NULL THEN concat('contrastive: same record contains ', category, ' and ', top_confusion, ' with explicit local context') ELSE 'small_qwen_narrative_pack: 300-1000 local Qwen records, then ablate' END AS pack
 FROM (SELECT *, {_RATES} FROM (SELECT coalesce(gc, pc) AS category, {_SUMS} FROM t GROUP BY 1)) LEFT JOIN {_PAIRS} USING (category) WHERE 3 * missed + 3 * confusion + 2 * boundary + hallucinated > 0 ORDER BY score DESC, f1, category"""))
def priority_rank(spark, d):
    """Failing classes by weighted score over predictions that share half of the shorter span."""
    return report.priorities(matched(spark, d, "pred_first"))


@query(walk("pred_first", f"""SELECT kind, label, r, doc_id, substring(text, gs + 1, ge - gs) AS expected, substring(text, ps + 1, pe - ps) AS predicted,
 CASE WHEN kind IN ('boundary', 'confusion') THEN round(greatest(0, least(ge, pe) - greatest(gs, ps)) / least(ge - gs, pe - ps), 6) END AS overlap_ratio,
 replace(substring(text, greatest(0, s - 42) + 1, e + 42 - greatest(0, s - 42)), chr(10), '\\n') AS context FROM
 (SELECT *, CAST(row_number() OVER (PARTITION BY kind, label ORDER BY doc_id, s, e, ps, pe) AS INTEGER) AS r FROM (SELECT *, CASE WHEN kind = 'confusion' THEN gc || '->' || pc ELSE coalesce(gc, pc) END AS label, coalesce(gs, ps) AS s, coalesce(ge, pe) AS e FROM t WHERE kind <> 'tp')) JOIN documents USING (doc_id) WHERE r <= 8"""))
def failure_examples(spark, d):
    """Eight failures of each kind and class with their texts; only documents with such a failure meet the texts."""
    return report.examples(matched(spark, d, "pred_first"), docs(spark, d))


@query(W + """SELECT sum(least(g, p))::BIGINT AS tp, sum(greatest(p - g, 0))::BIGINT AS fp, sum(greatest(g - p, 0))::BIGINT AS fn FROM (SELECT coalesce(g, 0) AS g, coalesce(p, 0) AS p FROM
 (SELECT doc_id, category, value, count(*) AS g FROM gold GROUP BY ALL) FULL JOIN (SELECT doc_id, category, value, count(*) AS p FROM pred GROUP BY ALL) USING (doc_id, category, value))""")
def multiset_match(spark, d):
    return match.multiset(sided(spark, d, _PRED))


_CASES = r"""(SELECT DISTINCT doc_id, category, trim(regexp_replace(value, '[ \t\r\n\f]+', ' ', 'g')) AS v FROM {})"""


@query(W + f"""SELECT coalesce(category, '(all)') AS category, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn
FROM (SELECT doc_id, category, v, g IS NOT NULL AS g, p IS NOT NULL AS p FROM (SELECT *, 1 AS g FROM {_CASES.format('gold')}) FULL JOIN (SELECT *, 1 AS p FROM {_CASES.format('pred')}) USING (doc_id, category, v)) GROUP BY ROLLUP (category)""")
def set_match(spark, d):
    """Each document's set of class and value, white space collapsed: found, wrong and missed, by class and in all."""
    return match.sets(sided(spark, d, _PRED))


_REGRESSED = """ FROM gold g WHERE EXISTS (SELECT 1 FROM pred p WHERE p.doc_id = g.doc_id AND p.category = g.category AND p."start" < g."end" AND g."start" < p."end")
 AND NOT EXISTS (SELECT 1 FROM run2 p WHERE p.doc_id = g.doc_id AND p.category = g.category AND p."start" < g."end" AND g."start" < p."end")"""
_RUN2 = ", run2 AS (SELECT * FROM gold WHERE NOT " + MISSED_BY_OTHER + """ UNION ALL SELECT doc_id, 'phone', "start" + 3, "end" + 2, value FROM gold WHERE substring(md5(value), 5, 1) < '6')"""
_ACROSS2 = _ACROSS.replace("1 AS side", "2 AS side")
_FIRST = """coalesce((SELECT arg_min(p.category, (p."start", p."end", p.category)) FROM run2 p WHERE p.doc_id = g.doc_id AND p."start" < g."end" AND g."start" < p."end"), '<NOTHING>')"""


@query(W + _RUN2 + f"""SELECT g.doc_id, g.category, g."start", g."end", {_FIRST} AS instead{_REGRESSED}""")
def model_regressions(spark, d):
    """Expected spans that the first run found and the second lost, with the first span that stands there instead."""
    return match.regressions(sided(spark, d, _PRED, _OTHER, _ACROSS2))


@query(W + _RUN2 + f"""SELECT category, instead, count(*) AS n FROM (SELECT g.category, {_FIRST} AS instead{_REGRESSED}) GROUP BY ALL ORDER BY n DESC, category, instead""")
def regression_labels(spark, d):
    return match.regressions(sided(spark, d, _PRED, _OTHER, _ACROSS2)).groupBy("category", "instead").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category", "instead")


@query(W + _RUN2 + """, x AS (SELECT category, EXISTS (SELECT 1 FROM pred p WHERE p.doc_id = g.doc_id AND p.category = g.category AND p."start" < g."end" AND g."start" < p."end") AS one,
 EXISTS (SELECT 1 FROM run2 p WHERE p.doc_id = g.doc_id AND p.category = g.category AND p."start" < g."end" AND g."start" < p."end") AS two FROM gold g)
SELECT category, count(*) FILTER (one) AS first, count(*) FILTER (two) AS second, count(*) FILTER (one AND NOT two) AS lost FROM x GROUP BY 1""")
def regression_recalls(spark, d):
    return match.recalls(sided(spark, d, _PRED, _OTHER, _ACROSS2))


def _totals(spans, name, side):
    c = match.exact(spans, side).agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")])
    return c.select(F.lit(name).alias("variant"), *match.rates(F.col("tp"), F.col("fp"), F.col("fn")))


@query(W + """, v AS (SELECT 'first' AS variant, * FROM pred UNION ALL SELECT 'second', * FROM gold WHERE NOT """ + MISSED_BY_OTHER + """),
n AS (SELECT variant, count(*) AS np, count(*) FILTER (EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = v.doc_id AND g.category = v.category AND g."start" = v."start" AND g."end" = v."end")) AS tp FROM v GROUP BY 1)
SELECT variant, round(2.0 * tp / (np + (SELECT count(*) FROM gold)), 6)::DOUBLE AS f1 FROM n ORDER BY f1 DESC, variant LIMIT 1""")
def best_variant(spark, d):
    """The run with the highest F1, the first by name of equals."""
    c = _by_variant(spark, d)
    return c.select("variant", "f1").orderBy(F.desc("f1"), "variant").limit(1)


def _by_variant(spark, d):
    """Rates of both runs from one aggregation over all spans."""
    key = [F.count_if(F.col("side") == k).alias(f"n{k}") for k in (0, 1, 2)]
    n = sided(spark, d, _PRED, _OTHER).groupBy(*match.KEY).agg(*key)
    sums = n.agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in (0, 1, 2)], *[F.sum(F.least("n0", f"n{k}")).alias(f"tp{k}") for k in (1, 2)])
    c = sums.select(F.inline(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(f"tp{k}").alias("tp"), (F.col(f"n{k}") - F.col(f"tp{k}")).alias("fp"), (F.col("n0") - F.col(f"tp{k}")).alias("fn")) for k, v in ((1, "first"), (2, "second"))])))
    return c.select("variant", *match.rates(F.col("tp"), F.col("fp"), F.col("fn")))


@query(W + """, hit AS (SELECT (SELECT count(*) FROM gold) AS g, (SELECT count(*) FROM pred) AS p1, (SELECT count(*) FROM gold JOIN pred USING (doc_id, category, "start", "end")) AS t1, (SELECT count(*) FROM gold WHERE NOT """ + MISSED_BY_OTHER + """) AS p2),
m AS (SELECT 'precision' AS k, round(t1 / p1, 6) AS baseline, 1.0::DOUBLE AS other FROM hit UNION ALL SELECT 'recall', round(t1 / g, 6), round(p2 / g, 6) FROM hit UNION ALL SELECT 'f1', round(2.0::DOUBLE * t1 / (p1 + g), 6), round(2.0::DOUBLE * p2 / (p2 + g), 6) FROM hit)
SELECT concat('detection.', x, k) AS metric, CASE WHEN x = '' THEN 0 ELSE baseline END::DOUBLE AS baseline, CASE WHEN x = '' THEN 0 ELSE other END::DOUBLE AS other, CASE WHEN x = '' THEN 0 ELSE round(other - baseline, 6) END::DOUBLE AS delta FROM m, (VALUES (''), ('span.')) v(x)""")
def metric_delta(spark, d):
    """Fixed metrics of two runs side by side; one that a run lacks counts 0."""
    named = [F.struct(F.lit(f"detection.span.{k}").alias("metric"), F.col(k).alias("value"), "variant") for k in ("precision", "recall", "f1")]
    m = _by_variant(spark, d).select(F.inline(F.array(*named)))
    return report.metric_delta(m, "first", "second")
