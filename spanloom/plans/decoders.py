"""Queries that decode label scores of the documents' tokens, with their SQL.

The scores stand in for a model's: a byte of noise for each label by the word's digest and
a lead for the label that detection gives the token.  Texts are read in windows
of 64 words, as a model would.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.spans import NEEDED, PATTERNS, all_spans
from ..operators import match
from ..operators.decode import best_disjoint, decoded
from ..sources.storage import scratch
from .catalogue import SPANS, docs, query

CLASSES = tuple(PATTERNS)
WIDTH = 2 * len(CLASSES) + 1
WINDOW, LEAD = 64, 230
#: What a task that scores holds at once: texts as strings, digests of words, and tokens with their scores, each up to one text more.
TEXTS, DIGESTS, TOKENS = 256, 1 << 16, 1 << 16


def true_labels(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each token's label by the first detected span that it meets: B- of the first token that meets it, I- of the others."""
    found = sorted((m.start(), c, m.end()) for c, p in PATTERNS.items() if NEEDED.get(c, "") in text for m in re.finditer(p, text))
    out = np.zeros(len(starts), np.int64)
    for a, c, b in found:
        lo, hi = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        own = 1 + 2 * CLASSES.index(c) + (np.arange(lo, hi) > lo)
        out[lo:hi] = np.where(out[lo:hi] == 0, own, out[lo:hi])
    return out


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int16())]
    noise: dict[str, bytes] = {}
    lead = np.eye(WIDTH, dtype=np.int16) * LEAD

    def out(rows: list) -> pa.RecordBatch:
        ids, parts = np.concatenate([r[0] for r in rows]), [np.concatenate([r[k] for r in rows]) for k in (2, 3, 4)]
        sizes = np.concatenate([r[1] for r in rows])
        offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(offs * w, pa.array(p.ravel(), t.value_type)) for p, t, w in zip(parts, kinds[1:], (1, 1, WIDTH), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids), *lists], ["doc_id", "start", "end", "score"])

    for batch in (b.slice(lo, TEXTS) for b in batches for lo in range(0, b.num_rows, TEXTS)):
        rows, held = [], 0
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            c = np.frombuffer((t or "").encode("utf-32-le", "replace"), np.uint32)
            ink = np.concatenate([[False], (c != 32) & ((c < 9) | (c > 13)), [False]])
            edges = np.flatnonzero(ink[1:] != ink[:-1]).astype(np.int32)
            starts, ends = edges[::2], edges[1::2]
            if not len(starts):
                continue
            if len(noise) > DIGESTS:
                noise.clear()
            ws = [t[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            for w in ws:
                if w not in noise:
                    noise[w] = hashlib.md5(w.encode()).digest()
            own = np.frombuffer(b"".join([noise[w] for w in ws]), np.uint8).reshape(-1, 16)[:, :WIDTH].astype(np.int16) + lead[true_labels(t, starts, ends)]
            cuts = np.arange(0, len(starts), WINDOW)
            rows.append((np.full(len(cuts), i), np.diff(np.append(cuts, len(starts))), starts, ends, own))
            held += len(starts)
            if held > TOKENS:
                yield out(rows)
                rows, held = [], 0
        if rows:
            yield out(rows)


def found(spark, d):
    """Spans of every window by each decoder; a task scores and decodes in one Python worker."""
    return decoded(docs(spark, d).where("doc_id is not null").select("doc_id", "text"), CLASSES, scorer=_scores)


def variants(spark, d):
    """variant, doc_id, category, start, end of three decoders of one table of scores."""
    at = scratch(spark, "decoded")
    found(spark, d).write.partitionBy("variant").parquet(at)
    spans = spark.read.schema("doc_id long, category string, start int, end int, gain long, variant string").parquet(at)
    plain = spans.where("variant <> 'by_class'").select("variant", "doc_id", "category", "start", "end")
    return plain.unionByName(best_disjoint(spans.where("variant = 'by_class'")).select(F.lit("no_overlap").alias("variant"), "doc_id", "category", "start", "end"))


#: Label k of a window's path is its k-th letter from a; view -1 has all labels, the others O and one class.
DECODED = SPANS.rstrip() + rf""",
ws AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, unnest(string_split_regex(text, '[^\x20\x09-\x0D]+')[1:-2]) AS gap, unnest(range(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')))) AS ix FROM documents),
wt AS (SELECT doc_id, ix, word, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY ix) AS INTEGER) AS e FROM ws),
tok AS MATERIALIZED (SELECT doc_id, ix, ix // {WINDOW} AS win, word, e - length(word) AS s, e FROM wt),
hit AS (SELECT t.doc_id, t.ix, g.category, g."start", t.ix > min(t.ix) OVER (PARTITION BY g.doc_id, g.category, g."start") AS inside FROM tok t JOIN gold g ON g.doc_id = t.doc_id AND t.s < g."end" AND g."start" < t.e),
lab AS (SELECT doc_id, ix, arg_min(1 + 2 * (list_position({list(CLASSES)}, category) - 1) + CAST(inside AS INTEGER), ("start", category)) AS k FROM hit GROUP BY ALL),
sc AS MATERIALIZED (SELECT doc_id, win, ix % {WINDOW} AS t, s, e, list_transform(range({WIDTH}), lambda j: CAST(('0x' || substring(md5(word), CAST(2 * j + 1 AS BIGINT), 2)) AS BIGINT) + CASE WHEN coalesce(k, 0) = j THEN {LEAD} ELSE 0 END) AS score FROM tok LEFT JOIN lab USING (doc_id, ix)),
vs AS MATERIALIZED (SELECT v, doc_id, win, t, CASE WHEN v < 0 THEN score ELSE [score[1], score[2 * v + 2], score[2 * v + 3]] END AS score FROM sc, (SELECT unnest(range(-1, {len(CLASSES)})) AS v)),
vit(v, doc_id, win, t, best, path) AS (SELECT v, doc_id, win, t, list_transform(score, lambda x, i: CASE WHEN i > 1 AND i % 2 = 1 THEN -1000000 ELSE x END), list_transform(score, lambda x, i: chr(CAST(96 + i AS INTEGER))) FROM vs WHERE t = 0
 UNION ALL SELECT v, doc_id, win, t, list_transform(score, lambda x, i: x + best[p[i]]), list_transform(score, lambda x, i: path[p[i]] || chr(CAST(96 + i AS INTEGER))) FROM
 (SELECT vs.v, vs.doc_id, vs.win, vs.t, vs.score, vit.best, vit.path, list_transform(vs.score, lambda x, i: CASE WHEN i > 1 AND i % 2 = 1 THEN CASE WHEN vit.best[i] > vit.best[i - 1] THEN i ELSE i - 1 END ELSE list_position(vit.best, list_max(vit.best)) END) AS p
  FROM vit JOIN vs ON vs.v = vit.v AND vs.doc_id = vit.doc_id AND vs.win = vit.win AND vs.t = vit.t + 1)),
walked AS (SELECT v, doc_id, win, arg_max(path[list_position(best, list_max(best))], t) AS path FROM vit GROUP BY ALL
 UNION ALL SELECT -2, doc_id, win, string_agg(chr(CAST(96 + list_position(score, list_max(score)) AS INTEGER)), '' ORDER BY t) FROM sc GROUP BY ALL),
lets AS (SELECT v, doc_id, win, t, ascii(path[t + 1]) - 97 AS k FROM (SELECT *, unnest(range(length(path))) AS t FROM walked)),
began AS (SELECT *, k > 0 AND (k % 2 = 1 OR coalesce(lag(k + 1) OVER o // 2, 0) <> (k + 1) // 2) AS new FROM lets WINDOW o AS (PARTITION BY v, doc_id, win ORDER BY t)),
numbered AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY v, doc_id, win ORDER BY t) AS r FROM began),
found AS MATERIALIZED (SELECT v, doc_id, win, r, {list(CLASSES)}[CASE WHEN v < 0 THEN (k + 1) // 2 ELSE v + 1 END] AS category, min(s) AS "start", max(e) AS "end", CAST(sum(score[CASE WHEN v < 0 THEN k + 1 ELSE 2 * v + k + 1 END] - score[1]) AS BIGINT) AS gain
 FROM (SELECT v, doc_id, win, t, r, k FROM numbered WHERE k > 0) JOIN sc USING (doc_id, win, t) GROUP BY v, doc_id, win, r, category),
cand AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, win ORDER BY "end", "start", category) AS i FROM found WHERE v >= 0),
prior AS MATERIALIZED (SELECT c.*, (SELECT count(*) FROM cand b WHERE b.doc_id = c.doc_id AND b.win = c.win AND b."end" <= c."start") AS p FROM cand c),
wis(doc_id, win, i, best, sets) AS (SELECT DISTINCT doc_id, win, 0::BIGINT, [0::BIGINT], [[]::BIGINT[]] FROM cand
 UNION ALL SELECT c.doc_id, c.win, c.i, list_append(w.best, greatest(w.best[-1], w.best[c.p + 1] + c.gain)), list_append(w.sets, CASE WHEN w.best[c.p + 1] + c.gain > w.best[-1] THEN list_append(w.sets[c.p + 1], c.i) ELSE w.sets[-1] END)
 FROM wis w JOIN prior c ON c.doc_id = w.doc_id AND c.win = w.win AND c.i = w.i + 1),
pick AS (SELECT doc_id, win, unnest(x) AS i FROM (SELECT doc_id, win, arg_max(sets[-1], i) AS x FROM wis GROUP BY ALL)),
dec AS MATERIALIZED (SELECT CASE v WHEN -2 THEN 'argmax' ELSE 'viterbi' END AS variant, doc_id, category, "start", "end" FROM found WHERE v < 0 UNION ALL SELECT 'no_overlap', doc_id, category, "start", "end" FROM cand JOIN pick USING (doc_id, win, i))
"""
_W = "WITH RECURSIVE " + DECODED


@query(_W + 'SELECT variant, doc_id, category, "start", "end" FROM dec')
def decoded_spans(spark, d):
    """The best label of each token, the best allowed sequence, and the best disjoint spans of every class decoded alone."""
    return variants(spark, d)


_RATES = """c AS (SELECT variant, count(*) AS np, count(g.doc_id) AS tp FROM dec LEFT JOIN gold g USING (doc_id, category, "start", "end") GROUP BY 1),
rates AS (SELECT variant, tp, np - tp AS fp, n - tp AS fn, round(coalesce(tp / nullif(np, 0), 0), 6) AS precision, round(coalesce(tp / nullif(n, 0), 0), 6) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(np + n, 0), 0), 6) AS f1 FROM c, (SELECT count(*) AS n FROM gold))"""


def rated(spark, d):
    """Counts and rates of every variant against the detected spans, from one aggregation."""
    gold = docs(spark, d).select("doc_id", F.explode(all_spans(F.col("text"))).alias("s")).select(F.lit("").alias("variant"), "doc_id", "s.category", "s.start", "s.end")
    names = ("argmax", "no_overlap", "viterbi")
    n = gold.unionByName(variants(spark, d)).groupBy(*match.KEY).agg(F.count_if(F.col("variant") == "").alias("g"), *[F.count_if(F.col("variant") == v).alias(v) for v in names])
    sums = n.agg(F.sum("g").alias("g"), *[F.sum(v).alias(f"n_{v}") for v in names], *[F.sum(F.least("g", v)).alias(f"tp_{v}") for v in names])
    rows = sums.select(F.inline(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(f"tp_{v}").alias("tp"), (F.col(f"n_{v}") - F.col(f"tp_{v}")).alias("fp"), (F.col("g") - F.col(f"tp_{v}")).alias("fn")) for v in names])))
    return rows.select("variant", "tp", "fp", "fn", *match.rates(F.col("tp"), F.col("fp"), F.col("fn")))


@query(f"{_W}, {_RATES} SELECT * FROM rates")
def decoder_rates(spark, d):
    return rated(spark, d)


@query(f"{_W}, {_RATES} SELECT variant, f1 FROM rates ORDER BY f1 DESC, variant LIMIT 1")
def best_decoder(spark, d):
    """The decoder with the highest F1, the first by name of equals."""
    return rated(spark, d).select("variant", "f1").orderBy(F.desc("f1"), "variant").limit(1)
