"""Queries without SQL against plain loops over the same texts."""

import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from spanloom.operators.transform import chunks
from spanloom.plans import catalogue

AT = "/root/testdata/sf0.001"


def packed(text, least=40, most=220):
    """The running length begins at 0 and counts a space for each sentence; a sentence that opens a chunk because the last is full counts none."""
    flat = re.sub(r"\s+", " ", text).strip()
    if len(flat) <= most:
        return [flat] if len(flat) >= least else []
    out, held, size = [], [], 0
    for s in re.split(r"(?<=[.!?·;])\s+", flat):
        if size + 1 + len(s) > most:
            out.append((size, held))
            held, size = [s], len(s)
        else:
            held.append(s)
            size += 1 + len(s)
    return [" ".join(h) for n, h in [*out, (size, held)] if h and n >= least]


def test_limits(spark):
    """Both limits at the first chunk, which counts one more than it has, and at a later one."""
    texts = ["aaaa. bbb. cc.", "aaaa. bbbb. c", "aaa. b. c. dddddd", "aaaaaaaaaaaaaaaaa. b", "", " ", "a b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for least, most in ((1, 9), (5, 10), (6, 10), (10, 10), (11, 11), (11, 10), (4, 12)):
        got = [r.x for r in df.select(chunks(F.col("t"), least, most).alias("x")).collect()]
        assert got == [packed(t, least, most) for t in texts], (least, most)
    assert packed("aaaa. bbbb. c", 1, 12) == ["aaaa. bbbb.", "c"] and packed("aaaa. bbbb. c", 1, 11) == ["aaaa.", "bbbb. c"]


def test_chunks(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet").collect()
    want = sorted((r.doc_id, k, c) for r in docs for k, c in enumerate(packed(r.text)))
    assert sorted(map(tuple, catalogue.QUERIES["greedy_chunks"](spark, AT).collect())) == want
    first = {}
    for r in docs:
        for c in packed(r.text):
            first[c] = min(first.get(c, (r.source, r.doc_id)), (r.source, r.doc_id))
    by = defaultdict(list)
    for c, (source, i) in first.items():
        by[source].append((hashlib.md5(c.encode()).hexdigest(), source, i, c))
    want = sorted(x[1:] for rows in by.values() for x in sorted(rows)[:100])
    assert sorted(map(tuple, catalogue.QUERIES["corpus_chunks"](spark, AT).collect())) == want
