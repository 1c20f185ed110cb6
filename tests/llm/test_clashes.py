"""Columns beside the documented ones may have any name; nulls and an empty table too."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm.fingerprint import fingerprints
from spanloom.llm.langid import learn as learn_languages
from spanloom.llm.langid import predict
from spanloom.llm.linededup import line_matches, remove_lines
from spanloom.llm.neardup import near_duplicates
from spanloom.llm.packing import pack_documents
from spanloom.llm.pieces import encode
from spanloom.llm.substring import remove_repeats
from spanloom.llm.toxicity import learn, score, without_toxic

NAMES = ["h", "id", "key", "bands", "sig", "a", "b", "comp", "class_id", "class", "line", "word", "words", "asked", "gone_lines", "gone_doc", "kept", "carried", "n_words", "n_removed", "salt", "part", "first",
         "n", "x", "col", "pos", "start", "length", "piece", "offset", "sequence_id", "bin", "toxic", "score", "next", "edited", "held_out", "row", "shard", "window", "digest", "removed", "n_links", "text_a", "seq", "rank", "gone", "index", "count"]


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "en"), (2, long + " end", "en"), (3, None, None), (4, "", "fr"), (None, long, "fr"), (5, "un mot\nun autre mot de plus ici\n" + long, "fr"), (5, "twice", "en"), (6, "un autre mot de plus ici", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})
    return df.select("*", *[F.lit(n).alias(n) for n in NAMES])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (2, 1), (3, None), (None, 1)], "doc_id long, toxic int").select("*", *[F.lit(1).alias(n) for n in ("text", "quality", "feature", "total")])


OPERATORS = {
    "fingerprints": (fingerprints, True), "line_matches": (line_matches, False), "remove_lines": (remove_lines, True), "near_duplicates": (near_duplicates, True),
    "pack": (pack_documents, False), "encode": (encode, True), "passages": (remove_repeats, True), "carried": (lambda d: remove_repeats(d, plain=False, carry=d.columns), True),
    "languages": (lambda d: predict(d, learn_languages(d)), True), "near_stage": (lambda d: corpus_pipeline.near_dedup(d.sparkSession, d, ""), False), "passage_stage": (lambda d: corpus_pipeline.substring_dedup(d.sparkSession, d, ""), True),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_with_names_of_the_operators_own(docs, name):
    operator, whole = OPERATORS[name]
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    got, want = operator(docs), operator(plain)
    same = [c for c in want.columns if c != "carried" and c in got.columns]
    norm = lambda df: sorted((tuple(r) for r in df.select(*same).collect()), key=str)
    assert same and norm(got) == norm(want)
    assert not whole or got.count() == docs.count()
    assert operator(docs.limit(0)).collect() == []


def test_toxicity(docs, labels):
    model = learn(docs, labels)
    assert score(docs, model).count() == docs.count()
    assert without_toxic(docs, model).columns == docs.columns
    assert score(docs.limit(0), learn(docs.limit(0), labels.limit(0))).collect() == []
