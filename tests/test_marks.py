import unicodedata

import pytest
from pyspark.sql import functions as F

from spanloom.operators import curate, quota
from spanloom.operators.transform import transliterate, without_marks


def test_every_character(spark):
    """Canonical decomposition without marks, character by character."""
    rows = [chr(k) for k in range(0x30000) if not 0xD800 <= k < 0xE000] + ["café", "café", "ά 한글 Q̣̇", ""]
    df = spark.createDataFrame([(c,) for c in rows], "c string").repartition(8)
    plain = lambda t: "".join(x for x in unicodedata.normalize("NFD", t) if unicodedata.category(x) != "Mn")
    got = df.select("c", without_marks(F.col("c")).alias("x")).collect()
    assert [(r.c, r.x) for r in got if r.x != plain(r.c)] == [] and len(got) == len(rows)
    assert spark.sql("select cast(null as string) t").select(transliterate(F.col("t")).alias("x")).first().x is None


def test_transliteration(spark):
    for text, want in (("ά Ά ΐ ς", "a A i s"), ("Ψώνια στη Χίο", "Psonia sti Chio"), ("naïve Ωmega", "naive Omega"), ("plain", "plain"), ("ϴ θ", "Th th")):
        assert spark.range(1).select(transliterate(F.lit(text)).alias("x")).first().x == want


def test_ratios_are_checked(spark):
    docs = spark.range(10).selectExpr("id as doc_id", "'a' as s")
    with pytest.raises(ValueError, match="add up"):
        curate.stratified_split(docs, "s", {"a": 0.5, "b": 0.6}, 1)
    with pytest.raises(ValueError, match="negative"):
        curate.ratio_split(docs, 0.8, 0.3, 1)
    with pytest.raises(ValueError, match="negative"):
        quota.quota_split(docs, "s", "false", 10, 1, (0.9, 0.2, 0.1))
