import corpus_pipeline
from spanloom.llm.toxicity import learn, score

from .test_linededup import brute as lines_brute
from .test_neardup import brute as near_brute
from .test_packing import check
from .test_substring import brute as substring_brute

AT = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    before, columns = docs, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, AT).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        rows = [(r.doc_id, r.text) for r in before.collect()]
        if k < 4:
            assert after.columns == columns
            got = {r.doc_id: r.text for r in after.collect()}
            assert all(r.n_chars == len(r.text) for r in after.collect())
        if name == "toxicity":
            scores = {r.doc_id: r.score for r in score(before, learn(before, spark.read.parquet(f"{AT}/labels.parquet"))).collect()}
            assert got == {i: t for i, t in rows if scores[i] < 0.5}
        elif name == "line_dedup":
            gone = {k for k, v in lines_brute(rows).items() if v[0]}
            assert got == {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}
        elif name == "near_dedup":
            classes = set(near_brute(rows))
            assert got == {i: t for i, t in rows if (i, i) in classes}
        elif name == "substring_dedup":
            want = {i: k for i, _, _, k in substring_brute(rows, 35)}
            assert {i: " ".join(t.split()) for i, t in got.items()} == {i: " ".join(k.split()) for i, k in want.items()}
            assert all(got[i] == t for i, t in rows if " ".join(t.split()) == " ".join(want[i].split()))
        else:
            check(after.collect(), rows, 2048)
        before = after


def test_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, "a", 0), (1, None, "a", 0), (None, "x", "b", 1), (2, "", None, 0)], "doc_id long, text string, carried string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, odd, AT)
        assert out.columns == odd.columns and out.count() >= 2


def test_different_texts_of_one_id_stay(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (2, a), (3, b + " end"), (4, c), (4, c), (None, a), (None, "alone"), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, h string")
    got = sorted(map(str, map(tuple, corpus_pipeline.near_dedup(spark, docs, AT).collect())))
    assert got == sorted(map(str, [(1, a, "k"), (1, b, "k"), (4, c, "k"), (None, "alone", "k"), (5, None, "k")]))


def test_empty_table(spark):
    empty = spark.read.parquet(f"{AT}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, AT).collect() == []


def test_a_batch_is_bounded_in_bytes(spark):
    import pyarrow as pa

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    docs = spark.range(0, 6000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 500) AS text")
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes], "rows": [b.num_rows]}) for b in batches)
    corpus_pipeline.packing(spark, docs.limit(1), AT)
    got = docs.mapInArrow(sizes, "n long, rows long").collect()
    assert sum(r.rows for r in got) == 6000 and max(r.n for r in got) < 5 << 20
    spark.conf.set(key, "1m")
    corpus_pipeline.small_batches(spark)
    assert spark.conf.get(key) == "1m"
    spark.conf.unset(key)
