from itertools import permutations

from pyspark.sql import functions as F

from spanloom.llm.filteraudit import LETTERS, SIZE, TABLE, _tallies, audit, text_bits

DOCS = "doc_id long, text string, lang string"


def brute(docs, labels):
    """Each document through each order, filter by filter."""
    firsts = {}
    for i, t, _ in docs:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))

    def fails(i, t):
        t = t or ""
        ws = t.encode().split()
        out = {"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t)}
        return {x for x, bad in out.items() if bad} | ({"E"} if i is not None and firsts[t] < i else set())

    good, toxic = ({i for i, *marks in labels if marks[k] == 1 and i is not None} for k in (0, 1))
    known = [(i, lang or "", fails(i, t)) for i, t, lang in docs]
    rows = {}
    for part in {p for _, p, _ in known}:
        shapley = dict.fromkeys(LETTERS, 0)
        for order in map("".join, permutations(LETTERS)):
            left = [(i, f) for i, p, f in known if p == part]
            before = []
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                shapley[x] += len(gone)
                alone = sum(f == {x} for _, p, f in known if p == part)
                rows[part, order, step] = [len(left), len(gone), sum(x in f for _, f in before), alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), x]
                before += gone
        for key, r in rows.items():
            if key[0] == part:
                r[-1] = shapley[r[-1]]
    return rows


def asked(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_table():
    assert TABLE.shape == (32, 120) and (TABLE[0] == 5).all() and (TABLE[31] == 0).all()


def test_odd_rows_against_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(100))
    docs = [
        (1, None, "en"), (2, "", None), (3, "", ""), (4, long, "en"), (5, long, "fr"), (5, long, "fr"), (None, long, None), (6, "A b # C", "en"), (7, "été É" * 40, "fr"), (7, "other", "fr"),
        (8, "x " * 300_000, "en"), (9, "ABC " + long, None), (-1, "x " * 300_000, "de"), (10, "a b\x1fc " + long, "de"), (11, None, "de"),
    ]
    labels = [(4, 1, 0), (5, 1, 1), (5, 0, None), (None, 1, 1), (8, None, 1), (12, 1, 1), (-1, 1, None)]
    d, m = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute(docs, labels)
    assert asked(audit(d, m)) == want and len(want) == 4 * 600
    more = [F.lit("x").alias(c) for c in ("part", "digest", "bits", "label", "first", "n", "at", "tally", "quality", "toxic")]
    assert asked(audit(d.select("*", *more), m.select("*", *more[:-2]))) == want
    assert asked(audit(d.repartition(7), m, at_once=1)) == want
    assert audit(d.limit(0), m).collect() == [] and audit(d, m.limit(0)).count() == 2400


def test_many_parts(spark):
    """More parts than a task holds at once."""
    docs = [(i, f"text {i % 7}", f"l{i % 150}") for i in range(600)]
    assert asked(audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(3, 1, 1)], "doc_id long, quality int, toxic int"))) == brute(docs, [(3, 1, 1)])


def test_kernels(spark):
    import pyarrow as pa

    assert text_bits(pa.array(["", None, "A#", "a " * 100])).tolist() == [1, 1, 13, 2]
    got = list(_tallies(2)([pa.RecordBatch.from_pydict({"part": ["a", "b", "c", "a"], "bits": [0, 1, 31, 1], "label": [0, 1, 2, 3]})]))
    assert sum(b.num_rows for b in got) == 3 and all(len(t) == SIZE for b in got for t in b.column("tally").to_pylist())
    assert sum(sum(t) for b in got for t in b.column("tally").to_pylist()) == 4 * 121
