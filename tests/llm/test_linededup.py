import random
from collections import defaultdict

from spanloom.llm.linededup import line_matches, op5_line_dedup, remove_lines


def brute(docs):
    """{(doc_id, line): (removed, n_links, class_id)}"""
    lines = sorted({(i, k, frozenset(x.split())) for i, t in docs if i is not None for k, x in enumerate((t or "").split("\n")) if x.split()}, key=lambda x: x[:2])
    sets = list(dict.fromkeys(x[2] for x in lines))
    first = {}
    for i, k, s in lines:
        first.setdefault(s, (i, k))
    has = defaultdict(list)
    for n, s in enumerate(sets):
        for w in s:
            has[w].append(n)
    near = defaultdict(set)
    for n, s in enumerate(sets):
        for m in {m for w in s for m in has[w] if m < n}:
            if len(s & sets[m]) >= 0.8 * len(s | sets[m]) - 1e-9:
                near[s].add(sets[m])
                near[sets[m]].add(s)
    comp = {}
    for s in sets:
        if s not in comp:
            todo, group = [s], {s}
            while todo:
                for y in near[todo.pop()] - group:
                    group.add(y)
                    todo.append(y)
            least = min(first[x][0] for x in group)
            comp.update(dict.fromkeys(group, least))
    return {(i, k): (first[s] < (i, k) or any(first[x] < (i, k) for x in near[s]), len(near[s]), comp[s]) for i, k, s in lines}


def sample():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 3)))
    base = [[word() for _ in range(rng.choice([1, 3, 4, 5, 10, 40]))] for _ in range(40)]
    docs = []
    for i in range(150):
        lines = []
        for _ in range(rng.choice([0, 1, 4])):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 3])):
                w[rng.randrange(len(w))] = word()
            rng.shuffle(w)
            lines.append(rng.choice([" ", "  ", "\t"]).join(w))
        docs.append((i, "\n".join(lines)))
    return docs + [(900, None), (901, ""), (902, "\n\n"), (903, "a b c d\n\na b c d\nA B\n"), (904, " ".join(f"x{i}" for i in range(70000))), (905, " ".join(f"x{i}" for i in range(60000))), (3, "one two"), (3, docs[3][1])]


def test_against_brute_force(spark):
    docs = sample()
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, line int").repartition(5)
    got = {(r.doc_id, r.line): (r.removed, r.n_links, r.class_id) for r in line_matches(df).collect() if r.doc_id != 3}
    want = brute(docs)
    assert got == {k: v for k, v in want.items() if k[0] != 3}
    out = {r.doc_id: r.text for r in remove_lines(df).collect()}
    for i, t in docs:
        if i != 3:
            assert out[i] == (t if not any(v[0] for k, v in want.items() if k[0] == i) else "\n".join(x for n, x in enumerate(t.split("\n")) if not want.get((i, n), [False])[0]))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_matches(empty).collect() == [] and remove_lines(empty).collect() == []


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs)
    got = op5_line_dedup(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        own = {k[1]: v for k, v in want.items() if k[0] == r.doc_id}
        assert (r.n_lines, r.removed_lines, r.n_links) == (len(own), ",".join(str(n) for n in sorted(own) if own[n][0]), sum(v[1] for v in own.values()))
        assert r.class_id == min((v[2] for v in own.values()), default=r.doc_id)
