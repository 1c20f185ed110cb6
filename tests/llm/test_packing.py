import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from spanloom.llm import packing
from spanloom.llm.packing import OpenBins, pack_documents


def test_ids_are_those_of_the_named_tokenizer():
    """On every text of the 0.1 tables and on strings that are made to differ."""
    tok, ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.load_tokenizer()
    rng = random.Random(11)
    parts = ["<|endoftext|>", "<|end", "oftext|>", "\u00a0", "\u3000", "\ufeff", "\x00", "\x1f", "'s", "'RE", "’ll", "\r\n", "\n\n ", "\t", "é", "e\u0301", "日本", "\U0001f600", "١٢", "²", "a", "A1", " ", "   ", "_", "\u200b", "ǅ", "ﬁ"]
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist() + ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(5000)]
    for lo in range(0, len(texts), 1000):
        some = [t or "" for t in texts[lo : lo + 1000]]
        for t, e in zip(some, tok.encode_batch(some, add_special_tokens=False), strict=True):
            assert list(ids(t)) == e.ids, t


def check(rows, docs, capacity):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for i, t in docs:
        want[i].append([*tok.encode(t or "", add_special_tokens=False).ids, 0])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, texts in want.items():
        if len(texts) > 1:
            continue
        ids, at = texts[0], 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert k == 0 or r.length == capacity
            assert zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return by_seq


def test_pieces_bins_and_edges(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["alpha", "né", "日本", "x1", "\n"]) for _ in range(rng.choice([1, 20, 300])))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "<|endoftext|> a"), (1003, "long " * 4000), (1004, "x"), (1004, "x")]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, length string, bin int").repartition(5)
    rows = pack_documents(df, capacity=256, open_bins=16, fan_in=2).collect()
    seqs = check(rows, docs, 256)
    total = sum(r.length for r in rows)
    assert len(seqs) <= total / 256 * 1.05 + 2
    assert sum(r.doc_id == 1004 for r in rows) == 2


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_best_fit_against_brute_force():
    rng = random.Random(1)
    bins, plain, made = OpenBins(50, 8), [], 0
    for _ in range(2000):
        size = rng.randint(1, 50)
        b, free = bins.take(size)
        fits = [f for f in plain if f >= size]
        assert (b >= 0) == bool(fits)
        if fits:
            assert free == min(fits)
            plain.remove(free)
        else:
            b, free, made = made, 50, made + 1
        bins.put(b, free - size)
        if free - size:
            plain.append(free - size)
            if len(plain) > 8:
                plain.remove(min(plain))


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    check(packing.op7_best_fit_packing(spark, "/root/testdata/sf0.001").collect(), [(r.doc_id, r.text) for r in docs], 2048)
