"""Texts under a language model by deleted interpolation.

P(w | v) mixes the relative frequencies of the pair v w and of w with a uniform
share, by weights that hang on how often the context v was seen.  The weights
come from expectation-maximisation on the counts of training documents that the
frequencies leave out; the frequencies that score come from all of them.

Texts are cut once into batches of a few MB, each of documents of one kind.  A
batch sends every n-gram it holds once, with its count, to the n-gram's bucket,
which adds the counts of all batches up and sends each its n-grams' sums back in
the order they came: so what one batch asks for and learns is bounded by its own
text, and a frequent n-gram is as many rows as there are batches that hold it.
Words are sent and counted by their bytes; pairs, which only ``score`` needs, by
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, as_batch, dropped, per_batch, table, written
from .kernels import SPACE, U64, gram_hashes, mix, pieces, utf8, words

#: Kinds of documents: counted for frequencies, counted for the weights, scored only.
KEPT, DELETED, HELD_OUT = 0, 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The hash of a text's end, which is also the context of its first word.
END = mix(np.array([0x5EED0E2D], U64))[0]
#: Bits of a hash that tell pairs of one bucket apart; a bucket holds about a million, of which two clash in one bucket of two.
_KEY = 40


def _packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers of each array in the fewest bytes, one byte plane after another, compressed."""
    press, out = zstandard.ZstdCompressor(level=1), []
    for a in arrays:
        a = np.ascontiguousarray(a, "<u8")
        size = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        out.append(bytes([size]) + press.compress(a.view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()))
    return b"".join(len(x).to_bytes(4, "little") + x for x in out)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    at, out = 0, []
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 4], "little")
        size, planes = blob[at + 4], np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[at + 5 : at + 4 + n]), np.uint8).reshape(blob[at + 4], -1)
        a = np.zeros((planes.shape[1], 8), np.uint8)
        a[:, :size] = planes.T
        out.append(a.view("<u8").ravel())
        at += 4 + n
    return out


def _strings(lengths: np.ndarray, data: bytes) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offs), pa.py_buffer(data)])


def spelt(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different tokens of all texts by their bytes, the place of each token among them, and token offsets by text; an end, one after each text, is empty."""
    found, sizes = [], []
    for a, b in pieces(offs):
        own = _LOWER[data[offs[a] : offs[b]]]
        start, end, at = words(own, offs[a : b + 1] - offs[a])
        found.append(_strings(np.insert(end - start, at[1:], 0), own[~SPACE[own]].tobytes()))
        sizes.append(np.diff(at) + 1)
    every = pa.chunked_array(found, pa.large_binary()).combine_chunks().dictionary_encode()
    n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return every.dictionary, np.asarray(every.indices).astype(np.int64), np.concatenate([[0], np.cumsum(n)])


def hashes(different: pa.Array) -> np.ndarray:
    """Of different tokens."""
    out = np.frombuffer(b"".join([blake2b(w, digest_size=8).digest() for w in different.to_pylist()]), "<u8").astype(U64)
    out[np.diff(_offsets(different)) == 0] = END
    return out


def _offsets(strings: pa.Array) -> np.ndarray:
    return np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, an end after each text, and token offsets by text."""
    different, place, at = spelt(data, offs)
    return hashes(different)[place], at


def _batched(size: int):
    """Rows of documents of one kind and about ``size`` bytes, compressed."""
    to = arrow_schema("batch long, kind int, bytes long, ids binary, lengths binary, body binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], []]
        sizes, done, task = [0, 0, 0], 0, TaskContext.get().partitionId()

        def out(kind: int) -> pa.RecordBatch:
            nonlocal done
            ids = pa.array([i for i, _ in held[kind]], pa.int64())
            known = np.asarray(ids.is_valid())
            texts = [t for _, t in held[kind]]
            row = {
                "batch": [(task << 32) + done], "kind": [kind], "bytes": [sizes[kind]], "ids": [_packed(np.asarray(ids.fill_null(0)).view(U64), known)],
                "lengths": [_packed(np.array([len(t) for t in texts], U64))], "body": [zstandard.ZstdCompressor(level=3).compress(b"".join(texts))],
            }
            held[kind], sizes[kind], done = [], 0, done + 1
            return as_batch(row, to)

        for batch in batches:
            data, offs = utf8(batch.column("text"))
            for k, (i, kind) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("kind").to_pylist(), strict=True)):
                held[kind].append((i, data[offs[k] : offs[k + 1]].tobytes()))
                sizes[kind] += int(offs[k + 1] - offs[k]) + 8
                if sizes[kind] >= size:
                    yield out(kind)
        for kind in range(3):
            if held[kind]:
                yield out(kind)

    return run, "batch long, kind int, bytes long, ids binary, lengths binary, body binary"


class Batch:
    """A batch's ids and tokens, and its different n-grams in the order in which they are sent."""

    def __init__(self, row: dict):
        lengths = _unpacked(row["lengths"])[0].astype(np.int64)
        raw = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=max(1, int(lengths.sum())))
        ids, known = _unpacked(row["ids"])
        self.ids = pa.array(ids.view(np.int64), mask=known == 0)
        different, place, self.offs = spelt(np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(lengths)]))
        h = hashes(different)
        order = np.argsort(h, kind="stable")
        rank = np.empty(len(h), np.int64)
        rank[order] = np.arange(len(h))
        #: Different words in the order of their hashes.
        self.words = different.take(pa.array(order))
        #: By n: hashes of different n-grams, the place of each token's among them, and how often each occurs.  What stands before a batch's first token is an end, as it is before every text.
        pairs = np.unique(gram_hashes(np.concatenate([[END], h[place]]), 2), return_inverse=True, return_counts=True)
        self.grams = [(h[order], rank[place], np.bincount(place, minlength=len(h))[order]), pairs]
        #: The place of each token's context among the different tokens.
        one = self.grams[0][1]
        self.before = np.empty(len(one), np.int64)
        if len(one):
            self.before[1:], self.before[0] = one[:-1], one[-1]


def buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """Of sorted hashes: their buckets, in order too."""
    return ((keys >> U64(_KEY)) * U64(n) >> U64(64 - _KEY)).astype(np.int64)


def _asks(n_buckets: list[int]):
    """Every different n-gram of a batch, by bucket, with its count: a word by its bytes, a pair by the lower bits of its hash."""

    def run(rows: pa.RecordBatch) -> Iterator[dict]:
        for row in rows.to_pylist():
            b = Batch(row)
            ends = _offsets(b.words)
            text = b.words.buffers()[2].to_pybytes() if ends[-1] else b""
            for n, ((keys, _, count), many) in enumerate(zip(b.grams, n_buckets, strict=True), 1):
                at = buckets(keys, many)
                cut = np.flatnonzero(np.diff(at, prepend=-1))
                told = np.diff(ends) if n == 1 else keys & U64((1 << _KEY) - 1)
                upto = np.append(cut[1:], len(keys))
                yield {
                    "n": np.full(len(cut), n, np.int32), "bucket": at[cut], "batch": np.full(len(cut), row["batch"]), "kind": np.full(len(cut), row["kind"], np.int32),
                    "body": [_packed(told[i:k], count[i:k]) for i, k in zip(cut, upto, strict=True)],
                    "words": [zstandard.ZstdCompressor(level=1).compress(text[ends[i] : ends[k]]) if n == 1 else None for i, k in zip(cut, upto, strict=True)],
                }

    return run


ASK = "n int, bucket long, batch long, kind int, body binary, words binary"
#: ``batch`` -1 has the bucket's sums: different ones and all, of the kept and of both.
REPLY = "batch long, n int, bucket long, kind int, body binary, seen array<long>"


def _answer(group: pa.Table) -> pa.Table:
    """Counts of a bucket's n-grams over all batches, for each batch in its own order."""
    rows = group.to_pylist()
    got = [_unpacked(r["body"]) for r in rows]
    told = np.concatenate([k for k, _ in got])
    if rows[0]["n"] == 1:
        place = np.asarray(_strings(told, b"".join([zstandard.ZstdDecompressor().decompress(r["words"]) for r in rows])).dictionary_encode().indices)
    else:
        _, place = np.unique(told, return_inverse=True)
    count = np.concatenate([c for _, c in got]).astype(np.int64)
    kind = np.repeat([r["kind"] for r in rows], [len(k) for k, _ in got])
    sums = []
    for k in (KEPT, DELETED):
        own = np.zeros(int(place.max()) + 1, np.int64)
        np.add.at(own, place[kind == k], count[kind == k])
        sums.append(own)
    kept, every = sums[0], sums[0] + sums[1]
    ends = np.cumsum([len(k) for k, _ in got])
    bodies = [_packed(kept[p], every[p]) for p in np.split(place, ends[:-1])]
    n, bucket = rows[0]["n"], rows[0]["bucket"]
    seen = [int((kept > 0).sum()), int(kept.sum()), int((every > 0).sum()), int(every.sum())]
    return pa.table({
        "batch": pa.array([r["batch"] for r in rows] + [-1], pa.int64()), "n": pa.array([n] * (len(rows) + 1), pa.int32()), "bucket": pa.array([bucket] * (len(rows) + 1), pa.int64()),
        "kind": pa.array([r["kind"] for r in rows] + [-1], pa.int32()), "body": pa.array([*bodies, None], pa.binary()), "seen": pa.array([None] * len(rows) + [seen], pa.list_(pa.int64())),
    })


def _counts(batch: Batch, replies: pa.Table, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: counts of the pair, of its context and of itself; ``which`` is 0 for the kept documents' and 1 for all.

    A pair, which may share its count with another, is never counted more often than its words.
    """
    by = []
    for n in (1, 2):
        own = sorted((r["bucket"], r["body"]) for r in replies.to_pylist() if r["n"] == n)
        by.append(np.concatenate([_unpacked(body)[which] for _, body in own]).astype(np.int64) if own else np.zeros(0, np.int64))
    one, context = by[0][batch.grams[0][1]], by[0][batch.before]
    return np.minimum(by[1][batch.grams[1][1]], np.minimum(one, context)), context, one


def levels(context: np.ndarray) -> np.ndarray:
    """The bucket of a context's frequency: 0, 1, 2 to 3, 4 to 7 and so on."""
    return np.where(context > 0, np.frexp(np.maximum(context, 1).astype(float))[1], 0)


def parts(pair: np.ndarray, context: np.ndarray, one: np.ndarray, total: int, different: int) -> np.ndarray:
    """The three estimates of each token: of the pair, of the word alone and the uniform one; what can't be estimated takes the next one's value."""
    even = np.full(len(one), 1 / (different + 1))
    word = one / total if total else even
    return np.stack([np.where(context > 0, pair / np.maximum(context, 1), word), word, even], axis=1)


def _triples(batch: Batch, replies: pa.Table) -> pa.Table:
    """Different (pair, context, one) counts of a batch's tokens and how often each occurs."""
    seen, n = np.unique(np.stack(_counts(batch, replies, 0), axis=1), axis=0, return_counts=True)
    return pa.table({"pair": seen[:, 0], "context": seen[:, 1], "one": seen[:, 2], "n": n})


def _both(run, schema: str):
    """``run(batch, replies, row)`` on a batch's own row and its replies."""
    to = arrow_schema(schema)

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [run(Batch(row), right, row) for row in left.to_pylist()]
        return pa.concat_tables(out).cast(to) if out else to.empty_table()

    return one, schema


LEVELS = 65


def expected(rows: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    """The E step: by level, how many tokens each estimate accounts for; rows are (level and count, estimates)."""
    out = np.zeros((LEVELS, 3))
    for at, p in rows:
        share = weights[at[:, 0]] * p
        share *= (at[:, 1] / share.sum(axis=1))[:, None]
        np.add.at(out, at[:, 0], share)
    return out


def improved(sums: np.ndarray) -> np.ndarray:
    """The M step, with one token of its own for each estimate so that no weight is nought; a level without tokens takes the nearest lower one's, else the nearest higher one's."""
    weights = (sums + 1) / (sums + 1).sum(axis=1, keepdims=True)
    full = np.flatnonzero(sums.sum(axis=1) > 0)
    if len(full):
        weights = weights[full[np.maximum(np.searchsorted(full, np.arange(LEVELS), "right") - 1, 0)]]
    return weights


def learn_weights(counts: DataFrame, total: int, different: int, rounds: int = 20, enough: float = 1e-4) -> np.ndarray:
    """Weights by level of context frequency from (pair, context, one, n) of the deleted documents' tokens.

    Tasks add up the E step of their rows; what reaches the driver has a row for
    each level.  Stops after ``rounds`` or where no weight changes by ``enough``.
    """
    weights = np.full((LEVELS, 3), 1 / 3)
    for _ in range(rounds):
        now = weights

        def step(b: pa.RecordBatch, now=now) -> Iterator[dict]:
            pair, context, one, n = (np.asarray(b.column(c)) for c in ("pair", "context", "one", "n"))
            sums = expected([(np.stack([levels(context), n], axis=1), parts(pair, context, one, total, different))], now)
            at = np.flatnonzero(sums.sum(axis=1))
            yield {"level": at.astype(np.int32), "a": sums[at, 0], "b": sums[at, 1], "c": sums[at, 2]}

        partial = per_batch(counts, step, "level int, a double, b double, c double")
        sums = np.zeros((LEVELS, 3))
        for r in partial.groupBy("level").agg(*[F.sum(c).alias(c) for c in "abc"]).collect():
            sums[r.level] = r.a, r.b, r.c
        weights = improved(sums)
        if np.abs(weights - now).max() < enough:
            break
    return weights


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame, batch_bytes: int = 4 << 20, bucket_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from rows whose crc32(doc_id as text) mod 7 is not 2; a tenth of them,
    by another hash, is deleted from the frequencies while the weights are learned.
    ``score`` is the log10 probability of the text and its end, ``base_score`` that
    by single words with one added to each count.

    Null and empty texts are an end alone.  Rows that repeat count and are scored
    each; a row with a null doc_id is held out.  Without training documents every
    token is unknown: base_score is 0 and score what the uniform share gives.  An
    empty table gives no rows; other columns are ignored.  Texts are read whole; a
    text longer than a batch is a batch of its own.  Words are told apart by their
    bytes, pairs by 40 bits within a bucket: about one pair in 10^6 shares its
    count with another, which ``score`` alone sees.
    """
    h = F.encode(F.col("doc_id").cast("string"), "UTF-8")
    kind = F.when(F.coalesce(F.crc32(h) % 7 == 2, F.lit(True)), HELD_OUT).when(F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0, DELETED).otherwise(KEPT)
    run, schema = _batched(batch_bytes)
    texts = written(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), kind.alias("kind")).mapInArrow(run, schema), "texts")
    size = texts.agg(F.sum("bytes")).first()[0] or 0
    many = max(1, size // bucket_bytes)
    asks = per_batch(texts, _asks([max(1, many // 8), many]), ASK)
    replies = written(asks.groupBy("n", "bucket").applyInArrow(_answer, REPLY), "replies")
    seen = replies.where("batch = -1 and n = 1").agg(*[F.sum(F.get("seen", F.lit(k))).alias(f"s{k}") for k in range(4)]).first()
    kept_v, kept_n, every_v, every_n = (x or 0 for x in seen)
    of = lambda df: df.groupBy("batch")
    own = replies.where("batch >= 0").select("batch", "n", "bucket", "kind", "body")
    one, schema = _both(lambda b, right, row: _triples(b, right), "pair long, context long, one long, n long")
    deleted = of(texts.where(F.col("kind") == DELETED)).cogroup(of(own.where(F.col("kind") == DELETED))).applyInArrow(one, schema)
    counts = written(deleted.groupBy("pair", "context", "one").agg(F.sum("n").alias("n")), "counts")
    weights = learn_weights(counts, kept_n, kept_v)
    dropped(counts)

    def scored(b: Batch, right: pa.Table, row: dict) -> pa.Table:
        pair, context, single = _counts(b, right, 1)
        p = (weights[levels(context)] * parts(pair, context, single, every_n, every_v)).sum(axis=1)
        base = np.log10((single + 1) / (every_n + every_v + 1))
        add = lambda x: np.add.reduceat(x, b.offs[:-1])
        n = len(b.ids)
        return pa.table({"doc_id": b.ids, "held_out": [row["kind"] == HELD_OUT] * n, "n_tokens": np.diff(b.offs), "n_known": add((single > 0).astype(np.int64)), "train_tokens": np.full(n, every_n), "base_score": add(base), "score": add(np.log10(p))})

    one, schema = _both(scored, SCORED)
    return of(texts).cogroup(of(own)).applyInArrow(one, schema)


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under a model of six in seven of them; ``scores`` says how odd rows count."""
    return scores(table(spark, sf_dir, "documents"))
