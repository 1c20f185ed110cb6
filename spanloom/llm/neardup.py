"""Near-duplicate classes of documents by weighted Jaccard over word shingles.

BagMinHash signatures: the weight axis of a shingle is cut into the intervals
(0, 1], (1, 2], (2, 4], .., each with a Poisson process of its own whose rate is
the interval's length.  A point descends the halves of its interval by the bits
of its mark and counts if the unit level it reaches lies below the shingle's
count.  Points fall on registers at random and each register keeps its earliest,
so two registers agree with the probability of the weighted Jaccard similarity.
A document's registers are filled round by round, the next point of every
process at a time, and a process ends at the document's latest register, so a
shingle costs about one point.

Registers are banded.  In each bucket every text is checked against the bucket's
smallest id; afterwards buckets whose texts are still in several classes compare
those across classes: signatures tell, each pair in its first common band, which
texts may still have a link, and all of those in a bucket are held against each
other.  A link is verified by the overlap of the two multisets; what joins two
classes is reported once for each bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, as_batch, components, dropped, per_batch, table, unused, written
from .kernels import U64, gram_hashes, mix, pieces, ragged, slice_hashes, utf8, words

_GOLD = U64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle of ``k`` words; a shorter text is one shingle, an empty one has none."""
    start, end, by_row = words(data, offsets)
    h = slice_hashes(data, start, end)
    n = np.diff(by_row)
    count = np.maximum(n - k + 1, 0)
    at = ragged(by_row[:-1], count)
    hashes = gram_hashes(h, k)[at] if len(at) else np.zeros(0, U64)
    rows = np.repeat(np.arange(len(n)), count)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        own = np.concatenate([gram_hashes(h[by_row[r] : by_row[r + 1]], int(n[r]), 1) for r in short])
        rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, own])
    return rows, hashes


def multisets(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and count of each distinct shingle of a row, ordered by both."""
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])) if len(r) else np.zeros(0, np.int64)
    return r[new], h[new], np.diff(np.append(new, len(r)))


def bag_min_hash(rows: np.ndarray, items: np.ndarray, weights: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """Earliest times (n_rows, m); a row without items keeps infinity."""
    sig = np.full(n_rows * m, np.inf)
    parts, low, high = [], 0, 1
    while len(weights) and low < weights.max():
        on = np.flatnonzero(weights > low)
        seed = mix(items[on] ^ U64((high * 0xA24BAED4963EE407) & (2**64 - 1)))
        parts.append((rows[on], seed, np.full(len(on), high - low), np.minimum(weights[on], high) - low))
        low, high = high, high * 2
    if not parts:
        return sig.reshape(n_rows, m)
    row, state, size, below = (np.concatenate(x) for x in zip(*parts, strict=True))
    t = np.zeros(len(row))
    while len(row):
        state = state + _GOLD
        r = mix(state)
        t = t - np.log1p(-((r >> U64(11)).astype(np.float64) * 2.0**-53)) / size
        last = sig.reshape(n_rows, m).max(axis=1)
        keep = np.flatnonzero(t < last[row])
        row, state, size, below, t = row[keep], state[keep], size[keep], below[keep], t[keep]
        mark = mix(r[keep] ^ U64(0x2545F4914F6CDD1D))
        on = np.flatnonzero(((mark >> U64(32)).astype(np.int64) & (size - 1)) < below)
        np.minimum.at(sig, row[on] * m + (mark[on] & U64(0xFFFFFFFF)).astype(np.int64) % m, t[on])
    return sig.reshape(n_rows, m)


def _sign(k: int, m: int, per_band: int):
    def one(batch):
        data, offs = utf8(batch.column("text"))
        for lo, hi in pieces(offs, 1 << 20):
            n = hi - lo
            rows, hashes = shingles(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], k)
            sig = mix(bag_min_hash(*multisets(rows, hashes), n, m).view(U64).ravel()).reshape(n, m)
            bands = gram_bands(sig, per_band)
            has = np.zeros(n, bool)
            has[rows] = True
            keys = [bands[i].view(np.int64) if has[i] else [] for i in range(n)]
            small = (sig & U64(255)).astype(np.uint8)
            yield {"doc_id": batch.column("doc_id").slice(lo, n), "h": batch.column("h").slice(lo, n), "bands": keys, "sig": [x.tobytes() for x in small]}

    return one


def gram_bands(sig: np.ndarray, per_band: int) -> np.ndarray:
    n, m = sig.shape
    b = m // per_band
    out = np.tile(mix(np.arange(1, b + 1, dtype=U64)), (n, 1))
    for i in range(per_band):
        out = out * U64(0xFF51AFD7ED558CCD) + sig[:, i : b * per_band : per_band]
    return mix(out.ravel()).reshape(n, b)


def overlaps(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Weighted Jaccard of row i of ``left`` and of ``right``, each rows and hashes."""
    r = np.concatenate([left[0], right[0]])
    h = np.concatenate([left[1], right[1]])
    side = np.repeat([0, 1], [len(left[0]), len(right[0])])
    order = np.lexsort((h, r))
    r, h, side = r[order], h[order], side[order]
    new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])])) if len(r) else np.zeros(0, np.int64)
    if not len(new):
        return np.zeros(n)
    total, b = np.diff(np.append(new, len(r))), np.add.reduceat(side, new)
    a = total - b
    both = np.bincount(r[new], np.minimum(a, b), n)
    return both / np.maximum(np.bincount(r[new], np.maximum(a, b), n), 1)


def _verify(k: int, least: float):
    def one(batch):
        a, ao = utf8(batch.column("text_a"))
        b, bo = utf8(batch.column("text_b"))
        for lo, hi in pieces(ao + bo, 1 << 20):
            x = overlaps(shingles(a[ao[lo] : ao[hi]], ao[lo : hi + 1] - ao[lo], k), shingles(b[bo[lo] : bo[hi]], bo[lo : hi + 1] - bo[lo], k), hi - lo)
            on = pa.array(np.flatnonzero(x >= least))
            yield {"a": batch.column("a").slice(lo, hi - lo).take(on), "b": batch.column("b").slice(lo, hi - lo).take(on), "similarity": x[x >= least]}

    return one


def verified(pairs: DataFrame, texts: DataFrame, k: int, least: float) -> DataFrame:
    """(a, b, similarity) of those pairs (a, b) of ids whose texts are alike enough."""
    first = texts.withColumnsRenamed({"id": "a", "text": "text_a"}).hint("merge")
    second = texts.withColumnsRenamed({"id": "b", "text": "text_b"}).hint("merge")
    two = pairs.join(first, "a").join(second, "b")
    return written(per_batch(two.select("a", "b", "text_a", "text_b"), _verify(k, least), "a long, b long, similarity double"), "alike")


def _open_pairs(comps: np.ndarray, sigs: np.ndarray, bands: np.ndarray, own: int, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """i, others and agreement: pairs of different classes whose signatures agree enough and whose first common band is ``own``."""
    m = sigs.shape[1]
    _, inv, size = np.unique(comps, return_inverse=True, return_counts=True)
    order = np.lexsort((inv, size[inv]))
    inv, sigs, bands = inv[order], sigs[order], bands[order]
    edge = np.append(np.flatnonzero(np.concatenate([[True], inv[1:] != inv[:-1]])), len(order))
    for x, y in zip(edge[:-1], edge[1:], strict=True):
        for i in range(x, y):
            for z in range(y, len(order), 1 << 14):
                same = (sigs[z : z + (1 << 14)] == sigs[i]).sum(axis=1)
                on = np.flatnonzero(same >= least * m)
                on = on[~(bands[z + on, :own] == bands[i, :own]).any(axis=1)]
                if len(on):
                    yield order[i], order[z + on], same[on]


def _by_bucket(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[int, list[tuple]]]:
    held, key = [], None
    for batch in batches:
        for k, *x in zip(*(batch.column(c).to_pylist() for c in ("key", *names)), strict=True):
            if k != key and held:
                yield key, held
                held = []
            key = k
            held.append(x)
    if held:
        yield key, held


def _arrays(rows: list, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.array([x[0] for x in rows]), np.array([x[1] for x in rows]), np.frombuffer(b"".join(x[2] for x in rows), np.uint8).reshape(-1, m), np.array([x[3] for x in rows])


def _undecided(m: int, least: float):
    """(key, id) of texts that a pair of their bucket still has to be verified for."""
    schema = "key long, id long"
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _by_bucket(batches, ("id", "comp", "sig", "bands")):
            ids, comps, sigs, bands = _arrays(rows, m)
            need = np.zeros(len(ids), bool)
            for i, j, _ in _open_pairs(comps, sigs, bands, int(np.flatnonzero(bands[0] == key)[0]), least):
                need[i] = True
                need[j] = True
            if need.any():
                yield as_batch({"key": np.full(need.sum(), key), "id": ids[need]}, to)

    return run, schema


def join_classes(bags: list[tuple[np.ndarray, np.ndarray]], classes: np.ndarray, similarity: float, cells: int = 1 << 22) -> np.ndarray:
    """The smallest class that each text's class is joined to by texts, of any class, that are alike enough.

    ``bags``: shingles and their counts of each text.  Overlaps are products of
    matrices of texts and shingles that several texts have, up to ``cells`` entries
    at a time, so memory grows with the texts and not with their pairs.
    """
    n, now = len(bags), classes.copy()
    _, inv, size = np.unique(classes, return_inverse=True, return_counts=True)
    order = np.lexsort((inv, size[inv]))
    total = np.array([c.sum() for _, c in bags])
    # An item is a shingle's i-th occurrence: texts share as many as the lesser count.
    count = np.concatenate([c for _, c in bags])
    row = np.repeat(np.repeat(np.argsort(order), [len(c) for _, c in bags]), count)
    shingle = np.repeat(np.concatenate([h for h, _ in bags]), count)
    nth = ragged(np.zeros(len(count), np.int64), count)
    by = np.lexsort((row, nth, shingle))
    row, shingle, nth = row[by], shingle[by], nth[by]
    item = np.cumsum(np.concatenate([[False], (shingle[1:] != shingle[:-1]) | (nth[1:] != nth[:-1])])) if len(row) else row
    shared = np.bincount(item)[item] > 1
    row, item = row[shared], item[shared]
    item = np.cumsum(np.concatenate([[False], item[1:] != item[:-1]])) if len(item) else item
    total = total[order]
    step, width = max(1, min(256, cells // n)), max(1, cells // n)
    cuts = np.searchsorted(item, np.arange(0, (item[-1] + 1 if len(item) else 0) + width, width))
    for lo in range(0, n, step):
        own = now[order]
        mine = np.arange(lo, min(lo + step, n))
        others = np.arange(lo, n)
        if (own[others] == own[lo]).all():
            continue
        both = np.zeros((len(mine), len(others)))
        for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            has = np.zeros((n - lo, width), np.float32)
            on = row[x:y] >= lo
            has[row[x:y][on] - lo, item[x:y][on] - k * width] = 1
            both += has[: len(mine)] @ has.T
        alike = both / np.maximum(total[mine][:, None] + total[others] - both, 1) >= similarity
        for i, near in zip(mine, alike, strict=True):
            met = np.unique(own[others[near]])
            if len(met) > 1 or len(met) and met[0] != own[i]:
                met = np.union1d(met, own[i])
                own[np.isin(own, met)] = met[0]
        now[order] = own
    return now


def _decide(k: int, similarity: float):
    """(a, b): a class of a bucket and a smaller one that texts of the bucket join it to."""
    schema = "a long, b long"
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches, ("comp", "text")):
            comps = np.array([x[0] for x in rows])
            bags = [multisets(*shingles(*utf8(pa.array([x[1]])), k))[1:] for x in rows]
            now = join_classes(bags, comps, similarity)
            on = now != comps
            if on.any():
                a, b = np.unique(np.stack([comps[on], now[on]]), axis=1)
                yield as_batch({"a": a, "b": b}, to)

    return run, schema


def text_digest(text: str = "text") -> Column:
    """What tells texts apart; a null text is an empty one."""
    return F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))


def near_classes(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8, bands: int = 24, per_band: int = 4, slack: float = 0.2) -> DataFrame:
    """(doc_id, h, class_id, leads) of every row: h is its ``text_digest``, leads whether its text stands for its class.

    A text is named by the smallest doc_id that has it, other texts of that id by
    a hash, so texts of one id are told apart; see ``near_duplicates``.
    """
    m = bands * per_band
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), text_digest().alias("h"))
    signed = written(per_batch(keyed, _sign(words_per_shingle, m, per_band), "doc_id long, h string, bands array<long>, sig binary"), "signed")
    reps = signed.groupBy("h").agg(F.min("doc_id").alias("doc"), F.min_by(F.struct("bands", "sig"), "doc_id").alias("x")).select("h", "doc", "x.*")
    other = F.row_number().over(Window.partitionBy(F.coalesce("doc", F.xxhash64("h"))).orderBy("h")) > 1
    reps = written(reps.withColumn("other", other).select("h", "doc", F.when(F.col("doc").isNotNull() & F.col("other"), F.xxhash64("doc", "h")).otherwise(F.col("doc")).alias("id"), "bands", "sig"), "reps")
    occ = reps.where("id is not null").select("id", F.explode("bands").alias("key"))
    first = written(occ.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("key", "a"), "buckets")
    member = written(occ.join(first, "key"), "members")
    pairs = written(member.where("a < id").select("a", F.col("id").alias("b")).distinct(), "pairs")
    inside = reps.select("h", F.col("doc").alias("doc_id"), "id").join(member.select("id").distinct(), "id").hint("merge")
    texts = written(keyed.join(inside, ["doc_id", "h"]).select("id", "text").dropDuplicates(["id"]), "texts")
    links = verified(pairs, texts, words_per_shingle, similarity)
    comp = written(components(links), "classes")
    placed = written(member.select("key", "id").join(comp, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp")), "inside")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    rest = written(placed.join(mixed, "key").join(reps.select("id", "sig", "bands").hint("merge"), "id"), "mixed")
    run, schema = _undecided(m, similarity - slack)
    need = rest.repartition("key").sortWithinPartitions("key").select("key", "id", "comp", "sig", "bands").mapInArrow(run, schema)
    run, schema = _decide(words_per_shingle, similarity)
    asked = rest.join(written(need, "undecided"), ["key", "id"]).join(texts.hint("merge"), "id")
    links2 = written(asked.select("key", "comp", "text").repartition("key").sortWithinPartitions("key").mapInArrow(run, schema), "alike")
    joined = written(components(links2), "joined").select(F.col("id").alias("part"), F.col("comp").alias("whole"))
    dropped(first, member, pairs, texts, placed, rest)
    of = reps.select("h", "doc", "id").join(comp, "id", "left").join(joined, F.coalesce("comp", "id") == F.col("part"), "left").select("h", "doc", F.coalesce("whole", "comp").alias("comp"))
    lead = of.where("comp is not null").groupBy("comp").agg(F.min(F.struct("doc", F.col("h").alias("by"))).alias("lead")).select("comp", "lead.*").withColumnRenamed("doc", "class_id")
    of_text = of.join(lead, "comp", "left").select("h", F.coalesce("class_id", "doc").alias("class_id"), (F.coalesce("by", "h") == F.col("h")).alias("leads"))
    return signed.select("doc_id", "h").join(written(of_text, "classes"), "h")


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, class_id): the smallest doc_id that a chain of near-duplicates leads to.

    Two texts are linked if the weighted Jaccard similarity of their shingle
    multisets (``words_per_shingle``, 5) is ``similarity`` (0.8) or more.  Equal
    texts are one class, found by digest before the signatures are banded; a null
    text equals an empty one, and texts without words have no links but to their
    equals.  A text of fewer words than a shingle is one shingle.  Rows with one
    doc_id have the class of their own text each; a null doc_id gets that of its
    equals.  Other columns don't come back; an empty table gives no rows.  A pair
    at the least similarity is missed with probability
    (1 - similarity**per_band)**bands, 3e-6 as set.
    """
    return near_classes(docs, **how).select("doc_id", "class_id")


def distinct_texts(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each class of ``near_duplicates``: one that has the class's smallest doc_id.

    Rows with one doc_id and different texts stay, unless their texts are alike.  A
    row with a null doc_id goes if its text, or one like it, has an id.
    """
    doc, digest = unused(docs, "doc"), unused(docs, "digest")
    left = near_classes(docs, **how).where("leads and doc_id <=> class_id").select(F.col("doc_id").alias(doc), F.col("h").alias(digest)).distinct()
    rows = docs.withColumn(digest, text_digest()).hint("merge")
    own = rows.join(left.withColumnRenamed(digest, digest + "_"), (rows["doc_id"].eqNullSafe(F.col(doc))) & (rows[digest] == F.col(digest + "_")))
    return own.dropDuplicates(["doc_id", digest]).select(*docs.columns)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
