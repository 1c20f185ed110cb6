"""Line deduplication by an exact set-similarity join.

A line is its set of words.  Words are ordered by rarity: their counts over all
documents, kept in a table of fixed size by hash, then the hash, so the order is
total whatever shares a cell.  Two lines that are similar enough share a word of
their prefixes.  Prefix entries (word, line, length, position, bitmap of the
words) travel as arrays by bucket of the word; pairs of a word pass the length,
positional and bitmap filters.  Lines with a candidate are read again, and each
pair is verified once, at the first word that its two prefixes share; a line's
set only travels to words where its candidates change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, as_batch, components, per_batch, table, unused, written
from .kernels import U64, mix, pieces, ragged, slice_hashes, utf8, words

CELLS = 1 << 21
FILTER_BITS = 1 << 23
_SLICES = 64


def line_offsets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all lines and, by text, how many lines it has; an empty text has one line."""
    breaks = np.flatnonzero(data == 10) + 1
    n = np.searchsorted(breaks, offsets[1:], "right") - np.searchsorted(breaks, offsets[:-1], "right")
    #: A break at a text's very end opens an empty line of that text.
    starts = np.concatenate([offsets[:-1], breaks])
    order = np.lexsort((np.concatenate([np.zeros(len(n), np.int8), np.ones(len(breaks), np.int8)]), np.concatenate([np.arange(len(n)), np.searchsorted(offsets[1:], breaks, "left")])))
    return np.append(starts[order], offsets[-1]), n + 1


def _counts():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            data, offs = utf8(batch.column("text"))
            for lo, hi in pieces(offs):
                d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                start, end, _ = words(d, o)
                total += np.bincount((slice_hashes(d, start, end) & U64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        if total.any():
            top = total.max()
            kind = np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
            parts = total.astype(kind).reshape(_SLICES, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([kind().itemsize] * _SLICES, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "width", "counts"])

    return run


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for p, w, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            sums[p] = sums.get(p, 0) + np.frombuffer(c, f"<u{w}").astype(np.int64)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([8] * len(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["part", "width", "counts"])


def word_ranks(docs: DataFrame) -> np.ndarray:
    """Logarithmic rarity by cell, one byte for each of ``CELLS``: a table of fixed size, whatever the input's."""
    schema = "part int, width int, counts binary"
    summed = docs.select("text").mapInArrow(_counts(), schema).repartition(_SLICES, "part").mapInArrow(_sum_counts, schema).collect()
    out = np.zeros(CELLS, np.int64).reshape(_SLICES, -1)
    for r in summed:
        out[r.part] = np.frombuffer(r.counts, "<i8")
    return np.minimum(np.log2(out.ravel() + 1.0) * 4, 255).astype(np.uint8)


def prefix_length(size: np.ndarray, least: float) -> np.ndarray:
    return size - np.ceil(least * size - 1e-9).astype(np.int64) + 1


def line_sets(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(lines, sizes, matrix, keep): words of lines of like length, rarest first; keep marks one of each."""
    start, end, by_line = words(data, offsets)
    h = slice_hashes(data, start, end)
    key = (ranks[(h & U64(CELLS - 1)).astype(np.int64)].astype(U64) << U64(56)) | (h >> U64(8))
    n = np.diff(by_line)
    width = np.where(n > 0, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), 0)
    for w in np.unique(width[width > 0]):
        lines = np.flatnonzero(width == w)
        at = ragged(by_line[lines], n[lines])
        row = np.repeat(np.arange(len(lines)), n[lines])
        m = np.full((len(lines), w), ~U64(0))
        m[row, ragged(np.zeros(len(lines), np.int64), n[lines])] = key[at]
        m.sort(axis=1)
        keep = np.arange(w) < n[lines][:, None]
        keep[:, 1:] &= m[:, 1:] != m[:, :-1]
        yield lines, keep.sum(axis=1), m, keep


def digests(m: np.ndarray, keep: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix((mix(m.ravel()).reshape(m.shape) * keep).sum(axis=1, dtype=U64) + size.astype(U64))


#: Longer lines have bitmaps of 128 bits, whose halves fold into the 64 of the others.
_LONG = 96
ENTRY = {"word": "<u8", "line": "<i8", "bits": "<u8", "size": "<u4", "at": "<u4"}
#: Turns the order of unsigned words into that of Spark's longs.
_TOP = U64(1 << 63)


def _entries(ranks, least: float, buckets: int):
    schema = "kind int, bucket int, body binary, doc_id long, line int, class long"
    to = arrow_schema(schema)

    def one(batch):
        data, offs = utf8(batch.column("text"))
        ids = batch.column("doc_id")
        for lo, hi in pieces(offs):
            d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            lines, per_text = line_offsets(d, o)
            first = np.cumsum(per_text) - per_text
            text_of = np.repeat(np.arange(hi - lo), per_text)
            found, cls, out = [], [], []
            for which, size, m, keep in line_sets(d, lines, ranks.value):
                dig = digests(m, keep, size).view(np.int64)
                found.append(which)
                cls.append(dig)
                place = np.cumsum(keep, axis=1) - 1
                take = keep & (place < prefix_length(size, least)[:, None]) & (size >= least / (1 - least) - 1e-9)[:, None]
                r, c = np.nonzero(take)
                if not len(r):
                    continue
                low, high = (np.bitwise_xor.reduce(np.where(keep, x.reshape(m.shape), U64(0)), axis=1) for x in _parity(m.ravel()))
                out.append((m[r, c], dig[r], (low ^ high)[r], size[r].astype(np.uint32), place[r, c].astype(np.uint32), high[r]))
            if found:
                w, c = np.concatenate(found), np.concatenate(cls)
                t, k = text_of[w], len(w)
                b = (mix(c.view(U64)) % U64(buckets)).astype(np.int32)
                yield {"kind": np.zeros(k, np.int32), "bucket": b, "body": pa.nulls(k, pa.binary()), "doc_id": ids.take(pa.array(t + lo)), "line": (w - first[t]).astype(np.int32), "class": c}
            if out:
                e = [np.concatenate(x) for x in zip(*out, strict=True)]
                b = (mix(e[0]) % U64(buckets)).astype(np.int64)
                order = np.argsort(b, kind="stable")
                e, b = [x[order] for x in e], b[order]
                edge = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
                k, cut = len(edge), [*edge.tolist(), len(b)]
                yield {"kind": np.ones(k, np.int32), "bucket": b[edge].astype(np.int32), "body": [_body([v[x:y] for v in e]) for x, y in zip(cut[:-1], cut[1:], strict=True)], "doc_id": pa.nulls(k, pa.int64()), "line": np.zeros(k, np.int32), "class": np.zeros(k, np.int64)}

    def run(batches):
        for batch in batches:
            for cols in one(batch):
                yield as_batch(cols, to)

    return run, schema


def _parity(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bit of each word in the lower and the upper half of a parity bitmap: two sets' differ in no more bits than the sets in words."""
    k = mix(v)
    bit = U64(1) << (k & U64(63))
    top = (k & U64(64)).astype(bool)
    return np.where(top, U64(0), bit), np.where(top, bit, U64(0))


def candidate_pairs(word, cls, size, at, bits, high, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one word, sorted by word and size, that pass the filters."""
    live, shift, n = np.arange(len(word)), 1, len(word)
    while True:
        live = live[live + shift < n]
        other = live + shift
        live = live[(word[live] == word[other]) & (size[live] >= least * size[other] - 1e-9)]
        if not len(live):
            return
        i, j = live, live + shift
        a, b = size[i].astype(np.int64), size[j].astype(np.int64)
        need = np.ceil(least / (1 + least) * (a + b) - 1e-9)
        ok = np.flatnonzero((np.minimum(a - at[i], b - at[j]) >= need) & (cls[i] != cls[j]) & (np.bitwise_count(bits[i] ^ bits[j]) <= a + b - 2 * need))
        if len(ok):
            i, j, most = i[ok], j[ok], (a + b - 2 * need)[ok]
            d, h = bits[i] ^ bits[j], high[i] ^ high[j]
            ok = (size[i] <= _LONG) | (size[j] <= _LONG) | (np.bitwise_count(d ^ h) + np.bitwise_count(h) <= most)
            if ok.any():
                yield i[ok], j[ok]
        shift += 1


def _body(e: list[np.ndarray]) -> bytes:
    """Entries by column; upper halves of bitmaps for long lines only."""
    return b"".join([len(e[0]).to_bytes(8, "little"), *(v.tobytes() for v in e[:5]), e[5][e[3] > _LONG].tobytes()])


def _columns(parts: list[bytes]) -> list[np.ndarray]:
    """A bucket's entries, one for each word and line, ordered by word and length."""
    cols: list[list] = [[] for _ in range(len(ENTRY) + 1)]
    for p in parts:
        n, at = int.from_bytes(p[:8], "little"), 8
        for c, kind in zip(cols, ENTRY.values(), strict=False):
            c.append(np.frombuffer(p, kind, n, at))
            at += c[-1].nbytes
        high = np.zeros(n, U64)
        high[cols[3][-1] > _LONG] = np.frombuffer(p, "<u8", -1, at)
        cols[5].append(high)
    word, line, bits, size, at, high = (np.concatenate(c) for c in cols)
    order = np.lexsort((line, size, word))
    word, line = word[order], line[order]
    new = np.concatenate([[True], (word[1:] != word[:-1]) | (line[1:] != line[:-1])])
    order = order[new]
    return [word[new], line[new], size[order], at[order], bits[order], high[order]]


def _wanted(least: float):
    """Lines as they came (kind 0), and (word, class) of entries that have a candidate (kind 1)."""
    schema = "kind int, word long, class long, partners long, doc_id long, line int"
    to = arrow_schema(schema)

    def bucket(parts: list[bytes]) -> pa.RecordBatch | None:
        cols = _columns(parts)
        n = len(cols[0])
        need, partners, own = np.zeros(n, bool), np.zeros(n, U64), mix(cols[1].view(U64))
        for i, j in candidate_pairs(*cols, least):
            need[i] = True
            need[j] = True
            np.add.at(partners, i, own[j])
            np.add.at(partners, j, own[i])
        k = int(need.sum())
        if not k:
            return None
        return as_batch({"kind": np.ones(k, np.int32), "word": (cols[0][need] ^ _TOP).view(np.int64), "class": cols[1][need], "partners": partners[need].view(np.int64), "doc_id": pa.nulls(k, pa.int64()), "line": np.zeros(k, np.int32)}, to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            plain = pa.array(np.flatnonzero(kind == 0))
            if len(plain):
                zero = np.zeros(len(plain), np.int64)
                yield as_batch({"kind": zero, "word": zero, "partners": zero, **{c: batch.column(c).take(plain) for c in ("class", "doc_id", "line")}}, to)
            on = pa.array(np.flatnonzero(kind == 1))
            for b, body in zip(batch.column("bucket").take(on).to_pylist(), batch.column("body").take(on).to_pylist(), strict=True):
                if b != now and held:
                    if (out := bucket(held)) is not None:
                        yield out
                    held = []
                now = b
                held.append(body)
        if held and (out := bucket(held)) is not None:
            yield out

    return run, schema


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_BITS, bool)
    for batch in batches:
        bits[_bit(batch.column("doc_id").to_numpy(zero_copy_only=False))] = True
    if bits.any():
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array([p.tobytes() for p in np.packbits(bits).reshape(_SLICES, -1)], pa.binary())], ["part", "bits"])


def _any(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for p, c in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist(), strict=True):
            sums[p] = sums.get(p, np.uint8(0)) | np.frombuffer(c, np.uint8)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["part", "bits"])


def _bit(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U64)) & U64(FILTER_BITS - 1)).astype(np.int64)


def possibly(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without most rows whose doc_id isn't in ``ids``: one bit array of fixed size goes to all tasks, so that fewer texts are shuffled."""
    schema = "part int, bits binary"
    rows = ids.select("doc_id").mapInArrow(_mark, schema).repartition(_SLICES, "part").mapInArrow(_any, schema).collect()
    bits = np.zeros((_SLICES, FILTER_BITS // 8 // _SLICES), np.uint8)
    for r in rows:
        bits[r.part] = np.frombuffer(r.bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits.ravel())

    @F.pandas_udf("boolean")
    def there(doc_id: pd.Series) -> pd.Series:
        k = _bit(doc_id.to_numpy())
        return pd.Series((shared.value[k >> 3] >> (7 - (k & 7)).astype(np.uint8)) & 1 > 0)

    return docs.where(there("doc_id"))


def _extract(ranks):
    def one(batch):
        data, offs = utf8(batch.column("text"))
        asked = batch.column("asked").to_pylist()
        for lo, hi in pieces(offs):
            d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            lines, per_text = line_offsets(d, o)
            first = np.cumsum(per_text) - per_text
            want: dict[int, list] = {}
            for r in range(hi - lo):
                for x in asked[lo + r]:
                    want.setdefault(int(first[r]) + x["line"], []).append(x)
            pick = np.array(sorted(want), np.int64)
            cols: dict[str, list] = {c: [] for c in ("word", "class", "doc_id", "line", "body")}
            for which, _, m, keep in line_sets(d, lines, ranks.value):
                on = np.flatnonzero(np.isin(which, pick))
                for k in on:
                    body = m[k][keep[k]].tobytes()
                    dig = int(digests(m[k : k + 1], keep[k : k + 1], keep[k : k + 1].sum(axis=1)).view(np.int64)[0])
                    for x in want[int(which[k])]:
                        if x["class"] != dig:
                            continue
                        for w in x["words"]:
                            cols["word"].append(w)
                            cols["body"].append(body)
                            for c in ("class", "doc_id", "line"):
                                cols[c].append(x[c])
            yield cols

    return one


def _verify(least: float, at_once: int = 1 << 14):
    """(class, n_links, later, root): verified links of each class here, whether one is with an earlier line, and its group."""
    schema = "class long, n_links long, later boolean, root long"
    to = arrow_schema(schema)

    def some(rows: list[tuple]) -> pa.RecordBatch | None:
        rows = list({r[:2]: r for r in rows}.values())
        word = np.array([r[0] for r in rows]).view(U64) ^ _TOP
        sets = [np.frombuffer(r[4], U64) for r in rows]
        size = np.array([len(s) for s in sets])
        order = np.lexsort((size, word))
        rows, sets = [rows[k] for k in order], [sets[k] for k in order]
        word, size = word[order], size[order]
        cls = np.array([r[1] for r in rows])
        flat = np.concatenate(sets)
        begin = np.cumsum(size) - size
        seg = np.repeat(np.arange(len(rows)), size)
        low, high = (np.bitwise_xor.reduceat(x, begin) for x in _parity(flat))
        at = np.zeros(len(rows), np.int64)
        hit = np.flatnonzero(flat == word[seg])
        at[seg[hit]] = hit - begin[seg[hit]]
        when = sorted({(r[2], r[3]) for r in rows})
        when = {w: k for k, w in enumerate(when)}
        when = np.array([when[r[2], r[3]] for r in rows])
        links, later = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
        root = {int(c): int(c) for c in cls}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def shared(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
            """Words that the first ``n`` of each of the two sets have in common."""
            pair = np.arange(len(i))
            r = np.concatenate([np.repeat(pair, n[i]), np.repeat(pair, n[j])])
            v = flat[np.concatenate([ragged(begin[i], n[i]), ragged(begin[j], n[j])])]
            o = np.lexsort((v, r))
            r, v = r[o], v[o]
            return np.bincount(r[1:][(r[1:] == r[:-1]) & (v[1:] == v[:-1])], minlength=len(i))

        def check(i: np.ndarray, j: np.ndarray) -> None:
            #: The pair counts only under the first word that both have.
            first = shared(i, j, at) == 0
            i, j = i[first], j[first]
            both = shared(i, j, size)
            on = np.flatnonzero(both >= least * (size[i] + size[j] - both) - 1e-9)
            i, j = i[on], j[on]
            np.add.at(links, i, 1)
            np.add.at(links, j, 1)
            later[np.where(when[i] < when[j], j, i)] = True
            for x, y in zip(cls[i].tolist(), cls[j].tolist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)

        for i, j in candidate_pairs(word, cls, size, at, low ^ high, high, least):
            for k in range(0, len(i), at_once):
                check(i[k : k + at_once], j[k : k + at_once])
        on = np.flatnonzero(links)
        return as_batch({"class": cls[on], "n_links": links[on], "later": later[on], "root": [find(int(x)) for x in cls[on]]}, to) if len(on) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("word", "class", "doc_id", "line", "body")), strict=True):
                if len(held) >= 1 << 14 and r[0] != now:
                    if (out := some(held)) is not None:
                        yield out
                    held = []
                now = r[0]
                held.append(r)
        if held and (out := some(held)) is not None:
            yield out

    return run, schema


def line_matches(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """A row for each line that has words: doc_id, line, class, removed, n_links, class_id.

    Lines with one set of words are one class.  Two classes are linked if the
    Jaccard similarity of their sets is ``similarity`` or more.  removed: an
    earlier line, by doc_id and then line number (from 0), has the same class or
    a linked one.  n_links: classes linked to the line's.  class_id: the smallest
    doc_id that has a line in the line's component of links.  Lines end at ``\\n``;
    lines without words are in no class and never removed.  A null text has no
    lines with words; rows with a null doc_id are left out; rows that repeat a
    doc_id count as one text's, so equal lines under one id and number are one
    line.  An empty table gives no rows; other columns don't come back.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    ranks = spark.sparkContext.broadcast(word_ranks(docs))
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    run, schema = _entries(ranks, similarity, buckets)
    made = docs.mapInArrow(run, schema).repartition("bucket").sortWithinPartitions("bucket")
    run, schema = _wanted(similarity)
    made = written(made.mapInArrow(run, schema), "lines")
    lines = made.where("kind = 0").select("doc_id", "line", "class")
    wanted = made.where("kind = 1").select("word", "class", "partners")
    classes = written(lines.groupBy("class").agg(F.min(F.struct("doc_id", "line")).alias("x")).select("class", "x.*"), "classes")
    #: Under a word whose candidates are those of the word before, no pair has its first common word.
    firsts = "transform(filter(seen, (x, i) -> i = 0 or x.partners <> seen[i - 1].partners), x -> x.word)"
    asked = (
        wanted.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("word", "partners"))).alias("seen")).select("class", F.expr(firsts).alias("words")).join(classes, "class")
        .groupBy("doc_id").agg(F.collect_list(F.struct("class", "doc_id", "line", "words")).alias("asked"))
    )
    asked = written(asked, "asked")
    sets = per_batch(possibly(docs, asked).join(asked, "doc_id").select("text", "asked"), _extract(ranks), "word long, class long, doc_id long, line int, body binary")
    run, schema = _verify(similarity)
    found = written(sets.repartition("word").sortWithinPartitions("word").select("word", "class", "doc_id", "line", "body").mapInArrow(run, schema), "links")
    comp = written(components(found.select(F.col("class").alias("a"), F.col("root").alias("b"))), "components").withColumnRenamed("id", "class")
    links = found.groupBy("class").agg(F.sum("n_links").alias("n_links"), F.max("later").alias("later"))
    linked = written(classes.join(links, "class").join(comp, "class", "left").withColumn("comp", F.coalesce("comp", "class")), "linked")
    of = linked.join(linked.groupBy("comp").agg(F.min("doc_id").alias("class_id")), "comp").select("class", "n_links", "later", "class_id")
    full = classes.withColumnsRenamed({"doc_id": "first_doc", "line": "first_line"}).join(of, "class", "left")
    full = written(full.select("class", "first_doc", "first_line", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("later", F.lit(False)).alias("later"), F.coalesce("class_id", "first_doc").alias("class_id")), "classes")
    return lines.distinct().join(full, "class").select(
        "doc_id", "line", "class", (F.col("later") | (F.col("doc_id") != F.col("first_doc")) | (F.col("line") != F.col("first_line"))).alias("removed"), "n_links", "class_id"
    )


def remove_lines(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` with the lines that ``line_matches`` removes taken out of text; all columns and rows stay.

    A text that loses no line is unchanged, one that loses all is empty.
    """
    doc, lines = unused(docs, "gone_doc"), unused(docs, "gone_lines")
    gone = line_matches(docs, similarity).where("removed").groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set("line").alias(lines))
    j = docs.join(gone, docs["doc_id"] == gone[doc], "left")
    kept = F.expr(f"array_join(transform(filter(transform(split(text, '\\n', -1), (x, i) -> struct(x, i)), y -> not array_contains({lines}, y.i)), y -> y.x), '\\n')")
    return j.withColumn("text", F.when(F.col(lines).isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: doc_id, n_lines (with words), n_removed, removed_lines (numbers between commas), n_links, class_id."""
    docs = table(spark, sf_dir, "documents")
    by_doc = line_matches(docs).groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count_if("removed").alias("n_removed"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("removed"), F.col("line")))), ",").alias("removed_lines"),
        F.sum("n_links").alias("n_links"), F.min("class_id").alias("class_id"),
    )
    return docs.select("doc_id").join(by_doc, "doc_id", "left").select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("removed_lines", F.lit("")).alias("removed_lines"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("class_id", "doc_id").alias("class_id"),
    )
