"""Exact removal of word passages that occur more than once.

A passage is ``window`` successive words.  Each window has an anchor, the
smallest hash of the word grams in it, so equal windows have equal anchors and
successive windows with one anchor form a segment.  Segments whose anchor stands
in one place only cannot repeat.  The others are grouped by their digests, and
the words of two places of each class, its first and its last, are read from
their texts; a class with one place gives the words of that.  They go to the
anchor's shard, which builds a compressed FM-index over them (BWT in a wavelet
matrix whose codes are shorter for commoner words) and searches every class
backwards, all classes of the shard side by side.  The length matched while the
interval holds two suffixes or more is the matching statistic; windows that lie
within it are repeated.  So it is the words found in the texts that decide: a
class whose two places hold different words is left alone.  An anchor with very
many classes is split by its windows' own hashes, so that shards are bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, as_batch, dropped, per_batch, table, written
from .kernels import U64, gram_hashes, mix, pieces, ragged, slice_hashes, utf8, words

GRAM = 8
SEGMENT = "key long, anchor long, digest long, first int, n_windows int"
_STEP = 0xD1342543DE82EF95


class WaveletMatrix:
    """Rank over symbols in zero-order compressed bits.

    A symbol's code has Shannon's length for its frequency, so all levels hold at
    most one bit a symbol more than the entropy.  At each level codes that end
    take the first places, which the next level leaves out.  Counts before each
    512 bits and, in 16 bits, before each 64 within them make up the directory.
    """

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        n = len(symbols)
        self.length = np.zeros(len(counts), np.int64)
        used = np.flatnonzero(counts)
        self.length[used] = np.maximum(1, np.ceil(np.log2(n / counts[used]) - 1e-12)).astype(np.int64)
        self.code, self.levels = np.zeros(len(counts), np.int64), []
        waiting = used[np.argsort(self.length[used], kind="stable")]
        open_ = np.zeros(1, np.int64)
        ends = []
        for k in range(int(self.length.max(initial=0))):
            kids = np.concatenate([open_, open_ | (1 << k)])
            done = int(np.searchsorted(self.length[waiting], k + 1, "right"))
            self.code[waiting[:done]] = kids[:done]
            ends.append(int(counts[waiting[:done]].sum()))
            waiting = waiting[done:]
            open_ = kids[done : done + len(waiting)]
        at = self.code[symbols]
        for k, gone in enumerate(ends):
            bit = (at >> k) & 1
            m = len(at)
            packed = np.zeros((m // 512 + 1) * 64, np.uint8)
            raw = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed[: len(raw)] = raw
            block = packed.view("<u8")
            ones = np.bitwise_count(block).astype(np.int64).reshape(-1, 8)
            far = np.zeros(len(ones), np.int64)
            np.cumsum(ones.sum(axis=1)[:-1], out=far[1:])
            near = np.zeros((len(ones), 8), np.uint16)
            near[:, 1:] = np.cumsum(ones, axis=1)[:, :-1]
            self.levels.append((block, far, near.ravel(), m - int(bit.sum()), gone))
            at = np.concatenate([at[bit == 0], at[bit == 1]])[gone:]

    def rank(self, symbol: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Where the prefix of length ``where`` ends among the equal symbols, in the order of their last level."""
        code, size, where = self.code[symbol], self.length[symbol], where.copy()
        live = np.arange(len(symbol))
        for k, (block, far, near, zero, gone) in enumerate(self.levels):
            on = size[live] > k
            if not on.all():
                live = live[on]
            if not len(live):
                break
            at = where[live]
            w = at >> 6
            r = far[w >> 3] + near[w] + np.bitwise_count(block[w] & ((U64(1) << (at & 63).astype(U64)) - U64(1)))
            at = np.where((code[live] >> k) & 1, zero + r, at - r)
            where[live] = np.where(size[live] > k + 1, at - gone, at)
        return where


class FMIndex:
    """Counts of word sequences of up to ``depth`` words; symbol 0 separates texts."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        rank, order, h = text.astype(np.int64), None, 1
        while True:
            key = rank.copy()
            if h > 1:
                half = h >> 1
                key *= int(rank.max()) + 2
                key[: n - half] += rank[half:] + 1
            order = np.argsort(key, kind="stable")
            s = key[order]
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
            rank = new
            if h >= depth + 1:
                break
            h <<= 1
        counts = np.bincount(text)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.tree = WaveletMatrix(text[order - 1], counts)
        self.zero = self.tree.rank(np.arange(len(counts)), np.zeros(len(counts), np.int64))
        self.size = n

    def back(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = self.before[symbol] - self.zero[symbol]
        m = len(symbol)
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return base + both[:m], base + both[m:]

    def reach(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How far back from each end, ``begin`` at most, the words stand in two places or more."""
        at = end.copy()
        live = np.flatnonzero(at > begin)
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.size, np.int64)
        while len(live):
            lo, hi = self.back(text[at[live] - 1], lo, hi)
            keep = hi - lo >= 2
            live, lo, hi = live[keep], lo[keep], hi[keep]
            at[live] -= 1
            more = at[live] > begin[live]
            live, lo, hi = live[more], lo[more], hi[more]
        return at

    def repeated(self, text: np.ndarray, begin: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
        """Bit i is set if the window i words after ``begin`` stands in two places or more, for i under n.

        The words of some windows are searched as one: windows that lie in what is
        matched are repeated, the last one isn't if too little is.  If not even the
        words that all the others have in common are repeated, none of them is;
        else they are searched by halves.
        """
        mask = np.zeros(len(n), np.int64)
        seg, a, k = np.arange(len(n)), np.zeros(len(n), np.int64), n.astype(np.int64)
        while len(seg):
            b = begin[seg] + a
            hits = np.clip(b + k - self.reach(text, b, b + k - 1 + window), 0, k)
            np.bitwise_or.at(mask, seg, np.left_shift(np.left_shift(1, hits) - 1, a + k - hits))
            k = k - np.maximum(hits, 1)
            on = k > 0
            seg, a, k = seg[on], a[on], k[on]
            b = begin[seg] + a
            on = self.reach(text, b + k - 1, b + np.maximum(window, k - 1)) == b + k - 1
            seg, a, k = seg[on], a[on], k[on]
            half = k // 2
            cut = half > 0
            seg, a, k = np.concatenate([seg[cut], seg]), np.concatenate([a[cut], a + half]), np.concatenate([half[cut], k - half])
        return mask


def _leftmost_min(v: np.ndarray, width: int) -> np.ndarray:
    """Index of the first smallest value in each window of ``width``."""
    at, have = np.arange(len(v)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(v[b] < v[a], b, a)
        have += step
    return at


def _word_arrays(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, offs = utf8(batch.column("text"))
    for lo, hi in pieces(offs):
        d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        start, end, by_row = words(d, o)
        yield lo, slice_hashes(d, start, end), by_row


def _segments(window: int, gram: int):
    width = window - gram + 1

    def one(batch):
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        for lo, h, by_row in _word_arrays(batch):
            count = np.maximum(np.diff(by_row) - window + 1, 0)
            at = ragged(by_row[:-1], count)
            if not len(at):
                continue
            g = gram_hashes(h, gram)
            low = _leftmost_min(g, width)[at]
            new = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
            n = np.diff(np.append(new, len(at)))
            first = at[new]
            row = np.searchsorted(by_row, first, "right") - 1
            power = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(len(h), U64(_STEP))]))
            sums = np.concatenate([[U64(0)], np.cumsum(h * power[:-1])])
            last = first + n + window - 1
            back = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(len(h), U64(pow(_STEP, -1, 1 << 64)))]))
            digest = mix(((sums[last] - sums[first]) * back[first]) ^ n.astype(U64))
            yield {"key": keys[lo + row], "anchor": g[low[new]].view(np.int64), "digest": digest.view(np.int64), "first": (first - by_row[row]).astype(np.int32), "n_windows": n.astype(np.int32)}

    return one


#: The words at a place of a class, as the text has them: 0 its first, 1 its last, 2 and 3 the same in a second row of that text.
CLASS = "anchor long, digest long, place int, n_windows int, words binary"


def _slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Byte slices as binary values."""
    ends = np.concatenate([[0], np.cumsum(end - start)])
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data[ragged(start, end - start)])])


def _extract(window: int):
    def one(batch):
        asked, twice = batch.column("asked"), batch.column("copies").to_numpy() > 1
        each, x = np.concatenate([[0], np.cumsum(asked.value_lengths().to_numpy(zero_copy_only=False))]), asked.flatten()
        first, n, place = (x.field(c).to_numpy() for c in ("first", "n_windows", "place"))
        data, offs = utf8(batch.column("text"))
        for lo, hi in pieces(offs):
            d = data[offs[lo] : offs[hi]]
            start, end, by_row = words(d, offs[lo : hi + 1] - offs[lo])
            rows = hi - lo
            a, b = each[lo], each[hi]
            size = n[a:b].astype(np.int64) + window - 1
            row = np.repeat(np.arange(rows), np.diff(each[lo : hi + 1]))
            begin = by_row[:-1][row] + first[a:b]
            # A text that several rows have stands in as many places.
            again = np.flatnonzero(twice[lo : lo + rows][row])
            pick = np.concatenate([np.arange(b - a), again])
            yield {
                **{c: x.field(c).slice(a, b - a).take(pa.array(pick)) for c in ("anchor", "digest", "n_windows")},
                "place": np.concatenate([place[a:b], place[a:b][again] + 2]).astype(np.int32), "words": _slices(d, start[begin[pick]], end[begin[pick] + size[pick] - 1]),
            }

    return one


def _read(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, their bytes one after another, where each word starts and ends, and how many windows each row has."""
    t = pa.Table.from_batches(held).combine_chunks()
    parts = t["words"].to_pylist()
    data = np.frombuffer(b"".join(parts), np.uint8)
    start, end, _ = words(data, np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]))
    return t, data, start, end, t["n_windows"].to_numpy().astype(np.int64)


def _search(window: int, shard_words: int):
    schema = "anchor long, digest long, mask int"
    to = arrow_schema(schema)

    def shard(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t, data, first, last, n = _read(held)
        flat = slice_hashes(data, first, last)
        anchor, digest, place = (t[c].to_numpy() for c in ("anchor", "digest", "place"))
        size = n + window - 1
        begin = np.cumsum(size) - size
        _, dense = np.unique(flat, return_inverse=True)
        text = np.zeros(int((size + 1).sum()), np.int64)
        start = np.cumsum(size + 1) - size - 1
        text[ragged(start, size)] = dense + 1
        # The first place of each class is searched; the class is left alone if another holds other words.
        order = np.lexsort((place, digest, anchor))
        new = np.concatenate([[True], (anchor[order][1:] != anchor[order][:-1]) | (digest[order][1:] != digest[order][:-1])])
        head = order[new][np.cumsum(new) - 1]
        own, other = head[~new], order[~new]
        same = size[own] == size[other]
        at = np.flatnonzero(same)
        off = dense[ragged(begin[own[at]], size[own[at]])] != dense[ragged(begin[other[at]], size[other[at]])]
        same[at[np.add.reduceat(off, np.cumsum(size[own[at]]) - size[own[at]]) > 0] if len(at) else at] = False
        asked = np.setdiff1d(order[new], own[~same])
        mask = FMIndex(text, window).repeated(text, start[asked], n[asked], window)
        keep = asked[mask != 0]
        return as_batch({"anchor": anchor[keep], "digest": digest[keep], "mask": mask[mask != 0].astype(np.int32)}, to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, last = [], 0, None
        for batch in batches:
            if not len(batch):
                continue
            anchor = batch.column("anchor").to_numpy()
            sums = np.concatenate([[0], np.cumsum(batch.column("n_windows").to_numpy().astype(np.int64) + window - 1)])
            at = 0
            for c in np.flatnonzero(np.concatenate([[bool(held) and anchor[0] != last], anchor[1:] != anchor[:-1]])).tolist():
                if n + sums[c] - sums[at] >= shard_words:
                    yield shard([*held, batch.slice(at, c - at)])
                    held, n, at = [], 0, c
            held.append(batch.slice(at))
            n, last = n + int(sums[-1] - sums[at]), anchor[-1]
        if held:
            yield shard(held)

    return run, schema


def _windows(window: int):
    """The windows of classes with a hash of each."""

    def one(batch):
        t, data, start, end, n = _read([batch])
        flat = slice_hashes(data, start, end)
        size = n + window - 1
        begin = np.cumsum(size) - size
        row, i = np.repeat(np.arange(len(n)), n), ragged(np.zeros(len(n), np.int64), n)
        key = gram_hashes(flat, window).view(np.int64)[ragged(begin, n)] if len(n) else i
        yield {**{c: t[c].take(pa.array(row)) for c in ("anchor", "digest", "place")}, "i": i.astype(np.int32), "key": key}

    return one


def _pick(window: int):
    """Some windows of classes as classes of one window."""

    def one(batch):
        asked = batch.column("asked")
        _, data, start, end, n = _read([batch])
        size = n + window - 1
        row, x = np.repeat(np.arange(len(n)), asked.value_lengths().to_numpy(zero_copy_only=False)), asked.flatten()
        k = len(row)
        begin = (np.cumsum(size) - size)[row] + x.field("i").to_numpy()
        yield {"anchor": x.field("key"), "digest": batch.column("anchor").take(pa.array(row)), "place": x.field("side"), "n_windows": np.ones(k, np.int32), "words": _slices(data, start[begin], end[begin + window - 1])}

    return one


def repeated_windows(keyed: DataFrame, window: int, shard_words: int = 1 << 19, most_classes: int = 4096) -> DataFrame:
    """(key, first, mask): bit ``i`` of mask is set if window ``first + i`` starts elsewhere too.

    ``keyed`` has key long and text; rows with one key must have one text.  The
    index of a shard holds about ``shard_words`` words, and one anchor's classes
    more.  Anchors of more than ``most_classes`` classes are split: their windows
    are grouped by hash, and one of each repeated group is indexed.  Segments are
    told apart by 64-bit digests within an anchor.
    """
    texts = keyed.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    occ = written(per_batch(keyed.select("key", "text"), _segments(window, GRAM), SEGMENT), "segments")
    again = written(occ.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    seg = written(occ.join(again, "anchor"), "segments")
    dropped(occ, again)
    ends = F.struct("key", "first", "n_windows")
    two = seg.groupBy("anchor", "digest").agg(F.min(ends).alias("x"), F.max(ends).alias("y"))
    classes = written(two.select("anchor", "digest", F.posexplode(F.array_distinct(F.array("x", "y"))).alias("place", "x")).select("anchor", "digest", "place", "x.*"), "classes")
    many = written(classes.where("place = 0").groupBy("anchor").agg(F.count("*").alias("c")).where(F.col("c") > most_classes).select("anchor"), "anchors")

    def taken(some: DataFrame) -> DataFrame:
        asked = some.groupBy("key").agg(F.collect_list(F.struct("first", "n_windows", "anchor", "digest", "place")).alias("asked"))
        return per_batch(texts.join(asked, "key").select("text", "copies", "asked"), _extract(window), CLASS)

    def found(some: DataFrame) -> DataFrame:
        run, schema = _search(window, shard_words)
        return some.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, schema)

    masks = found(taken(classes.join(many, "anchor", "left_anti")))
    hot = written(taken(classes.join(many, "anchor")), "classes")
    single = written(per_batch(hot, _windows(window), "anchor long, digest long, place int, i int, key long"), "windows")
    place = F.struct("digest", "place", "i")
    group = single.groupBy("anchor", "key").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y")
    sides = group.select("anchor", "key", F.posexplode(F.array("x", "y")).alias("side", "x")).select("anchor", "key", "side", "x.*")
    picked = sides.groupBy("anchor", "digest", "place").agg(F.collect_list(F.struct("key", "i", "side")).alias("asked"))
    hits = found(per_batch(hot.join(picked, ["anchor", "digest", "place"]).select("anchor", "n_windows", "words", "asked"), _pick(window), CLASS)).select(F.col("anchor").alias("key"), F.col("digest").alias("anchor"))
    split = single.join(hits, ["anchor", "key"]).groupBy("anchor", "digest").agg(F.bit_or(F.expr("shiftleft(1, i)")).alias("mask"))
    return seg.join(masks.unionByName(split), ["anchor", "digest"]).select("key", "first", "mask")


def _strip(window: int, plain: bool):
    def one(batch):
        data, offs = utf8(batch.column("text"))
        hits = batch.column("hits").to_pylist()
        others = [c for c in batch.schema.names if c not in ("text", "hits")]
        for lo, hi in pieces(offs):
            d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            start, end, by_row = words(d, o)
            n = np.diff(by_row)
            gone = np.zeros(len(start), bool)
            for r in range(hi - lo):
                if hits[lo + r]:
                    starts = np.array([x["first"] + i for x in hits[lo + r] for i in range(x["mask"].bit_length()) if x["mask"] >> i & 1])
                    step = np.zeros(n[r] + 1, np.int32)
                    np.add.at(step, starts, 1)
                    np.add.at(step, starts + window, -1)
                    gone[by_row[r] : by_row[r + 1]] = np.cumsum(step)[:-1] > 0
            kept, blob = [], d.tobytes()
            left = ~gone
            cut = np.concatenate([[0], np.cumsum(gone)])
            for r in range(hi - lo):
                a, b = by_row[r], by_row[r + 1]
                if not plain:
                    kept.append(_without(d[o[r] : o[r + 1]], np.append(start[a:b], o[r + 1]) - o[r], gone[a:b]) if cut[b] > cut[a] else blob[o[r] : o[r + 1]].decode())
                    continue
                pick = np.flatnonzero(left[a:b]) + a if cut[b] > cut[a] else range(a, b)
                kept.append(b" ".join([blob[x:y] for x, y in zip(start[pick].tolist(), end[pick].tolist(), strict=True)]).decode() if len(pick) else "")
            yield {"n_words": n, "n_removed": cut[by_row[1:]] - cut[by_row[:-1]], "kept": kept, **{c: batch.column(c).slice(lo, hi - lo) for c in others}}

    return one


def _without(text: np.ndarray, edge: np.ndarray, gone: np.ndarray) -> str:
    """The text without those words and the white space after them."""
    step = np.zeros(len(text) + 1, np.int32)
    np.add.at(step, edge[:-1][gone], 1)
    np.add.at(step, edge[1:][gone], -1)
    return text[np.cumsum(step)[:-1] == 0].tobytes().decode()


def remove_repeats(docs: DataFrame, window: int = 35, plain: bool = True, carry: list[str] | None = None) -> DataFrame:
    """Rows of ``docs``: doc_id, n_words, n_removed, kept and a struct ``carried`` of the columns in ``carry``.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A word goes if a window of ``window``
    words that covers it also starts in another place of any text, its own
    included; kept has the others, joined by one space.  A null text has no
    words; an empty table gives no rows; repeated rows count as texts of their
    own, so all their windows repeat.  If not
    ``plain``, kept is the text without the removed words and the white space
    after each.
    """
    carried = F.struct(*[docs[c] for c in carry or ["doc_id"]])
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"), *([carried.alias("carried")] if carry else []))
    hits = repeated_windows(keyed, window).groupBy("key").agg(F.collect_list(F.struct("first", "mask")).alias("hits"))
    also = [c for c in keyed.columns if c == "carried"]
    schema = "doc_id long, n_words long, n_removed long, kept string" + "".join(f", carried {dict(keyed.dtypes)[c]}" for c in also)
    return per_batch(keyed.join(hits, "key", "left").select("doc_id", "text", "hits", *also), _strip(window, plain), schema)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that stand elsewhere too."""
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
