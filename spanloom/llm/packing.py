"""Best-fit packing of token pieces into fixed-length sequences.

Bounded-space online best-fit: a task keeps at most ``open_bins`` open bins, in
a bitset keyed by free space.  An item goes to the bin with the least free
space that holds it; when there are too many open bins the fullest closes.
Bins still open at a task's end are items of the next round, in which bins of
``fan_in`` tasks meet, until one task has the rest, so no task ever holds more
than a bounded number of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, as_batch, table, written
from .kernels import pieces as ranges
from .kernels import utf8

#: Id that ends each document.
END_ID = 0


class OpenBins:
    """Open bins by free space: a bitset of the levels in use and a stack for each."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.count, self.bits = capacity, most, 0, 0
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def take(self, size: int) -> tuple[int, int]:
        """The fullest open bin that holds ``size`` and its free space, or (-1, capacity)."""
        fit = self.bits >> size
        if not fit:
            return -1, self.capacity
        free = size + ((fit & -fit).bit_length() - 1)
        stack = self.at[free]
        bin_ = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.count -= 1
        return bin_, free

    def put(self, bin_: int, free: int) -> None:
        """Keep the bin open; a full one closes, and the fullest one if there are too many."""
        if not free:
            return
        self.at[free].append(bin_)
        self.bits |= 1 << free
        self.count += 1
        if self.count > self.most:
            least = (self.bits & -self.bits).bit_length() - 1
            self.at[least].pop(0)
            if not self.at[least]:
                self.bits ^= 1 << least
            self.count -= 1

    def left(self) -> list[tuple[int, int]]:
        return [(b, free) for free, stack in enumerate(self.at) for b in stack]


def load_tokenizer(path: str | None = None):
    """A text's ids under the byte-level BPE; ``path`` is its ranks file's.  The end mark's string is its own id."""
    import base64

    import public_tokenizers
    import tiktoken

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = "<|endoftext|>"
    enc = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={special: len(ranks)})
    return lambda t: enc.encode(t, allowed_special="all") if special in t else enc.encode_ordinary(t)


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, bin long, offset long, free int"


def _pack_task(ids_of, capacity: int, open_bins: int):
    to = arrow_schema(PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = ids_of()
        task = TaskContext.get().partitionId()
        bins, made = OpenBins(capacity, open_bins), 0
        for batch in batches:
            text = batch.column("text")
            ids = batch.column("doc_id").to_pylist()
            _, offs = utf8(text)
            for lo, hi in ranges(offs, 4 << 20):
                rows: list[tuple] = []
                for k, t in enumerate(text.slice(lo, hi - lo).to_pylist()):
                    a = np.array([*encode(t or ""), END_ID], dtype="<u4")
                    n = len(a)
                    head = n % capacity or capacity
                    at = 0
                    for p in range((n + capacity - 1) // capacity):
                        size = head if p == 0 else capacity
                        bin_, free = bins.take(size)
                        if bin_ < 0:
                            bin_, made = made, made + 1
                        bins.put(bin_, free - size)
                        rows.append((ids[lo + k], p, at, size, zlib.crc32(a[at : at + size].tobytes()), task, bin_, capacity - free, 0))
                        at += size
                if rows:
                    yield as_batch(dict(zip(to.names, map(list, zip(*rows)), strict=True)), to)
        left = bins.left()
        if left:
            b, f = map(list, zip(*left))
            m = len(b)
            yield as_batch({"doc_id": [None] * m, "piece": [-1] * m, "start": [0] * m, "length": [capacity - x for x in f], "ids_crc32": [0] * m, "task": [task] * m, "bin": b, "offset": [0] * m, "free": f}, to)

    return run


def _merge_task(capacity: int, open_bins: int, group: int):
    """Bins as items: (task, bin, length) rows of one group, the longest first."""
    schema = "task int, bin long, length long, to_task int, to_bin long, shift long, left_over boolean"
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bins, made, used = None, None, 0, {}

        def rest():
            left = bins.left()
            m = len(left)
            return as_batch({"task": [now] * m, "bin": [b for b, _ in left], "length": [capacity - f for _, f in left], "to_task": [now] * m, "to_bin": [b for b, _ in left], "shift": [0] * m, "left_over": [True] * m}, to)

        for batch in batches:
            rows = []
            for t, b, n in zip(*(batch.column(c).to_pylist() for c in ("task", "bin", "length")), strict=True):
                g = t // group
                if g != now:
                    if bins is not None:
                        if rows:
                            yield as_batch(dict(zip(to.names, map(list, zip(*rows)), strict=True)), to)
                            rows = []
                        yield rest()
                    now, bins, made = g, OpenBins(capacity, open_bins), 0
                bin_, free = bins.take(n)
                if bin_ < 0:
                    bin_, made = made, made + 1
                bins.put(bin_, free - n)
                rows.append((t, b, n, g, bin_, capacity - free, False))
            if rows:
                yield as_batch(dict(zip(to.names, map(list, zip(*rows)), strict=True)), to)
        if bins is not None:
            yield rest()

    return run, schema


def pack_documents(docs: DataFrame, capacity: int = 2048, open_bins: int = 1024, fan_in: int = 64, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are its tokens and id 0; a null or empty text has id 0
    alone.  Only documents of more than ``capacity`` ids are cut: the first
    piece takes the remainder, so all others fill a sequence.  Equal documents
    and equal doc_ids are packed one by one, each row of the input once.  An
    empty table gives no rows; further columns of ``docs`` are ignored.
    ``tokenizer`` is the path of a ranks file.

    No ids are shuffled: a task tokenises and packs its rows, only bins that
    are still open at its end move on.
    """
    rows = docs.select("doc_id", "text").mapInArrow(_pack_task(lambda: load_tokenizer(tokenizer), capacity, open_bins), PIECE)
    rows = written(rows, "packed")
    items = rows.where("piece < 0").select("task", "bin", "length")
    moved = rows.where("piece >= 0").select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).alias("level"), "task", "bin", "offset")
    tasks, level = (items.agg(F.max("task")).first()[0] or 0) + 1, 0
    while True:
        groups = (tasks + fan_in - 1) // fan_in
        run, schema = _merge_task(capacity, open_bins * 4, fan_in)
        dealt = items.withColumn("g", F.expr(f"task div {fan_in}")).repartition(groups, "g").sortWithinPartitions("g", F.desc("length"), "task", "bin").select("task", "bin", "length")
        step = written(dealt.mapInArrow(run, schema), "bins")
        to = step.where("not left_over").select("task", "bin", "to_task", "to_bin", "shift")
        moved = _follow(moved, to, level)
        if groups <= 1:
            break
        items, tasks, level = step.where("left_over").select("task", "bin", "length"), groups, level + 1
    #: Level, task and bin number a sequence: 12, 25 and 26 bits.
    sequence = F.col("level").cast("long") * (1 << 51) + F.col("task").cast("long") * (1 << 26) + F.col("bin")
    return moved.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset")


def _follow(moved: DataFrame, to: DataFrame, level: int) -> DataFrame:
    """Give pieces whose bin moved at ``level`` their new place."""
    to = to.withColumn("on", F.lit(level))
    j = moved.join(to, (moved.task == to.task) & (moved.bin == to.bin) & (moved.level == to.on), "left")
    return j.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.when(F.col("to_bin").isNull(), F.col("level")).otherwise(level + 1).alias("level"),
        F.coalesce(F.col("to_task"), moved.task).alias("task"), F.coalesce(F.col("to_bin"), moved.bin).alias("bin"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces packed into sequences."""
    return pack_documents(table(spark, sf_dir, "documents"))
