"""Document fingerprints by content-defined chunking.

Boundaries are where a gear hash of the last 16 bytes has zeros under a mask; the
mask is stricter before the normal chunk size than after it (normalised
chunking), with a least and a greatest size.  A fingerprint is the set of chunk
digests with the bytes each covers, so text that moves keeps its chunks, and the
containment of one fingerprint in another is the share of its bytes whose chunks
the other has.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, as_batch, table
from .kernels import BYTE_VALUE

LEAST, NORMAL, MOST, WINDOW = 24, 64, 256, 16
_GEAR = (BYTE_VALUE >> np.uint64(32)).astype(np.uint32)
_STRICT, _LOOSE = np.uint32(0xFE000000), np.uint32(0xF8000000)


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash of the 16 bytes up to each, by doubling."""
    h, w = _GEAR[data], 1
    while w < WINDOW:
        out = h.copy()
        out[w:] += h[:-w] << np.uint32(w)
        h, w = out, w * 2
    return h


def chunks(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a text's bytes."""
    n = len(data)
    h = gear(data)
    loose = np.flatnonzero((h & _LOOSE) == 0)
    strict = loose[(h[loose] & _STRICT) == 0].tolist()
    loose = loose.tolist()
    ends, at = [], 0
    while n - at > LEAST:
        k = bisect_left(strict, at + LEAST - 1)
        if k < len(strict) and strict[k] < at + NORMAL:
            end = strict[k] + 1
        else:
            k = bisect_left(loose, at + NORMAL)
            end = loose[k] + 1 if k < len(loose) and loose[k] < at + MOST else at + MOST
        if end >= n:
            break
        ends.append(end)
        at = end
    if n:
        ends.append(n)
    return ends


def digests(text: bytes) -> dict[int, int]:
    """Bytes covered by chunk digest."""
    out: dict[int, int] = {}
    at = 0
    for end in chunks(np.frombuffer(text, np.uint8)):
        d = xxhash.xxh3_64_intdigest(text[at:end]) >> 16
        out[d] = out.get(d, 0) + end - at
        at = end
    return out


def as_string(found: dict[int, int]) -> str:
    """Digests of 12 hex digits with the bytes they cover, ordered."""
    return ",".join([f"{d:012x}:{found[d]:x}" for d in sorted(found)])


def from_string(s: str) -> dict[int, int]:
    return {int(x[:12], 16): int(x[13:], 16) for x in s.split(",")} if s else {}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of ``a``'s bytes in chunks that ``b`` has; 1 if both are empty, 0 if one is."""
    if not a or not b:
        return float(not a and not b)
    return sum(min(n, b[d]) for d, n in a.items() if d in b) / sum(a.values())


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _prints() -> tuple:
    to = arrow_schema(ROW)

    def row(doc_id, text, own, next_text, next_own):
        n = len(text)
        half = n // 2
        edited = (text[: n - half] + next_text[:half]).encode()
        other = digests(edited)
        return doc_id, n, hashlib.sha256(edited).hexdigest(), as_string(own), as_string(other), containment(own, other), containment(own, next_own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            rows, held = [], 0
            for slot, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("slot", "guest", "doc_id", "text")), strict=True):
                own = digests(text.encode())
                if last is not None and last[0] == slot:
                    rows.append(row(last[1], last[2], last[3], text, own))
                    held += len(text)
                last = None if guest else (slot, doc_id, text, own)
                if held > 1 << 22:
                    yield as_batch(dict(zip(to.names, zip(*rows), strict=True)), to)
                    rows, held = [], 0
            if rows:
                yield as_batch(dict(zip(to.names, zip(*rows), strict=True)), to)

    return run, ROW


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every row of ``docs`` (doc_id, text) and its edited text.

    The next document is the following one in descending (doc_id, hash of text), the
    last one's is the first; a single document is its own next.  A null text is
    empty, a null doc_id comes last, rows that repeat are neighbours.  Ids are
    cut into ranges of like size; the first row of a range also follows the range
    above as a guest, so each task sees whole neighbourhoods and no text moves
    more than once.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("double").alias("place"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions")) * 2
    cuts = sorted(set(d.approxQuantile("place", [k / ranges for k in range(1, ranges)], 0.2 / ranges)))
    d = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="place", outputCol="bucket").transform(d) if cuts else d.withColumn("bucket", F.lit(0.0))
    d = d.withColumn("slot", -F.col("bucket").cast("int"))
    order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), F.xxhash64("text"))
    #: One row for each range: its first row in descending order, and the slot above; the very first is guest of the last one.
    firsts = d.groupBy("slot").agg(F.max(order).alias("first"))
    above = F.coalesce(F.lag("slot").over(Window.orderBy("slot")), F.max("slot").over(Window.partitionBy(F.lit(0))))
    lead = F.broadcast(firsts.select(F.col("slot").alias("of"), "first", above.alias("above")))
    guests = d.join(lead, (F.col("slot") == F.col("of")) & (order == F.col("first"))).dropDuplicates(["slot"]).select(F.col("above").alias("slot"), F.lit(True).alias("guest"), "doc_id", "text")
    rows = d.select("slot", F.lit(False).alias("guest"), "doc_id", "text").unionByName(guests)
    run, schema = _prints()
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    dealt = rows.withColumn("o1", key).withColumn("o2", F.xxhash64("text")).repartition("slot").sortWithinPartitions("slot", "guest", F.desc("o1"), F.desc("o2"))
    return dealt.select("slot", "guest", "doc_id", "text").mapInArrow(run, schema)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and that of its edited text."""
    return fingerprints(table(spark, sf_dir, "documents"))
