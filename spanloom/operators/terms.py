"""Terms of a table in texts: whole words, all of them or the longest from the left.

A dictionary of a checked size is broadcast as an automaton, which goes through
each text once whatever the number of terms.  A larger one is joined: texts are
cut into windows of as many words as terms have, which meet the terms by
equality.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOUND = "doc_id long, term string, start int, end int"
#: A word's characters.
WORD = r"[\p{L}\p{N}_]+"


def _inside(c: str) -> bool:
    return c.isalnum() or c == "_"


def whole_words(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, term) of all terms that begin and end where words do, by start."""
    out = []
    for last, term in automaton.iter(text):
        start, end = last + 1 - len(term), last + 1
        if (start == 0 or not _inside(text[start - 1])) and (end == len(text) or not _inside(text[end])):
            out.append((start, end, term))
    return sorted(out)


def longest_first(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """From the left, at each place the longest term, then on behind it."""
    out: list[tuple[int, int, str]] = []
    for s in sorted(found, key=lambda s: (s[0], -s[1])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def by_automaton(docs: DataFrame, terms: list[str], longest: bool) -> DataFrame:
    automaton = ahocorasick.Automaton()
    for t in terms:
        automaton.add_word(t, t)
    automaton.make_automaton()
    shared = docs.sparkSession.sparkContext.broadcast(automaton if terms else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = whole_words(t, own) if t and own is not None else []
                rows += [(i, term, a, b) for a, b, term in (longest_first(found) if longest else found)]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "term", "start", "end"])

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)


def by_join(docs: DataFrame, terms: DataFrame, longest: bool) -> DataFrame:
    """As ``by_automaton`` for terms that begin and end with a word's characters, with the terms as a table.

    Terms are told apart by how many words they hold; windows of so many words
    are cut from the texts and joined on their SHA-256.
    """
    size = F.size(F.regexp_extract_all("term", F.lit(WORD), 0))
    listed = terms.select("term").where("term is not null").distinct().withColumn("n", size)
    sizes = sorted(r.n for r in listed.select("n").distinct().collect() if r.n)
    schema = "doc_id long, n int, start int, end int, h binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import regex

        word = regex.compile(WORD)
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "n", "start", "end", "h"])

        rows: list = []
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                at = [m.span() for m in word.finditer(t or "")]
                for n in sizes:
                    for k in range(len(at) - n + 1):
                        a, b = at[k][0], at[k + n - 1][1]
                        rows.append((i, n, a, b, hashlib.sha256(t[a:b].encode()).digest()))
                        if len(rows) >= 1 << 16:
                            yield out(rows)
                            rows = []
        if rows:
            yield out(rows)

    known = listed.select("term", "n", F.unhex(F.sha2(F.encode("term", "UTF-8"), 256)).alias("h"))
    found = docs.select("doc_id", "text").mapInArrow(run, schema).join(known, ["n", "h"]).select("doc_id", "term", "start", "end")
    if not longest:
        return found
    one = "array<struct<start:int,end:int,term:string>>"

    @F.arrow_udf(one)
    def kept(lists: pa.Array) -> pa.Array:
        rows = [longest_first([(x["start"], x["end"], x["term"]) for x in v]) for v in lists.to_pylist()]
        return pa.array([[{"start": a, "end": b, "term": t} for a, b, t in r] for r in rows], lists.type)

    listed = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "term")).cast(one).alias("s"))
    return listed.select("doc_id", F.inline(kept("s"))).select("doc_id", "term", "start", "end")


def find_terms(docs: DataFrame, terms: DataFrame, longest: bool = True, most_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, term, start, end of the terms of a table (column term) in texts, as whole words.

    ``longest``: from the left, at each place the longest, without overlap; else
    all.  Terms whose bytes add up to at most ``most_bytes`` are broadcast, more
    are joined.  Null and empty terms are left out, as are those that don't begin
    and end with a word's character; null texts hold none.
    """
    sound = terms.select("term").where(F.col("term").rlike(rf"^{WORD}(?s:.*[\p{{L}}\p{{N}}_])?$")).distinct()
    size = sound.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()[0]
    if size <= most_bytes:
        return by_automaton(docs, [r.term for r in sound.collect()], longest)
    return by_join(docs, sound, longest)
