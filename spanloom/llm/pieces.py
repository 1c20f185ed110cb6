"""SentencePiece encoding and decoding of a unigram model.

Pieces with log scores stand in a double-array trie over bytes.  Texts are cut
before each run of white-space markers, where no piece can cross, and the Viterbi
search runs over all different cuts of a batch side by side, one byte position
after another.  Long strings without markers are cut too, where no piece that
stands in them spans, which changes no best way.  A character without a piece costs the unknown score and falls
back to its bytes' pieces.
"""

from __future__ import annotations

import functools
import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, as_batch, table
from .kernels import pieces as ranges
from .kernels import ragged, slice_hashes, utf8

MARK = "▁"
#: Longer strings are cut before the search.
LONG = 64


class DoubleArray:
    """A byte trie in two arrays: the child of state s by byte c is base[s] + c if check there is s."""

    def __init__(self, keys: list[bytes]):
        root: dict = {}
        for k, key in enumerate(keys):
            node = root
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = k
        base, check, value = [0], [-1], [-1]
        free, queue = 1, [(0, root)]

        def grow(n: int) -> None:
            more = n - len(base)
            if more > 0:
                base.extend([0] * more)
                check.extend([-1] * more)
                value.extend([-1] * more)

        for state, node in queue:
            kids = sorted(c for c in node if c >= 0)
            value[state] = node.get(-1, -1)
            if not kids:
                continue
            #: A single child takes the first gap, several together the end of the array.
            if len(kids) == 1:
                while free < len(base) and check[free] >= 0 or free <= kids[0]:
                    free += 1
                b = free - kids[0]
            else:
                b = max(1, len(base) - kids[0])
            grow(b + kids[-1] + 1)
            base[state] = b
            for c in kids:
                check[b + c] = state
                queue.append((b + c, node[c]))
        self.base, self.check, self.value = (np.array(x + [fill] * 256, np.int32) for x, fill in ((base, 0), (check, -1), (value, -1)))


class Pieces:
    """A model: pieces, scores and what becomes of unknown characters."""

    def __init__(self, names: list[str], scores: list[float], normal: list[bool], byte_ids: dict[int, int], unknown: int):
        self.names, self.byte_ids, self.unknown = names, byte_ids, unknown
        ids = [k for k, n in enumerate(normal) if n]
        self.ids = np.array(ids, np.int32)
        self.scores = np.array([scores[k] for k in ids], np.float64)
        self.trie = DoubleArray([names[k].replace(MARK, " ").encode() for k in ids])
        self.unknown_score = float(self.scores.min() - 10)
        inner = [names[k] for k in ids if MARK in names[k].lstrip(MARK)]
        if inner:
            raise ValueError(f"{len(inner)} pieces have a marker after other characters; texts can't be cut before markers")
        out = [n.replace(MARK, " ").encode() for n in names]
        for b, k in byte_ids.items():
            out[k] = bytes([b])
        self.length = np.array([len(x) for x in out])
        self.begin = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(out), np.uint8)

    @classmethod
    def load(cls, path: str | None = None) -> Pieces:
        """The model of a file, built once in each driver."""
        import public_tokenizers

        path = path or public_tokenizers.path("piece_bpe_32k.model")
        state = os.stat(path)
        return cls._built(path, state.st_mtime_ns, state.st_size)

    @classmethod
    @functools.lru_cache(maxsize=4)
    def _built(cls, path: str, changed: int, size: int) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(sp.get_piece_size())
        names = [sp.id_to_piece(k) for k in n]
        special = [sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) for k in n]
        return cls(names, [sp.get_score(k) for k in n], [not s for s in special], {int(names[k][3:5], 16): k for k in n if sp.is_byte(k)}, sp.unk_id())

    def search(self, rows: np.ndarray, size: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Viterbi for byte strings padded into ``rows``: (ids, lengths) joined, row by row."""
        n, width = rows.shape
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0
        back, piece = np.zeros((width + 1, n), np.int32), np.full((width + 1, n), -1, np.int32)
        t = self.trie
        lead = (rows & 0xC0) != 0x80
        for i in range(width):
            on = np.flatnonzero((size > i) & lead[:, i] & (best[i] > -np.inf))
            if not len(on):
                continue
            state, score = np.zeros(len(on), np.int32), best[i][on]
            c = rows[on, i]
            span = np.where(c < 0x80, 1, np.where(c < 0xE0, 2, np.where(c < 0xF0, 3, 4)))
            covered = np.zeros(n, bool)
            k, live = i, on
            while len(live) and k < width:
                nxt = t.base[state] + rows[live, k]
                ok = (t.check[np.minimum(nxt, len(t.check) - 1)] == state) & (t.base[state] > 0) & (size[live] > k)
                live, state, score = live[ok], nxt[ok], score[ok]
                k += 1
                v = t.value[state]
                end = np.flatnonzero(v >= 0)
                if len(end):
                    r, p = live[end], v[end]
                    s = score[end] + self.scores[p]
                    up = s > best[k][r]
                    best[k][r[up]], back[k][r[up]], piece[k][r[up]] = s[up], i, self.ids[p[up]]
                    one = np.zeros(n, np.int32)
                    one[on] = span
                    covered[r[one[r] == k - i]] = True
            bare = ~covered[on]
            for w in np.unique(span[bare]):
                r = on[bare & (span == w)]
                s = best[i][r] + self.unknown_score
                j = min(i + int(w), width)
                up = s > best[j][r]
                best[j][r[up]], back[j][r[up]], piece[j][r[up]] = s[up], i, -1
        return best, back, piece

    def matches(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and number of every piece that stands in ``data``, all starts walked side by side."""
        t, n = self.trie, len(data)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        state, k, out = np.zeros(len(at), np.int32), 0, []
        while True:
            inside = at + k < n
            at, state = at[inside], state[inside]
            nxt = t.base[state] + data[at + k]
            ok = (t.check[np.minimum(nxt, len(t.check) - 1)] == state) & (t.base[state] > 0)
            at, state = at[ok], nxt[ok]
            if not len(at):
                break
            k += 1
            v = t.value[state]
            end = np.flatnonzero(v >= 0)
            out.append((at[end], at[end] + k, v[end]))
        return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((), (), ())))

    def safe_cuts(self, data: np.ndarray) -> np.ndarray:
        """Places between characters that no piece of several characters spans: the best ways to both sides are independent."""
        begin, end, _ = self.matches(data)
        depth = np.zeros(len(data) + 1, np.int64)
        np.add.at(depth, begin + 1, 1)
        np.add.at(depth, end, -1)
        lead = np.append((data & 0xC0) != 0x80, True)
        return np.flatnonzero((np.cumsum(depth) <= 0) & lead)

    def one_by_one(self, data: np.ndarray) -> list[int]:
        """Ids of one long string by the same Viterbi search over its matches, place after place."""
        n, (begin, end, which) = len(data), self.matches(data)
        order = np.lexsort((begin, end))
        begin, end, which = begin[order].tolist(), end[order].tolist(), which[order].tolist()
        best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0], k, scores = 0.0, 0, self.scores.tolist()
        lead = np.flatnonzero(np.append((data & 0xC0) != 0x80, True)).tolist()
        for i, j in zip(lead[:-1], lead[1:], strict=True):
            bare = True
            while k < len(end) and end[k] <= j:
                s = best[begin[k]] + scores[which[k]]
                if s > best[j]:
                    best[j], back[j], piece[j] = s, begin[k], int(self.ids[which[k]])
                bare &= begin[k] != i
                k += 1
            if bare and best[i] + self.unknown_score > best[j]:
                best[j], back[j], piece[j] = best[i] + self.unknown_score, i, -1
        return self._walk(data.tobytes(), n, back, piece)

    def _walk(self, raw: bytes, s: int, back: list[int], piece: list[int]) -> list[int]:
        ids: list[int] = []
        while s:
            if piece[s] >= 0:
                ids.append(piece[s])
            elif self.byte_ids:
                ids.extend(self.byte_ids[x] for x in reversed(raw[back[s] : s]))
            else:
                ids.append(self.unknown)
            s = back[s]
        return ids[::-1]

    def encode_strings(self, found: list[bytes]) -> list[list[int]]:
        """Ids of byte strings in which a space stands for the marker; long ones are cut where no piece spans."""
        parts, owner = [], []
        for k, raw in enumerate(found):
            if len(raw) <= LONG:
                parts.append(raw)
                owner.append(k)
                continue
            cuts = self.safe_cuts(np.frombuffer(raw, np.uint8)).tolist()
            parts.extend(raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
            owner.extend([k] * (len(cuts) - 1))
        out: list[list[int]] = [[] for _ in found]
        for k, ids in zip(owner, self._encode_parts(parts), strict=True):
            out[k].extend(ids)
        return out

    def _encode_parts(self, found: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in found]
        size = np.array([len(x) for x in found], np.int64)
        for k in np.flatnonzero(size > 16 * LONG).tolist():
            out[k] = self.one_by_one(np.frombuffer(found[k], np.uint8))
            size[k] = 0
        group = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
        for g in np.unique(group):
            at = np.flatnonzero((group == g) & (size > 0))
            if not len(at):
                continue
            step = max(1, (1 << 21) >> int(g))
            for lo in range(0, len(at), step):
                some = at[lo : lo + step]
                width = int(size[some].max())
                rows = np.zeros((len(some), width), np.uint8)
                seg = np.repeat(np.arange(len(some)), size[some])
                rows[seg, ragged(np.zeros(len(some), np.int64), size[some])] = np.frombuffer(b"".join([found[k] for k in some]), np.uint8)
                _, back, piece = self.search(rows, size[some])
                back, piece = back.T.tolist(), piece.T.tolist()
                for k, s, b, p in zip(some.tolist(), size[some].tolist(), back, piece, strict=True):
                    out[k] = self._walk(found[k], s, b, p)
        return out

    def encode_batch(self, data: np.ndarray, offsets: np.ndarray, known: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts joined, and offsets by text; an empty text has none, others get a leading marker."""
        n = np.diff(offsets)
        some = n > 0
        o = np.concatenate([[0], np.cumsum(n + some)])
        d = np.full(o[-1], 0x20, np.uint8)
        d[ragged(o[:-1] + some, n)] = data
        space, line = d == 0x20, d == 0x0A
        cut = np.zeros(len(d) + 1, bool)
        cut[o] = True
        cut[1:-1] |= (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        start = np.flatnonzero(cut[:-1]) if len(d) else np.zeros(0, np.int64)
        end = np.append(start[1:], len(d))
        u, first, inv = np.unique(slice_hashes(d, start, end), return_index=True, return_inverse=True)
        blob, keys = d.tobytes(), u.tolist()
        new = [k for k, h in enumerate(keys) if h not in known]
        for k, ids in zip(new, self.encode_strings([blob[start[first[k]] : end[first[k]]] for k in new]), strict=True):
            known[keys[k]] = ids
        lists = [known[h] for h in keys]
        size = np.array([len(x) for x in lists], np.int64)
        flat = np.fromiter((i for x in lists for i in x), np.int32, int(size.sum()))
        begin = np.cumsum(size) - size
        ids = flat[ragged(begin[inv], size[inv])]
        total = np.concatenate([[0], np.cumsum(size[inv])])
        return ids, total[np.searchsorted(start, o)]

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Texts of ids: pieces and bytes joined, markers as spaces, without the leading one."""
        n = self.length[ids]
        raw = self.flat[ragged(self.begin[ids], n)].tobytes()
        at = np.concatenate([[0], np.cumsum(n)])[offsets].tolist()
        return [raw[a + (b > a and raw[a] == 0x20) : b] for a, b in zip(at[:-1], at[1:], strict=True)]


def encode(docs: DataFrame, model: str | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_sha256, round_trip, ids) of every row.

    ids_crc32 is over little-endian unsigned 32-bit ids; decoded_sha256 and
    round_trip are of the text that the ids decode to.  A null text is encoded
    like an empty one, to no ids.  Rows that repeat are encoded each; an empty
    table gives no rows; other columns are ignored.  ``model`` is a file's path.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.load(model))
    schema = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    to = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = shared.value, {}
        for batch in batches:
            data, offs = utf8(batch.column("text"))
            for lo, hi in ranges(offs, 2 << 20):
                d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                ids, by = pieces.encode_batch(d, o, known)
                back, raw, u = pieces.decode_batch(ids, by), d.tobytes(), ids.astype("<u4")
                cols = {"doc_id": batch.column("doc_id").slice(lo, hi - lo), "n_tokens": np.diff(by), "ids_crc32": [zlib.crc32(u[a:b]) for a, b in zip(by[:-1], by[1:], strict=True)], "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in back], "round_trip": [x == raw[a:b] for x, a, b in zip(back, o[:-1], o[1:], strict=True)]}
                if with_ids:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(by, pa.int32()), pa.array(ids, pa.int32()))
                yield as_batch(cols, to)
                if len(known) > 1 << 19:
                    known.clear()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return encode(table(spark, sf_dir, "documents"), with_ids=False)
