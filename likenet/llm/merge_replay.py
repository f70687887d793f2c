"""Byte-level BPE encoding and decoding by replaying the merges over a corpus of words.

The distinct words of a batch lie behind each other in one array of symbols. An inverted index holds, for each
rank, the positions whose pair of neighbours merges at that rank. Ranks are taken in order from a heap; each position of a rank
is merged left to right, and only the two pairs beside the merged one are looked up again. Words never
touch each other, so the order is that of encoding each word by itself. If a merge opens a pair of a lower
rank, the positions that are left wait until that rank is done.

Such a corpus is what an Arrow batch of texts brings in words that aren't known yet, up to 50,000 of them, so its arrays have a bound. What has been
encoded is remembered over batches and partitions up to a bound, so a frequent word is encoded once and a text costs a lookup for each of its words.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_batches, text_frame

_CODERS: dict[tuple, "MergeReplay"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int], pattern: str, remember: int = 400_000, longest: int = 64):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.token = {i: t for t, i in ranks.items()}
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        self.remember, self.longest = remember, longest
        self.decimal = {i: str(i) for i in self.token}
        self.pairs: dict[int, int] = {}  # first id * 2**20 + second id
        # Of pairs of bytes; -1 stands for none.
        self.first = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int64)
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}  # what was known before known last began anew

    def _rank(self, a: int, b: int) -> int:
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        rank = self.pairs[a << 20 | b] = self.ranks.get(self.token[a] + self.token[b], -1)
        return rank

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        out: list = [[self.ranks[w]] if w in self.ranks else None for w in words]
        todo = [k for k, ids in enumerate(out) if ids is None]
        # A blank position (-1) before, between and after the words.
        blob = b"\0".join([b"", *(words[k] for k in todo), b""])
        lengths = np.array([len(words[k]) for k in todo], np.int64)
        starts = np.cumsum(lengths + 1) - lengths
        borders = np.concatenate([[0], starts + lengths]) if todo else np.array([0])
        raw = np.frombuffer(blob, np.uint8)
        symbols = np.array(self.byte_id, np.int64)[raw]
        symbols[borders] = -1
        rank = np.append(self.first[raw[:-1], raw[1:]], -1)
        rank[borders] = -1
        rank[borders[1:] - 1] = -1
        at = np.flatnonzero(rank >= 0)
        order = at[np.argsort(rank[at], kind="stable")]
        ranked = rank[order]
        cuts = np.flatnonzero(np.diff(ranked)) + 1
        index = {int(r[0]): p.tolist() for r, p in zip(np.split(ranked, cuts), np.split(order, cuts), strict=True)} if len(at) else {}
        # Of each position: its symbol (-1 at borders), the rank of the pair that begins there (-1 for none), its neighbours.
        sym, rank_at, n = symbols.tolist(), rank.tolist(), len(raw)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = sorted(index)
        rank_of, look, pop, push = self.pairs.get, self._rank, heapq.heappop, heapq.heappush
        while heap:
            r = pop(heap)
            positions = index.pop(r, None)
            if not positions:
                continue
            positions.sort()
            for p in positions:
                if rank_at[p] != r:
                    continue
                q = right[p]
                after, before = right[q], left[p]
                sym[p], rank_at[q] = r, -1
                right[p], left[after] = after, p
                lower, new = False, -1
                if (a := sym[before]) >= 0:
                    new = rank_of(a << 20 | r)
                    if new is None:
                        new = look(a, r)
                    rank_at[before] = new
                    if new >= 0:
                        try:
                            index[new].append(before)
                        except KeyError:
                            index[new] = [before]
                            push(heap, new)
                        lower = new < r
                new = -1
                if (b := sym[after]) >= 0:
                    new = rank_of(r << 20 | b)
                    if new is None:
                        new = look(r, b)
                    if new >= 0:
                        try:
                            index[new].append(p)
                        except KeyError:
                            index[new] = [p]
                            push(heap, new)
                        lower |= new < r
                rank_at[p] = new
                if lower:
                    if r not in index:
                        push(heap, r)
                    index.setdefault(r, []).extend(positions[bisect(positions, p) :])
                    break
        for k, p in zip(todo, starts.tolist(), strict=True):
            ids = []
            while sym[p] >= 0:
                ids.append(sym[p])
                p = right[p]
            out[k] = ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.token[i] for i in ids])

    def learn(self, words: list[str], at_once: int = 50_000) -> None:
        """Encode and remember words."""
        decimal = self.decimal.__getitem__
        for k in range(0, len(words), at_once):
            part = words[k : k + at_once]
            for w, ids in zip(part, self.replay([w.encode() for w in part]), strict=True):
                self.known[w] = " ".join(map(decimal, ids)).encode(), self.decode(ids)

    def texts(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """Of each text: the number of ids, the decimal ids joined by blanks, the decoded bytes."""
        split = [self.find(t) for t in texts]
        if len(self.known) > self.remember:
            self.known, self.old = {}, self.known
        missing = list(set().union(*split).difference(self.known))
        if self.old:
            self.known.update((w, self.old[w]) for w in missing if w in self.old)
            missing = [w for w in missing if w not in self.known]
        self.learn(missing)
        known = self.known.__getitem__
        for words in split:
            if not words:
                yield 0, b"", b""
                continue
            ids, data = zip(*map(known, words), strict=True)
            ids, data = b" ".join(ids), b"".join(data)
            yield ids.count(b" ") + 1, ids, data
        for w in missing:
            if len(w) > self.longest:
                del self.known[w]


def coder(path: str, pattern: str) -> MergeReplay:
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = MergeReplay(read_ranks(path), pattern)
    return _CODERS[path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded text, if asked for).

    One row per row of the input, repeated ones and null identifiers too; a row depends on its own text alone, so nothing can tie. Null text
    counts as empty; an empty text has no ids. A word of any length is encoded whole. An empty table gives an empty result; other columns
    are ignored, whatever they are called.
    """
    small_batches(docs.sparkSession, 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(ranks_path, pattern)
        for batch in batches:
            texts = [b.decode("utf-8", "replace") for b in batch.column(1).to_pylist()]
            rows = [(n, ids if with_ids else None, hashlib.sha256(ids).hexdigest(), data if with_ids else None, hashlib.sha256(data).hexdigest()) for n, ids, data in bpe.texts(texts)]
            n, ids, ids_sha, data, data_sha = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [], [])
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(data_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays += [pa.array([list(map(int, x.split())) for x in ids], pa.list_(pa.int32())), pa.array([x.decode() for x in data], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return text_frame(docs, id_col, text_col).mapInArrow(run, schema + (", ids array<int>, decoded string" if with_ids else ""))
