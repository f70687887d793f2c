"""Token counts by a linear longest-match automaton over word pieces.

The vocabulary lies in two tries: pieces that begin a word and pieces that continue one. A node from which
no edge leads on has a failure link: the node reached after the pieces that greedy longest-match would have cut off by
then. Only how many pieces that link pops is kept, so a word is counted in time linear in its bytes and no piece is ever built.
A word that can't be cut into pieces counts as one unknown token. A byte-level vocabulary leaves none: see ``pieces_of_ranks``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, text_frame
from .merge_replay import read_ranks

_AUTOMATA: dict[str, "LongestMatch"] = {}


class LongestMatch:
    def __init__(self, initial: list[bytes], following: list[bytes], remember: int = 400_000, longest: int = 64):
        """``initial``: pieces that begin a word; ``following``: pieces that continue one."""
        self.edges: dict[int, int] = {}  # node * 256 + byte
        self.n = 2  # node 0 begins a word, node 1 continues it
        self.remember, self.longest = remember, longest
        self.known: dict[bytes, int] = {}
        ends = set()
        for root, pieces in ((0, initial), (1, following)):
            for piece in pieces:
                u = root
                for b in piece:
                    v = self.edges.get(u * 256 + b)
                    if v is None:
                        v = self.edges[u * 256 + b] = self.n
                        self.n += 1
                    u = v
                if u > 1:
                    ends.add(u)
        self._link(ends)

    def _link(self, ends: set[int]) -> None:
        """Failure links, shortest strings first; -1 stands for none."""
        self.fail, self.pops = [-1] * self.n, [0] * self.n
        children: dict[int, list[tuple[int, int]]] = {}
        for key, v in self.edges.items():
            children.setdefault(key >> 8, []).append((key & 255, v))
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for b, v in children.get(u, ()):
                queue.append(v)
                if v in ends:
                    self.fail[v], self.pops[v] = 1, 1
                    continue
                z, popped = self.fail[u], self.pops[u]
                while z >= 0 and z * 256 + b not in self.edges:
                    popped += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.edges[z * 256 + b], popped

    def count(self, word: bytes) -> int:
        """The number of pieces; -1 if the word can't be cut."""
        edges, fail, pops, u, n = self.edges, self.fail, self.pops, 0, 0
        for b in word:
            while (v := edges.get(u * 256 + b)) is None:
                if fail[u] < 0:
                    return -1
                n += pops[u]
                u = fail[u]
            u = v
        while u > 1:
            if fail[u] < 0:
                return -1
            n += pops[u]
            u = fail[u]
        return n

    def texts(self, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """Of each text: words, tokens, unknown words."""
        if len(self.known) > self.remember:
            self.known.clear()
        split = [t.split() for t in texts]  # of bytes, this splits at ASCII blanks only
        missing = list(set().union(*split).difference(self.known))
        self.known.update((w, self.count(w)) for w in missing)
        for words in split:
            counts = [self.known[w] for w in words]
            unknown = counts.count(-1)
            yield len(words), sum(counts) + 2 * unknown, unknown
        for w in missing:
            if len(w) > self.longest:
                del self.known[w]


def pieces_of_ranks(path: str) -> tuple[list[bytes], list[bytes]]:
    """Word pieces from a byte-level vocabulary: those that begin a word, and those that continue one.

    What follows a leading blank in the vocabulary begins a word. A word that none of these begins (in scripts that the vocabulary knows
    without a blank only) begins with a following piece: so one that has no beginning piece as its own beginning is among both.
    Every byte is a following piece, and every word can be cut.
    """
    vocabulary = read_ranks(path)
    initial = {t[1:] for t in vocabulary if t[:1] == b" " and len(t.split()) == 1 and len(t.split()[0]) == len(t) - 1}
    following = [t for t in vocabulary if len(t.split()) == 1 and len(t.split()[0]) == len(t)]
    also = [t for t in following if not any(t[:k] in initial for k in range(1, len(t) + 1))]
    return [*initial, *also], following


def automaton(path: str) -> LongestMatch:
    if path not in _AUTOMATA:
        _AUTOMATA[path] = LongestMatch(*pieces_of_ranks(path))
    return _AUTOMATA[path]


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of every whole text.

    One row per row of the input, repeated ones and null identifiers too; a count depends on its own text alone, so nothing can tie.
    Null and empty texts have no words and no tokens. A word of any length is counted whole. An empty table gives an empty result;
    other columns are ignored, whatever they are called.
    """
    small_batches(docs.sparkSession, 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = automaton(vocabulary_path)
        for batch in batches:
            rows = list(match.texts(batch.column(1).to_pylist()))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), pa.int64()) for c in cols)], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return text_frame(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
