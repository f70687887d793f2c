"""Online packing by the sum-of-squares rule.

Documents become token ids and are packed, as they arrive, into windows of ``capacity`` tokens. A window that
is filled to level ``h`` counts in the level array entry ``N(h)``; a piece of ``s`` tokens goes where it keeps
the sum of squares of ``N(1) .. N(capacity - 1)`` least: into a window of level ``h``, which changes the sum by
``2 (N(h+s) - N(h)) + 2`` (or ``1 - 2 N(h)`` if it fills the window), or into a new one, by ``2 N(s) + 1``.
A document longer than a window first fills whole windows of its own; its rest is placed by the rule.

Every partition packs by itself, so there is no shuffle. At the end of a run (a partition's input, or ``run_ids`` ids held in
windows that aren't full, which bounds memory) the windows that are still open hold enough ids to fill the fullest of them. Those stay as the rule
filled them; the pieces of the others are placed again by the same rule, whole where a window takes them, and a
piece that none takes is cut to fill the window with the most room. What is left, less than a window, goes to windows whose
lengths are powers of two. So no sequence needs padding, and only what fills gaps is moved.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import MEMORIES, small_batches, text_frame, trimmed

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_TOKENIZERS: dict[str, "WordIds"] = {}
MEMORIES["packing"] = _TOKENIZERS


class WordIds:
    """Token ids of texts, as little-endian unsigned 32-bit words; remembers words.

    The tokenizer drops white space and no token spans it, so the ids of a text are those of its
    blank-separated words in turn. A word of lower-case Latin letters alone is one token or a run of tokens of which the last, and
    only that, carries the end-of-word mark: many of them go through the merges in one call, without the
    normaliser and splitter that they don't need, and are told apart by that mark. Punctuation after such a word is a token run of its own.
    """

    def __init__(self, path: str, remember: int = 600_000, longest: int = 40):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # They are found before the tokenizer lower-cases: a text with one in any case is left as it is.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        mark = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if mark and t.endswith(mark)]] = True
        self.remember, self.longest = remember, longest
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # what was known before known last began anew

    def _learn(self, words: list[str]) -> None:
        """Add the ids of words that aren't known."""
        rest, split, bare = set(), {}, set()
        for w in words:
            if w.isalpha() and (w.isascii() and w.islower() or _is_plain(w)):
                bare.add(w)
                continue
            core = w.rstrip(punctuation)
            if len(core) < len(w) and core.isalpha() and (core.isascii() and core.islower() or _is_plain(core)):
                tail = w[len(core) :]
                split[w] = core, tail
                if core not in self.known:
                    bare.add(core)
                if tail not in self.known:
                    rest.add(tail)
            else:
                rest.add(w)
        rest = list(rest)
        self.known.update((w, np.array(x.ids, "<u4").tobytes()) for w, x in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True))
        bare = list(bare)
        ids = np.array(self.plain.encode_batch_fast([" ".join(bare)], add_special_tokens=False)[0].ids, "<u4")
        cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
        blob = ids.tobytes()
        self.known.update(zip(bare, [blob[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
        self.known.update((w, self.known[core] + self.known[tail]) for w, (core, tail) in split.items())

    def __call__(self, texts: list[str], end_id: int | None) -> list[bytes]:
        split = [blank_split(t if any(x in low for x in self.special) else low) for t, low in ((t, _lower(t)) for t in texts)]
        if len(self.known) > self.remember:
            self.known, self.old = {}, self.known
        missing = list(set().union(*split).difference(self.known))
        if self.old:
            self.known.update((w, self.old[w]) for w in missing if w in self.old)
            missing = [w for w in missing if w not in self.known]
        self._learn(missing)
        known = self.known.__getitem__
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        out = [b"".join(map(known, words)) + end for words in split]
        for w in missing:
            if len(w) > self.longest:
                del self.known[w]
        return out


def _is_plain(word: str) -> bool:
    """Letters of Latin-1 alone, in lower case."""
    return word.isalpha() and _is_latin(word) and word == word.lower()


def _lower(text: str) -> str:
    """Lower case where that's the tokenizer's own, character by character: in texts of Latin-1 characters."""
    return text.lower() if _is_latin(text) else text


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def blank_split(text: str) -> list[str]:
    """Words between ASCII blanks."""
    for c in "\n\t\r\v\f":
        if c in text:
            text = text.replace(c, " ")
    return text.split(" ")


def word_ids(path: str) -> WordIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


class SumOfSquares:
    """The packer of one partition. ``place`` and ``close`` return finished pieces, in no set order.

    A piece is (doc, start, ids as bytes, document's ids, sequence, offset).
    """

    def __init__(self, capacity: int, first_sequence: int, run_ids: int = 1 << 24):
        if capacity < 1 or capacity & (capacity - 1):
            raise ValueError("capacity must be a power of two")
        self.capacity, self.next, self.run_ids = capacity, first_sequence, run_ids
        self.levels = np.zeros(capacity + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.held = 0  # ids in open windows
        self.moved = 0  # ids that a window gave up at the end of a run

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, doc, ids: bytes) -> list[tuple]:
        total, done, at = len(ids) // 4, [], 0
        while total - at >= self.capacity:
            done.append((doc, at, ids[4 * at : 4 * (at + self.capacity)], total, self._new(), 0))
            at += self.capacity
        if at < total:
            size = total - at
            self.held += size
            done += self._put((doc, at, ids[4 * at :], total), self._choose(size))
            if self.held > self.run_ids:
                done += self.close()
        return done

    def _put(self, piece: tuple, level: int) -> list[tuple]:
        """The piece into a window of this level (0: a new one); the window's pieces if that fills it."""
        window = self.open[level].pop() if level else []
        self.levels[level] -= level > 0
        window.append(piece)
        level += len(piece[2]) // 4
        if level == self.capacity:
            self.held -= level
            return self._number(window)
        self.open[level].append(window)
        self.levels[level] += 1
        return []

    def _choose(self, size: int, may_open: bool = True) -> int:
        """The level of the window that takes ``size`` ids; 0 for a new one, or none."""
        n, cap = self.levels, self.capacity
        change = np.where(n[1 : cap - size + 1] > 0, 2 * (n[size + 1 : cap + 1] - n[1 : cap - size + 1]) + 2, 1 << 60)
        if n[cap - size]:
            change[-1] = 1 - 2 * n[cap - size]
        if not len(change):
            return 0
        # Of equal changes the fullest window is taken, and a new one only if that is strictly better.
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return best + 1 if change[best] <= (2 * n[size] + 1 if may_open else 1 << 59) else 0

    def _number(self, window: list) -> list[tuple]:
        sequence, offset, out = self._new(), 0, []
        for doc, start, ids, total in window:
            out.append((doc, start, ids, total, sequence, offset))
            offset += len(ids) // 4
        return out

    def close(self) -> list[tuple]:
        """Fill the fullest open windows with the pieces of the others; what is left goes to windows of powers of two."""
        room = self.held // self.capacity  # so many windows stay
        queue: list[tuple] = []
        for level in range(self.capacity, 0, -1):
            stay = self.open[level][:room]
            room -= len(stay)
            queue += [p for window in self.open[level][len(stay) :] for p in window]
            self.open[level], self.levels[level] = stay, len(stay)
        self.moved += sum(len(p[2]) // 4 for p in queue)
        # Longest pieces first: they are the hardest to place whole.
        queue.sort(key=lambda p: len(p[2]))
        done, rest = [], []
        while queue:
            piece = queue.pop()
            level = self._choose(len(piece[2]) // 4, may_open=False)
            if not level:
                levels = np.flatnonzero(self.levels)
                if not len(levels):
                    rest.append(piece)
                    continue
                level = int(levels[0])
                piece, behind = self._cut(piece, self.capacity - level)
                queue.append(behind)
            done += self._put(piece, level)
        left = sum(len(p[2]) // 4 for p in rest)
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            window = []
            while size:
                piece = rest.pop()
                if len(piece[2]) // 4 > size:
                    piece, behind = self._cut(piece, size)
                    rest.append(behind)
                window.append(piece)
                size -= len(piece[2]) // 4
            done += self._number(window)
        self.held = 0
        return done

    @staticmethod
    def _cut(piece: tuple, size: int) -> tuple[tuple, tuple]:
        doc, start, ids, total = piece
        return (doc, start, ids[: 4 * size], total), (doc, start + size, ids[4 * size :], total)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int | None = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    run_ids: int = 1 << 24,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if asked for).

    Null and empty texts hold ``end_id`` only (and give no piece without one). Repeated rows and null
    identifiers are packed like any other; rows are taken as they come, so nothing can tie. A text that is longer than a window is cut. An empty table
    gives an empty result. Other columns are ignored, whatever they are called. A sequence that is shorter than ``capacity`` has a power of two as its
    length. Where a text spells a special token of the tokenizer, it gets that token's id.
    """
    small_batches(docs.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer_path)
        packer = SumOfSquares(capacity, TaskContext.get().partitionId() << 36, run_ids)

        def emit(pieces: list[tuple]) -> pa.RecordBatch:
            doc, start, ids, total, sequence, offset = map(list, zip(*pieces, strict=True))
            cols = [doc, start, [len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids], total, sequence, offset]
            names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]
            arrays = [pa.array(x, pa.int64()) for x in cols]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

        for batch in batches:
            texts = [b.decode("utf-8", "replace") for b in batch.column(1).to_pylist()]
            out = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(texts, end_id), strict=True):
                out += packer.place(doc, ids)
            if out:
                yield emit(out)
        if out := packer.close():
            yield emit(out)

    return text_frame(docs, id_col, text_col).mapInArrow(trimmed(run, "packing"), PIECE_SCHEMA + (", ids array<int>" if with_ids else ""))
