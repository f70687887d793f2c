"""Deduplication of repeated byte strings, by longest-previous-factor values over a sparse suffix order.

A string of ``length`` bytes (a window) is repeated if it also starts anywhere else. Suffixes are not sorted at every byte
but at anchors: of every window the ``GRAM``-byte substring of least hash, the leftmost of equals, is the anchor, so two equal windows have
their anchor at the same place inside, and it is enough to compare anchors that share their substring. Substrings that repeat themselves after
``PERIODS`` bytes or less ("the the the ") come after all others, so they are anchors of windows that hold nothing else only: junk that many texts share, between
other text each time, then has few surroundings.

1. Each partition finds its anchors with a hash of the substring and one of the whole surroundings, which are the windows
   of the anchor, from the first to the last. Anchors of equal surroundings are a class, all of whose windows repeat. A partition settles its own
   classes and sends one member of each; so a passage that fills a third of the rows is sent once per partition. (The hash of surroundings folds two
   of independent kinds, one modulo 2^64 and one modulo a prime, and goes with that of the substring.)
2. Anchors meet by substring, packed in buckets. Classes that span partitions are settled. Where one substring has several classes,
   one member of each asks for its surroundings. Substrings with very many classes, such as rulers, are known from a sample of the documents
   and don't meet here: their anchors ask at once, to meet by parts of their windows. Should the sample miss one, it only costs time.
3. The surroundings of one substring are put in suffix order to the right, within every branch of their order to the
   left. In a branch that agrees on the left for ``d`` bytes, the greatest common prefix that an anchor has with an earlier one is the one with its previous
   or next smaller position in suffix order (the longest previous factor), and with a later one that with its previous or next greater
   position. Windows that begin ``d`` bytes before the anchor repeat if ``d`` and that prefix make up ``length``. Where every copy goes both
   count, where the first one stays the previous ones only.
   A substring with too many classes to order in one task has its windows split in ``PARTS`` parts by ``d``; those of a part have more than
   the substring in common, and anchors meet again by that. Parts are split further where need be; in the end a part is one window.
4. The spans of each document are merged and cut out.

With ``keep="none"`` every copy of a repeated string goes; with ``keep="first"`` the first one (least identifier, then least
place) stays. Strings are judged on the input in either case.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, small_batches, trimmed

GRAM = 32
#: A substring with a period of so many bytes or less is an anchor only where there is no other.
PERIODS = 16
#: Anchors that are put in order in one task; beyond, they are split by more of their surroundings.
MOST_CLASSES = 20_000
#: Documents of the sample that tells substrings with very many classes: a fiftieth, within these bounds.
SAMPLE = 5_000, 200_000
#: Texts are hashed together up to so many bytes.
_BLOCK = 1 << 17
_NO_ID = -(1 << 63)
#: From so many values on, NumPy is faster than a loop.
_VECTORS = 64

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x5851F42D4C957F2D)
_BACK = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
# The second hash: a polynomial modulo a prime, with letters and a base of its own.
_PRIME, _BASE = np.uint64((1 << 31) - 1), 1_103_515_245
_LETTER = _rng.integers(1, (1 << 31) - 1, 256).astype(np.uint64)
_prime_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of _STEP and _BACK, at least ``n`` of each."""
    if len(_powers[0]) < n:
        n = max(n, 2 * len(_powers[0]), _BLOCK)
        for k, step in enumerate((_STEP, _BACK)):
            table = np.full(n, step, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers


def _prime_tables(n: int) -> list[np.ndarray]:
    """Powers of _BASE modulo _PRIME and of its inverse, at least ``n`` of each."""
    while len(_prime_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, int(_PRIME)))):
            have = _prime_powers[k]
            _prime_powers[k] = np.concatenate([have, have * np.uint64(pow(base, len(have), int(_PRIME))) % _PRIME])
    return _prime_powers


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over values[i : i + width]."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[:-step], values[step:])
        done += step
    return values


def _periodic(raw: np.ndarray) -> np.ndarray:
    """Whether the substring of ``GRAM`` bytes that begins at each place has a period of at most ``PERIODS``."""
    n = len(raw) - GRAM + 1
    out = np.zeros(n, bool)
    for p in range(1, PERIODS + 1):
        same = np.zeros(len(raw) - p + 1, np.int32)
        np.cumsum(raw[p:] == raw[:-p], out=same[1:])
        out |= same[GRAM - p : GRAM - p + n] - same[:n] == GRAM - p
    return out


_PLACE = np.uint64((1 << 32) - 1)


class AnchorFinder:
    def __init__(self, length: int):
        if length <= GRAM:
            raise ValueError(f"length must be over {GRAM}")
        self.length, self.width = length, length - GRAM + 1

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Of the anchors of all texts: number of the text, place, hash of the substring, hash of the surroundings."""
        return self.surrounded(texts)[:4]

    def surrounded(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """The same, and how many bytes the surroundings reach to the left of the place, and to the right."""
        with np.errstate(over="ignore"):
            found, raw = self._find(texts, False)
            if not len(found[0]):
                return found
            # Texts with anchors that are periodic are looked at again. In all others these couldn't be anchors anyway.
            grams = raw[(found[1] + self._starts(texts)[found[0]])[:, None] + np.arange(GRAM)]
            dull = np.zeros(len(grams), bool)
            for p in range(1, PERIODS + 1):
                dull |= (grams[:, p:] == grams[:, :-p]).all(1)
            if not dull.any():
                return found
            again = np.unique(found[0][dull])
            others = ~np.isin(found[0], again)
            second = self._find([texts[k] for k in again.tolist()], True)[0]
        return tuple(np.concatenate([x[others], y]) for x, y in zip(found, (again[second[0]], *second[1:]), strict=True))

    @staticmethod
    def _starts(texts: list[bytes]) -> np.ndarray:
        sizes = np.array([len(t) for t in texts], np.int64)
        return np.cumsum(sizes) - sizes

    def _find(self, texts: list[bytes], told_apart: bool) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """What ``surrounded`` returns, and the bytes of all texts; periodic substrings come last if they are ``told_apart``."""
        starts, raw = self._starts(texts), np.frombuffer(b"".join(texts), np.uint8)
        n, ends = len(raw), starts + [len(t) for t in texts]
        none = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
        good = ends - starts >= self.length
        if not good.any():
            return none, raw
        up, back = _power_tables(n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[:n], out=prefix[1:])
        grams = mix64((prefix[GRAM:] - prefix[:-GRAM]) * back[: n - GRAM + 1])
        # By periodicity, 31 bits of the hash, and place: what a window chooses depends on its bytes alone.
        rank = (grams >> np.uint64(33) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
        if told_apart:
            rank[_periodic(raw)] |= np.uint64(1 << 63)
        least = _sliding(rank, self.width, np.minimum)  # of the window that begins there
        # Windows that run over the end of a text don't count.
        inside = np.zeros(n + 1, np.int32)
        np.add.at(inside, starts[good], 1)
        np.add.at(inside, ends[good] - self.length + 1, -1)
        window = np.flatnonzero(np.cumsum(inside)[: len(least)] > 0)
        chosen = (least[window] & _PLACE).astype(np.int64)
        # The windows of an anchor lie side by side.
        begins = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        at, low, high = chosen[begins], window[begins], window[np.append(begins[1:], len(window)) - 1] + self.length
        around = mix64((prefix[high] - prefix[low]) * back[low])
        prime_up, prime_back = _prime_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[raw] * prime_up[:n] % _PRIME, out=sums[1:])
        around = mix64(around ^ ((sums[high] - sums[low]) % _PRIME * prime_back[low] % _PRIME) * _STEP)
        around = mix64(around + (at - low).astype(np.uint64) * _STEP + (high - at).astype(np.uint64))
        of = np.searchsorted(ends, at, side="right")
        return (of, at - starts[of], grams[at], around, at - low, high - at), raw


def _merge_spans(spans: np.ndarray) -> np.ndarray:
    """Sorted, disjoint, not touching: (n, 2)."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return np.column_stack([spans[first, 0], np.append(reach[first[1:] - 1], reach[-1])])


# What a partition sends for each anchor.
_SENT = np.dtype([("gram", "<u8"), ("around", "<u8"), ("doc", "<i8"), ("place", "<i4"), ("before", "<i4"), ("after", "<i4"), ("check", "<i8"), ("many", "u1")])
_ROWS = "doc long, check long, kind int, gram long, spans binary"
_MET = ["bucket", "doc", "check", "kind", "gram", "spans"]
SPAN, ASK, SHOW, ASK_MANY, SHOW_MANY = range(5)


def _pack(rows: np.ndarray) -> bytes:
    """Column by column: equal and small numbers then compress."""
    return b"".join(np.ascontiguousarray(rows[f]).tobytes() for f in _SENT.names)


def _unpack(blobs: list[bytes]) -> np.ndarray:
    out = np.zeros(sum(len(b) // _SENT.itemsize for b in blobs), _SENT)
    at = 0
    for blob in blobs:
        n, read = len(blob) // _SENT.itemsize, 0
        for f in _SENT.names:
            kind = _SENT.fields[f][0]
            out[f][at : at + n] = np.frombuffer(blob, kind, n, read)
            read += n * kind.itemsize
        at += n
    return out


def _span_rows(doc, check, spans: list[bytes]) -> pa.RecordBatch:
    n = len(spans)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(check, pa.int64()), pa.array(np.full(n, SPAN, np.int32)), pa.array(np.zeros(n, np.int64)), pa.array(spans, pa.binary())],
        ["doc", "check", "kind", "gram", "spans"],
    )


def _ask_rows(heads: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    """Rows by which anchors ask for their surroundings."""
    places = pa.array([p.tobytes() for p in np.column_stack([heads[f] for f in ("place", "before", "after")]).astype("<i4")], pa.binary())
    arrays = [pa.array(heads["doc"]), pa.array(heads["check"]), pa.array(kind.astype(np.int32)), pa.array(heads["gram"].view(np.int64)), places]
    return pa.RecordBatch.from_arrays(arrays, ["doc", "check", "kind", "gram", "spans"])


def _windows_of(rows: np.ndarray) -> np.ndarray:
    """The surroundings of anchors, as spans."""
    return np.column_stack([rows["place"] - rows["before"], rows["place"] + rows["after"]]).astype("<i4")


def _find_pass(length: int, first_stays: bool, buckets: int, large: np.ndarray | None = None):
    """Of rows (doc, check, body): (bucket, doc, check, kind, gram, spans), anchors for the bucket; or, where doc isn't null, a document's settled spans and what it asks.

    Anchors of ``large`` substrings (sorted) ask at once.
    """
    large = np.zeros(0, np.uint64) if large is None else large

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, parts, docs, checks = AnchorFinder(length), [], [], []

        def take(texts: list[bytes], base: int) -> None:
            of, place, gram, around, before, after = find.surrounded(texts)
            parts.append((of + base, gram, around, *(x.astype(np.int32) for x in (place, before, after))))

        for batch in batches:
            block, filled, base = [], 0, len(docs)
            for doc, check, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if block and filled + len(text) > _BLOCK:
                    take(block, base)
                    block, filled, base = [], 0, len(docs)
                block.append(text)
                filled += len(text)
                docs.append(doc)
                checks.append(check)
            if block:
                take(block, base)
        if not parts:
            return
        of = np.concatenate([p[0] for p in parts])
        rows = np.zeros(len(of), _SENT)
        for k, name in enumerate(("gram", "around", "place", "before", "after"), 1):
            rows[name] = np.concatenate([p[k] for p in parts])
        rows["doc"], rows["check"] = np.array(docs, np.int64)[of], np.array(checks, np.int64)[of]
        parts.clear()
        order = np.lexsort((rows["place"], rows["doc"], rows["around"], rows["gram"]))
        rows, of = rows[order], of[order]
        begins, many = _classes(rows)
        settled = _settled(rows, begins, many, first_stays)
        sent = rows[begins]
        sent["many"] = many
        # Settled spans, merged by document.
        spans, of = _windows_of(rows[settled]), of[settled]
        order = np.lexsort((spans[:, 0], of))
        spans, of = spans[order], of[order]
        cuts = np.flatnonzero(np.diff(of)) + 1
        numbers = of[np.concatenate([[0], cuts])] if len(of) else of
        merged = [_merge_spans(s).astype("<i4").tobytes() for s in np.split(spans, cuts)] if len(of) else []
        bucket_of = lambda numbers: pa.array(((numbers + TaskContext.get().partitionId()) % buckets).astype(np.int32))
        if merged:
            who = _span_rows(np.array(docs, np.int64)[numbers], np.array(checks, np.int64)[numbers], merged)
            yield pa.RecordBatch.from_arrays([bucket_of(numbers), *who.columns], _MET)
        at_once = np.isin(sent["gram"], large)
        if at_once.any():
            asks = sent[at_once]
            asks = _ask_rows(asks, np.where((asks["many"] > 0) & (not first_stays), SHOW_MANY, ASK_MANY))
            yield pa.RecordBatch.from_arrays([bucket_of(np.arange(asks.num_rows)), *asks.columns], _MET)
            sent = sent[~at_once]
        bucket = (sent["gram"] >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        sent, bucket = sent[order], bucket[order].astype(np.int32)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        heads = bucket[np.concatenate([[0], cuts])] if len(bucket) else bucket
        blobs = [_pack(s) for s in np.split(sent, cuts)] if len(bucket) else []
        for k in range(0, len(blobs), 256):
            n = len(blobs[k : k + 256])
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(heads[k : k + 256]), none, none, pa.nulls(n, pa.int32()), none, pa.array(blobs[k : k + 256], pa.binary())], _MET)

    return run


def _classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by gram and around: where classes begin, and whether they have more than one member."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    new = (rows["gram"][1:] != rows["gram"][:-1]) | (rows["around"][1:] != rows["around"][:-1])
    begins = np.flatnonzero(np.concatenate([[True], new]))
    counts = np.diff(np.append(begins, len(rows)))
    return begins, (counts > 1) | (np.maximum.reduceat(rows["many"], begins) > 0)


def _settled(rows: np.ndarray, begins: np.ndarray, many: np.ndarray, first_stays: bool) -> np.ndarray:
    """Rows (sorted by class, document and place) that other members of their class settle."""
    counts = np.diff(np.append(begins, len(rows)))
    out = np.repeat(many, counts)
    if first_stays and len(rows):
        lead = np.repeat(begins, counts)
        out &= (rows["doc"] != rows["doc"][lead]) | (rows["place"] != rows["place"][lead])
    return out


def _bucket_pass(first_stays: bool, most_classes: int):
    """Of the rows of ``_find_pass``, sorted by bucket: settled spans, and who has to show surroundings."""

    def settle(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = _unpack(blobs)
        rows = rows[np.lexsort((rows["place"], rows["doc"], rows["around"], rows["gram"]))]
        begins, many = _classes(rows)
        mine = rows[_settled(rows, begins, many, first_stays)]
        if len(mine):
            yield _span_rows(mine["doc"], mine["check"], [s.tobytes() for s in _windows_of(mine)])
        heads = rows[begins]
        new = np.flatnonzero(np.concatenate([[True], heads["gram"][1:] != heads["gram"][:-1]])) if len(heads) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(new, len(heads)))
        shared = np.repeat(sizes, sizes)
        asks = shared > 1
        if asks.any():
            heads, many, shared = heads[asks], many[asks], shared[asks]
            kind = np.where(many & (not first_stays), SHOW, ASK) + 2 * (shared > most_classes)
            yield _ask_rows(heads, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            known = batch.column(1).is_valid()
            ready = batch.filter(known)
            if ready.num_rows:
                yield ready.select(_MET[1:])
            rest = batch.filter(pc.invert(known))
            for bucket, blob in zip(rest.column(0).to_pylist(), rest.column(5).to_pylist(), strict=True):
                if bucket != now and blobs:
                    yield from settle(blobs)
                    blobs = []
                now = bucket
                blobs.append(blob)
        if blobs:
            yield from settle(blobs)

    return run


#: Into so many parts a range of windows is split.
PARTS = 4


def _splits(length: int) -> int:
    """How often all windows of an anchor have to be split until each is by itself."""
    width, n = length - GRAM + 1, 0
    while width > 1:
        width, n = -(-width // PARTS), n + 1
    return n


def _parts(low: int, high: int, left: bytes, right: bytes, length: int) -> Iterator[tuple[int, int, int]]:
    """(gram, low, high) for each part of the windows that begin low to high bytes before an anchor, where it has any.

    What all windows of a part have in common makes its gram.
    """
    width = -(-(high - low + 1) // PARTS)
    for x in range(low, high + 1, width):
        y = min(high, x + width - 1)
        if len(left) >= x and len(right) >= length - y:
            core = b"%d %d " % (x, y) + left[:x] + b"|" + right[: length - y]
            yield int.from_bytes(hashlib.blake2b(core, digest_size=8).digest(), "little", signed=True), x, y


def _surroundings_pass(length: int):
    """Of rows (doc, check, body, asked): (doc, check, kind, gram, spans, place, low, high, left, right), left read backwards.

    Anchors of a substring with too many classes give a row for each part of their windows.
    """
    reach = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, check, body, asked in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                back = body[::-1]
                for ask in asked:
                    (place, before, after), kind = struct.unpack("<3i", ask["spans"]), ask["kind"]
                    at = len(body) - place
                    left, right = back[at : at + before], body[place : place + after]
                    if kind >= ASK_MANY:
                        out += [(doc, check, kind - 2, gram, None, place, x, y, left, right) for gram, x, y in _parts(0, reach, left, right, length)]
                    else:
                        out.append((doc, check, kind, ask["gram"], None, place, 0, reach, left, right))
                if len(out) > 20_000:
                    yield _full_rows(out)
                    out = []
            if out:
                yield _full_rows(out)

    return run


_FULL = _ROWS + ", place int, low int, high int, left binary, right binary"


def _full_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in _FULL.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def common_prefix(x: bytes, y: bytes) -> int:
    low, high = 0, min(len(x), len(y))
    if x[:high] == y[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if x[low:middle] == y[low:middle]:
            low = middle
        else:
            high = middle
    return low


def longest_factors(prefixes: list[int], places: list) -> list[int]:
    """For suffixes in order, with the common prefixes of neighbours: the longest that each shares with one of a smaller place.

    That is the previous or the next smaller place in suffix order; one stack tells both. Equal places aren't smaller.
    """
    best = [0] * len(places)
    stack: list[tuple] = []  # (suffix, place, prefix shared with the entry below, with the previous smaller place)
    for k, place in enumerate(places):
        run = prefixes[k - 1] if k else 0
        while stack and stack[-1][1] > place:
            suffix, _, below, _ = stack.pop()
            if run > best[suffix]:
                best[suffix] = run
            if below < run:
                run = below
        before = 0
        if stack:
            _, last, _, reach = stack[-1]
            before = run if last < place else min(run, reach)
            best[k] = before
        stack.append((k, place, run, before))
    return best


class _RangeMinimum:
    """Least of values[a:b]; from tables of spans of powers of two where there are many values."""

    def __init__(self, values: list[int]):
        self.values, self.tables = values, []
        if len(values) >= _VECTORS:
            table, step = np.array(values, np.int32), 1
            self.tables.append(table)
            while 2 * step <= len(values):
                table = np.minimum(table[:-step], table[step:])
                self.tables.append(table)
                step *= 2

    def between(self, marks: list[int]) -> list[int]:
        """For neighbours a, b of rising marks."""
        if not self.tables:
            return [min(self.values[a:b]) for a, b in zip(marks, marks[1:], strict=False)]
        if len(marks) >= _VECTORS:
            at = np.array(marks)
            a, b = at[:-1], at[1:]
            level = np.frexp((b - a).astype(np.float64))[1] - 1
            out = np.empty(len(a), np.int32)
            for k in np.flatnonzero(np.bincount(level)).tolist():
                here = level == k
                out[here] = np.minimum(self.tables[k][a[here]], self.tables[k][b[here] - (1 << k)])
            return out.tolist()
        out = []
        for a, b in zip(marks, marks[1:], strict=False):
            if b - a <= _VECTORS:
                out.append(min(self.values[a:b]))
            else:
                k = (b - a).bit_length() - 1
                out.append(int(min(self.tables[k][a], self.tables[k][b - (1 << k)])))
        return out


def repeated_windows(lefts: list[bytes], rights: list[bytes], length: int, places: list[int], earlier: bool, least: int = 0, most: int = 1 << 30) -> list[list[tuple[int, int]]]:
    """Of each anchor: spans, relative to it, of its windows that repeat around another anchor, or an ``earlier`` one only.

    ``places`` are the ranks of the anchors in the corpus; they tie where an anchor is given twice. Windows that begin ``least`` to ``most`` bytes before the anchor are looked at.
    """
    n = len(lefts)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    if n == 2:  # most groups: each is the other's neighbour
        nearest = max(least, length - common_prefix(*rights))
        furthest = min(common_prefix(*lefts), most)
        for a in (0, 1) if nearest <= furthest else ():
            if places[a] > places[1 - a] or (not earlier and places[a] < places[1 - a]):
                out[a].append((-furthest, length - nearest))
        return out
    by_left = sorted(range(n), key=lefts.__getitem__)
    agree = [common_prefix(lefts[a], lefts[b]) for a, b in zip(by_left, by_left[1:], strict=False)]
    by_right = sorted(range(n), key=rights.__getitem__)
    shared = _RangeMinimum([common_prefix(rights[a], rights[b]) for a, b in zip(by_right, by_right[1:], strict=False)])
    rank = [0] * n
    for k, a in enumerate(by_right):
        rank[a] = k
    left_ranks = [rank[a] for a in by_left]
    todo = [(0, n - 1, least)] if n > 1 else []
    while todo:
        low, high, base = todo.pop()
        depth = min(agree[low:high])
        if depth >= base:
            branch = sorted(left_ranks[low : high + 1])
            prefixes = shared.between(branch)
            # Only runs of neighbours that agree long enough to the right can hold a window.
            need, furthest, at = length - min(depth, most), min(depth, most), 0
            for end in [*(k for k, x in enumerate(prefixes) if x < need), len(prefixes)]:
                inner, first, at = prefixes[at:end], at, end + 1
                if not inner:
                    continue
                run = [by_right[r] for r in branch[first : end + 1]]
                ranks = [places[a] for a in run]
                factors = longest_factors(inner, ranks)
                if not earlier:  # with later ones: greater places are smaller ones counted from the end
                    factors = map(max, factors, longest_factors(inner, [-r for r in ranks]))
                for a, right in zip(run, factors, strict=True):
                    nearest = max(base, length - right)
                    if nearest <= furthest:
                        out[a].append((-furthest, length - nearest))
        if depth >= most:
            continue  # windows that begin further to the left aren't asked for
        begin = low
        for k in range(low, high + 1):
            if k == high or agree[k] == depth:
                if k > begin:
                    todo.append((begin, k, max(base, depth + 1)))
                begin = k + 1
    return out


def _order_pass(length: int, first_stays: bool, most_classes: int):
    """Of full rows sorted by gram: spans, those of the input too, and the parts of what is too much to order at once."""

    def span(row: tuple, spans: list[tuple[int, int]]) -> tuple:
        place = row[5]
        return (row[0], row[1], SPAN, row[0], np.array([(place + a, place + b) for a, b in spans], "<i4").tobytes(), *[None] * 5)

    def order(rows: list[tuple]) -> list[tuple]:
        if first_stays:
            rank = {p: k for k, p in enumerate(sorted({(r[0], r[5]) for r in rows}))}
            places = [rank[r[0], r[5]] for r in rows]
        else:  # every row is an occurrence of its own, even if identifiers repeat
            places = list(range(len(rows)))
        found = repeated_windows([r[8] for r in rows], [r[9] for r in rows], length, places, first_stays, rows[0][6], rows[0][7])
        return [span(r, spans) for r, spans in zip(rows, found, strict=True) if spans and r[2] == ASK]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        out: list[tuple] = []
        many = False  # the group has been found too large; of equal windows (low = high), the first so far stays in it

        def spill(row: tuple) -> None:
            _, _, kind, _, _, place, low, high, left, right = row
            if low < high:
                out.extend((*row[:3], gram, None, place, x, y, left, right) for gram, x, y in _parts(low, high, left, right, length))
            elif not first_stays:
                out.append(span(row, [(-low, length - low)]))
            else:
                a, b = sorted([group.pop(), row], key=lambda r: (r[0], r[5]))
                group.append(a)
                if (a[0], a[5]) != (b[0], b[5]):
                    out.append(span(b, [(-low, length - low)]))

        for batch in batches:
            done = pc.equal(batch.column(2), SPAN)
            if ready := pc.sum(done).as_py():
                yield batch.filter(done)
                if ready == batch.num_rows:
                    continue
                batch = batch.filter(pc.invert(done))
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][3] != row[3]:
                    if not many:
                        out += order(group)
                    group, many = [], False
                if many:
                    spill(row)
                    continue
                group.append(row)
                if len(group) > most_classes:
                    rows, group, many = group, group[:1], True
                    for r in rows[first_stays and row[6] == row[7] :]:
                        spill(r)
            if out:
                yield _full_rows(out)
                out.clear()
        if group and not many:
            out += order(group)
        if out:
            yield _full_rows(out)

    return run


def _cut_pass(names: list[str], with_text: bool):
    """Of rows (doc, body, found, carried columns ...): what is removed and what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, digests, texts = [], [], [], [], []
            for body, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = np.zeros((0, 2), np.int64)
                if found:
                    spans = _merge_spans(np.frombuffer(b"".join(found), "<i4").reshape(-1, 2).astype(np.int64))
                left, at = [], 0
                for a, b in spans.tolist():
                    left.append(body[at:a])
                    at = b
                left = b"".join([*left, body[at:]])
                n_bytes.append(len(body))
                n_removed.append(len(body) - len(left))
                n_spans.append(len(spans))
                digests.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    texts.append(left.decode("utf-8", "ignore"))
            arrays = [*batch.columns[3:], pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())]
            if with_text:
                arrays.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, [*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text])

    return run


def _large_grams(base: DataFrame, length: int, most_classes: int) -> np.ndarray:
    """Hashes of substrings that by a sample of documents have over ``most_classes`` classes, sorted; at most a third of the sample's anchors."""
    n = base.count()
    share = min(1.0, min(max(SAMPLE[0], n // 50), SAMPLE[1]) / max(1, n))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = AnchorFinder(length)
        for batch in batches:
            _, _, gram, around = find(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(around.view(np.int64))], ["gram", "around"])

    sample = base.where(F.pmod(F.col("check"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else base
    told = sample.select("body").distinct().mapInArrow(trimmed(anchors), "gram long, around long").distinct()
    told = told.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(2, most_classes * share))
    return np.sort(np.array([r.gram for r in told.select("gram").collect()], np.int64).view(np.uint64))


def substring_dedup(
    docs: DataFrame,
    length: int = 200,
    keep: str = "none",
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = ("doc_id",),
    with_text: bool = False,
    most_classes: int = MOST_CLASSES,
) -> DataFrame:
    """The columns ``carry``, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text) of each row.

    Texts are UTF-8 bytes; null counts as empty. A text shorter than ``length`` loses nothing. Equal texts are copies of each other. With ``keep="first"``,
    rows that repeat an identifier and text count as one document, a null identifier comes first, and different texts of one identifier that hold the same string at the
    same place tie, so that both keep it. With ``keep="none"`` rows without identifier are like any others. ``kept_text`` leaves out characters that a cut went through.
    A text of any length counts whole. An empty table gives an empty result. Columns that aren't carried are ignored, whatever they are called.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep must be none or first")
    spark, first_stays = docs.sparkSession, keep == "first"
    small_batches(spark, 1000)
    # Carried columns get names of their own: they may be called like ours. The identifier comes back from "doc", so that
    # without others both joins below take the same rows, and the texts are shuffled once.
    extra = [c for c in carry if c != id_col]
    # Rows are told apart by identifier and hash of the text, so those without identifier share nothing, unless their texts are the same.
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"),
        *(F.col(c).alias(f"carry_{c}") for c in extra),
    )
    base = base.select("doc", F.xxhash64("body").alias("check"), *base.columns[1:])
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    large = _large_grams(base.select("doc", "check", "body"), length, most_classes)
    sent = base.select("doc", "check", "body").mapInArrow(trimmed(_find_pass(length, first_stays, buckets, large)), "bucket int, " + _ROWS)
    met = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(_bucket_pass(first_stays, most_classes)), _ROWS)
    met = materialize(met, "anchors")

    # Sets: rows that repeat an identifier and a text ask, and are told, the same.
    asks = met.where(F.col("kind") != SPAN).groupBy("doc", "check").agg(F.collect_set(F.struct("kind", "gram", "spans")).alias("asked"))
    rest = base.join(asks.hint("shuffle_hash"), ["doc", "check"])
    rest = rest.select("doc", "check", "body", "asked").mapInArrow(trimmed(_surroundings_pass(length)), _FULL)
    found = met.where(F.col("kind") == SPAN).select("doc", "check", "spans")
    for _ in range(max(1, _splits(length))):
        ordered = rest.repartition("gram").sortWithinPartitions("gram").mapInArrow(trimmed(_order_pass(length, first_stays, most_classes)), _FULL)
        ordered = materialize(ordered, "ordered")
        found = found.union(ordered.where(F.col("kind") == SPAN).select("doc", "check", "spans"))
        rest = ordered.where(F.col("kind") != SPAN)
        if not rest.limit(1).count():
            break
    spans = found.groupBy("doc", "check").agg(F.collect_set("spans").alias("found"))
    rows = base.join(spans.hint("shuffle_hash"), ["doc", "check"], "left")
    kinds = dict(docs.dtypes)
    who = F.when(F.col("doc") != _NO_ID, F.col("doc")).cast(kinds[id_col])
    rows = rows.select("doc", "body", "found", *((who if c == id_col else F.col(f"carry_{c}")).alias(f"carry_{c}") for c in carry))
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "n_bytes long, n_removed long, n_spans long, kept_sha256 string", *["kept_text string"] * with_text])
    return rows.mapInArrow(trimmed(_cut_pass(list(carry), with_text)), schema)
