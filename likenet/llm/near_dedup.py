"""Near-duplicate groups from SetSketch registers.

A document's set holds its distinct word shingles. Its sketch has ``m`` registers: every element draws points of a
Poisson process and deals them to registers at random; a register keeps the truncated logarithm, to a base little
over one, of the least point it got. Registers are independent, the sketch of a union is the maximum of
the sketches, and two sketches agree in a register about as often as the sets' Jaccard similarity says.

1. Documents of one set are one class. From here on a class counts once, however many copies it has.
2. The registers are cut into bands; classes that agree in a band meet in its bucket. With 57 bands of 6
   registers a pair of similarity 0.8 meets nowhere with a probability of 3e-8, one of similarity 0.02 somewhere with 4e-9. The base is so
   little over one that registers of sets without a common element agree once in 2,000 times, so those meet with less than 1e-17.
3. In a bucket, every class is paired with the bucket's first one: as many pairs as rows. Pairs whose joint likelihood, from
   how many registers are greater, less and equal, speaks against the threshold by a factor of e^16 are put aside.
   Of the others, each class's likeliest pair is verified on the full sets.
4. Verified links are joined to components by hooking and pointer jumping.
5. In buckets that still hold several components, classes of different components are compared, sketch against
   sketch, in blocks of bounded size. First each class's likeliest pair is verified and joined. Then the sets of all classes that are in
   some likely pair are brought to their blocks, and every such pair is verified there unless links of the block have joined it, so
   what comes out grows with the rows. Classes of one component aren't compared: a further link among them changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_told, materialize, mix64, small_batches, text_frame, trimmed

BANDS, ROWS, BASE = 57, 6, 1.001
#: So many identifiers of wanted texts are broadcast (16 bytes each); for more, texts are moved.
BROADCAST_TEXTS = 1_000_000
#: Shares of the nodes of one label.
SALT = 16
#: Classes of one bucket in a block.
BLOCK = 512
#: Log of the likelihood ratio beyond which a pair is put aside.
SURE = 16.0


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased."""
    words = text.lower().split()  # of bytes: ASCII only, both
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    n = max(1, len(words) - width + 1)
    out = np.full(n, min(width, len(words)), np.uint64)
    for k in range(min(width, len(words))):
        out = mix64(out + h[k : k + n] + np.uint64(0x9E3779B97F4A7C15))
    return np.unique(out)


def sketches(sets: list[np.ndarray], m: int, base: float = BASE, scale: float = 20.0) -> np.ndarray:
    """The registers of each set, which must not be empty: (len(sets), m) of uint16."""
    least = np.full((len(sets), m), np.inf)
    # So many points an element of the set will need, as a power of two; sets that need as many are done together.
    needs = np.array([max(0, int(np.ceil(np.log2(m * (np.log(m) + 1) / len(s))))) for s in sets], int)
    for need in set(needs.tolist()):
        ours = np.flatnonzero(needs == need)
        element = np.concatenate([sets[k] for k in ours])
        owner = np.repeat(ours, [len(sets[k]) for k in ours])
        point, drawn, draw = np.zeros(len(element)), 0, 1 << need
        while len(element):
            turns = np.arange(drawn + 1, drawn + draw + 1).astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
            for k in range(0, len(element), max(1, (1 << 18) // draw)):
                part = slice(k, k + max(1, (1 << 18) // draw))
                with np.errstate(over="ignore"):
                    bits = mix64(element[part, None] + turns)
                steps = np.log(((bits >> np.uint64(12)).astype(float) + 0.5) * 2.0**-52)
                steps[:, 0] -= point[part] * (m * scale)
                points = np.cumsum(steps, axis=1) / (-m * scale)
                place = owner[part, None] * m + (mix64(bits) % np.uint64(m)).astype(np.int64)
                np.minimum.at(least.ravel(), place.ravel(), points.ravel())
                point[part] = points[:, -1]
            # Later points of an element are greater: it is done when no register could still take one.
            top = np.full(len(sets), -np.inf)
            still = np.unique(owner)
            top[still] = least[still].max(axis=1)
            live = point < top[owner]
            element, owner, point = element[live], owner[live], point[live]
            drawn, draw = drawn + draw, max(1, draw // 4)
    return np.clip(np.floor(1 - np.log(least) / np.log(base)), 0, 65535).astype(np.uint16)


def merge_sketches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def band_key(number: np.ndarray, registers: np.ndarray) -> np.ndarray:
    """A 64-bit key of the registers (last axis) of the bands of these numbers."""
    key = number.astype(np.uint64) + np.uint64(1)
    for k in range(registers.shape[-1]):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + registers[..., k].astype(np.uint64))
    return key


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """The keys of all bands: (sets, bands)."""
    parts = registers.reshape(len(registers), registers.shape[1] // rows, rows)
    return band_key(np.broadcast_to(np.arange(parts.shape[1]), parts.shape[:2]), parts)


def log_likelihood(greater, less, equal, n_a, n_b, similarity, base: float = BASE):
    """Of a similarity, given how many registers of A are greater than, less than and equal to those of B."""
    chance = lambda x: -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)
    total = n_a + n_b
    up, down = chance((n_a - n_b * similarity) / total), chance((n_b - n_a * similarity) / total)
    tiny = 1e-300
    return greater * np.log(up + tiny) + less * np.log(down + tiny) + equal * np.log(np.maximum(1 - up - down, tiny))


def likely(greater, less, equal, n_a, n_b, percent: int, base: float = BASE) -> np.ndarray:
    """False where the joint likelihood speaks clearly against a similarity of at least ``percent``/100."""
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    above, best = np.full(len(most), -np.inf), np.full(len(most), -np.inf)
    low = percent / 100
    for part in np.linspace(0, 1, 33):
        best = np.maximum(best, log_likelihood(greater, less, equal, n_a, n_b, part * most, base))
        above = np.maximum(above, log_likelihood(greater, less, equal, n_a, n_b, low + part * np.maximum(most - low, 0), base))
    return (above >= best - SURE) & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))


def _digest_pass(width: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(2).to_pylist()]
            # Sets of up to three can only be equal; they need no sketch.
            big = [k for k, s in enumerate(sets) if len(s) >= 4]
            register_list: list = [b""] * len(sets)
            for k, registers in zip(big, sketches([sets[k] for k in big], m), strict=True):
                register_list[k] = registers.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array(register_list, pa.binary()),
                ],
                ["doc_id", "text_hash", "n_shingles", "set_key", "registers"],
            )

    return run


def _band_pass(bands: int, rows: int):
    """Of rows (node, n_shingles, registers): (band, node, n_shingles) for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                registers = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(batch.num_rows, bands * rows)
                keys = band_keys(registers, rows).view(np.int64).ravel()
                node, n = (np.repeat(batch.column(k).to_numpy(), bands) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(node), pa.array(n)], ["band", "node", "n_shingles"])

    return run


def _by_likelihood(percent: int):
    """Of rows (a, n_a, reg_a, b, n_b, reg_b), the pairs (a, b, same) that may be similar enough; same: registers that agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = dict(zip(batch.schema.names, batch.columns, strict=True))
            x, y = (np.frombuffer(b"".join(col[c].to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("reg_a", "reg_b"))
            up, down = (x > y).sum(axis=1), (x < y).sum(axis=1)
            same = x.shape[1] - up - down
            good = pa.array(likely(up, down, same, col["n_a"].to_numpy().astype(float), col["n_b"].to_numpy().astype(float), percent))
            yield pa.RecordBatch.from_arrays([col["a"].filter(good), col["b"].filter(good), pa.array(same).filter(good)], ["a", "b", "same"])

    return run


def similar(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two sets, as sorted 64-bit numbers, are similar enough."""
    both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
    both.sort(kind="stable")  # merges the two runs
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _by_sets(percent: int):
    """Of rows (a, set_a, b, set_b), the pairs (a, b) that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns, strict=True))
            good = [similar(x, y, percent) for x, y in zip(col["set_a"].to_pylist(), col["set_b"].to_pylist(), strict=True)]
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([col["a"].filter(keep), col["b"].filter(keep)], ["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): the label is the least node that can be reached.

    Each round hooks a node, and the node it is labelled with, to the least label next to it, then follows labels once. Most nodes of a large
    component soon have one label. Distinct labels are looked up first, and only what a label leads on to comes back, dealt to
    ``SALT`` shares of its nodes.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        mine = labels.join(near, "node")
        offers = mine.select("node", "near").union(mine.where("near < label").select(F.col("label").alias("node"), "near"))
        offers = offers.groupBy("node").agg(F.min("near").alias("near"))
        hooked = labels.join(offers, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        onward = labels.where("label < node").select(F.col("node").alias("label"), F.col("label").alias("next"))
        onward = hooked.select("label").distinct().join(onward, "label").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        jumped = hooked.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int")).join(onward, ["label", "salt"], "left")
        jumped = materialize(jumped.select("node", "was", F.coalesce("next", "label").alias("label")), "labels")
        changed = jumped.where("label <> was").limit(1).count()
        discard(labels)
        labels = jumped.select("node", "label")
        labels._likenet_path = jumped._likenet_path
        if not changed:
            discard(both)
            return labels


def _sets(nodes: DataFrame, classes: DataFrame, source: DataFrame, width: int) -> DataFrame:
    """(node, elements): the full sets of ``nodes`` (node), from the text that stands for the class: one with its identifier and hash.

    Rows that repeat both collapse before they are moved and hashed. Where not too many texts are wanted, the others aren't moved at all.
    """
    wanted = nodes.join(classes.select("node", "set_key", "rep"), "node").select("node", "set_key", "rep.*")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns, strict=True))
            found = [shingle_set(t, width).tobytes() for t in col["body"].to_pylist()]
            # Another text may have the same identifier and hash.
            same = [hashlib.blake2b(s, digest_size=16).digest() == k for s, k in zip(found, col["set_key"].to_pylist(), strict=True)]
            keep = pa.array(same, pa.bool_())
            yield pa.RecordBatch.from_arrays([col["node"].filter(keep), pa.array(found, pa.binary()).filter(keep)], ["node", "elements"])

    ours = wanted.toDF("node", "set_key", "rep_id", "rep_hash")
    texts = source
    same_row = (F.col("text_hash") == F.col("rep_hash")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))
    if nodes.count() <= BROADCAST_TEXTS:
        texts = texts.join(F.broadcast(ours.select("rep_hash")), F.col("text_hash") == F.col("rep_hash"), "left_semi")
    texts = texts.dropDuplicates(["doc_id", "text_hash"])
    found = texts.join(ours.hint("shuffle_hash"), same_row).select("node", "set_key", "body")
    return materialize(found.mapInArrow(trimmed(sets), "node long, elements binary").dropDuplicates(["node"]), "sets")


def _verify(pairs: DataFrame, classes: DataFrame, source: DataFrame, width: int, percent: int, best: bool) -> DataFrame:
    """The links among ``pairs`` (a, b): by likelihood first, then on the full sets of what is left.

    With ``best``, only the likeliest pair of each ``b`` is verified.
    """
    told = classes.select("node", "n_shingles", "registers")
    a = told.toDF("a", "n_a", "reg_a")
    b = told.toDF("b", "n_b", "reg_b")
    left = pairs.join(a, "a").join(b, "b").select("a", "n_a", "reg_a", "b", "n_b", "reg_b").mapInArrow(trimmed(_by_likelihood(percent)), "a long, b long, same long")
    if best:
        left = left.groupBy("b").agg(F.max(F.struct("same", "a")).alias("top")).select("top.a", "b")
    left = materialize(left.select("a", "b"), "pairs")
    full = _sets(left.select(F.col("a").alias("node")).union(left.select("b")).distinct(), classes, source, width)
    checked = left.join(full.toDF("a", "set_a"), "a").join(full.toDF("b", "set_b"), "b").select("a", "set_a", "b", "set_b")
    out = materialize(checked.mapInArrow(trimmed(_by_sets(percent)), "a long, b long"), "verified")
    discard(full)
    discard(left)
    return out


class _Blocks:
    """Compares the classes of two blocks of a bucket (or those of one) by their sketches.

    Rows come as columns band, x, y, side, node, label, n_shingles, registers (and elements), sorted by band, x and y; side 0 is block x,
    side 1 block y. Blocks x and y may be the same: then all rows have side 0.
    """

    def __init__(self, percent: int, bands: int, rows: int):
        self.percent, self.bands, self.rows = percent, bands, rows
        self.kind = np.dtype((np.uint16, (bands * rows,)))

    def groups(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[int]]]:
        """Columns of whole groups, and where each group begins, with the end."""
        held: list | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns[:7]] + [np.frombuffer(b"".join(batch.column(7).to_pylist()), self.kind)]
            cols += [np.array([*c.to_pylist(), None], object)[:-1] for c in batch.columns[8:]]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            cuts = (np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1).tolist()
            if cuts:
                yield [c[: cuts[-1]] for c in cols], [0, *cuts]
            held = [c[cuts[-1] if cuts else 0 :] for c in cols]
        if held is not None:
            yield held, [0, len(held[0])]

    def agreeing(self, cols: list, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of one group: numbers of rows of different components that agree in enough registers, and in how many they do."""
        x, y, side, node, label, regs = (cols[k][low:high] for k in (1, 2, 3, 4, 5, 7))
        one = np.flatnonzero(side == 0)
        two = one if x[0] == y[0] else np.flatnonzero(side == 1)
        m = regs.shape[1]
        if len(one) * len(two) <= 256:
            same = (regs[one][:, None, :] == regs[two][None, :, :]).sum(axis=2)
        else:
            same = np.zeros((len(one), len(two)), np.uint8 if m < 256 else np.int32)
            left, right = np.ascontiguousarray(regs[one].T), np.ascontiguousarray(regs[two].T)
            for k in range(m):
                same += left[k][:, None] == right[k][None, :]
        # Registers agree at least as often as the similarity says: fewer by six standard deviations aren't worth a closer look.
        share = self.percent / 100
        ok = same >= m * share - 6 * np.sqrt(m * share * (1 - share)) - 1
        ok &= label[one][:, None] != label[two][None, :]
        if x[0] == y[0]:
            ok &= node[one][:, None] < node[two][None, :]
        i, j = np.nonzero(ok)
        return low + one[i], low + two[j], same[i, j].astype(np.int64)

    def candidates(self, cols: list, cuts: list[int], first_band_only: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all groups, in turn: numbers of rows of different components that may be similar enough, and in how many registers they agree.

        With ``first_band_only``, a pair that agrees in several bands counts in the first of them only.
        """
        found, waiting, kept = [], 0, [(np.zeros(0, np.int64),) * 3]

        def settle() -> None:
            i, j, same = (np.concatenate(x) for x in zip(*found, strict=True))
            # So many pairs at once: a block may have a quarter of a million.
            for k in range(0, len(i), 20_000):
                part = i[k : k + 20_000], j[k : k + 20_000], same[k : k + 20_000]
                good = self._likely(cols, *part, first_band_only)
                kept.append(tuple(x[good] for x in part))

        for low, high in zip(cuts, cuts[1:], strict=False):
            if high > low + 1:
                found.append(self.agreeing(cols, low, high))
                waiting += len(found[-1][0])
                if waiting > 20_000:
                    settle()
                    found, waiting = [], 0
        if waiting:
            settle()
        return tuple(np.concatenate(x) for x in zip(*kept, strict=True))

    def _likely(self, cols: list, i: np.ndarray, j: np.ndarray, same: np.ndarray, first_band_only: bool) -> np.ndarray:
        band, n, regs = cols[0], cols[6], cols[7]
        up = (regs[i] > regs[j]).sum(axis=1)
        good = likely(up, regs.shape[1] - up - same, same, n[i].astype(float), n[j].astype(float), self.percent)
        if first_band_only:
            a = regs[i].reshape(len(i), self.bands, self.rows)
            first = (a == regs[j].reshape(len(j), self.bands, self.rows)).all(axis=2).argmax(axis=1)
            good &= band_key(first, a[np.arange(len(i)), first]).view(np.int64) == band[i]
        return good

    def likeliest(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each row of a group, the likeliest pair (a, b)."""
        for cols, cuts in self.groups(batches):
            i, j, same = self.candidates(cols, cuts, False)
            if len(i):
                one, two, same = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([same, same])
                order = np.lexsort((cols[4][two], -same, one))
                top = order[np.flatnonzero(np.concatenate([[True], np.diff(one[order]) != 0]))]
                pairs = np.sort(np.column_stack([cols[4][one[top]], cols[4][two[top]]]), axis=1)
                pairs = np.unique(pairs, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def doubtful(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows (band, x, y, side, node, label) that are in any pair."""
        for cols, cuts in self.groups(batches):
            i, j, _ = self.candidates(cols, cuts, True)
            if len(i):
                rows = np.unique(np.concatenate([i, j]))
                yield pa.RecordBatch.from_arrays([pa.array(c[rows]) for c in cols[:6]], ["band", "x", "y", "side", "node", "label"])

    def joining(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links (a, b), verified on the full sets, likeliest first; of pairs that other links of the batch have joined, none."""
        for cols, cuts in self.groups(batches):
            node, label, elements = cols[4], cols[5], cols[8]
            root = {k: k for k in label.tolist()}

            def find(k: int, root=root) -> int:
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            i, j, same = self.candidates(cols, cuts, True)
            order = np.argsort(-same, kind="stable")
            out = []
            for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
                p, q = find(int(label[a])), find(int(label[b]))
                if p != q and similar(elements[a], elements[b], self.percent):
                    root[p] = q
                    out.append((int(node[a]), int(node[b])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])


def _blocks(met: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Step 5's blocks: (band, x, y, side, node, label) of buckets that hold several components.

    A bucket's largest component, if it has more than half of the rows, is its main one. Its rows are dealt to blocks, and so are the others, ``BLOCK``
    to each. Two blocks of others meet, and a block of others and one of the main component; the main component's
    blocks don't meet each other.
    """
    told = met.select("band", "node").join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label"))
    told = materialize(told, "met")
    mixed = told.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("rows")).where("low < high")
    sizes = told.join(mixed.select("band"), "band", "left_semi").groupBy("band", "label").agg(F.count(F.lit(1)).alias("part"))
    top = sizes.groupBy("band").agg(F.max(F.struct("part", "label")).alias("top"))
    has_main = 2 * F.col("top.part") > F.col("rows")
    plan = mixed.join(top, "band").select(
        "band",
        F.when(has_main, F.col("top.label")).alias("main"),
        F.when(has_main, F.ceil(F.col("top.part") / BLOCK)).otherwise(0).cast("int").alias("main_blocks"),
        F.ceil((F.col("rows") - F.when(has_main, F.col("top.part")).otherwise(0)) / BLOCK).cast("int").alias("blocks"),
    )
    told = told.join(plan, "band").withColumn("is_main", F.coalesce(F.col("label") == F.col("main"), F.lit(False)))
    told = told.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("main_blocks")).otherwise(F.col("blocks"))).cast("int"))
    told = told.withColumn(
        "spot",
        F.explode(
            F.expr(
                "case when is_main then transform(sequence(0, blocks - 1), k -> struct(k as x, -own - 1 as y, 1 as side)) else concat("
                " transform(sequence(own, blocks - 1), k -> struct(own as x, k as y, 0 as side)),"
                " transform(filter(sequence(0, own), k -> k < own), k -> struct(k as x, own as y, 1 as side)),"
                " transform(filter(sequence(0, main_blocks), k -> k > 0), k -> struct(own as x, -k as y, 0 as side))) end"
            )
        ),
    )
    return told.select("band", "spot.x", "spot.y", "spot.side", "node", "label")


def _gathered(rows: DataFrame, *with_columns: str) -> DataFrame:
    """Rows of one pair of blocks together. The number of partitions is set: few bytes may be much work here."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("band", "x", "y", "side", "node", "label", "n_shingles", "registers", *with_columns)
    return rows.repartition(n, "band", "x", "y").sortWithinPartitions("band", "x", "y")


def near_groups(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * |intersection| >= percent * |union| of their sets of ``width``-word shingles; with
    fewer words the whole sequence is the one shingle. ``component_id`` is the least identifier that links lead to. Null text counts as
    empty; a document without words is linked with nothing. Rows that repeat an identifier and text share a result. A null
    identifier is the component's only if all are null, and such rows say kept. Texts of any length count whole. An
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark, 1000)
    source = text_frame(docs, id_col, text_col).select("doc_id", F.xxhash64("body").alias("text_hash"), "body")
    schema = "doc_id long, text_hash long, n_shingles long, set_key binary, registers binary"
    told = materialize(source.mapInArrow(trimmed(_digest_pass(width, bands * rows)), schema), "sketches")
    classes = told.where("n_shingles > 0").groupBy("set_key").agg(
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("rep_id"), F.col("text_hash").alias("rep_hash")))).alias("known"),
        F.min(F.struct(F.lit(None).cast("long").alias("rep_id"), F.col("text_hash").alias("rep_hash"))).alias("any"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("registers").alias("registers"),
        F.count(F.lit(1)).alias("copies"),
    )
    classes = classes.select("set_key", F.coalesce("known", "any").alias("rep"), "n_shingles", "registers", "copies")
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    sketched = classes.where(F.length("registers") > 0).select("node", "n_shingles", "registers")
    in_bands = sketched.mapInArrow(trimmed(_band_pass(bands, rows)), "band long, node long, n_shingles long")
    leaders = in_bands.groupBy("band").agg(F.min(F.struct("node", "n_shingles")).alias("lead"), F.count(F.lit(1)).alias("met")).where("met > 1")
    met = materialize(in_bands.join(leaders, "band").select("band", "node", "n_shingles", "lead", "met"), "buckets")
    close = 100 * F.least("n_shingles", "lead.n_shingles") >= percent * F.greatest("n_shingles", "lead.n_shingles")
    pairs = met.where((F.col("node") != F.col("lead.node")) & close).select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct()
    links = _verify(pairs, classes, source, width, percent, best=True)
    labels = components(links)
    compare, told_of = _Blocks(percent, bands, rows), classes.select("node", "n_shingles", "registers")
    link, place = "a long, b long", "band long, x int, y int, side int, node long, label long"
    across = _gathered(_blocks(met, labels, classes).join(told_of, "node")).mapInArrow(trimmed(compare.likeliest), link).distinct()
    more = _verify(across, classes, source, width, percent, best=False)
    if more.limit(1).count():
        links = links.union(more)
        labels = components(links)
    doubtful = materialize(_gathered(_blocks(met, labels, classes).join(told_of, "node")).mapInArrow(trimmed(compare.doubtful), place), "doubtful")
    if doubtful.limit(1).count():
        full = _sets(doubtful.select("node").distinct(), classes, source, width)
        joined = _gathered(doubtful.join(told_of, "node").join(full, "node"), "elements").mapInArrow(trimmed(compare.joining), link)
        joined = materialize(joined, "joined")
        if joined.limit(1).count():
            labels = components(links.union(joined))

    least = classes.join(labels, "node", "left").select("set_key", "rep.rep_id", "copies", F.coalesce("label", "node").alias("label"))
    of_label = least.groupBy("label").agg(F.min("rep_id").alias("component"), F.count(F.lit(1)).alias("n"))
    n_rows = told.count()
    of_key = join_told(least.select("set_key", "copies", "label"), of_label, "label", "n", n_rows).select("set_key", "copies", "component")
    of_key = materialize(of_key, "components")
    out = told.select("doc_id", "n_shingles", "set_key")
    linked = join_told(out.where("n_shingles > 0"), of_key, "set_key", "copies", n_rows)
    linked = linked.select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = out.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
