"""Toxicity by a linear-chain conditional random field with two tags.

Labels are given for documents, tokens are labelled from them: words and beginnings of words that occur nearly only
in toxic documents mark a token of such a document; all other tokens are clean. A chain over all tokens of the texts
learns a weight for each marker, for endings, shapes and neighbours that took no part in the labelling, and for each pair of neighbouring tags, by its
conditional likelihood, with exact gradients from the forward-backward pass. So a token that carries a marker need not be toxic in the end,
one without any may be, and the tags beside it count too.

A document's score is a logistic function of what the marginals add up to: the expected number of toxic tokens and the greatest
marginal. Spans are runs of tokens with a marginal of a half or more.

With two tags a message is one ratio, and a step of it contracts, so texts are cut into segments that overlap by
``CONTEXT`` tokens on both sides: every token is tagged, and what a cut changes in a marginal is far below rounding of the score.
For training, texts are cut into windows of ``WINDOW`` tokens, one behind the other: every token of every text is in one.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain as joined
from string import punctuation

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out_column, small_batches, text_frame
from .labelled import FIT_BYTES, labelled_sample

SEGMENT, CONTEXT = 1024, 64
#: Tokens of a sequence in training, and sequences in a block, which bounds memory.
WINDOW, BLOCK = 256, 2000
PREFIXES, SUFFIXES = range(3, 9), range(3, 6)


def normal(word: str) -> str:
    """A token without punctuation around it, in lower case."""
    return word.strip(punctuation).lower()


def stems(word: str) -> list[str]:
    """Of a normalised token: itself and its beginnings."""
    return [word, *(f"{word[:k]}*" for k in PREFIXES if k <= len(word))] if word else []


def shape(token: str) -> str:
    """Of a token as written: its case, and whether it holds more than letters, or more than letters and digits."""
    case = "a" if token.islower() else "A" if token.isupper() else "Aa" if token.istitle() else "aA"
    return f"^{case}" if token.isalpha() else f"^{case}9" if token.isalnum() else f"^{case}."


def features(token: str) -> list[str]:
    """Of a token as written: its stems, endings and shape."""
    word = normal(token)
    return [*stems(word), *(f"*{word[-k:]}" for k in SUFFIXES if k < len(word)), shape(token)]


def beside(token: str) -> list[str]:
    """What a token tells about the ones before and behind it."""
    word = normal(token)
    return [word, f"{word[:4]}*"] if word else []


def markers(texts: list[str], labels: np.ndarray, precision: float = 0.85) -> tuple[list[str], list[str]]:
    """Stems of which toxic documents make up at least ``precision`` of the documents that have them; and all features that are as frequent.

    They must be in enough toxic documents that, were labels dealt at random, ten stems would be expected to pass. Copies
    mustn't make up the number, so documents count once for each least hash of their tokens, which near copies mostly share.
    """
    kinds: dict[str, set[int]] = {}
    of = _Remembered(features)
    for text, y in zip(texts, labels, strict=True):
        if y and text.strip():
            words = set(text.split())
            kind = min(xxhash.xxh3_64_intdigest(normal(w)) for w in words)
            for f in {f for w in words for f in of(w)}:
                kinds.setdefault(f, set()).add(kind)
    n_stems = sum(f[0] not in "*^" for f in kinds)
    least = max(2, np.ceil(np.log(10 / max(1, n_stems)) / np.log(np.clip(labels.mean(), 0.01, 0.9))))
    frequent = {f for f, k in kinds.items() if len(k) >= least}
    del kinds
    likely = {f for f in frequent if f[0] not in "*^"}
    of = _Remembered(lambda w: tuple(f for f in stems(normal(w)) if f in likely))
    toxic, clean = Counter(), Counter()
    for text, y in zip(texts, labels, strict=True):
        (toxic if y else clean).update({f for w in set(text.split()) for f in of(w)})
    return sorted(f for f in likely if toxic[f] >= precision * (toxic[f] + clean[f])), sorted(frequent)


class _Remembered:
    """A function of a token, remembered for so many tokens at a time."""

    def __init__(self, function, most: int = 200_000):
        self.function, self.most, self.known = function, most, {}

    def __call__(self, token: str):
        found = self.known.get(token)
        if found is None:
            found = self.function(token)
            if len(self.known) >= self.most:
                self.known.clear()
            if len(token) <= 40:
                self.known[token] = found
        return found


class _Incidence:
    """Which rows (distinct tokens) have which columns (features)."""

    def __init__(self, lists: Iterator[list[int]], columns: int):
        sizes, cols = array("i"), array("i")
        for found in lists:
            sizes.append(len(found))
            cols.extend(found)
        self.rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.cols = np.frombuffer(cols, np.int32) if cols else np.zeros(0, np.int32)
        self.shape = len(sizes), columns

    def of_rows(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weight[self.cols], self.shape[0])

    def of_columns(self, value: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, value[self.rows], self.shape[1])


class _Places:
    """Where the tokens of sequences lie in a table by time, the longest sequence first."""

    def __init__(self, sizes: list[int]):
        n = np.asarray(sizes, np.int64)
        order = np.argsort(-n, kind="stable")
        column = np.empty(len(n), np.int64)
        column[order] = np.arange(len(n))
        steps = int(n.max(initial=0))
        self.live = np.searchsorted(-n[order], -np.arange(steps), side="left")  # sequences longer than t
        starts = np.cumsum(n) - n
        time = np.arange(int(n.sum())) - np.repeat(starts, n)
        self.flat = time * len(n) + np.repeat(column, n)
        self.inside = np.arange(len(n)) < self.live[:, None] if steps else np.zeros((0, len(n)), bool)

    def spread(self, field: np.ndarray) -> np.ndarray:
        out = np.zeros(self.inside.shape, field.dtype)
        out.ravel()[self.flat] = field
        return out

    def gather(self, table: np.ndarray) -> np.ndarray:
        return table.ravel()[self.flat]


class _Told(dict):
    """Numbers of tokens, and by number what a token's weights add up to: for itself, for the one behind it, for the one before it.

    Most distinct tokens are seen once, so the sums are made without making their features: those of beginnings and of endings are added up beforehand,
    and a beginning that no longer one follows ends the search.
    """

    def __init__(self, chain: "Chain"):
        super().__init__()
        self.own, self.behind, self.ahead = array("d"), array("d"), array("d")
        self.bias = float(chain.weight[-1])
        self.words, self.shapes, heads, tails, self.near_heads = {}, {}, {}, {}, {}
        for f, own, behind, ahead in zip(chain.index, chain.weight.tolist(), chain.behind.tolist(), chain.ahead.tolist(), strict=False):
            if f[0] == "^":
                self.shapes[f] = own
            elif f[0] == "*":
                tails[f[1:]] = own
            elif f[-1] == "*":
                heads[f[:-1]] = own
                self.near_heads[f[:-1]] = behind, ahead
            else:
                self.words[f] = own, behind, ahead
        self.lower = self.shapes.get("^a", 0.0)
        part = {x[:k] for x in heads for k in PREFIXES if k <= len(x)}
        self.heads = {x: sum(heads.get(x[:k], 0.0) for k in PREFIXES if k <= len(x)) for x in part}
        part = {x[-k:] for x in tails for k in SUFFIXES if k <= len(x)}
        self.tails = {x: sum(tails.get(x[-k:], 0.0) for k in SUFFIXES if k <= len(x)) for x in part}

    def __missing__(self, token: str) -> int:
        word, none = normal(token), (0.0, 0.0, 0.0)
        own, behind, ahead = self.words.get(word, none) if word else none
        if word:
            more, size, told, heads, tails = 0.0, len(word), 0.0, self.heads, self.tails
            for k in PREFIXES:
                if k > size or (told := heads.get(word[:k])) is None:
                    break
                more = told
            own += more
            more = 0.0
            for k in SUFFIXES:
                if k >= size or (told := tails.get(word[-k:])) is None:
                    break
                more = told
            own += more
            if near := self.near_heads.get(word[:4]):
                behind, ahead = behind + near[0], ahead + near[1]
        own += self.lower if token.islower() and token.isalpha() else self.shapes.get(shape(token), 0.0)
        number = len(self.own)
        self.own.append(own + self.bias)
        self.behind.append(behind)
        self.ahead.append(ahead)
        if len(token) <= 40:
            self[token] = number
        return number


class Chain:
    """Two tags. Weights of features for tag 1 against tag 0 (a token's own, its predecessor's, its successor's), of tag pairs, and of the first tag."""

    def __init__(self, names: list[str], marks: list[str] | None = None):
        """``marks``: the features that label a token of a toxic document; all stems among the names unless given."""
        self.index = {f: k for k, f in enumerate(names)}
        self.marks = set(names if marks is None else marks)
        self.weight = np.zeros(len(names) + 1)  # the last is every token's
        self.behind, self.ahead = np.zeros(len(names)), np.zeros(len(names))  # of the token before, of the one after
        self.pair = np.zeros((2, 2))
        self.begin = 0.0
        self.known: _Told | None = None
        self.final = np.zeros(3)

    def __getstate__(self):
        return self.__dict__ | {"known": None}

    def numbers(self, found: list[str]) -> list[int]:
        return [k for f in found if (k := self.index.get(f)) is not None]

    def emissions(self, words: list[str]) -> np.ndarray:
        """The log potential of tag 1 against tag 0 of each token."""
        return self.fields([words])[0]

    def fields(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The same for the tokens of several texts."""
        if self.known is None or len(self.known.own) > 300_000:
            self.known = _Told(self)
        sizes = np.array([len(words) for words in texts], np.int64)
        ends = np.cumsum(sizes)
        number = np.fromiter(map(self.known.__getitem__, joined.from_iterable(texts)), np.int64, int(sizes.sum()))
        own, behind, ahead = (np.frombuffer(x) for x in (self.known.own, self.known.behind, self.known.ahead))
        inner = np.ones(len(number), bool)  # has a token of its text before it
        inner[(ends - sizes)[sizes > 0]] = False
        field = own[number]
        field[1:] += behind[number[:-1]] * inner[1:]
        field[:-1] += ahead[number[1:]] * inner[1:]
        return np.split(field, ends[:-1]) if texts else []

    def marginals(self, emissions: list[np.ndarray], pairs: bool = False):
        """The chance of tag 1 for each token of each sequence; with ``pairs``, also expected counts of tag pairs."""
        at = _Places([len(e) for e in emissions])
        field = np.concatenate(emissions) if emissions else np.zeros(0)
        chance, counts, first = self.passes(at, field, pairs)
        cuts = np.cumsum([len(e) for e in emissions])[:-1]
        out = np.split(chance, cuts) if emissions else []
        return (out, counts, first) if pairs else out

    def passes(self, at: "_Places", field: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray | None, float]:
        """Forward and backward over sequences that lie behind each other in ``field``: chances, expected tag pairs, expected first tags."""
        em, t, live = np.exp(at.spread(field)), np.exp(self.pair), at.live
        ahead, back = np.zeros_like(em), np.ones_like(em)
        steps = len(em)
        if steps:
            ahead[0] = em[0] * np.exp(self.begin)
        for k in range(1, steps):
            m = live[k]
            r = ahead[k - 1, :m]
            ahead[k, :m] = em[k, :m] * (t[0, 1] + t[1, 1] * r) / (t[0, 0] + t[1, 0] * r)
        em *= back  # becomes what a token and those behind it say
        for k in range(steps - 2, -1, -1):
            m = live[k + 1]
            em[k + 1, :m] *= back[k + 1, :m]
            r = em[k + 1, :m]
            back[k, :m] = (t[1, 0] + t[1, 1] * r) / (t[0, 0] + t[0, 1] * r)
        odds = ahead * back
        chance = at.gather(odds / (1 + odds))
        if not pairs:
            return chance, None, 0.0
        first = float((odds[0] / (1 + odds[0])).sum()) if steps else 0.0
        a, b = ahead[:-1][at.inside[1:]], em[1:][at.inside[1:]]
        none, second, both = t[0, 0], t[0, 1] * b, t[1, 1] * a * b
        one = t[1, 0] * a
        mass = none + second + one + both
        return chance, np.array([[(none / mass).sum(), (second / mass).sum()], [(one / mass).sum(), (both / mass).sum()]]), first

    def fit(self, texts: list[str], labels: np.ndarray, rounds: int = 30, ridge: float = 1e-3) -> "Chain":
        """Fit the chain on every token of the texts, then the document's logistic function."""
        sample = Sample(self, texts, labels)
        if not len(sample.type):
            return self
        params = np.zeros(sample.size)
        params[sample.bias] = -3.0
        mean, square, scale = np.zeros_like(params), np.zeros_like(params), np.sqrt(sample.counts + 1.0)
        for step in range(1, rounds + 1):
            grad = sample.gradient(params)[0] / scale + ridge * params
            mean, square = 0.8 * mean + 0.2 * grad, 0.95 * square + 0.05 * grad**2
            params = params - 0.5 * (mean / (1 - 0.8**step)) / (np.sqrt(square / (1 - 0.95**step)) + 1e-8)
        sample.put(params)
        self.known = None
        del sample
        self._fit_final(self.summaries(texts), labels)
        return self

    def log_mass(self, emissions: list[np.ndarray]) -> float:
        """The logarithm of the sum over all taggings, added up over sequences."""
        out = 0.0
        for e in emissions:
            a = np.array([0.0, e[0] + self.begin])
            for x in e[1:]:
                a = np.logaddexp.reduce(a[:, None] + self.pair, axis=0) + np.array([0.0, x])
            out += np.logaddexp.reduce(a)
        return float(out)

    def _fit_final(self, x: np.ndarray, y: np.ndarray, rounds: int = 50) -> None:
        """Logistic regression by Newton's method, with a small ridge."""
        x = np.column_stack([np.ones(len(x)), x])
        w, ridge = np.zeros(3), np.array([1e-6, 0.1, 0.1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
            w = w - np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        self.final = w

    def tagged(self, texts: list[str]) -> list[np.ndarray]:
        """Marginals of all tokens of each text."""
        parts, of = [], []
        for k, e in enumerate(self.fields([text.split() for text in texts])):
            for a in range(0, max(len(e), 1), SEGMENT):
                low = max(0, a - CONTEXT)
                parts.append(e[low : a + SEGMENT + CONTEXT])
                of.append((k, a - low, min(SEGMENT, len(e) - a)))
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for (k, skip, n), p in zip(of, self.marginals(parts), strict=True):
            out[k].append(p[skip : skip + n])
        return [np.concatenate(p) for p in out]

    def summaries(self, texts: list[str]) -> np.ndarray:
        parts = [self.of_marginals(self.tagged(texts[k : k + 250])) for k in range(0, len(texts), 250)]
        return np.concatenate(parts) if parts else np.zeros((0, 2))

    @staticmethod
    def of_marginals(tagged: list[np.ndarray]) -> np.ndarray:
        return np.array([[np.log1p(p.sum()), p.max(initial=0)] for p in tagged]).reshape(len(tagged), 2)

    def scores(self, summaries: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.final[0] + summaries @ self.final[1:])))


class Sample:
    """Texts to fit a chain on, as numbers: the type of each token, its tag, and the features of each type."""

    def __init__(self, chain: Chain, texts: list[str], labels: np.ndarray, kind=np.float32):
        self.chain, self.kind, types, parts = chain, kind, {}, []
        for text in texts:
            words = text.split()
            parts.append(np.fromiter((types.setdefault(w, len(types)) for w in words), np.int32, len(words)))
        self.sizes = [min(WINDOW, len(p) - a) for p in parts for a in range(0, len(p), WINDOW)]
        lengths = [len(p) for p in parts]
        self.type = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        starts = np.cumsum(lengths) - lengths
        first = starts[np.array(lengths) > 0] if parts else []
        self.inner = np.ones(len(self.type), bool)  # has a token of its text before it
        self.inner[first] = False
        n = len(chain.index)
        self.own = _Incidence((chain.numbers(features(w)) for w in types), n)
        self.near = _Incidence((chain.numbers(beside(w)) for w in types), n)
        marked = np.array([any(f in chain.marks for f in stems(normal(w))) for w in types], bool)
        self.tag = (marked[self.type] & np.repeat(np.asarray(labels) > 0, lengths)).astype(kind) if types else np.zeros(0, kind)
        # Parameters: own weights, every token's, those of the token before and after, tag pairs, the first tag.
        self.bias, self.size = n, 3 * n + 6
        uses = np.bincount(self.type, minlength=len(types)).astype(float)
        near = self.near.of_columns(uses)
        self.counts = np.concatenate([self.own.of_columns(uses), [len(self.type)], near, near, np.full(4, len(self.type)), [len(self.sizes)]])
        # Blocks of sequences: where each begins and ends, its places, and the tag pairs and first tags that were seen.
        self.blocks, at = [], 0
        for k in range(0, len(self.sizes), BLOCK):
            sizes = self.sizes[k : k + BLOCK]
            tags = self.tag[at : at + sum(sizes)].astype(int)
            starts = np.cumsum(sizes) - sizes
            joined = np.ones(len(tags), bool)
            joined[starts] = False
            code = (2 * tags[:-1] + tags[1:])[joined[1:]]
            self.blocks.append((at, at + len(tags), sizes, np.bincount(code, minlength=4).reshape(2, 2), float(tags[starts].sum())))
            at += len(tags)

    def put(self, params: np.ndarray) -> None:
        n, c = self.bias, self.chain
        c.weight, c.behind, c.ahead = params[: n + 1].copy(), params[n + 1 : 2 * n + 1].copy(), params[2 * n + 1 : 3 * n + 1].copy()
        c.pair, c.begin = params[-5:-1].reshape(2, 2).copy(), float(params[-1])

    def gradient(self, params: np.ndarray, loss: bool = False) -> tuple[np.ndarray, float]:
        """Of the negative conditional log-likelihood of the tags (and that itself if asked for)."""
        self.put(params)
        c, n, kinds = self.chain, self.bias, self.own.shape[0]
        lend, borrow = self.near.of_rows(c.behind), self.near.of_rows(c.ahead)
        lend, borrow = lend.astype(self.kind), borrow.astype(self.kind)
        field = (self.own.of_rows(c.weight[:-1]) + c.weight[-1]).astype(self.kind)[self.type]
        field[1:] += lend[self.type[:-1]] * self.inner[1:]
        field[:-1] += borrow[self.type[1:]] * self.inner[1:]
        gap, pairs, first, total = np.empty_like(field), np.zeros((2, 2)), 0.0, 0.0
        for low, high, sizes, seen, opened in self.blocks:
            part, tag = field[low:high], self.tag[low:high]
            chance, expected, begun = c.passes(_Places(sizes), part)
            gap[low:high] = chance - tag
            pairs += expected - seen
            first += begun - opened
            if loss:
                total += c.log_mass(np.split(part, np.cumsum(sizes)[:-1])) - (part * tag).sum() - (seen * c.pair).sum() - opened * c.begin
        own = self.own.of_columns(np.bincount(self.type, gap, kinds))
        inner = self.inner[1:]
        behind = self.near.of_columns(np.bincount(self.type[:-1], gap[1:] * inner, kinds))
        ahead = self.near.of_columns(np.bincount(self.type[1:], gap[:-1] * inner, kinds))
        return np.concatenate([own, [gap.sum()], behind, ahead, pairs.ravel(), [first]]), total


def spans(text: str, chances: np.ndarray, least: float = 0.5) -> list[tuple[int, int]]:
    """Character spans of the runs of toxic tokens."""
    out, at, before = [], 0, False
    for word, p in zip(text.split(), chances, strict=True):
        at = text.index(word, at)
        if p >= least:
            out[-1:] = [(out[-1][0], at + len(word))] if before else [*out[-1:], (at, at + len(word))]
        before = p >= least
        at += len(word)
    return out


def fit_chain(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", fit_rows: int = 8000, fit_bytes: int = FIT_BYTES) -> Chain | float:
    """A fitted chain; with labels of one kind only (or none) the constant score to give."""
    texts, y = labelled_sample(docs, labels, label_col, fit_rows, fit_bytes)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.0
    marks, names = markers(texts, y)
    return Chain(names, marks).fit(texts, y)


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", threshold: float = 0.7, fit_rows: int = 8000, fit_bytes: int = FIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and spans (character offsets of what was tagged), one row per row of ``docs``.

    The chain is fitted on all of at most ``fit_rows`` labelled texts that aren't held out, of ``fit_bytes`` bytes at most. Null text counts as empty; an empty text has no toxic token
    and gets the score of that. Repeated rows are scored alike; a row without identifier is scored and isn't held out; nothing else
    can tie. Texts of any length are tagged whole. Without labels every score is 0, with labels of one kind only it is that kind. An empty table gives an empty result. Only
    the text is looked at; other columns are ignored.
    """
    small_batches(docs.sparkSession, 1000)
    chain = fit_chain(docs, labels, label_col, fit_rows, fit_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b.decode("utf-8", "replace") for b in batch.column(1).to_pylist()]
            if isinstance(chain, float):
                score, found = np.full(len(texts), chain), [[] for _ in texts]
            else:
                tagged = chain.tagged(texts)
                score = chain.scores(chain.of_marginals(tagged))
                found = [spans(t, p) if p.max(initial=0) >= 0.5 else [] for t, p in zip(texts, tagged, strict=True)]
            pairs = pa.array([[{"start": a, "end": b} for a, b in s] for s in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pairs], ["doc_id", "score", "spans"])

    out = text_frame(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, spans array<struct<start int, end int>>")
    return out.select("doc_id", held_out_column("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
