"""Quality by a byte-level convolutional network, in numpy.

A text's UTF-8 bytes are cut into chunks that overlap, from the first byte to the last. In a chunk, every byte is a learned vector and one
more input says whether the last bytes repeat those a few places earlier; learned filters run over both, and each filter's
greatest response in the chunk is kept. The greatest and the mean of these over all chunks of the document are combined into
one probability.

Training is plain back-propagation with Adam over every chunk of the sample's texts; through a maximum only the place that won gets a gradient.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bodies, held_out_column, small_batches, text_frame
from .labelled import FIT_BYTES, labelled_sample

CHUNK, OVERLAP = 512, 64
WIDTH, STRIDE = 8, 2
LAGS, RUN = range(1, 17), 8


def chunk_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of all texts, (n, CHUNK) of bytes padded with zeros, and the number of chunks of each text.

    A text has at least one chunk; each further one begins OVERLAP bytes before the last one ended.
    """
    step = CHUNK - OVERLAP
    counts = [1 + max(0, -(-(len(t) - CHUNK) // step)) for t in texts]
    out = np.zeros((sum(counts), CHUNK), np.uint8)
    row = 0
    for text, n in zip(texts, counts, strict=True):
        raw = np.frombuffer(text, np.uint8)
        for k in range(n):
            part = raw[k * step : k * step + CHUNK]
            out[row, : len(part)] = part
            row += 1
    return out, np.array(counts)


def echoes(chunks: np.ndarray) -> np.ndarray:
    """1 where the RUN bytes that end here repeat those some LAGS places earlier."""
    out = np.zeros(chunks.shape, bool)
    for lag in LAGS:
        same = (chunks[:, lag:] == chunks[:, :-lag]) & (chunks[:, lag:] > 0)
        run = 1
        while run < RUN:
            same = same[:, run:] & same[:, :-run]
            run *= 2
        out[:, lag + RUN - 1 :] |= same
    return out


class ByteNetwork:
    def __init__(self, filters: int = 16, vector: int = 7, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.filters, self.channels = filters, vector + 1
        self.vectors = rng.normal(0, 0.5, (256, vector)).astype(np.float32)
        self.kernel = rng.normal(0, (WIDTH * self.channels) ** -0.5, (WIDTH * self.channels, filters)).astype(np.float32)
        self.bias = np.zeros(filters, np.float32)
        self.out = rng.normal(0, 0.1, 2 * filters).astype(np.float32)
        self.offset = np.zeros(1, np.float32)
        self.constant: float | None = None

    def _parts(self) -> list[np.ndarray]:
        return [self.vectors, self.kernel, self.bias, self.out, self.offset]

    def _patches(self, chunks: np.ndarray) -> np.ndarray:
        """What each filter sees: (chunks, places, WIDTH * channels)."""
        x = np.empty((*chunks.shape, self.channels), np.float32)
        x[:, :, :-1] = self.vectors[chunks]
        x[:, :, -1] = echoes(chunks)
        places = (CHUNK - WIDTH) // STRIDE + 1
        a, b, c = x.strides
        return np.lib.stride_tricks.as_strided(x, (len(chunks), places, WIDTH * self.channels), (a, STRIDE * b, c))

    def _pool(self, chunks: np.ndarray, at_once: int = 64):
        """Each filter's greatest response in each chunk, where it is, and what it saw there is left to ``_seen``."""
        best = np.empty((len(chunks), self.filters), np.float32)
        place = np.empty((len(chunks), self.filters), np.int64)
        for k in range(0, len(chunks), at_once):
            patches = self._patches(chunks[k : k + at_once])
            response = (patches.reshape(-1, patches.shape[2]) @ self.kernel).reshape(len(patches), -1, self.filters)
            place[k : k + at_once] = response.argmax(axis=1)
            best[k : k + at_once] = response.max(axis=1)
        return np.maximum(best + self.bias, 0), place

    def _seen(self, chunks, seen, chunk, window) -> np.ndarray:
        return np.concatenate([self.vectors[seen], echoes(chunks)[chunk[:, None], window][:, :, None].astype(np.float32)], axis=2)

    def _combine(self, pooled: np.ndarray, counts: np.ndarray):
        first = np.cumsum(counts) - counts
        top = np.maximum.reduceat(pooled, first, axis=0)
        mean = np.add.reduceat(pooled, first, axis=0) / counts[:, None]
        features = np.concatenate([top, mean], axis=1)
        return features, top, 1 / (1 + np.exp(-np.clip(features @ self.out + self.offset, -30, 30)))

    def scores(self, texts: list[bytes], at_once: int = 1 << 20) -> np.ndarray:
        """The probability of label 1 of each whole text; texts are chunked together up to ``at_once`` bytes."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out, k = np.empty(len(texts)), 0
        while k < len(texts):
            end, filled = k + 1, len(texts[k])
            while end < len(texts) and filled + len(texts[end]) <= at_once:
                filled += len(texts[end])
                end += 1
            chunks, counts = chunk_texts(texts[k:end])
            out[k:end] = self._combine(self._pool(chunks)[0], counts)[2]
            k = end
        return out

    def gradients(self, chunks: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> tuple[list[np.ndarray], float]:
        pooled, place = self._pool(chunks)
        features, top, p = self._combine(pooled, counts)
        error = ((p - labels) / len(labels)).astype(np.float32)
        g_out, g_offset = features.T @ error, error.sum(keepdims=True)
        back = error[:, None] * self.out[None, :]
        of = np.repeat(np.arange(len(counts)), counts)
        winners = pooled == top[of]
        ties = np.add.reduceat(winners, np.cumsum(counts) - counts, axis=0, dtype=np.float32)
        g_pool = back[of, self.filters :] / counts[of, None] + winners * back[of, : self.filters] / ties[of]
        g_pool = (g_pool * (pooled > 0)).astype(np.float32)
        g_kernel, g_vectors, g_bias = np.zeros_like(self.kernel), np.zeros_like(self.vectors), np.zeros_like(self.bias)
        for k in range(0, len(chunks), 1024):  # so many chunks at once, for a text may have any number of them
            part, weights = chunks[k : k + 1024], g_pool[k : k + 1024]
            chunk, which = np.nonzero(weights)
            g = weights[chunk, which]
            window = (place[k : k + 1024][chunk, which] * STRIDE)[:, None] + np.arange(WIDTH)
            seen = part[chunk[:, None], window]
            x = self._seen(part, seen, chunk, window)
            for f in range(self.filters):
                mine = which == f
                g_kernel[:, f] += x[mine].reshape(-1, WIDTH * self.channels).T @ g[mine]
            g_bias += np.bincount(which, g, self.filters).astype(np.float32)
            g_x = (g[:, None] * self.kernel[:, which].T).reshape(-1, WIDTH, self.channels)[:, :, : self.vectors.shape[1]]
            letter, width = seen.ravel(), self.vectors.shape[1]
            for c in range(width):
                g_vectors[:, c] += np.bincount(letter, g_x[:, :, c].ravel(), 256)
        loss = float(-np.mean(np.log(np.where(labels > 0, p, 1 - p) + 1e-9)))
        return [g_vectors, g_kernel, g_bias, g_out, g_offset], loss

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 2, least_steps: int = 360) -> "ByteNetwork":
        """Every epoch goes over every chunk of every text. Of few texts there are more epochs, for ``least_steps`` steps in all."""
        if len(set(labels.tolist())) < 2:
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return self
        rng = np.random.default_rng(seed)
        mean, square = ([np.zeros_like(p) for p in self._parts()] for _ in range(2))
        per_epoch = -(-len(texts) // batch)
        epochs = max(epochs, -(-least_steps // per_epoch))
        steps, total = 0, epochs * per_epoch
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for k in range(0, len(order), batch):
                rows = order[k : k + batch]
                grads, _ = self.gradients(*chunk_texts([texts[i] for i in rows]), labels[rows])
                steps += 1
                now = rate * (1 - 0.9 * steps / total)
                for part, grad, m, v in zip(self._parts(), grads, mean, square, strict=True):
                    m += 0.1 * (grad - m)
                    v += 0.01 * (grad**2 - v)
                    part -= now * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-7)
        return self


def quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = 0.5, fit_rows: int = 3000, fit_bytes: int = FIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted, one row per row of ``docs``.

    The network is fitted on all of at most ``fit_rows`` labelled texts that aren't held out, of ``fit_bytes`` bytes at most. Null text counts as empty: one chunk of zeros, with the score that
    gives. Repeated rows are scored alike; a row without identifier is scored and isn't held out; nothing else can tie. Texts of any length are scored whole.
    Without labels every score is 0.5, with labels of one kind only it is that kind. An empty table gives an empty result.
    Only the text is looked at; other columns are ignored.
    """
    small_batches(docs.sparkSession, 1000)
    texts, y = labelled_sample(docs, labels, label_col, fit_rows, fit_bytes)
    network = ByteNetwork().fit([t.encode() for t in texts], y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.scores(bodies(batch)), pa.float64())], ["doc_id", "score"])

    out = text_frame(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out_column("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
