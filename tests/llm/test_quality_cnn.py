import random
import zlib

import numpy as np

from likenet.llm.quality_cnn import CHUNK, LAGS, OVERLAP, RUN, STRIDE, WIDTH, ByteNetwork, chunk_texts, echoes, quality


def test_chunks_cover_every_byte():
    for n in (0, 1, CHUNK - 1, CHUNK, CHUNK + 1, 2 * CHUNK - OVERLAP, 2 * CHUNK - OVERLAP + 1, 5000):
        text = np.random.default_rng(n).integers(1, 255, n).astype(np.uint8).tobytes()
        chunks, counts = chunk_texts([text, b"x"])
        assert counts.tolist() == [len(chunks) - 1, 1]
        whole = chunks[0].tobytes() + b"".join(c[OVERLAP:].tobytes() for c in chunks[1:-1])
        assert whole.rstrip(b"\0") == text and len(whole) - n <= CHUNK


def test_echoes_against_brute_force():
    rng = random.Random(1)
    row = [rng.choice(b"abc") for _ in range(100)] + list(b"word " * 30) + [0] * 60
    row = np.array(row + list(b"z" * (CHUNK - len(row))), np.uint8)
    got = echoes(row[None])[0]
    for t in range(CHUNK):
        want = any(t - RUN + 1 - lag >= 0 and all(row[t - k] == row[t - k - lag] > 0 for k in range(RUN)) for lag in LAGS)
        assert got[t] == want


def test_scores_against_brute_force():
    net = ByteNetwork(filters=3, vector=2, seed=4)
    net.bias[:] = [0.1, -0.2, 0.3]
    texts = [b"", b"short", bytes(np.random.default_rng(0).integers(1, 255, 1500).astype(np.uint8))]
    for text, got in zip(texts, net.scores(texts)):
        pooled = []
        for chunk in chunk_texts([text])[0]:
            x = np.column_stack([net.vectors[chunk], echoes(chunk[None])[0]])
            at = [np.maximum(x[p : p + WIDTH].ravel() @ net.kernel + net.bias, 0) for p in range(0, CHUNK - WIDTH + 1, STRIDE)]
            pooled.append(np.max(at, axis=0))
        f = np.concatenate([np.max(pooled, axis=0), np.mean(pooled, axis=0)])
        assert np.isclose(got, 1 / (1 + np.exp(-(f @ net.out + net.offset[0]))), atol=1e-5)


def test_gradients_against_differences():
    net = ByteNetwork(filters=3, vector=2, seed=6)
    for name in ("vectors", "kernel", "bias", "out", "offset"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    texts = [b"some text " * 80, b"other, shorter", bytes(range(32, 120)) * 9]
    chunks, counts = chunk_texts(texts)
    labels = np.array([1, 0, 1])
    grads, _ = net.gradients(chunks, counts, labels)
    rng = np.random.default_rng(2)
    for part, grad in zip(net._parts(), grads):
        for _ in range(6):
            k = tuple(rng.integers(0, n) for n in part.shape)
            part[k] += 1e-3
            up = net.gradients(chunks, counts, labels)[1]
            part[k] -= 2e-3
            down = net.gradients(chunks, counts, labels)[1]
            part[k] += 1e-3
            assert abs((up - down) / 2e-3 - grad[k]) < 2e-3


def test_training_takes_every_chunk(monkeypatch):
    """What each step gets are whole texts, long ones too; and chunks in blocks give the gradients of all at once."""
    seen = []
    net = ByteNetwork(filters=2, vector=2)
    real = net.gradients
    monkeypatch.setattr(net, "gradients", lambda chunks, counts, labels: seen.append((len(chunks), counts.sum())) or real(chunks, counts, labels))
    texts = [b"long " * 4000, b"short", b"", b"x" * 9000]
    net.fit(texts, np.array([1, 0, 0, 1]), epochs=2, batch=2, least_steps=1)
    assert sum(n for n, _ in seen) == 2 * len(chunk_texts(texts)[0]) and all(n == m for n, m in seen)
    long = np.random.default_rng(1).integers(1, 255, 1500 * (CHUNK - OVERLAP)).astype(np.uint8).tobytes()
    chunks, counts = chunk_texts([long, b"other"])
    grads, _ = net.gradients(chunks, counts, np.array([1, 0]))
    assert len(chunks) > 1024 and all(np.isfinite(g).all() for g in grads) and abs(grads[1]).sum() > 0


def sample(n):
    rng, rows = random.Random(5), []
    for i in range(n):
        y = int(rng.random() < 0.7)
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(30, 200))]
        rows.append((i, " ".join(words if y else [w + rng.choice(["###", "$$"]) for w in words]), y))
    return rows


def test_held_out_accuracy(spark):
    rows = sample(600)
    extra = [(9000, None, 0.0), (9001, "", 0.0), (None, "abc def", 0.0), (9002, "abc### " * 20_000, 0.0), (3, rows[3][1], 0.0)]
    docs = spark.createDataFrame([(i, t, 0.1) for i, t, _ in rows] + extra, "doc_id long, text string, score double").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None)], "doc_id long, quality int")
    got = quality(docs, labels).collect()
    assert len(got) == len(rows) + 5
    truth = {i: y for i, _, y in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[9002].predicted == 0 and by[9000].score == by[9001].score


def test_few_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality(docs, none).collect()} == {0.5}
    assert quality(docs.limit(0), none).collect() == []
