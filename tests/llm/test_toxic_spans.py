import itertools
import random
import zlib

import numpy as np
import pytest

from likenet.llm.labelled import labelled_sample
from likenet.llm.toxic_spans import CONTEXT, SEGMENT, WINDOW, Chain, Sample, markers, spans, toxicity


def sample(n, seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        text, y = [rng.choice(words) for _ in range(rng.randint(20, 60))], int(rng.random() < 0.3)
        for _ in range(3 * y):
            text[rng.randrange(len(text))] = rng.choice(["vile", "foulness", "foulest!", "FOULER"])
        rows.append((i, " ".join(text), y))
    return rows


def chain():
    c = Chain(["bad", "worse"])
    c.weight, c.pair, c.begin = np.array([2.0, 3.0, -1.0]), np.array([[0.5, -0.7], [-0.2, 0.9]]), -0.4
    return c


def test_marginals_against_all_taggings():
    c, seqs = chain(), [["bad", "x", "worse", "y"], ["x"], ["worse", "bad"], ["a", "b", "bad", "c", "d", "worse"]]
    got, pairs, first = c.marginals([c.emissions(s) for s in seqs], pairs=True)
    want_pairs, want_first = np.zeros((2, 2)), 0.0
    for s, p in zip(seqs, got):
        e, mass, total = c.emissions(s), np.zeros(len(s)), 0.0
        for tags in itertools.product((0, 1), repeat=len(s)):
            w = np.exp(np.dot(e, tags) + c.begin * tags[0] + sum(c.pair[a, b] for a, b in zip(tags, tags[1:])))
            total += w
            mass += w * np.array(tags)
        assert np.allclose(p, mass / total)
        for tags in itertools.product((0, 1), repeat=len(s)):
            w = np.exp(np.dot(e, tags) + c.begin * tags[0] + sum(c.pair[a, b] for a, b in zip(tags, tags[1:]))) / total
            want_first += w * tags[0]
            for a, b in zip(tags, tags[1:]):
                want_pairs[a, b] += w
    assert np.allclose(pairs, want_pairs) and np.isclose(first, want_first)


def test_segments_make_no_difference():
    c, rng = chain(), random.Random(3)
    words = [rng.choice(["bad", "x", "y", "worse"]) for _ in range(2 * SEGMENT + 3 * CONTEXT)]
    cut = c.tagged([" ".join(words), "", "bad"])
    assert np.allclose(cut[0], c.marginals([c.emissions(words)])[0], atol=1e-9) and len(cut[1]) == 0 and len(cut[2]) == 1


def test_markers_are_stems_of_toxic_words():
    rows = sample(600)
    found, frequent = markers([r[1] for r in rows], np.array([r[2] for r in rows]))
    assert {"vile", "foul*"} <= set(found) <= set(frequent) and not any(f.startswith("w1") for f in found)
    assert "^a" in frequent and any(f[0] == "*" for f in frequent)


def small_sample(kind=np.float64):
    """Texts of one and of several windows, with marked tokens far behind in both kinds of documents."""
    texts = ["x bad y worse", "", "Bad", "x y " * (WINDOW // 2) + "z bad worse", "q " * (2 * WINDOW + 5) + "bad end", "worse worse Odd-one 9"]
    names = ["bad", "worse", "wor*", "*rse", "^A", "^aA.", "x", "q", "x*"]
    return Sample(Chain(names, ["bad", "worse"]), texts, np.array([1, 0, 1, 1, 0, 1]), kind), texts


def test_training_sees_every_token():
    s, texts = small_sample()
    words = [w for t in texts for w in t.split()]
    assert sum(s.sizes) == len(s.type) == len(words) and s.counts[s.bias] == len(words)
    # A marked token is toxic in a toxic document, however far behind it is, and clean in a clean one.
    want = [float(y and w.lower() in ("bad", "worse")) for t, y in zip(texts, [1, 0, 1, 1, 0, 1]) for w in t.split()]
    assert s.tag.tolist() == want and s.tag[s.type == s.type[1]].sum() == 2


def test_gradient_against_differences():
    s, _ = small_sample()
    rng = np.random.default_rng(3)
    params = rng.normal(0, 0.5, s.size)
    grad, _ = s.gradient(params)
    for k in range(s.size):
        step = np.zeros(s.size)
        step[k] = 1e-5
        slope = (s.gradient(params + step, loss=True)[1] - s.gradient(params - step, loss=True)[1]) / 2e-5
        assert abs(slope - grad[k]) < 1e-4, k
    coarse, _ = small_sample(np.float32)
    assert np.allclose(coarse.gradient(params)[0], grad, rtol=1e-3, atol=1e-3)


def test_emissions_of_a_text_are_those_of_training():
    s, texts = small_sample()
    params = np.random.default_rng(4).normal(0, 0.5, s.size)
    s.put(params)
    e = np.concatenate([s.chain.emissions(t.split()) for t in texts])
    c = s.chain
    lend, borrow = s.near.of_rows(c.behind), s.near.of_rows(c.ahead)
    field = (s.own.of_rows(c.weight[:-1]) + c.weight[-1])[s.type]
    field[1:] += lend[s.type[:-1]] * s.inner[1:]
    field[:-1] += borrow[s.type[1:]] * s.inner[1:]
    assert np.allclose(e, field)


def test_sample_is_bounded(spark):
    twice = next(i for i in range(1, 40) if zlib.crc32(str(i).encode()) % 3 != 1)
    docs = spark.createDataFrame([(i, "x" * (10 * i), "?") for i in range(40)] + [(twice, "a", "?"), (None, "n", "?")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    held = {i for i in range(40) if zlib.crc32(str(i).encode()) % 3 == 1}
    texts, y = labelled_sample(docs, labels, "toxic", 1000)
    assert len(texts) == 40 - len(held) and "a" in texts and set(y.tolist()) == {0, 1}
    texts, _ = labelled_sample(docs, labels, "toxic", 1000, most_bytes=500)
    assert 0 < sum(map(len, texts)) <= 500
    assert len(labelled_sample(docs, labels, "toxic", 7)[0]) == 7


def test_held_out_accuracy_and_spans(spark):
    rows = sample(900)
    docs = spark.createDataFrame([(i, t, "en", 0.5) for i, t, _ in rows] + [(9000, None, "x", 0.0), (9001, "", "x", 0.0), (None, "vile vile", "x", 0.0), (9002, "word " * 20_000 + "vile foulest", "x", 0.0), (3, rows[3][1], "x", 0.0)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity(docs.repartition(3), labels).collect()
    assert len(got) == len(rows) + 5
    truth, texts = {i: y for i, _, y in rows}, {i: t for i, t, _ in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[9002].predicted == 1 and by[None].predicted == 1 and by[9000].score == by[9001].score < 0.5
    for r in held[:50]:
        if r.predicted:
            assert all("vile" in texts[r.doc_id][s.start : s.end] or "foul" in texts[r.doc_id][s.start : s.end].lower() for s in r.spans)


@pytest.mark.parametrize(("labels", "score"), [([], 0.0), ([(1, 0)], 0.0), ([(1, 1), (2, 1)], 1.0)])
def test_few_labels(spark, labels, score):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    told = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    got = toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert {r.score for r in got} == {score if told else 0.0}
    assert toxicity(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).collect() == []


def test_spans():
    assert spans("a bad  bad b bad", np.array([0, 0.9, 0.8, 0, 0.5])) == [(2, 10), (13, 16)]


def test_sums_of_weights_make_no_features(monkeypatch):
    """New tokens, which most distinct ones are, get what their features add up to without a list of features for each."""
    import likenet.llm.toxic_spans as module

    rng = random.Random(8)
    tokens = ["".join(rng.choices("abcAB9.*^-é", k=rng.randint(1, 12))) for _ in range(3000)] + ["...", "x" * 60, "ab", "abc", "Abc", "12"]
    names = sorted({f for w in tokens for f in module.features(w) if rng.random() < 0.3})
    c = Chain(names)
    c.weight, c.behind, c.ahead = (np.array([rng.gauss(0, 1) for _ in range(len(names) + k)]) for k in (1, 0, 0))
    lines, want = [tokens[k : k + 7] for k in range(0, len(tokens), 7)] + [[], tokens[:1]], []
    for line in lines:
        own = [c.weight[-1] + c.weight[c.numbers(module.features(w))].sum() for w in line]
        near = [c.numbers(module.beside(w)) for w in line]
        for k in range(len(line)):
            own[k] += c.behind[near[k - 1]].sum() * (k > 0) + (c.ahead[near[k + 1]].sum() if k + 1 < len(line) else 0.0)
        want.append(own)
    monkeypatch.setattr(module, "features", None)
    for _ in range(2):
        assert all(np.allclose(a, b) for a, b in zip(c.fields(lines), want, strict=True))
    assert np.allclose(c.emissions(lines[0]), want[0])
