import random
import re

import numpy as np
import pytest

from likenet.llm import common, near_dedup
from likenet.llm.near_dedup import likely, merge_sketches, near_groups, shingle_set, sketches


def brute(rows, width, percent=80):
    def shingles(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()

    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(sets[k]), least.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(5, 120))] for _ in range(n // 6)]
    rows = []
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(text) // 12))):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i, " ".join(text)))
    rng.shuffle(rows)
    return rows


EDGES = [(1000, None), (1001, ""), (1002, " \n"), (1003, "One"), (1004, "one "), (1005, "one two"), (1006, "ONE TWO"), (1007, "É x"), (1008, "é x"), (1009, "go " * 5000), (1003, "One"), (None, "one two"), (None, "nobody else"), *[(None, "nobody else at all")] * 30, *[(1011, f"again and again {i}") for i in range(20)]]


@pytest.mark.parametrize("width", [2, 5])
def test_against_brute_force(spark, width):
    rows = corpus(width, 300) + EDGES
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, node string, label int").repartition(6)
    got = near_groups(docs, width=width).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("block", [4, 512])
def test_what_leaders_do_not_link(spark, monkeypatch, block):
    """A large group in which hardly any pair but neighbours is linked."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(60)] + [(100 + i, " ".join(words[:50] + [f"u{i}_{k}" for k in range(20)])) for i in range(30)]
    random.Random(3).shuffle(rows)
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 2))


def test_empty_table(spark):
    assert near_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sketches_are_mergeable_and_estimate():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**63, (2, 500)).astype(np.uint64)
    common = rng.integers(0, 2**63, 4000).astype(np.uint64)
    x, y = np.unique(np.concatenate([a, common])), np.unique(np.concatenate([b, common]))
    m = 4096
    s = sketches([x, y, np.union1d(x, y)], m)
    assert (merge_sketches(s[0], s[1]) == s[2]).all()
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.03
    up, down = (s[0] > s[1]).sum(), (s[0] < s[1]).sum()
    at = lambda j: near_dedup.log_likelihood(up, down, m - up - down, len(x), len(y), j)
    assert abs(max(np.linspace(0, 1, 201), key=at) - 0.8) < 0.03


def test_unrelated_sets_do_not_meet():
    """How often registers of sets without common elements agree; a bucket needs ROWS of them, and there are BANDS of those."""
    rng = np.random.default_rng(2)
    s = sketches([rng.integers(0, 2**63, 300).astype(np.uint64) for _ in range(400)], near_dedup.BANDS * near_dedup.ROWS)
    agree = np.mean([(s[i] == s[j]).mean() for i in range(200) for j in range(200, 400)])
    assert agree < 1 / 1000 and near_dedup.BANDS * agree**near_dedup.ROWS < 1e-8
    # Nor do sets that share a fiftieth, or not often.
    assert near_dedup.BANDS * (0.02 + agree) ** near_dedup.ROWS < 1e-8
    # And those that are similar enough do.
    assert (1 - 0.8**near_dedup.ROWS) ** near_dedup.BANDS < 1e-7


def test_hot_labels_and_sets(spark, monkeypatch):
    """Groups that are hot keys, with texts moved and not moved."""
    monkeypatch.setattr(common, "hot_rows", lambda n: 3)
    rows = corpus(9, 120) + EDGES
    monkeypatch.setattr(near_dedup, "BROADCAST_TEXTS", 0)
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width=2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 2)


def test_likelihood_keeps_links_and_drops_others():
    rng = np.random.default_rng(1)
    m, n = near_dedup.BANDS * near_dedup.ROWS, 900.0
    for similarity, low, high in ((0.8, 1.0, 1.0), (0.2, 0.0, 0.01)):
        p = (1 - similarity) / 2
        up, down, same = rng.multinomial(m, [p, p, similarity], 20_000).T
        assert low <= likely(up, down, same, np.full(len(up), n), np.full(len(up), n), 80).mean() <= high


def test_shingles():
    assert len(shingle_set(b"a b A B a b", 2)) == 2 and len(shingle_set(b"x", 2)) == 1 and len(shingle_set(b" ", 2)) == 0
    assert shingle_set(b"x", 2)[0] not in shingle_set(b"x x", 2)
