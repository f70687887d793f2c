import hashlib
import random

import numpy as np
import pytest

from likenet.llm.substring_dedup import AnchorFinder, common_prefix, longest_factors, repeated_windows, substring_dedup


def brute(rows, length, keep):
    """(doc_id, n_bytes, n_removed, n_spans, kept sha) of each row, sorted."""
    seen = {}
    first = {}
    for k, (i, t) in enumerate(rows):
        data = (t or "").encode()
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            seen[w] = seen.get(w, 0) + 1
            at = (-1 if i is None else i, p)
            first[w] = min(at, first.get(w, at))
    out = []
    for i, t in rows:
        data = (t or "").encode()
        hit = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if seen[w] > 1 and (keep == "none" or first[w] != (-1 if i is None else i, p)):
                hit[p : p + length] = True
        left = bytes(b for b, h in zip(data, hit) if not h)
        spans = int(hit[0]) + int((hit[1:] & ~hit[:-1]).sum())
        out.append((i, len(data), len(data) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n, length):
    rng = random.Random(seed)
    make = lambda k: "".join(rng.choice("abcdé 東\n") for _ in range(k))
    passages = [make(k) for k in (length // 2, length - 1, length, length + 1, 2 * length, 5 * length)] + ["ab" * length, "x" * (3 * length)]
    rows = []
    for i in range(n):
        text = make(rng.randint(0, 2 * length))
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(passages)
            a = rng.randint(0, len(part) // 3)
            text += part[a : len(part) - rng.randint(0, len(part) // 3)] + make(rng.randint(0, length))
        rows.append((i, text))
    rows += [(n, rows[3][1]), (n + 1, None), (n + 2, ""), (n + 3, "short"), (n + 4, "short"), (n + 5, "y" * length), (None, rows[5][1] + "q")]
    return rows


@pytest.mark.parametrize(("length", "keep", "most"), [(40, "none", 20_000), (64, "first", 20_000), (200, "none", 20_000), (48, "none", 3), (48, "first", 3)])
def test_against_brute_force(spark, length, keep, most):
    rows = corpus(length, 120, length)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, doc string, check int").repartition(5)
    got = substring_dedup(docs, length, keep, most_classes=most, with_text=True).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute(rows, length, keep)


def test_repeated_rows(spark):
    text = "".join(random.Random(1).choices("abcdef", k=500))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text[100:350])], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup(docs, 200).collect()) == [(1, 500), (1, 500), (2, 250)]
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup(docs, 200, "first").collect()) == [(1, 0), (1, 0), (2, 250)]


def test_one_identifier_with_two_texts(spark):
    text = "".join(random.Random(2).choices("abcdef", k=500))
    docs = spark.createDataFrame([(1, text), (1, "zzz" + text[:250] + "!"), (1, "other")], "doc_id long, text string")
    assert sorted((r.n_bytes, r.n_removed) for r in substring_dedup(docs, 200).collect()) == [(5, 0), (254, 250), (500, 250)]


def test_carried_columns_and_cut_characters(spark):
    text = "é" * 300
    docs = spark.createDataFrame([(1, "a" + text, "n"), (2, "b" + text, "m")], "doc_id int, text string, body string")
    got = substring_dedup(docs, 201, carry=("body", "doc_id"), with_text=True).select("doc_id", "body", "kept_text").collect()
    assert sorted(map(tuple, got)) == [(1, "n", "a"), (2, "m", "b")]


@pytest.mark.parametrize("keep", ["none", "first"])
def test_empty_table(spark, keep):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string"), keep=keep).collect() == []


def test_every_window_has_an_anchor_of_its_own_choice():
    rng = random.Random(4)
    for alphabet in ("ab", "abcdefgh", "a"):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))).encode() for _ in range(20)]
        of, place, gram, _ = AnchorFinder(50)(texts)
        for k, text in enumerate(texts):
            at = {int(p): int(g) for o, p, g in zip(of, place, gram) if o == k}
            alone = dict(zip(*(x.tolist() for x in AnchorFinder(50)([text])[1:3])))
            assert at == alone
            for p in range(len(text) - 49):
                assert any(p <= q <= p + 18 for q in at)


def test_longest_factors():
    rng = random.Random(6)
    for _ in range(50):
        items = sorted(bytes(rng.choice(b"ab") for _ in range(6)) for _ in range(rng.randint(2, 9)))
        places = rng.sample(range(99), len(items))
        prefixes = [common_prefix(a, b) for a, b in zip(items, items[1:])]
        want = [max([common_prefix(a, b) for j, b in enumerate(items) if j != i and places[j] < places[i]], default=0) for i, a in enumerate(items)]
        assert longest_factors(prefixes, places) == want


@pytest.mark.parametrize("earlier", [False, True])
def test_repeated_windows(earlier):
    rng = random.Random(7)
    for n in range(1, 12):
        lefts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 8))) for _ in range(n)]
        rights = [bytes(rng.choice(b"ab") for _ in range(rng.randint(3, 9))) for _ in range(n)]
        places = rng.sample(range(50), n)
        got = repeated_windows(lefts, rights, 9, places, earlier)
        for i in range(n):
            want, others = set(), [j for j in range(n) if j != i and (not earlier or places[j] < places[i])]
            for d in range(9):
                if any(common_prefix(lefts[i], lefts[j]) >= d and common_prefix(rights[i], rights[j]) >= 9 - d for j in others):
                    want |= set(range(-d, 9 - d))
            assert {x for a, b in got[i] for x in range(a, b)} == want


@pytest.mark.parametrize("keep", ["none", "first"])
def test_a_ruler_in_every_text(spark, keep):
    """One substring that is an anchor nearly everywhere, with surroundings that differ; and rows without identifier."""
    rng = random.Random(12)
    make = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    passage = make(150) + "=" * 70 + make(150)
    rows = [(i, make(rng.randint(100, 300)) + "=" * 70 + make(rng.randint(100, 300)) + (passage if i % 5 == 0 else "")) for i in range(120)]
    if keep == "none":
        rows += [(None, make(200) + passage[20:330]) for _ in range(6)] + [(None, rows[7][1])] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring_dedup(docs, 100, keep, most_classes=10).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute(rows, 100, keep)


def test_second_hash_against_direct_sums():
    """Surroundings are equal where their bytes are, wherever they lie."""
    rng = random.Random(13)
    core = "".join(rng.choices("abcdefgh", k=400)).encode()
    find = AnchorFinder(50)
    around = {}
    for shift in (0, 1, 77, 5000):
        of, place, gram, hashed = find([bytes(rng.choices(b"xyz", k=shift)) + core])
        for p, g, h in zip(place.tolist(), gram.tolist(), hashed.tolist()):
            if shift + 50 <= p <= shift + 300:
                assert around.setdefault((p - shift, g), h) == h
    assert len(around) > 3 and len(set(around.values())) == len(around)


@pytest.mark.parametrize("n", [2, 3, 40, 150])
def test_windows_of_large_groups_and_ranges(n):
    rng, length = random.Random(n), 25
    for _ in range(20):
        make = lambda most: bytes(rng.choice(b"ab" if rng.random() < 0.1 else b"a") for _ in range(rng.choice([0, most // 2, most, most])))
        lefts, rights = [make(20) for _ in range(n)], [b"gram" + make(21) for _ in range(n)]
        earlier = rng.random() < 0.5
        places = [rng.randrange(n) for _ in range(n)] if earlier else list(range(n))
        least, most = sorted(rng.randrange(21) for _ in range(2))
        for a, spans in enumerate(repeated_windows(lefts, rights, length, places, earlier, least, most)):
            got = {x for p, q in spans for x in range(least, most + 1) if p <= -x and length - x <= q}
            want = set()
            for b in range(n):
                if places[b] < places[a] or (not earlier and a != b):
                    x, y = common_prefix(lefts[a], lefts[b]), common_prefix(rights[a], rights[b])
                    want |= {w for w in range(least, most + 1) if w <= x and length - w <= y}
            assert got == want


def periodic_junk(n):
    """Texts with runs of a repeated word, of any length and phase, between words of their own."""
    rng = random.Random(21)
    make = lambda k: "".join(rng.choices("abcdefgh ", k=k))
    return [make(rng.randint(60, 200)) + (rng.choice(["the ", "und ", "=", "menteramente "]) * 90)[rng.randint(0, 9) : rng.randint(60, 350)] + make(rng.randint(60, 200)) for _ in range(n)]


def test_periodic_junk_has_few_surroundings():
    """Runs of one word lie in many texts, between other text each time; their substrings must not gather a class for each place of each text."""
    texts = [t.encode() for t in periodic_junk(300)]
    of, place, gram, around = AnchorFinder(100)(texts)
    classes = {}
    for g, a in zip(gram.tolist(), around.tolist()):
        classes.setdefault(g, set()).add(a)
    assert len(place) > 300 and max(map(len, classes.values())) <= 40
    # Every window has one anchor, and surroundings are an anchor's windows.
    of, place, _, _, before, after = AnchorFinder(100).surrounded(texts)
    for k, text in enumerate(texts):
        windows = [w for p, b, a in zip(place[of == k], before[of == k], after[of == k]) for w in range(p - b, p + a - 99)]
        assert sorted(windows) == list(range(len(text) - 99))


@pytest.mark.parametrize("keep", ["none", "first"])
def test_periodic_junk_against_brute_force(spark, keep):
    rows = list(enumerate(periodic_junk(60)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = substring_dedup(docs, 100, keep, most_classes=5).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute(rows, 100, keep)
