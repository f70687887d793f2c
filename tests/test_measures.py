"""The five measures against worked values and dense closed forms."""

import numpy as np
import pytest

from likenet.plans import methods, verify
from likenet.sources import prepare

# A graph of 3 + 4 vertices and its scores, from independent computation (FIXTURES.md).
EDGES = [(0, 3), (0, 4), (1, 4), (1, 5), (2, 4), (2, 5), (2, 6)]
PAIRS = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (3, 6), (4, 5), (4, 6), (5, 6)]
GOLD = {
    ("mapreduce", 1): [0.0888888889, 0.0888888889, 0.2888888889, 0.2, None, None, 0.2888888889, 0.0888888889, 0.0888888889],
    ("mapreduce", 2): [0.2725925926, 0.32, 0.4844444444, 0.2592592593, 0.0592592593, 0.0237037037, 0.4251851852, 0.1896296296, 0.1659259259],
    ("mapreduce", 3): [0.3879506173, 0.5270123457, 0.6361481481, 0.3943703704, 0.1943703704, 0.0853333333, 0.6124444444, 0.3034074074, 0.2180740741],
    ("mapreduce", 5): [0.7909767901, 1.2286700686, 0.9096783539, 0.6915832099, 0.4915832099, 0.2443693827, 0.9907344856, 0.5435206584, 0.2991512757],
    ("delta", 1): [0.0888888889, 0.0888888889, 0.2888888889, 0.2, 0.0, 0.0, 0.2888888889, 0.0888888889, 0.0888888889],
    ("delta", 3): [0.2095802469, 0.2561975309, 0.4245925926, 0.2634074074, 0.0634074074, 0.0272592593, 0.4038518519, 0.1677037037, 0.1404444444],
    ("delta", 5): [0.2491496296, 0.324386941, 0.4512092181, 0.2883173663, 0.0883173663, 0.0406492181, 0.4363575309, 0.1886893827, 0.1480401646],
    ("dfs", 1): [0.2, 0.1333333333, 0.2666666667, 0.2666666667, 0.0, 0.0, 0.2666666667, 0.2666666667, 0.4],
    ("dfs", 2): [0.3066666667, 0.3111111111, 0.5688888889, 0.3244444444, 0.0577777778, 0.0177777778, 0.3955555556, 0.32, 0.4355555556],
    ("dfs", 3): [0.3472592593, 0.3611851852, 0.6204444444, 0.3908148148, 0.1241481481, 0.0604444444, 0.6468148148, 0.4551111111, 0.528],
    ("dfs", 5): [0.4709846914, 0.5424421399, 0.8699983539, 0.4957353086, 0.229068642, 0.1221965432, 0.9311196708, 0.6065553909, 0.6176921811],
    ("matrix", 1): [0.2, 0.1333333333, 0.2666666667, 0.2666666667, None, None, 0.2666666667, 0.2666666667, 0.4],
    ("matrix", 2): [0.3066666667, 0.24, 0.4266666667, 0.3555555556, 0.1333333333, 0.1066666667, 0.3822222222, 0.3733333333, 0.5066666667],
    ("matrix", 3): [0.3742222222, 0.3134814815, 0.4859259259, 0.4124444444, 0.2186666667, 0.192, 0.4533333333, 0.4444444444, 0.5706666667],
    ("matrix", 5): [0.4426153086, 0.3924938272, 0.5400125103, 0.4745797531, 0.3118696296, 0.2902281481, 0.5100641975, 0.5028503704, 0.6091614815],
}
DELTA_005 = {
    3: [0.1898271605, 0.226962963, 0.4091851852, 0.2634074074, 0.0634074074, 0.0272592593, 0.4038518519, 0.1677037037, 0.1404444444],
    5: [0.1898271605, 0.226962963, 0.4091851852, 0.2634074074, 0.0634074074, 0.0272592593, 0.4038518519, 0.1677037037, 0.1404444444],
}


def frame(spark, rows):
    return spark.createDataFrame([(a, b, w[0] if (w := rest) else 1.0) for a, b, *rest in rows], "src int, dst int, w double")


def scores(df):
    return {(r.i, r.j): r.score for r in df.collect()}


@pytest.mark.parametrize(("method", "steps"), GOLD)
def test_worked_values(spark, method, steps):
    got = scores(methods.similarity(frame(spark, EDGES), method, 3, 4, steps))
    for pair, want in zip(PAIRS, GOLD[method, steps], strict=True):
        assert (pair not in got) if want is None else abs(got[pair] - want) < 1e-9
    diagonal = {k: v for k, v in got.items() if k[0] == k[1]}
    assert diagonal == ({} if method == "dfs" else {(i, i): 1.0 for i in range(7)})
    if method == "matrix":
        assert all(abs(got[j, i] - v) < 1e-12 for (i, j), v in got.items()) and all(0 <= v <= 1 for v in got.values())
    if method == "delta":
        assert set(got) == {(r.i, r.j) for r in prepare.init_similarity(spark, 3, 4).collect()}


@pytest.mark.parametrize("steps", DELTA_005)
def test_delta_with_a_larger_threshold(spark, steps):
    got = scores(methods.similarity(frame(spark, EDGES), "delta", 3, 4, steps, epsilon=0.05))
    assert all(abs(got[p] - want) < 1e-9 for p, want in zip(PAIRS, DELTA_005[steps], strict=True))


def test_identity_as_start(spark):
    edges, start = frame(spark, EDGES), prepare.identity(spark, 7)
    assert set(scores(methods.similarity(edges, "delta", 3, 4, 2, start=start))) == {(i, i) for i in range(7)}
    assert scores(methods.similarity(edges, "dfs", 3, 4, 2, start=start)) == {}
    for method in ("mapreduce", "matrix"):
        a, b = scores(methods.similarity(edges, method, 3, 4, 2, start=start)), scores(methods.similarity(edges, method, 3, 4, 2))
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_random_walk(spark):
    got = scores(methods.similarity(frame(spark, EDGES), "pagerank", 3, 4, 3))
    first_column = [0.2853333333, 0.0213333333, 0.0213333333, 0.2506666667, 0.3217777778, 0.0711111111, 0.0284444444]
    assert all(abs(got[i, 0] - x) < 1e-9 for i, x in enumerate(first_column)) and abs(got[2, 6] - 0.4728888889) < 1e-9
    for j in range(7):
        assert abs(sum(v for (_, c), v in got.items() if c == j) - 1) < 1e-12


def random_graph(seed):
    rng = np.random.default_rng(seed)
    rows = [(int(a), int(4 + b), float(w)) for a, b, w in zip(rng.integers(0, 4, 14), rng.integers(0, 5, 14), rng.integers(1, 4, 14))]
    return sorted({(a, b): (a, b, w) for a, b, w in rows}.values()), 4, 5


def dense(edges, n):
    m = np.zeros((n, n))
    for a, b, *_ in edges:
        m[a, b] += 1
        m[b, a] += 1
    return m


@pytest.mark.parametrize("seed", [1, 2])
def test_matrix_against_the_dense_verifier(spark, seed):
    edges, n_a, n_b = random_graph(seed)
    want = verify.dense_similarity(edges, n_a + n_b, 3)
    for v in set(range(n_a + n_b)) - {x for a, b, _ in edges for x in (a, b)}:
        want[v, v] = 0.0
    got = methods.similarity(frame(spark, edges), "matrix", n_a, n_b, 3)
    assert verify.agrees(got, want) and not verify.agrees(got, want + 1e-7)


@pytest.mark.parametrize("seed", [3, 4])
def test_closed_forms_with_repeated_edges(spark, seed):
    edges, n_a, n_b = random_graph(seed)
    edges = [*edges, edges[0], edges[0], edges[3]]
    n, m = n_a + n_b, dense(edges, n_a + n_b)
    w = m / np.maximum(m.sum(axis=0), 1)
    s = np.eye(n)
    for _ in range(3):
        s = np.triu(0.8 * w @ (2 * np.triu(s, 1) + np.diag(np.diag(s))) @ w.T, 1) + np.eye(n)
    assert verify.agrees(methods.similarity(frame(spark, edges), "mapreduce", n_a, n_b, 3), s)
    change, total = np.triu(0.8 * w @ w.T, 1), np.eye(n)
    for _ in range(3):
        total = total + change
        change = np.triu(0.8 * w @ np.where(change > 0.01, change, 0) @ w.T, 1)
    keys = np.array([[i <= j and (i < n_a) == (j < n_a) for j in range(n)] for i in range(n)])
    assert verify.agrees(methods.similarity(frame(spark, edges), "delta", n_a, n_b, 3, epsilon=0.01), total * keys)
    d = m.sum(axis=0)

    def walk(a, b, left, depth):
        out = 0.0
        for u in range(n):
            for v in range(n):
                if m[u, a] and m[v, b]:
                    times = m[u, a] * m[v, b]
                    out += times * ((0.8 / (d[a] * d[b])) ** depth if u == v else walk(u, v, left - 1, depth + 1) if left else 0.0)
        return out

    want = np.array([[walk(i, j, 2, 1) if keys[i, j] and i != j else 0.0 for j in range(n)] for i in range(n)])
    assert verify.agrees(methods.similarity(frame(spark, edges), "dfs", n_a, n_b, 3), want)


def test_isolated_vertices(spark):
    edges = frame(spark, [(0, 2)])
    assert set(scores(methods.similarity(edges, "matrix", 2, 2, 2))) == {(0, 0), (2, 2)}
    assert {(i, i) for i in range(4)} <= set(scores(methods.similarity(edges, "mapreduce", 2, 2, 2)))
    assert {j for _, j in scores(methods.similarity(edges, "pagerank", 2, 2, 1))} == {0, 2}


def test_empty_graph(spark):
    edges = frame(spark, [(0, 2)]).limit(0)
    for method, rows in (("mapreduce", 4), ("delta", 6), ("dfs", 2), ("matrix", 0), ("pagerank", 0)):
        assert len(scores(methods.similarity(edges, method, 2, 2, 2))) == rows


def test_cross_side_start(spark):
    start = spark.createDataFrame([(0, 3, 0.5)], "i int, j int, score double")
    for method in ("mapreduce", "delta", "dfs"):
        with pytest.raises(Exception, match="across sides"):
            methods.similarity(frame(spark, EDGES), method, 3, 4, 1, start=start).collect()


def test_symmetric_option(spark):
    got = scores(methods.similarity(frame(spark, EDGES), "mapreduce", 3, 4, 2, symmetric=True))
    assert all(got[j, i] == v for (i, j), v in got.items())
    with pytest.raises(ValueError, match="no such method"):
        methods.similarity(frame(spark, EDGES), "other", 3, 4)
