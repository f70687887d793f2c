import pytest

from likenet.functions.partition_ids import modulo, sub_modulo
from likenet.operators import graph, sparse
from likenet.plans import methods
from likenet.plans.options import Options, options, read_properties
from likenet.sources import cells, prepare, shared

BASE = {
    "app.graph.data": "g", "app.graph.size": "7", "app.graphA.size": "3", "app.graphB.size": "4", "app.iterations": "2", "app.partitions": "2",
}


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_cells_round_trip(spark, tmp_path):
    made = spark.createDataFrame([(0, 3, 1.0), (1, 2, 1e-4), (5, 6, 0.333333333333)], "i int, j int, score double")
    cells.write_cells(made, str(tmp_path / "cells"))
    assert sorted(cells.read_cells(spark, str(tmp_path / "cells")).collect()) == sorted(made.collect())


@pytest.mark.parametrize("bad", ["((1,2),1)", "((1,2),1.0E-4)", "((-1,2),1.0)", "", " ((1,2),1.0)", None])
def test_lines_of_another_form(spark, bad):
    given = lines(spark, "((1,2),1.5)", bad)
    with pytest.raises(Exception, match="not a cell"):
        cells.parse_cells(given).collect()
    assert [tuple(r) for r in cells.parse_cells(given, strict=False).collect()] == [(1, 2, 1.5)]


def test_starts(spark):
    made = prepare.init_similarity(spark, 37, 13).collect()
    assert len(made) == 794 and all(r.i <= r.j and (r.i < 37) == (r.j < 37) and r.score == float(r.i == r.j) for r in made)
    assert [tuple(r) for r in prepare.identity(spark, 3).orderBy("i").collect()] == [(0, 0, 1.0), (1, 1, 1.0), (2, 2, 1.0)]


@pytest.mark.parametrize("dist", ["uniform", "zipf"])
def test_random_graph(spark, dist):
    made = prepare.random_bipartite(spark, 20, 10, 500, seed=3, dist=dist).collect()
    assert 0 < len(made) <= 200 and len({(r.src, r.dst) for r in made}) == len(made)
    assert all(0 <= r.src < 20 <= r.dst < 30 and r.w == 1.0 for r in made)
    assert sorted(made) == sorted(prepare.random_bipartite(spark, 20, 10, 500, seed=3, dist=dist).collect())
    with pytest.raises(ValueError, match="need vertices"):
        prepare.random_bipartite(spark, 5, 0, 3)


def test_adjacency_with_repeated_and_weighted_edges(spark):
    edges = spark.createDataFrame([(0, 3, 2.0), (0, 3, 2.0), (0, 4, 1.0), (1, 4, 1.0)], "src int, dst int, w double")
    w = {(r.u, r.v): r.w for r in graph.normalised(edges).collect()}
    assert w == {(0, 3): 1.0, (3, 0): 2 / 3, (4, 0): 1 / 3, (0, 4): 0.5, (1, 4): 0.5, (4, 1): 1.0}
    unit = {(r.u, r.v): r.w for r in graph.normalised(edges, weighted=False).collect()}
    assert unit[3, 0] == 2 / 3 and unit[0, 3] == 1.0
    assert {r.v: r.d for r in graph.degrees(edges).collect()} == {0: 3, 1: 1, 3: 2, 4: 2}
    assert {r.slice for r in graph.row_slices(graph.normalised(edges), 2).collect()} == {0, 1}
    with pytest.raises(ValueError, match="over 1"):
        graph.row_slices(edges, 1)


def test_threshold_is_strict(spark):
    made = spark.createDataFrame([(0, 1, 0.05), (0, 2, 0.06), (1, 1, 1.0)], "i int, j int, score double")
    assert [r.j for r in sparse.over_threshold(made, 0.05).collect()] == [2]


def test_columns_and_partition_numbers(spark):
    made = prepare.init_similarity(spark, 3, 2)
    assert sorted(sparse.unpack_columns(sparse.pack_columns(made)).collect()) == sorted(made.collect())
    ids = spark.range(40)
    got = ids.select("id", modulo(ids.id, 4).alias("m"), sub_modulo(ids.id, 3, 5).alias("s")).collect()
    assert all(r.m == r.id % 4 and r.s == r.id // 5 % 3 for r in got)


def test_options():
    text = "# comment\napp.impl.type = matrix\n" + "\n".join(f"{k}={v}" for k, v in BASE.items()) + "\napp.initSimMatPath: s\napp.matrix.graphPartitions=3\n"
    opts = options(read_properties(text))
    assert (opts.method, opts.n_a, opts.slices, opts.similarity_path) == ("matrix", 3, 3, "s")
    with pytest.raises(OSError, match="iterations should be set"):
        options({k: v for k, v in BASE.items() if k != "app.iterations"})
    with pytest.raises(OSError, match="initSimMatPath should be set"):
        options(BASE | {"app.impl.type": "dfs"})
    with pytest.raises(ValueError, match="over 1"):
        options(BASE | {"app.matrix.graphPartitions": "1"})
    with pytest.raises(ValueError, match="no such method"):
        options(BASE | {"app.impl.type": "x"})


def test_a_run_from_files(spark, tmp_path):
    graph_path, start, diagonal = (str(tmp_path / x) for x in ("graph", "start", "diagonal"))
    edges = spark.createDataFrame([(0, 3, 1.0), (0, 4, 1.0), (1, 4, 1.0), (1, 5, 1.0), (2, 4, 1.0), (2, 5, 1.0), (2, 6, 1.0)], "src int, dst int, w double")
    cells.write_cells(edges, graph_path)
    prepare.prepare(spark, 3, 4, start, diagonal)
    for method, pair in (("mapreduce", 0.2725925926), ("delta", 0.1807407407), ("dfs", 0.3066666667), ("matrix", 0.3066666667)):
        got = methods.run(spark, Options(graph_path, 7, 3, 4, 2, 2, method, start, diagonal))
        assert abs(got.where("i = 0 and j = 1").first().score - pair) < 1e-9
    assert methods.run(spark, Options(graph_path, 7, 3, 4, 2, 2)) is None


def test_materialized_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_dir", lambda _: str(tmp_path))
    made = shared.materialize(spark.range(5), "x")
    assert list(tmp_path.glob("likenet*")) and made.count() == 5
    shared.discard(made)
    assert not list(tmp_path.glob("likenet*"))


def test_shared_folder(spark):
    assert shared.shared_dir(spark) == shared.shared_dir(spark)

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Cluster)
