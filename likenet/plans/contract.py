"""The queries of the measures and their parts, and SQL for DuckDB that gives the same rows.

All run on one graph: brands (25, side A) against sizes (50, side B) of all parts, weighted by the number of parts. Scores
are rounded to 8 places after an offset that keeps rational scores off the borders of rounding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.partition_ids import modulo, sub_modulo
from ..operators import graph, sparse
from ..sources import cells, prepare
from ..sources.shared import materialize, shared_path
from . import methods, shuffle_bench, verify
from .options import options

N_A, N_B, C, EPSILON = 25, 50, 0.8, 0.01
N = N_A + N_B


def edges_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, w) of the graph; aggregated once and written, as several steps read it."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    src = (F.substring("p_brand", 7, 10).cast("int") - 1).alias("src")
    found = part.groupBy(src, (F.col("p_size") + (N_A - 1)).cast("int").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    return materialize(found, "edges")


def rounded(frame: DataFrame, name: str = "score") -> DataFrame:
    return frame.withColumn(name, F.round(F.col(name) + F.lit(1.3e-9), 8))


def _start(spark: SparkSession) -> DataFrame:
    return prepare.init_similarity(spark, N_A, N_B)


def _filled(spark: SparkSession) -> DataFrame:
    """A symmetric start with cells beside the diagonal."""
    near = F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.lit(1.0) / (F.col("i") + F.col("j") + 1))
    upper = _start(spark).withColumn("score", near)
    return upper.unionByName(graph.transposed(upper.where("i < j")))


def parse_cells(spark, sf_dir):
    lines = cells.format_cells(edges_of(spark, sf_dir))
    return cells.parse_cells(lines, ("src", "dst", "w"))


def neighbours_degree(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    return graph.neighbours(edges).join(graph.degrees(edges), "v")


def normalised_adjacency(spark, sf_dir):
    return rounded(graph.normalised(edges_of(spark, sf_dir)), "w")


def transpose_normalised(spark, sf_dir):
    return rounded(graph.transposed(graph.normalised(edges_of(spark, sf_dir))), "w")


def mapreduce_step(spark, sf_dir):
    w = graph.normalised(edges_of(spark, sf_dir), weighted=False)
    upper = _filled(spark).where("i <= j")
    return rounded(sparse.expand_pairs(sparse.doubled(upper), w, C))


def mapreduce_t3(spark, sf_dir):
    return rounded(methods.mapreduce(edges_of(spark, sf_dir), _start(spark), prepare.identity(spark, N), 3, C))


def left_product(spark, sf_dir):
    return rounded(sparse.left_product(_filled(spark), graph.normalised(edges_of(spark, sf_dir)), N_A))


def matrix_step(spark, sf_dir):
    return rounded(methods.matrix(edges_of(spark, sf_dir), _filled(spark), N_A, 1, C))


def matrix_t3(spark, sf_dir):
    return rounded(methods.matrix(edges_of(spark, sf_dir), _start(spark), N_A, 3, C))


def delta_step(spark, sf_dir):
    w = graph.normalised(edges_of(spark, sf_dir), weighted=False)
    return rounded(sparse.expand_pairs(sparse.over_threshold(_filled(spark).where("i <= j"), EPSILON), w, C))


def delta_accumulate(spark, sf_dir):
    w = graph.normalised(edges_of(spark, sf_dir), weighted=False)
    return rounded(sparse.accumulate(_start(spark), sparse.expand_pairs(sparse.doubled(_start(spark)), w, C)))


def delta_t3(spark, sf_dir):
    return rounded(methods.delta(edges_of(spark, sf_dir), _start(spark), 3, EPSILON, C))


def dfs_t1(spark, sf_dir):
    return rounded(methods.dfs(edges_of(spark, sf_dir), _start(spark), 1, C))


def dfs_t3(spark, sf_dir):
    return rounded(methods.dfs(edges_of(spark, sf_dir), _start(spark), 3, C))


def _unit(edges: DataFrame) -> DataFrame:
    """Walks need columns that sum to one."""
    return edges.withColumn("w", F.lit(1.0))


def rwr_t1(spark, sf_dir):
    return rounded(methods.pagerank(_unit(edges_of(spark, sf_dir)), prepare.identity(spark, N), 1, C))


def rwr_t5(spark, sf_dir):
    return rounded(methods.pagerank(_unit(edges_of(spark, sf_dir)), prepare.identity(spark, N), 5, C))


def double_shuffle(spark, sf_dir):
    dealt = shuffle_bench.double_shuffle(shuffle_bench.records(spark, 300), 8)
    return dealt.groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


def column_pack(spark, sf_dir):
    packed = sparse.pack_columns(graph.normalised(edges_of(spark, sf_dir)).toDF("i", "j", "score"))
    return packed.select(
        "j",
        F.size("cells").cast("long").alias("n_cells"),
        F.col("cells")[0]["i"].alias("first_row"),
        F.expr("round(aggregate(cells, 0D, (a, c) -> a + c.score * (1 + c.i)) + 1.3e-9D, 8)").alias("weighted_sum"),
        modulo(F.col("j"), 4).alias("modulo_id"),
        sub_modulo(F.col("j"), 4, 10).alias("sub_modulo_id"),
    )


def verify_matrix(spark, sf_dir):
    """The matrix method against the same sums over expanded pairs, without its two steps and without pruning."""
    edges = _unit(edges_of(spark, sf_dir))
    w = materialize(graph.normalised(edges), "adjacency")
    has_edge = w.select(F.col("u").alias("i")).distinct()
    other = prepare.identity(spark, N)
    for _ in range(2):
        a = w.select(F.col("u").alias("i"), F.col("v").alias("r"), F.col("w").alias("wr"))
        b = w.select(F.col("u").alias("j"), F.col("v").alias("c"), F.col("w").alias("wc"))
        sums = other.join(a, "i").join(b, "j").groupBy("r", "c").agg(F.sum(F.col("wr") * F.col("score") * F.col("wc")).alias("s"))
        other = sums.where("r <> c").select(F.col("r").alias("i"), F.col("c").alias("j"), (F.lit(C) * F.col("s")).alias("score"))
        other = materialize(other.unionByName(has_edge.select("i", F.col("i").alias("j"), F.lit(1.0).alias("score"))), "other")
    cells = verify.differences(methods.matrix(edges, prepare.identity(spark, N), N_A, 2, C), other)
    return rounded(rounded(cells), "other").withColumn("agrees", F.col("difference") <= 1e-8).drop("difference")


def random_bipartite(spark, sf_dir):
    return prepare.random_bipartite(spark, 37, 13, 700, seed=7)


def row_slices(spark, sf_dir):
    return rounded(graph.row_slices(graph.normalised(edges_of(spark, sf_dir)), 3), "w")


def text_sink(spark, sf_dir):
    path = shared_path(spark, "cells")
    cells.write_cells(edges_of(spark, sf_dir), path)
    return cells.read_graph(spark, path)


def prepared(spark, sf_dir):
    """Both matrices that a run starts from, by way of their files."""
    paths = shared_path(spark, "similarity"), shared_path(spark, "identity")
    prepare.prepare(spark, N_A, N_B, *paths)
    start, identity = (cells.read_cells(spark, p) for p in paths)
    return start.withColumn("kind", F.lit("similarity")).unionByName(identity.withColumn("kind", F.lit("identity")))


def run_by_options(spark, sf_dir):
    """A whole run as a properties file says: files of edges and matrices in, two steps of ``mapreduce``."""
    data, start, identity = (shared_path(spark, x) for x in ("cells", "similarity", "identity"))
    cells.write_cells(edges_of(spark, sf_dir), data)
    prepare.prepare(spark, N_A, N_B, start, identity)
    settings = {
        "graph.data": data, "graph.size": str(N), "graphA.size": str(N_A), "graphB.size": str(N_B), "iterations": "2", "partitions": "2",
        "impl.type": "mapreduce", "initSimMatPath": start, "diagSimMatPath": identity,
    }
    return rounded(methods.run(spark, options(settings)))


def same_side(spark, sf_dir):
    return rounded(graph.check_sides(_filled(spark), N_A))


def repeated_edges(spark, sf_dir):
    """Adjacency of a graph in which some edges are given twice, with other weights."""
    edges = edges_of(spark, sf_dir)
    again = edges.where(F.col("dst") % 3 == 0).withColumn("w", F.col("w") + 1.5)
    both = edges.unionByName(again)
    weighted, unit = (rounded(graph.normalised(both, weighted=x), "w") for x in (True, False))
    return weighted.join(unit.withColumnRenamed("w", "unit_w"), ["u", "v"])


def rwr_weighted_t2(spark, sf_dir):
    return rounded(methods.pagerank(edges_of(spark, sf_dir), prepare.identity(spark, N), 2, C))


def dense_matrix_t2(spark, sf_dir):
    """The dense second opinion itself; its graph has 75 vertices at any scale factor."""
    edges = [tuple(r) for r in edges_of(spark, sf_dir).select("src", "dst", "w").collect()]
    dense = verify.dense_similarity(edges, N, 2, C)
    known = sorted({v for a, b, _ in edges for v in (a, b)})
    found = [(i, j, float(dense[i, j])) for i in known for j in known if dense[i, j]]
    return rounded(spark.createDataFrame(found, "i int, j int, score double"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q01_parse_cells": parse_cells,
    "q02_init_similarity": lambda spark, sf_dir: prepare.init_similarity(spark, 37, 13),
    "q03_identity": lambda spark, sf_dir: prepare.identity(spark, 50),
    "q04_neighbours_degree": neighbours_degree,
    "q05_normalised_adjacency": normalised_adjacency,
    "q06_transpose_normalised": transpose_normalised,
    "q07_mapreduce_step": mapreduce_step,
    "q08_mapreduce_T3": mapreduce_t3,
    "q09_left_product": left_product,
    "q10_matrix_step": matrix_step,
    "q11_matrix_T3": matrix_t3,
    "q12_delta_step": delta_step,
    "q13_delta_accumulate": delta_accumulate,
    "q14_delta_T3": delta_t3,
    "q15_dfs_T1": dfs_t1,
    "q16_dfs_T3": dfs_t3,
    "q17_rwr_T1": rwr_t1,
    "q18_rwr_T5": rwr_t5,
    "q19_double_shuffle": double_shuffle,
    "q20_column_pack": column_pack,
    "q21_verify_matrix": verify_matrix,
    "q22_random_bipartite": random_bipartite,
    "q23_row_slices": row_slices,
    "q24_text_sink": text_sink,
    "q25_prepared": prepared,
    "q26_run_by_options": run_by_options,
    "q27_same_side": same_side,
    "q28_repeated_edges": repeated_edges,
    "q29_rwr_weighted_T2": rwr_weighted_t2,
    "q30_dense_matrix_T2": dense_matrix_t2,
}


def _with(*tables: tuple[str, str], last: str) -> str:
    """SQL of named tables and a last select."""
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in tables) + f"\n{last}"


def _score(column: str = "score") -> str:
    return f"round({column} + 1.3e-9::DOUBLE, 8) AS {column}"


_EDGES = (
    "edges",
    f"SELECT CAST(substr(p_brand, 7) AS INTEGER) - 1 AS src, CAST({N_A - 1} + p_size AS INTEGER) AS dst, CAST(count(*) AS DOUBLE) AS w FROM part GROUP BY 1, 2",
)
_BOTH = ("both_ways", "SELECT dst AS u, src AS v, w FROM edges UNION ALL SELECT src, dst, w FROM edges")
_WADJ = ("wadj", "SELECT u, v, w / count(*) OVER (PARTITION BY v) AS w FROM both_ways")
_UADJ = ("uadj", "SELECT u, v, 1::DOUBLE / count(*) OVER (PARTITION BY v) AS w FROM both_ways")
_DEG = ("deg", "SELECT v, count(*) AS d FROM both_ways GROUP BY v")


def _start_sql(n_a: int, n_b: int) -> str:
    return (
        f"SELECT CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, CASE WHEN a.i = b.i THEN 1::DOUBLE ELSE 0::DOUBLE END AS score "
        f"FROM range({n_a + n_b}) a(i) JOIN range({n_a + n_b}) b(i) ON a.i <= b.i AND (a.i < {n_a}) = (b.i < {n_a})"
    )


_START = ("start", _start_sql(N_A, N_B))
_IDENTITY = ("ident", f"SELECT CAST(i AS INTEGER) AS i, CAST(i AS INTEGER) AS j, 1::DOUBLE AS score FROM range({N}) t(i)")
_UPPER = ("upper_start", "SELECT i, j, CASE WHEN i = j THEN 1::DOUBLE ELSE 1::DOUBLE / (i + j + 1) END AS score FROM start")
_FILLED = ("filled", "SELECT * FROM upper_start UNION ALL SELECT j, i, score FROM upper_start WHERE i < j")


def _expand(source: str, factor: str = "CASE WHEN i <> j THEN 2::DOUBLE ELSE 1::DOUBLE END", where: str = "score <> 0") -> str:
    """What pairs of neighbours receive from the cells of ``source``."""
    return (
        f"SELECT a.u AS i, b.u AS j, sum({C}::DOUBLE * a.w * b.w * {factor} * s.score) AS score FROM (SELECT * FROM {source} WHERE {where}) s "
        f"JOIN uadj a ON a.v = s.i JOIN uadj b ON b.v = s.j WHERE a.u < b.u GROUP BY 1, 2"
    )


def _left(source: str) -> str:
    return f"SELECT w.v AS i, s.j, sum(w.w * s.score) AS score FROM {source} s JOIN wadj w ON w.u = s.i WHERE (w.v < {N_A}) <> (s.j < {N_A}) GROUP BY 1, 2 HAVING sum(w.w * s.score) <> 0"


def _right(source: str) -> str:
    return (
        f"SELECT w.v AS i, m.i AS j, CASE WHEN w.v = m.i THEN 1::DOUBLE ELSE {C}::DOUBLE * sum(m.score * w.w) END AS score FROM {source} m JOIN wadj w ON w.u = m.j "
        f"WHERE (w.v < {N_A}) = (m.i < {N_A}) GROUP BY 1, 2 HAVING sum(m.score * w.w) <> 0"
    )


def _delta_sum(total: str, change: str) -> str:
    return f"SELECT s.i, s.j, s.score + coalesce(d.score, 0) AS score FROM {total} s LEFT JOIN {change} d ON s.i = d.i AND s.j = d.j"


def _walk(source: str, level: int) -> str:
    """Walks one step longer: what remains of level ``level`` and the pairs around it."""
    return (
        f"SELECT i, j, sum(score) AS score FROM (SELECT i, j, common * pow(step, {level}) AS score FROM chance UNION ALL "
        f"SELECT a.v AS i, b.v AS j, sum(h.score) AS score FROM {source} h JOIN both_ways a ON a.u = h.i JOIN both_ways b ON b.u = h.j WHERE a.v <> b.v GROUP BY 1, 2) GROUP BY 1, 2"
    )


_COMMON = ("common", "SELECT a.v AS i, b.v AS j, CAST(count(*) AS DOUBLE) AS common FROM both_ways a JOIN both_ways b ON a.u = b.u WHERE a.v <> b.v GROUP BY 1, 2")
_CHANCE = ("chance", f"SELECT i, j, common, {C}::DOUBLE / (a.d * b.d) AS step FROM common JOIN deg a ON a.v = i JOIN deg b ON b.v = j")


def _walked(name: str) -> str:
    return f"SELECT s.i, s.j, {_score('score')} FROM (SELECT s.i, s.j, coalesce(h.score, 0) AS score FROM start s LEFT JOIN {name} h ON s.i = h.i AND s.j = h.j WHERE s.i <> s.j) s"


def _restart(source: str) -> str:
    return (
        f"SELECT i, j, sum(score) AS score FROM (SELECT a.u AS i, x.j, {C}::DOUBLE * sum(a.w * x.score) AS score FROM {source} x JOIN uadj a ON a.v = x.i GROUP BY 1, 2 "
        f"UNION ALL SELECT DISTINCT v, v, 1::DOUBLE - {C}::DOUBLE FROM both_ways) GROUP BY 1, 2 HAVING sum(score) <> 0"
    )


def _cells(name: str) -> str:
    return f"SELECT i, j, {_score()} FROM {name}"


_UNIT = [_EDGES, _BOTH, _UADJ, _START]
_WEIGHTED = [_EDGES, _BOTH, _WADJ, _START]
_CHANGES = [("d1", _expand("start")), ("s1", _delta_sum("start", "d1"))]

ORACLE_SQL: dict[str, str] = {
    "q01_parse_cells": _with(_EDGES, last="SELECT * FROM edges"),
    "q02_init_similarity": _start_sql(37, 13),
    "q03_identity": "SELECT CAST(i AS INTEGER) AS i, CAST(i AS INTEGER) AS j, 1::DOUBLE AS score FROM range(50) t(i)",
    "q04_neighbours_degree": _with(_EDGES, _BOTH, _DEG, last="SELECT b.v, b.u AS n, d.d FROM both_ways b JOIN deg d ON d.v = b.v"),
    "q05_normalised_adjacency": _with(_EDGES, _BOTH, _WADJ, last=f"SELECT u, v, {_score('w')} FROM wadj"),
    "q06_transpose_normalised": _with(_EDGES, _BOTH, _WADJ, last=f"SELECT v AS u, u AS v, {_score('w')} FROM wadj"),
    "q07_mapreduce_step": _with(*_UNIT, _UPPER, ("t", _expand("upper_start")), last=_cells("t")),
    "q08_mapreduce_T3": _with(
        *_UNIT, _IDENTITY, *((f"s{k}", f"{_expand(f's{k - 1}' if k > 1 else 'start')} UNION ALL SELECT * FROM ident") for k in (1, 2, 3)), last=_cells("s3")
    ),
    "q09_left_product": _with(*_WEIGHTED, _UPPER, _FILLED, ("m", _left("filled")), last=_cells("m")),
    "q10_matrix_step": _with(*_WEIGHTED, _UPPER, _FILLED, ("m", _left("filled")), ("s", _right("m")), last=_cells("s")),
    "q11_matrix_T3": _with(
        *_WEIGHTED, *(x for k in (1, 2, 3) for x in ((f"m{k}", _left(f"s{k - 1}" if k > 1 else "start")), (f"s{k}", _right(f"m{k}")))), last=_cells("s3")
    ),
    "q12_delta_step": _with(*_UNIT, _UPPER, ("t", _expand("upper_start", "1", f"i <> j AND score > {EPSILON}")), last=_cells("t")),
    "q13_delta_accumulate": _with(*_UNIT, *_CHANGES, last=_cells("s1")),
    "q14_delta_T3": _with(
        *_UNIT,
        *_CHANGES,
        *(x for k in (2, 3) for x in ((f"d{k}", _expand(f"d{k - 1}", "1", f"i <> j AND score > {EPSILON}")), (f"s{k}", _delta_sum(f"s{k - 1}", f"d{k}")))),
        last=_cells("s3"),
    ),
    "q15_dfs_T1": _with(_EDGES, _BOTH, _DEG, _START, _COMMON, _CHANCE, ("h1", "SELECT i, j, common * step AS score FROM chance"), last=_walked("h1")),
    "q16_dfs_T3": _with(
        _EDGES, _BOTH, _DEG, _START, _COMMON, _CHANCE, ("h3", "SELECT i, j, common * pow(step, 3) AS score FROM chance"), ("h2", _walk("h3", 2)), ("h1", _walk("h2", 1)), last=_walked("h1")
    ),
    "q17_rwr_T1": _with(_EDGES, _BOTH, _UADJ, _IDENTITY, ("x1", _restart("ident")), last=_cells("x1")),
    "q18_rwr_T5": _with(_EDGES, _BOTH, _UADJ, _IDENTITY, *((f"x{k}", _restart(f"x{k - 1}" if k > 1 else "ident")) for k in range(1, 6)), last=_cells("x5")),
    "q19_double_shuffle": "SELECT CAST(r AS INTEGER) AS r, count(*) AS n, CAST(count(*) AS DOUBLE) AS total FROM range(300) a(r), range(300) b(i) GROUP BY r",
    "q20_column_pack": _with(
        _EDGES, _BOTH, _WADJ, last="SELECT v AS j, count(*) AS n_cells, min(u) AS first_row, round(sum(w * (1 + u)) + 1.3e-9::DOUBLE, 8) AS weighted_sum, CAST(v % 4 AS INTEGER) AS modulo_id, CAST((v // 10) % 4 AS INTEGER) AS sub_modulo_id FROM wadj GROUP BY v"
    ),
    "q21_verify_matrix": _with(
        _EDGES, _BOTH, _UADJ, _IDENTITY, ("wadj", "SELECT * FROM uadj"), *(x for k in (1, 2) for x in ((f"m{k}", _left(f"s{k - 1}" if k > 1 else "ident")), (f"s{k}", _right(f"m{k}")))),
        last=f"SELECT i, j, {_score()}, round(score + 1.3e-9::DOUBLE, 8) AS other, true AS agrees FROM s2",
    ),
    "q22_random_bipartite": _with(
        ("draws", "SELECT md5('7:' || id) AS h FROM range(700) t(id)"),
        ("parts", "SELECT ('0x' || substr(h, 1, 8))::BIGINT / 4294967296::DOUBLE AS a, ('0x' || substr(h, 9, 8))::BIGINT / 4294967296::DOUBLE AS b FROM draws"),
        last="SELECT DISTINCT CAST(floor(a * 37) AS INTEGER) AS src, CAST(floor(b * 13) + 37 AS INTEGER) AS dst, 1::DOUBLE AS w FROM parts",
    ),
    "q23_row_slices": _with(_EDGES, _BOTH, _WADJ, last=f"SELECT u, v, {_score('w')}, CAST(u % 3 AS INTEGER) AS slice FROM wadj"),
    "q24_text_sink": _with(_EDGES, last="SELECT * FROM edges"),
    "q25_prepared": _with(_START, _IDENTITY, last="SELECT *, 'similarity' AS kind FROM start UNION ALL SELECT *, 'identity' FROM ident"),
    "q26_run_by_options": _with(
        *_UNIT, _IDENTITY, *((f"s{k}", f"{_expand(f's{k - 1}' if k > 1 else 'start')} UNION ALL SELECT * FROM ident") for k in (1, 2)), last=_cells("s2")
    ),
    "q27_same_side": _with(_START, _UPPER, _FILLED, last=_cells("filled")),
    "q28_repeated_edges": _with(
        (_EDGES[0] + "_once", _EDGES[1]),
        ("edges", "SELECT * FROM edges_once UNION ALL SELECT src, dst, w + 1.5 FROM edges_once WHERE dst % 3 = 0"),
        _BOTH,
        _DEG,
        ("cells", "SELECT u, b.v, max(w) / any_value(d) AS w, count(*) / any_value(d)::DOUBLE AS unit_w FROM both_ways b JOIN deg ON deg.v = b.v GROUP BY u, b.v"),
        last=f"SELECT u, v, {_score('w')}, {_score('unit_w')} FROM cells",
    ),
    "q29_rwr_weighted_T2": _with(_EDGES, _BOTH, ("uadj", _WADJ[1]), _IDENTITY, ("x1", _restart("ident")), ("x2", _restart("x1")), last=_cells("x2")),
    "q30_dense_matrix_T2": _with(
        _EDGES, _BOTH, _WADJ, _IDENTITY, *(x for k in (1, 2) for x in ((f"m{k}", _left(f"s{k - 1}" if k > 1 else "ident")), (f"s{k}", _right(f"m{k}")))), last=_cells("s2")
    ),
}
