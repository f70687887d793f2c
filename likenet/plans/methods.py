"""The five measures, as loops of DataFrame steps.

Each returns (i, j, score). The driver holds the loop only; from the second step on, what a step reads was written to the shared folder, so
plans don't grow and a lost executor costs one step. The methods don't compute the same numbers: see the README.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, sparse
from ..sources import cells, prepare
from ..sources.shared import materialize
from .options import METHODS, Options


def _each_step(frame: DataFrame, step, iterations: int) -> DataFrame:
    """``step`` applied so many times, with a cut of the lineage between."""
    for k in range(iterations):
        frame = step(frame)
        if k + 1 < iterations:
            frame = materialize(frame, "step")
    return frame


def mapreduce(edges: DataFrame, start: DataFrame, identity: DataFrame, iterations: int, c: float = 0.8) -> DataFrame:
    """S ← striu(c·W·(2·striu(S) + diag(S))·Wᵀ) + I, with unit weights. Pairs that are never reached are absent."""
    w = materialize(graph.normalised(edges, weighted=False), "adjacency")
    return _each_step(start, lambda s: sparse.expand_pairs(sparse.doubled(s), w, c).unionByName(identity), iterations)


def delta(edges: DataFrame, start: DataFrame, iterations: int, epsilon: float = 1e-4, c: float = 0.8) -> DataFrame:
    """S ← S + Δ on the keys of the start; Δ from the start, then from its own cells over epsilon."""
    w = materialize(graph.normalised(edges, weighted=False), "adjacency")
    total, change = start, sparse.expand_pairs(sparse.doubled(start), w, c)
    for k in range(iterations):
        if k:
            change = sparse.expand_pairs(sparse.over_threshold(change, epsilon), w, c)
        if k + 1 < iterations:
            change = materialize(change, "change")
        total = sparse.accumulate(total, change)
        if k + 1 < iterations:
            total = materialize(total, "total")
    return total


def dfs(edges: DataFrame, start: DataFrame, iterations: int, c: float = 0.8) -> DataFrame:
    """For each off-diagonal key of the start: the sum over walks of k <= iterations steps that end when they first meet, of (c / (d(a) d(b)))^k.

    (a, b) is the last pair before they meet. Computed from the longest walks inwards, without a source in the rows:
    h_k = g_k + A·h_{k+1}·A off the diagonal, g_k(a, b) = common(a, b)·(c / (d(a) d(b)))^k, and the score is h_1.
    """
    nbr = graph.neighbours(edges)
    adjacency = materialize(nbr.groupBy(F.col("v").alias("u"), F.col("n").alias("v")).agg(F.count(F.lit(1)).cast("double").alias("w")), "adjacency")
    deg = graph.degrees(edges)
    same = adjacency.select(F.col("u").alias("i"), F.col("v").alias("j"), F.col("w").alias("score"))
    common = sparse.product_right(same, adjacency, transpose=True).where("i <> j")
    chance = common.join(deg.toDF("i", "di"), "i").join(deg.toDF("j", "dj"), "j")
    chance = materialize(chance.select("i", "j", F.col("score").alias("common"), (F.lit(c) / (F.col("di") * F.col("dj"))).alias("step")), "common")
    level = lambda k: chance.select("i", "j", (F.col("common") * F.pow("step", F.lit(float(k)))).alias("score"))
    found = level(iterations) if iterations else chance.select("i", "j", F.lit(0.0).alias("score")).limit(0)
    for k in range(iterations - 1, 0, -1):
        walked = sparse.product_right(sparse.product_left(adjacency, found, transpose=False), adjacency, transpose=True).where("i <> j")
        found = level(k).unionByName(walked).groupBy("i", "j").agg(F.sum("score").alias("score"))
        if k > 1:
            found = materialize(found, "walks")
    keys = start.where("i <> j").select("i", "j").withColumn("score", F.lit(0.0))
    return sparse.accumulate(keys, found)


def matrix(edges: DataFrame, start: DataFrame, n_a: int, iterations: int, c: float = 0.8) -> DataFrame:
    """S ← c·Wᵀ·S·W with ones on the diagonal. A vertex without an edge has no cell from the first step on."""
    w = materialize(graph.normalised(edges), "adjacency")
    return _each_step(sparse.nonzero(start), lambda s: sparse.right_product(sparse.left_product(s, w, n_a), w, n_a, c), iterations)


def pagerank(edges: DataFrame, start: DataFrame, iterations: int, c: float = 0.8) -> DataFrame:
    """Random walk with restart: x ← c·W·x + (1 - c)·e for each column j of the start; (i = reached, j = start, score), no zeros.

    A start vertex without an edge has an empty column from the first step on.
    """
    w = materialize(graph.normalised(edges), "adjacency")
    columns = start.select("j").distinct()
    restart = columns.join(w.select(F.col("u").alias("j")).distinct(), "j").select(F.col("j").alias("i"), "j", F.lit(1.0 - c).alias("score"))
    restart = materialize(restart, "restart")

    def step(x: DataFrame) -> DataFrame:
        moved = sparse.product_left(w, x, transpose=False).withColumn("score", F.lit(c) * F.col("score"))
        return sparse.nonzero(moved.unionByName(restart).groupBy("i", "j").agg(F.sum("score").alias("score")))

    return _each_step(sparse.nonzero(start), step, iterations)


def similarity(edges: DataFrame, method: str, n_a: int, n_b: int, iterations: int = 5, c: float = 0.8, epsilon: float = 1e-4, start: DataFrame | None = None, symmetric: bool = False, strict: bool = True) -> DataFrame:
    """One of the five methods; without a start, from the zero-filled identity of both sides.

    ``strict`` makes a start cell across sides an error, for the methods that don't allow any. ``symmetric`` mirrors the
    cells of a method that keeps the upper triangle only.
    """
    if method not in METHODS:
        raise ValueError(f"no such method: {method}")
    spark = edges.sparkSession
    start = prepare.init_similarity(spark, n_a, n_b) if start is None else start
    if strict and method in ("mapreduce", "delta", "dfs"):
        start = graph.check_sides(start, n_a)
    if method == "mapreduce":
        out = mapreduce(edges, start, prepare.identity(spark, n_a + n_b), iterations, c)
    elif method == "delta":
        out = delta(edges, start, iterations, epsilon, c)
    elif method == "dfs":
        out = dfs(edges, start, iterations, c)
    elif method == "matrix":
        return matrix(edges, start, n_a, iterations, c)
    else:
        return pagerank(edges, start, iterations, c)
    return out.unionByName(graph.transposed(out.where("i <> j"))) if symmetric else out


def run(spark: SparkSession, opts: Options) -> DataFrame | None:
    """A run as the options say; without a method, nothing."""
    if opts.method is None:
        return None
    edges = cells.read_graph(spark, opts.graph_data)
    start = cells.read_cells(spark, opts.similarity_path)
    if opts.method == "mapreduce":
        return mapreduce(edges, start, cells.read_cells(spark, opts.identity_path), opts.iterations, opts.c)
    return similarity(edges, opts.method, opts.n_a, opts.n_b, opts.iterations, opts.c, opts.epsilon, start)
