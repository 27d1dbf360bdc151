"""Exact top-k search by a vector-approximation file.

The file holds one cell number per component, a byte, and nothing else; cells are equal parts between the smallest and
the largest value that the component takes anywhere. The cells of a vector bound its score from both sides.

A first pass scans the cells for the k-th best lower bound of every query over the whole file, a second one for the vectors
whose upper bound reaches it. Only of those are exact vectors read, by a join on the row, and scored; the k-th result is
then certain, since nothing else can reach it. Of equal vectors no more than the ``2 k`` rows of the smallest ids take part
as candidates (and ``k`` of one id), which is all that ties by id can ask for, so a vector that many rows share brings no
more survivors than any other.

Queries and file meet in a grid: the file's blocks are dealt to parts of about ``FILE_PART`` blocks, the queries' to parts of
about ``QUERY_PART``, and each pair of parts is one group. Sizes of groups are fixed, so the number of jobs doesn't depend on
the number of queries and no task holds more than two parts.

Defined results. Vectors that are null, or hold null or a non-finite component, take no part; nor does a row without
id. Only vectors of equal length are compared, empty ones score 0. Ties go to the smaller id. An id that several rows
have stands for each of them, but no row is a neighbour of its own id. Scores are 64-bit; one that leaves them is an
error. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbolex.llm.lookups import looked_up
from arbolex.session import materialize

#: cells of a component; vectors and queries in a block; blocks of the file and of queries that meet in one group
CELLS, ROWS_BLOCK, QUERY_BLOCK, FILE_PART, QUERY_PART = 256, 4096, 256, 32, 16
Ends = dict[int, tuple[np.ndarray, np.ndarray]]


def whole_numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v array<long>, dim) of the vectors that take part; ``v`` is floor(scale * x)."""
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>"))
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fit)
        .select("vec_id", F.transform("embedding", lambda x: F.floor(scale * x)).alias("v"))
        .withColumn("dim", F.size("v"))
    )


def cell_bounds(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Smallest and largest value of every component by vector length, over all vectors."""
    ends = (
        rows.select("dim", F.posexplode("v").alias("at", "x"))
        .groupBy("dim", "at")
        .agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        .collect()  # two numbers per component
    )
    found: dict[int, list] = {}
    for r in sorted(ends, key=lambda r: (r.dim, r.at)):
        found.setdefault(r.dim, []).append((r.lo, r.hi))
    return {dim: tuple(np.array(x, float).T) for dim, x in found.items()}


def candidates(rows: DataFrame, k: int) -> DataFrame:
    """Of rows with equal vectors those that can be among the k best of some query, by their ids."""
    of_id = Window.partitionBy("v", "vec_id").orderBy("row")
    of_vector = Window.partitionBy("v").orderBy("vec_id", "row")
    few = rows.withColumn("_n", F.row_number().over(of_id)).where(F.col("_n") <= k)
    return few.withColumn("_n", F.row_number().over(of_vector)).where(F.col("_n") <= 2 * k).drop("_n")


def blocks(rows: DataFrame, size: int, numbers: tuple[str, ...], body: Callable, kind: str) -> DataFrame:
    """Rows of equal ``dim`` packed into blocks: ``block, dim``, the columns of ``numbers`` as bytes, ``data`` from ``body``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(at))
                vectors = part.column("v").flatten().to_numpy().reshape(len(at), dim)
                held = [part.column(c).to_numpy() for c in numbers]
                for lo in range(0, len(at), size):
                    some = slice(lo, lo + size)
                    values = [number, int(dim), *(x[some].tobytes() for x in held), body(vectors[some], int(dim)).tobytes()]
                    types = [pa.int64(), pa.int32(), *[pa.binary()] * (len(numbers) + 1)]
                    number += 1
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, types, strict=True)], names)

    names = ["block", "dim", *numbers, kind]
    return rows.select("dim", "v", *numbers).mapInArrow(build, f"block long, dim int, {', '.join(f'{c} binary' for c in names[2:])}")


def cell_numbers(block: np.ndarray, ends: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    low, high = ends
    width = (high - low) / CELLS + (high == low)
    return np.clip((block - low) // width, 0, CELLS - 1).astype(np.uint8)


def cell_limits(cells: np.ndarray, ends: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole value in each cell, one unit wider than its edges against rounding."""
    low, high = ends
    width = (high - low) / CELLS + (high == low)
    cells = cells.astype(float)
    return np.floor(low + cells * width) - 1, np.ceil(low + (cells + 1) * width) + 1


def score_bounds(queries: np.ndarray, cells: np.ndarray, ends: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) of the scores of all queries (rows) and vectors (columns), one unit wider against rounding."""
    if not queries.shape[1]:
        none = np.zeros((len(queries), len(cells)))
        return none, none
    least, most = cell_limits(cells, ends)
    up, down = np.maximum(queries, 0.0), np.minimum(queries, 0.0)
    lower, upper = up @ least.T + down @ most.T, up @ most.T + down @ least.T
    slack = 1 + 1e-9 * np.maximum(np.abs(lower), np.abs(upper))
    return lower - slack, upper + slack


def meetings(file: pa.Table, asked: pa.Table, ends: Ends) -> Iterator[tuple]:
    """(query block, file block, lower, upper) of two parts, with minus infinity at the query's own id."""
    for q in asked.to_pylist():
        dim = q["dim"]
        queries = np.frombuffer(q["vectors"], float).reshape(-1, dim) if dim else np.empty((len(q["query"]) // 8, 0))
        numbers, own = np.frombuffer(q["query"], np.int64), np.frombuffer(q["vec_id"], np.int64)
        for dim_of, rows, ids, cells in zip(*(file.column(c) for c in ("dim", "row", "vec_id", "cells")), strict=True):
            if dim_of.as_py() != dim:
                continue
            ids = np.frombuffer(ids.as_buffer(), np.int64)
            cells = np.frombuffer(cells.as_buffer(), np.uint8).reshape(len(ids), dim)
            lower, upper = score_bounds(queries, cells, ends.get(dim))
            same = own[:, None] == ids[None, :]
            lower[same] = upper[same] = -np.inf
            yield q, numbers, own, np.frombuffer(rows.as_buffer(), np.int64), ids, lower, upper


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the highest integer inner product for every query row."""
    rows = materialize(whole_numbers(vectors, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    ends = cell_bounds(rows)

    def to_cells(block: np.ndarray, dim: int) -> np.ndarray:
        return cell_numbers(block, ends[dim]) if dim else np.empty((len(block), 0), np.uint8)

    file = materialize(blocks(candidates(rows, k), ROWS_BLOCK, ("row", "vec_id"), to_cells, "cells"), "vafile")
    asked = rows.where(is_query).select("vec_id", "v", "dim").dropDuplicates()
    asked = materialize(asked.withColumn("query", F.monotonically_increasing_id()).withColumn("floor", F.lit(float("-inf"))), "queries")

    def packed(queries: DataFrame) -> DataFrame:
        return blocks(queries, QUERY_BLOCK, ("query", "vec_id", "floor"), lambda v, _: v.astype(float), "vectors")

    first = materialize(packed(asked), "query-blocks")
    high, wide = max(1, -(-file.count() // FILE_PART)), max(1, -(-first.count() // QUERY_PART))

    def grid(queries: DataFrame):
        """The parts of the file and of the queries by cell of the grid."""
        part = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = file.withColumn("i", part(high)).withColumn("j", each(wide))
        right = queries.withColumn("j", part(wide)).withColumn("i", each(high))
        return left.groupBy("i", "j").cogroup(right.groupBy("i", "j"))

    def floors(part: pa.Table, queries: pa.Table) -> pa.Table:
        best: dict[int, list] = {}
        for _, numbers, _, _, _, lower, _ in meetings(part, queries, ends):
            held = best.setdefault(int(numbers[0]), [numbers, np.empty((len(numbers), 0))])
            both = np.concatenate([held[1], lower], axis=1)
            held[1] = np.partition(both, -k, axis=1)[:, -k:] if both.shape[1] > k else both
        numbers = np.concatenate([np.empty(0, np.int64), *(np.repeat(n, x.shape[1]) for n, x in best.values())])
        return pa.table({"query": numbers.astype(np.int64), "low": np.concatenate([np.empty(0), *(x.ravel() for _, x in best.values())])})

    def near(part: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(4)]
        for q, numbers, own, at, ids, _, upper in meetings(part, queries, ends):
            who, which = np.nonzero((upper >= np.frombuffer(q["floor"], float)[:, None]) & np.isfinite(upper))
            for values, own_values in zip(found, (numbers[who], own[who], at[which], ids[which]), strict=True):
                values.append(own_values)
        return pa.table(dict(zip(("query", "query_id", "row", "vec_id"), map(np.concatenate, found), strict=True)))

    lows = grid(first).applyInArrow(floors, "query long, low double")
    kth = Window.partitionBy("query").orderBy(F.desc("low"))
    floor = lows.withColumn("_n", F.row_number().over(kth)).where(F.col("_n") <= k).groupBy("query").agg(
        F.min("low").alias("low"), F.count(F.lit(1)).alias("n")
    )
    # with fewer than k rows in all, every one of them is a result
    known = asked.drop("floor").join(floor, "query", "left")
    known = known.withColumn("floor", F.when(F.col("n") == k, F.col("low")).otherwise(float("-inf"))).drop("low", "n")
    left = materialize(grid(packed(known)).applyInArrow(near, "query long, query_id long, row long, vec_id long"), "survivors")
    exact = looked_up(left, rows.select("row", F.col("v").alias("x")), "row")
    exact = exact.join(asked.select("query", F.col("v").alias("y")), "query")
    score = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, p: s + p)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    ranked = exact.withColumn("score", score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
