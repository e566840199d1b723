"""Vector tables: what searches share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from featurelab.sources.work import materialize

# Vectors an index is fitted on, at most about.
SAMPLE = 16_384
# Vectors of one task of a search.
TASK_ROWS = 32_768
# Queries of one task of a search.
TASK_QUERIES = 16_384


def usable(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """A written table (uid, id, vector, norm2) of the vectors that take part, and their dimension.

    Left out: NULL ids and vectors, empty vectors, vectors with a NULL or non-finite component, and
    vectors of another length than most have (of two equally common lengths the longer counts).
    ``uid`` numbers rows, so that rows of one id stay apart.
    """
    told = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False)))
    told = told.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)
    norm2 = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    staged = materialize(told.withColumn("norm2", norm2).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    lengths = staged.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = lengths["dim"] if lengths else 0
    return staged.where(F.size("vector") == dim), dim


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """A column of vectors as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def sampled(vectors: DataFrame, dim: int, rows: int = SAMPLE, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of about ``rows`` rows at most."""
    total = vectors.count()
    table = vectors.select("id", "vector").sample(min(1.0, rows / max(1, total)), seed).toArrow().sort_by("id")
    return table.column("id").to_numpy(), matrix(table.column("vector"), dim)


def centres(points: np.ndarray, count: int, rounds: int = 10, seed: int = 42) -> np.ndarray:
    """Means of ``count`` groups at most, by Lloyd's method."""
    draws = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    found = distinct[draws.permutation(len(distinct))[:count]]
    for _ in range(rounds):
        own = nearest(points, found)[0]
        sizes = np.bincount(own, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, own, points)
        found = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], found)
    return found


def nearest(points: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, distance) of the nearest of ``found`` for every point."""
    own, gap = np.zeros(len(points), dtype=np.int64), np.zeros(len(points))
    for at in range(0, len(points), 4096):
        part = points[at : at + 4096]
        squares = squared_distances(part, found)
        own[at : at + 4096] = squares.argmin(axis=1)
        gap[at : at + 4096] = np.sqrt(((part - found[own[at : at + 4096]]) ** 2).sum(axis=1))
    return own, gap


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T, 0.0)


def search_shards(
    keyed: DataFrame, sizes: dict[int, int], asked: DataFrame, queries: int,
    scan: Callable[[pa.Table, pa.Table], pa.Table], schema: str, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """``scan`` of the vectors and the queries of every shard.

    ``keyed`` has shard, uid and what ``scan`` reads; ``asked`` has one row per query and shard it asks
    for. A shard of more than ``task_rows`` vectors is searched in parts, to which its queries go
    in copies; more than ``TASK_QUERIES`` queries come in groups, to which the vectors go in copies.
    So no task holds more, whatever share of the table is in one shard.
    """
    parts = {shard: -(-size // task_rows) for shard, size in sizes.items() if size > task_rows}
    many = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair]) if parts else None
    count = F.coalesce(many[F.col("shard")], F.lit(1)) if parts else F.lit(1)
    groups = max(1, -(-queries // TASK_QUERIES))
    left = keyed.withColumn("part", F.pmod(F.xxhash64("uid"), count).cast("int"))
    left = left.withColumn("group", F.explode(F.array(*[F.lit(g) for g in range(groups)])) if groups > 1 else F.lit(0))
    right = asked.withColumn("part", F.explode(F.sequence(F.lit(0), count - 1)) if parts else F.lit(0))
    right = right.withColumn("group", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int") if groups > 1 else F.lit(0))
    keys = ["shard", "part", "group"]

    def run(vectors: pa.Table, wanted: pa.Table) -> pa.Table:
        return scan(vectors, wanted)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def best_of(found: DataFrame, k: int, order: Column) -> DataFrame:
    """The first ``k`` rows of each query (``uid``) by ``order`` and vec_id, with their ``rank`` from 1."""
    by = Window.partitionBy("uid").orderBy(order, "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
