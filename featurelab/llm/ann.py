"""Approximate nearest neighbours: probed lists, scanned dimension by dimension.

Vectors are dealt to lists by nearest centre. A query probes its nearest lists, as many as a sample
needs for the recall asked for. Within a list, vectors are rotated at random and kept in blocks of
columns. After each block the squared distance so far, scaled up to all dimensions, estimates the
whole one; a candidate is abandoned once the estimate is above the k-th best distance by more than
the error that the test allows after so many dimensions. Survivors are measured exactly, in double
precision, on the vectors as they were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelab.llm.vectors import SAMPLE, best_of, centres, matrix, nearest, sampled, search_shards, squared_distances, usable
from featurelab.sources.work import materialize

# Lists, at most; larger ones are searched in parts.
MAX_LISTS = 1_024
# Sampled queries that the number of probes is set by.
PROBE_QUERIES = 256
# Columns of a block.
BLOCK = 16
# Error of the test, in units of 1 / sqrt(dimensions seen).
EPSILON = 2.1

_FOUND = "uid long, query_id long, vec_id long, score double"
_EMPTY = pa.schema([("uid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def rotation(dim: int, seed: int = 42) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def probes_for(points: np.ndarray, centre: np.ndarray, k: int, recall: float, queries: int = PROBE_QUERIES, seed: int = 42) -> int:
    """Lists to probe so that the share ``recall`` of the sample's true neighbours lies in them."""
    chosen = np.random.default_rng(seed).permutation(len(points))[:queries]
    own = nearest(points, centre)[0]
    gaps = squared_distances(points[chosen], points)
    gaps[np.arange(chosen.size), chosen] = np.inf
    near = np.argsort(gaps, axis=1, kind="stable")[:, : min(k, len(points) - 1)]
    place = np.argsort(np.argsort(squared_distances(points[chosen], centre), axis=1, kind="stable"), axis=1)
    needed = np.take_along_axis(place, own[near], axis=1).ravel()
    return int(np.quantile(needed, recall, method="higher")) + 1 if needed.size else 1


def _scan(vectors: pa.Table, wanted: pa.Table, turn: np.ndarray, k: int, epsilon: float) -> pa.Table:
    """The nearest k found in one list for each query, as far as they are within the query's bound."""
    if not vectors.num_rows or not wanted.num_rows:
        return _EMPTY.empty_table()
    dim = len(turn)
    ids, rows = vectors.column("id").to_numpy(), matrix(vectors.column("vector"), dim)
    turned = rows @ turn
    starts = range(0, dim, BLOCK)
    columns = [np.ascontiguousarray(turned[:, a : a + BLOCK]) for a in starts]
    slack = 1e-9 * (1.0 + np.abs(turned).max()) ** 2
    own, uid, asked = wanted.column("id").to_numpy(), wanted.column("uid").to_numpy(), matrix(wanted.column("vector"), dim)
    bound = wanted.column("bound").to_numpy()
    out = []
    for who, number, query, most in zip(own, uid, asked, bound, strict=True):
        q = query @ turn
        best_gap, best_id = np.zeros(0), np.zeros(0, np.int64)
        for first in range(0, len(ids), 4096):  # the bound gets tighter from stretch to stretch
            alive = first + np.flatnonzero(ids[first : first + 4096] != who)
            sums = np.zeros(alive.size)
            for a, column in zip(starts, columns, strict=True):
                part = column[alive] - q[a : a + BLOCK]
                sums += np.einsum("ij,ij->i", part, part)
                seen = min(a + BLOCK, dim)
                margin = (1 + epsilon / np.sqrt(seen)) ** 2 if seen < dim else 1.0
                kept = sums * (dim / seen) <= most * margin + slack
                alive, sums = alive[kept], sums[kept]
            if not alive.size:
                continue
            away = rows[alive] - query
            gap, found = np.concatenate([best_gap, (away * away).sum(axis=1)]), np.concatenate([best_id, ids[alive]])
            if gap.size > k:
                least = np.partition(gap, k - 1)[k - 1]
                kept = np.flatnonzero(gap <= least)
                gap, found = gap[kept], found[kept]
            order = np.lexsort((found, gap))[:k]
            best_gap, best_id = gap[order], found[order]
            if order.size == k:
                most = min(most, best_gap[-1])
        if best_gap.size:
            out.append((np.full(best_gap.size, number), np.full(best_gap.size, who), best_id, np.sqrt(best_gap)))
    if not out:
        return _EMPTY.empty_table()
    return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_EMPTY)


def nearest_neighbours(
    df: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.97,
    epsilon: float = EPSILON, sample_rows: int = SAMPLE, seed: int = 42,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each query row, by Euclidean distance.

    ``queries`` is a condition on ``id``; candidates are all rows of another id. The index is fitted on
    about ``sample_rows`` vectors and holds every row. ``recall`` sets how many lists are probed: the
    share of the sample's own neighbours that they hold; the test in the scan loses little more.

    Ties go to the smaller id; fewer candidates give fewer rows. Zero vectors take no part, nor do the
    rows that ``vectors.usable`` names. Repeated rows are candidates each, and queries each. An empty
    table gives an empty one.
    """
    spark = df.sparkSession
    vectors, dim = usable(df, id_col, vector_col)
    vectors = vectors.where("norm2 > 0 or exists(vector, x -> x <> 0)")
    facts = vectors.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(queries, 1)).alias("queries")).first()
    if not facts["rows"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    known, points = sampled(vectors, dim, sample_rows, seed)
    if not len(points):
        first = vectors.select("id", "vector").limit(1).toArrow()
        known, points = first.column("id").to_numpy(), matrix(first.column("vector"), dim)
    turn = rotation(dim, seed)
    centre = centres(points, int(min(MAX_LISTS, max(1, round(facts["rows"] ** 0.5 / 4)))), seed=seed)
    probes = probes_for(points, centre, k, recall, seed=seed)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = nearest(matrix(batch.column(2), dim), centre)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], ["uid", "id", "vector", "shard"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows = matrix(batch.column(2), dim)
                to = np.argsort(squared_distances(rows, centre), axis=1, kind="stable")
                # The first lists that hold k candidates are searched without a bound, so that k are found.
                place, free = np.arange(len(centre)), 1 + (np.cumsum(filled[to], axis=1) <= k).sum(axis=1)
                # In the others the k-th best distance to the sample bounds what is worth finding.
                gaps = squared_distances(rows, points)
                gaps[batch.column(1).to_numpy()[:, None] == known[None]] = np.inf
                bound = np.full(len(rows), np.inf)
                if gaps.shape[1] >= k:
                    bound = np.partition(gaps, k - 1, axis=1)[:, k - 1] * (1 + 1e-9) + 1e-9 * (1 + (rows * rows).sum(axis=1))
                i, j = np.nonzero(place[None] < np.maximum(probes, free)[:, None])
                part = batch.take(pa.array(i))
                limit = np.where(j < free[i], np.inf, bound[i])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(to[i, j].astype(np.int32)), pa.array(limit)], ["uid", "id", "vector", "shard", "bound"]
                )

    def scan(vectors: pa.Table, wanted: pa.Table) -> pa.Table:
        return _scan(vectors, wanted, turn, k, epsilon)

    base = vectors.select("uid", "id", "vector")
    keyed = materialize(base.mapInArrow(key, "uid long, id long, vector array<double>, shard int"), "keyed")
    sizes = {r["shard"]: r["count"] for r in keyed.groupBy("shard").count().collect()}  # at most MAX_LISTS rows
    filled = np.array([sizes.get(c, 0) for c in range(len(centre))])
    asked = base.where(queries).mapInArrow(ask, "uid long, id long, vector array<double>, shard int, bound double")
    found = search_shards(keyed, sizes, asked, facts["queries"], scan, _FOUND)
    return best_of(found, k, F.asc("score")).select("query_id", "rank", "vec_id", "score")
