"""Exact top-k search by inner product on a pivot-distance index.

With one more component, sqrt(M - |x|^2) for the largest squared norm M, all vectors have the same
norm, and the largest inner product is the smallest Euclidean distance to the query with 0 there.
Vectors are keyed by their nearest pivot and the distance to it, and each pivot's distances are cut
into annuli, the shards.

A query first searches the annulus it would lie in itself. With its k-th best score there, r is the
distance that a better vector must stay within; by the triangle inequality it then lies in an
annulus that meets [d - r, d + r], d being the query's distance to the pivot. Only those are searched
next, and of them only the rows in that range, outward from the query's own distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelab.llm.vectors import best_of, centres, matrix, nearest, sampled, search_shards, usable
from featurelab.sources.work import materialize

PIVOTS = 32
# Annuli of one pivot, at most; larger ones are searched in parts.
ANNULI = 64
# Vectors of an annulus, about.
ANNULUS_ROWS = 8_192
# Vectors the pivots are fitted on.
PIVOT_SAMPLE = 4_096
# Rows scored at a time.
_ROWS = 2_048

_FOUND = "uid long, query_id long, vec_id long, score double"
_EMPTY = pa.schema([("uid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _lifted(vectors: np.ndarray, norm2: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([vectors, np.sqrt(np.maximum(most - norm2, 0.0))])


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best, ties to the smaller id."""
    if score.size > k:
        least = np.partition(score, score.size - k)[score.size - k]
        kept = np.flatnonzero(score >= least)
        return kept[np.lexsort((ids[kept], -score[kept]))[:k]]
    return np.lexsort((ids, -score))


def _scan(vectors: pa.Table, wanted: pa.Table, dim: int, k: int, most: float) -> pa.Table:
    """The best k of one shard for each query, as far as they reach the query's bound."""
    if not vectors.num_rows or not wanted.num_rows:
        return _EMPTY.empty_table()
    gap = vectors.column("gap").to_numpy()
    order = np.argsort(gap, kind="stable")
    gap, ids, rows = gap[order], vectors.column("id").to_numpy()[order], matrix(vectors.column("vector"), dim)[order]
    own, query, far = (wanted.column(c).to_numpy() for c in ("id", "norm2", "gap"))
    uid, bound, asked = wanted.column("uid").to_numpy(), wanted.column("bound").to_numpy().copy(), matrix(wanted.column("vector"), dim)
    out = []
    for start in range(0, len(own), 256):
        part = slice(start, start + 256)
        q, low, high, who = asked[part], bound[part], far[part], own[part]
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(q)
        # Outward from the middle of the block's own distances.
        blocks = sorted(range(0, len(ids), _ROWS), key=lambda a: abs(gap[min(a + _ROWS // 2, len(ids) - 1)] - high.mean()))
        for a in blocks:
            b = min(a + _ROWS, len(ids))
            reach = np.sqrt(np.maximum(query[part] + most - 2 * low, 0.0)) * (1 + 1e-9) + 1e-6
            near = np.flatnonzero((gap[a] <= high + reach) & (gap[b - 1] >= high - reach))
            if not near.size:
                continue
            scores = q[near] @ rows[a:b].T
            for i, line in zip(near, scores, strict=True):
                hits = np.flatnonzero((line >= low[i]) & (ids[a:b] != who[i]))
                if not hits.size:
                    continue
                s, v = np.concatenate([best[i][0], line[hits]]), np.concatenate([best[i][1], ids[a:b][hits]])
                chosen = _best(s, v, k)
                best[i] = (s[chosen], v[chosen])
                if chosen.size == k:
                    low[i] = max(low[i], best[i][0][-1])
        for i, (s, v) in enumerate(best):
            if s.size:
                out.append((np.full(s.size, uid[start + i]), np.full(s.size, who[i]), v, s))
    if not out:
        return _EMPTY.empty_table()
    return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_EMPTY)


def top_k(
    df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS,
    annulus_rows: int = ANNULUS_ROWS, sample_rows: int = PIVOT_SAMPLE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product with each query row.

    ``queries`` is a condition on ``id`` that marks the query rows; candidates are all rows of another id.
    Scores are sums in double precision, exact for whole numbers below 2**53. Ties go to the smaller id;
    fewer candidates give fewer rows. Rows that take no part: see ``vectors.usable``. Repeated rows are
    candidates each, and queries each. An empty table gives an empty one.
    """
    spark = df.sparkSession
    vectors, dim = usable(df, id_col, vector_col)
    facts = vectors.agg(F.count(F.lit(1)).alias("rows"), F.max("norm2").alias("most"), F.count(F.when(queries, 1)).alias("queries")).first()
    if not facts["rows"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most = facts["most"]
    known, points = sampled(vectors, dim, sample_rows)
    if not len(points):
        first = vectors.select("id", "vector").limit(1).toArrow()
        known, points = first.column("id").to_numpy(), matrix(first.column("vector"), dim)
    lifted = _lifted(points, (points * points).sum(axis=1), most)
    pivot = centres(lifted, pivots)
    own, far = nearest(lifted, pivot)
    annuli = int(min(ANNULI, max(1, facts["rows"] // (annulus_rows * len(pivot)))))
    inner = [np.quantile(far[own == p], np.arange(1, annuli) / annuli) if (own == p).any() else np.zeros(annuli - 1) for p in range(len(pivot))]

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, gap = nearest(_lifted(matrix(batch.column(2), dim), batch.column(3).to_numpy(), most), pivot)
            ring = np.zeros(len(own), dtype=np.int64)
            for p in np.unique(own):
                ring[own == p] = np.searchsorted(inner[p], gap[own == p], "right")
            shard = pa.array((own * annuli + ring).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], shard, pa.array(gap)], ["uid", "id", "vector", "shard", "gap"])

    keyed = vectors.select("uid", "id", "vector", "norm2").mapInArrow(key, "uid long, id long, vector array<double>, shard int, gap double")
    keyed = materialize(keyed, "keyed")
    # At most PIVOTS * ANNULI rows.
    shards = keyed.groupBy("shard").agg(F.min("gap").alias("low"), F.max("gap").alias("high"), F.count(F.lit(1)).alias("rows")).collect()
    ring = np.array([(s["shard"], s["low"], s["high"]) for s in sorted(shards)])
    number, low, high = ring[:, 0].astype(np.int64), ring[:, 1], ring[:, 2]
    sizes = {s["shard"]: s["rows"] for s in shards}

    def ask(home: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch = whole.slice(at, 1024)
                    rows, norm2 = matrix(batch.column(2), dim), batch.column(3).to_numpy()
                    to = np.column_stack([rows, np.zeros(len(rows))])
                    # Differences, not the expanded square: the bounds must not lose digits.
                    dist = np.stack([np.sqrt(((to - p) ** 2).sum(axis=1)) for p in pivot], axis=1)[:, number // annuli]
                    away = np.maximum(np.maximum(low - dist, dist - high), 0.0)
                    score = rows @ points.T
                    score[batch.column(1).to_numpy()[:, None] == known[None]] = -np.inf
                    bound = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(rows), -np.inf)
                    # Sums of products may differ in their last digits from one block to another.
                    bound = np.maximum(bound, batch.column(4).to_numpy()) - 1e-12 * np.sqrt(norm2 * most)
                    first = np.lexsort((dist, away), axis=1)[:, 0] if len(number) > 1 else np.zeros(len(rows), int)
                    if home:
                        meets = np.zeros(away.shape, dtype=bool)
                        meets[np.arange(len(rows)), first] = True
                    else:
                        reach = np.sqrt(np.maximum(norm2 + most - 2 * bound, 0.0)) * (1 + 1e-9) + 1e-6
                        meets = away <= reach[:, None]
                        meets[np.arange(len(rows)), first] = False
                    i, j = np.nonzero(meets)
                    part = batch.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[:4], pa.array(number[j].astype(np.int32)), pa.array(dist[i, j]), pa.array(bound[i])],
                        ["uid", "id", "vector", "norm2", "shard", "gap", "bound"],
                    )

        return run

    def scan(vectors: pa.Table, wanted: pa.Table) -> pa.Table:
        return _scan(vectors, wanted, dim, k, most)

    asking = "uid long, id long, vector array<double>, norm2 double, shard int, gap double, bound double"
    told = vectors.where(queries).select("uid", "id", "vector", "norm2")
    nothing = F.lit(float("-inf")).alias("bound")
    near = told.select("*", nothing).mapInArrow(ask(True), asking)
    at_home = materialize(search_shards(keyed, sizes, near, facts["queries"], scan, _FOUND), "home")
    reached = at_home.groupBy("uid").agg(F.get(F.sort_array(F.collect_list("score"), False), F.lit(k - 1)).alias("bound"))
    rest = told.join(reached, "uid", "left").select(*told.columns, F.coalesce("bound", nothing).alias("bound"))
    further = search_shards(keyed, sizes, rest.mapInArrow(ask(False), asking), facts["queries"], scan, _FOUND)
    return best_of(at_home.unionByName(further), k, F.desc("score")).select("query_id", "rank", "vec_id", "score")
