"""How many genomes of equal score are unlike a genome, counted without listing pairs.

Every group of equal scores is cut into cells: the nearest of a few vantage points and the
distance to it in rings. The triangle inequality settles most cells as a whole, all alike or
all unlike; genomes of the other cells are compared in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from featurelab.operators.sized import broadcast_if_small
from featurelab.sources.work import materialize

VANTAGE_POINTS = 16  # of a group
BLOCK = 2048  # genomes compared with as many in one task, about
_ROWS_AT_ONCE = 1024


def _bits(genomes: pa.Array, length: int) -> np.ndarray:
    joined = "".join(genomes.to_pylist()).encode()
    if len(joined) != len(genomes) * length:
        raise ValueError(f"every genome needs {length} genes")
    return np.frombuffer(joined, dtype=np.uint8).reshape(len(genomes), length)


def unlike_peers(
    solutions: DataFrame, length: int, run: str = "run_id", warn_below: float = 0.95,
    vantage_points: int = VANTAGE_POINTS, block: int = BLOCK,
) -> DataFrame:
    """Per distinct (run, score, genome) with peers: ``equal_scores``, the other rows with its run and score,
    and ``unlike_peers``, those of them that share less than ``warn_below`` of its genes.

    Exact. Repeated rows are peers of each other and count one by one, in one result row; rows without run,
    score or genome are left out; a genome of another length than ``length`` raises an error; an empty table
    gives an empty result. Genomes spread evenly over all bits leave most cells open: their blocks are all compared.
    """
    radius = max((h for h in range(length + 1) if (length - h) / length >= warn_below), default=-1)
    width, group = max(1, radius // 2), ["_run", "score"]
    cell = [*group, "_point", "_ring"]
    named = solutions.select(F.col(run).alias("_run"), F.col("score").cast("double").alias("score"), F.col("genome").cast("string").alias("genome"))
    kinds = materialize(named.na.drop().groupBy(*group, "genome").agg(F.count(F.lit(1)).alias("_copies")), "kinds")

    drawn = Window.partitionBy(*group).orderBy(F.xxhash64("genome"), "genome")
    points = (
        kinds.withColumn("_nth", F.row_number().over(drawn))
        .filter(F.col("_nth") <= vantage_points)
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list("genome")).alias("_points"))
    )  # at most vantage_points a group

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS_AT_ONCE):
                batch = whole.slice(start, _ROWS_AT_ONCE)
                of_row = batch.column("_points")
                ends = np.r_[0, np.cumsum(of_row.value_lengths().to_numpy())].astype(np.int32)
                rows = np.repeat(np.arange(batch.num_rows), np.diff(ends))
                away = (_bits(batch.column("genome"), length)[rows] != _bits(of_row.flatten(), length)).sum(axis=1)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(away.astype(np.int32)))
                kept = [batch.column(c) for c in (*group, "genome", "_copies")]
                yield pa.RecordBatch.from_arrays([*kept, lists], names=[*group, "genome", "_copies", "_away"])

    fields = {f.name: f.dataType.simpleString() for f in kinds.schema}
    columns = ", ".join(f"{c} {fields[c]}" for c in (*group, "genome", "_copies"))
    placed = (
        kinds.join(broadcast_if_small(points), group)
        .mapInArrow(distances, f"{columns}, _away array<int>")
        .withColumn("_near", F.array_min("_away"))
        .withColumn("_point", F.array_position("_away", F.col("_near")).cast("int") - 1)
        .withColumn("_ring", F.floor(F.col("_near") / width).cast("int"))
    )
    placed = materialize(placed, "placed")

    cells = placed.groupBy(*cell).agg(
        F.min("_near").alias("low"), F.max("_near").alias("high"), F.sum("_copies").alias("rows"), F.count(F.lit(1)).alias("kinds")
    )
    listed = cells.groupBy(*group).agg(
        F.sum("rows").alias("_rows"),
        F.collect_list(F.struct(F.col("_point").alias("point"), F.col("_ring").alias("ring"), "low", "high", "rows", "kinds")).alias("_cells"),
    ).filter(F.col("_rows") > 1)  # at most vantage_points * (length / width + 1) cells a group
    here = placed.join(broadcast_if_small(listed), group)

    def distance(c):
        return F.element_at("_away", c["point"] + 1)

    def apart(c):
        return F.greatest(distance(c) - c["high"], c["low"] - distance(c)) > radius

    def undecided(c):
        return ~apart(c) & (distance(c) + c["high"] > radius)

    settled = here.select(
        *group, "genome", (F.col("_rows") - 1).alias("equal_scores"),
        F.aggregate(F.filter("_cells", apart), F.lit(0).cast("bigint"), lambda n, c: n + c["rows"]).alias("unlike"),
    )
    visits = here.select(*group, "genome", F.explode(F.filter("_cells", undecided)).alias("c")).select(
        *group, F.col("c.point").alias("_point"), F.col("c.ring").alias("_ring"), "genome",
        F.ceil(F.col("c.kinds") / block).cast("int").alias("_members"),
    )
    visits = materialize(visits, "visits")
    asked = visits.groupBy(*cell).agg(
        F.max("_members").alias("_members"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_visitors")
    )
    asked = broadcast_if_small(asked)

    def part(count: str):
        return F.pmod(F.xxhash64("genome"), F.col(count)).cast("int")

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    blocks = [*cell, "_m", "_v"]
    left = visits.drop("_members").join(asked, cell).withColumn("_v", part("_visitors")).withColumn("_m", every("_members"))
    right = placed.select(*cell, "genome", "_copies").join(asked, cell)
    right = right.withColumn("_m", part("_members")).withColumn("_v", every("_visitors"))

    def compare(rows: pa.Table) -> pa.Table:
        member = rows.column("_member").to_numpy()
        visitors, members = rows.filter(pa.array(~member)), rows.filter(pa.array(member))
        a, b = (
            (_bits(t.column("genome").combine_chunks(), length) == ord("1")).astype(np.float32) for t in (visitors, members)
        )
        away = a.sum(axis=1)[:, None] + b.sum(axis=1) - 2 * (a @ b.T)
        unlike = (away > radius).astype(np.int64) @ members.column("_copies").to_numpy()
        return visitors.select([*group, "genome"]).append_column("unlike", pa.array(unlike))

    schema = f"{', '.join(f'{c} {fields[c]}' for c in (*group, 'genome'))}, unlike bigint"
    sides = [
        side.select(*blocks, "genome", copies.alias("_copies"), F.lit(member).alias("_member"))
        for side, copies, member in [(left, F.lit(0).cast("bigint"), False), (right, F.col("_copies"), True)]
    ]
    compared = sides[0].unionByName(sides[1]).groupBy(*blocks).applyInArrow(compare, schema)
    both = settled.unionByName(compared.withColumn("equal_scores", F.lit(None).cast("bigint")))
    return both.groupBy(*group, "genome").agg(
        F.max("equal_scores").alias("equal_scores"),
        (F.sum("unlike") - int(radius < 0)).alias("unlike_peers"),  # itself is no peer
    ).withColumnRenamed("_run", run)
