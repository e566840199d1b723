"""Uniform shuffle into shards of exact size, by a communication matrix.

Rows are permuted within their partition while they are staged. How many rows each partition sends
to each shard is drawn, exactly, from the multivariate hypergeometric distribution that a uniform
permutation of all rows would give. The first rows of a partition then go to shard 0, the next to
shard 1, and so on; every shard permutes what it has received.

The matrix is drawn by DataFrame expressions only, down a tree over the partitions: a node splits
its row counts for all shards among at most ``FAN`` children, so a level is one join and the nodes
of a level are drawn side by side. A single draw inverts the distribution, walking from its mode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from featurelab.llm.common import number_within
from featurelab.sources.work import materialize

# Children of a node of the tree over partitions, as a power of two.
_FAN_BITS = 6
# Rows that one task permutes in a shard, about.
BLOCK_ROWS = 500_000
# Standard deviations from the mode that a draw covers; what lies beyond has a chance below 1e-22.
_REACH = 10


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _walk(weight: Column, steps: Column, target: Column, ratio: Callable[[Column], Column]) -> Column:
    """(sum, below): all weights from ``weight`` on, and how many partial sums stay below ``target``."""
    start = F.struct(
        weight.alias("weight"), F.lit(0.0).alias("sum"), F.lit(0).cast("bigint").alias("below")
    )

    def step(state: Column, i: Column) -> Column:
        total = state["sum"] + state["weight"]
        return F.struct(
            (state["weight"] * ratio(i)).alias("weight"),
            total.alias("sum"),
            (state["below"] + F.when(total < target, 1).otherwise(0)).cast("bigint").alias("below"),
        )

    return F.aggregate(F.sequence(F.lit(1).cast("bigint"), steps), start, step)


def hypergeometric(total: Column, marked: Column, drawn: Column, chance: Column) -> Column:
    """How many of ``drawn`` rows, taken from ``total`` of which ``marked`` are marked, are marked.

    ``chance`` is a uniform number in [0, 1); the result is a whole number within its exact bounds.
    """
    N, m, n = (x.cast("double") for x in (total, marked, drawn))
    safe = F.greatest(N, F.lit(2.0))
    spread = F.sqrt(n * m / safe * (N - m) / safe * (N - n) / (safe - 1))
    low, high = F.greatest(F.lit(0.0), n + m - N), F.least(n, m)
    mode = F.least(high, F.greatest(low, F.floor((n + 1) * (m + 1) / (N + 2)).cast("double")))
    facts = F.struct(
        N.alias("all"), m.alias("marked"), n.alias("drawn"), low.alias("low"), high.alias("high"), mode.alias("mode"),
        F.ceil(spread * _REACH + 16).cast("bigint").alias("steps"), chance.alias("chance"),
    )

    def draw(f: Column) -> Column:
        def up(i: Column) -> Column:  # from mode + i - 1 to mode + i; nothing follows the upper bound
            x = f["mode"] + i - 1
            return F.greatest(f["marked"] - x, F.lit(0.0)) * F.greatest(f["drawn"] - x, F.lit(0.0)) / (
                (x + 1) * F.greatest(f["all"] - f["marked"] - f["drawn"] + x + 1, F.lit(1.0))
            )

        def down(i: Column) -> Column:  # from mode - i + 1 to mode - i
            x = f["mode"] - i + 1
            return F.greatest(x, F.lit(0.0)) * F.greatest(f["all"] - f["marked"] - f["drawn"] + x, F.lit(0.0)) / (
                F.greatest(f["marked"] - x + 1, F.lit(1.0)) * F.greatest(f["drawn"] - x + 1, F.lit(1.0))
            )

        one, none = F.lit(1.0), F.lit(-1.0)
        sums = F.struct(
            _walk(one, f["steps"], none, up)["sum"].alias("up"), (_walk(one, f["steps"], none, down)["sum"] - 1).alias("down")
        )

        def place(s: Column) -> Column:
            target = f["chance"] * (s["up"] + s["down"])
            above = f["mode"] + _walk(one, f["steps"], target, up)["below"]
            # Downwards the mode itself is passed first: its weight of 1 is added to the target.
            below = f["mode"] - _walk(one, f["steps"], target - s["up"] + 1, down)["below"]
            return F.when(target <= s["up"], above).otherwise(below)

        return F.least(f["high"], F.greatest(f["low"], _let(sums, place))).cast("bigint")

    return _let(facts, draw)


def _chance(seed: int, *keys: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))


def _split(kids: Column, counts: Column, level: int, shards: int, seed: int) -> Column:
    """Counts of every child: its rows drawn from what the children before it have left over."""

    def child_counts(rest: Column, kid: Column) -> Column:
        start = F.struct(
            F.aggregate(rest, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
            kid["rows"].alias("rows"),
            F.array().cast("array<bigint>").alias("out"),
        )

        def one(state: Column, k: Column) -> Column:
            marked = F.get(rest, k)
            got = F.when(marked == state["total"], state["rows"]).otherwise(
                hypergeometric(state["total"], marked, state["rows"], _chance(seed, F.lit(level), kid["child"], k))
            )
            return _let(
                got,
                lambda g: F.struct(
                    (state["total"] - marked).alias("total"),
                    (state["rows"] - g).alias("rows"),
                    F.concat(state["out"], F.array(g)).alias("out"),
                ),
            )

        return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), start, one)["out"]

    start = F.struct(
        counts.alias("rest"), F.array().cast("array<struct<child:bigint,counts:array<bigint>>>").alias("out")
    )

    def step(state: Column, kid: Column) -> Column:
        return _let(
            child_counts(state["rest"], kid),
            lambda got: F.struct(
                F.zip_with(state["rest"], got, lambda a, b: a - b).alias("rest"),
                F.concat(state["out"], F.array(F.struct(kid["child"].alias("child"), got.alias("counts")))).alias("out"),
            ),
        )

    return F.aggregate(kids, start, step)["out"]


def communication_matrix(parts: DataFrame, sizes: list[int], seed: int = 42) -> DataFrame:
    """(part, counts): rows each part sends to each shard.

    ``parts`` has a whole number ``part`` from 0 on and its ``rows``, which add up to ``sizes``. Rows
    and columns of the matrix add up exactly, and it is distributed as under a uniform permutation.
    """
    spark = parts.sparkSession
    last = parts.agg(F.max("part")).first()[0] or 0
    height = max(1, -(-int(last).bit_length() // _FAN_BITS))
    nodes = spark.range(1).select(
        F.lit(0).cast("bigint").alias("node"), F.array(*[F.lit(s).cast("bigint") for s in sizes]).alias("counts")
    )
    for level in range(height - 1, -1, -1):
        kids = (
            parts.groupBy(F.shiftright("part", _FAN_BITS * level).cast("bigint").alias("child"))
            .agg(F.sum("rows").alias("rows"))
            .groupBy(F.shiftright("child", _FAN_BITS).alias("node"))
            .agg(F.array_sort(F.collect_list(F.struct("child", "rows"))).alias("kids"))
        )
        split = _split(F.col("kids"), F.col("counts"), level, len(sizes), seed)
        nodes = nodes.join(kids, "node").select(F.inline(split)).withColumnRenamed("child", "node")
        nodes = materialize(nodes, "matrix")
    return nodes.withColumnRenamed("node", "part")


def uniform_shards(df: DataFrame, shards: int, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows and columns of ``df`` with ``shard``, from 0, and ``slot``, gapless from 0 in each shard.

    Shard sizes differ by at most one row. The order of rows over shards and slots is a uniform
    permutation, however the rows are partitioned: a hot group of equal rows is spread evenly. NULLs
    and repeated rows are rows like any other; an empty table gives an empty one. Columns of ``df``
    called ``shard`` or ``slot`` are replaced; any other name is free.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "slot")]
    staged = materialize(
        df.select(F.struct(*kept).alias("row"), F.rand(seed).alias("draw"))
        .sortWithinPartitions("draw")
        .select("row", F.monotonically_increasing_id().alias("uid")),
        "staged",
    ).select("row", "uid", F.shiftright("uid", 33).alias("part"), F.col("uid").bitwiseAND((1 << 33) - 1).alias("nth"))
    parts = materialize(staged.groupBy("part").agg(F.count(F.lit(1)).alias("rows")), "parts")
    total = parts.agg(F.sum("rows")).first()[0] or 0
    sizes = [total // shards + (k < total % shards) for k in range(shards)]
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("ends"))

    def add(state: Column, count: Column) -> Column:
        return F.struct(
            (state["at"] + count).alias("at"), F.concat(state["ends"], F.array(state["at"] + count)).alias("ends")
        )

    ends = communication_matrix(parts, sizes, seed).select("part", F.aggregate("counts", start, add)["ends"].alias("ends"))
    sent = staged.join(ends, "part").select(
        "row", "uid",
        F.size(F.filter("ends", lambda e: e <= F.col("nth"))).alias("shard"),
        F.xxhash64(F.lit(seed + 1), "uid").alias("draw"),
    )
    blocks = max(1, -(-(total // shards) // block_rows))
    sent = materialize(sent.withColumn("block", F.pmod(F.shiftrightunsigned("draw", 32), F.lit(blocks)).cast("int")), "sent")
    inside = Window.partitionBy("shard", "block").orderBy("draw", "uid")
    numbered = number_within(sent.withColumn("slot", F.row_number().over(inside) - 1), ["shard"], "block", "slot")
    return numbered.select("row.*", "shard", "slot")
