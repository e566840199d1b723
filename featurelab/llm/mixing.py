"""Mixing sources to target weights by capped water-filling.

A budget is shared by weight; a source whose share is above ``max_epochs`` times its size is clamped
there, and the excess goes to the others by weight, until no share is above its cap. Each source
then gives whole repetitions of all its documents, and a seeded part of them once more.

The part is found by counting: documents are ordered by a hash of their key, sizes are added up per
source and range of the hash, and only the range in which the target is reached is looked at row by
row. No source, however large, is sorted as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from featurelab.functions.draws import digest
from featurelab.sources.work import materialize

# Ranges of the hash, as a power of 16.
_RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    """Words of a text, separated by ASCII white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def numbered_sources(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank``, from 0, by code point of ``source``, NULL last.

    Sources are sorted over ranges and numbered within each; a source table of any size works.
    """
    ordered = materialize(
        sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_uid", F.monotonically_increasing_id()), "sources"
    )
    ordered = ordered.withColumn("_part", F.shiftright("_uid", 33)).withColumn("_nth", F.col("_uid").bitwiseAND((1 << 33) - 1))
    parts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    shifts = parts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    return ordered.join(shifts, "_part").withColumn("rank", F.col("_nth") + F.col("_shift")).drop("_uid", "_part", "_nth", "_shift")


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """``sources`` (source, weight, source_size) with ``target``, a double.

    Targets add up to ``budget`` if the caps allow it, else every source is at its cap. Every pass
    clamps at least one source more; a pass is one sum over the table.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    left, level, done = float(budget), 0.0, 0.0
    clamped = -1
    while True:
        # A source is clamped once its cap is at most its share; the level per weight only rises.
        full = (cap <= F.col("weight") * F.lit(level)) if clamped >= 0 else F.lit(False)
        row = sources.agg(
            F.sum(F.when(full, cap).otherwise(0.0)).alias("done"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight").cast("double"))).alias("weight"),
            F.count(F.when(full, 1)).alias("clamped"),
        ).first()
        if row["clamped"] == clamped or not row["weight"]:
            break
        clamped, done = row["clamped"], row["done"]
        level = max(left - done, 0.0) / row["weight"]
    if not row["weight"]:
        level = float("inf")
    share = F.col("weight") * F.lit(level)
    return sources.withColumn("target", F.when(F.col("weight") > 0, F.least(cap, share)).otherwise(0.0).cast("double"))


def _told(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> DataFrame:
    """``docs`` as the struct ``row``, with id, of (the source), size, draw and its range."""
    text = F.col(text_col)
    draw = digest(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))), seed=seed)
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"),
        F.struct(F.col(source_col).alias("source")).alias("of"), word_count(text).alias("size"), draw.alias("draw"),
    ).withColumn("range", F.substring("draw", 1, _RANGE_DIGITS))


def _goals(told: DataFrame, weights: DataFrame | None, share: float, max_epochs: float, cycle: tuple[float, ...]) -> DataFrame:
    """One row per source: its size and target, whole repetitions, and where the last one ends.

    Documents of ranges before ``edge`` are taken once more, those after it are not; in it, documents
    are added to ``before`` words until ``extra`` is reached."""
    ranges = materialize(told.groupBy("of", "range").agg(F.sum("size").alias("words")), "ranges")
    sources = ranges.groupBy("of").agg(F.sum("words").alias("source_size")).select(F.col("of.source"), "source_size")
    if weights is None:
        chosen = F.array(*[F.lit(float(w)) for w in cycle])
        rank = (F.col("rank") % len(cycle) + 1).cast("int")
        weighted = numbered_sources(sources).withColumn("weight", F.element_at(chosen, rank)).drop("rank")
    else:
        named = weights.select(F.col(weights.columns[0]).alias("_source"), F.col(weights.columns[1]).cast("double").alias("_weight"))
        weighted = sources.join(named, F.col("source").eqNullSafe(F.col("_source")), "left")
        weighted = weighted.withColumn("weight", F.coalesce("_weight", F.lit(0.0))).drop("_source", "_weight")
    weighted = materialize(weighted, "weighted")
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    targets = water_fill(weighted, share * total, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    goals = targets.select(F.struct("source").alias("of"), "source_size", "target", whole.alias("whole"))
    goals = materialize(goals.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size")), "goals")
    before = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        ranges.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .join(goals, "of")
        .where("before + words > extra")
        .groupBy("of")
        .agg(F.min(F.struct("range", "before")).alias("edge"))
    )
    return materialize(
        goals.join(edges, "of", "left").select(*goals.columns, F.col("edge.range").alias("edge"), F.col("edge.before").alias("before")),
        "edges",
    )


def _copied(told: DataFrame, goals: DataFrame, max_epochs: float) -> DataFrame:
    """``told`` with the columns of ``goals`` and ``copies``. Only rows of an edge range are shuffled."""
    # A document without words is below any mark: without this bound a source at its cap gave it once more.
    most = F.lit(math.ceil(max_epochs)).cast("bigint")
    placed = told.join(goals, "of")
    at_edge = F.col("range").eqNullSafe(F.col("edge"))
    inside = Window.partitionBy("of", "range").orderBy("draw", "size", "id").rowsBetween(Window.unboundedPreceding, -1)
    # A document is in if half of it lies below the mark: the nearest that whole documents come.
    at = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    edge = placed.where(at_edge).withColumn("more", (at + F.col("size") / 2 <= F.col("extra")).cast("bigint"))
    rest = placed.where(~at_edge).withColumn("more", F.coalesce(F.col("range") < F.col("edge"), F.lit(True)).cast("bigint"))
    return edge.unionByName(rest).withColumn("copies", F.least(F.col("whole") + F.col("more"), most))


def mix(
    docs: DataFrame, weights: DataFrame | None = None, share: float = 1.5, max_epochs: float = 2.0, seed: int = 42,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", cycle: tuple[float, ...] = (5, 2, 1),
) -> DataFrame:
    """(id_col, source_col, size, source_size, target, copies, taken), one row per document.

    ``size`` is the number of words. The mix has ``share`` times all sizes. ``weights`` has source and
    weight; without it, sources by code point, NULL last, weigh ``cycle`` over and over. ``copies`` is
    how often the whole document is taken, ``taken`` is copies times size. Within a source, documents
    are copied once more in the order of a seeded hash of (id, text) until the target is met as nearly
    as whole documents can; no document is taken more than ``max_epochs`` times, rounded up.

    NULL text: size 0; documents of size 0 are copied like their neighbours in that order, within the
    same bound. NULL source:
    a source like any other. A source that ``weights`` lacks has weight 0. Equal rows share a hash and
    are taken one by one. An empty table gives an empty one. Other columns are not read.
    """
    told = materialize(_told(docs, id_col, source_col, text_col, seed).drop("row"), "sizes")
    copied = _copied(told, _goals(told, weights, share, max_epochs, cycle), max_epochs)
    return copied.select(
        F.col("id").alias(id_col), F.col("of.source").alias(source_col), "size", "source_size", "target",
        "copies", (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame, weights: DataFrame | None = None, share: float = 1.5, max_epochs: float = 2.0, seed: int = 42,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", cycle: tuple[float, ...] = (5, 2, 1),
) -> DataFrame:
    """The documents of the mix with all their columns, each as often as ``mix`` takes it."""
    told = _told(docs, id_col, source_col, text_col, seed)
    goals = _goals(materialize(told.drop("row"), "sizes"), weights, share, max_epochs, cycle)
    copied = _copied(told, goals, max_epochs).where("copies > 0")
    return copied.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("row.*")
