"""Genetic search over populations held in one DataFrame.

Every row is an individual ``(run_id, idx, genome, score)``; a run holds ``n`` of them
and ``n`` is a setting, so a window over one run stays small however many runs there
are. Rows are hash-partitioned by ``run_id`` once. All steps of a generation keep that
partitioning: partners come from a window over the pair, and parents and children from
one exploded row, so that a generation needs no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType
from pyspark.sql.window import Window, WindowSpec

from featurelab.functions import genes
from featurelab.functions.draws import SEED, integer, uniform
from featurelab.sources.work import cut_lineage, materialize

# Share of equal individuals that counts as standing still, and how many
# such generations end a run of the generic search and of the feature search.
STILL_SHARE = 0.8
STILL_LIMIT = 50
STILL_LIMIT_FEATURES = 10

# Genomes of equal score that one task counts by itself, at most.
LIKENESS_BLOCK = 2048


def per_run() -> WindowSpec:
    return Window.partitionBy("run_id")



def random_population(runs: DataFrame, length: int, seed: int = SEED) -> DataFrame:
    """``n`` random genomes for each row of ``runs`` (run_id, n, ...)."""
    return runs.withColumn("idx", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")))).withColumn(
        "genome", genes.random_genome(length, F.col("run_id"), F.col("idx"), seed=seed)
    )


def random_masks(
    runs: DataFrame, baseline: list[str], exmodel: list[str], max_features: int, seed: int = SEED
) -> DataFrame:
    """Random feature masks: how many features, how many of them baseline, and which.

    The total is uniform on 0..max_features, the baseline part uniform on 0..all and
    capped by the total; earlier models' outputs fill the rest, never more than there are.
    Features are the ones with the smallest draws, so each set is equally likely.
    """
    people = runs.withColumn(
        "idx", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")))
    )
    who = (F.col("run_id"), F.col("idx"))
    total = integer(max_features + 1, *who, "total", seed=seed)
    base = F.least(integer(len(baseline) + 1, *who, "baseline", seed=seed), total)
    people = people.withColumn("_base", base).withColumn(
        "_extra", F.least(total - F.col("_base"), F.lit(len(exmodel)))
    )

    def bits(names: list[str], part: str, wanted: Column) -> Column:
        if not names:
            return F.lit("")
        places = F.sequence(F.lit(0), F.lit(len(names) - 1))
        draws = F.transform(
            places, lambda i: F.struct(uniform(*who, part, i, seed=seed).alias("u"), i.alias("i"))
        )
        # Smallest draws first: split once into set and unset genes, then back in place.
        ordered, size = F.array_sort(draws), wanted.cast("int")

        def marked(part: Column, gene: str) -> Column:
            return F.transform(part, lambda d: F.struct(d["i"].alias("i"), F.lit(gene).alias("gene")))

        on = marked(F.slice(ordered, F.lit(1), size), "1")
        off = marked(F.slice(ordered, size + 1, F.lit(len(names))), "0")
        return F.array_join(F.transform(F.array_sort(F.concat(on, off)), lambda g: g["gene"]), "")

    return (
        people.withColumn("baseline_genes", bits(baseline, "b", F.col("_base")))
        .withColumn("exmodel_genes", bits(exmodel, "x", F.col("_extra")))
        .withColumn("genome", F.concat("baseline_genes", "exmodel_genes"))
        .drop("_base", "_extra")
    )


def with_features(population: DataFrame, baseline: list[str], exmodel: list[str]) -> DataFrame:
    """The feature names a genome stands for, split at the number of baseline features."""
    size = len(baseline)
    base = F.substring("genome", 1, size)
    extra = F.substring("genome", size + 1, max(1, len(exmodel)))
    return population.withColumns(
        {
            "baseline_genes": base,
            "exmodel_genes": extra,
            "baseline_features": genes.selected(base, baseline),
            "exmodel_features": genes.selected(extra, exmodel),
        }
    )


def inconsistent(population: DataFrame, baseline: list[str], exmodel: list[str]) -> DataFrame:
    """Rows whose features, parts and genome do not agree. Empty means all is well."""
    want_base = genes.selected(F.col("baseline_genes"), baseline)
    want_extra = genes.selected(F.col("exmodel_genes"), exmodel)
    agrees = (
        (F.array_sort("baseline_features") == F.array_sort(want_base))
        & (F.array_sort("exmodel_features") == F.array_sort(want_extra))
        & (F.col("genome") == F.concat("baseline_genes", "exmodel_genes"))
    )
    return population.filter(~F.coalesce(agrees, F.lit(False)))


def ranked(population: DataFrame) -> DataFrame:
    """``idx`` renumbered from the best score; equal scores keep their order."""
    order = per_run().orderBy(F.col("score").desc_nulls_last(), "idx")
    return population.withColumn("idx", F.row_number().over(order) - 1)


def crossed(
    population: DataFrame,
    generation,
    pc: Column | float,
    seed: int = SEED,
    out: str = "genome",
    size: Column | None = None,
) -> DataFrame:
    """Best with worst, second best with second worst, ...: each pair crosses with probability ``pc``.

    ``size``: rows of the run, where they are known."""
    n, idx = F.count(F.lit(1)).over(per_run()) if size is None else size, F.col("idx")
    data = population.withColumn("_n", n).withColumn("_pair", F.least(idx, F.col("_n") - 1 - idx))
    pair = Window.partitionBy("run_id", "_pair")
    partner = F.when(
        idx == F.col("_pair"), F.max_by("genome", "idx").over(pair)
    ).otherwise(F.min_by("genome", "idx").over(pair))
    key = (F.col("run_id"), F.lit(generation), F.col("_pair"))
    cut = integer(F.length("genome") + 1, *key, "cut", seed=seed)
    meets = (F.col("_pair") < F.floor(F.col("_n") / 2)) & (uniform(*key, "cross", seed=seed) < pc)
    child = F.when(meets, genes.crossover(F.col("genome"), F.col("_partner"), F.col("_cut")))
    return (
        data.withColumns({"_partner": partner, "_cut": cut})
        .withColumn(out, F.coalesce(child, F.col("genome")))
        .drop("_n", "_pair", "_partner", "_cut")
    )


def mutated(
    population: DataFrame,
    generation,
    pm: Column | float,
    seed: int = SEED,
    genome: str = "genome",
) -> DataFrame:
    """With probability ``pm`` one gene, drawn evenly, flips."""
    key = (F.col("run_id"), F.lit(generation), F.col("idx"))
    gene = integer(F.length(genome), *key, "gene", seed=seed)
    hit = uniform(*key, "mutate", seed=seed) < pm
    return population.withColumn(
        genome, F.when(hit, genes.flip(F.col(genome), gene)).otherwise(F.col(genome))
    )


def keep_best(pool: DataFrame, n: Column | int) -> DataFrame:
    """The ``n`` best of each run; on equal scores children (source 0) before parents (1)."""
    order = per_run().orderBy(F.col("score").desc_nulls_last(), "source", "idx")
    place = F.row_number().over(order) - 1
    return (
        pool.withColumn("_place", place)
        .filter(F.col("_place") < n)
        .withColumn("idx", F.col("_place"))
        .drop("_place", "source")
    )


def select_best(parents: DataFrame, children: DataFrame, n: Column | int) -> DataFrame:
    """Elitist choice among two populations."""
    pool = children.withColumn("source", F.lit(0)).unionByName(parents.withColumn("source", F.lit(1)))
    return keep_best(pool, n)


def summary(population: DataFrame) -> DataFrame:
    """Per run: total, mean, best and worst score, best genome and repeated individuals."""
    return population.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("score").alias("total"),
        F.avg("score").alias("mean"),
        F.max("score").alias("max_score"),
        F.min("score").alias("min_score"),
        F.max_by("genome", F.struct(F.col("score"), -F.col("idx"))).alias("best_genome"),
        (F.count(F.lit(1)) - F.count_distinct("genome")).alias("equal_individuals"),
    )


def shares(population: DataFrame) -> DataFrame:
    """Score divided by population size."""
    return population.withColumn("prob", F.col("score") / F.count(F.lit(1)).over(per_run()))


def unscored(population: DataFrame, solutions: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct genomes the memo does not hold."""
    return population.select(*keys).distinct().join(solutions.select(*keys), keys, "left_anti")


def remember(solutions: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """Memo with the new scores; of several scores of one genome the newest version stays."""
    return (
        solutions.unionByName(scored)
        .groupBy(*keys)
        .agg(F.max_by("score", "version").alias("score"), F.max("version").alias("version"))
    )


def score_once(
    population: DataFrame,
    solutions: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    keys: list[str],
    version: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Score each unseen genome once and join all scores back: (population, new memo).

    New scores are written before the population and the memo are joined with them."""
    fresh = materialize(score(unscored(population, solutions, keys)).withColumn("version", F.lit(version)), "fresh")
    memo = remember(solutions, fresh.select(*keys, "score", "version"), keys)
    return population.drop("score").join(memo.select(*keys, "score"), keys), memo


def equal_scores(solutions: DataFrame, run: str = "run_id") -> DataFrame:
    """Genomes whose score other genomes of the run share, and how many others.

    The genomes of one (run, score) are each other's equals; they are counted, not paired.
    """
    same = solutions.groupBy(run, "score").agg((F.count(F.lit(1)) - 1).alias("equal_scores"))
    return solutions.join(same.filter(F.col("equal_scores") > 0), [run, "score"])


def _genes(genomes: pa.Array, length: int) -> np.ndarray:
    """Which genes are 1, genome by gene; a missing gene is none."""
    signs = "".join((g or "")[:length].ljust(length, "0") for g in genomes.to_pylist()).encode("ascii", "replace")
    return np.frombuffer(signs, dtype=np.uint8).reshape(len(genomes), length) == ord("1")


def likeness(
    solutions: DataFrame, length: int, run: str = "run_id", warn_below: float = 0.95, block: int = LIKENESS_BLOCK
) -> DataFrame:
    """Mean share of equal genes between a genome and all others with its score.

    Counting the ones of each gene per (run, score) gives the exact mean over all pairs
    of a genome without forming a pair. Groups of more than ``block`` genomes are counted in parts by a hash of
    the genome. The warning is on that mean, which can hide a single unlike pair.
    """
    keys = [run, "score"]
    sizes = solutions.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("equal_scores")).filter(F.col("equal_scores") > 0)
    members = solutions.join(sizes, keys)
    small, large = members.filter(F.col("equal_scores") < block), members.filter(F.col("equal_scores") >= block)

    def agreeing(rows: pa.Table) -> pa.Table:
        genomes = rows.column("genome").combine_chunks()
        genes = _genes(genomes, length)
        ones = genes.sum(axis=0)
        # A genome agrees with itself on every gene: take it out of the count.
        same = genes @ ones + ~genes @ (len(genes) - ones) - length
        return rows.append_column("_same", pa.array(same, pa.int64(), mask=~genomes.is_valid().to_numpy(zero_copy_only=False)))

    def counted(rows: pa.Table) -> pa.Table:
        ones = _genes(rows.column("genome").combine_chunks(), length).sum(axis=0)
        return rows.slice(0, 1).drop_columns(["_part", "genome"]).append_column("_ones", pa.array([ones.tolist()], pa.list_(pa.int64())))

    def added(rows: pa.Table) -> pa.Table:
        ones = rows.column("_ones").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, length).sum(axis=0)
        return rows.slice(0, 1).drop_columns(["_ones"]).append_column("_ones", pa.array([ones.tolist()], pa.list_(pa.int64())))

    told = StructType([*members.schema.fields, StructField("_same", LongType())])
    of_group = StructType([*members.select(*keys).schema.fields, StructField("_ones", ArrayType(LongType()))])
    part = F.pmod(F.xxhash64("genome"), F.ceil((F.col("equal_scores") + 1) / block)).alias("_part")
    ones = large.select(*keys, part, "genome").groupBy(*keys, "_part").applyInArrow(counted, of_group)
    ones = ones.groupBy(*keys).applyInArrow(added, of_group)
    n = F.col("equal_scores") + 1
    agreement = F.zip_with(F.split("genome", ""), F.col("_ones"), lambda gene, ones: F.when(gene == "1", ones).otherwise(n - ones))
    same = F.aggregate(F.slice(agreement, 1, length), F.lit(0).cast("bigint"), lambda a, x: a + x) - length
    # A list of counts may unfold to many times its written size: never to be broadcast on a guess.
    in_parts = large.join(ones.hint("merge"), keys).withColumn("_same", same).drop("_ones")
    whole = small.groupBy(*keys).applyInArrow(agreeing, told)
    return (
        whole.unionByName(in_parts)
        .withColumn("likeness", F.col("_same") / (F.col("equal_scores") * length))
        .withColumn("unlike", (F.col("likeness") < warn_below).cast("bigint"))
        .drop("_same")
    )


def overlap(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Per run: rows at the same idx with equal values, and whether all of them are."""
    here = left.select("run_id", "idx", *[F.col(c).alias(f"_l_{c}") for c in columns])
    pairs = here.join(right.select("run_id", "idx", *columns), ["run_id", "idx"])
    equal = {c: F.count_if(F.col(f"_l_{c}").eqNullSafe(F.col(c))) for c in columns}
    return pairs.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("compared"),
        *[v.alias(f"equal_{c}") for c, v in equal.items()],
        *[(v == F.count(F.lit(1))).cast("bigint").alias(f"all_equal_{c}") for c, v in equal.items()],
    )


def generation(
    population: DataFrame,
    number: int,
    score: Callable[[DataFrame], DataFrame],
    still_limit: int,
    seed: int = SEED,
) -> DataFrame:
    """Cross, mutate, score, keep the best; runs that stand still pass unchanged.

    ``population`` has run_id, n, pc, pm, idx, genome, score, ``still``, the number of
    generations so far in which at least 80 % of the run were repeats (never reset), and
    ``age``, the generations lived before standing still for good.
    """
    bred = crossed(population, number, F.col("pc"), seed, out="_child")
    bred = mutated(bred, number, F.col("pm"), seed, genome="_child")
    parents = {"genome": "_parent", "score": "_parent_score"}
    scored = score(bred.withColumnsRenamed({**parents, "_child": "genome"}))
    parent = F.struct(F.lit(1).alias("source"), F.col("_parent").alias("genome"), F.col("_parent_score").alias("score"))
    child = F.struct(F.lit(0).alias("source"), F.col("genome"), F.col("score"))
    moving = F.col("still") < still_limit
    both = F.when(moving, F.array(parent, child)).otherwise(F.array(parent))
    pool = (
        scored.withColumn("age", F.col("age") + moving.cast("int"))
        .withColumn("_one", F.explode(both))
        .drop("genome", "score", *parents.values())
        .select("*", "_one.*")
        .drop("_one")
    )
    kept = keep_best(pool, F.col("n"))
    repeats = F.col("n") - F.size(F.collect_set("genome").over(per_run()))
    stands = (repeats >= F.col("n") * F.lit(STILL_SHARE)) & moving
    return kept.withColumn("still", F.col("still") + stands.cast("int"))


def evolve(
    population: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    max_iterations: int,
    still_limit: int = STILL_LIMIT,
    seed: int = SEED,
    cut_every: int = 4,
) -> DataFrame:
    """Run all searches of ``population`` (run_id, n, pc, pm, idx, genome) side by side.

    ``max_iterations + 1`` generations, fewer if every run stands still. ``score`` adds a
    ``score`` column. Lineage is cut with a reliable checkpoint every few generations; a
    score that runs jobs of its own wants ``cut_every=1``.
    """
    # Few rows per run: many runs share a partition, and the hash spreads them evenly.
    placed = population.repartition("run_id")
    current = ranked(score(placed)).withColumns({"still": F.lit(0), "age": F.lit(0)})
    for number in range(max_iterations + 1):
        current = generation(current, number, score, still_limit, seed)
        if number % cut_every == cut_every - 1:
            current = cut_lineage(current)
            if current.filter(F.col("still") < still_limit).isEmpty():
                break
    return current


def ones_score(population: DataFrame) -> DataFrame:
    """OneMax, the test problem with a known best genome."""
    return population.withColumn("score", genes.ones(F.col("genome")).cast("double"))


def with_settings(
    solutions: DataFrame, population_bits: int = 5, pc_bits: int = 5, pm_bits: int = 5, eps: float = 1e-4
) -> DataFrame:
    n, pc, pm = genes.settings(F.col("genome"), population_bits, pc_bits, pm_bits, eps)
    return solutions.withColumns({"n": n, "pc": pc, "pm": pm})


def sweep_settings(
    settings: DataFrame,
    length: int,
    max_iterations: int,
    score: Callable[[DataFrame], DataFrame] = ones_score,
    best_possible: float | None = None,
    cost: float = 0.1,
    seed: int = SEED,
    cut_every: int = 4,
) -> DataFrame:
    """Score settings genomes by the search they describe; one run per distinct genome.

    score = -(best possible - best found) - cost * generations lived. All runs
    advance in the same jobs, and the cost counts generations instead of seconds so that
    a result can be repeated.
    """
    distinct = with_settings(settings.select("genome").distinct())
    runs = distinct.withColumnRenamed("genome", "run_id")
    start = random_population(runs, length, seed)
    final = evolve(start, score, max_iterations, seed=seed, cut_every=cut_every)
    best = F.lit(float(length) if best_possible is None else best_possible)
    return final.groupBy(F.col("run_id").alias("genome")).agg(
        F.max("n").alias("n"),
        F.max("pc").alias("pc"),
        F.max("pm").alias("pm"),
        F.max("score").alias("best_found"),
        (-(best - F.max("score")) - cost * F.max("age")).alias("score"),
    )


def search_settings(
    runs: DataFrame,
    length: int,
    inner_iterations: int,
    outer_iterations: int,
    score: Callable[[DataFrame], DataFrame] = ones_score,
    genome_length: int = 15,
    seed: int = SEED,
) -> DataFrame:
    """Genetic search over settings genomes: the outer population's score is a sweep.

    Every settings genome is swept once; later generations look it up.
    """
    population = random_population(runs, genome_length, seed)
    memo: list[DataFrame] = []

    def sweep(frame: DataFrame) -> DataFrame:
        fresh = frame.select("genome").distinct()
        for known in memo:
            fresh = fresh.join(known, "genome", "left_anti")
        found = cut_lineage(
            sweep_settings(fresh, length, inner_iterations, score, seed=seed).select("genome", "score")
        )
        memo.append(found)
        table = memo[0]
        for known in memo[1:]:
            table = table.unionByName(known)
        return frame.join(table, "genome")

    return evolve(population, sweep, outer_iterations, seed=seed, cut_every=1)


def good_settings(solutions: DataFrame, better_than: float = -200.0) -> DataFrame:
    """Averages over the settings that scored well, probabilities counted as at most 1."""
    return (
        with_settings(solutions.filter(F.col("score") > better_than))
        .agg(
            F.count(F.lit(1)).alias("settings"),
            F.avg("n").alias("avg_n"),
            F.avg(F.least("pc", F.lit(1.0))).alias("avg_pc"),
            F.avg(F.least("pm", F.lit(1.0))).alias("avg_pm"),
        )
    )
