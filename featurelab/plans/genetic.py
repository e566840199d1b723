"""Genomes, populations and the generic genetic search."""

from __future__ import annotations

from pyspark.sql import functions as F

from featurelab.functions import genes
from featurelab.operators import large_runs
from featurelab.operators import population as pop
from featurelab.operators.peers import unlike_peers
from featurelab.plans import generation_sql as sql
from featurelab.plans.fixtures import (
    GENES, GENOMES, ORDER_FEATURES, RUN_SIZE, genomes, rounded, sql_bits, sql_digest, sql_int,
)
from featurelab.sources.tables import read_table

QUERIES, ORACLE = {}, {}

_PC, _PM = 0.6, 0.4  # high enough that every branch is taken
_EXMODEL = ["m0", "m1", "m2", "m3"]
_MAX_FEATURES = 8


def _scored(spark, sf):
    return pop.ones_score(genomes(spark, sf))


def random_genomes(spark, sf):
    orders = read_table(spark, sf, "orders")
    return orders.select("o_orderkey", genes.random_genome(70, F.col("o_orderkey"), "g").alias("genome"))


def _runs(spark, sf, n=20):
    return read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("run_id"), F.lit(n).alias("n"))


def random_populations(spark, sf):
    people = pop.random_population(_runs(spark, sf), GENES)
    return people.select("run_id", F.col("idx").cast("bigint"), "genome")


def mask_populations(spark, sf):
    masks = pop.random_masks(_runs(spark, sf), ORDER_FEATURES, _EXMODEL, _MAX_FEATURES)
    named = pop.with_features(masks, ORDER_FEATURES, _EXMODEL)
    return named.select(
        "run_id", F.col("idx").cast("bigint"), "genome",
        F.array_join("baseline_features", ",").alias("baseline"),
        F.array_join("exmodel_features", ",").alias("exmodel"),
    )


def onemax(spark, sf):
    orders = read_table(spark, sf, "orders")
    return genomes(spark, sf).select("run_id", "idx", genes.ones(F.col("genome")).alias("score")).unionByName(
        orders.select(
            F.lit(-1).cast("bigint").alias("run_id"), F.col("o_orderkey").alias("idx"),
            genes.digit_sum((F.col("o_orderkey") * 100).cast("string")).alias("score"),
        )
    )


def rank_population(spark, sf):
    ranked = pop.ranked(_scored(spark, sf))
    return ranked.select("run_id", F.col("idx").cast("bigint"), "genome", "score")


def crossover(spark, sf):
    crossed = pop.crossed(pop.ranked(_scored(spark, sf)), 0, _PC)
    return crossed.select("run_id", F.col("idx").cast("bigint"), "genome")


def mutation(spark, sf):
    return pop.mutated(genomes(spark, sf), 0, _PM)


def _children(spark, sf):
    parents = pop.ranked(_scored(spark, sf))
    children = pop.mutated(pop.crossed(parents, 0, _PC), 0, _PM)
    return parents, pop.ones_score(children)


def select_best(spark, sf):
    parents, children = _children(spark, sf)
    best = pop.select_best(parents, children, RUN_SIZE)
    return best.select("run_id", F.col("idx").cast("bigint"), "genome", "score")


def population_summary(spark, sf):
    report = pop.summary(_scored(spark, sf))
    return report.withColumn("mean", rounded("mean"))


def selection_share(spark, sf):
    return pop.shares(_scored(spark, sf)).select("run_id", "idx", rounded("prob", 6).alias("prob"))


def unscored_genomes(spark, sf):
    people = genomes(spark, sf)
    known = people.filter(F.col("genome").startswith("1")).select("genome").distinct()
    return pop.unscored(people, known, ["genome"])


def memo_update(spark, sf):
    solutions = _scored(spark, sf).select("genome", "score").distinct().withColumn("version", F.lit(0))
    again = solutions.filter(F.col("genome").endswith("1"))
    newer = again.select("genome", (F.col("score") + 100).alias("score"), F.lit(1).alias("version"))
    memo = pop.remember(solutions, newer, ["genome"])
    return memo.select("genome", "score", F.col("version").cast("bigint"))


def batch_scores(spark, sf):
    people = genomes(spark, sf)
    memo = pop.ones_score(people.filter(F.col("genome").startswith("1")).select("genome").distinct())
    scored, _ = pop.score_once(
        people, memo.withColumn("version", F.lit(0)), pop.ones_score, ["genome"], version=1
    )
    return scored.select("run_id", "idx", "genome", "score")


def equal_scores(spark, sf):
    solutions = _scored(spark, sf).select("run_id", "genome", "score").distinct()
    return pop.equal_scores(solutions)


def genome_likeness(spark, sf):
    solutions = _scored(spark, sf).select("run_id", "genome", "score").distinct()
    alike = pop.likeness(solutions, GENES)
    return alike.withColumn("likeness", rounded("likeness", 6))


# Fixed value: genes of the longest genomes that the generic search is run with.
_LONG = 784


def long_genome_likeness(spark, sf):
    """Likeness of long genomes with equally many ones, drawn for every customer."""
    key = F.col("c_custkey")
    people = read_table(spark, sf, "customer").select(
        F.floor(key / RUN_SIZE).cast("bigint").alias("run_id"), genes.random_genome(_LONG, key, "long").alias("genome")
    )
    solutions = pop.ones_score(people).select("run_id", "genome", "score").distinct()
    alike = pop.likeness(solutions, _LONG)
    return alike.withColumn("likeness", rounded("likeness", 6))


_ALIKE = 0.7


def unlike_genomes(spark, sf):
    """Peers that share less than 70 % of a genome's genes, among all customers of a nation with as many ones."""
    people = read_table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("bigint").alias("run_id"), genes.random_genome(GENES, F.col("c_custkey")).alias("genome")
    )
    return unlike_peers(pop.ones_score(people), GENES, warn_below=_ALIKE)


def population_overlap(spark, sf):
    before = pop.ranked(_scored(spark, sf))
    after = pop.mutated(before, 0, _PM)
    return pop.overlap(before, after, ["genome", "score"])


def genome_features(spark, sf):
    named = pop.with_features(genomes(spark, sf), ORDER_FEATURES, _EXMODEL + ["m4", "m5"])
    return named.select(
        "run_id", "idx",
        F.array_join("baseline_features", ",").alias("baseline"),
        F.array_join("exmodel_features", ",").alias("exmodel"),
    )


def inconsistent_individuals(spark, sf):
    """Every seventh customer's genome is changed after its features were named."""
    exmodel = _EXMODEL + ["m4", "m5"]
    named = pop.with_features(genomes(spark, sf), ORDER_FEATURES, exmodel)
    broken = pop.mutated(named, 0, 1 / 7)
    return pop.inconsistent(broken, ORDER_FEATURES, exmodel).select("run_id", "idx", "genome")


def decoded_settings(spark, sf):
    decoded = pop.with_settings(genomes(spark, sf))
    return decoded.select("run_id", "idx", "n", rounded("pc", 6).alias("pc"), rounded("pm", 6).alias("pm"))


def good_settings(spark, sf):
    scored = pop.ones_score(genomes(spark, sf)).withColumn("score", F.col("score") * -30)
    report = pop.good_settings(scored, -200.0)
    return report.select("settings", *[rounded(c, 6).alias(c) for c in ["avg_n", "avg_pc", "avg_pm"]])


def one_generation(spark, sf):
    """Rank, cross, mutate, score and keep the best of every population once."""
    people = genomes(spark, sf).withColumns(
        {"n": F.count(F.lit(1)).over(pop.per_run()), "pc": F.lit(_PC), "pm": F.lit(_PM)}
    )
    final = pop.evolve(people, pop.ones_score, max_iterations=0)
    return final.select("run_id", F.col("idx").cast("bigint"), "genome", "score")


def large_run(spark, sf):
    """One generation of a single run that holds all customers, in parts of at most 500 or so."""
    people = read_table(spark, sf, "customer").select(
        F.lit(0).cast("bigint").alias("run_id"), F.col("c_custkey").cast("bigint").alias("idx"),
        genes.random_genome(GENES, F.col("c_custkey")).alias("genome"), F.lit(_PC).alias("pc"), F.lit(_PM).alias("pm"),
    )
    people = people.join(F.broadcast(people.agg(F.count(F.lit(1)).alias("n"), F.max("run_id").alias("run_id"))), "run_id")
    after = large_runs.generation(pop.ones_score(people), 0, pop.ones_score, part_rows=500)
    return after.select("run_id", F.col("idx").cast("bigint"), "genome", "score")


_GENERATIONS = 3
_SEARCH_GENES = 30


def three_generations(spark, sf):
    """Three whole generations of every population."""
    people = genomes(spark, sf).withColumns(
        {"n": F.count(F.lit(1)).over(pop.per_run()), "pc": F.lit(_PC), "pm": F.lit(_PM)}
    )
    final = pop.evolve(people, pop.ones_score, max_iterations=_GENERATIONS - 1)
    return final.select("run_id", F.col("idx").cast("bigint"), "genome", "score")


def onemax_search(spark, sf):
    """One search per supplier: 20 individuals, up to 13 generations."""
    runs = _runs(spark, sf).withColumns({"pc": F.lit(0.25), "pm": F.lit(0.1)})
    start = pop.random_population(runs, _SEARCH_GENES)
    found = pop.summary(pop.evolve(start, pop.ones_score, max_iterations=12))
    return found.withColumn("mean", rounded("mean"))


def settings_sweep(spark, sf):
    """Each customer's genome read as search settings and scored by the search it describes."""
    settings = genomes(spark, sf).select("genome")
    swept = pop.sweep_settings(settings, length=_SEARCH_GENES, max_iterations=5)
    return swept.withColumns({c: rounded(c, 6) for c in ["pc", "pm", "score"]})


def settings_search(spark, sf):
    """Outer searches over settings, one per ten suppliers; all inner searches run at once."""
    group = F.floor(F.col("s_suppkey") / 10).cast("bigint")
    suppliers = read_table(spark, sf, "supplier").groupBy(group.alias("run_id"))
    runs = suppliers.agg(F.count(F.lit(1)).cast("int").alias("n")).withColumns(
        {"pc": F.lit(0.25), "pm": F.lit(0.1)}
    )
    best = pop.search_settings(runs, length=_SEARCH_GENES, inner_iterations=3, outer_iterations=1)
    return best.select("run_id", F.col("idx").cast("bigint"), "genome", "score")


QUERIES.update(
    random_genomes=random_genomes, random_populations=random_populations,
    mask_populations=mask_populations, onemax=onemax, rank_population=rank_population,
    crossover=crossover, mutation=mutation, select_best=select_best,
    population_summary=population_summary, selection_share=selection_share,
    unscored_genomes=unscored_genomes, memo_update=memo_update, batch_scores=batch_scores,
    equal_scores=equal_scores, genome_likeness=genome_likeness,
    long_genome_likeness=long_genome_likeness, unlike_genomes=unlike_genomes, population_overlap=population_overlap,
    genome_features=genome_features, inconsistent_individuals=inconsistent_individuals,
    decoded_settings=decoded_settings, good_settings=good_settings, one_generation=one_generation, large_run=large_run,
    three_generations=three_generations,
    onemax_search=onemax_search, settings_sweep=settings_sweep, settings_search=settings_search,
)

_ONES = "length(replace(genome, '0', ''))"
_SCORED = f"""{GENOMES},
scored AS (SELECT *, CAST({_ONES} AS DOUBLE) AS score FROM genomes)"""
_START = f"""{_SCORED},
start AS (SELECT run_id, idx, genome, count(*) OVER (PARTITION BY run_id) AS n, {_PC} AS pc, {_PM} AS pm FROM genomes)"""
_RANKED = f"{_START}, {sql.ranked('start')}"
_CROSSED = f"{_RANKED}, {sql.crossed('ranked', GENES)}"
_KEPT = f"{_CROSSED}, {sql.mutated('crossed_0', GENES)}, {sql.kept('ranked')}"
_PEOPLE = "SELECT run_id, idx, genome, score FROM {last}"


def sql_names(genome: str, names: list[str]) -> str:
    cells = ", ".join(
        f"CASE WHEN substr({genome}, {i + 1}, 1) = '1' THEN '{n}' END" for i, n in enumerate(names)
    )
    return f"concat_ws(',', {cells})"


_SAMPLE_BITS = f"""
draws AS (SELECT run_id, idx, part, i, hash32 / 4294967296.0 AS u FROM (
            SELECT run_id, idx, part, i, CAST('0x' || substr(md5(concat_ws('|', '42', run_id, idx, part, i)), 1, 8) AS BIGINT) AS hash32
            FROM people, (SELECT 'b' AS part, unnest(range(0, {len(ORDER_FEATURES)})) AS i
                          UNION ALL SELECT 'x', unnest(range(0, {len(_EXMODEL)}))) f)),
placed AS (SELECT *, row_number() OVER (PARTITION BY run_id, idx, part ORDER BY u, i) AS place FROM draws),
bits AS (SELECT run_id, idx, part,
                string_agg(CASE WHEN place <= CASE part WHEN 'b' THEN base ELSE extra END THEN '1' ELSE '0' END, '' ORDER BY i) AS genes
         FROM placed JOIN wanted USING (run_id, idx) GROUP BY ALL)"""

SETTINGS_SQL = """
  CAST('0b' || substr(genome, 1, 5) AS BIGINT) + 1 AS n,
  1.0::DOUBLE / (CAST('0b' || substr(genome, 6, 5) AS BIGINT) + 0.0001::DOUBLE) AS pc,
  1.0::DOUBLE / (CAST('0b' || substr(genome, 11, 5) AS BIGINT) + 0.0001::DOUBLE) AS pm"""

_MEMO = f"""{_SCORED}, memo AS (SELECT DISTINCT run_id, genome, score FROM scored)"""

ORACLE.update(
    random_genomes=f"""
SELECT o_orderkey, substr({" || ".join(sql_bits(sql_digest("o_orderkey", "'g'", str(b))) for b in range(3))}, 1, 70) AS genome
FROM orders""",
    random_populations=f"""
SELECT s_suppkey AS run_id, idx, substr({sql_bits(sql_digest("s_suppkey", "idx"))}, 1, {GENES}) AS genome
FROM supplier, range(0, 20) t(idx)""",
    mask_populations=f"""
WITH people AS (SELECT s_suppkey AS run_id, idx FROM supplier, range(0, 20) t(idx)),
totals AS (SELECT *, {sql_int(str(_MAX_FEATURES + 1), "run_id", "idx", "'total'")} AS total,
                  {sql_int(str(len(ORDER_FEATURES) + 1), "run_id", "idx", "'baseline'")} AS b FROM people),
wanted AS (SELECT run_id, idx, least(b, total) AS base, least(total - least(b, total), {len(_EXMODEL)}) AS extra FROM totals),
{_SAMPLE_BITS}
SELECT b.run_id, b.idx, b.genes || x.genes AS genome, {sql_names("b.genes", ORDER_FEATURES)} AS baseline,
       {sql_names("x.genes", _EXMODEL)} AS exmodel
FROM (SELECT * FROM bits WHERE part = 'b') b JOIN (SELECT * FROM bits WHERE part = 'x') x USING (run_id, idx)""",
    onemax=f"""
WITH {GENOMES}
SELECT run_id, idx, {_ONES} AS score FROM genomes
UNION ALL
SELECT -1, o_orderkey, list_sum(list_transform(string_split(CAST(o_orderkey * 100 AS VARCHAR), ''), lambda d: CAST(d AS BIGINT)))::BIGINT
FROM orders""",
    rank_population=f"WITH {_RANKED} SELECT run_id, idx, genome, score FROM ranked",
    crossover=f"WITH {_CROSSED} SELECT run_id, idx, genome FROM crossed_0",
    mutation=f"WITH {_START}, {sql.mutated('start', GENES)} SELECT run_id, idx, genome FROM mutated_0",
    select_best=f"WITH {_KEPT} SELECT run_id, idx, genome, score FROM kept_0",
    large_run=sql.generations(
        f"""
start AS (SELECT 0 AS run_id, c_custkey AS idx, substr({sql_bits(sql_digest("c_custkey"))}, 1, {GENES}) AS genome,
                 count(*) OVER () AS n, {_PC} AS pc, {_PM} AS pm FROM customer)""",
        "start", GENES, 1, _PEOPLE,
    ),
    one_generation=sql.generations(_START, "start", GENES, 1, _PEOPLE),
    three_generations=sql.generations(_START, "start", GENES, _GENERATIONS, _PEOPLE),
    onemax_search=sql.generations(
        f"""
start AS (SELECT s_suppkey AS run_id, idx, substr({sql_bits(sql_digest("s_suppkey", "idx"))}, 1, {_SEARCH_GENES}) AS genome,
                 20 AS n, 0.25 AS pc, 0.1 AS pm FROM supplier, range(0, 20) t(idx))""",
        "start", _SEARCH_GENES, 13,
        """
SELECT run_id, count(*) AS n, sum(score) AS total, round(avg(score), 4) AS mean, max(score) AS max_score, min(score) AS min_score,
       arg_max(genome, score * 1000 - idx) AS best_genome, count(*) - count(DISTINCT genome) AS equal_individuals
FROM {last} GROUP BY run_id""",
    ),
    settings_sweep=sql.generations(
        f"""{GENOMES},
settings AS (SELECT *, {SETTINGS_SQL} FROM (SELECT DISTINCT genome FROM genomes)),
start AS (SELECT genome AS run_id, idx, substr({sql_bits(sql_digest("genome", "idx"))}, 1, {_SEARCH_GENES}) AS genome, n, pc, pm
          FROM settings, range(0, 32) t(idx) WHERE idx < n)""",
        "start", _SEARCH_GENES, 6,
        f"""
SELECT run_id AS genome, max(n) AS n, round(max(pc), 6) AS pc, round(max(pm), 6) AS pm, max(score) AS best_found,
       round(-({_SEARCH_GENES} - max(score)) - 0.1 * 6, 6) AS score FROM {{last}} GROUP BY run_id""",
    ),
    settings_search=sql.settings_search(
        f"""
runs AS (SELECT s_suppkey // 10 AS run_id, count(*) AS n FROM supplier GROUP BY 1),
start AS (SELECT run_id, idx, substr({sql_bits(sql_digest("run_id", "idx"))}, 1, {GENES}) AS genome, n, 0.25 AS pc, 0.1 AS pm
          FROM runs, range(0, 10) t(idx) WHERE idx < n)""",
        "start", GENES, _SEARCH_GENES, 4, 2, SETTINGS_SQL,
        lambda run, idx: f"substr({sql_bits(sql_digest(run, idx))}, 1, {_SEARCH_GENES})",
    ),
    population_summary=f"""
WITH {_SCORED}
SELECT run_id, count(*) AS n, sum(score) AS total, round(avg(score), 4) AS mean, max(score) AS max_score,
       min(score) AS min_score, arg_max(genome, score * 1000 - idx) AS best_genome,
       count(*) - count(DISTINCT genome) AS equal_individuals
FROM scored GROUP BY run_id""",
    selection_share=f"""
WITH {_SCORED} SELECT run_id, idx, round(score / count(*) OVER (PARTITION BY run_id), 6) AS prob FROM scored""",
    unscored_genomes=f"""
WITH {GENOMES} SELECT DISTINCT genome FROM genomes WHERE genome NOT LIKE '1%'""",
    memo_update=f"""
WITH {_SCORED}
SELECT DISTINCT genome, CASE WHEN genome LIKE '%1' THEN score + 100 ELSE score END AS score,
       CAST(genome LIKE '%1' AS BIGINT) AS version FROM scored""",
    batch_scores=f"WITH {_SCORED} SELECT run_id, idx, genome, score FROM scored",
    equal_scores=f"""
WITH {_MEMO}
SELECT a.run_id, a.genome, a.score, count(*) AS equal_scores
FROM memo a JOIN memo b ON a.run_id = b.run_id AND a.score = b.score AND a.genome <> b.genome GROUP BY ALL""",
    genome_likeness=f"""
WITH {_MEMO}
SELECT a.run_id, a.genome, a.score, count(*) AS equal_scores,
       round(avg(({GENES} - hamming(a.genome, b.genome)) / {GENES}.0), 6) AS likeness,
       CAST(avg(({GENES} - hamming(a.genome, b.genome)) / {GENES}.0) < 0.95 AS BIGINT) AS unlike
FROM memo a JOIN memo b ON a.run_id = b.run_id AND a.score = b.score AND a.genome <> b.genome GROUP BY ALL""",
    long_genome_likeness=f"""
WITH memo AS (
  SELECT DISTINCT run_id, genome, CAST({_ONES} AS DOUBLE) AS score FROM (
    SELECT c_custkey // {RUN_SIZE} AS run_id,
           substr({" || ".join(sql_bits(sql_digest("c_custkey", "'long'", str(b))) for b in range(-(-_LONG // 32)))}, 1, {_LONG}) AS genome
    FROM customer))
SELECT a.run_id, a.genome, a.score, count(*) AS equal_scores,
       round(avg(({_LONG} - hamming(a.genome, b.genome)) / {_LONG}.0), 6) AS likeness,
       CAST(avg(({_LONG} - hamming(a.genome, b.genome)) / {_LONG}.0) < 0.95 AS BIGINT) AS unlike
FROM memo a JOIN memo b ON a.run_id = b.run_id AND a.score = b.score AND a.genome <> b.genome GROUP BY ALL""",
    unlike_genomes=f"""
WITH p AS (
  SELECT c_nationkey AS run_id, substr({sql_bits(sql_digest("c_custkey"))}, 1, {GENES}) AS genome FROM customer),
scored AS (SELECT run_id, genome, CAST({_ONES} AS DOUBLE) AS score, count(*) AS copies FROM p GROUP BY run_id, genome)
SELECT CAST(a.run_id AS BIGINT) AS run_id, a.genome, a.score, CAST(sum(b.copies) - 1 AS BIGINT) AS equal_scores,
       CAST(coalesce(sum(b.copies) FILTER (WHERE ({GENES} - hamming(a.genome, b.genome)) / {GENES}.0 < {_ALIKE}), 0) AS BIGINT) AS unlike_peers
FROM scored a JOIN scored b ON a.run_id = b.run_id AND a.score = b.score GROUP BY ALL HAVING sum(b.copies) > 1""",
    population_overlap=f"""
WITH {_RANKED}, {sql.mutated('ranked', GENES)}
SELECT run_id, count(*) AS compared,
       count(*) FILTER (WHERE a.genome = b.genome) AS equal_genome, count(*) FILTER (WHERE a.score = b.score) AS equal_score,
       CAST(count(*) FILTER (WHERE a.genome = b.genome) = count(*) AS BIGINT) AS all_equal_genome,
       CAST(count(*) FILTER (WHERE a.score = b.score) = count(*) AS BIGINT) AS all_equal_score
FROM ranked a JOIN mutated_0 b USING (run_id, idx) GROUP BY run_id""",
    genome_features=f"""
WITH {GENOMES}
SELECT run_id, idx, {sql_names("genome", ORDER_FEATURES)} AS baseline,
       {sql_names(f"substr(genome, {len(ORDER_FEATURES) + 1})", _EXMODEL + ["m4", "m5"])} AS exmodel FROM genomes""",
    inconsistent_individuals=f"""
WITH {_START}, {sql.mutated('start', GENES, pm=str(1 / 7))}
SELECT m.run_id, m.idx, m.genome FROM mutated_0 m JOIN genomes g USING (run_id, idx) WHERE m.genome <> g.genome""",
    decoded_settings=f"""
WITH {GENOMES}
SELECT run_id, idx, n, round(pc, 6) AS pc, round(pm, 6) AS pm FROM (SELECT *, {SETTINGS_SQL} FROM genomes)""",
    good_settings=f"""
WITH {_SCORED}
SELECT count(*) AS settings, round(avg(n), 6) AS avg_n, round(avg(least(pc, 1.0)), 6) AS avg_pc,
       round(avg(least(pm, 1.0)), 6) AS avg_pm
FROM (SELECT *, {SETTINGS_SQL} FROM scored WHERE score * -30 > -200)""",
)
