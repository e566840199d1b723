import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from featurelab.functions import genes
from featurelab.operators import population as pop

FEATURES = [f"f{i}" for i in range(6)]


def runs(spark, n=12, count=3, pc=0.5, pm=0.3):
    return spark.range(count).select(
        F.col("id").alias("run_id"), F.lit(n).alias("n"), F.lit(pc).alias("pc"), F.lit(pm).alias("pm")
    )


def ring(best, worst, cut):
    """Child of ``best``: a ring segment of round(G/2) genes from the cut on comes from ``worst``."""
    size = len(best)
    swapped = {(cut + i) % size for i in range(round(size / 2))}
    return "".join(worst[i] if i in swapped else best[i] for i in range(size))


@pytest.mark.parametrize("size", [1, 2, 5, 8, 15])
def test_crossover_swaps_a_ring_segment(spark, size):
    best, worst = "1" * size, "0" * size
    cuts = spark.range(size + 1).select(
        "id",
        genes.crossover(F.lit(best), F.lit(worst), F.col("id")).alias("a"),
        genes.crossover(F.lit(worst), F.lit(best), F.col("id")).alias("b"),
    )
    for r in cuts.collect():
        assert r["a"] == ring(best, worst, r["id"])
        assert all(x != y for x, y in zip(r["a"], r["b"]))  # every gene survives once


def test_flip_every_position(spark):
    rows = spark.range(5).select("id", genes.flip(F.lit("01101"), F.col("id")).alias("g")).collect()
    for r in rows:
        assert sum(a != b for a, b in zip(r["g"], "01101")) == 1 and r["g"][r["id"]] != "01101"[r["id"]]


@given(st.lists(st.text("01", min_size=6, max_size=6), min_size=1, max_size=8))
@settings(max_examples=5, deadline=None)
def test_features_follow_bits(spark, bits):
    df = spark.createDataFrame([(0, i, b) for i, b in enumerate(bits)], "run_id int, idx int, genome string")
    for r in pop.with_features(df, FEATURES[:4], FEATURES[4:]).collect():
        named = r["baseline_features"] + r["exmodel_features"]
        assert named == [f for f, gene in zip(FEATURES, r["genome"]) if gene == "1"]


def test_population_of_one(spark):
    start = pop.random_population(runs(spark, n=1, pc=1.0, pm=1.0), 5)
    final = pop.evolve(start, pop.ones_score, 3)
    assert final.groupBy("run_id").count().filter("count <> 1").isEmpty()


def test_best_score_never_falls_and_onemax_is_solved(spark):
    start = pop.random_population(runs(spark, n=20, pc=0.9, pm=0.9), 8)
    first = pop.ranked(pop.ones_score(start))
    now = first.withColumns({"still": F.lit(0), "age": F.lit(0)}).repartition("run_id")
    best = {r["run_id"]: r["m"] for r in now.groupBy("run_id").agg(F.max("score").alias("m")).collect()}
    for g in range(4):
        now = pop.generation(now, g, pop.ones_score, 50)
        after = {r["run_id"]: r["m"] for r in now.groupBy("run_id").agg(F.max("score").alias("m")).collect()}
        assert all(after[k] >= best[k] for k in best)
        best = after
    solved = pop.summary(pop.evolve(start, pop.ones_score, 40)).collect()
    assert all(r["max_score"] == 8 and r["n"] == 20 for r in solved)


def test_standing_still_ends_a_run(spark):
    same = runs(spark, n=5, count=1, pc=0.0, pm=0.0).withColumn(
        "idx", F.explode(F.sequence(F.lit(0), F.lit(4)))
    ).withColumn("genome", F.lit("111"))
    final = pop.evolve(same, pop.ones_score, 30, still_limit=3, cut_every=2)
    assert {(r["still"], r["age"]) for r in final.collect()} == {(3, 3)}


def test_summary_ties_take_the_first(spark):
    df = spark.createDataFrame([(0, 0, "01", 1.0), (0, 1, "10", 1.0), (0, 2, "00", 0.0), (0, 3, "00", 0.0)], "run_id int, idx int, genome string, score double")
    row = pop.summary(df).first()
    assert (row["best_genome"], row["equal_individuals"], row["total"], row["mean"]) == ("01", 1, 2.0, 0.5)


def test_select_best_prefers_children(spark):
    schema = "run_id int, idx int, genome string, score double"
    parents = spark.createDataFrame([(0, 0, "p0", 3.0), (0, 1, "p1", 1.0)], schema)
    children = spark.createDataFrame([(0, 0, "c0", 1.0), (0, 1, "c1", 3.0)], schema)
    best = pop.select_best(parents, children, 2).orderBy("idx").collect()
    assert [r["genome"] for r in best] == ["c1", "p0"]


def test_memo_scores_each_genome_once(spark):
    people = spark.createDataFrame([(0, 0, "11"), (0, 1, "11"), (0, 2, "01"), (1, 0, "10")], "run_id int, idx int, genome string")
    memo = spark.createDataFrame([("01", 99.0, 0)], "genome string, score double, version int")
    scored, after = pop.score_once(people, memo, pop.ones_score, ["genome"], version=1)
    assert {r["genome"]: r["score"] for r in scored.collect()} == {"11": 2.0, "01": 99.0, "10": 1.0}
    assert scored.count() == 4 and after.count() == 3


def test_likeness_by_brute_force(spark):
    genomes = ["110100", "101100", "111000", "000111", "100000", "000001"]
    rows = [(0, g, float(g.count("1"))) for g in genomes]
    got = {r["genome"]: r for r in pop.likeness(spark.createDataFrame(rows, "run_id int, genome string, score double"), 6).collect()}
    for _, g, s in rows:
        peers = [h for h in genomes if h != g and h.count("1") == s]
        alike = [sum(a == b for a, b in zip(g, h)) / 6 for h in peers]
        assert got[g]["likeness"] == pytest.approx(sum(alike) / len(alike))
        assert got[g]["equal_scores"] == len(peers)


def test_random_masks_respect_the_limits(spark):
    masks = pop.random_masks(runs(spark, n=60), FEATURES, ["m0", "m1"], 4).collect()
    assert {len(r["genome"]) for r in masks} == {8}
    assert max(r["genome"].count("1") for r in masks) <= 4
    assert len({r["genome"] for r in masks}) > 30
    assert any("1" in r["exmodel_genes"] for r in masks)


def test_inconsistent_finds_a_changed_genome(spark):
    named = pop.with_features(pop.random_population(runs(spark, n=5, count=1), 6), FEATURES[:4], FEATURES[4:])
    assert pop.inconsistent(named, FEATURES[:4], FEATURES[4:]).isEmpty()
    broken = named.withColumn("genome", F.when(F.col("idx") == 2, genes.flip(F.col("genome"), F.lit(0))).otherwise(F.col("genome")))
    assert [r["idx"] for r in pop.inconsistent(broken, FEATURES[:4], FEATURES[4:]).collect()] == [2]


def test_settings_decode(spark):
    df = spark.createDataFrame([("00011" + "00010" + "00000",)], "genome string")
    row = pop.with_settings(df).first()
    assert row["n"] == 4 and row["pc"] == pytest.approx(1 / 2.0001) and row["pm"] == pytest.approx(1e4)


def test_sweep_scores_every_setting(spark):
    codes = ["".join(p) for p in itertools.product(["00000", "01000"], ["00001", "00100"], ["00001"])]
    swept = pop.sweep_settings(spark.createDataFrame([(c,) for c in codes], "genome string"), 10, 4)
    rows = {r["genome"]: r for r in swept.collect()}
    assert set(rows) == set(codes)
    for r in rows.values():
        assert r["score"] <= 0 and r["best_found"] <= 10


def test_evolution_does_not_depend_on_partitions(spark):
    found = []
    for parts in [1, 5]:
        start = pop.random_population(runs(spark).repartition(parts), 12)
        final = pop.evolve(start, pop.ones_score, 3)
        found.append(sorted((r["run_id"], r["idx"], r["genome"]) for r in final.collect()))
    assert found[0] == found[1]


def test_likeness_of_long_genomes(spark):
    genomes = ["1" * 784, "1" * 392 + "0" * 392, "0" * 784]
    table = spark.createDataFrame([(0, g, 1.0) for g in genomes], "run_id int, genome string, score double")
    got = {r["genome"]: r["likeness"] for r in pop.likeness(table, 784).collect()}
    assert got == {genomes[0]: 0.25, genomes[1]: 0.5, genomes[2]: 0.25}


def test_likeness_in_parts_without_a_column_per_gene(spark):
    """Groups counted in parts give the same rows, and the plan does not grow with the genes."""
    rows = [(k % 2, f"{(k * 2654435761) % 4096:012b}", float(k % 3), k) for k in range(60)] + [(0, None, 1.0, 60), (0, "11", 1.0, 61), (None, "11", 1.0, 62)]
    table = spark.createDataFrame(rows, "run_id int, genome string, score double, more int")
    whole, parts = (pop.likeness(table, 12, block=block) for block in (2048, 4))
    assert whole.columns == parts.columns == ["run_id", "score", "genome", "more", "equal_scores", "likeness", "unlike"]
    found = [sorted((r["more"], r["equal_scores"], r["likeness"], r["unlike"]) for r in x.collect() if r["genome"]) for x in (whole, parts)]
    assert found[0] == found[1] and len(found[0]) == 61
    some = dict((r[3], r) for r in rows if r[1] and r[0] is not None)
    for more, equals, like, _ in found[0]:
        own = some[more]
        peers = [r for r in rows if r[0] == own[0] and r[2] == own[2] and r[3] != more]
        assert equals == len(peers)
        if None not in [r[1] for r in peers]:
            alike = [sum(a == b for a, b in zip(own[1].ljust(12, "0"), r[1].ljust(12, "0"))) / 12 for r in peers]
            assert like == pytest.approx(sum(alike) / len(alike))
    long, short = (len(pop.likeness(table, n)._jdf.queryExecution().analyzed().toString()) for n in (784, 12))
    assert long < 2 * short


def test_new_genomes_are_scored_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def score(df):
        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return df.mapInArrow(count, df.schema).withColumn("score", F.lit(1.0))

    people = spark.createDataFrame([("01",), ("01",), ("10",)], "genome string").withColumn("score", F.lit(None).cast("double"))
    memo = spark.createDataFrame([], "genome string, score double, version int")
    scored, after = pop.score_once(people, memo, score, ["genome"])
    assert scored.count() == 3 and after.count() == 2 and seen.value == 2
