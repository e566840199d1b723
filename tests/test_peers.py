"""Unlike peers against a comparison of all pairs."""

import numpy as np
import pytest

from featurelab.operators.peers import unlike_peers

SCHEMA = "run_id int, genome string, score double"


def by_pairs(rows, length, below):
    found = {}
    for run, genome, score in {r for r in rows if None not in r}:
        peers = [g for r, g, s in rows if (r, s) == (run, score) and g is not None]
        peers.remove(genome)
        if peers:
            alike = [sum(a == b for a, b in zip(genome, g)) / length for g in peers]
            found[run, genome, score] = (len(peers), sum(x < below for x in alike))
    return found


def flipped(rng, genome, bits):
    genes = list(genome)
    for i in rng.choice(len(genes), bits, replace=False):
        genes[i] = "1" if genes[i] == "0" else "0"
    return "".join(genes)


@pytest.mark.parametrize("block,points", [(2048, 16), (7, 3), (40, 1)])
def test_equals_all_pairs(spark, block, points):
    rng = np.random.default_rng(11)
    seeds = ["".join(rng.choice(["0", "1"], 60)) for _ in range(4)]
    rows = [(int(rng.random() < 0.1), flipped(rng, seeds[rng.integers(4)], rng.integers(0, 6)), float(rng.random() < 0.2)) for _ in range(400)]
    rows += rows[:30] + [(5, seeds[0], 1.0), (6, seeds[1], 2.0), (6, seeds[1], 2.0)]  # repeated, alone, only its copy
    rows += [(None, seeds[0], 1.0), (0, None, 1.0), (0, seeds[0], None)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for below in [0.95, 0.9, 0.0, 1.01]:
        got = unlike_peers(table, 60, warn_below=below, vantage_points=points, block=block).collect()
        assert len(got) == len({(r["run_id"], r["genome"], r["score"]) for r in got})
        assert {(r["run_id"], r["genome"], r["score"]): (r["equal_scores"], r["unlike_peers"]) for r in got} == by_pairs(rows, 60, below)


def test_empty_table_and_wrong_length(spark):
    assert unlike_peers(spark.createDataFrame([], SCHEMA), 60).count() == 0
    with pytest.raises(Exception, match="needs 4 genes"):
        unlike_peers(spark.createDataFrame([(0, "101", 1.0), (0, "100", 1.0)], SCHEMA), 4).collect()
