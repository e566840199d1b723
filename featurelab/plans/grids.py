"""Grids of models in layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from featurelab.models import layers
from featurelab.models.learners import learner
from featurelab.plans.fixtures import (
    LAYERS, MODEL_NAMES, NEURONS, ORDER_FACTS, ORDER_FEATURES, folded, order_facts, rounded, sql_hash, sql_int,
    systems,
)
from featurelab.plans.profiling import sql_folds
from featurelab.sources.work import new_path

QUERIES, ORACLE = {}, {}

_WIDTH = 4  # bits for 12 models


def _grids(spark, sf):
    return layers.random_grids(systems(spark, sf), MODEL_NAMES, LAYERS, NEURONS)


def _neurons(spark, sf):
    return layers.random_neurons(_grids(spark, sf), ORDER_FEATURES, LAYERS, NEURONS)


def model_grids(spark, sf):
    return _grids(spark, sf).select("system_id", F.col("layer").cast("bigint"), F.col("neuron").cast("bigint"), "model")


def grid_chromosomes(spark, sf):
    return layers.grid_chromosomes(_grids(spark, sf), MODEL_NAMES)


def decoded_grids(spark, sf):
    """Half of every chromosome is replaced by ones, whose code names no model."""
    coded = layers.grid_chromosomes(_grids(spark, sf), MODEL_NAMES)
    size = LAYERS * NEURONS * _WIDTH // 2
    changed = coded.withColumn("chromosome", F.concat(F.substring("chromosome", 1, size), F.lit("1" * size)))
    cells = layers.decode_chromosomes(changed, MODEL_NAMES, LAYERS, NEURONS)
    return cells.select("system_id", F.col("layer").cast("bigint"), F.col("neuron").cast("bigint"), "model")


def neuron_masks(spark, sf):
    named = _neurons(spark, sf)
    return named.select(
        "system_id", "name", "baseline_genes", F.array_join("baseline_features", ",").alias("baseline"),
        F.array_join("layer_genes", "/").alias("layer_genes"), F.array_join("exmodel_features", ",").alias("exmodel"),
    )


def neuron_chromosomes(spark, sf):
    return _neurons(spark, sf).select("system_id", "name", "chromosome")


def lower_outputs(spark, sf):
    outputs = layers.outputs_below(_grids(spark, sf), 2)
    return outputs.select("system_id", F.array_join("outputs", ",").alias("outputs"))


def _predictions(facts):
    """Four simple neurons' outputs as long rows."""
    cells = [
        F.struct(F.lit(f"m{i}").alias("neuron"), (F.col("price") * w).alias("prediction"))
        for i, w in enumerate([0.9, 0.95, 1.0, 1.05])
    ]
    return facts.select("row_id", "fold", F.inline(F.array(*cells)))


def neuron_outputs(spark, sf):
    facts = folded(order_facts(spark, sf))
    wide = layers.output_table(_predictions(facts), ["m0", "m1", "m2", "m3"])
    return wide.select(
        "row_id", F.col("fold").cast("bigint"), *[rounded(c, 8).alias(c) for c in ["m0", "m1", "m2", "m3"]]
    )


def neuron_inputs(spark, sf):
    facts = folded(order_facts(spark, sf))
    outputs = layers.output_table(_predictions(facts), ["m0", "m1", "m2", "m3"])
    table = layers.neuron_inputs(facts, outputs, ["qty", "n"], ["m1", "m3"])
    return table.select(
        "row_id", F.col("fold").cast("bigint"), "qty", "n", *[rounded(c, 8).alias(c) for c in ["m1", "m3", "y"]]
    )


def stacked_layers(spark, sf):
    """Two layers; each column is one neuron's out-of-fold prediction."""
    facts = folded(order_facts(spark, sf))
    neurons = [
        layers.Neuron("linear_N_0_M_0", 0, learner("linear"), ["n", "qty"], []),
        layers.Neuron("bayesridge_N_0_M_1", 0, learner("bayesridge"), ["price"], []),
        layers.Neuron("gradientboosting_N_0_M_2", 0, learner("gradientboosting", trees=3), ["price", "disc"], []),
        layers.Neuron(
            "linear_N_1_M_0", 1, learner("linear"), ["disc"],
            ["linear_N_0_M_0", "bayesridge_N_0_M_1", "gradientboosting_N_0_M_2"],
        ),
    ]
    return layers.train_layers(facts, neurons, 3)


def stacked_baseline(spark, sf):
    """One layer of one single-feature neuron: its out-of-fold predictions have a closed form."""
    facts = folded(order_facts(spark, sf))
    neuron = layers.Neuron("linear_N_0_M_0", 0, learner("linear"), ["qty"], [])
    outputs = layers.train_layers(facts, [neuron], 3)
    return outputs.select("row_id", F.col("fold").cast("bigint"), rounded("linear_N_0_M_0", 6).alias("linear_N_0_M_0"))


def _linear_neurons():
    one = learner("linear")
    return [
        layers.Neuron("linear_N_0_M_0", 0, one, ["qty"], []),
        layers.Neuron("linear_N_0_M_1", 0, one, ["disc"], []),
        layers.Neuron("linear_N_1_M_0", 1, one, [], ["linear_N_0_M_0", "linear_N_0_M_1"]),
    ]


def stacked_linear(spark, sf):
    """Two neurons of one feature and a second layer on their outputs: solved in closed form."""
    neurons = _linear_neurons()
    outputs = layers.train_layers(folded(order_facts(spark, sf)), neurons, 3)
    return outputs.select("row_id", F.col("fold").cast("bigint"), *[rounded(n.name, 6).alias(n.name) for n in neurons])


def resumed_linear(spark, sf):
    """The same grid, stopped after its first layer and taken up again from the manifest."""
    neurons, facts, manifest = _linear_neurons(), folded(order_facts(spark, sf)), new_path(spark, "manifest")
    layers.train_layers(facts, neurons[:2], 3, manifest=manifest)
    outputs = layers.train_layers(facts, neurons, 3, manifest=manifest)
    return outputs.select("row_id", F.col("fold").cast("bigint"), *[rounded(n.name, 6).alias(n.name) for n in neurons])


QUERIES.update(
    model_grids=model_grids, grid_chromosomes=grid_chromosomes, decoded_grids=decoded_grids,
    neuron_masks=neuron_masks, neuron_chromosomes=neuron_chromosomes, lower_outputs=lower_outputs,
    neuron_outputs=neuron_outputs, neuron_inputs=neuron_inputs, stacked_layers=stacked_layers,
    stacked_baseline=stacked_baseline, stacked_linear=stacked_linear, resumed_linear=resumed_linear,
)

_NAMES = "[" + ", ".join(f"'{m}'" for m in MODEL_NAMES) + "]"
_GRID = f"""
cells AS (SELECT s_suppkey AS system_id, layer, neuron,
                 {sql_int(str(len(MODEL_NAMES)), "s_suppkey", "layer", "neuron")} AS code
          FROM supplier, range(0, {LAYERS}) a(layer), range(0, {NEURONS}) b(neuron)),
grid AS (SELECT system_id, layer, neuron, code, {_NAMES}[code + 1] AS model,
                {_NAMES}[code + 1] || '_N_' || layer || '_M_' || neuron AS name FROM cells)"""
_FEATURES = "[" + ", ".join(f"'{f}'" for f in ORDER_FEATURES) + "]"
_BASE_BIT = f"{sql_hash('system_id', 'layer', 'neuron', chr(39) + 'b' + chr(39), 'i')} % 2"
_LOWER_BIT = f"{sql_hash('g.system_id', 'g.layer', 'g.neuron', chr(39) + 'x' + chr(39), 'l.layer', 'l.neuron')} % 2"
_MASKS = f"""{_GRID},
base AS (SELECT system_id, name, string_agg(CAST(bit AS VARCHAR), '' ORDER BY i) AS baseline_genes,
                coalesce(string_agg({_FEATURES}[i + 1], ',' ORDER BY i) FILTER (WHERE bit = 1), '') AS baseline
         FROM (SELECT system_id, name, i, {_BASE_BIT} AS bit FROM grid, range(0, {len(ORDER_FEATURES)}) t(i)) GROUP BY ALL),
lower AS (SELECT g.system_id, g.name, l.layer AS lvl, l.neuron AS place, l.name AS output, {_LOWER_BIT} AS bit
          FROM grid g JOIN grid l ON g.system_id = l.system_id AND l.layer < g.layer),
per_layer AS (SELECT system_id, name, lvl, string_agg(CAST(bit AS VARCHAR), '' ORDER BY place) AS genes FROM lower GROUP BY ALL),
every AS (SELECT g.system_id, g.name, t.lvl, coalesce(p.genes, '') AS genes
          FROM grid g CROSS JOIN range(0, {LAYERS}) t(lvl) LEFT JOIN per_layer p
            ON p.system_id = g.system_id AND p.name = g.name AND p.lvl = t.lvl),
extra AS (SELECT system_id, name, string_agg(genes, '/' ORDER BY lvl) AS layer_genes, string_agg(genes, '' ORDER BY lvl) AS joined
          FROM every GROUP BY ALL),
chosen AS (SELECT system_id, name, string_agg(output, ',' ORDER BY lvl, place) AS exmodel FROM lower WHERE bit = 1 GROUP BY ALL)"""
_OUTPUTS = "price * 0.9 AS m0, price * 0.95 AS m1, price * 1.0 AS m2, price * 1.05 AS m3"

ORACLE.update(
    model_grids=f"WITH {_GRID} SELECT system_id, layer, neuron, model FROM grid",
    grid_chromosomes=f"""
WITH {_GRID}
SELECT system_id, string_agg(lpad(bin(code), {_WIDTH}, '0'), '' ORDER BY layer, neuron) AS chromosome FROM grid GROUP BY 1""",
    decoded_grids=f"""
WITH {_GRID} SELECT system_id, layer, neuron, CASE WHEN layer < {LAYERS // 2} THEN model END AS model FROM grid""",
    neuron_masks=f"""
WITH {_MASKS}
SELECT system_id, name, baseline_genes, baseline, layer_genes, coalesce(exmodel, '') AS exmodel
FROM base JOIN extra USING (system_id, name) LEFT JOIN chosen USING (system_id, name)""",
    neuron_chromosomes=f"""
WITH {_MASKS}
SELECT system_id, name, baseline_genes || joined AS chromosome FROM base JOIN extra USING (system_id, name)""",
    lower_outputs=f"""
WITH {_GRID}
SELECT system_id, string_agg(name, ',' ORDER BY layer, neuron) AS outputs FROM grid WHERE layer < 2 GROUP BY 1""",
    neuron_outputs=f"""
WITH {ORDER_FACTS}, b AS ({sql_folds("facts", "row_id", 3)}), o AS (SELECT row_id, fold, {_OUTPUTS} FROM b)
SELECT row_id, fold, {", ".join(f"round(m{i}, 8) AS m{i}" for i in range(4))} FROM o""",
    neuron_inputs=f"""
WITH {ORDER_FACTS}, b AS ({sql_folds("facts", "row_id", 3)}), o AS (SELECT row_id, fold, {_OUTPUTS} FROM b)
SELECT row_id, fold, qty, n, round(m1, 8) AS m1, round(m3, 8) AS m3, round(y, 8) AS y
FROM b JOIN o USING (row_id, fold)""",
    stacked_linear=f"""
WITH {ORDER_FACTS}, b AS ({sql_folds("facts", "row_id", 3)}),
f0 AS (SELECT k, regr_slope(y, qty) AS s, regr_intercept(y, qty) AS i, regr_slope(y, disc) AS t, regr_intercept(y, disc) AS j
       FROM b, range(0, 3) r(k) WHERE fold <> k GROUP BY k),
o AS (SELECT row_id, fold, y, i + s * qty AS p, j + t * disc AS q FROM b JOIN f0 ON fold = k),
m AS (SELECT k, var_pop(p) AS pp, var_pop(q) AS qq, covar_pop(p, q) AS pq, covar_pop(p, y) AS py, covar_pop(q, y) AS qy,
             avg(p) AS mp, avg(q) AS mq, avg(y) AS my FROM o, range(0, 3) r(k) WHERE fold <> k GROUP BY k),
f1 AS (SELECT *, (py * qq - qy * pq) / (pp * qq - pq * pq) AS wp, (qy * pp - py * pq) / (pp * qq - pq * pq) AS wq FROM m)
SELECT row_id, fold, round(p, 6) AS "linear_N_0_M_0", round(q, 6) AS "linear_N_0_M_1",
       round(my + wp * (p - mp) + wq * (q - mq), 6) AS "linear_N_1_M_0" FROM o JOIN f1 ON fold = k""",
    stacked_baseline=f"""
WITH {ORDER_FACTS}, b AS ({sql_folds("facts", "row_id", 3)}),
fits AS (SELECT k, regr_slope(y, qty) AS s, regr_intercept(y, qty) AS i FROM b, range(0, 3) t(k) WHERE fold <> k GROUP BY k)
SELECT row_id, fold, round(i + s * qty, 6) AS "linear_N_0_M_0" FROM b JOIN fits ON fold = k""",
)
ORACLE["resumed_linear"] = ORACLE["stacked_linear"]
