"""Grids of models in layers: a neuron of one layer may use the outputs of lower layers."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, fields, is_dataclass
from functools import partial

from pyspark.ml.param import Params
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featurelab.functions.draws import SEED, hash32, integer
from featurelab.models.gram import fold_moments, least_squares, linear_prediction, total_moments
from featurelab.models.jobs import side_by_side
from featurelab.models.learners import Learner, MomentFit
from featurelab.operators.clean import clamp_negative, stack_rows
from featurelab.operators.profile import plain_column
from featurelab.sources.work import materialize, new_path


def random_grids(
    systems: DataFrame, models: list[str], layers: int, neurons: int, seed: int = SEED
) -> DataFrame:
    """(system_id, layer, neuron, model): one drawn model per cell of every system."""
    cells = systems.select(
        "system_id", F.explode(F.sequence(F.lit(0), F.lit(layers - 1))).alias("layer")
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(neurons - 1))).alias("neuron"))
    drawn = integer(len(models), F.col("system_id"), F.col("layer"), F.col("neuron"), seed=seed)
    names = F.array(*[F.lit(m) for m in models])
    return cells.withColumn("model", F.element_at(names, (drawn + 1).cast("int")))


def bits_per_model(models: list[str]) -> int:
    return max(1, (len(models) - 1).bit_length())


def grid_chromosomes(grids: DataFrame, models: list[str]) -> DataFrame:
    """(system_id, chromosome): the codes of all cells, layer by layer."""
    names = F.array(*[F.lit(m) for m in models])
    code = F.lpad(F.bin(F.array_position(names, F.col("model")) - 1), bits_per_model(models), "0")
    cell = F.struct("layer", "neuron", code.alias("code"))
    # One entry per cell of a system: layers * neurons, a setting.
    ordered = F.array_sort(F.collect_list(cell))
    return grids.groupBy("system_id").agg(F.array_join(F.transform(ordered, lambda c: c["code"]), "").alias("chromosome"))


def decode_chromosomes(
    chromosomes: DataFrame, models: list[str], layers: int, neurons: int
) -> DataFrame:
    """Chromosomes back to cells; a code without a model gives NULL."""
    width = bits_per_model(models)
    names = F.array(*[F.lit(m) for m in models])
    cell = F.col("cell")
    code = F.conv(F.substr("chromosome", cell * width + 1, F.lit(width)), 2, 10).cast("int")
    return (
        chromosomes.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(layers * neurons - 1))))
        .select(
            "system_id",
            F.floor(cell / neurons).cast("int").alias("layer"),
            (cell % neurons).alias("neuron"),
            F.get(names, code).alias("model"),
        )
    )


def neuron_name(model, layer, neuron) -> Column:
    return F.concat(model, F.lit("_N_"), layer.cast("string"), F.lit("_M_"), neuron.cast("string"))


def _coin(names: Column, *key, seed: int) -> Column:
    """One fair bit per entry of ``names`` as text."""
    bits = F.transform(
        names, lambda _, i: F.when(hash32(*key, i, seed=seed) % 2 == 1, F.lit("1")).otherwise(F.lit("0"))
    )
    return F.array_join(bits, "")


def _picked(names: Column, bits: Column) -> Column:
    return F.filter(names, lambda _, i: F.substr(bits, i + 1, F.lit(1)) == "1")


def random_neurons(
    grids: DataFrame, features: list[str], layers: int, neurons: int, seed: int = SEED
) -> DataFrame:
    """Every cell with its name, a random half of the baseline features and, for each lower
    layer, a random half of that layer's outputs.

    A system's cells (layers * neurons, a setting) are gathered once; each cell then reads
    the names of the layers below from that row. Adds baseline_genes, baseline_features,
    layer_genes and layer_features (arrays by layer), exmodel_features and chromosome.
    """
    named = grids.withColumn("name", neuron_name(F.col("model"), F.col("layer"), F.col("neuron")))
    cell = F.struct("layer", "neuron", "model", "name")
    systems = named.groupBy("system_id").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    placed = systems.select("system_id", "cells", F.explode("cells").alias("c")).select(
        "system_id", "cells", "c.*"
    )
    key = (F.col("system_id"), F.col("layer"), F.col("neuron"))
    every = F.array(*[F.lit(f) for f in features])
    lower = F.transform(
        F.sequence(F.lit(0), F.lit(layers - 1)),
        lambda below: F.when(
            below < F.col("layer"),
            F.transform(
                F.filter("cells", lambda c: c["layer"] == below), lambda c: c["name"]
            ),
        ).otherwise(F.array().cast("array<string>")),
    )
    layer_genes = F.transform("lower", lambda names, below: _coin(names, *key, "x", below, seed=seed))
    layer_features = F.zip_with("lower", "layer_genes", _picked)
    return (
        placed.withColumn("baseline_genes", _coin(every, *key, "b", seed=seed))
        .withColumn("baseline_features", _picked(every, F.col("baseline_genes")))
        .withColumn("lower", lower)
        .withColumn("layer_genes", layer_genes)
        .withColumn("layer_features", layer_features)
        .withColumn("exmodel_features", F.flatten("layer_features"))
        .withColumn("chromosome", F.concat("baseline_genes", F.array_join("layer_genes", "")))
        .drop("cells", "lower")
    )


def outputs_below(grids: DataFrame, layer: int) -> DataFrame:
    """(system_id, outputs): the names of all neurons in lower layers, in order."""
    below = grids.filter(F.col("layer") < layer)
    name = neuron_name(F.col("model"), F.col("layer"), F.col("neuron"))
    cell = F.struct("layer", "neuron", name.alias("name"))
    ordered = F.array_sort(F.collect_list(cell))
    return below.groupBy("system_id").agg(F.transform(ordered, lambda c: c["name"]).alias("outputs"))


def output_table(predictions: DataFrame, names: list[str]) -> DataFrame:
    """Long (row_id, fold, neuron, prediction) to one column per neuron: one shuffle."""
    return predictions.groupBy("row_id", "fold").pivot("neuron", names).agg(F.first("prediction"))


def neuron_inputs(
    data: DataFrame, outputs: DataFrame | None, baseline: list[str], exmodel: list[str]
) -> DataFrame:
    """The columns a neuron is fitted on: selected baseline features and lower outputs."""
    base = data.select("row_id", "fold", *baseline, "y")
    if not exmodel:
        return base
    return base.join(outputs.select("row_id", "fold", *exmodel), ["row_id", "fold"])


@dataclass
class Neuron:
    name: str
    layer: int
    learner: Learner
    baseline: list[str]
    exmodel: list[str]


def _fold_value(table: DataFrame, neurons: list[Neuron], folds: int) -> dict[str, Column]:
    """Out-of-fold predictions of linear neurons as columns: one set of moments for all of
    them and all folds, and no join."""
    names = sorted({c for n in neurons for c in (*n.baseline, *n.exmodel)})
    moments = fold_moments(table, names, "y", "fold")
    total = total_moments(moments)
    values = {}
    for neuron in neurons:
        fit = neuron.learner.fit if isinstance(neuron.learner.fit, MomentFit) else MomentFit(least_squares)
        used = fit.names([*neuron.baseline, *neuron.exmodel])
        picked = [names.index(c) for c in used]
        value = F.lit(None).cast("double")
        for k in range(folds):
            train = total - moments[k] if k in moments else total
            value = F.when(F.col("fold") == k, linear_prediction(used, *fit.solve(train, picked))).otherwise(value)
        values[neuron.name] = value
    return values


def _long_predictions(table: DataFrame, neurons: list[Neuron], folds: int) -> DataFrame:
    """(row_id, fold, neuron, prediction) of learners that are fitted fold by fold."""

    def part(neuron: Neuron, k: int) -> DataFrame:
        names = [*neuron.baseline, *neuron.exmodel]
        inputs = table.select("row_id", "fold", "y", *names)
        model = neuron.learner.fit(inputs.filter(F.col("fold") != k), names, "y")
        return model.predict(inputs.filter(F.col("fold") == k)).select(
            "row_id", "fold", F.lit(neuron.name).alias("neuron"), "prediction"
        )

    return stack_rows(*side_by_side([partial(part, n, k) for n in neurons for k in range(folds)]))


def system_neurons(neurons: DataFrame, system_id, learners: dict[str, Learner]) -> list[Neuron]:
    """The neurons of one system of ``random_neurons``, with their learners: a few rows."""
    rows = neurons.filter(F.col("system_id") == system_id).orderBy("layer", "neuron").collect()
    return [
        Neuron(r["name"], r["layer"], learners[r["model"]], r["baseline_features"], r["exmodel_features"])
        for r in rows
    ]


def _told(value) -> str:
    """A learner's settings as text that is the same in every process."""
    if isinstance(value, Params):
        known = {p.name: v for p, v in value.extractParamMap().items() if not p.name.endswith("Col")}
        return f"{type(value).__name__}{sorted(known.items())}"
    if is_dataclass(value) and not isinstance(value, type):
        return f"{type(value).__name__}({', '.join(_told(getattr(value, f.name)) for f in fields(value))})"
    if isinstance(value, partial):
        return f"{_told(value.func)}{[_told(v) for v in value.args]}{sorted((k, _told(v)) for k, v in value.keywords.items())}"
    if callable(value):
        held = [_told(c.cell_contents) for c in getattr(value, "__closure__", None) or ()]
        return f"{getattr(value, '__qualname__', type(value).__qualname__)}{held}"
    return repr(value)


def _table_mark(data: DataFrame) -> str:
    """Rows and an order-free sum of hashes of a table: one scan."""
    hashed = F.xxhash64(*[plain_column(c) for c in sorted(data.columns)]).cast("decimal(20,0)")
    rows, total = data.agg(F.count(F.lit(1)), F.sum(hashed)).first()
    return f"{sorted(data.columns)} {rows} {total}"


class Manifest:
    """The finished layers of a grid: a table of (mark, layer, neurons, path) in ``folder``.

    ``mark`` digests the data, the settings of the layer's neurons and all layers below, so a layer trained
    on other rows or with other settings is never taken for this one. A layer is entered after it has
    been written whole; what a stop left half-written has no entry and is not read.
    """

    SCHEMA = "mark string, layer int, neurons array<string>, path string"

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        spark.createDataFrame([], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)

    def entries(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.folder)

    def find(self, mark: str) -> DataFrame | None:
        found = self.entries().where(F.col("mark") == mark).select("path").first()
        return self.spark.read.parquet(found["path"]) if found else None

    def enter(self, mark: str, layer: int, names: list[str], grown: DataFrame) -> DataFrame:
        path = new_path(self.spark, f"layer-{layer}")
        grown.write.parquet(path)
        self.spark.createDataFrame([(mark, layer, names, path)], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)
        return self.spark.read.parquet(path)


def train_layers(
    data: DataFrame, neurons: list[Neuron], folds: int, clip_negative: bool = False, manifest: str | None = None
) -> DataFrame:
    """Out-of-fold predictions of all neurons, one column each, layer by layer.

    ``data`` has row_id, fold, the baseline features and y. Each neuron is fitted on the
    other folds and predicts its own, so later layers never see a fitted value. A layer is
    written before the next one reads it. A neuron without a feature predicts its train mean.

    ``manifest`` names a folder in which every finished layer is entered. Called again with the same
    data and neurons after a stop, training goes on at the first layer without an entry; the layers'
    tables lie in the shared folder, which must still be there.
    """
    held = Manifest(data.sparkSession, manifest) if manifest else None
    mark = f"{folds} {clip_negative} {_table_mark(data)}" if held else ""
    table = data
    for layer in sorted({n.layer for n in neurons}):
        here = [n for n in neurons if n.layer == layer]
        if held:
            told = [(n.name, n.learner.name, _told(n.learner.fit), n.baseline, n.exmodel) for n in here]
            mark = hashlib.sha256(f"{mark} {told}".encode()).hexdigest()
            done = held.find(mark)
            if done is not None:
                table = done
                continue
        linear = [
            n for n in here
            if isinstance(n.learner.fit, MomentFit) or not (n.baseline or n.exmodel)
        ]
        others = [n for n in here if n not in linear]
        grown = table.withColumns(_fold_value(table, linear, folds)) if linear else table
        if others:
            wide = output_table(_long_predictions(table, others, folds), [n.name for n in others])
            grown = grown.join(wide, ["row_id", "fold"])
        if clip_negative:
            grown = grown.withColumns({n.name: clamp_negative(F.col(n.name)) for n in here})
        names = [n.name for n in here]
        table = held.enter(mark, layer, names, grown) if held else materialize(grown, f"layer-{layer}")
    return table.select("row_id", "fold", *[n.name for n in sorted(neurons, key=lambda n: n.layer)])
