"""Categories as 0/1 columns and feature vectors."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from featurelab.operators.profile import plain_column, classify_columns
from featurelab.operators.sized import broadcast_if_small
from featurelab.sources.work import materialize, new_path

# Wider encodings belong in a sparse vector: see dummy_vector.
MAX_DUMMY_COLUMNS = 1000


def categories(df: DataFrame, column: str, limit: int = MAX_DUMMY_COLUMNS) -> list:
    """Sorted distinct values; an error, never a cut, beyond ``limit``."""
    rows = df.select(plain_column(column)).where(plain_column(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} categories: use dummy_vector")
    return sorted(r[0] for r in rows)


def _flags(column: str, values: list, taken: set[str]) -> dict[str, Column]:
    flags = {}
    for v in values:
        name = str(v) if str(v) not in taken else f"{column}_{v}"
        taken.add(name)
        flags[name] = F.when(plain_column(column) == F.lit(v), 1).otherwise(0).cast("bigint")
    return flags


def dummies(df: DataFrame, columns: list[str], limit: int = MAX_DUMMY_COLUMNS) -> DataFrame:
    """Replace each column by one 0/1 column per category, named after the value.

    A name already taken gets the column as prefix. Narrow: no join back on the row.
    """
    taken = {c for c in df.columns if c not in columns}
    flags: dict[str, Column] = {}
    for c in columns:
        flags.update(_flags(c, categories(df, c, limit), taken))
    return df.withColumns(flags).drop(*columns)


def encode_table(df: DataFrame, limit: int = MAX_DUMMY_COLUMNS) -> DataFrame:
    """Numbers stay, text that reads as numbers becomes double, the rest becomes dummies."""
    kinds = {r["column"]: r["is_numeric"] for r in classify_columns(df).collect()}
    types = dict(df.dtypes)
    text_numbers = {
        c: plain_column(c).try_cast("double") for c in df.columns if kinds[c] and types[c] == "string"
    }
    numbers = df.withColumns(text_numbers) if text_numbers else df
    return dummies(numbers, [c for c in df.columns if not kinds[c]], limit)


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """(value, index): the distinct non-NULL values as text, numbered from 0 in UTF-8 order.

    Values are dealt out by ranges, numbered within a range and shifted by the ranges before it; there
    may be as many as rows, and no task or driver holds them all.
    """
    values = df.select(plain_column(column).cast("string").alias("value")).na.drop().distinct()
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = values.repartitionByRange(ranges, "value").withColumn("range", F.spark_partition_id())
    dealt = materialize(dealt, "values")  # a value's range is written down, not computed twice
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("values"))  # a row per range
    shifts = shifts.select("range", F.coalesce(F.sum("values").over(before), F.lit(0)).alias("shift"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("value")) - 1
    return dealt.withColumn("place", place).join(F.broadcast(shifts), "range").select(
        "value", (F.col("place") + F.col("shift")).alias("index")
    )


def dummy_slots(df: DataFrame, columns: list[str], out: str) -> tuple[DataFrame, int]:
    """``df`` with the slots of its categories as an array, one per column, and the number of slots.

    Every column has a slot per value, in UTF-8 order, and a last one for NULL. A dictionary is broadcast
    below a checked size, else joined by a shuffle.
    """
    names, slots, size = set(df.columns), [], 0
    for i, c in enumerate(columns):
        value, index = f"_value_{i}", f"_index_{i}"
        while value in names or index in names:
            value, index = f"{value}_", f"{index}_"
        numbered = materialize(dictionary(df, c), "dictionary")
        known = numbered.count()
        told = broadcast_if_small(numbered.select(F.col("value").alias(value), F.col("index").alias(index)))
        df = df.join(told, plain_column(c).cast("string") == F.col(value), "left").drop(value)
        slots.append((index, F.coalesce(F.col(index), F.lit(known)) + F.lit(size)))
        size += known + 1
    return df.withColumn(out, F.array(*[slot for _, slot in slots])).drop(*[index for index, _ in slots]), size


def dummy_vector(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Any number of categories as one sparse vector, whose slots ``dummy_slots`` describes.

    The table is written once, the vector as its parts, and read with the vector's type. More slots than
    a vector's index can name raise ValueError.
    """
    coded, size = dummy_slots(df, columns, out)
    if size >= 2**31:
        raise ValueError(f"{size} slots are more than a vector can have: use dummy_slots")
    places = F.transform(plain_column(out), lambda i: i.cast("int"))
    parts = F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), places.alias("indices"),
        F.transform(places, lambda _: F.lit(1.0)).alias("values"),
    )
    path = new_path(df.sparkSession, "vectors")
    written = coded.withColumn(out, parts)
    written.write.parquet(path)
    typed = StructType([StructField(f.name, VectorUDT() if f.name == out else f.dataType) for f in written.schema])
    return df.sparkSession.read.schema(typed).parquet(path)


def feature_vector(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out).transform(df)


def masked_vector(df: DataFrame, genome: str, vector: str = "features", out: str = "masked") -> DataFrame:
    """The entries of the vector whose gene is 1; the table is assembled once for all genomes."""
    picked = [i for i, gene in enumerate(genome) if gene == "1"]
    return VectorSlicer(inputCol=vector, outputCol=out, indices=picked).transform(df)
