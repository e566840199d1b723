"""Reading and writing observation tables, solutions and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


# Quotes inside a quoted field are doubled, as other CSV tools write them.
_CSV = {"header": True, "escape": '"'}
# A value that does not fit its type, or a row of another length, stops the scan instead of being lost.
_STRICT = {"mode": "FAILFAST"}
# What stands for a missing field inside the reader: no text can be it, so quoted empty text stays text.
_MISSING = "\x01missing\x01"


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str | None = None, **options
) -> DataFrame:
    """CSV with a header row. Without a schema the types are inferred, which costs one more scan.

    ``options`` go to the reader; ``multiLine=True`` reads line breaks inside quotes, at the
    price of one task per file. A malformed row raises an error; ``mode="PERMISSIVE"`` reads on.
    A header whose names or order differ from the schema's raises an error too. A field without
    anything is NULL, ``""`` is empty text.
    """
    reader = spark.read.options(**{**_CSV, **_STRICT, "enforceSchema": False, "nullValue": _MISSING, **options})
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, line_breaks: bool = False) -> None:
    """CSV with a header row. Text with a line break raises an error, as a reader that takes lines apart
    would cut it in two without one; ``line_breaks=True`` writes it, to be read with ``multiLine=True``."""
    if not line_breaks:
        told = {}
        for f in df.schema:
            if isinstance(f.dataType, StringType):
                value = F.col("`" + f.name.replace("`", "``") + "`")
                broken = value.contains("\n") | value.contains("\r")
                told[f.name] = F.when(broken, F.raise_error(F.lit(f"line break in {f.name}: write with line_breaks=True"))).otherwise(value)
        df = df.withColumns(told) if told else df
    # Blanks at the ends of a text are part of it.
    df.write.mode("errorifexists").options(**_CSV, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def save_solutions(solutions: DataFrame, path: str) -> None:
    solutions.write.mode("errorifexists").parquet(path)


def load_solutions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_model(model, path: str) -> None:
    model.write().save(path)


def load_model(model_class, path: str):
    return model_class.load(path)
