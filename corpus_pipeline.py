"""A corpus prepared in five stages, each by one of the text operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and
reads again as the next stage's ``docs``. All but the last return the columns of ``documents``.
Further columns go through every stage but the last, whatever their names; an empty table gives an
empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from featurelab.llm import mixing, packing, pii, quality, queries, simhash
from featurelab.sources.work import materialize


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, scores at 0.7 or more.

    A NULL or empty text is scored like any other; every one of repeated rows is kept or rejected alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # Columns go by place: no name in the table can clash with the score's.
    names = docs.columns
    placed = docs.toDF(*[f"c{i}" for i in range(len(names))])
    scored = quality.score(placed, quality.fit(docs, labels), text_col=f"c{names.index('text')}", out="score")
    return scored.where(F.col("score") >= queries.GOOD).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies.

    A row goes by a hash of its id and text, so rows that share an id but not their text, and rows
    with a NULL id, are documents of their own. Of rows that repeat both, one stays; should two
    different rows of one group share that hash, both stay. NULL and wordless texts are copies of
    each other.
    """
    key = F.xxhash64("doc_id", "text").alias("key")
    found = materialize(simhash.near_duplicates(docs.select(key, "text"), "key", width=3, max_bits=2, seed=42), "groups")
    first = found.where("key = component_id").groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    told = docs.select(key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # Always a merge join: the texts are dealt out once, at any size.
    kept = told.join(materialize(first, "first").hint("merge"), "key")
    by = Window.partitionBy("key", "row.doc_id", "row.text").orderBy(F.xxhash64("row"))
    one = kept.where("rows > 1").withColumn("nth", F.row_number().over(by)).where("nth = 1")
    return kept.where("rows = 1").select("row").unionByName(one.select("row")).select("row.*")


def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated ones too, with personal data masked and ``n_chars`` of the new text; NULL texts stay NULL."""
    return pii.redact(docs, queries.private_data_model())


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; wordless ones among them, NULL is a source."""
    return mixing.mixed_documents(docs, share=1.5, max_epochs=2.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, with their sequence and place; a NULL or empty text has the end id alone."""
    return packing.pack(docs, queries.tokenizer_path(), queries.CAPACITY, 0)


STAGES = [
    ("quality classifier", good_documents),
    ("SimHash near-dedup", one_of_each_group),
    ("PII", without_private_data),
    ("mixing", mixed),
    ("best-fit packing", packed),
]

# A learned classifier, XXH64 fingerprints and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return materialize(STAGES[-1][1](spark, docs, sf_dir), "packed")
