"""From raw documents to packed training sequences, in five stages over the whole corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents; extra columns are dropped.

Null texts and texts without a letter have no language and go in the first stage. Rows without a doc_id link
with nothing and stay; null sources are a source of their own. Ties go to the smaller doc_id. Texts may be of
any length and are read whole. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.llm import language_id, minhash_neardup, mixing, packing, substring_dedup
from codelattice.llm.common import few, materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text, no letter) go; lang becomes the predicted language."""
    found = language_id.annotate(docs.select(*COLUMNS), language_id.train(docs))
    return found.where("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays, and of rows that repeat doc_id
    and text one. Texts are shuffled only where a doc_id repeats or where too many documents go for a broadcast."""
    found = minhash_neardup.near_duplicates(docs)
    gone = few(materialise(found.where(~F.col("kept")).select("doc_id").distinct(), "gone"))
    repeated = few(materialise(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"), "repeated"))
    docs = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")
    once = docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(repeated, "doc_id", "left_anti").unionByName(once).select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out; documents of which nothing is left go."""
    cut = substring_dedup.dedup_passages(docs.select(*COLUMNS))
    return cut.where((F.col("removed_words") == 0) | F.col("text").rlike(r"\S")).withColumn("n_chars", F.when(F.col("removed_words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix(docs.select(*COLUMNS))
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", keep_languages),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: The vocabulary of the last stage and the classifier of the first can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
