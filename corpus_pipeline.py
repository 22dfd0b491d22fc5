"""From documents to shards: quality classifier, one of each near-duplicate group, no benchmark leaks, mix, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnflow.llm.common import stored, table
from turnflow.llm.cotraining import good_documents
from turnflow.llm.decontam import without_leaks
from turnflow.llm.mixing import mixed_documents
from turnflow.llm.ngram_join import one_of_each
from turnflow.llm.sharding import SHARDS, shard, tree


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject: each row by its own text and columns, so null and empty texts are judged
    too, and repeated rows alike. Rows without a label, and labels without a row, are fine; see `good_documents`."""
    return good_documents(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group linked by shared 5-word n-grams (Jaccard 0.8). Documents without words stay;
    of rows that repeat one another, and of ties among rows without id, one stays; see `one_of_each`."""
    return one_of_each(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; all rows of an id go with a text that does; see `without_leaks`."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. Those without words give nothing and go; a null source is a source; see `mixed_documents`."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their slot in it. Null ids and repeated rows get slots of their own, ties follow the rest of the row; see `shard`."""
    return shard(docs, tree(SHARDS))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("sharding", sharding),
]

#: The classifier has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
