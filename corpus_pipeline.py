"""The corpus pipeline: documents in, packed training sequences out.

Each stage gets what its predecessor wrote, applies one operator to all of it and,
but for the last, returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.jaccard import JaccardJoin
from faultline.llm.packing import pack_documents
from faultline.llm.quality import quality_verdicts
from faultline.llm.queries import mixed, table, tokenizer_file
from faultline.llm.shared import stored
from faultline.llm.substrings import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a risk-controlled rule rejects go."""
    return quality_verdicts(docs, table(spark, sf_dir, "labels"), keep_text=True).where("kept").select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays."""
    return JaccardJoin(docs).one_of_each(docs).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under repeated windows go; a document left without words stays as an empty one."""
    cleaned = remove_repeats(docs).drop("text", "n_chars").withColumnRenamed("kept_text", "text")
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is repeated as often as its rate says, or left out."""
    rated, _ = mixed(docs, spark, sf_dir, keep_text=True)
    return rated.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer_file(), 2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: Fitted rates and byte-pair ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage's output is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
