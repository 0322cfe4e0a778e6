"""From raw documents to packed training sequences.

STAGES lists (name, function) in order. A function takes (spark, docs, sf_dir) and works on all of docs, which
is what the stage before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm import line_dedup, mixing, near_dedup, packing, toxicity
from weftwork.llm.common import read_table
from weftwork.operators.rounds import cut, drop_scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = toxicity.fit_chain(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), chain).filter(F.col("toxic") < chain.threshold).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay even if all their lines go; n_chars follows the text."""
    kept = line_dedup.drop_repeated_lines(docs.select(*COLUMNS))
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each class stays, and so do rows without doc_id.

    Where a doc_id is repeated, each of its texts stays or goes for itself; those that stay come as often as they came, equal rows too.
    """
    gone = near_dedup.near_duplicate_texts(docs).filter("doc_id <> class_id").select("doc_id", F.col("digest").alias("_digest")).distinct()
    return docs.select(*COLUMNS).withColumn("_digest", near_dedup.text_digest()).join(gone.hint("merge"), ["doc_id", "_digest"], "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mixture takes twice come twice."""
    return mixing.mix(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), "stage")
        drop_scratch(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Classifiers, near duplicates and tokenizers are beyond SQL; tests hold each stage against plain Python.
ORACLE_SQL = None
