"""The corpus pipeline: toxic documents go, boilerplate lines go, one of each group of near duplicates stays, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.llm import jaccard, linededup, packing, toxicity
from docfacts.llm.common import discard, free_name, stored, table
from docfacts.llm.queries import tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    facts = free_name(docs, "line_dedup")
    cleaned = linededup.drop_lines(docs, F.col("source"), facts=facts)
    changed = F.col(facts)["n_dropped"] > 0
    return cleaned.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select([F.col(f"`{c}`") for c in docs.columns])


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, k=5, num=80, den=100)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", join_near_duplicates),
    ("packing", pack_sequences),
]

#: The classifier and the tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not given:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
