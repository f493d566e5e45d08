"""Corpus pipeline: documents in, token digests out. Each stage reads what its predecessor wrote.

Stages return the columns of ``documents`` until the last one. Null, empty and repeated rows are handled as the operators
say; an empty table stays empty. The mix is written range-sorted by training position and encoded row by row, so its files, and the
partitions of run()'s result, follow the training order; no stage shuffles after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestamp.llm import bpe, linededup, mixing, quality, simhash
from lodestamp.llm.common import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio's threshold."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.rate(docs, model).where("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their frequent lines; n_chars follows."""
    out = linededup.dedup_lines(docs)
    n_chars = F.char_length("kept_text").cast("long").alias("n_chars")
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with the smallest id (rows without one come last), then by hash of its text.
    Of rows with equal id and text a single one stays.

    Two hashes of id and text are the key of both the join and the window, so texts are shuffled once.
    """
    whole = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("text").isNull(), F.col("text")]
    named = docs.select("*", F.xxhash64(*whole).alias("__k1"), F.xxhash64(F.lit("second"), *whole).alias("__k2"))
    found = simhash.near_duplicates(named, keep=("__k1", "__k2"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__k1", "__k2")).alias("m")
    stay = found.groupBy("component_fp").agg(first).select(F.col("m.__k1").alias("__k1"), F.col("m.__k2").alias("__k2"))
    same = Window.partitionBy("__k1", "__k2").orderBy("lang", "source", "n_chars")
    return named.join(stay, ["__k1", "__k2"]).withColumn("__n", F.row_number().over(same)).where("__n = 1").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix takes it."""
    plan = mixing.plan_mix(docs, whole_documents=True, keep=("text", "lang", "n_chars"))
    return mixing.training_order(plan).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every row."""
    return bpe.digests(docs, bpe.tokenizer_path())


STAGES = [("quality rules", rules), ("line dedup", lines), ("SimHash near-dedup", near_copies), ("mixing to target weights", mix), ("BPE encoding and decoding", tokens)]

#: Fingerprints and byte pairs are beyond SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
