"""A corpus pipeline of the corpus operators: each stage reads what the one before it kept.

Nulls, empty tables and repeated rows are as each operator says. A text of null is rejected by the quality stage only
if the classifier rejects an empty text, and by the language stage, as it has no letter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm import jaccard, language, line_crf, mixing, pieces
from fieldweave.llm.common import Scratch
from fieldweave.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier predicts to be good."""
    return line_crf.score_documents(docs, table(spark, sf_dir, "labels"), keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found and not rejected."""
    return language.identify(docs, language.train(docs), keep=COLUMNS).where("not rejected").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of linked ones; all of those without a doc_id."""
    return jaccard.keep_one(docs).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: taken words over its size, rounded; documents not taken go.

    Rows are named by two hashes of all columns, so a null or repeated doc_id is nothing special. Equal rows have one
    name: the mix lays out and takes each of them, and one of them stands for as many as it takes of all.
    """
    marked = [x for c in COLUMNS for x in (F.col(c).isNull(), F.col(c))]
    keyed = docs.select(*COLUMNS, F.concat_ws(":", F.xxhash64(*marked), F.xxhash64(F.lit(1), *marked)).alias("row_key"))
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    taken = mixing.mix(keyed.select(F.col("row_key").alias("doc_id"), "source", "text")).groupBy(F.col("doc_id").alias("m_key")).agg(F.sum(times).cast("int").alias("times"))
    held = keyed.join(taken.where("times > 0"), F.col("row_key") == F.col("m_key")).dropDuplicates(["row_key"])
    return held.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and source with the ids of the text, the round trip's outcome and the parity's."""
    got = pieces.encode(docs.select("doc_id", "source", "text"), pieces.read_model())
    return got.select("doc_id", "source", F.size("ids").alias("n_ids"), "ids", "decoded_ok", "parity")


STAGES = [
    ("quality classifier", quality),
    ("language ID", languages),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", encoded),
]
#: No stage of the pipeline can be put in SQL: two are trained models, one a token model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; each stage's rows are written to the shared folder and read again."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
