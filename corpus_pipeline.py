"""From raw documents to shards for training: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalspark.llm import decontamination, jaccard_join, language_id, mixing, sharding
from tonalspark.llm.common import scratch

#: No stage but the last can be written in SQL (trained model, hashed blocks, tiling): tests hold them against brute force.
ORACLE_SQL = None


#: Texts of so many letters whose decoding loss reaches the bound are in no language that was learned. Of 10,000 documents of four
#: languages, with junk among them, the largest loss is .71; a text in another script comes to about .8.
LETTERS, FAR = 50, 0.75


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without text or letters, and those of LETTERS letters or more that are too far from the codeword of any
    learned language (FAR). Ambiguous ones stay. Rows and columns stay as they are.

    The model learns from the documents that aren't held out; without any labelled document nothing is told, all go.
    """
    model = language_id.fit(docs.where(~language_id.is_held_out(F.col("doc_id"))))
    added = ("lang_pred", "score", "ambiguous", "loss")
    clashes = {c: f"own_{c}" for c in docs.columns if c in added}
    told = language_id.identify(docs.withColumnsRenamed(clashes), model).where(F.col("lang_pred") != language_id.UNKNOWN)
    foreign = (F.col("loss") >= FAR) & (F.length(F.regexp_replace("text", r"\P{L}+", "")) >= LETTERS)
    return told.where(~foreign).drop(*added).withColumnsRenamed({v: k for k, v in clashes.items()}).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at a similarity of 0.8 the smallest doc_id stays.

    Documents without words and rows with a null doc_id stay; rows of one doc_id stay or go together.
    """
    found = jaccard_join.jaccard_components(docs, k=5, percent=80)
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold 60 % or more of a benchmark item in runs of five words or more, or 30 words in runs of ten.

    Null and empty texts hold nothing and stay; repeated rows share their fate; columns of any name stay as they are.
    """
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples half of the tokens so that sources, languages and topics weigh as the square roots of their tokens do, as far as they
    have the tokens and can all be met.

    A null source or language is a value of its own; documents without words follow their cell; rows of one doc_id share
    their fate, those without one are told apart by source, language, topic and length. Columns stay as they are.
    """
    return mixing.sample(docs, fraction=0.5, temper=0.5)


def in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Appends the documents to a new store in the shared folder and compacts it; adds each row's shard.

    Rows stay as they are, with nulls, empty texts and repeats; a column shard is replaced, other names don't clash. An empty
    table comes back empty. Each call has a store of its own, so a stage that is run again doesn't add to the first one's.
    """
    return sharding.sharded(docs, scratch(spark, "corpus"))


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed_to_targets),
    ("sharding", in_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what each keeps is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
