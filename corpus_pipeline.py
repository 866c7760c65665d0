"""A training corpus from raw documents, in five stages.

Language identification, removal of near duplicates, benchmark decontamination, mixing
of sources, and token ids in files. Each stage takes the documents that the one before
kept, as a table that was written and read again, and returns documents; the last
returns what its files hold. Nulls, repeated rows and empty tables are treated as the
operators say; columns beyond those of ``documents`` are dropped at the start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import binary_output, decontamination, jaccard_join, language_id, mixing
from linkloom.llm.common import cut_lineage, scratch_path, table
from linkloom.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go; the others carry the language that was found, however sure it is."""
    model = language_id.train(language_id.train_allowed(docs))
    found = language_id.predict(docs.select(*COLUMNS), model)
    known = found.where(F.col("lang_pred") != language_id.UNKNOWN)
    return known.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays (five words, similarity 0.8)."""
    return jaccard_join.near_duplicates_removed(docs.select(*COLUMNS))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in files; what the files hold."""
    return binary_output.round_trip(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("binary_output", write_token_ids),
]

#: Stages 1, 4 and 5 cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return cut_lineage(STAGES[-1][1](spark, docs, sf_dir))
