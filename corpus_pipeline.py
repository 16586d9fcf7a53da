"""The corpus pipeline: toxic documents go, then repeated lines, then near copies; sources are mixed and the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of docs.
Null texts are empty documents; they are never toxic by their words, lose no lines, link with nothing, are taken 0 times by the mix.
Rows of one doc_id with different texts are scored, and lose lines, each by its own text; they are one node of the near-copy groups,
so they stay or go together; the mix takes rows of equal doc_id, source and size alike, and each is packed. Equal rows are treated
alike. Lines go before near copies are judged: of a near copy the n-gram stage sees only the lines that no earlier document has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeframe.llm import line_dedup, mixing, ngram_join, packing, toxicity
from probeframe.llm.common import rest, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold stay as they are."""
    rest(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts keep the lines that no earlier line is within one edit of; documents that lose all their lines go."""
    rest(spark)
    out = line_dedup.dedup_lines(docs)
    out = out.where("n_removed = 0 or n_removed < n_lines")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id."""
    rest(spark)
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, whole."""
    rest(spark)
    mixed = mixing.mix(docs, whole=True, rows=True).where("copies > 0 and size > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__copy")).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 4096 tokens."""
    rest(spark)
    return packing.pack(docs).select("doc_id", "copy", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", keep_one),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: SQL cannot express the classifier, so each stage is tested against a plain version of it (tests/llm).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch(spark, "pipeline")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
