"""A corpus pipeline of five stages, each an operator of kinfold.llm.

Every stage gets what its predecessor kept, as a table that was written and
reread. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import exact, jaccard, langid, packing, secrets
from kinfold.llm.common import discard, release, scratch, stored
from kinfold.llm.queries import tokenizer


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, however low its score; the model learns from the labelled three quarters."""
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    found = langid.predict(marked, langid.train(docs))
    return found.filter(F.col("lang_pred") != "und").select("row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest doc_id."""
    return exact.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked shingle sets: that with the smallest doc_id."""
    found = jaccard.components(docs.select("doc_id", "text"), width=5, percent=80)
    # equal rows were removed before; a null id is a document of its own
    go = found.filter("component_id != doc_id").select("doc_id").distinct()
    return docs.join(go, "doc_id", "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; live-looking credentials in their texts are replaced by their kind."""
    clean = secrets.redact(secrets.scan(docs, F.col("source"), F.concat_ws("/", "source", "lang")))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"), with_ids=False)


STAGES = [("language ID", language), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("secret scans", secret_scan), ("packing", pack)]

#: The stages can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is written to the shared folder and reread.

    What a stage stored for itself, and its input, go when its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch():
            found = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
        discard(docs)
        docs = found
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
