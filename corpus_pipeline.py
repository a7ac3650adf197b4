"""The corpus pipeline: quality rules, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes it as Parquet to the
shared folder and hands the reread table to the next. All but the last return the columns of
documents, whole rows as they came.

Rows whose text is null count as empty: the quality rules reject them. Rows that repeat another in
every column are copies like any other. An empty table passes through. Extra columns of documents
are carried along, whatever their names.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import packing, quality, simhash, toxicity
from wardline.llm.base import ship_package, staged, table
from wardline.llm.catalog import WORD_VOCABULARY


def _rows(docs: DataFrame, *fields: str) -> DataFrame:
    """The whole row as ``row`` beside the fields a stage works on, so that no other name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *fields)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the robust outlier test rejects go."""
    ship_package(spark)
    judged = quality.with_verdict(staged(quality.with_counts(docs), "pipeline-quality"))
    return judged.where("kept").select("row.*")


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go; the model learns from the kept documents' labels."""
    # The text goes through the scoring once: the row beside it is without it.
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    scored = toxicity.with_toxicity(
        docs.select(rest, "doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"), with_text=True
    )
    return scored.where("predicted = 0").select(*[F.col("text" if c == "text" else f"row.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the one with the smallest id, of repeated rows any one.

    Components are those of the operator itself: fingerprints of three-word shingles, links at three bits.
    """
    ship_package(spark)
    own = staged(_rows(docs).withColumn("uid", F.monotonically_increasing_id()), "pipeline-copies")
    place = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("doc_id"), "uid")
    found = simhash.near_duplicates(own.select(place.alias("id"), F.col("row.text").alias("text")), "id", "text")
    stays = found.where("id = component").select("id.uid")
    return own.join(stays, "uid", "left_semi").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's pieces with their place in a training sequence."""
    ship_package(spark)
    return packing.pack_documents(docs, WORD_VOCABULARY)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("simhash_near_dedup", near_duplicates),
    ("best_fit_packing", pack),
]

# Hashes of shingles, fits and searches are beyond SQL; tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
