"""The corpus pipeline: quality, line dedup, near copies, decontamination and mixing, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps with the columns
of ``documents``; ``run`` writes each result as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxelloom.llm import decontam, jaccard, linededup, mixing, quality, simhash
from voxelloom.llm.common import Work, components, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _named(docs: DataFrame) -> DataFrame:
    """The documents' own columns; rows without id are left out, as no later decision could name them."""
    return docs.select(*COLUMNS).where("doc_id IS NOT NULL")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    docs = _named(docs)
    bad = quality.classify(docs, table(spark, sf_dir, "labels")).where("NOT keep").select(F.col("doc_id").alias("bad")).distinct()
    return docs.join(bad, F.col("doc_id") == F.col("bad"), "left_anti")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines, short ones too, that repeat earlier ones; one that loses all its words goes."""
    docs = _named(docs)
    cut = linededup.removed(docs.select("doc_id", "text"), Work(spark, "lines"), min_words=1)
    cut = cut.groupBy("doc_id").agg(F.collect_set("line").alias("cut")).withColumnRenamed("doc_id", "cut_id")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("cut"), i)), "\n")
    text = F.when(F.col("cut").isNull(), F.col("text")).otherwise(kept)
    out = (docs.join(cut, F.col("doc_id") == F.col("cut_id"), "left").withColumn("text", text)
           .where(F.col("cut").isNull() | (F.trim(F.translate("text", "\n\t\r\f\v", "     ")) != "")))
    return out.withColumn("n_chars", F.when(F.col("cut").isNull(), F.col("n_chars")).otherwise(
        F.length("text").cast("bigint"))).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; documents without words are no copies.

    Near copies have fingerprints as op6 links them, or sets of five-word shingles with a Jaccard similarity of 0.8
    or more, which differ in far more bits than op6 allows.
    """
    docs, work = _named(docs), Work(spark, "near")
    worded = docs.where(F.coalesce(mixing.n_tokens(F.col("text")), F.lit(0)) > 0).select("doc_id", "text")
    found = simhash.near_duplicates(worded).where("doc_id <> component_id").select(
        F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    links = work.put(found.unionByName(jaccard.linked(worded, work)), "links")
    bad = components(links, work, "group").where("node <> root").select(F.col("node").alias("bad")).distinct()
    return docs.join(bad, F.col("doc_id") == F.col("bad"), "left_anti").dropDuplicates(["doc_id"])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontam.clean(_named(docs), table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled documents with the topic, token count and probability they were drawn with."""
    docs = _named(docs)
    drawn = mixing.mix(docs).where("selected").select(F.col("doc_id").alias("drawn"), "topic", "n_tokens", "probability").distinct()
    return docs.join(drawn, F.col("doc_id") == F.col("drawn")).drop("drawn")


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage), ("SimHash near-dedup", near_stage),
          ("benchmark decontamination", decontamination_stage), ("mixing sources to target weights", mixing_stage)]
#: A trained classifier and exact set joins are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.put(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            work.drop(f"stage{k - 1}")
    return docs
