"""A corpus from raw documents to packed sequences: five stages, each a DataFrame written and read again by the next.

Stages, in order, with what each decides:
    quality     documents whose score is under 0.5 go
    neardup     one document of each near-duplicate component stays
    decontam    documents that hold a window of a benchmark item go (coverage limit 0)
    secrets     spans of secrets become [SECRET] in the text; n_chars follows
    packing     token pieces of the rest with their place in sequences of 4096

All but the last return the columns of documents.

Defined cases: a null or empty text is a document like any other: it is scored, is near to none, holds no benchmark item
and no secret, and is packed as its end token. A null doc_id has no label; of documents in one near-duplicate component
that with the least id stays, and rows that repeat an id are judged each by their text. Further columns, whatever their
names, are carried to the last stage and change nothing. Without labels every score is 0.5, so nothing is rejected. An
empty table of documents gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvarium.llm import decontam, neardup, packing, quality, secrets
from solvarium.llm._shared import Scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id")))
    model = quality.train(docs, labels)
    return quality.score(docs, model, score_col="__score").where("__score >= 0.5").select(*docs.columns)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"), max_coverage=0.0)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return out
    changed = F.when(F.col("text").contains("[SECRET]"), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", neardup_stage),
    ("benchmark decontamination", decontam_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: Learned scores, signatures and tokens have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage{k}")
            if k:
                scratch.drop(f"stage{k - 1}")
    return docs
