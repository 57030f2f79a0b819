"""The corpus pipeline: ordered stages over documents, each a table in the shared folder.

Every stage works on all rows that the one before kept, and all but the last return the
columns of documents:

* toxicity drops documents that the nearest labelled examples call toxic;
* line_dedup deletes blocks of lines that align with any earlier document (n_chars, where
  there is such a column, follows the text);
* simhash keeps one document, that with the smallest doc_id, of each group of near duplicates, and
  one row of a document that is given several times;
* decontamination drops documents that hold a benchmark item;
* mixing adds domain posteriors, and the rate and copies that meet the target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import scratch, staged
from vellum.llm.decontamination import decontaminate
from vellum.llm.line_dedup import line_dedup
from vellum.llm.mixing import mix
from vellum.llm.near_duplicates import one_of_each_group
from vellum.llm.toxicity import NOT_HELD_OUT, fit_toxicity, score_toxicity


#: Shares of the token budget; toxic documents are gone by the last stage.
TARGETS = {"high": 0.8, "low": 0.2, "toxic": 0.0}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"), keep=NOT_HELD_OUT)
    return score_toxicity(docs, model).where("predicted = 0").select("carried.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    carry = [c for c in docs.columns if c != "text"]
    out = line_dedup(docs, carry=carry, every=True)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"carried.`{c}`").alias(c) for c in docs.columns])


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hits = decontaminate(docs, _table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(hits, docs["doc_id"].eqNullSafe(hits["doc_id"]), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, _table(spark, sf_dir, "labels"), TARGETS)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup_stage),
    ("simhash", simhash),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: No stage has a SQL form: training, alignment and least squares are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each reading what the one before wrote."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = staged(stage(spark, docs, sf_dir), f"pipeline_{name}", keep=True)
    return docs
