"""Training-data pipeline over documents: quality rules, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame; all but
the last return the columns of documents. Between stages the rows are written as Parquet and read again.

Defined cases, the same in every stage: a null text is an empty one, fails the base rules of quality and goes there; a
null doc_id stays a row of its own; of repeated rows the near-duplicate stage keeps one; of equals the least doc_id
stays, nulls last; very long texts are read whole; an empty table gives an empty one; further columns pass through all
stages but packing, whatever their names. Each stage reads doc_id and text, packing also source; n_chars is optional.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, near_copies, packing, quality_rules, secrets
from marginalia.llm.common import forget, kept, table
from marginalia.llm.queries import MIXTURE


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned ones reject."""
    return quality_rules.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles overlap by 0.8 or more, that of the least doc_id."""
    return near_copies.representatives(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or re-parameterised."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and n_chars, if there is such a column, counted anew."""
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences that each hold the sources in the mixture wanted."""
    return packing.pack(docs, alpha=MIXTURE)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: Learned rules, fingerprints and token ids are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(*before)  # the next stage's rows are written; the last ones stay, the result reads them
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
