"""From documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir); ``run`` writes what a stage
returns as Parquet in the shared folder and reads it again for the next one. All
stages but the last return the columns of ``documents``.

In every stage a null text counts as empty and stays null, extra columns are
kept, and an empty table gives an empty one; no row goes but by the stage's own
decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import bpe, decontaminate, near_dup, packing, rule_ensemble, secrets, storage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 9) rejects go.

    An empty text is scored like any other. Rows are judged one by one: repeats
    of a row have one verdict. Without labels every row stays.
    """
    return rule_ensemble.keep_good(docs, rule_ensemble.fit(docs, _table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (operator 1) stays: the one of the smallest id.

    Texts without words - null and empty ones too - are a class each, so they
    all stay; of exact repetitions of a row one stays.
    """
    return near_dup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates (operator 2) go.

    A text without words is never contaminated; repeats of a row have one
    verdict; with an empty benchmark every row stays.
    """
    return decontaminate.remove_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets (operator 7) are masked; n_chars follows the text. All rows stay."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 (operator 5): where each piece of each document lies.

    A null or empty text is its end id alone; repeated and null ids are packed
    row by row.
    """
    return packing.pack(docs, bpe.library_path(), capacity=2048, end_id=0)


STAGES = [("quality classifier", keep_quality), ("near-duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("secret scan", mask_secrets), ("packing", pack_sequences)]
#: SQL can't express the classifier's fit, the token ids or the packing; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = storage.materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
