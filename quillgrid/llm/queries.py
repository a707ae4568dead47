"""The queries opN_<name> of the contract, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import bpe
from quillgrid.llm import decontaminate as clean
from quillgrid.llm import html_text, licenses, quality_rules, repair, rule_ensemble, secrets, spelling, warc
from quillgrid.llm.near_dup import near_duplicates
from quillgrid.llm.packing import pack
from quillgrid.llm.token_count import token_counts
from quillgrid.llm.token_files import token_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), bpe.library_path())


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), bpe.library_path(), end_id=2)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), bpe.library_path(), capacity=2048, end_id=0)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_shingles", "kept")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clean.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items", "spans")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"), threshold=0.3)
    return quality_rules.apply(docs, model).drop("probability")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rule_ensemble.classify(docs, rule_ensemble.fit(docs, table(spark, sf_dir, "labels")))


def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(repair.damage(table(spark, sf_dir, "conversations")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.words(table(spark, sf_dir, "documents"), least=5, typos=97), least=3, ratio=2)


def queries() -> dict:
    return {"op11_main_text": op11_main_text, "op12_conversation_repair": op12_conversation_repair, "op13_spelling_variants": op13_spelling_variants, "op10_license_scan": op10_license_scan, "op7_secret_scan": op7_secret_scan, "op3_warc_salvage": op3_warc_salvage, "op4_quality_rules": op4_quality_rules, "op9_quality_classifier": op9_quality_classifier, "op2_decontamination": op2_decontamination, "op1_near_duplicates": op1_near_duplicates, "op5_best_fit_packing": op5_best_fit_packing, "op6_token_counts": op6_token_counts, "op8_token_files": op8_token_files}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": clean.oracle(), "op3_warc_salvage": warc.ORACLE, "op7_secret_scan": secrets.oracle(), "op10_license_scan": licenses.oracle()}
