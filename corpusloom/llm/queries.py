"""One query for each operator, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import automaton, decontaminate, imatch, neardup, pieces, quality, secrets, suffixsort, surrogates, wordpiece

#: The queries' key; a user passes a secret of their own.
SURROGATE_KEY = b"corpusloom query key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op1_digest(secrets.secret_spans(_table(spark, sf_dir, "documents")))


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op2_result(decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.op4_result(_table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.op9_result(neardup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixsort.op5_result(suffixsort.remove_repeats(_table(spark, sf_dir, "documents")))


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.op6_result(surrogates.replace_private(_table(spark, sf_dir, "documents"), SURROGATE_KEY))


def op7_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.op7_result(automaton.remove_repeats(_table(spark, sf_dir, "documents")))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_rows(_table(spark, sf_dir, "documents"))


def op10_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_ratings(docs, quality.grades_of(_table(spark, sf_dir, "labels")), 3)
    return quality.score(docs, model).select(
        "doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round(F.col("tails")[0], 6).alias("p_not_toxic"), F.round(F.col("tails")[1], 6).alias("p_good"), (F.col("tails")[1] >= quality.KEEP_FROM).alias("kept")
    )


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_winnowing, op3_token_counts, op4_imatch, op5_suffix_dedup, op6_surrogates, op7_automaton_dedup, op8_sentencepiece, op9_near_duplicates, op10_quality_grades)}
ORACLE_SQL: dict[str, str] = {"op2_winnowing": decontaminate.ORACLE_SQL}
