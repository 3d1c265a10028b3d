"""The queries of this folder, one per operator, over whole tables; and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import digest, near_groups

    return digest(near_groups(table(spark, sf_dir, "documents")))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge_urls, rule_table

    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op7_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .private import digest

    return digest(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import passages

    return passages(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    return judge(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .content import extract

    return extract(table(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .middle import fill_in_middle

    return fill_in_middle(table(spark, sf_dir, "documents"), outputs=False)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import periodic_runs

    return periodic_runs(table(spark, sf_dir, "documents"), plant=True, outputs=False)


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import alike_groups

    return alike_groups(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, run in globals().items() if name.startswith("op") and callable(run)}


def oracle_sql() -> dict[str, str]:
    from . import middle, quality, urls

    return {"op3_url_filter": urls.ORACLE, "op9_quality_rules": quality.ORACLE, "op11_fill_in_middle": middle.ORACLE}
