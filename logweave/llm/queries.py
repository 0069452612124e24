"""The registered queries of this subpackage, one an operator: each applies
its operator, with production parameters, to the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .ann import nearest
from .common import table
from .divergence import SQL as DIVERGENCE_SQL, divergence
from .line_dedup import SQL as LINES_SQL, line_report
from .mixing import mix_report
from .near_dup import near_duplicates
from .packing import pack
from .pii import private_report
from .quality_model import quality_scores
from .quality_rules import quality_report
from .secrets import secret_report
from .simhash import simhash_groups
from .spelling import SQL as SPELLING_SQL, spelling_groups
from .suffix_dedup import repeat_report


def op1_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_report(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_remove_repeats, op2_near_duplicates, op3_quality_model, op4_nearest_neighbours, op5_mix_sources, op6_secrets,
    op7_quality_rules, op8_packing, op9_private_data, op10_line_dedup, op11_spelling_variants,
    op12_simhash, op13_source_divergence)}

#: Hash-based and iterative operators have no SQL; see the brute-force tests.
ORACLE: dict[str, str] = {"op10_line_dedup": LINES_SQL, "op11_spelling_variants": SPELLING_SQL, "op13_source_divergence": DIVERGENCE_SQL}
