"""The queries ``opN_<name>`` of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from planewise.llm import divergence, interactions, language, lines, pages, phrases, pieces, private, simhash, substrings, templates, tiles, vectors
from planewise.llm.common import read


#: The key of the registered query, whose tables are invented; a user's own key is a secret.
QUERY_KEY = "invented tables"


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.dedup_phrases(read(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(read(spark, sf_dir, "documents"), pieces.default_model())


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(read(spark, sf_dir, "documents"))


def op6_private_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.replace_private(read(spark, sf_dir, "documents"), QUERY_KEY)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(read(spark, sf_dir, "embeddings"), every=20)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(read(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read(spark, sf_dir, "documents"))


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.interactions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.near_duplicates(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_suffix_array_dedup,
        op2_decontamination,
        op3_repeated_phrases,
        op4_sentencepiece,
        op5_language_id,
        op6_private_surrogates,
        op7_simhash_near_dedup,
        op8_nearest_neighbours,
        op9_main_text,
        op10_line_dedup,
        op11_source_divergence,
        op12_filter_interactions,
        op13_embedding_near_dedup,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op10_line_dedup": lines.ORACLE, "op11_source_divergence": divergence.ORACLE, "op12_filter_interactions": interactions.ORACLE, "op13_embedding_near_dedup": tiles.ORACLE}
