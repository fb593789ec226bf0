"""The registered queries of the document operators: each runs over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from frostline.llm import (
    contamination,
    context_tree,
    language,
    lexical,
    near_duplicates,
    packing,
    quality,
    repeats,
    secrets,
    shards,
    spelling,
    token_counts,
    wavelet,
)
from frostline.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"))


@query
def op2_near_duplicates(spark, sf_dir):
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_sharding(spark, sf_dir):
    return shards.balanced_shards(table(spark, sf_dir, "documents"))


@query
def op4_decontamination(spark, sf_dir):
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_token_files(spark, sf_dir):
    return wavelet.read_documents(wavelet.write_shards(table(spark, sf_dir, "documents")))


@query
def op6_repeated_passages(spark, sf_dir):
    return repeats.find_repeats(table(spark, sf_dir, "documents"))


@query
def op7_secret_scans(spark, sf_dir):
    return secrets.secrets(table(spark, sf_dir, "documents"))


@query
def op8_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op9_language_id(spark, sf_dir):
    return language.languages(table(spark, sf_dir, "documents"))


@query
def op10_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op11_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query
def op12_lexical_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_context_tree_scores(spark, sf_dir):
    return context_tree.scores(table(spark, sf_dir, "documents"))


ORACLE["op1_quality_rules"] = quality.ORACLE
ORACLE["op11_spelling_variants"] = spelling.ORACLE
ORACLE["op12_lexical_search"] = lexical.ORACLE
