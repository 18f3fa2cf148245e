"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeinwork.llm import context_mixing, decontaminate, html_extract, lexical_search, line_dedup, minhash, mixing, ngram_quality, quality_rules, secret_scan, substring_dedup, token_align, url_filter
from skeinwork.llm.common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the rules, else by trees fitted on seed-labelled urls."""
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.fit(url_filter.seed_labelled(pages)))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    return secret_scan.digest(secret_scan.find(table(spark, sf_dir, "documents")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier document or line has."""
    return line_dedup.dedupe(table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return minhash.classify(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document the mix takes."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test items that documents hold."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity under the model of trusted text, and whether it stays."""
    return ngram_quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of every document and whether the rules keep it."""
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document keeps without the 50-byte strings that start in earlier documents."""
    return substring_dedup.dedupe(table(spark, sf_dir, "documents")).drop("removed")


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two vocabularies meet in every document."""
    return token_align.align(table(spark, sf_dir, "documents"))


def op12_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document costs under word counts and under the mixed bit predictors."""
    return context_mixing.score(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that rank highest for every test item."""
    return lexical_search.search(lexical_search.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_secret_scan, op3_line_dedup, op4_minhash, op5_mixing, op6_decontaminate, op7_ngram_quality, op8_html_extract, op9_quality_rules, op10_substring_dedup, op11_token_align, op12_context_mixing, op13_lexical_search)}
ORACLES = {"op3_line_dedup": line_dedup.ORACLE_SQL, "op5_mixing": mixing.ORACLE_SQL, "op9_quality_rules": quality_rules.ORACLE_SQL, "op13_lexical_search": lexical_search.ORACLE_SQL}
