"""The registered queries of the training-data operators: each applies its operator, with
production parameters, to its whole table. ``ORACLES`` holds DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, decontaminate, exact_dedup, license_scan, line_runs, odd_sketch, oracles, packing, quality, ranked_search, text_density, token_counts,
               toxicity, url_reputation)
from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
# The first number in a page's path names the document it shows.
DOCUMENT_OF_URL = "try_cast(regexp_extract(url, '://[^/?#]*/[^?#0-9]*([0-9]+)', 1) as bigint)"


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is bad where its document is labelled low quality or toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.greatest(1 - F.col("quality"), F.col("toxic")).alias("bad"))
    outcomes = pages.select("url", F.expr(DOCUMENT_OF_URL).alias("doc_id")).join(labels, "doc_id").select("url", "bad")
    return url_reputation.judge(pages, outcomes, URL_RULES)


def op2_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), capacity=1024, end_id=0)


def op3_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.delete_runs(table(spark, sf_dir, "documents"), run_words=line_runs.RUN_WORDS)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op5_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op7_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_density.extract(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), limit=4096)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_pair_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), limit=0.3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_reputation": op1_url_reputation,
    "op2_cost_balanced_packing": op2_cost_balanced_packing,
    "op3_line_runs": op3_line_runs,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_odd_sketch": op5_odd_sketch,
    "op6_license_scan": op6_license_scan,
    "op7_text_density": op7_text_density,
    "op8_token_counts": op8_token_counts,
    "op9_decontamination": op9_decontamination,
    "op10_quality": op10_quality,
    "op11_pair_alignment": op11_pair_alignment,
    "op12_ranked_search": op12_ranked_search,
    "op13_toxicity": op13_toxicity,
}

ORACLES: dict[str, str] = {
    "op1_url_reputation": oracles.url_reputation(URL_RULES, """
      SELECT p.url, greatest(1 - l.quality, l.toxic) AS bad FROM pages p
      JOIN labels l ON l.doc_id = try_cast(regexp_extract(p.url, '://[^/?#]*/[^?#0-9]*([0-9]+)', 1) AS BIGINT)"""),
    "op3_line_runs": oracles.LINE_RUNS,
    "op4_exact_dedup": oracles.EXACT_DEDUP,
    "op5_odd_sketch": oracles.NEAR_DUPLICATES,
    "op6_license_scan": oracles.LICENSES,
    "op9_decontamination": oracles.CONTAMINATION,
    "op12_ranked_search": oracles.RANKED,
}
