"""The ``opN_<name>`` queries and, where SQL can express one, the DuckDB statement for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfield.llm import annulus_codes, bloom_lm, mixing, oracles, packing, robust_quality, secret_scan, shingle_join, spot_sigs
from wayfield.llm import stable_search, suffix_levels, tsqr_whitening, url_filter, wordpiece

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; the files stay outside the repository."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


ORACLES["op1_url_filter"] = oracles.url_rules(URL_RULES)


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_levels.remove_repeats(documents(spark, sf_dir))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = wordpiece.rank_file_pieces(vocabulary("byte_bpe_50k.tiktoken"))
    return wordpiece.count_tokens(documents(spark, sf_dir), pieces)


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


ORACLES["op4_secret_scan"] = oracles.secrets()


MIX_PLAN = mixing.MixPlan(
    domain_weights={"g0": 0.5, "g1": 0.3, "g2": 0.2},
    lang_weights={"en": 0.55, "de": 0.2, "fr": 0.15, "es": 0.1},
    budget_share=0.8,
    max_epochs=2,
)
#: Sources are named src<number>; a domain is that number modulo 3.
SOURCE_DOMAIN = "concat('g', cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 3)"


@query
def op5_spot_sigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_sigs.fingerprints(documents(spark, sf_dir))


@query
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source").withColumn("domain", F.expr(SOURCE_DOMAIN))
    return mixing.mix(docs, MIX_PLAN, F.col("domain")).drop("text")


ORACLES["op6_source_mixing"] = oracles.mixture(MIX_PLAN, "'g' || CAST(CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 3 AS VARCHAR)")


@query
def op7_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "lang", "source", "text")
    return robust_quality.judge(docs).drop("lang", "source")


@query
def op8_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score(documents(spark, sf_dir))


@query
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_duplicates(documents(spark, sf_dir)).drop("content", "component")


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


@query
def op11_stable_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stable_search.nearest(embeddings(spark, sf_dir), "id % 20 = 0", k=20)


ORACLES["op11_stable_search"] = oracles.inner_products(k=20, every=20)


@query
def op12_annulus_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annulus_codes.encode(embeddings(spark, sf_dir))


ORACLES["op12_annulus_codes"] = oracles.product_codes(annulus_codes.PARTS, annulus_codes.ENTRIES, annulus_codes.ROUNDS)


@query
def op13_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tsqr_whitening.whiten(embeddings(spark, sf_dir))
