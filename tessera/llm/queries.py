"""The registered queries of this package: thin wrappers that give each operator
its production parameters and shape its rows as the query's contract says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, htmlcrf, lexsearch, linededup, merkle, nbsvm, oracles, packing, perplexity, simhash, superkmer, toxicity, urlfilter, wavelet
from .common import held_out, table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = htmlcrf.extract(table(spark, sf_dir, "pages"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).drop("score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = superkmer.dedup_substrings(table(spark, sf_dir, "documents"), window=13)
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _judged(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _judged(nbsvm.score(docs, nbsvm.fit(docs, table(spark, sf_dir, "labels"))), 0.7)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, length=4096)


def op9_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _judged(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), 0.3)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexsearch.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return wavelet.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_line_dedup, op3_url_filter, op4_substring_dedup, op5_decontamination, op6_quality, op7_simhash, op8_packing, op9_perplexity, op10_toxicity, op11_lexical_search, op12_merkle_manifest, op13_token_shards)}
ORACLE = {"op2_line_dedup": oracles.OP2, "op3_url_filter": oracles.OP3, "op4_substring_dedup": oracles.OP4, "op11_lexical_search": oracles.OP11, "op12_merkle_manifest": oracles.OP12}
