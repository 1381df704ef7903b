"""The registered queries: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, quality_model, sql, warc
from tidemark.llm.divergence import divergence
from tidemark.llm.ngram_join import ngram_components
from tidemark.llm.packing import pack_documents
from tidemark.llm.pii import pii_digests
from tidemark.llm.prefix_trie import prefix_trie
from tidemark.llm.quality_rules import apply_rules
from tidemark.llm.secret_scan import secret_digests
from tidemark.llm.token_files import read_token_files, token_digests, write_token_files
from tidemark.llm.tokens import default_path
from tidemark.llm.topk import top_k
from tidemark.llm.toxicity import toxicity
from tidemark.session import read_table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(read_table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_model.fit(docs).score(docs, ("doc_id",))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(spark, read_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(read_table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.tiktoken"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(read_table(spark, sf_dir, "documents"), default_path("word_bpe_49k.json"), "word", end_id=1)
    return token_digests(read_token_files(manifest))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, model = mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    domains = F.array(*map(F.lit, model.domains))
    likeliest = F.element_at(domains, F.array_position("posterior", F.array_max("posterior")).cast("int"))
    return mixed.select("doc_id", "n_tokens", likeliest.alias("domain"), "posterior", "rate", "copies")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archive(read_table(spark, sf_dir, "pages"))
    # Records that aren't whole fail: their bytes count here, not only their headers.
    records = warc.read_archive(spark, path).where("octet_length(record) > 0")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digests(read_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(read_table(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, read_table(spark, sf_dir, "embeddings"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark, read_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark, read_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_ngram_join": op3_ngram_join,
        "op4_secret_scan": op4_secret_scan,
        "op5_token_files": op5_token_files,
        "op6_mixing": op6_mixing,
        "op7_warc": op7_warc,
        "op8_pii": op8_pii,
        "op9_quality_rules": op9_quality_rules,
        "op10_top_k": op10_top_k,
        "op11_toxicity": op11_toxicity,
        "op12_source_divergence": op12_source_divergence,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_ngram_join": sql.NGRAM_COMPONENTS,
        "op7_warc": sql.WARC,
        "op9_quality_rules": sql.QUALITY_RULES,
        "op10_top_k": sql.TOP_K,
        "op12_source_divergence": sql.DIVERGENCE,
        "op13_prefix_trie": sql.PREFIX_TRIE,
    }
