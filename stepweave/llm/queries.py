"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from stepweave.llm import (
    cover_tree,
    decontaminate,
    filter_audit,
    katz,
    line_dedup,
    near_copies,
    secrets,
    sentencepieces,
    sharding,
    simhash,
    token_files,
    toxicity,
    whitening,
)
from stepweave.llm.common import table, vocabulary


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.digest(katz.score(table(spark, sf_dir, "documents"), ~katz.held_out("doc_id")))


def op3_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies.digest(near_copies.near_copies(table(spark, sf_dir, "documents")))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.digest(spark, token_files.write_tokens(docs, vocabulary("byte_bpe_50k.json")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.decontaminate(docs, benchmark))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out("doc_id")), "text", "doc_id", "toxic")
    return toxicity.digest(toxicity.score(docs, model))


def op7_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepieces.digest(sentencepieces.encode_decode(docs, vocabulary("piece_bpe_32k.model")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(table(spark, sf_dir, "documents")))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return cover_tree.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(whitening.whiten(table(spark, sf_dir, "embeddings")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = filter_audit.document_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.digest(filter_audit.audit(counts))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_copies(table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": op1_secrets,
        "op2_katz": op2_katz,
        "op3_near_copies": op3_near_copies,
        "op4_token_files": op4_token_files,
        "op5_decontaminate": op5_decontaminate,
        "op6_toxicity": op6_toxicity,
        "op7_sentencepieces": op7_sentencepieces,
        "op8_line_dedup": op8_line_dedup,
        "op9_top_k": op9_top_k,
        "op10_sharding": op10_sharding,
        "op11_whitening": op11_whitening,
        "op12_filter_audit": op12_filter_audit,
        "op13_simhash": op13_simhash,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secrets": secrets.oracle(),
        "op5_decontaminate": decontaminate.ORACLE,
        "op8_line_dedup": line_dedup.ORACLE,
        "op9_top_k": cover_tree.ORACLE,
        "op12_filter_audit": filter_audit.ORACLE,
    }
