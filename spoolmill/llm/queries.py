"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, jaccard, licenses, media, mixing, packing, pii, quality, ranked, simhash, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)

    def count(kind: int):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    out = out.withColumn("base", F.filter("spans", lambda x: x["base"]))
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS[:4])]
    return out.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), urls.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), licenses.known(spark))
    lines = F.array_join(F.transform("line_licences", lambda x: F.concat(x["line"].cast("string"), F.lit(":"), x["licence"])), ",")
    return found.select("doc_id", "digest", "licence", F.size("line_licences").cast("long").alias("n_lines"), lines.alias("line_licences"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, *toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.to_media(table(spark, sf_dir, "documents")))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    tree = chat.format_tree(chat.with_probe(table(spark, sf_dir, "conversations")), path)
    return chat.digests(chat.read_back(*tree, path))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.select(docs, keep_text=False).select("doc_id", *mixing.LEVELS, "n_tokens", "epoch", "take")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return judged.select("doc_id", *quality.SIGNALS, "base_failed", "kept", "quality")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_url_filters, op3_license_scans, op4_toxicity, op5_media_columns, op6_ngram_jaccard_join, op7_chat_formatting, op8_mixing, op9_quality_rules, op10_packing, op11_simhash, op12_vector_codes, op13_ranked_search)}
ORACLES = {"op2_url_filters": urls.ORACLE, "op3_license_scans": licenses.oracle(), "op7_chat_formatting": chat.ORACLE, "op8_mixing": mixing.ORACLE, "op12_vector_codes": codes.oracle(), "op13_ranked_search": ranked.ORACLE}
