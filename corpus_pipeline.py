"""A corpus pipeline of five stages, each one operator of ``spoolmill.llm``.

quality rules, near duplicates by n-gram Jaccard, personal data, source mixing, packing. Each stage
takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of
``documents``; the last returns packed pieces. ``n_chars`` follows the text.

``run`` writes each stage's rows to the shared folder, which is where work resumes if executors are lost, and removes
the rows before them. The last stage's input stays until its rows have been read; it is the caller's to remove.

Defined results for any stage: null texts count as empty; null ids, sources and languages are values like others; a
repeated row is a document of its own (near duplicates keep one of them); empty tables give empty results;
columns other than those of ``documents`` are not passed on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolmill.llm import common, jaccard, mixing, packing, pii, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No SQL: the quality fit, the near-duplicate classes and the tokenizer are beyond it.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: empty and null texts among them, as they have too few words."""
    return quality.judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the least id; documents without words all stay."""
    return jaccard.keep_one(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by the name of its kind; null texts stay null, all rows stay."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gets its budget; a document taken in two epochs is there twice, and the last one of
    a source is cut where the budget ends. Documents without words are not taken."""
    taken = mixing.select(docs.select(*COLUMNS))
    text = mixing.cut_text(F.col("text"), F.col("take"), F.col("n_tokens"))
    return taken.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens; a document without text is one piece of one token."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_rules), ("jaccard", near_duplicates), ("pii", personal_data), ("mixing", mix_sources), ("packing", pack_windows)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        with common.scratch() as keep:
            docs = keep(common.cut(stage(spark, docs, sf_dir)))
        if before is not None:
            common.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
