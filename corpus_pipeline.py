"""From raw documents to token ids in five stages.

Each stage is a function of (spark, docs, sf_dir) on all that the one before it kept; its result is written as
Parquet and read again. All but the last return the columns of ``documents``.

Rows with the same id and text are one document and share every decision. Texts that lose lines get a new n_chars.

Null texts are empty and, like other texts too short for the fixed rules, go in the first stage. Null ids are an id like
others; such rows are told apart by their text. Null lang and source form groups of their own. Very long texts pass whole
through every stage. Other columns of ``documents`` aren't read. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwatch.llm import decontaminate, line_dedup, quality, sentencepieces, simhash
from loamwatch.llm.common import keyed, same_row
from loamwatch.staging import discard, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_META = ("lang", "source", "n_chars")
#: No SQL: line, near-duplicate and tokenizer stages can't be expressed.
ORACLE_SQL = None


def _rows(docs: DataFrame) -> DataFrame:
    return keyed(docs, keep=_META)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the fixed rules or the adaptive limits of their language and source."""
    found = quality.quality(_rows(docs), ["doc_id", "row_key", "lang", "source"])
    good = found.groupBy("doc_id", "row_key").agg(F.bool_or("kept").alias("kept")).where("kept")
    return _rows(docs).alias("d").join(good.alias("g"), same_row("d", "g"), "left_semi").select(*COLUMNS)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay in the first of them only."""
    kept = line_dedup.drop_lines(docs, line_dedup.line_bitmaps(docs, keep_first=True), _META)
    chars = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", chars.alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least id. Repeated rows of it become one, with the least lang, source and n_chars (nulls first)."""
    first = simhash.near_duplicates(docs).where("first").select("doc_id", "row_key")
    kept = _rows(docs).alias("d").join(first.alias("f"), same_row("d", "f"), "left_semi")
    one = kept.groupBy("doc_id", "row_key").agg(F.first("text").alias("text"), F.min(F.struct(*_META)).alias("_meta"))  # the text is the same
    return one.select("doc_id", "text", "_meta.*").select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    hits = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "row_key").distinct()
    return _rows(docs).alias("d").join(hits.alias("h"), same_row("d", "h"), "left_anti").select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of each text, their number, and whether they decode to the text."""
    encoded = sentencepieces.encode_texts(docs, keep=("doc_id", "lang", "source", "n_chars"))
    return encoded.select("doc_id", "lang", "source", "n_chars", F.size("token_ids").cast("long").alias("n_tokens"), "round_trip", "token_ids")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", repeated_lines),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece encoding and decoding", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name.split()[0].lower())
        discard(before)  # a stage's table is read by the next one alone
    return docs
