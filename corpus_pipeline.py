"""The corpus pipeline: languages, near copies, benchmark leaks, personal data, tokens.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows that its predecessor kept and returns
the columns of ``documents``; the last returns token figures. Between stages the rows are written as
Parquet and read again. No stage can be written in SQL as a whole, so there is no ``ORACLE_SQL``; the
tests hold the pipeline against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souklens.functions.storage import materialise
from souklens.llm import bpe, fmindex, language, minmax, pii
from souklens.llm.queries import tokenizer_file
from souklens.llm.textbytes import plain_columns

#: Near copies: share of common 5-word shingles, in per cent.
SIMILARITY = 80
#: Rows whose language is at least so sure stay: lower scores mean a toss-up on both levels.
LEAST_SCORE = 0.3
#: Ids to be dropped are broadcast up to this many (8 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _sized(rows: DataFrame) -> DataFrame:
    return rows.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in rows.columns else rows


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of a determined language; texts that are null, without a letter or of no language's shape go."""
    rows, restore = plain_columns(docs)
    names = dict(zip(docs.columns, rows.columns))
    learned = language.train(docs.filter(~language.held_out("doc_id")).select(F.col("doc_id").alias("id"), "lang", "text"))
    found = language.predict(rows, learned, names["text"], rows.columns)
    return restore(found.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest id; of rows that repeat id and text one stays.

    Rows with a null id are compared with nothing and stay.
    """
    found = materialise(minmax.near_duplicates(docs, "doc_id", "text", SIMILARITY))
    gone = found.filter("NOT kept").select("doc_id").distinct()
    out = _without(docs, gone)
    again = materialise(found.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if again.isEmpty():
        return out
    once = out.join(again, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return _without(out, again).unionByName(once)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti").select(docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the passages of ``benchmark``; a row of which nothing but such passages is left goes."""
    rows, restore = plain_columns(docs)
    text = dict(zip(docs.columns, rows.columns))["text"]
    cleaned = fmindex.remove(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text)
    return _sized(restore(cleaned.filter((F.col("n_hit") == 0) | F.col(text).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with each span of personal data replaced by its kind in brackets."""
    rows, restore = plain_columns(docs)
    return _sized(restore(pii.redact(rows, dict(zip(docs.columns, rows.columns))["text"])))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token figures of each row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and whether decoding gave the text back (``same``)."""
    return bpe.round_trip(docs, tokenizer_file())


STAGES = [
    ("language identification", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("personal data", redact_personal_data),
    ("BPE encoding and decoding", encode_and_decode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
