"""The registered queries of this package: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souklens.llm import bpe, collocations, fmindex, forest, language, licences, minmax, pii, quality, warc, whitening, wrappers

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def op9_minmax_dedup(spark: SparkSession, root: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, root, "documents"), percent=85)


def op6_fm_decontamination(spark: SparkSession, root: str) -> DataFrame:
    found = fmindex.scan(table(spark, root, "documents"), table(spark, root, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def tokenizer_file() -> str:
    """The byte-level BPE file that the queries use; installed beside Python, not part of this package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_boosted_pii(spark: SparkSession, root: str) -> DataFrame:
    found = pii.find(table(spark, root, "documents"))
    counts = [pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"),
                        *[pii.count_of(F.col("spans"), k).alias(f"n_{k}") for k in pii.ADDED])


def op2_wrapper_text(spark: SparkSession, root: str) -> DataFrame:
    return wrappers.extract(table(spark, root, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op3_licence_automaton(spark: SparkSession, root: str) -> DataFrame:
    return licences.scan(table(spark, root, "documents")).drop("spans")


def op4_trie_bpe(spark: SparkSession, root: str) -> DataFrame:
    return bpe.round_trip(table(spark, root, "documents"), tokenizer_file()).drop("same")


def op5_language_svm(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return language.identify(docs, docs).select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op7_warc_salvage(spark: SparkSession, root: str) -> DataFrame:
    return warc.round_trip(table(spark, root, "pages")).drop("url")


def op8_two_tier_counts(spark: SparkSession, root: str) -> DataFrame:
    return bpe.token_counts(table(spark, root, "documents"), tokenizer_file())


def op10_quality_ratio(spark: SparkSession, root: str) -> DataFrame:
    made = quality.assess(table(spark, root, "documents"), table(spark, root, "labels"))
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op11_stripe_collocations(spark: SparkSession, root: str) -> DataFrame:
    return collocations.collocations(table(spark, root, "documents"))


def op12_forest_neighbours(spark: SparkSession, root: str) -> DataFrame:
    return forest.neighbours(table(spark, root, "embeddings"), F.col("id") % 100 == 0)


def op13_chebyshev_whitening(spark: SparkSession, root: str) -> DataFrame:
    return whitening.whiten(table(spark, root, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_boosted_pii": op1_boosted_pii,
    "op2_wrapper_text": op2_wrapper_text,
    "op3_licence_automaton": op3_licence_automaton,
    "op4_trie_bpe": op4_trie_bpe,
    "op5_language_svm": op5_language_svm,
    "op6_fm_decontamination": op6_fm_decontamination,
    "op7_warc_salvage": op7_warc_salvage,
    "op8_two_tier_counts": op8_two_tier_counts,
    "op9_minmax_dedup": op9_minmax_dedup,
    "op10_quality_ratio": op10_quality_ratio,
    "op11_stripe_collocations": op11_stripe_collocations,
    "op12_forest_neighbours": op12_forest_neighbours,
    "op13_chebyshev_whitening": op13_chebyshev_whitening,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9_SQL = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM worded
), spread AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM spread a JOIN spread b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
  SELECT u, v FROM both_ways UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON r.v = b.u
), lowest AS (
  SELECT u, min(v) AS low FROM reach GROUP BY u
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
FROM sets LEFT JOIN lowest ON doc_id = u
"""

OP6_SQL = rf"""
WITH worded AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS x
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)
), lengths AS (
  SELECT DISTINCT n FROM windows
), places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM worded, lengths WHERE len(w) >= n)
), found AS (
  SELECT doc_id, item_id, n, i FROM places JOIN windows USING (n, x)
), hits AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM worded LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP7_SQL = """
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> low THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> low THEN low END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d, min(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) AS low FROM pages)
"""

OP11_SQL = rf"""
WITH words AS (
  SELECT doc_id, p, coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT doc_id, lang, unnest(pieces) AS piece, unnest(range(len(pieces))) AS p
        FROM (SELECT row_number() OVER () AS doc_id, lang, string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]') AS pieces FROM documents))
), sizes AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang HAVING sum(len(w)) > 0
), places AS (
  SELECT lang, k, w[i:i + k - 1] AS x FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k)
), counts AS (
  SELECT lang, k, array_to_string(x, ' ') AS phrase, any_value(x) AS x, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 10
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, unnest(range(1, c.k)) AS cut, c.x FROM counts c WHERE c.k > 1
), scored AS (
  SELECT c.*, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score FROM cuts c
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.x[1:c.cut], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.x[c.cut + 1:c.k], ' ')
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
  SELECT lang, part, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(x[1:2], ' '), array_to_string(x[2:3], ' ')]) AS part FROM counts WHERE k = 3) GROUP BY ALL
), ranked AS (
  SELECT l.*, row_number() OVER (PARTITION BY l.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest l
  LEFT JOIN longer g ON g.lang = l.lang AND g.part = l.phrase AND l.k = 2 WHERE g.f IS NULL OR 100 * g.f < 50 * l.a
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

SQL: dict[str, str] = {"op11_stripe_collocations": OP11_SQL, "op6_fm_decontamination": OP6_SQL, "op7_warc_salvage": OP7_SQL, "op9_minmax_dedup": OP9_SQL}
