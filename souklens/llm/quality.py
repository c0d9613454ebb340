"""Quality rules, and a log-likelihood ratio of hashed n-grams between trusted and raw text.

Two multinomials over hashed word unigrams and bigrams are counted over the whole corpus: of the
trusted documents and of all. A text's score is the mean, over its n-grams, of the logarithm of the
ratio of both; each n-gram is left out of the counts once for its own sake. A text is kept if it
passes the rules and its score is not under the threshold, which lies below ``RECALL`` of the trusted texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souklens.functions.storage import materialise
from souklens.llm import textbytes as tb

BUCKET_BITS = 16
#: Added to each bucket's count, so that unseen n-grams say nothing.
SMOOTHING = 1.0
#: Share of trusted texts above the threshold's quantile, and the texts that lie below it at least, if they
#: are at most a tenth, so that no single label decides; slack below it, as a share of its distance from
#: their median, for good texts that no label covers; scores are compared on a grid of this step.
RECALL, LEAST_BELOW, SLACK, GRID = 0.98, 2, 0.75, 1 / 1024
#: Trusted ids are broadcast up to this many (8 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_PLACES = tb.mix(np.arange(1, 4, dtype=np.uint64)) | np.uint64(1)


def _words(block: tb.Block):
    """Starts of words, a code of each by its bytes, its hash, and the first word of each text."""
    starts, ends = tb.spans(tb.SOLID[block.data], block.offsets)
    codes, words = tb.distinct(block.data, starts, ends)
    return starts, codes, tb.hash_words(words)[codes], np.searchsorted(starts, block.offsets)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def rules(block: tb.Block, words: np.ndarray, first: np.ndarray) -> dict:
    """The countable properties of each text of a block."""
    data, offsets = block.data, block.offsets
    n_words = np.diff(first)
    solid = tb.SOLID[data]
    # lines with a word, and how many differ
    edges = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    low = edges[:-1]
    high = edges[1:] - (data[edges[1:] - 1] == 10)
    filled = np.concatenate([[0], np.cumsum(solid)])
    real = filled[high] > filled[low]
    low, high = low[real], high[real]
    owner = block.owner(low)
    lines = np.bincount(owner, minlength=len(block))
    different = np.unique(owner * (len(low) + 1) + tb.distinct(data, low, high)[0])
    n_dup = lines - np.bincount(different // (len(low) + 1), minlength=len(block))
    # words of 3-word windows that stand in the text more than once
    repeated = np.zeros(len(words), bool)
    if len(words) >= 3:
        doc = np.searchsorted(first, np.arange(len(words) - 2), side="right") - 1
        inside = np.flatnonzero(np.arange(len(words) - 2) + 3 <= first[doc + 1])
        window = tb.dense([doc[inside], words[inside], words[inside + 1], words[inside + 2]])
        twice = np.bincount(window)[window] > 1
        at = inside[twice]
        for j in range(3):
            repeated[at + j] = True
    return {"n_words": n_words, "word_chars": _per_text(solid & ((data & 0xC0) != 0x80), offsets), "n_symbols": _per_text(_SYMBOL[data], offsets),
            "n_dup_lines": n_dup, "n_repeat_words": _per_text(repeated, first)}


def ngram_buckets(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word and of every pair of neighbours; no pair (the bucket past the last) where a text ends."""
    shift = np.uint64(64 - BUCKET_BITS)
    ones = (words >> shift).astype(np.int64)
    twos = np.full(len(words), 1 << BUCKET_BITS, np.int64)
    if len(words) > 1:
        twos[:-1] = (tb.mix(words[:-1] * _PLACES[0] + words[1:] * _PLACES[1]) >> shift).astype(np.int64)
    ends = first[1:] - 1
    twos[ends[ends >= 0]] = 1 << BUCKET_BITS
    return ones, twos


def with_trust(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, trusted``: whether any label row gives the id quality 1."""
    good = materialise(labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("good_id")).distinct())
    few = good.count() <= BROADCAST_IDS
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.join(F.broadcast(good) if few else good, F.col("id") == F.col("good_id"), "left").select("id", "text", F.col("good_id").isNotNull().alias("trusted"))


def count_ngrams(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket over all texts and over the trusted ones.

    Each task adds up its own counts; one row per task and bucket at most is shuffled.
    """
    size = 1 << BUCKET_BITS

    def run(batches):
        total, trusted = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            flags = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for block in tb.blocks(batch.column(0)):
                _, _, hashes, first = _words(block)
                ones, twos = ngram_buckets(hashes, first)
                total += np.bincount(ones, minlength=size + 1)[:size] + np.bincount(twos, minlength=size + 1)[:size]
                own = np.repeat(flags[block.first:block.first + len(block)], np.diff(first))
                trusted += np.bincount(ones[own], minlength=size + 1)[:size] + np.bincount(twos[own], minlength=size + 1)[:size]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen]), pa.array(trusted[seen])], names=["bucket", "n", "t"])

    counted = rows.select("text", "trusted").mapInArrow(run, "bucket long, n long, t long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    total, trusted = np.zeros(size, np.float64), np.zeros(size, np.float64)
    for r in counted.collect():  # a row per bucket
        total[r["bucket"]], trusted[r["bucket"]] = r["n"], r["t"]
    return total, trusted


def log_ratios(total: np.ndarray, trusted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log ratio by bucket for texts outside and inside the trusted set, each without one own occurrence."""
    share = trusted.sum() / max(1.0, total.sum())
    if not share:
        return np.zeros(len(total) + 1), np.zeros(len(total) + 1)
    raw = np.log(np.maximum(total - 1, 0) + SMOOTHING)
    outside = np.log(trusted / share + SMOOTHING) - raw
    inside = np.log(np.maximum(trusted - 1, 0) / share + SMOOTHING) - raw
    return np.append(outside, 0.0), np.append(inside, 0.0)


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """Per row: id, the counts of ``rules``, ``base_failed``, ``score``, ``threshold`` and ``kept``.

    ``base_failed``: under 50 words, or more than half of the words in repeated 3-word windows. A null
    or empty text has no words, score 0 and fails. With no trusted text every score is 0 and the
    rules alone decide. Rows stay as given; a null id is not trusted.
    """
    rows = with_trust(docs, labels, id_col, text_col)
    outside, inside = log_ratios(*count_ngrams(rows))
    ratios = docs.sparkSession.sparkContext.broadcast((outside.astype(np.float32), inside.astype(np.float32)))

    def work(block: tb.Block, used: list) -> dict:
        _, words, hashes, first = _words(block)
        out = rules(block, words, first)
        ones, twos = ngram_buckets(hashes, first)
        trusted = used[0].to_numpy(zero_copy_only=False).astype(bool)
        own = np.repeat(trusted, out["n_words"])
        each = [np.where(own, ratios.value[1][b], ratios.value[0][b]) for b in (ones, twos)]
        total = np.diff(np.concatenate([[0.0], np.cumsum(each[0].astype(np.float64) + each[1])])[first])
        grams = np.maximum(1, 2 * out["n_words"] - 1)
        # on the grid, so that the order of additions can't move a text across the threshold
        out["score"] = np.round(total / grams / GRID) * GRID
        return out

    schema = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"
    made = tb.map_texts(rows, "text", ["id", "trusted"], schema, work, ["trusted"])
    made = materialise(made.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))
    low = threshold(made, recall)
    kept = ~F.col("base_failed") & (F.col("score") >= low)
    return made.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", F.lit(low).alias("threshold"), kept.alias("kept"))


def threshold(made: DataFrame, recall: float) -> float:
    """Of the trusted texts that pass the rules: the largest grid value that ``recall`` of them reach, or all but ``LEAST_BELOW``, less the slack."""
    counts = made.filter("trusted AND NOT base_failed").groupBy("score").count().collect()  # scores are grid values within a few units of 0
    if not counts:
        return -math.inf

    total = sum(r["count"] for r in counts)
    below = min(LEAST_BELOW, (total - 1) // 10)

    def reached_by(share: float) -> float:
        left = min(math.ceil(share * total), total - below)
        for r in sorted(counts, key=lambda r: -r["score"]):
            left -= r["count"]
            if left <= 0:
                return r["score"]

    low = reached_by(recall)
    return low - SLACK * (reached_by(0.5) - low)
