"""Collocations by the stripes pattern.

Every prefix of one or two words keys a stripe: a counter of the words that follow it, with the end of
the piece as one of them. Tasks build the stripes of their texts, stripes of a prefix meet in one bucket
and are merged elementwise. A merged stripe holds all that the statistics need of its prefix: its sum is
the prefix's own count, its entries are the counts of the extended phrases, and its largest real entry is
the most frequent extension to the right.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souklens.functions.storage import materialise
from souklens.llm import textbytes as tb

UNDETERMINED = "und"
LEAST, PER_LANG, COVERED, PARTS = 10, 2000, 50, 32
#: Text for which there is one bucket at most; entries, and words, that a task holds before it sends them on.
BUCKET_BYTES, HELD, HELD_WORDS = 16 << 20, 600_000, 500_000

#: ``[.,;:!?\x0A-\x0D]`` end a piece, these and blanks a word.
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD = ~_STOP
_WORD[[32, 9]] = False

#: Codes that are no word: the second word of a prefix of one, and the end of a piece as what follows.
ONE, END = 0, 1
_BITS = 21  # three codes of so many bits are sorted as one integer


class Pool:
    """Words, each with its language, under dense codes; told apart by their bytes."""

    def __init__(self):
        self.codes: dict[bytes, int] = {b"": ONE, b"\n": END}

    def __len__(self) -> int:
        return len(self.codes)

    def add(self, words: list[bytes]) -> np.ndarray:
        codes = self.codes
        return np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)

    def words(self) -> list[bytes]:
        return list(self.codes)


class Stripes:
    """Merged stripes: entries (first word, second word or ``ONE``, what follows) in order of their prefix, and counts."""

    def __init__(self):
        self.pool = Pool()
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.fresh, self.rows = 0, 0

    def add(self, entries: np.ndarray, counts: np.ndarray) -> None:
        """Merges whenever as many entries are new as were merged before, so that no more than twice the result is held."""
        self.parts.append((entries, counts))
        self.fresh += len(counts)
        if self.fresh > max(self.rows, HELD // 4):
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """Elementwise sums."""
        if self.fresh:
            entries, counts = np.concatenate([e for e, _ in self.parts], axis=1), np.concatenate([n for _, n in self.parts])
            self.parts = []
            if len(self.pool) <= 1 << _BITS:
                key = packed(entries)
                order = np.argsort(key, kind="stable")
                key = key[order]
                other = key[1:] != key[:-1]
            else:
                order = np.lexsort(entries[::-1])
                other = (entries[:, order[1:]] != entries[:, order[:-1]]).any(axis=0)
            first = np.flatnonzero(np.concatenate([[True], other]))
            self.parts = [(entries[:, order[first]], np.add.reduceat(counts[order], first))]
            self.rows, self.fresh = len(first), 0
        return self.parts[0] if self.parts else (np.zeros((3, 0), np.int32), np.zeros(0, np.int64))


def packed(entries: np.ndarray) -> np.ndarray:
    key = entries[0].astype(np.int64)
    for row in entries[1:]:
        key <<= _BITS
        key |= row
    return key


def prefixes(entries: np.ndarray) -> np.ndarray:
    """Where the stripes begin."""
    return np.flatnonzero(np.concatenate([[True], (entries[:2, 1:] != entries[:2, :-1]).any(axis=0)])) if entries.shape[1] else np.zeros(0, np.int64)


def _small(values: np.ndarray) -> tuple[str, bytes]:
    """Numbers in the least wide type that holds them."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return kind.str, values.astype(kind).tobytes()


def pack(words: list[bytes], entries: np.ndarray, counts: np.ndarray) -> bytes:
    """Stripes as bytes: the words that they hold, each prefix once with the size of its stripe, what follows and counts.

    Entries are places in ``words``, sorted by prefix.
    """
    there = np.zeros(len(words), bool)
    there[entries] = True
    local = (np.cumsum(there) - 1)[entries]
    begin = prefixes(local)
    arrays = [_small(x) for x in (local[0, begin], local[1, begin], np.diff(np.append(begin, len(counts))), local[2], counts)]
    names = [words[i] for i in np.flatnonzero(there).tolist()]
    joined = b"\x00".join(names)
    return pickle.dumps((joined, None if joined.count(b"\x00") == len(names) - 1 else [len(w) for w in names], arrays), protocol=5)


def unpack(body: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words, entries as places in them, and counts."""
    joined, lengths, arrays = pickle.loads(body)
    first, second, sizes, follows, counts = [np.frombuffer(raw, kind).astype(np.int64) for kind, raw in arrays]
    if lengths is None:
        words = joined.split(b"\x00")
    else:  # a word holds the byte between words
        ends = (np.cumsum(lengths) + np.arange(len(lengths))).tolist()
        words = [joined[e - n:e] for e, n in zip(ends, lengths)]
    return words, np.stack([np.repeat(first, sizes), np.repeat(second, sizes), follows]), counts


def add_texts(held: Stripes, block: tb.Block, langs: pa.Array) -> None:
    """Adds the stripes of a block's texts."""
    data = tb.FOLD[block.data]
    solid = _WORD[data]
    starts, ends = tb.spans(solid, block.offsets)
    if not len(starts):
        return
    word, texts = tb.distinct(data, starts, ends)
    lang = langs.cast(pa.large_string()).cast(pa.large_binary()).dictionary_encode()
    owner, size = block.owner(starts), len(texts)
    both = lang.indices.to_numpy(zero_copy_only=False)[owner].astype(np.int64) * size + word
    used, at = np.unique(both, return_inverse=True)
    names = lang.dictionary.to_pylist()
    code = held.pool.add([texts[x % size] + b"\n" + names[x // size] for x in used.tolist()])[at]
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    inner = np.flatnonzero((stops[starts[1:]] == stops[starts[:-1]]) & (owner[1:] == owner[:-1]))  # words with a next one
    follows = np.full(len(code), END, np.int64)
    follows[inner] = code[inner + 1]
    one = np.stack([code, np.full(len(code), ONE), follows])
    two = np.stack([code[inner], code[inner + 1], follows[inner + 1]])
    entries = np.concatenate([one, two], axis=1).astype(np.int32)
    held.add(entries, np.ones(entries.shape[1], np.int64))


def bodies(held: Stripes, buckets: int) -> Iterator[pa.RecordBatch]:
    """``bucket, body``: whole stripes by a hash of their prefix, with the words that they hold, compressed."""
    entries, counts = held.merged()
    words = held.pool.words()
    order = sorted(range(len(words)), key=words.__getitem__)  # words in order compress better
    place = np.empty(len(words), np.int32)
    place[order] = np.arange(len(words), dtype=np.int32)
    entries, words = place[entries], [words[i] for i in order]
    hashes = tb.hash_words(words)
    bucket = (tb.mix(hashes[entries[0]] + tb.mix(hashes[entries[1]])) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort([entries[1], entries[0], bucket])
    bucket = bucket[order]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
    codec = pa.Codec("zstd", 3)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        body = pack(words, entries[:, order[a:b]], counts[order[a:b]])
        yield pa.RecordBatch.from_arrays([pa.array(bucket[a:a + 1]), pa.array([len(body)], pa.int64()), pa.array([codec.compress(body, asbytes=True)], pa.binary())], names=["bucket", "size", "body"])


def frequent(held: Stripes, least: int) -> pa.RecordBatch:
    """What merged stripes say of phrases with at least ``least`` occurrences, and how many words each language has.

    ``kind`` 1, 2, 3: phrases of so many words, ``f`` their count, ``head`` the count of the phrase without its
    last word; 0: the number of words of a language in ``f``.
    """
    entries, counts = held.merged()
    begin = prefixes(entries)
    sums = np.add.reduceat(counts, begin) if len(begin) else counts
    size = np.diff(np.append(begin, len(counts)))
    words = [w.partition(b"\n") for w in held.pool.words()]
    single = entries[1, begin] == ONE
    often = np.flatnonzero(single & (sums >= least))
    real = np.flatnonzero((counts >= least) & (entries[2] != END))
    head = np.repeat(sums, size)[real]
    rows = []
    sizes: dict[bytes, int] = {}
    for w, n in zip(entries[0, begin[single]].tolist(), sums[single].tolist()):
        sizes[words[w][2]] = sizes.get(words[w][2], 0) + n
    for lang, n in sizes.items():
        rows.append((0, lang, None, None, None, n, None))
    for w, n in zip(entries[0, begin[often]].tolist(), sums[often].tolist()):
        rows.append((1, words[w][2], words[w][0], None, None, n, None))
    for a, b, c, n, h in zip(*entries[:, real].tolist(), counts[real].tolist(), head.tolist()):
        if b == ONE:
            rows.append((2, words[a][2], words[a][0], words[c][0], None, n, h))
        else:
            rows.append((3, words[a][2], words[a][0], words[b][0], words[c][0], n, h))
    kinds = [pa.int32()] + [pa.binary()] * 4 + [pa.int64()] * 2
    columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([c.cast(pa.string()) if c.type == pa.binary() else c for c in columns], names=["kind", "lang", "w1", "w2", "w3", "f", "head"])


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> DataFrame:
    """``kind, lang, w1, w2, w3, f, head`` of all phrases of one to three words with ``least`` occurrences, see ``frequent``.

    One shuffle: bodies of stripes by the bucket of their prefix. A bucket is for about ``BUCKET_BYTES`` of text, so
    what one task merges does not grow with the corpus, and a frequent prefix comes as one stripe from each task.
    """
    tb.small_batches(docs.sparkSession)
    rows = docs.select(docs[text_col].cast("string").alias("t"), F.coalesce(docs[lang_col].cast("string"), F.lit(UNDETERMINED)).alias("lang")).filter("t <> ''")
    spark = docs.sparkSession
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / (8 * BUCKET_BYTES)))
    buckets = max(2 * partitions, math.ceil(total / BUCKET_BYTES))

    def build(batches):
        tb.give_back()
        held = Stripes()
        for batch in batches:
            if not batch.num_rows:
                continue
            for block in tb.blocks(batch.column(0)):
                add_texts(held, block, batch.column(1).slice(block.first, len(block)))
                if held.rows > HELD or len(held.pool) > HELD_WORDS:
                    yield from bodies(held, buckets)
                    held = Stripes()
        yield from bodies(held, buckets)
        tb.give_back()

    def merge(batches):
        bucket, held, codec = None, Stripes(), pa.Codec("zstd")
        for batch in batches:
            for at, size, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if at != bucket:
                    if bucket is not None:
                        yield frequent(held, least)
                    bucket, held = at, Stripes()
                words, entries, counts = unpack(codec.decompress(body.as_buffer(), size, asbytes=True))
                held.add(held.pool.add(words).astype(np.int32)[entries], counts)
        if bucket is not None:
            yield frequent(held, least)
        tb.give_back()

    made = rows.mapInArrow(build, "bucket int, size long, body binary").repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return made.mapInArrow(merge, "kind int, lang string, w1 string, w2 string, w3 string, f long, head long")


def _score(a, left, right):
    """floor(1000000 a a / (left right)), exact: products have up to 38 digits."""
    big = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (big(a) * big(a)), big(left) * big(right))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = PER_LANG, covered: int = COVERED) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of two or three words of each language.

    Texts are folded A-Z, cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at blanks and tabs into words. A phrase
    with ``a >= least`` occurrences is scored by its worst cut, floor(1000000 a a / (l r)) with the counts of both
    parts; of equal cuts that after fewer words counts. A phrase inside a longer one that has ``covered`` per cent of
    its occurrences or more is dropped. ``n`` is the number of all words of the language. Ranks go by score and a,
    falling, then by the phrase's bytes. A null language counts as ``und``, null and empty texts say nothing, repeated
    rows count as often as they stand there, and an empty table gives no rows. Counts are exact up to 10^15.
    """
    known = materialise(phrase_counts(docs, text_col, lang_col, least))
    words = known.filter("kind = 1").select("lang", F.col("w1").alias("w"), F.col("f").alias("fw"))
    sizes = known.filter("kind = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    pairs = known.filter("kind = 2").select("lang", "w1", "w2", "f", "head")
    triples = known.filter("kind = 3").select("lang", "w1", "w2", "w3", "f", "head")
    # the most frequent phrase around each pair: it extended to the right, or to the left
    around = triples.select("lang", "w1", "w2", "f").unionAll(triples.select("lang", "w2", "w3", "f")).groupBy("lang", "w1", "w2").agg(F.max("f").alias("longer"))
    second = words.withColumnsRenamed({"w": "w2", "fw": "r"})
    two = pairs.join(second, ["lang", "w2"]).join(around, ["lang", "w1", "w2"], "left")
    two = two.filter(F.coalesce(100 * F.col("longer") < covered * F.col("f"), F.lit(True)))
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"), F.col("head").alias("l"), "r", _score(F.col("f"), F.col("head"), F.col("r")).alias("score"))

    tail = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("r1"))
    ends = triples.join(tail, ["lang", "w2", "w3"]).join(words.withColumnsRenamed({"w": "w1", "fw": "l1"}), ["lang", "w1"]).join(words.withColumnsRenamed({"w": "w3", "fw": "r2"}), ["lang", "w3"])
    s1, s2 = _score(F.col("f"), F.col("l1"), F.col("r1")), _score(F.col("f"), F.col("head"), F.col("r2"))
    cut = F.when(F.col("s1") <= F.col("s2"), F.struct(F.col("l1").alias("l"), F.col("r1").alias("r"), F.col("s1").alias("score"))).otherwise(
        F.struct(F.col("head").alias("l"), F.col("r2").alias("r"), F.col("s2").alias("score")))
    three = ends.withColumns({"s1": s1, "s2": s2}).select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), cut.alias("cut")).select("lang", "phrase", "a", "cut.*")

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # the first ``top`` of each part of a language before those of the whole, so that no task reads more than ``PARTS * top`` rows of it
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = two.unionByName(three).withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top).drop("rank").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(F.broadcast(sizes) if _few(sizes) else sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _few(sizes: DataFrame, most: int = 100_000) -> bool:
    """Languages are broadcast up to this many (some MB)."""
    return sizes.limit(most + 1).count() <= most
