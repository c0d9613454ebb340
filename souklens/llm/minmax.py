"""Near duplicates of word shingles by min-max hashing.

Every permutation of the shingle hashes gives two signature values, the minimum and the maximum of
the set, so a signature of given length needs half the hash evaluations. The match of a minimum (or
maximum) of two sets is an unbiased estimate of their Jaccard similarity, and the two values of a
permutation are almost independent. Bands of ``rows`` values become bucket keys.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souklens.functions.storage import materialise
from souklens.llm import textbytes as tb
from souklens.llm.components import components

SHINGLE = 5
ROWS = 6
MISS = 1e-5
#: Ids of texts to be compared are broadcast up to this many (8 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_U = np.uint64


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands needed so that a pair just at the threshold shares none with a chance under ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def _constants(n: int, seed: int) -> np.ndarray:
    return tb.mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93) + _U(seed)) | _U(1)


_PLACES = _constants(SHINGLE, 11)


def _shingled(block: tb.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct shingles, one text after another: a code by their bytes, a hash, and the offsets between texts.

    Codes hold within the block, hashes everywhere. A text of one to four words has its whole word sequence as
    its only shingle.
    """
    data = tb.FOLD[block.data]
    starts, ends = tb.spans(tb.SOLID[data], block.offsets)
    words, distinct = tb.distinct(data, starts, ends)
    hashes = tb.hash_words(distinct)[words]
    first = np.searchsorted(starts, block.offsets)
    count = np.diff(first)
    # a shingle begins at each word that has four more behind it, or at the first word of a shorter text
    begins = np.concatenate([tb.ragged(np.maximum(count - SHINGLE + 1, 0), first[:-1]), first[:-1][(count > 0) & (count < SHINGLE)]])
    size = np.minimum(count[np.searchsorted(first, begins, side="right") - 1], SHINGLE)
    columns, rolled = [], size.astype(np.uint64)
    for j in range(SHINGLE):
        there = size > j
        at = np.minimum(begins + j, max(0, len(words) - 1))
        columns.append(np.where(there, words[at] + 1, 0))
        rolled += np.where(there, hashes[at] * _PLACES[j], _U(0))
    codes = tb.dense(columns)
    owner = np.searchsorted(first, begins, side="right") - 1
    once = np.unique(owner * (int(codes.max(initial=0)) + 1) + codes, return_index=True)[1]
    return codes[once], tb.mix(rolled[once]), np.searchsorted(owner[once], np.arange(len(block) + 1))


def shingle_sets(block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, one text after another, and the offsets between texts."""
    _, hashes, offsets = _shingled(block)
    return hashes, offsets


def signatures(docs: DataFrame, id_col: str, text_col: str, percent: int, rows: int = ROWS) -> DataFrame:
    """Per text: id, n_shingles, a 128-bit digest of the set (s1, s2) and its band keys.

    A null or wordless text has size 0, digest 0 and no keys.
    """
    bands = bands_for(percent, rows)
    turns = _constants(math.ceil(bands * rows / 2), 23)
    within, salts = _constants(rows, 37), _constants(bands, 41)

    def work(block: tb.Block) -> dict:
        flat, off = shingle_sets(block)
        sizes = np.diff(off)
        full = np.flatnonzero(sizes)
        at = off[:-1][full]
        s1, s2 = np.zeros(len(block), np.uint64), np.zeros(len(block), np.uint64)
        keys = np.zeros((len(full), bands), np.uint64)
        if len(full):
            s1[full], s2[full] = np.add.reduceat(flat, at), np.add.reduceat(tb.mix(flat ^ _U(0xA5A5A5A5A5A5A5A5)), at)
            value = 0
            turned = np.empty_like(flat)
            for turn in turns:
                np.multiply(flat, turn, out=turned)
                for pick in (np.minimum, np.maximum):
                    if value < bands * rows:
                        keys[:, value // rows] += pick.reduceat(turned, at) * within[value % rows]
                        value += 1
            keys = tb.mix(keys + salts)
        lengths = np.zeros(len(block) + 1, np.int32)
        lengths[full + 1] = bands
        lists = pa.ListArray.from_arrays(np.cumsum(lengths, dtype=np.int32), pa.array(keys.reshape(-1).view(np.int64)))
        return {"n_shingles": sizes, "s1": s1.view(np.int64), "s2": s2.view(np.int64), "keys": lists}

    return tb.map_texts(docs, text_col, [id_col], "n_shingles long, s1 long, s2 long, keys array<long>", work)


def confirm(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets reach the threshold, as links ``(u, v)``."""
    ids = materialise(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct())
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).filter("id IS NOT NULL")
    few = ids.count() <= BROADCAST_IDS
    tb.small_batches(docs.sparkSession)
    texts = texts.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    rows = pairs.join(texts.withColumnsRenamed({"id": "b", "text": "text_b"}), "b").join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a")

    def check(batches):
        tb.give_back()
        for batch in batches:
            for part in _parts(batch):
                ids, texts = [part.column(i).to_pylist() for i in (0, 1)], [part.column(i).cast(pa.large_string()) for i in (2, 3)]
                # a pivot stands in many rows, one after another: its set is made once
                fresh = [i for i in range(part.num_rows) if not i or ids[0][i] != ids[0][i - 1] or texts[0][i] != texts[0][i - 1]]
                which = np.searchsorted(np.array(fresh), np.arange(part.num_rows), side="right") - 1
                # one block, so that codes hold for both sides
                block = next(tb.blocks(pa.concat_arrays([texts[0].take(pa.array(fresh)), texts[1]]), limit=1 << 62))
                codes, _, off = _shingled(block)
                sets = [codes[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                good = []
                for i, right in enumerate(sets[len(fresh):]):
                    left = sets[which[i]]
                    common = _common(left, right)
                    good.append(100 * common >= percent * (len(left) + len(right) - common))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, g in zip(side, good) if g], pa.int64()) for side in ids], names=["u", "v"])
        tb.give_back()

    return rows.select("a", "b", "text_a", "text_b").mapInArrow(check, "u long, v long")


def _parts(batch: pa.RecordBatch):
    """A batch of pairs, in parts that hold about a block of text, or a single pair."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for i in (2, 3):
        sizes += np.asarray(pc.fill_null(pc.binary_length(batch.column(i)), 0))
    ends, a = np.cumsum(sizes), 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + tb.BLOCK_BYTES, side="right")))
        yield batch.slice(a, b - a)
        a = b


def _common(left: np.ndarray, right: np.ndarray) -> int:
    if len(left) > len(right):
        left, right = right, left
    at = np.searchsorted(right, left)
    at[at == len(right)] = 0
    return int((right[at] == left).sum()) if len(right) else 0


def _near(percent: int):
    """Sizes that can reach the threshold at all."""
    return (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, rows: int = ROWS) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for every row of ``docs``.

    Two texts are linked if ``100 * |A & B| >= percent * |A | B|`` for their sets of 5-word shingles;
    a component is named by its smallest id, whose row is kept.

    1. Rows of equal sets form a class under their smallest id (a grouping, combined before the shuffle).
    2. In every bucket of band keys each class is compared with the bucket's smallest one, on full sets.
    3. Links become components. Members of buckets that still hold several components are compared
       across components too, wherever a prefix filter on their full sets leaves the chance of a link.

    Texts that are null, empty or without words have no shingles and are linked with nothing. Ids have
    to be integers; rows with a null id are compared with nothing and kept. Rows that share an id
    are one node: linked if any of their texts is. Repeated rows are returned as often as given.
    """
    ids = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    signed = materialise(signatures(ids, "id", "text", percent, rows))
    full = signed.filter("n_shingles > 0 AND id IS NOT NULL")
    classes = materialise(full.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.max("n_shingles").alias("n"), F.any_value("keys").alias("keys")))

    placed = classes.select("rep", "n", F.explode("keys").alias("key"))
    heads = placed.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("head"), F.count("*").alias("members")).filter("members > 1")
    buckets = materialise(placed.join(heads, "key").select("key", "members", "rep", "n", F.col("head.rep").alias("pivot"), F.col("head.n").alias("pivot_n")))
    stars = buckets.filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b"), F.col("pivot_n").alias("n_a"), F.col("n").alias("n_b"))
    stars = materialise(stars.filter(_near(percent)).select("a", "b").distinct())
    links = materialise(confirm(stars, ids, "id", "text", percent))
    parts = components(links)

    rest = _rest(buckets, parts, ids, percent)
    if rest is not None:
        rest = materialise(rest.join(stars, ["a", "b"], "left_anti"))
        more = materialise(confirm(rest, ids, "id", "text", percent))
        if not more.isEmpty():
            parts = components(links.unionAll(more))

    # rows to classes, classes to components
    named = classes.join(parts, classes["rep"] == parts["node"], "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    columns = [F.col("id").alias(id_col), F.col("n_shingles"), F.col("component").alias("component_id"),
               F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept")]
    linked = full.join(named, ["s1", "s2"]).select(columns)
    alone = signed.filter("n_shingles = 0 OR id IS NULL").withColumn("component", F.col("id")).select(columns)
    return linked.unionAll(alone)


def _rest(buckets: DataFrame, parts: DataFrame, ids: DataFrame, percent: int) -> DataFrame | None:
    """Pairs in different components that may still be linked, among members of buckets of several components.

    A prefix filter: with shingles in order of rarity among these members, two linked sets share one
    of their ``n - ceil(n * percent / 100) + 1`` first shingles, at places that leave room for enough
    common ones. Mass passages are common and so come last; groups that are one component are left out.
    """
    named = parts.withColumnRenamed("node", "rep")
    # two members: their only pair has been compared
    live = buckets.filter("members > 2").select("key", "rep", "n").join(named, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    members = materialise(_open(live).select("rep", "n", "component").distinct())
    count = members.count()
    if not count:
        return None
    near = F.broadcast(members) if count <= BROADCAST_IDS // 4 else members
    texts = ids.filter("id IS NOT NULL").join(near, ids["id"] == members["rep"]).select("rep", "n", "component", "text")

    def spread(batches):
        for batch in batches:
            for block in tb.blocks(batch.column(3)):
                flat, off = shingle_sets(block)
                at = pa.array(np.repeat(np.arange(block.first, block.first + len(block)), np.diff(off)))
                yield pa.RecordBatch.from_arrays([batch.column(i).take(at) for i in range(3)] + [pa.array(flat.view(np.int64))], names=["rep", "n", "component", "shingle"])
        tb.give_back()

    shingles = materialise(texts.mapInArrow(spread, "rep long, n long, component long, shingle long"))
    rarity = shingles.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
    order = Window.partitionBy("rep").orderBy(F.coalesce("df", F.lit(1)), "shingle")
    placed = shingles.join(rarity, "shingle", "left").withColumn("place", F.row_number().over(order))
    first = placed.filter((F.col("df") > 1) & (F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1))
    first = materialise(first.select(F.col("shingle").alias("key"), "rep", "n", "component", "place"))
    first = _open(first)
    left = first.select("key", F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("c"), F.col("place").alias("i"))
    right = first.select("key", F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("d"), F.col("place").alias("j"))
    room = (100 + percent) * (1 + F.least(F.col("n_a") - F.col("i"), F.col("n_b") - F.col("j"))) >= percent * (F.col("n_a") + F.col("n_b"))
    return left.join(right, "key").filter((F.col("a") < F.col("b")) & (F.col("c") != F.col("d")) & _near(percent) & room).select("a", "b").distinct()


def _open(live: DataFrame) -> DataFrame:
    """Rows of the keys that hold more than one component."""
    mixed = live.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    return live.join(mixed, "key")
