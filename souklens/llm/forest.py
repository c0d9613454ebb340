"""Nearest neighbours by a forest of random-projection trees.

Every tree has orthonormal random directions, one for each level, and splits at medians of a bounded
sample; all rows are then put into its leaves. A query goes through all trees with one priority queue
of branches. Directions of a tree are orthogonal, so the squared margins on the way to a branch add up
to a lower bound of the squared distance to anything below it: that is the queue's key. Rows of the
leaves that are visited are ranked again by exact distances.

The search runs in two rounds. The first visits the ``FIRST`` nearest leaves, which gives each query
the distance of its k-th neighbour so far; the second visits every leaf whose bound is under
``REACH`` times that distance. So near neighbours in clustered vectors take few leaves and vectors
without structure many, at every size alike; with ``reach=1`` the search is exact.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souklens.functions.storage import materialise
from souklens.llm.textbytes import small_batches
from souklens.llm.vectors import matrix, usable

#: Trees; rows of a leaf as meant; rows of the sample that trees are fitted on, at least so many in a leaf.
TREES, LEAF_ROWS, SAMPLE_ROWS, SAMPLE_LEAF = 4, 256, 16_384, 8
#: Leaves of the first round; share of the k-th distance found there that a leaf's bound may have in the second.
FIRST, REACH = 8, 0.17
#: Rows of a leaf, and queries at a leaf, that are worked on at once; a fuller leaf is cut into pieces.
PIECE_ROWS, PIECE_QUERIES = 2048, 512


class Forest:
    """Directions (d, depth) and, per level, thresholds of each tree."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 5):
        d = sample.shape[1]
        wanted = min(rows / leaf_rows, len(sample) / SAMPLE_LEAF)
        self.depth = min(d, max(0, math.ceil(math.log2(wanted)))) if wanted > 1 else 0
        rng = np.random.default_rng(seed)
        self.directions, self.thresholds = [], []
        for _ in range(trees):
            turn = np.linalg.qr(rng.normal(size=(d, max(1, self.depth))))[0]
            at, levels = np.zeros(len(sample), np.int64), []
            for level in range(self.depth):
                p = sample @ turn[:, level]
                cuts = np.zeros(1 << level)
                order = np.lexsort((p, at))
                edges = np.searchsorted(at[order], np.arange((1 << level) + 1))
                for node, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                    cuts[node] = p[order[(a + b) // 2]] if b > a else 0.0
                levels.append(cuts)
                at = 2 * at + (p >= cuts[at])
            self.directions.append(turn)
            self.thresholds.append(levels)

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point in each tree, numbered through all trees."""
        out = np.zeros((len(points), len(self.directions)), np.int64)
        for t, (turn, levels) in enumerate(zip(self.directions, self.thresholds)):
            p, at = points @ turn, np.zeros(len(points), np.int64)
            for level, cuts in enumerate(levels):
                at = 2 * at + (p[:, level] >= cuts[at])
            out[:, t] = at + (t << self.depth)
        return out

    def search(self, point: np.ndarray, first: int, most: float) -> list[int]:
        """Leaves in order of their bounds: the ``first`` ones, then all with a bound of at most ``most``."""
        spots = [(point @ turn).tolist() for turn in self.directions]
        # a branch: bound on the squared distance, tree, level, node
        queue = [(0.0, t, 0, 0) for t in range(len(spots))]
        out = []
        while queue:
            bound, t, level, node = heapq.heappop(queue)
            if len(out) >= first and bound > most:
                break
            while level < self.depth:  # down the near side; the far sides wait
                margin = spots[t][level] - self.thresholds[t][level][node]
                near = 2 * node + (margin >= 0)
                far = bound + margin * margin
                if len(out) < first or far <= most:
                    heapq.heappush(queue, (far, t, level + 1, near ^ 1))
                level, node = level + 1, near
            out.append((t << self.depth) + node)
        return out


def _pieces(rows: DataFrame, size: int) -> DataFrame:
    """``leaf, piece`` groups of about ``size`` rows at most: a leaf is cut into as many pieces as its count asks for."""
    counts = materialise(rows.groupBy("leaf").agg(F.ceil(F.count("*") / size).alias("pieces")))
    fuller = F.broadcast(counts.filter("pieces > 1"))  # a row per leaf at most: trees * sample rows / 8
    return rows.join(fuller, "leaf", "left").withColumn("piece", F.pmod(F.xxhash64("rep"), F.coalesce("pieces", F.lit(1))))


def _route(rows: DataFrame, shared, d: int) -> DataFrame:
    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            leaves = shared.value.leaves(matrix(batch.column(1), d))
            at = pa.array(np.repeat(np.arange(batch.num_rows), leaves.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(i).take(at) for i in range(3)] + [pa.array(leaves.reshape(-1))], names=["rep", "v", "low", "leaf"])

    return rows.select("rep", "v", "low").mapInArrow(work, "rep long, v array<double>, low long, leaf long")


def _visits(queries: DataFrame, shared, d: int, first: int, reach: float | None) -> DataFrame:
    """``rep, v, most, leaf``: the leaves that each query visits.

    ``most`` is the k-th distance known so far. Without ``reach`` only the ``first`` leaves are visited;
    with it also those with a bound under ``reach * most``, all if no such distance is known.
    """

    def work(batches):
        forest = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            limits = [-1.0 if reach is None else math.inf if m is None else (reach * m) ** 2 for m in batch.column(2).to_pylist()]
            found = [forest.search(point, first, limit) for point, limit in zip(matrix(batch.column(1), d), limits)]
            at = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([batch.column(i).take(at) for i in range(3)] + [pa.array([y for x in found for y in x], pa.int64())], names=["rep", "v", "most", "leaf"])

    return queries.select("rep", "v", "most").mapInArrow(work, "rep long, v array<double>, most double, leaf long")


def _rerank(leaves: DataFrame, visits: DataFrame, d: int, k: int) -> DataFrame:
    """``query, rep, low, distance``: of each visited piece of a leaf the query's ``k`` nearest rows under ``most``, by exact distances."""
    asked = _pieces(visits, PIECE_QUERIES).groupBy("leaf", F.col("piece").alias("of")).agg(F.collect_list(F.struct("rep", "v", "most")).alias("queries"))
    # never by broadcast: Spark would take the visits for as small as the queries that they come from
    pairs = leaves.join(asked.hint("merge"), "leaf").select("rows", "queries")

    def work(batches):
        for batch in batches:
            for rows, queries in zip(batch.column(0), batch.column(1)):
                a, b = rows.values, queries.values
                x, q = matrix(a.field("v"), d), matrix(b.field("v"), d)
                reps, lows = a.field("rep").to_numpy(), a.field("low").to_numpy()
                asking, most = b.field("rep").to_numpy(), b.field("most").to_numpy(zero_copy_only=False)
                norm = (x * x).sum(axis=1)
                rough = norm - 2 * (q @ x.T) + (q * q).sum(axis=1)[:, None]
                # rounding of the expanded form; far under any gap that matters, and only more rows are looked at
                slack = 1e-12 * d * (norm.max() + (q * q).sum(axis=1)) + 1e-300
                limit = np.where(np.isnan(most), np.inf, most * most)
                if len(reps) > k:
                    limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1])
                i, j = np.nonzero(rough <= (limit + 2 * slack)[:, None])
                distance = np.sqrt(((q[i] - x[j]) ** 2).sum(axis=1))
                order = np.lexsort((lows[j], distance, i))
                i, j, distance = i[order], j[order], distance[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                good = place < k
                yield pa.RecordBatch.from_arrays([pa.array(asking[i[good]]), pa.array(reps[j[good]]), pa.array(lows[j[good]]), pa.array(distance[good])], names=["query", "rep", "low", "distance"])

    return pairs.mapInArrow(work, "query long, rep long, low long, distance double")


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each query, every candidate once."""
    once = found.groupBy("query", "rep").agg(F.min("distance").alias("distance"), F.min("low").alias("low"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("distance", "low", "rep"))).filter(F.col("place") <= k)


def neighbours(rows: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, trees: int = TREES,
               leaf_rows: int = LEAF_ROWS, first: int = FIRST, reach: float = REACH) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of every row with ``is_query``, by Euclidean distance.

    ``is_query`` is a condition on the column ``id``. Candidates are all rows but the query's
    own; fewer than ``k`` candidates are all returned; equal distances go by the smaller id. Vectors
    that are null, empty, zero or hold null or non-finite entries take no part, nor do those of another
    than the most frequent length and rows with a null id. Rows that repeat id and vector are one row; an
    id with several vectors is as many rows and queries. Equal vectors are one point of the search, with the
    ``k + 1`` smallest ids, which is all that any answer can need. Other columns are ignored. Ids are integers.
    """
    session, n_ids = rows.sparkSession, k + 1
    small_batches(session)
    picked, d = usable(rows, id_col, vector_col, zero=False)
    empty = session.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not d:
        return empty
    # 0.0 and -0.0 are one value of a key
    picked = picked.filter("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    first_ids = Window.partitionBy("v").orderBy("id")
    once = picked.withColumn("step", F.dense_rank().over(first_ids)).filter(F.col("step") <= n_ids)
    points = once.groupBy("v").agg(F.min("id").alias("low"), F.array_sort(F.collect_set("id")).alias("ids"))
    points = materialise(points.withColumn("rep", F.monotonically_increasing_id()))  # numbers hold once they are written
    n = points.count()
    if not n:
        return empty
    # a share of all points by a hash of theirs: SAMPLE_ROWS, give or take a few per cent
    part = F.pmod(F.xxhash64("v", F.lit(17)), F.lit(1 << 31)) < int(min(1.0, SAMPLE_ROWS / n) * (1 << 31))
    sample = points.filter(part).select("v").toArrow()["v"].combine_chunks()
    shared = session.sparkContext.broadcast(Forest(matrix(sample, d), n, trees, leaf_rows))
    leaves = _pieces(_route(points, shared, d), PIECE_ROWS).groupBy("leaf", "piece").agg(F.collect_list(F.struct("rep", "low", "v")).alias("rows"))
    leaves = materialise(leaves)

    asking = materialise(picked.filter(is_query).distinct().join(points.select("rep", "v"), "v").select("id", "rep"))
    queries = points.join(asking.select("rep").distinct(), "rep", "left_semi").select("rep", "v")
    near = materialise(_rerank(leaves, _visits(queries.withColumn("most", F.lit(None).cast("double")), shared, d, first, None), d, n_ids))
    known = _nearest(near, n_ids).groupBy("query").agg(F.when(F.count("*") >= n_ids, F.max("distance")).alias("most"))
    again = materialise(queries.join(known, queries["rep"] == known["query"]).select("rep", "v", "most"))
    found = near.unionAll(_rerank(leaves, _visits(again, shared, d, first, reach), d, n_ids))
    best = materialise(_nearest(found, n_ids))
    # points to ids: of equal distances the smaller id first
    named = best.join(points.select("rep", "ids"), "rep").select("query", "rep", "distance", F.explode("ids").alias("id"))
    lists = named.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "id", "rep"))), 1, n_ids).alias("found"))
    own = asking.join(lists, asking["rep"] == lists["query"])
    others = F.filter("found", lambda x: (x["id"] != F.col("id")) | (x["rep"] != F.col("query")))
    out = own.select(F.col("id").alias("query_id"), F.slice(others, 1, k).alias("found")).select("query_id", F.posexplode("found").alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.distance").alias("score"))
