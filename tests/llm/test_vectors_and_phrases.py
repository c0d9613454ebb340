"""Phrases, neighbours and whitening against plain versions."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import brute
from souklens.llm import collocations, forest, queries, whitening
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


# -- 11


def plain_collocations(rows, least=10, top=2000, covered=50):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    by = defaultdict(list)
    for p, a in f.items():
        lang, w = p[0], p[1:]
        if len(w) == 1 or a < least:
            continue
        score, k = min((1_000_000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w)))
        by[lang].append((-score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    out = []
    for lang, found in by.items():
        longer = defaultdict(int)
        for _, a, phrase, _, _ in found:
            w = phrase.split(b" ")
            for part in ([w[:2], w[1:]] if len(w) == 3 else []):
                longer[b" ".join(part)] = max(longer[b" ".join(part)], -a)
        left = sorted(x for x in found if 100 * longer[x[2]] < covered * -x[1])
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(left[:top], 1)]
    return out


def phrases(df, **kw):
    return [tuple(r) for r in collocations.collocations(df, **kw).collect()]


@pytest.mark.parametrize("held", [2_000_000, 50])
def test_collocations(spark, small, edge, held, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", held)  # with 50 every block is sent on alone
    extra = [(None, "Ab c, ab c; AB\tc d.e f\x0bab c"), (None, "é🙂 ü é🙂 ü " * 12), ("und", "ab c " * 9), ("x y", "q  w e\n" * 11), ("", "q w " * 12)]
    df = small.select("lang", "text").unionByName(edge.select("lang", "text")).unionByName(spark.createDataFrame(extra, "lang string, text string"))
    rows = [tuple(r) for r in df.collect()]
    assert sorted(phrases(df)) == sorted(plain_collocations(rows))
    assert sorted(phrases(df, least=3, top=40)) == sorted(plain_collocations(rows, 3, 40))


def test_collocations_by_hand(spark):
    rows = [("en", "new york city. new york city! new york state, york")] * 5 + [(None, None), ("en", "")]
    got = phrases(spark.createDataFrame(rows, "lang string, text string"), least=5)
    # all phrases of two words lie within ones of three that have half of their occurrences or more
    assert got == [("en", 1, "new york city", 10, 15, 10, 50, 666666), ("en", 2, "new york state", 5, 15, 5, 50, 333333)]


def test_collocation_scores_are_exact(spark):
    rows = spark.createDataFrame([(999_999_999_937, 999_999_999_989, 999_999_999_961)], "a long, l long, r long")
    assert rows.select(collocations._score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 1_000_000 * 999_999_999_937**2 // (999_999_999_989 * 999_999_999_961)


def test_collocations_without_rows(none, edge):
    assert phrases(none) == []
    assert phrases(edge.limit(0)) == []


def test_codes_beyond_the_packed_range(monkeypatch):
    monkeypatch.setattr(collocations, "_BITS", 1)
    held = collocations.Stripes()
    rng = np.random.default_rng(1)
    held.pool.add([b"%d" % i for i in range(50)])
    entries = rng.integers(0, 50, (3, 4000)).astype(np.int32)
    held.add(entries, np.ones(4000, np.int64))
    got, n = held.merged()
    assert Counter({tuple(e): c for e, c in zip(got.T.tolist(), n.tolist())}) == Counter(map(tuple, entries.T.tolist()))


# -- 12


def usable(rows, zero):
    good = [(i, tuple(map(float, v))) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]
    d = max(Counter(len(v) for _, v in good).items(), key=lambda x: (x[1], x[0]), default=(0, 0))[0]
    return [(i, v) for i, v in good if len(v) == d]


def plain_neighbours(rows, asks, k=10):
    rows = sorted({(i, v) for i, v in usable(rows, False) if i is not None})
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = []
    for i, v in rows:
        if asks(i):
            d = np.sqrt(((x - np.array(v)) ** 2).sum(axis=1))
            found = [(d[j], int(ids[j])) for j in np.lexsort((ids, d)) if rows[j] != (i, v)][:k]
            out += [(i, rank, j, s) for rank, (s, j) in enumerate(found, 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "t", 1.0, 3) for i, v in rows], "vec_id long, embedding array<float>, label string, distance double, rank int")


def clusters(n, d=24, seed=2):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(12, d))[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, d))).astype(np.float32)
    return [(i, x[i].tolist()) for i in range(n)]


def neighbours(df, step=20, **kw):
    return sorted(tuple(r) for r in forest.neighbours(df, F.col("id") % step == 0, **kw).collect())


def test_forest_with_full_reach_is_exact(spark):
    rows = clusters(1500)
    assert neighbours(vectors(spark, rows), leaf_rows=16, reach=1.0) == plain_neighbours(rows, lambda i: i % 20 == 0)


def test_forest_recall_and_scores(spark):
    rows = clusters(3000)
    got, want = neighbours(vectors(spark, rows), leaf_rows=32), plain_neighbours(rows, lambda i: i % 20 == 0)
    found = {(q, j): s for q, _, j, s in got}
    hit = [(q, j) in found for q, _, j, _ in want]
    assert len(got) == len(want) and np.mean(hit) >= 0.9
    assert all(found[q, j] == s for q, _, j, s in want if (q, j) in found)
    x = dict(rows)
    assert all(s == np.sqrt(((np.array(x[q]) - np.array(x[j])) ** 2).sum()) for q, _, j, s in got)


def test_forest_bound_holds():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 10))
    made = forest.Forest(x, 800, leaf_rows=16)
    leaves = made.leaves(x)
    order = made.search(x[5], 0, math.inf)
    assert len(order) == len(set(order)) == 4 << made.depth and leaves[5, 0] in order[:4]
    near = ((x - x[5]) ** 2).sum(axis=1)
    for limit in (0.1, 0.5, 2.0):
        seen = set(made.search(x[5], 0, limit))
        assert all(set(leaves[i]) <= seen for i in np.flatnonzero(near <= limit))


def test_forest_ties_and_awkward_vectors(spark):
    rows = clusters(300, 6) + [(i, [1.0] * 6) for i in range(400, 700)] + [(40, [0.5] * 6), (40, [0.5] * 6), (60, [0.25] * 6), (60, [-0.25] * 6)]
    rows += [(1000, None), (1020, []), (1040, [0.0] * 6), (1060, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (1080, [NAN] * 6), (1100, [INF] * 6), (1120, [1.0, 2.0]), (None, [1.0] * 6),
             (1140, [-0.0, 0.0, 0.0, 1.0, 0.0, 0.0]), (1160, [0.0, -0.0, 0.0, 1.0, 0.0, 0.0])]
    df = vectors(spark, rows)
    want = plain_neighbours(rows, lambda i: i % 20 == 0)
    assert neighbours(df, leaf_rows=8, reach=1.0) == want
    # a point that is a third of all rows: equal distances go by the smaller id
    assert [r[2] for r in want if r[0] == 420] == [400, 401, 402, 403, 404, 405, 406, 407, 408, 409]


def test_forest_few_rows(spark):
    assert neighbours(vectors(spark, [])) == []
    assert neighbours(vectors(spark, [(0, [1.0, 2.0])])) == []
    assert neighbours(vectors(spark, [(0, [1.0, 2.0]), (7, [1.0, 5.0]), (9, [1.0, 2.0])])) == [(0, 1, 9, 0.0), (0, 2, 7, 3.0)]
    assert neighbours(vectors(spark, [(1, [1.0, 2.0]), (7, [1.0, 5.0])])) == []


def test_forest_query_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = {r[:3] for r in plain_neighbours(rows, lambda i: i % 100 == 0)}
    got = {tuple(r)[:3] for r in queries.op12_forest_neighbours(spark, "/root/testdata/sf0.01").collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)


# -- 13


def plain_whitening(rows, k=8):
    rows = usable(rows, True)
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in rows])
    n = len(x)
    sums = [sum(c) for c in x.T.tolist()]
    centred = np.array([[(n * c - s) / n for c, s in zip(r, sums)] for r in x.tolist()])
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1], turn[:, ::-1]
    k = int((values[:k] > 1e-12 * values[0]).sum())
    deviations = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x.tolist()]
    return [(i, dev) for (i, _), dev in zip(rows, deviations)], centred @ turn[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def holds(got, rows, k=8):
    """The rows of a result agree with the plain version, up to the sign of each component."""
    keys, want, explained = plain_whitening(rows, k)
    got = sorted((r for r in got), key=lambda r: (r["component"], r["vec_id"] is not None, r["vec_id"] or 0, r["deviation"], r["whitened"]))
    assert len(got) == want.size
    for c in range(want.shape[1]):
        part = [r for r in got if r["component"] == c + 1]
        mine = {(r["vec_id"], r["deviation"]): r["whitened"] for r in part}
        y = np.array([mine[key] for key in keys])
        assert np.allclose(y * np.sign(y @ want[:, c]), want[:, c], atol=1e-8)
        assert all(r["n"] == len(keys) and abs(r["explained"] / explained[c] - 1) < 1e-9 and r["identity_error"] < 1e-9 for r in part)


def test_whitening(spark):
    rows = clusters(700, 48)
    holds(whitening.whiten(vectors(spark, rows)).collect(), rows)


def test_whitening_by_filters(spark):
    """More dimensions than columns of the block, and a flat spectrum with one large direction."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 60)).astype(np.float32)
    x[:, 0] *= 30
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    holds(whitening.whiten(vectors(spark, rows)).collect(), rows)


def test_whitening_awkward_vectors(spark):
    rows = clusters(60, 5) + [(7, [1.0] * 5), (7, [1.0] * 5), (None, [0.0] * 5), (500, None), (501, []), (502, [None] * 5), (503, [NAN] * 5), (504, [INF, 1.0, 1.0, 1.0, 1.0]), (505, [1.0, 2.0])]
    holds(whitening.whiten(vectors(spark, rows)).collect(), rows)


def test_whitening_of_few_directions(spark):
    rows = [(i, [float(i), 2.0 * i, 3.0]) for i in range(9)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert {r["component"] for r in got} == {1}
    holds(got, rows)
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, None)]):
        assert whitening.whiten(vectors(spark, rows)).collect() == []


def test_whitening_of_large_numbers(spark):
    rows = [(i, [float((-1) ** i * i * 1e9), float(i % 3), 5.0]) for i in range(40)]
    got = whitening.whiten(vectors(spark, rows)).filter("component = 1").collect()
    want = dict(plain_whitening(rows)[0])
    assert all(r["deviation"] == (want[r["vec_id"]] if want[r["vec_id"]] < 1 << 63 else None) for r in got)
    huge = whitening.whiten(vectors(spark, [(1, [3e38, 1.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])])).collect()
    assert huge and all(math.isfinite(r["whitened"]) for r in huge)


def test_partial_sums_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rows = clusters(300, 6)
    holds(whitening.whiten(vectors(spark, rows).repartition(11)).collect(), rows)
