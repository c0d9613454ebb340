"""Bucketed order, exact quantiles and hot-key joins against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from souklens.functions.ordering import bucket_of, ntile_col, ordered, percent_rank_of, ranked
from souklens.functions.quantiles import exact_quantiles, quantile_values
from souklens.functions.skew import join_per_key


def data(n=3000, hot=0.35, nulls=0.05, seed=3):
    """(key, id, value): one key holds most rows, one value a third of them."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = "a" if rnd.random() < 0.6 else rnd.choice(["b", "c", None])
        u = rnd.random()
        v = None if u < nulls else 7.0 if u < nulls + hot else round(rnd.uniform(0, 50), 1)
        rows.append((k, i, v))
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(data(), "k string, id bigint, v double")


def sort_key(v, desc):
    """Missing values first going up, last going down."""
    return (0 if v is None else 1, v or 0.0) if not desc else (1 if v is None else 0, -(v or 0.0))


@pytest.mark.parametrize("small", [0, 10**9])
@pytest.mark.parametrize("desc", [False, True])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_ordered(frame, keys, desc, small):
    df = frame.withColumn("one", F.lit(1))
    got = ordered(df, "v", "id", keys, descending=desc, running={"cum": "v", "cnt": "one"}, small=small, buckets=16).collect()
    groups = {}
    for r in data():
        groups.setdefault(r[0] if keys else None, []).append(r)
    want = {}
    for rows in groups.values():
        rows.sort(key=lambda r: (*sort_key(r[2], desc), r[1]))
        run = 0.0
        for pos, (_, i, v) in enumerate(rows, 1):
            run += v or 0.0
            want[i] = (pos, len(rows), run, pos)
    assert len(got) == len(want)
    for r in got:
        pos, n, run, cnt = want[r["id"]]
        assert (r["pos"], r["n_rows"], r["cnt"]) == (pos, n, cnt)
        assert (r["cum"] or 0.0) == pytest.approx(run, abs=1e-6)


def test_ordered_small_inputs(spark):
    empty = spark.createDataFrame([], "id bigint, v double")
    assert ordered(empty, "v", "id", small=0).count() == 0
    one = spark.createDataFrame([(1, 5.0)], "id bigint, v double")
    assert ordered(one, "v", "id", small=0).first()["pos"] == 1


@pytest.mark.parametrize("tiles", [1, 4, 10, 7])
@pytest.mark.parametrize("n", [1, 3, 10, 23])
def test_ntile(spark, tiles, n):
    df = spark.createDataFrame([(i, float(i)) for i in range(n)], "id bigint, v double")
    got = [r[0] for r in ordered(df, "v", "id").orderBy("pos").select(ntile_col(tiles)).collect()]
    base, rem = divmod(n, tiles)
    want = [t + 1 for t in range(tiles) for _ in range(base + (1 if t < rem else 0))]
    assert got == want


@pytest.mark.parametrize("small", [0, 10**9])
@pytest.mark.parametrize("group", [0, 1000, 10**9])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_exact_quantiles(frame, keys, group, small):
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = exact_quantiles(frame, "v", probs, keys, small=small, group=group).collect()
    groups = {}
    for k, _, v in data():
        if v is not None:
            groups.setdefault(k if keys else None, []).append(v)
    assert len(got) == len(groups)
    for r in got:
        vals = groups[r["k"] if keys else None]
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(vals, p), abs=1e-9)


def test_quantile_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert quantile_values(df, "v", [0.5, 0.9]) == [None, None]


@pytest.mark.parametrize("group", [0, 10])
def test_weighted_quantile(spark, group):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (9.0, 2)], "v double, n bigint")
    r = exact_quantiles(df, "v", {"m": 0.5}, weight="n", small=0, group=group).first()
    assert r["m"] == np.median([1, 1, 1, 2, 9, 9])


@pytest.mark.parametrize("small", [0, 10**9])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_percent_rank(frame, keys, small):
    got = {r["id"]: r["pr"] for r in percent_rank_of(frame, "v", keys, "pr", small=small).collect()}
    groups = {}
    for r in data():
        groups.setdefault(r[0] if keys else None, []).append(r)
    for rows in groups.values():
        for _, i, v in rows:
            below = sum(sort_key(x[2], False) < sort_key(v, False) for x in rows)
            assert got[i] == pytest.approx(below / (len(rows) - 1) if len(rows) > 1 else 0.0)


def test_long_split_lists(spark):
    splits = [float(2 * i) for i in range(50)]
    vals = [None, -5.0, 0.0, 1.0, 33.0, 34.0, 97.0, 98.0, 99.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r[0] for r in df.select(bucket_of(F.col("v"), splits)).collect()]
    want = [-1 if v is None else 2 * sum(s < v for s in splits) + (v in splits) for v in vals]
    assert got == want


def test_bucketed_order_with_many_buckets(frame):
    got = {r["id"]: r["pos"] for r in ordered(frame, "v", "id", small=0, buckets=200).collect()}
    rows = sorted(data(), key=lambda r: (*sort_key(r[2], False), r[1]))
    assert got == {r[1]: pos for pos, r in enumerate(rows, 1)}


def test_buckets_follow_the_order(spark):
    df = spark.createDataFrame([(float(v),) for v in range(20)], "v double")
    b = [r[0] for r in df.orderBy("v").select(bucket_of(F.col("v"), [3.0, 3.5, 10.0])).collect()]
    assert b == sorted(b) and b[3] == 1 and b[10] == 5 and b[19] == 6


@pytest.mark.parametrize("hot", [1, 500, 10**9])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_per_key(frame, hot, how):
    per = frame.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top")).filter("k IS NULL OR k <> 'c'")
    got = join_per_key(frame, per, ["k"], "n", ["id"], how, hot=hot)
    assert got.columns == ["k", "id", "v", "top"]
    rows = {r["id"]: r for r in got.collect()}
    tops = {}
    for k, _, v in data():
        if k != "c" and v is not None:
            tops[k] = max(v, tops.get(k, v))
    want = [r for r in data() if how == "left" or r[0] != "c"]
    assert len(rows) == len(want) == got.count()
    assert all(rows[i]["top"] == tops.get(k) for k, i, _ in want)


@pytest.mark.parametrize("small", [0, 10**9])
def test_ranked_against_windows(spark, frame, small):
    """Several columns of different types, ties, missing values and a repeated tie-break, with and without cuts."""
    df = frame.withColumns({"w": F.col("id") % 7, "t": F.col("id") % 500})
    got = ranked(df, {"v": "pv", "w": "pw"}, ["t", "id"], {"ten": 10, "four": 4}, small=small)
    df.createOrReplaceTempView("ranked_rows")
    want = spark.sql("""SELECT *, percent_rank() OVER (ORDER BY v) AS pv, percent_rank() OVER (ORDER BY w) AS pw,
        ntile(10) OVER (ORDER BY v, t, id) AS ten, ntile(4) OVER (ORDER BY v, t, id) AS four FROM ranked_rows""")
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("small", [0, 10**9])
def test_ranked_of_few_rows(spark, small):
    none = spark.createDataFrame([], "id bigint, v double")
    assert ranked(none, {"v": "p"}, ["id"], {"q": 4}, small=small).collect() == []
    one = spark.createDataFrame([(None, None)], "id bigint, v double")
    assert [tuple(r) for r in ranked(one, {"v": "p"}, ["id"], {"q": 4}, small=small).collect()] == [(None, None, 0.0, 1)]
    same = spark.createDataFrame([(1, 2.0), (1, 2.0)], "id bigint, v double")
    assert sorted(tuple(r) for r in ranked(same, {"v": "p"}, ["id"], {"q": 2}, small=small).collect()) == [
        (1, 2.0, 0.0, 1), (1, 2.0, 0.0, 2)]
