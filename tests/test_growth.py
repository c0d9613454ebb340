"""Steps whose shuffles grow no faster than their input, against brute force and by their plans."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from souklens.functions import quantiles, skew
from souklens.functions.quantiles import exact_quantiles, is_after, rows_at
from souklens.operators import benchmarks, configs, lift, ranking
from souklens.plans import benchmark_plans as bp
from souklens.plans import feature_plans as fp
from souklens.plans import stages
from souklens.sources import marketplace as mp

ROWS = [(i, random.Random(i).choice([None, -3.5, 0.0, 0.25, 2.0, 1e9]) if i % 3 else i * 0.37) for i in range(600)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, i % 7, v) for i, v in ROWS], "id bigint, k bigint, v double").cache()


def test_few_rows_go_on_to_quantiles(spark):
    """Only rows of cells with a wanted rank are ordered."""
    df = spark.range(50_000).select((F.col("id") * 0.5 + 1).alias("v"))
    left = quantiles._narrowed(df, "v", [lambda n: 0.5 * (n - 1)], [])
    assert 0 < left.count() < 2_500
    got = exact_quantiles(df, "v", {"m": 0.5}, group=10).first()["m"]
    assert got == 1 + 0.5 * 49_999 / 2


@pytest.mark.parametrize("small", [1_000_000, 10])
def test_quantiles_cut_twice(spark, monkeypatch, small):
    monkeypatch.setattr(quantiles, "SMALL", small)
    values = [float("-inf"), -1e300, -2.0, -2.0, 0.0, 5.0, 5.0, 5.5, 1e300, float("inf")] + [100.0 + i * 1e-9 for i in range(200)]
    df = spark.createDataFrame([(v, 1) for v in values] + [(v, 2) for v in values[2:8]], "v double, k int")
    got = {r["k"]: r["m"] for r in exact_quantiles(df, "v", {"m": 0.5}, ["k"], group=3).collect()}
    s = sorted(values)
    assert got == {1: (s[104] + s[105]) / 2, 2: 2.5}


def test_rows_at(frame):
    cols = ["v", "k", "id"]
    order = sorted(((v, i % 7, i) for i, v in ROWS), key=lambda r: (r[0] is not None, r[0] or 0.0, r[1], r[2]))
    places = [0, 5, 100, 299, 420, 598, 599]
    for p, row in zip(places, rows_at(frame, cols, places)):
        assert row == order[p][:len(row)]
        assert frame.filter(is_after(cols, row)).count() == 599 - p


@pytest.mark.parametrize("n", [0, 3, 9, 10, 57, 600])
def test_tiers_at_cuts_are_those_of_deciles(frame, n):
    df = frame.filter(F.col("id") < n)
    want = {r["id"]: r["value_tier"] for r in ranking.with_value_tiers(df, "v", ["k", "id"], []).collect()}
    cuts = ranking.value_cuts(df, "v", ["k", "id"])
    got = {r["id"]: r["t"] for r in df.select("id", ranking.tier_at_cuts("v", ["k", "id"], cuts).alias("t")).collect()}
    assert got == want


def test_side_medians_of_small_and_large_strata(frame):
    df = frame.filter("v IS NOT NULL").select("k", "v", (F.col("id") % 2).alias("a"), (F.col("id") % 5 > 0).cast("int").alias("b"))
    rows = lambda group: sorted(map(tuple, lift.side_medians(df, ["a", "b"], "v", ["k"], group).collect()))
    assert rows(1_000) == rows(60) == rows(1) and len(rows(1_000)) == 14


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_slots_are_shuffled_once(spark):
    """Newest slot, days and listing in one exchange."""
    s = spark.createDataFrame([(1, 2, 3, 4, 1, "x")], "a int, b int, p int, seq int, vacancies int, t string").withColumn("slot_date", F.current_date())
    cfg = configs.latest_config(s, ["a", "b", "p"], ["seq"], ["a", "b"]).groupBy("a", "b").agg(F.max("t"))
    assert exchanges(cfg) == 1


def test_text_is_parsed_before_the_shuffle(spark):
    from souklens.plans import feature_plans as fp

    for df in (fp.features(spark, "/root/testdata/sf0.001"), fp.configurations(spark, "/root/testdata/sf0.001", "addons")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        above = plan[:plan.index("RepartitionByExpression")]
        assert "details" not in above and "from_json" not in above


def test_bootstrap_remainders_take_no_arrays_of_their_own():
    """In place, and right at the edges."""
    values = [0, 1, lift.PRIME - 1, lift.PRIME, lift.PRIME + 1, 2 * lift.PRIME, (lift.PRIME - 1) ** 2, (lift.PRIME + 1) ** 2, 2 ** 63 - 1]
    t = np.array(values, np.uint64)
    assert lift._modulo(t) is t and t.tolist() == [v % lift.PRIME for v in values]


def test_report_with_performance_in_its_parts(spark):
    """Performance joined once to the options gives the report that joining it to every part gives; the stored report is sorted without them."""
    rows = [(s, a, f"{a}-{s}", p, f"tour {a}", float(10 + (7 * s + 3 * a + p) % 90), 20.0) for s in range(4) for a in range(5) for p in (1, 2)]
    o = spark.createDataFrame(rows, "supplier_id long, activity_id long, option_id string, pricing_id int, option_title string, price_eur double, retail_eur double")
    perf = spark.createDataFrame([(f"{a}-{s}", s, 10.0 * a) for s in range(3) for a in range(5)], "option_id string, bookings_l12m long, gmv_l12m double")
    both = o.join(perf, "option_id", "left")
    want = benchmarks.issue_report([benchmarks.within_parent_issues(o, perf), benchmarks.price_mismatch(o)], perf)
    got = benchmarks.issue_report([benchmarks.within_parent_issues(both), benchmarks.price_mismatch(both)])
    assert got.select(want.columns).collect() == want.collect() and want.count() > 40
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_counting_parses_no_prices(spark):
    """Features (F17 and the listings) parse what they count, and count the same as with everything parsed."""
    texts = [None, "", "{", "null", "{}", '{"pricingCategories":null,"group":[],"addons":null}',
             '{"pricingCategories":{"individual":[{"ticketCategory":"adult","prices":[{"minParticipants":1,"retailPrice":9.5},{"minParticipants":2,"retailPrice":null}]},'
             '{"ticketCategory":"SENIOR","prices":[]},{"ticketCategory":null,"prices":[{"minParticipants":3}]}],'
             '"group":[{"isAdditionalPaxForGroup":false,"prices":[{"maxParticipants":4,"retailPrice":1.25},{"maxParticipants":8,"retailPrice":2}]}],"addons":null}}',
             '{"pricingCategories":{"individual":null},"group":[{"isAdditionalPaxForGroup":true,"prices":[{"maxParticipants":2,"retailPrice":7.125}]}],'
             '"addons":[{"prices":[{"retailPrice":0.5}]},{"prices":[{"retailPrice":null}]}]}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, details string")
    count = lambda ddl: configs.counted_parts(configs.parse_config(df, "details", ddl)).orderBy("id")
    want = count(mp.CONFIG_DDL)
    assert count(mp.COUNT_DDL).schema == want.schema and count(mp.COUNT_DDL).collect() == want.collect()
    assert [r["addon_tiers"] for r in want.collect()][-2:] == [0, 2]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    root = "/root/testdata/sf0.001"
    assert "StructField(retailPrice" in plan(fp.parsed_slots(spark, root)) and "StructField(retailPrice" not in plan(fp.features(spark, root))


@pytest.fixture(scope="module")
def market(spark, tmp_path_factory):
    """Tables with more activities than suppliers, lines without activity or supplier, an unknown activity and one that is given twice."""
    root, r = str(tmp_path_factory.mktemp("market")), random.Random(7)
    day = lambda n: datetime(1998, 1, 1) + timedelta(days=n)
    line = lambda i: (i // 3, r.choice([None, 99, *range(12), *range(12)]), r.choice([None, 0, 1, 2]), 1 + i % 7, float(1 + i % 30),
                      100.0 + 7 * i % 911, i % 11 / 100, i % 9 / 100, "ANR"[i % 3], "OF"[i % 2], day(i % 900))
    tables = {
        "lineitem": ([line(i) for i in range(900)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "orders": ([(k, k % 17, "1-URGENT", day(4 * k)) for k in range(300)], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate timestamp"),
        "part": ([(k, f"tour {k}", f"type {k % 3}", f"brand {k % 2}", k, 9.5) for k in [*range(12), 3]],
                 "p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double"),
        "supplier": ([(k, k % 2, 6000.0 * k) for k in range(3)], "s_suppkey long, s_nationkey int, s_acctbal double"),
        "nation": ([(k, f"nation {k}", 0) for k in range(2)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "region")], "r_regionkey int, r_name string"),
        "customer": ([(k, 0, 100.0 - 300 * (k % 4)) for k in range(17)], "c_custkey long, c_nationkey int, c_acctbal double")}
    for name, (rows, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).write.parquet(f"{root}/{name}.parquet")
    return root


@pytest.fixture
def many_activities(spark, monkeypatch):
    """Activities are too many for a broadcast, suppliers are not; stages give their plan."""
    monkeypatch.setattr(mp, "broadcast_if_small", lambda dim, rows: skew.broadcast_if_small(dim, rows, 5))
    monkeypatch.setattr(fp, "DIM_ROWS", 5)
    monkeypatch.setattr(stages, "materialise", lambda df: df)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    stages.clear()
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    stages.clear()


def rounded(df):
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(repr(tuple(map(fix, r))) for r in df.select(sorted(df.columns)).collect())


def test_beside_is_a_full_join_in_place(spark):
    a = spark.createDataFrame([(1, 1, 5, None), (1, 2, 6, -0.5), (None, 1, 7, 1.0), (2, None, 8, float("nan"))], "a int, b int, x int, z double")
    b = spark.createDataFrame([(1, 2, "p"), (3, 1, "q"), (None, 1, "r"), (2, None, None)], "a int, b int, y string")
    assert rounded(lift.beside(a, b, ["a", "b"])) == rounded(a.join(b, ["a", "b"], "full"))
    dealt = [d.repartition("a").groupBy("a", "b").agg(F.max(c).alias(c)) for d, c in ((a, "x"), (b, "y"))]
    assert exchanges(lift.beside(*dealt, ["a", "b"]).groupBy("a").agg(F.max("x"))) == 2


def test_listings_are_not_shuffled_for_their_activities(spark, market, many_activities, monkeypatch):
    """Rows dealt out by activity (F3, F5 to F9, F21) stay where they are; those of an activity with too many lines are dealt out by listing."""
    rows = fp.listing_rows(spark, market)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(activity_id" in plan and "Exchange" not in plan[:plan.index("Union")]
    got = rounded(rows)
    monkeypatch.setattr(fp, "HOT", 3)
    stages.clear()
    assert fp.dealt_by(spark, market) == fp.KEYS
    assert rounded(fp.listing_rows(spark, market)) == got and len(got) > 40
    full = fp.rollup(spark, market).join(fp.performance(spark, market), fp.KEYS, "full")
    assert full.count() + full.filter("activity_id = 3").count() == len(got)


@pytest.mark.parametrize("part, column", [("individual", "ticket_category"), ("groups", "max_participants_tier"), ("addons", "country_name")])
def test_tiers_are_not_shuffled_for_their_activities(spark, market, many_activities, monkeypatch, part, column):
    """Configurations (F16, F18) take their place where they are, and before they are rows per tier."""
    monkeypatch.setattr(fp, "materialise", lambda df: df)
    placed = fp.placed_tiers(spark, market, part, "activity_type", column)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan[plan.index("Join"):]
    # slots and activities, no third
    assert plan.count("Exchange hashpartitioning(activity_id") == 2
    want = configs.tier_rows(fp.configurations(spark, market, part), part).join(
        mp.suppliers(spark, market).select("supplier_id", "country_name"), "supplier_id").join(mp.activities(spark, market).select("activity_id", "activity_type"), "activity_id")
    assert rounded(placed) == rounded(want.select(placed.columns)) and placed.count() > 40


def title_rows(spark):
    """Options with ties, without price, title, activity or id, and options that are given twice."""
    r = random.Random(11)
    row = lambda i: (r.choice([None, 1, 2, 3]), r.choice([None, "a", "b", "c", "d"]), r.choice([None, "tour one", "tour two"]), i % 4, r.choice([None, 0.0, 5.0, 7.5, 30.0, 1e6]))
    return spark.createDataFrame([row(i) for i in range(60)] + [(4, "e", "tour", 1, 9.0), (5, "f", "tour", 1, 2.0), (5, "g", "tour", 1, 3.0)],
                                 "activity_id long, option_id string, option_title string, pricing_id int, price_eur double")


def test_title_gaps_take_one_exchange(spark, monkeypatch):
    """Title groups (F2) are dealt out once; in windows, joined with hot keys spread, and some each way they have the same gaps."""
    o = title_rows(spark)
    assert exchanges(benchmarks.similar_title_gap(o)) == 1
    got = rounded(benchmarks.similar_title_gap(o))
    for hot in (0, 3, 15):
        assert rounded(benchmarks.similar_title_gap(o, hot=hot)) == got
    there = [r for r in o.collect() if r["activity_id"] is not None and r["option_title"] is not None]
    assert len(got) == len(there) and [g for g in got if g.startswith("(5, 'f'") or g.startswith("(5, 'g'")] == ["(5, 'f', 1, 0.5)", "(5, 'g', 1, 0.5)"]


def test_options_are_not_shuffled_for_their_activities(spark, market, many_activities, monkeypatch):
    """Slots dealt out by activity (F2) stay where they are when they meet its row."""
    priced = bp.options(spark, market)
    # slots and activities, no third; currency rates by day
    assert priced._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(activity_id") == 2
    got = rounded(priced)
    monkeypatch.setattr(fp, "HOT", 3)
    stages.clear()
    assert rounded(bp.options(spark, market)) == got and len(got) > 40


@pytest.mark.parametrize("cells", [1, 4, 65_536])
def test_activities_with_many_lines(spark, market, monkeypatch, cells):
    """Counted by cells first, however many activities share one."""
    monkeypatch.setattr(fp, "CELLS", cells)
    most = mp.lineitem(spark, market).groupBy("l_partkey").count().agg(F.max("count")).first()[0]
    assert [fp.crowded(spark, market, n) for n in (0, most - 1, most, 10 * most)] == [True, True, False, False]


def test_placed_beside_is_a_left_join_in_place(spark):
    a = spark.createDataFrame([(1, 1, 5), (1, 1, 6), (1, 2, 7), (None, 1, 8), (2, None, 9), (2, 1, None)], "a int, b int, x int")
    b = spark.createDataFrame([(1, 1, "p", 0.5), (3, 1, "q", 1.0), (None, 1, "r", 2.0), (2, None, "s", 3.0), (2, 1, None, float("nan"))], "a int, b int, y string, z double")
    assert rounded(skew.placed_beside(a, b, ["a", "b"])) == rounded(a.join(b, ["a", "b"], "left"))
    dealt = [d.repartition("a") for d in (a, b)]
    assert exchanges(skew.placed_beside(*dealt, ["a", "b"]).groupBy("a").agg(F.max("x"), F.max("z"))) == 2


def test_options_meet_their_performance_and_each_other_in_place(spark, market, many_activities, monkeypatch):
    """Rows for the report (F1) are shuffled as slots and as bookings, not as options; with activities that have too many lines for that, they are the same."""
    issues = bp.option_issues(spark, market)
    plan = issues._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("Union")]
    # slots, activities and bookings
    assert plan.count("Exchange hashpartitioning(activity_id") == 3 and "Exchange" not in above and above.count("Sort [") == 3
    got = rounded(issues)
    monkeypatch.setattr(benchmarks, "HOT_PARENT", 3)
    stages.clear()
    assert rounded(bp.option_issues(spark, market)) == got and len(got) > 40
    p = fp.performance(spark, market).select(*fp.KEYS, "bookings_l12m", "gmv_l12m")
    want = benchmarks.within_parent_issues(bp.options(spark, market).join(p, fp.KEYS, "left"))
    found = benchmarks.parent_issues(issues)
    assert rounded(found) == rounded(want.select(found.columns)) and want.count() > 20


def test_stored_parts_are_not_stored_again(spark, monkeypatch):
    rows = [(i % 5, i, f"{i}-{i % 5}", 1, float(i % 7), 4.0, i % 3 or None, None if i % 4 else 2.5 * i) for i in range(40)]
    o = spark.createDataFrame(rows, "supplier_id long, activity_id long, option_id string, pricing_id int, price_eur double, retail_eur double, bookings_l12m long, gmv_l12m double")
    want = benchmarks.issue_report([benchmarks.price_mismatch(o)]).collect()
    monkeypatch.setattr(benchmarks, "materialise", None)
    assert benchmarks.issue_report([benchmarks.price_mismatch(o)], stored=True).collect() == want and len(want) > 20
