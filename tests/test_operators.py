"""Edge rows for the operators: borders, missing data, ties, degenerate groups."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from souklens.functions import labels, periods, ratios
from souklens.functions.periods import EventWindows
from souklens.operators import benchmarks, causal, configs, engagement, lift, panel, quality, ranking, yoy
from souklens.operators import event_study as es
from souklens.sources import marketplace as mp
from souklens.sources import tables

W = EventWindows.around(date(1999, 6, 7), 2, 2)


def test_window_borders(spark):
    days = [W.ly_pre_start - timedelta(days=1), W.ly_pre_start, W.ly_pre_end, W.ly_event, W.ly_post_end, W.ly_post_end + timedelta(days=1),
            W.cy_pre_start, W.cy_event, W.cy_post_end, W.cy_post_end + timedelta(days=1)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = {r["d"]: r["period_window"] for r in periods.label_period_window(df, "d", W).collect()}
    assert got == {W.ly_pre_start: "PRE_LY", W.ly_pre_end: "PRE_LY", W.ly_event: "POST_LY", W.ly_post_end: "POST_LY",
                   W.cy_pre_start: "PRE_CY", W.cy_event: "POST_CY", W.cy_post_end: "POST_CY"}


def test_week_index_counts_whole_weeks(spark):
    df = spark.createDataFrame([(W.cy_event + timedelta(days=k),) for k in (-14, -1, 0, 6, 7)], "d date")
    lab = periods.with_week_index(periods.label_periods(df, "d", W), "d")
    assert [r["week_index"] for r in lab.orderBy("d").collect()] == [-2, -1, 0, 0, 1]


def test_overlapping_windows_give_several_rows(spark):
    ws = periods.two_event_windows(date(1999, 5, 31), date(1999, 6, 7), 2, 2)
    df = spark.createDataFrame([(date(1999, 6, 3),)], "d date")
    many = periods.explode_windows(df, "d", ws)
    assert sorted(r["window"] for r in many.collect()) == ["POST_COMM", "PRE_ROLLOUT"]
    assert [r["window"] for r in periods.label_first_window(df, "d", ws).collect()] == ["POST_COMM"]


def test_year_shift_rules():
    assert periods.year_back(date(1999, 6, 7), "364d") == date(1998, 6, 8)
    assert periods.year_back(date(2000, 2, 29), "12m_week") == date(1999, 2, 22)
    assert periods.shift_months(date(2001, 3, 31), -1) == date(2001, 2, 28)
    with pytest.raises(ValueError):
        periods.year_back(date(2000, 1, 1), "none")


def test_future_weeks_are_cut():
    assert len(periods.week_list(date(1999, 6, 7), 8, date(1999, 6, 21))) == 3
    st = panel.Study(date(1999, 6, 7), as_of=date(1999, 6, 20))
    assert st.ly_end == date(1999, 6, 20) - timedelta(days=364)
    with pytest.raises(ValueError):
        panel.Study(date(1999, 6, 8), as_of=date(1999, 7, 1))


def test_horizons(spark):
    a = date(1999, 6, 7)
    df = spark.createDataFrame([(date(1999, 9, 6),), (date(1999, 9, 7),), (date(1999, 12, 7),), (date(2000, 6, 7),), (date(2000, 6, 8),), (date(1999, 6, 6),)], "d date")
    got = [r[0] for r in df.select(periods.horizon_bucket(F.col("d"), F.lit(a))).collect()]
    assert got == ["3M", "6M", "12M", "12M", None, None]
    nested = df.agg(*[F.sum(ratios.flag(periods.within_months(F.col("d"), F.lit(a), m))) for m in (3, 6, 12)]).first()
    assert tuple(nested) == (2, 3, 4)


def test_ratios_with_zero_and_missing(spark):
    df = spark.createDataFrame([(0, 0), (5, 2), (None, 4)], "n int, d int")
    r = df.select(ratios.ratio(F.col("n"), F.col("d")), ratios.capped_ratio(F.col("n"), F.col("d"))).collect()
    assert [tuple(x) for x in r] == [(None, None), (2.5, 1.0), (None, 0.0)]
    w = spark.createDataFrame([(1.0, 2.0), (None, 100.0), (4.0, 1.0)], "x double, w double").agg(ratios.weighted_mean(F.col("x"), F.col("w"))).first()[0]
    assert w == 2.0


def test_missing_status_is_minus_one(spark):
    b = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "booking_id bigint, status_id int")
    s = mp.status_dim(spark)
    assert [r["booking_id"] for r in es.with_status(b, s, ["Unknown"]).collect()] == [1]
    assert es.with_status(b, s, ["Active", "Cancelled"]).count() == 2


def test_cancellation_counts_bookings_once(spark):
    d = date(1999, 6, 7)
    rows = [(1, 1, 10.0, d, d), (1, 1, 5.0, d, d), (2, 2, 20.0, d, date(1999, 12, 1)), (3, 2, 0.0, d, date(2002, 1, 1))]
    b = spark.createDataFrame(rows, "booking_id bigint, status_id int, nr double, event_start date, travel_date date").withColumns(
        {"k": F.lit("x"), "activity_id": F.lit(1), "supplier_id": F.lit(1)})
    r = es.cancellation_rates(b, ["k"], [3, 6]).first()
    assert (r["total_bookings"], r["cancelled_bookings"], r["bookings_3m"], r["bookings_6m"]) == (3, 2, 1, 2)
    assert r["cancellation_rate_nr"] == pytest.approx(20 / 35) and r["cancellation_rate_3m"] == 0


def test_session_funnel_with_missing_arrays(spark):
    rows = [("v1", 1, None, [1], True), ("v1", 0, [3], [], False), ("v2", 0, None, None, False)]
    s = spark.createDataFrame(rows, "visitor_id string, detail_views int, checked_ids array<bigint>, cart_ids array<bigint>, purchased boolean")
    r = es.session_funnel(s, []).first()
    assert (r["total_visitors"], r["detail_view_visitors"], r["check_availability_rate"], r["conversion_rate"]) == (2, 1, 1.0, 0.5)


def test_supply_counts_a_day_once(spark):
    d = date(1999, 6, 7)
    rows = [("c", d, 1, 10, d, True), ("c", d, 1, 10, d, False), ("c", d, 1, 11, d, True), ("c", d, 1, 11, d + timedelta(days=1), False),
            ("c", d, 2, 20, d, False)]
    h = spark.createDataFrame(rows, "k string, week_start date, supplier_id bigint, activity_id bigint, day date, is_online boolean")
    r = es.supply_availability(h, ["k"]).first()
    assert (r["total_activitys"], r["active_activitys"], r["total_suppliers"], r["active_suppliers"]) == (3, 2, 2, 1)
    assert r["avg_days_online_per_activity_week"] == pytest.approx(2 / 3)
    assert r["avg_days_online_per_supplier_week"] == 0.5 and r["avg_days_online_per_active_supplier_week"] == 1.0


def test_parity_keeps_missing_and_drops_null_flags(spark):
    rows = [(1, 1, 10.0, 1, 0, 5.0, "meet"), (1, 2, 30.0, None, None, 5.0, "lose"), (2, 2, 60.0, None, None, None, "beat")]
    d = spark.createDataFrame(rows, "activity_id int, supplier_id int, impressions double, x_meet int, x_beat int, x_price double, overall string")
    r = es.price_parity(d, [], ["x"]).first()
    assert r["x_parity_rate"] == 10 / 40 and r["overall_parity_rate"] == 70 / 100


def test_did_needs_a_base(spark):
    rows = [("a", "PRE_LY", 10.0), ("a", "POST_LY", 11.0), ("a", "PRE_CY", 10.0), ("a", "POST_CY", 13.0), ("b", "PRE_LY", 0.0),
            ("b", "POST_LY", 1.0), ("b", "PRE_CY", 1.0), ("b", "POST_CY", 1.0)]
    s = spark.createDataFrame(rows, "u string, period_window string, m double")
    got = {r["u"]: r["did"] for r in es.did_pct(s, ["u"], ["m"]).collect()}
    assert got["a"] == pytest.approx(0.2) and got["b"] is None
    with pytest.raises(ValueError):
        es.require_windows(spark.createDataFrame([("CY", "PRE")], "period string, window string"), ["CY"], ["PRE", "POST"])


def test_empty_id_list_is_no_filter(spark):
    df = spark.createDataFrame([(1,), (2,)], "id bigint")
    assert tables.keep_ids(df, tables.id_frame(spark, [], "id"), "id").count() == 2
    assert tables.keep_ids(df, tables.id_frame(spark, [2, 2], "id"), "id").count() == 1
    assert tables.keep_listed(df, "id", []).count() == 2


def test_csv_rows(spark):
    df = spark.createDataFrame([(" 1, ,2,x",), ("",), (None,)], "t string")
    assert [r["i"] for r in tables.csv_rows(df, "t", "i").collect()] == [1, 2, None]


def test_tables_are_safe(spark, tmp_path):
    df = spark.createDataFrame([(1, "real")], "v bigint, scenario string")
    p = str(tmp_path / "s")
    tables.replace_scenario(df.unionByName(df.withColumn("scenario", F.lit("placebo"))), p)
    tables.replace_scenario(df.withColumn("v", F.lit(9).cast("bigint")), p)
    assert {(r["scenario"], r["v"]) for r in spark.read.parquet(p).collect()} == {("real", 9), ("placebo", 1)}
    f = str(tmp_path / "f")
    tables.freeze_cohort(df, f)
    with pytest.raises(Exception):
        tables.freeze_cohort(df, f)
    a = str(tmp_path / "a")
    tables.append_evolving(df, a)
    tables.append_evolving(df.withColumn("w", F.lit(1.5)), a)
    assert set(tables.read_evolved(spark, a).columns) == {"v", "scenario", "w"}
    with pytest.raises(ValueError):
        tables.append_evolving(df.withColumn("v", F.lit("text")), a)


def test_pareto_rules(spark):
    df = spark.createDataFrame([("s", 1, 90.0), ("s", 2, 6.0), ("s", 3, 4.0), ("t", 4, 50.0), ("t", 5, 30.0), ("t", 6, 20.0), ("t", 7, 0.0)],
                               "g string, id bigint, v double")
    plain = ranking.pareto_set(df, ["g"], "id", "v").filter("in_set").collect()
    assert sorted(r["id"] for r in plain) == [4, 5]           # the dominant unit of s leaves an empty set
    cross = ranking.pareto_set(df, ["g"], "id", "v", include_crossing=True).filter("in_set").collect()
    assert sorted(r["id"] for r in cross) == [1, 4, 5]


def test_similar_title_gap_against_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(3)), f"o{int(rng.integers(6))}", p, "t" * 60 + str(int(rng.integers(2))) if i % 2 else f"u{int(rng.integers(2))}",
             float(rng.integers(1, 40))) for i, p in enumerate(range(80))]
    o = spark.createDataFrame(rows, "activity_id bigint, option_id string, pricing_id bigint, option_title string, price_eur double")
    got = {r["pricing_id"]: r["similar_gap"] for r in benchmarks.similar_title_gap(o).collect()}
    for a, op, p, t, x in rows:
        gaps = [abs(x - y) / min(x, y) for b, oq, _, u, y in rows if b == a and oq != op and u[:50] == t[:50]]
        assert got[p] == (pytest.approx(max(gaps)) if gaps else None)


def test_parent_facts_by_windows_and_by_joins(spark):
    rng = np.random.default_rng(9)
    rows = [(None if i % 17 == 0 else int(rng.integers(4)), f"o{int(rng.integers(5))}", i, None if i % 13 == 0 else "t" * 60 + str(int(rng.integers(2))),
             float(rng.integers(1, 30))) for i in range(150)]
    rows += [(99, "o1", 1000, "only", 5.0), (98, "o1", 1001, "", 0.0), (98, "o2", 1002, "", 4.0)]
    o = spark.createDataFrame(rows, "activity_id bigint, option_id string, pricing_id bigint, option_title string, price_eur double")
    narrow = lambda df: {r["pricing_id"]: [r[c] for c in benchmarks.PARENT_FACTS] for r in df.collect()}
    windows, mixed, joined = (narrow(benchmarks.parent_facts(o, hot)) for hot in (10 ** 6, 30, 0))
    assert len(windows) == len(mixed) == len(joined) == len(rows)
    for a, op, p, t, x in rows:
        mine = [r for r in rows if r[0] == a]
        titled = [r for r in mine if r[3] == t]
        prices = [r[4] for r in mine]
        got = dict(zip(benchmarks.PARENT_FACTS, windows[p]))
        below = sum(y < x for y in prices)
        assert got["pr"] == pytest.approx(below / (len(mine) - 1) if len(mine) > 1 else 0.0)
        assert (got["num_options"], got["num_prices"]) == (len({r[1] for r in mine}), len(set(prices)))
        assert got["parent_avg"] == pytest.approx(np.mean(prices)) and (got["parent_min"], got["parent_max"]) == (min(prices), max(prices))
        assert (got["title_configs"], got["title_prices"]) == (len({r[2] for r in titled}), len({r[4] for r in titled}))
        for other in (mixed[p], joined[p]):
            assert [v if v is None else pytest.approx(v, rel=1e-9) for v in windows[p]] == other
    empty = benchmarks.parent_facts(o.filter("false"))
    assert empty.count() == 0 and empty.columns == [*o.columns, *benchmarks.PARENT_FACTS]


def test_planted_synthetic_control(spark):
    rng = np.random.default_rng(1)
    weeks = [date(1999, 4, 12) + timedelta(weeks=i) for i in range(16)]
    event = weeks[8]
    donors = {f"d{j}": 100 + rng.normal(0, 5, 16).cumsum() for j in range(4)}
    pre = {k: v[:8].mean() for k, v in donors.items()}
    mix = 0.6 * donors["d0"] / pre["d0"] + 0.4 * donors["d2"] / pre["d2"]
    treated = 50 * mix / mix[:8].mean()
    treated[8:] *= 1.1
    rows = [(w, u, float(v[i])) for u, v in {**donors, "t": treated}.items() for i, w in enumerate(weeks)]
    rows.append((weeks[-1] + timedelta(weeks=1), "t", 1.0))          # week without donors
    p = spark.createDataFrame(rows, "week_start date, country_name string, m double")
    long = causal.complete_panel(p, ["t", *donors], ["m"])
    assert long.select("week_start").distinct().count() == 16
    norm = causal.normalise(long, event)
    fits = causal.synthetic_control(norm, ["t"], list(donors))
    f = fits.filter("is_treated").first()
    w = f["weights"]
    assert w["d0"] == pytest.approx(0.6, abs=1e-3) and w["d2"] == pytest.approx(0.4, abs=1e-3)
    want = 0.1 * (mix[8:] / mix[:8].mean()).mean()
    assert f["did"] == pytest.approx(want, abs=1e-4) and f["pre_rmse"] < 1e-4
    assert fits.filter("NOT is_treated").count() == 4
    pl = causal.placebo_in_space(fits).first()
    assert pl["placebos"] == 4 and 0 <= pl["placebos_larger"] <= 4
    series = causal.synthetic_series(norm, fits)
    assert series.count() == 16
    gap = causal.mean_post_gap(causal.level_corrected(series, p, {})).first()["did_absolute"]
    assert gap == pytest.approx(want * 50, rel=1e-2)
    assert {r["donor"]: r["drop_candidate"] for r in causal.donor_usage(fits).collect()}["d1"] is True


def test_short_pre_period_gives_no_fit(spark):
    rows = [(date(1999, 6, 7) + timedelta(weeks=i), u, 1.0 + i) for u in ("t", "a", "b") for i in range(-4, 2)]
    p = spark.createDataFrame(rows, "week_start date, country_name string, m double")
    n = causal.normalise(causal.complete_panel(p, ["t", "a", "b"], ["m"]), date(1999, 6, 7))
    assert causal.synthetic_control(n, ["t"], ["a", "b"]).count() == 0


def entity(i, country, **kw):
    base = dict(supplier_id=i, country_name=country, active_share_pre=1.0, active_share_post=1.0, pct_online_pre=1.0, pct_online_post=1.0,
                coverage_pre=0.5, coverage_post=0.5, price_idx_post=1.0, gmv_pre=100.0, gmv_post=100.0, nr_pre=10.0, nr_post=10.0)
    return {**base, **kw}


def test_reaction_flags(spark):
    rows = [entity(i, "c", price_idx_post=1 + i / 1000) for i in range(20)]
    rows += [entity(100, "t", active_share_post=0.0), entity(101, "t", price_idx_post=1.5), entity(102, "t", coverage_post=None),
             entity(103, "t", active_share_post=0.9)]
    schema = ", ".join(f"{k} {'bigint' if k == 'supplier_id' else 'string' if k == 'country_name' else 'double'}" for k in rows[0])
    e = causal.with_deltas(causal.with_dose(spark.createDataFrame([tuple(r.values()) for r in rows], schema), {"t": 5.0}))
    reactions = {"dark": ("active_delta", -1), "price": ("price_idx_post", 1), "dates": ("coverage_rel", -1)}
    f = causal.reaction_flags(e, causal.control_scales(e, F.col("country_name") == "c", reactions), reactions)
    got = {r["supplier_id"]: r for r in f.collect()}
    # no control unit moved its activity: any drop is beyond the line and gets the cap
    assert got[103]["flag_dark"] and got[103]["severity_dark"] == 9.99 and not got[103]["flag_exited"]
    assert got[100]["flag_exited"] and got[100]["value_at_risk"] == 100.0
    assert got[101]["flag_price"] and got[101]["severity_price"] == 9.99
    assert got[102]["severity_dates"] is None and got[102]["n_flags"] == 0
    assert got[101]["effective_rate"] == pytest.approx(0.105) and got[0]["surcharge_pct"] == 0
    treated = F.col("country_name") == "t"
    assert causal.action_list(f, treated, 2).count() == 2
    # controls give the scale and are in no result
    assert {r["country_name"] for r in causal.flags_by_country(f, treated).collect()} == {"t"}
    assert {r["country_name"] for r in causal.action_list(f, treated).collect()} == {"t"}
    assert sum(r["suppliers"] for r in causal.dose_by_flag(f, treated).collect()) == 4


def test_checks_and_reconciliation(spark):
    rows = [(date(1999, 5, 31), "a", 0.5, 1, 2), (date(1999, 6, 7), "a", None, 3, 2)]
    p = spark.createDataFrame(rows, "week_start date, country_name string, x double, n int, m int")
    made = quality.frame_checks(p, "f", 1, 2, date(1999, 6, 7)).unionByName(quality.panel_checks(p, ["x"], {"x": (0, 1)}, {"n": ("m", 1.0)}))
    got = {r["check_name"]: r["result"] for r in made.collect()}
    assert got == {"f: 1 units present": "PASS", "f: 2 weeks per unit": "PASS", "f: same number of weeks before and after": "PASS",
                   "x has no missing value": "FAIL", "x in [0, 1]": "PASS", "n <= m": "FAIL"}
    a = spark.createDataFrame([(1, 100.0, 0.0), (2, 103.0, 1.0)], "k int, v double, z double")
    b = spark.createDataFrame([(1, 100.0, 0.0), (2, 100.0, 2.0)], "k int, v double, z double")
    assert {r["metric"]: r["verdict"] for r in quality.reconcile(a, b, ["k"], ["v", "z"]).collect()} == {"v": "check", "z": "MISMATCH"}
    lone = spark.createDataFrame([(1, 100.0, 0.0), (3, 100.0, 2.0)], "k int, v double, z double")
    got = quality.reconcile(b, lone, ["k"], ["v"]).first()
    assert (got["matched_rows"], got["only_left"], got["only_right"], got["verdict"]) == (1, 1, 1, "MISMATCH")


def test_config_parsing_both_layouts(spark):
    new = '{"pricingCategories":{"individual":[{"ticketCategory":"adult","prices":[{"retailPrice":9},{"retailPrice":7}]}],"addons":[{"prices":[{"retailPrice":1}]}]}}'
    old = '{"pricingCategories":{},"group":[{"isAdditionalPaxForGroup":true,"prices":[{"retailPrice":1}]},{"isAdditionalPaxForGroup":false,"prices":[{"retailPrice":50}]}]}'
    df = spark.createDataFrame([(1, new), (2, old), (3, "not json")], "id int, j string")
    c = configs.parse_config(df, "j", mp.CONFIG_DDL)
    got = [tuple(r) for r in c.select(F.size("individual"), F.size("groups"), F.size("addons"), configs.tiers("individual"), configs.has_scale("individual"),
                                      configs.has_category("ADULT"), configs.retail_price(c), configs.retail_kind()).collect()]
    assert got == [(1, 0, 1, 2, 1, 1, 7.0, "ADULT_INDIVIDUAL"), (0, 2, 0, 0, 0, 0, 50.0, "SMALLEST_GROUP"), (0, 0, 0, 0, 0, 0, None, None)]
    assert configs.tier_rows(c, "groups").count() == 2 and configs.tier_rows(c, "groups", outer=True).count() == 4


def test_latest_config_counts_days(spark):
    d = date(2000, 1, 1)
    rows = [(1, 5, d, 1.0, None), (1, 7, d, 2.0, 3), (1, 6, d + timedelta(days=1), 9.0, 0)]
    s = spark.createDataFrame(rows, "k int, seq int, slot_date date, price double, vacancies int")
    r = configs.latest_config(s, ["k"], ["seq"]).first()
    assert (r["price"], r["dates_covered"], r["dates_with_vacancies"], r["dates_available"]) == (2.0, 2, 2, 1)


def test_trailing_windows_and_repeat_customers(spark):
    as_of = date(2001, 8, 1)
    rows = [(1, 10, 1, date(2001, 5, 1), 10.0), (1, 10, 2, date(2001, 4, 30), 5.0), (1, 11, 3, date(1999, 1, 1), 7.0), (2, 10, 4, date(2001, 7, 1), 1.0),
            (2, 10, 4, date(2001, 7, 1), 2.0)]
    b = spark.createDataFrame(rows, "e int, customer_id bigint, booking_id bigint, checkout_date date, gmv double").withColumns(
        {"nr": F.col("gmv") / 10, "tickets": F.lit(2.0)})
    got = {r["e"]: r for r in ranking.trailing_performance(b, ["e"], as_of).collect()}
    assert (got[1]["bookings_l3m"], got[1]["bookings_l6m"], got[1]["bookings_lifetime"]) == (1, 2, 3)
    assert got[1]["gmv_lifetime"] == 22.0 and got[1]["customers_l12m"] == 1 and got[1]["repeat_rate_l3m"] == 100.0
    assert (got[2]["bookings_l12m"], got[2]["gmv_l3m"], got[2]["avg_booking_value"]) == (1, 3.0, 1.5)
    assert got[1]["growth_pct"] == 0.0 and got[1]["days_since_last_booking"] == 92


def test_full_join_of_one_sided_quarters(spark):
    ytd = periods.YearToDate.at(date(2001, 7, 15))
    assert (ytd.cy_start, ytd.cy_end, ytd.py_end) == (date(2001, 1, 1), date(2001, 7, 1), date(2000, 7, 1))
    s = spark.createDataFrame([("v", date(2001, 2, 1), "s1", 0, True, None)], "visitor_id string, day date, session_id string, detail_views int, is_bounce boolean, is_new_visitor boolean")
    b = spark.createDataFrame([(1, 1, 1, date(2001, 5, 1), 10.0, 1.0, 9.0, 10.0, 0)],
                              "booking_id int, cart_id int, status_id int, checkout_date date, gmv double, nr double, supplier_share double, commission_rate double, coupon_id int")
    q = {r["quarter_start"]: r for r in yoy.yoy_quarters(s, b, ytd, []).collect()}
    assert q[date(2001, 1, 1)]["bookings"] is None and q[date(2001, 1, 1)]["returning_visitors"] == 1
    assert q[date(2001, 4, 1)]["sessions"] is None and q[date(2001, 4, 1)]["take_rate"] == pytest.approx(0.1)


def test_labels(spark):
    df = spark.createDataFrame([(None,), ("YES ",), ("x",)], "s string")
    assert [r[0] for r in df.select(labels.yes_no(F.col("s"))).collect()] == ["No", "Yes", "Unknown"]
    assert [r[0] for r in df.select(labels.one_of_or_other(F.col("s"), ["X"])).collect()] == ["Other", "Other", "x"]
    n = spark.createDataFrame([(0.0,), (None,), (5.0,), (10.0,)], "v double")
    assert [r[0] for r in n.select(labels.edge_bucket(F.col("v"), [10], ["lo", "hi"], zero="0")).collect()] == ["0", "0", "lo", "hi"]


def test_lift_with_one_sided_feature(spark):
    df = spark.createDataFrame([(1, 1, 0, 10.0, 1.0), (2, 1, 1, 20.0, 3.0)], "id bigint, f int, g int, v double, a double")
    got = {r["feature"]: r for r in lift.raw_lift(df, ["f", "g"], "v", "a").collect()}
    assert got["f"]["lift_pct"] is None and got["g"]["lift_pct"] == 100.0 and got["g"]["potential"] == 10.0
    assert lift.bootstrap_lift(df, "id", ["g"], "v").count() == 0          # too few rows on a side
    assert lift.segment_lift(df.withColumn("s", F.lit("x")), ["f", "g"], "s", "v", "a").count() == 1


def test_bootstrap_query_over_every_feature(spark):
    from souklens.plans import QUERIES

    got = {r["feature"] for r in QUERIES["bootstrap_lift_features"].run(spark, "/root/testdata/sf0.001").collect()}
    assert {"has_group", "has_capacity"} < got  # on so few rows the others lack 200 on a side


def test_bootstrap_interval_holds_the_plain_lift(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") % 2).cast("int").alias("f"), (F.lit(10.0) + F.col("id") % 7 + (F.col("id") % 2) * 3).alias("v"))
    r = lift.bootstrap_lift(df, "id", ["f"], "v", replicates=200).first()
    m = {x["f"]: x["m"] for x in df.groupBy("f").agg(F.avg("v").alias("m")).collect()}
    plain = (m[1] / m[0] - 1) * 100
    assert r["ci_low_pct"] < plain < r["ci_high_pct"] and r["ci_high_pct"] - r["ci_low_pct"] < 6


def test_poisson_weights_look_like_poisson():
    w = lift.bootstrap_weights(np.arange(20000), 17)[:, 16]
    assert abs(w.mean() - 1) < 0.05 and abs(w.var() - 1) < 0.08


def test_bootstrap_equals_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(lift, "BOOT_ROWS", 64)
    rows = [(i * 7 + 5, i % 2, int(i % 3 == 0), float((i * 37) % 101)) for i in range(900)] + [(None, 0, 1, 5.0), (3, None, 1, None)]
    df = spark.createDataFrame(rows, "id bigint, f int, g int, v double").repartition(5, "v")
    got = {r["feature"]: r for r in lift.bootstrap_lift(df, "id", ["f", "g"], "v", replicates=30).collect()}
    held = [r for r in rows if r[3] is not None]
    for at, name in ((1, "f"), (2, "g")):
        means = {}
        for h in (0, 1):
            own = [r for r in held if r[at] == h]
            lo, hi = np.quantile([r[3] for r in own], [0.01, 0.99])
            own = [r for r in own if r[0] is not None]
            w = lift.bootstrap_weights(np.array([r[0] for r in own]), 30)
            means[h] = [sum(w[i][k] * min(max(r[3], lo), hi) for i, r in enumerate(own)) / sum(w[i][k] for i in range(len(own))) for k in range(30)]
        lifts = [(a / b - 1) * 100 for a, b in zip(means[1], means[0])]
        assert got[name]["lift_mean_pct"] == pytest.approx(np.mean(lifts))
        assert got[name]["ci_low_pct"] == pytest.approx(np.quantile(lifts, 0.025))
        assert got[name]["ci_high_pct"] == pytest.approx(np.quantile(lifts, 0.975))


def test_status_label_groups(spark):
    a = spark.createDataFrame([("active",), ("in_progress",), ("resolved",)], "status string")
    got = {r["status_label"]: r["n"] for r in engagement.status_shares(a).collect()}
    assert got == {"Active / In progress": 2, "Resolved": 1}


def test_migration_and_time_buckets(spark):
    d = date(2000, 7, 1)
    rows = [(1, "resolved", d, d), (1, "resolved", date(2001, 1, 1), date(2001, 1, 3)), (2, "resolved", d, date(2000, 9, 9)), (3, "dismissed", d, None)]
    a = spark.createDataFrame(rows, "supplier_id int, status string, surfaced_at date, resolved_at date")
    got = {r["tier"]: r["suppliers"] for r in engagement.cohort_migration(a, d, date(2000, 10, 1), date(2001, 4, 1)).collect()}
    assert got == {"Occasional": 1, "Single-Use": 1}
    t = [(r["time_window"], r["n"]) for r in engagement.time_to_event(a).orderBy("sort_order").collect()]
    assert t == [("Same day", 1), ("Days 1-3", 1), ("60+ days", 1)]
    assert engagement.status_funnel(a, []).first()["dismissal_pct"] == 25.0


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/New_York"])
def test_date_ranges_do_not_move_with_the_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        df = spark.sql("SELECT explode(array(timestamp_ntz'1999-01-01 00:00:00', timestamp_ntz'1999-01-31 23:59:59', timestamp_ntz'1999-02-01 00:00:00')) AS t")
        assert df.filter(mp.in_days(F.col("t"), date(1999, 1, 1), date(1999, 1, 31))).count() == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_dimension_broadcast_is_size_checked(spark):
    from souklens.functions.skew import broadcast_if_small

    plan = lambda limit: spark.range(50).join(broadcast_if_small(spark.range(20), limit=limit), "id")._jdf.queryExecution().logical().toString()
    assert "ResolvedHint" in plan(20) or "UnresolvedHint" in plan(20)
    assert "Hint" not in plan(19)


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_differing_rows(spark, buckets):
    rng = np.random.default_rng(3)
    rows = {(i, "x" if i % 3 else None): int(v) for i, v in enumerate(rng.integers(0, 1000, 3000))}
    other = dict(rows)
    for i in (5, 99, 1500):   # planted: changed, lost, new
        other[i, "x" if i % 3 else None] = -1
    del other[6, None], other[7, "x"]
    other[9000, None] = 4
    frame = lambda d: spark.createDataFrame([(*k, v) for k, v in d.items()], "k int, s string, v long")
    got = {(r["k"], r["a_v"], r["b_v"], r["found"]) for r in quality.differing_rows(frame(rows), frame(other), ["k", "s"], ["v"], buckets).collect()}
    want = {(i, rows[i, "x" if i % 3 else None], -1, "differs") for i in (5, 99, 1500)}
    want |= {(6, rows[6, None], None, "only in a"), (7, rows[7, "x"], None, "only in a"), (9000, None, 4, "only in b")}
    assert got == want
    assert quality.differing_rows(frame(rows), frame(rows), ["k", "s"], ["v"], buckets).count() == 0
    nothing = frame(rows).limit(0)
    assert quality.differing_rows(nothing, frame(rows), ["k", "s"], ["v"], buckets).filter("found = 'only in b'").count() == 3000


@pytest.mark.parametrize("cell", [1, 14, 400])
def test_interval_join(spark, cell):
    from souklens.functions.intervals import interval_join

    rng = np.random.default_rng(cell)
    at = lambda n: date(1969, 6, 1) + timedelta(days=int(n))  # noqa: E731  days on both sides of the epoch
    facts = [(int(k), at(d), i) for i, (k, d) in enumerate(zip(rng.integers(0, 4, 300), rng.integers(0, 400, 300)))] + [(1, None, 900), (None, at(5), 901)]
    windows = [(int(k), at(s), at(s + n), i) for i, (k, s, n) in enumerate(zip(rng.integers(0, 4, 60), rng.integers(0, 400, 60), rng.integers(-3, 60, 60)))]
    windows += [(1, None, at(3), 90), (1, at(3), None, 91), (None, at(0), at(300), 92)]
    f = spark.createDataFrame(facts, "k int, day date, i int")
    w = spark.createDataFrame(windows, "k int, s date, e date, j int")
    got = interval_join(f, w, ["k"], "day", "s", "e", cell)
    want = [(a, b) for k, d, a in facts for q, s, e, b in windows if k is not None and k == q and d and s and e and s <= d <= e]
    assert sorted((r["i"], r["j"]) for r in got.collect()) == sorted(want) and len(want) > 50
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    far = interval_join(f, w.drop("k"), [], "day", "s", "e", cell).count()
    assert far == sum(1 for _, d, _ in facts for _, s, e, _ in windows if d and s and e and s <= d <= e)
