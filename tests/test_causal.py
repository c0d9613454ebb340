"""Synthetic control: certificates, and all that follows from the weights recomputed in SQL."""

from datetime import date, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from souklens.operators import causal
from souklens.plans import causal_plans, panel_plans

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("weeks, donors", [(8, 20), (8, 3), (30, 6), (1, 5), (8, 1)])
def test_gap_certifies_the_minimum(weeks, donors):
    rng = np.random.default_rng(weeks * 100 + donors)
    for _ in range(5):
        x, y = 1 + 0.1 * rng.normal(size=(weeks, donors)), 1 + 0.1 * rng.normal(size=weeks)
        w, gap = causal.simplex_fit(x, y)
        assert w.min() >= 0 and w.sum() == pytest.approx(1, abs=1e-12) and gap < 1e-9
        value = ((x @ w - y) ** 2).sum()
        others = rng.dirichlet(np.full(donors, 0.3), size=3000)  # no other point of the simplex is better by more than the gap
        assert (((others @ x.T - y) ** 2).sum(axis=1) >= value - gap - 1e-12).all()


def test_a_poor_fit_is_not_certified(spark):
    fits = spark.createDataFrame([("m", "t", True, 8, 8, 1.0, 0.0, 0.0, 1e-3, {"a": 0.5, "b": 0.6}), ("m", "u", True, 8, 8, 1.0, 0.0, 0.0, 1e-9, {"a": -0.1, "b": 1.1})], causal.FIT_SCHEMA)
    got = {r["treated"]: (r["weights_not_negative"], r["weights_sum_to_one"], r["certified"]) for r in causal.certificates(fits).collect()}
    assert got == {"t": (True, False, False), "u": (False, True, True)}


@pytest.fixture(scope="module")
def run(spark):
    p, n, f = causal_plans.fits_for(spark, SF, panel_plans.ST)
    series = causal.synthetic_series(n, f)
    con = duckdb.connect()
    tables = {"panel": p, "norm": n, "weights": causal.donor_weights(f), "fits": f.drop("weights"), "series": series,
              "levels": causal.level_corrected(series, p, causal_plans.YOY_BASE)}
    for name, df in tables.items():
        con.register(name, df.toArrow())
    con.execute("""CREATE TABLE syn AS SELECT w.metric, w.treated, n.week_start, n.is_pre, sum(w.weight * n.norm) AS s
                   FROM weights w JOIN norm n ON n.metric = w.metric AND n.country_name = w.donor GROUP BY ALL""")
    return con


def test_effects_follow_from_the_weights(run):
    got = run.execute("""
        SELECT count(*), max(abs(f.did - q.did)), max(abs(f.pre_rmse - q.rmse)), count(DISTINCT f.metric), count(DISTINCT f.treated), min(f.n_pre) FROM fits f JOIN (
          SELECT s.metric, s.treated, avg(norm) FILTER (NOT s.is_pre) - avg(norm) FILTER (s.is_pre) - avg(s) FILTER (NOT s.is_pre) + avg(s) FILTER (s.is_pre) AS did,
            sqrt(avg((norm - s) * (norm - s)) FILTER (s.is_pre)) AS rmse
          FROM syn s JOIN norm n ON n.metric = s.metric AND n.country_name = s.treated AND n.week_start = s.week_start GROUP BY ALL) q USING (metric, treated)""").fetchone()
    assert got[0] == run.execute("SELECT count(*) FROM fits").fetchone()[0] and got[1] < 1e-9 and got[2] < 1e-9
    assert got[3] >= 2 and got[4] == 25 and got[5] == 8


def test_every_unit_has_all_other_controls_as_donors(run):
    assert run.execute("SELECT DISTINCT is_treated, n FROM fits JOIN (SELECT metric, treated, count(*) AS n FROM weights GROUP BY ALL) USING (metric, treated) ORDER BY 1").fetchall() == [(False, 20), (True, 21)]


def test_levels_follow_from_the_series(run):
    base = " ".join(f"WHEN '{m}' THEN {b}" for m, b in causal_plans.YOY_BASE.items())
    got = run.execute(f"""
        WITH t AS (SELECT *, synthetic + avg(actual) FILTER (is_pre) OVER (PARTITION BY metric, treated) - avg(synthetic) FILTER (is_pre) OVER (PARTITION BY metric, treated) AS twin FROM series),
        b AS (SELECT t.*, CASE metric {base} END AS base FROM t JOIN panel p ON p.week_start = t.week_start AND p.country_name = t.treated),
        want AS (SELECT metric, treated, week_start, coalesce(base, actual) AS a, twin * coalesce(base / nullif(actual, 0), 1) AS w FROM b)
        SELECT count(*), max(abs(l.actual_abs - a)), max(abs(l.twin_abs - w)) FROM levels l JOIN want USING (metric, treated, week_start)""").fetchone()
    assert got[0] == run.execute("SELECT count(*) FROM series").fetchone()[0] and got[1] < 1e-9 and got[2] < 1e-9


def test_levels_of_ratios_to_last_year(spark):
    """A ratio's twin is carried over to the level that the ratio implies for last year; a base of its own, not the identity."""
    event, rows, series = date(1999, 6, 7), [], []
    for i in range(4):
        week = event + timedelta(weeks=i - 2)
        rows.append((week, "t", 100.0 + i, 50.0 + i))
        series.append(("x_yoy", "t", week, i < 2, (100.0 + i) / 50, 2.0))
    panel = spark.createDataFrame(rows, "week_start date, country_name string, x double, other double")
    s = spark.createDataFrame(series, "metric string, treated string, week_start date, is_pre boolean, actual double, synthetic double")
    got = causal.level_corrected(s, panel, {"x_yoy": "x"}).orderBy("week_start").collect()
    twin = (100.0 + 101.0) / 2 / 50
    assert [r["actual_abs"] for r in got] == [100.0, 101.0, 102.0, 103.0]
    assert [r["twin_abs"] for r in got] == pytest.approx([twin * 50] * 4)
    gap = causal.mean_post_gap(causal.level_corrected(s, panel, {"x_yoy": "x"})).first()["did_absolute"]
    assert gap == pytest.approx(102.5 - twin * 50)


def test_placebo_scenarios_are_stored(spark):
    from souklens.plans import QUERIES

    got = QUERIES["placebo_in_time"].run(spark, SF)
    counts = {r["scenario"]: r["count"] for r in got.groupBy("scenario").count().collect()}
    assert set(counts) == {"real", "placebo"} and all(n >= 8 for n in counts.values())
    real = QUERIES["placebo_in_space"].run(spark, SF)
    assert got.filter("scenario = 'real'").select(real.columns).exceptAll(real).count() == 0


def test_events_cover_the_weeks_of_the_study(spark):
    merged = panel_plans.merged_panel(spark, SF)
    assert merged.filter(F.col("visitors").isNull()).count() <= 0.05 * merged.count()
