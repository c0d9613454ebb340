"""Rows after the day of a report change nothing in it."""

from datetime import date

from souklens.operators import engagement, ranking

AS_OF = date(2000, 6, 30)


def rows_of(df):
    return sorted(map(repr, df.collect()))


def bookings(spark, rows):
    return spark.createDataFrame(rows, "activity_id long, supplier_id long, line_id long, customer_id long, booking_id long, status_id int, checkout_date date, gmv double, nr double, tickets double")


BEFORE = [(1, 1, 1, 7, 10, 1, date(2000, 6, 1), 10.0, 1.0, 2.0), (1, 1, 1, 7, 11, 1, date(2000, 6, 30), 20.0, 2.0, 1.0), (1, 1, 1, 8, 12, 1, date(1999, 3, 1), 5.0, 0.5, 1.0),
          (2, 2, 2, 8, 13, 1, date(1999, 12, 1), 7.0, 0.7, 1.0)]
AFTER = [(1, 1, 1, 7, 20, 1, date(2000, 7, 1), 99.0, 9.0, 9.0), (1, 1, 1, 8, 21, 1, date(2001, 1, 1), 99.0, 9.0, 9.0), (2, 2, 2, 8, 22, 1, date(2000, 7, 2), 99.0, 9.0, 9.0)]


def test_trailing_performance(spark):
    run = lambda rows: ranking.trailing_performance(bookings(spark, rows), ["activity_id", "supplier_id"], AS_OF)
    got = run(BEFORE + AFTER)
    assert rows_of(got) == rows_of(run(BEFORE))
    one = got.filter("activity_id = 1").first()
    assert one["bookings_l3m"] == 2 and one["bookings_lifetime"] == 3 and one["days_since_last_booking"] == 0


def test_relevant_entities(spark):
    days = lambda rows: spark.createDataFrame(rows, "supplier_id long, activity_id long, day date, is_online boolean")
    before = [(1, 1, date(2000, 1, 1), True), (2, 2, date(2000, 1, 1), False)]
    after = [(2, 2, date(2000, 7, 5), True), (3, 3, date(2000, 7, 5), True)]
    run = lambda b, d: engagement.relevant_entities(bookings(spark, b), days(d), AS_OF)
    assert rows_of(run(BEFORE + AFTER, before + after)) == rows_of(run(BEFORE, before)) != []


def test_later_resolutions_leave_actions_open(spark):
    rows = [(1, "a", date(2000, 6, 1), "resolved", date(2000, 7, 9)), (1, "a", date(2000, 6, 1), "resolved", date(2000, 6, 9)), (2, "a", date(2000, 7, 1), "active", None)]
    actions = spark.createDataFrame(rows, "supplier_id long, action_type string, surfaced_at date, status string, resolved_at date")
    got = engagement.surfaced(actions, date(2000, 1, 1), AS_OF)
    assert sorted((r["status"], r["resolved_at"]) for r in got.collect() if r["status"] == "resolved") == [("resolved", date(2000, 6, 9))]
    assert got.count() == 2 and engagement.status_funnel(got, []).first()["resolved"] == 1
