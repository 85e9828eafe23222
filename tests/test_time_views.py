"""Roll-ups by time: sessions that repeat, and a plan that groups no wide rows."""

import datetime as dt

from marginalia.operators import views

AT = dt.datetime(2024, 3, 1)


def test_papers_and_subjects_are_told_apart_where_sessions_repeat(spark):
    sessions = spark.createDataFrame([(1, 7, "a"), (1, 7, "b"), (1, 8, "a"), (2, 7, "a"), (3, None, None), (3, None, "c"), (4, 9, "d"), (None, 7, "e")], "id long, user_id long, subject string")
    times = spark.createDataFrame([(1, AT), (1, AT + dt.timedelta(days=1)), (1, AT + dt.timedelta(days=40)), (2, AT), (3, AT), (5, AT), (None, AT)], "session_id long, created_at timestamp")
    found = views.by_time(times, sessions, "month")
    got = {(r.user_id, r.time_label): (r.error_count, r.subject_count, r.paper_count, (r.end_ts - r.start_ts).days) for r in found.collect()}
    assert got == {
        (7, "2024-03"): (5, 2, 2, 1), (7, "2024-04"): (2, 2, 1, 0), (8, "2024-03"): (2, 1, 1, 1), (8, "2024-04"): (1, 1, 1, 0), (None, "2024-03"): (2, 1, 1, 0),
    }


def test_no_rows_are_expanded_and_no_struct_is_sorted(spark):
    from marginalia.plans.domain import Domain
    from marginalia.plans.views import drilldown, errors_by_month, errors_by_semester, errors_by_year

    d = Domain(spark, "/root/testdata/sf0.001")
    for view in (errors_by_year, errors_by_month, errors_by_semester, drilldown):
        plan = view(d)
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in text and "SortAggregate" not in text
