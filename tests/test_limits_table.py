"""The sliding count of events against its SQL, at fractions of a second."""

import duckdb

from lodestar.plans import evaluation


def test_rate_limit_rounds_seconds_as_its_sql_does(spark, tmp_path):
    # A day less half a second: rounding the first up and the last down keeps it in the window, cutting both off doesn't.
    day = "2024-01-{:02d} 00:00:{}"
    times = [day.format(1, "10.6"), day.format(1, "20.5"), day.format(1, "21.5"), day.format(2, "10.4"), day.format(2, "20.5"), day.format(2, "21.5"), day.format(2, "22.5")]
    con = duckdb.connect()
    con.sql("create table events (event_id bigint, user_id bigint, ts timestamp)")
    con.executemany("insert into events values (?, 1, ?)", [(i, t) for i, t in enumerate(times)])
    con.sql(f"copy events to '{tmp_path}/events.parquet'")
    got = sorted(tuple(r) for r in evaluation.rate_limit(spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(evaluation.RATE_SQL).fetchall()) and got
