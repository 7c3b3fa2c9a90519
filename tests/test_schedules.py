"""Next times on small cases."""

from datetime import datetime as D

import pytest

from tideglass.operators import schedules as S


@pytest.mark.parametrize(
    ("rule", "after", "at"),
    [
        ("*/15 * * * *", D(2024, 1, 1, 10, 15), D(2024, 1, 1, 10, 30)), ("0 9 * * 1-5", D(2024, 1, 5, 9, 0), D(2024, 1, 8, 9, 0)), ("0 0 L * *", D(2024, 2, 1), D(2024, 2, 29)), ("0 0 29 2 *", D(2024, 3, 1), D(2028, 2, 29)),
        ("0 0 13 * 5", D(2024, 1, 1), D(2024, 1, 5)), ("5 4 * * 7", D(2024, 1, 1), D(2024, 1, 7, 4, 5)), ("0 0 31 2 *", D(2024, 1, 1), None), ("bad", D(2024, 1, 1), None), ("x * * * *", D(2024, 1, 1), None),
    ],
)
def test_next_cron(rule, after, at):
    assert S.next_cron(rule, after) == at


def test_next_fire(spark):
    start, late = D(2024, 1, 1, 8), D(2024, 1, 1, 10, 30)
    rows = [
        (0, "once", None, None, start, None, late, 0, None, None, late), (1, "once", None, None, start, None, late, 1, None, None, None), (2, "interval", None, 3600, start, None, late, 5, None, None, D(2024, 1, 1, 11)),
        (3, "interval", None, 3600, start, D(2024, 1, 1, 10, 59), late, 5, None, None, None), (4, "interval", None, 3600, late, None, start, 0, None, None, late), (5, "interval", None, 3600, start, None, late, 5, 5, None, None),
        (6, "cron", "0 9 * * *", None, start, None, late, 0, None, "Asia/Shanghai", D(2024, 1, 2, 1)), (7, "cron", "0 8 * * *", None, start, None, start, 0, None, None, start), (8, "cron", "0 8 * * *", None, start, None, late, 0, None, None, D(2024, 1, 2, 8)),
    ]
    kind = "id int, mode string, rule string, interval_seconds int, start_at timestamp_ntz, end_at timestamp_ntz, after timestamp_ntz, fire_count int, max_fire_count int, zone string, want timestamp_ntz"
    got = S.next_fire(spark.createDataFrame(rows, kind)).collect()
    assert {r["id"]: r["next_at"] for r in got} == {r["id"]: r["want"] for r in got}
