"""Schedules: next times of one-off, interval and cron rules; what is due; retention."""

from __future__ import annotations

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far ahead a cron rule is searched: a leap day comes within eight years.
HORIZON_DAYS = 366 * 8


def _values(field: str, low: int, high: int) -> set[int]:
    """The numbers that a cron field names; empty for one it can't read."""
    out: set[int] = set()
    for part in field.split(","):
        base, _, step = part.partition("/")
        lo, _, hi = base.partition("-")
        if base == "*":
            lo, hi = str(low), str(high)
        elif not hi:
            hi = str(high) if step else lo
        if not (lo.isdigit() and hi.isdigit() and (step.isdigit() or not step)):
            return set()
        out |= set(range(int(lo), int(hi) + 1, int(step or 1) or 1))
    return {v for v in out if low <= v <= high}


def next_cron(rule: str, after: datetime) -> datetime | None:
    """The first minute after this time that the five fields allow; days of month and week are alternatives where both are given. None for a rule that can't be read or never comes."""
    parts = (rule or "").split()
    if len(parts) != 5:
        return None
    minutes, hours, months = _values(parts[0], 0, 59), _values(parts[1], 0, 23), _values(parts[3], 1, 12)
    last_day = parts[2] == "L"
    days, weekdays = set() if last_day else _values(parts[2], 1, 31), {v % 7 for v in _values(parts[4], 0, 7)}
    if not (minutes and hours and months and weekdays and (days or last_day)):
        return None
    start = (after + timedelta(minutes=1)).replace(second=0, microsecond=0)
    for k in range(HORIZON_DAYS):
        day = start.date() + timedelta(days=k)
        by_month = (day + timedelta(days=1)).day == 1 if last_day else day.day in days
        by_week = (day.weekday() + 1) % 7 in weekdays
        fits = by_month or by_week if parts[2] != "*" and parts[4] != "*" else by_month and by_week
        if day.month not in months or not fits:
            continue
        for h in sorted(hours):
            for m in sorted(minutes):
                at = datetime(day.year, day.month, day.day, h, m)
                if at >= start:
                    return at
    return None


def next_fire(schedules: DataFrame) -> DataFrame:
    """schedules (mode, rule, interval_seconds, start_at, end_at, after, fire_count, max_fire_count, zone) with next_at, in UTC; times are UTC instants without a zone.

    once: at the start, or at once when that is over, never a second time. interval: the first multiple from the
    start after `after`. cron: in the schedule's zone. None past the end or after the last firing.
    """
    zone = F.coalesce("zone", F.lit("UTC"))
    local = lambda c: F.from_utc_timestamp(F.col(c), zone)
    base = F.greatest(local("after"), local("start_at"))

    @F.pandas_udf("timestamp_ntz")
    def cron(rule: pd.Series, at: pd.Series, inclusive: pd.Series) -> pd.Series:
        back = lambda t, same: t.to_pydatetime() - timedelta(minutes=1) if same and not t.second and not t.microsecond else t.to_pydatetime()
        return pd.to_datetime(pd.Series([next_cron(r, back(t, same)) for r, t, same in zip(rule, at, inclusive)]))

    seconds = F.expr("timestampdiff(SECOND, start_at, after)")
    steps = F.floor(seconds / F.col("interval_seconds")) + 1
    by_interval = F.when(F.col("after") <= F.col("start_at"), F.col("start_at")).otherwise(F.col("start_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (steps * F.col("interval_seconds")).cast("decimal(18,6)")))
    by_cron = F.to_utc_timestamp(cron("rule", base.cast("timestamp_ntz"), F.col("after") <= F.col("start_at")), zone).cast("timestamp_ntz")
    plain = F.when((F.col("mode") == "once") & (F.col("fire_count") == 0), F.greatest("start_at", "after")).when(F.col("mode") == "interval", by_interval)
    # only cron rules go to Python
    is_cron = F.coalesce(F.col("mode") == "cron", F.lit(False))
    out = schedules.where(is_cron).withColumn("next_at", by_cron).unionByName(schedules.where(~is_cron).withColumn("next_at", plain))
    over = F.coalesce(F.col("fire_count") >= F.col("max_fire_count"), F.lit(False))
    return out.withColumn("next_at", F.when(~over & (F.col("end_at").isNull() | (F.col("next_at") <= F.col("end_at"))), F.col("next_at")))


def due_for_summary(last: Column, interval: Column, changed: Column, now: Column) -> Column:
    """Never summarised; or the interval (null: never due) has passed and documents changed since, or nobody knows when they did."""
    passed = now >= last + interval
    return F.when(interval.isNull(), False).when(last.isNull(), True).otherwise(passed & (changed.isNull() | (changed > last)))


def materialise(schedules: DataFrame, active: DataFrame, now: Column, key: str = "schedule_id") -> DataFrame:
    """The schedules that are due and have no active run (key)."""
    return schedules.where(F.col("next_at") <= now).join(active.select(key).distinct(), key, "left_anti")


def retained(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows that are not older than so many days."""
    return rows.where(F.col(at) >= now - F.make_dt_interval(F.lit(days)))
