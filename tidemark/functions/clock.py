"""Windows of 15 minutes from an origin, and session times in UTC (SCA-06..12)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORIGIN, SECONDS, PER_DAY = "2024-01-01", 900, 96


def window_of(ts: Column, origin: str = ORIGIN) -> Column:
    """floor((ts - origin) / 900 s); negative before the origin."""
    return F.floor(F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit(origin + " 00:00:00")), ts.cast("timestamp_ntz")) / (SECONDS * 1e6)).cast("long")


def window_start(window: Column, origin: str = ORIGIN) -> Column:
    return F.timestamp_add("SECOND", (window * SECONDS).cast("int"), F.to_timestamp_ntz(F.lit(origin + " 00:00:00")))


def fit_cutoff(window: Column) -> Column:
    """First window of the day that holds it: what is fitted through the day before applies from here on."""
    return F.floor(window / PER_DAY).cast("long") * PER_DAY


def hour_of_week(ts: Column) -> Column:
    """0 is Monday's first hour, UTC."""
    return F.weekday(ts) * 24 + F.hour(ts)


def ingested(observed: Column, lag_minutes: int = 15) -> Column:
    return F.timestamp_add("MINUTE", F.lit(lag_minutes), observed)


def parse_stamp(text: Column) -> Column:
    """14 digits as a UTC time; null for anything else."""
    return F.when(text.rlike("^[0-9]{14}$"), F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")))


def session_open_utc(day: Column, venue: Column, early: Column) -> Column:
    """Earliest session start in UTC: Amsterdam 09:00, else New York 04:00 if early, 09:30 if not."""
    at = lambda hhmm, zone: F.to_utc_timestamp(F.to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(f" {hhmm}:00"))), zone)
    return F.when(venue == "AS", at("09:00", "Europe/Amsterdam")).when(early, at("04:00", "America/New_York")).otherwise(at("09:30", "America/New_York"))
