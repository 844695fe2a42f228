"""Numbering plans and relative dates."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewater.functions import phone, text

NUMBERS = [
    ("+33 (0)1 42 68 53 00", "+33 142685300", "+33 1 42 68 53 00"), ("+44 (0) 20 7946 0958", "+44 2079460958", "+44 20 7946 0958"), ("+49 0151 23456789", "+49 15123456789", "+49 151 234 56789"), ("+34 612 34 56 78", "+34 612345678", "+34 612 34 56 78"),
    ("+39 06 6982 1234", "+39 0669821234", "+39 066 982 1234"), ("+36 06 30 123 4567", "+36 301234567", "+36 30 123 4567"), ("+420 601 123 456", "+420 601123456", "+420 601 123 456"), ("+353 087 123 4567", "+353 871234567", "+353 87 123 4567"), ("+91 98765 43210", "+91 9876543210", "+91 98765 43210"),
    ("+7 8 912 345 67 89", "+7 9123456789", "+7 912 345 67 89"), ("+65 6123 4567", "+65 61234567", "+65 6123 4567"), ("+55 11 91234 5678", "+55 11912345678", "+55 11 91234 5678"), ("+1 310 387 9598", "+1 (310) 387-9598", "+1 (310) 387-9598"), ("310-387-9598", "+1 (310) 387-9598", "+1 (310) 387-9598"),
    ("420601123456", "+420 601123456", "+420 601 123 456"), ("+999 1234567", "+9 991234567", "+9 991234567"), ("+33 12", None, None), ("911", None, None), ("1 (800) FLOWERS", "+1 (800) 356-9377", "+1 (800) 356-9377"), (None, None, None), ("", None, None),
]


def test_numbering_plans(spark):
    rows = spark.createDataFrame([(n,) for n, _, _ in NUMBERS], "n string")
    got = [tuple(r) for r in rows.select(phone.e164(F.col("n"), "e164_formatted"), phone.e164(F.col("n"), "e164_grouped")).collect()]
    assert [(n, *g) for (n, _, _), g in zip(NUMBERS, got)] == NUMBERS


def test_no_code_begins_another():
    assert not [(a, b) for a in phone.PLANS for b in phone.PLANS if a != b and b.startswith(a)]


NOW = dt.datetime(2024, 3, 31, 9, 30)  # a Sunday
WEDNESDAY, SATURDAY = dt.datetime(2024, 5, 15, 8, 0), dt.datetime(2024, 5, 18, 8, 0)
PHRASES = [
    ("now", NOW, NOW), ("Today", NOW, NOW), ("tomorrow", NOW, dt.datetime(2024, 4, 1, 9, 30)), (" Yesterday ", NOW, dt.datetime(2024, 3, 30, 9, 30)), ("3 days ago", NOW, dt.datetime(2024, 3, 28, 9, 30)), ("in two  weeks", NOW, dt.datetime(2024, 4, 14, 9, 30)), ("a month ago", NOW, dt.datetime(2024, 2, 29, 9, 30)),
    ("an hour from now", NOW, dt.datetime(2024, 3, 31, 10, 30)), ("90 minutes ago", NOW, dt.datetime(2024, 3, 31, 8, 0)), ("1 year later", NOW, dt.datetime(2025, 3, 31, 9, 30)), ("last month", NOW, dt.datetime(2024, 2, 29, 9, 30)), ("next week", NOW, dt.datetime(2024, 4, 7, 9, 30)), ("past year", NOW, dt.datetime(2023, 3, 31, 9, 30)),
    ("this week", WEDNESDAY, dt.datetime(2024, 5, 12, 8, 0)), ("this month", WEDNESDAY, dt.datetime(2024, 5, 1, 8, 0)), ("this day", WEDNESDAY, WEDNESDAY), ("friday", WEDNESDAY, dt.datetime(2024, 5, 17, 12)), ("monday", WEDNESDAY, dt.datetime(2024, 5, 13, 12)), ("Wed", WEDNESDAY, dt.datetime(2024, 5, 15, 12)),
    ("last friday", WEDNESDAY, dt.datetime(2024, 5, 10, 12)), ("last wednesday", WEDNESDAY, dt.datetime(2024, 5, 8, 12)), ("next friday", WEDNESDAY, dt.datetime(2024, 5, 24, 12)), ("next monday", WEDNESDAY, dt.datetime(2024, 5, 20, 12)), ("this tuesday", WEDNESDAY, dt.datetime(2024, 5, 21, 12)), ("next sunday", SATURDAY, dt.datetime(2024, 5, 26, 12)),
    ("next saturday", SATURDAY, dt.datetime(2024, 5, 25, 12)), ("next monday", NOW, dt.datetime(2024, 4, 1, 12)), ("next sunday", NOW, dt.datetime(2024, 4, 7, 12)), ("soon", NOW, None), ("3 ago", NOW, None), ("days ago", NOW, None), ("last", NOW, None), ("", NOW, None), (None, NOW, None), ("99999 days ago", NOW, None),
]


def test_relative_dates(spark):
    rows = spark.createDataFrame([(k, p, now) for k, (p, now, _) in enumerate(PHRASES)], "k int, p string, now timestamp")
    got = dict(rows.select("k", F.date_format(text.relative_date(F.col("p"), F.col("now")), "yyyy-MM-dd HH:mm")).collect())
    assert [(p, got[k]) for k, (p, _, _) in enumerate(PHRASES)] == [(p, w and w.strftime("%Y-%m-%d %H:%M")) for p, _, w in PHRASES]


@pytest.mark.parametrize("style,wanted", [("iso", "2024-03-29T09:30:00.000Z"), ("date", "2024-03-29"), ("timestamp", 1711704600000), ("components", (2024, 3, 29))])
def test_styles(spark, style, wanted):
    row = spark.createDataFrame([("2 days ago", NOW)], "p string, now timestamp").select(text.parse_date(F.col("p"), style, F.col("now"))).first()
    assert row[0] == wanted
