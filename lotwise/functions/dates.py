"""Dates and times of day in the spellings that tender data use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(x: Column) -> Column:
    """The first ten characters as 2024-1-31, 31.1.2024 or 31/1/2024; impossible dates are null."""
    s = F.substring(F.trim(x.cast("string")), 1, 10)
    return F.coalesce(F.try_to_date(s, "yyyy-M-d"), F.try_to_date(s, "d.M.yyyy"), F.try_to_date(s, "d/M/yyyy"))


def normal_date(x: Column) -> Column:
    """31.1.2024 anywhere in the text as 2024-01-31, without a calendar check; other text stays."""
    pattern = r"(\d{1,2})\.(\d{1,2})\.(\d{4})"
    part = lambda i: F.regexp_extract(x, pattern, i)
    turned = F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0"))
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(x, 1, 10)).when(x.rlike(pattern), turned).otherwise(x)


def normal_time(x: Column) -> Column:
    """9.05 or 9:05 anywhere in the text as 09:05; null without one."""
    pattern = r"(\d{1,2})[:.](\d{2})"
    return F.when(x.rlike(pattern), F.concat_ws(":", F.lpad(F.regexp_extract(x, pattern, 1), 2, "0"), F.regexp_extract(x, pattern, 2)))


def delivery_date(created: Column, delivery: Column, days: Column) -> Column:
    """The delivery date, or as many days (begun ones count) after creation."""
    return F.coalesce(delivery, F.when(days > 0, F.date_add(created, (days + 0.999999).cast("int"))))
