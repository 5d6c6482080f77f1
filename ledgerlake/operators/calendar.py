"""Calendars: the date dimension and month scaffolds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def date_dimension(dates: DataFrame) -> DataFrame:
    """Every day from the first of the first month to the last of the last month of column date."""
    bounds = dates.agg(F.trunc(F.min("date"), "MM").alias("a"), F.last_day(F.max("date")).alias("b")).where("a is not null")
    days = bounds.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date"))
    return days.select(
        "date",
        F.trunc("date", "MM").alias("month_start"),
        F.year("date").cast("long").alias("year_number"),
        F.quarter("date").cast("long").alias("quarter_number"),
        F.month("date").cast("long").alias("month_number"),
        F.date_format("date", "MMMM").alias("month_name"),
        F.day("date").cast("long").alias("day_number"),
        F.date_format("date", "EEEE").alias("day_name"),
        F.date_format("date", "yyyy-MM").alias("month_label"),
        F.dayofweek("date").isin(1, 7).alias("is_weekend"),
        F.concat(F.year("date").cast("string"), F.lit("-Q"), F.quarter("date").cast("string")).alias("year_quarter"),
    )


def months_from(first, last):
    """Array of month starts from one column to another, both included; empty if last is earlier."""
    return F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))
