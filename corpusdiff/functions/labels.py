"""Display labels and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fmt_date(c: Column) -> Column:
    return F.date_format(c, "yyyy.MM.dd")


def fmt_date_range(start: Column, end: Column) -> Column:
    return F.when(start == end, fmt_date(start)).otherwise(F.concat(fmt_date(start), F.lit(" - "), fmt_date(end)))


def fmt_percent(c: Column) -> Column:
    return F.concat(F.floor(c * 100 + 0.5).cast("int").cast("string"), F.lit("%"))


def confidence_tone(c: Column) -> Column:
    return F.when(c >= 0.85, F.lit("高")).when(c >= 0.7, F.lit("中")).otherwise(F.lit("低"))


def page_level(page: Column) -> Column:
    return F.when(page == 1, 4).when(page <= 3, 3).when(page <= 7, 2).otherwise(1)


def page_level_label(page: Column) -> Column:
    return F.when(page == 1, F.lit("一面")).when(page <= 3, F.lit("高")).when(page <= 7, F.lit("中")).otherwise(F.lit("低"))


def with_label(df: DataFrame, labels: DataFrame, kind: str, column: str, to: str) -> DataFrame:
    """Label of a code, the code itself where none is known."""
    known = labels.filter(F.col("kind") == kind).select(F.col("code").alias(column), F.col("label").alias(to))
    return df.join(known, column, "left").withColumn(to, F.coalesce(to, column))
