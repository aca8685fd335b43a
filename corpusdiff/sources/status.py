"""Extraction status, counts and display of pages and issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRINGS = "array<string>"
EMPTY_BODY = "Article body text was empty"
# Fixed value: the display text of the empty-body warning.
EMPTY_BODY_DISPLAY = "一部記事は本文抽出不可。タイトル・版面・参照ボタンのみ表示しています。"


def extract_status(has_items: Column, errors: Column, warnings: Column) -> Column:
    problems = (F.size(errors) > 0) | (F.size(warnings) > 0)
    return (
        F.when(has_items & problems, F.lit("partial"))
        .when(has_items, F.lit("ok"))
        .when(F.size(errors) > 0, F.lit("failed"))
        .otherwise(F.lit("empty"))
    )


def issue_status(requested: Column, returned: Column, articles: Column, failed: Column, errors: Column, warnings: Column) -> Column:
    """``errors`` and ``warnings`` are counts here."""
    return (
        F.when(requested == 0, F.lit("empty"))
        .when((returned == 0) & (failed > 0), F.lit("failed"))
        .when((articles == 0) & (errors > 0), F.lit("failed"))
        .when(articles == 0, F.lit("empty"))
        .when((failed > 0) | (errors > 0) | (warnings > 0), F.lit("partial"))
        .otherwise(F.lit("ok"))
    )


def with_extraction_info(articles: DataFrame, parser: str) -> DataFrame:
    """Status, parser, errors and warnings of each article; an empty body is a warning."""
    empty = F.coalesce(F.col("analysis_text"), F.lit("")) == ""
    none = F.array().cast(STRINGS)
    return articles.withColumn(
        "extraction",
        F.struct(
            F.when(empty, F.lit("empty")).otherwise(F.lit("ok")).alias("status"),
            F.lit(parser).alias("parser"),
            none.alias("errors"),
            F.when(empty, F.array(F.lit(EMPTY_BODY))).otherwise(none).alias("warnings"),
        ),
    )


def page_counts(pages: DataFrame, articles: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Counts per (source, issue_date, page_number). ``pages`` carry ``status`` and message counts of their own."""
    key = ["source", "issue_date", "page_number"]
    per_page = articles.groupBy(*key).agg(
        F.count("*").alias("articles"),
        F.count_if(F.col("extraction.status") == "failed").alias("failed_articles"),
        F.count_if(F.col("extraction.status") == "empty").alias("empty_articles"),
        F.sum(F.size("extraction.errors")).alias("errors"),
        F.sum(F.size("extraction.warnings")).alias("warnings"),
    )
    out = pages.select(*key).distinct().join(per_page, key, "left")
    if regions is not None:
        out = out.join(regions.groupBy(*key).agg(F.count("*").alias("regions")), key, "left")
    return out.na.fill(0)


def page_status(counts: DataFrame) -> DataFrame:
    """Status of each page from its counts; a page without articles is warned about."""
    has, errors = F.col("articles") > 0, F.col("errors") > 0
    return counts.withColumn("warnings", F.col("warnings") + F.when(has, 0).otherwise(1)).withColumn(
        "status",
        F.when(has & (errors | (F.col("warnings") > 0)), F.lit("partial"))
        .when(has, F.lit("ok"))
        .when(errors, F.lit("failed"))
        .otherwise(F.lit("empty")),
    )


def issue_counts(pages: DataFrame) -> DataFrame:
    """Counts and status per (source, issue_date) from the page rows of :func:`page_status`."""
    failed = F.count_if(F.col("status") == "failed")
    totals = pages.groupBy("source", "issue_date").agg(
        F.count("*").alias("requested_pages"),
        F.count("*").alias("all_pages"),
        failed.alias("failed_pages"),
        F.sum("articles").alias("articles"),
        F.sum("failed_articles").alias("failed_articles"),
        F.sum("empty_articles").alias("empty_articles"),
        F.sum("errors").alias("errors"),
        F.sum("warnings").alias("warnings"),
    )
    returned = F.when(F.col("failed_pages") == F.col("all_pages"), F.lit(0)).otherwise(F.col("all_pages"))
    return totals.withColumn("pages", returned).withColumn(
        "status",
        issue_status(*[F.col(c) for c in ("requested_pages", "pages", "articles", "failed_pages", "errors", "warnings")]),
    ).drop("all_pages")


def materialize_pages(pages: DataFrame, wanted: DataFrame, missing_status: str = "empty") -> DataFrame:
    """Every wanted (source, issue_date, page_number) as a row; absent ones become placeholders."""
    key = ["source", "issue_date", "page_number"]
    name = F.concat(F.lit("第"), F.lpad(F.col("page_number").cast("string"), 2, "0"), F.lit("版"))
    return (
        wanted.select(*key).distinct().join(pages, key, "left")
        .withColumn("placeholder", F.col("status").isNull())
        .withColumn("status", F.coalesce("status", F.lit(missing_status)))
        .withColumn("page_name", F.coalesce("page_name", name))
    )


def display_extraction(df: DataFrame) -> DataFrame:
    """Display status and message from an ``extraction`` struct."""
    messages = F.transform(
        F.concat("extraction.errors", "extraction.warnings"),
        lambda m: F.when(m == EMPTY_BODY, F.lit(EMPTY_BODY_DISPLAY)).otherwise(m),
    )
    status = F.when(F.col("extraction.status") == "ok", F.lit("success")).otherwise(F.col("extraction.status"))
    return df.withColumn(
        "display",
        F.struct(
            status.alias("status"), F.col("extraction.parser").alias("method"),
            F.nullif(F.array_join(F.array_distinct(messages), " / "), F.lit("")).alias("message"),
        ),
    )
