"""Feed JSON: one document per issue, pages and articles nested in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusdiff.functions import text as t
from corpusdiff.session import pin
from corpusdiff.sources.html import DEFAULT_TITLE, coordinate_pairs

ITEM = "struct<id:string,title:string,title2:string,content:string,point:array<string>,type:string>"
PAGE = (
    "struct<paperBk:string,paperImg:string,paperName:string,paperNumber:string,paperPDF:string,webUrl:string,"
    f"xyList:array<{ITEM}>>"
)
FEED = f"paperInfo array<{PAGE}>, _corrupt string"


def scan_feed(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed file with its whole text."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file_name"),
        F.to_date(F.try_to_timestamp(F.regexp_extract("_metadata.file_name", "(\\d{4}-\\d{2}-\\d{2})", 1))).alias("issue_date"),
        F.col("value").alias("json"),
    )


def parse_feed(df: DataFrame) -> DataFrame:
    """Adds ``feed`` and ``failed``. Text that is no JSON object fails the issue, not the job."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = pin(df.withColumn("feed", F.from_json("json", FEED, options)))
    return parsed.withColumn("failed", F.col("feed").isNull() | F.col("feed._corrupt").isNotNull())


def feed_pages(df: DataFrame, wanted: tuple[int, ...] | None = None) -> DataFrame:
    """Pages with a readable number; ``item`` still holds the article list."""
    pages = df.filter("NOT failed").select("issue_date", F.posexplode("feed.paperInfo").alias("page_pos", "page"))
    label = t.string_value("page.paperNumber")
    out = pages.withColumn("page_number", t.parse_int(label)).filter("page_number IS NOT NULL")
    if wanted is not None:
        out = out.filter(F.col("page_number").isin(list(wanted)))
    return out.select(
        "issue_date",
        "page_pos",
        "page_number",
        F.coalesce(t.string_value("page.paperBk"), F.concat(F.lit("第"), label, F.lit("版"))).alias("page_name"),
        t.string_value("page.webUrl").alias("url"),
        t.string_value("page.paperPDF").alias("pdf_url"),
        t.string_value("page.paperImg").alias("image_url"),
        F.col("page.xyList").alias("items"),
    )


def feed_region(points):
    """Polygon of a feed item, null without points."""
    found = coordinate_pairs(F.flatten(F.transform(points, lambda p: F.split(p, ","))))
    return F.when(
        F.size(found) > 0,
        F.struct(F.lit("percent").alias("unit"), F.lit("polygon").alias("shape"), found.alias("points")),
    )


def feed_articles(pages: DataFrame, source: str, excerpt_chars: int = 180) -> DataFrame:
    """One row per article; items with neither title nor content are left out."""
    items = pages.select(
        "issue_date", "page_number", "page_name", F.posexplode("items").alias("item_pos", "item")
    )
    title, content = t.string_value("item.title"), t.string_value("item.content")
    text = t.paragraph_text(F.coalesce(content, F.lit("")))
    kept = pin(items.filter(title.isNotNull() | content.isNotNull()).withColumn("text", text))
    own_id = F.concat_ws("-", F.col("issue_date").cast("string"), "page_number", "item_pos")
    return kept.select(
        F.concat(F.lit(f"{source}:"), F.coalesce(t.string_value("item.id"), own_id)).alias("id"),
        F.lit(source).alias("source"),
        "issue_date",
        "page_number",
        "page_name",
        F.col("item_pos").cast("long").alias("pos"),
        F.coalesce(title, F.lit(DEFAULT_TITLE)).alias("title"),
        t.string_value("item.title2").alias("subtitle"),
        F.col("text").alias("analysis_text"),
        t.excerpt("text", excerpt_chars).alias("excerpt"),
        feed_region(F.col("item.point")).alias("layout_region"),
    )


def feed_issue_status(df: DataFrame, articles: DataFrame) -> DataFrame:
    """Per issue: failed when the text was no JSON, otherwise by articles and their warnings."""
    counts = articles.groupBy("issue_date").agg(
        F.count("*").alias("articles"), F.count_if(F.col("analysis_text") == "").alias("empty_articles")
    )
    joined = df.select("issue_date", "failed").join(counts, "issue_date", "left").na.fill(0, ["articles", "empty_articles"])
    return joined.withColumn(
        "status",
        F.when(F.col("failed"), F.lit("failed"))
        .when(F.col("articles") == 0, F.lit("empty"))
        .when(F.col("empty_articles") > 0, F.lit("partial"))
        .otherwise(F.lit("ok")),
    )
