"""Articles, links and regions out of landed page HTML, in bulk."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusdiff.functions import text as t
from corpusdiff.session import pin

SHAPES = ("polygon", "rect", "circle")
DEFAULT_TITLE = "Untitled article"
POINTS = "array<struct<x:double,y:double>>"


def scan_html(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages; only the columns used later are read from the files."""
    return spark.read.parquet(path)


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def tag_text(html: Column, tag: str) -> Column:
    return F.nullif(t.strip_html(_first(html, f"(?i)<{tag}\\b[^>]*>([\\s\\S]*?)</{tag}>")), F.lit(""))


def prop(html: Column, name: str) -> Column:
    return F.nullif(t.strip_html(_first(html, f"(?i)<{name}>([\\s\\S]*?)</{name}>")), F.lit(""))


def tag_by_id(html: Column, element_id: str) -> Column:
    pattern = f"(?i)<([a-zA-Z0-9]+)\\b[^>]*\\bid=[\"']{element_id}[\"'][^>]*>([\\s\\S]*?)</\\1>"
    return F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 2))


def tag_by_class(html: Column, tag: str, name: str) -> Column:
    pattern = f"(?i)<{tag}\\b[^>]*\\bclass=[\"'][^\"']*\\b{name}\\b[^\"']*[\"'][^>]*>([\\s\\S]*?)</{tag}>"
    return F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 1))


def attr(html: Column, name: str) -> Column:
    pattern = f"(?i)\\b{name}\\s*=\\s*([\"'])(.*?)\\1"
    return F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 2))


@F.pandas_udf(T.StringType())
def resolve_url(href: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([None if h is None else urljoin(b or "", h) for h, b in zip(href, base)], dtype=object)


def page_name(html: Column, number: Column) -> Column:
    """Name in the "page N: name" heading of this page number, else a generated one."""
    pattern = F.lit("第\\s*0?(\\d{1,2})\\s*版[：:]\\s*([^<\\n\\r]+)")
    numbers = F.regexp_extract_all(html, pattern, F.lit(1))
    names = F.regexp_extract_all(html, pattern, F.lit(2))
    zipped = F.filter(F.arrays_zip(numbers.alias("n"), names.alias("name")), lambda s: s["n"].cast("int") == number)
    found = F.nullif(t.normalize_ws(F.get(zipped, F.lit(0))["name"]), F.lit(""))
    return F.coalesce(found, F.concat(F.lit("第"), F.lpad(number.cast("string"), 2, "0"), F.lit("版")))


def coordinate_pairs(values: Column) -> Column:
    """Consecutive values as points; a pair with something that is no number is skipped."""

    def number(i: Column) -> Column:
        return _first(F.get(values, i), "^\\s*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)").try_cast("double")

    starts = F.when(F.size(values) >= 2, F.sequence(F.lit(0), F.size(values) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    points = F.transform(starts, lambda i: F.struct(number(i).alias("x"), number(i + 1).alias("y")))
    return F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull()).cast(POINTS)


def layout_regions(pages: DataFrame) -> DataFrame:
    """``(page_id, pos, href, unit, shape, points)``, one row per image-map area with link and coordinates."""
    areas = pages.select(
        "page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit("(?i)<area\\b([^>]+)>"), F.lit(1))).alias("pos", "a")
    )
    shape = F.lower(attr(F.col("a"), "shape"))
    found = areas.select(
        "page_id", "pos", "url", F.nullif(attr(F.col("a"), "href"), F.lit("")).alias("href"),
        F.nullif(attr(F.col("a"), "coords"), F.lit("")).alias("coords"),
        F.when(shape.isin(*SHAPES), shape).otherwise(F.lit("unknown")).alias("shape"),
    ).filter("href IS NOT NULL AND coords IS NOT NULL")
    return found.select(
        "page_id", "pos", resolve_url("href", "url").alias("href"), F.lit("px").alias("unit"), "shape",
        coordinate_pairs(F.split("coords", ",")).alias("points"),
    )


def titled_links(pages: DataFrame, list_html: Column) -> DataFrame:
    """``(page_id, pos, link_url, title)`` of the links inside a fragment."""
    pattern = "(?i)<a\\b([^>]+)>([\\s\\S]*?)</a>"
    anchors = pages.withColumn("list_", list_html).select(
        "page_id", "url",
        F.posexplode(
            F.arrays_zip(
                F.regexp_extract_all("list_", F.lit(pattern), F.lit(1)).alias("attrs"),
                F.regexp_extract_all("list_", F.lit(pattern), F.lit(2)).alias("body"),
            )
        ).alias("pos", "a"),
    )
    return (
        anchors.select("page_id", "pos", "url", F.nullif(attr(F.col("a.attrs"), "href"), F.lit("")).alias("href"), t.strip_html("a.body").alias("title"))
        .filter("href IS NOT NULL")
        .select("page_id", "pos", resolve_url("href", "url").alias("link_url"), "title")
    )


def is_editorial_credit(title: Column) -> Column:
    return F.coalesce(t.normalize_ws(title).rlike("(?:^|[一二三四五六七八九十0-9])版责编[：:]"), F.lit(False))


def merge_links(regions: DataFrame, titled: DataFrame) -> DataFrame:
    """Region links and titled links by address: the later one of each kind wins, a titled link keeps the region."""
    areas = regions.withColumnRenamed("href", "link_url").groupBy("page_id", "link_url").agg(
        F.max_by(F.struct("unit", "shape", "points"), "pos").alias("region"), F.min("pos").alias("region_pos")
    )
    titles = titled.groupBy("page_id", "link_url").agg(
        F.max_by("title", "pos").alias("title"), F.min("pos").alias("title_pos")
    )
    links = areas.join(titles, ["page_id", "link_url"], "full_outer")
    return links.filter(~is_editorial_credit(F.col("title")))


def article_links(pages: DataFrame, list_html: Column | None = None) -> DataFrame:
    if list_html is None:
        list_html = F.coalesce(tag_by_class(F.col("html"), "ul", "news-list"), F.lit(""))
    return merge_links(layout_regions(pages), titled_links(pages, list_html))


def page_image(html: Column, base: Column, map_name: str = "PagePicMap") -> Column:
    img = _first(html, f"(?i)(<img\\b[^>]*\\busemap\\s*=\\s*[\"']?#{map_name}[\"']?[^>]*>)")
    return resolve_url(attr(img, "src"), base)


def first_href(html: Column, base: Column, pattern: str = "(?i)\\.pdf(?:[\"?#]|$)") -> Column:
    hrefs = F.regexp_extract_all(html, F.lit("(?i)href\\s*=\\s*[\"']([^\"']+)[\"']"), F.lit(1))
    return resolve_url(F.get(F.filter(hrefs, lambda h: h.rlike(pattern)), F.lit(0)), base)


def article_body(html: Column) -> Column:
    """The first container present: comment-marked body, then the two id containers."""
    marked = t.between(html, "<!--enpcontent-->", "<!--/enpcontent-->")
    return F.coalesce(marked, tag_by_id(html, "ozoom"), tag_by_id(html, "articleContent"), F.lit(""))


def parse_articles(pages: DataFrame, body: Column | None = None, fallback_title: Column | None = None, excerpt_chars: int = 180) -> DataFrame:
    """Title, subtitle, author, text and excerpt of each landed article page."""
    html = F.col("html")
    titles = [tag_text(html, "h1"), prop(html, "title"), tag_text(html, "title")]
    if fallback_title is not None:
        titles.append(fallback_title)
    parsed = pages.select(
        *[c for c in pages.columns if c != "html"],
        F.coalesce(*titles, F.lit(DEFAULT_TITLE)).alias("title"),
        F.coalesce(tag_text(html, "h2"), prop(html, "subtitle")).alias("subtitle"),
        prop(html, "author").alias("author"),
        t.paragraph_text(article_body(html) if body is None else body).alias("analysis_text"),
    )
    return pin(parsed).withColumn("excerpt", t.excerpt("analysis_text", excerpt_chars))


def article_id(source: str, url: Column) -> Column:
    return F.concat(F.lit(f"{source}:"), F.coalesce(_first(url, "(?i)content_([0-9]+)\\.html"), url))


def page_id(source: str, issue_date: Column, number: Column) -> Column:
    return F.concat(F.lit(f"{source}:"), issue_date.cast("string"), F.lit(":p"), F.lpad(number.cast("string"), 2, "0"))


def url_from_template(template: str, issue_date: Column, number: Column | None = None, item: Column | None = None) -> Column:
    """Fill ``{yyyy} {MM} {dd} {date} {page} {item}`` of an address template."""
    out = F.lit(template)
    values = {
        "{yyyy}": F.date_format(issue_date, "yyyy"), "{MM}": F.date_format(issue_date, "MM"),
        "{dd}": F.date_format(issue_date, "dd"), "{date}": F.date_format(issue_date, "yyyy-MM-dd"),
    }
    if number is not None:
        values["{page}"] = F.lpad(number.cast("string"), 2, "0")
    if item is not None:
        values["{item}"] = item.cast("string")
    for mark, value in values.items():
        out = F.replace(out, F.lit(mark), value)
    return out
