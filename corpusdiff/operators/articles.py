"""One flat row per article from any of the accepted article shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusdiff.functions.text import parse_int
from corpusdiff.rules import RuleSet

ENTITY = T.ArrayType(
    T.StructType(
        [T.StructField("text", T.StringType()), T.StructField("type", T.StringType()), T.StructField("confidence", T.DoubleType())]
    )
)
NARRATIVE_LISTS = ("main_actors", "beneficiaries", "problem_terms", "solution_terms", "authority_sources", "action_verbs")
MAX_PAGE = 2_147_483_647

# Field order decides the joined text; the first entry is the title.
ARTICLE_TEXT = (
    "title", "subtitle", "extraction.subtitle", "excerpt", "extraction.excerpt", "summary", "extraction.summary", "body",
    "body_text", "analysis_text", "content", "text", "extraction.body", "extraction.body_text",
    "extraction.analysis_text", "extraction.content", "extraction.text",
)
ANCHOR_TEXT = (
    "title", "subtitle", "extraction.subtitle", "excerpt", "summary", "analysis_text", "body_text", "body", "text",
    "extraction.excerpt", "extraction.summary", "extraction.analysis_text", "extraction.body_text", "extraction.body",
    "extraction.text",
)
LIKELY_TEXT = (
    "title", "subtitle", "extraction.subtitle", "excerpt", "extraction.excerpt", "summary", "extraction.summary",
    "analysis_text", "extraction.analysis_text",
)
HEADLINE_TEXT = ("title", "subtitle", "extraction.subtitle")


def _has(schema: T.StructType, path: str) -> bool:
    for step in path.split("."):
        if not isinstance(schema, T.StructType) or step not in schema.names:
            return False
        schema = schema[step].dataType
    return True


def field(df: DataFrame, path: str, data_type: str | T.DataType = "string") -> Column:
    """A possibly nested column, or a typed null where the input has no such field."""
    return F.col(path).cast(data_type) if _has(df.schema, path) else F.lit(None).cast(data_type)


def first_of(df: DataFrame, paths: tuple[str, ...], data_type: str = "string") -> Column:
    """First non-null field; empty text counts as present."""
    present = [field(df, p, data_type) for p in paths if _has(df.schema, p)]
    return F.coalesce(*present) if present else F.lit(None).cast(data_type)


def article_title(df: DataFrame, default: str = "") -> Column:
    paths = ("title", "headline", "extraction.title", "extraction.headline")
    return F.coalesce(first_of(df, paths), F.lit(default))


def article_date(df: DataFrame) -> Column:
    paths = ("issue_date", "date", "published_at", "extraction.issue_date", "extraction.date", "extraction.published_at")
    return F.to_date(F.try_to_timestamp(first_of(df, paths)))


def page_number(df: DataFrame) -> Column:
    """Page number, read from text where needed; the largest integer when unknown."""
    candidates = [
        field(df, "page_number", "int"),
        parse_int(field(df, "page")),
        field(df, "extraction.page_number", "int"),
        parse_int(field(df, "extraction.page")),
    ]
    return F.coalesce(*candidates, F.lit(MAX_PAGE))


def article_key(df: DataFrame, variant: str = "score") -> Column:
    own = [field(df, p) for p in ("id", "source_article_id", "extraction.source_article_id")]
    if variant == "score":
        fallback = F.concat_ws(
            ":", article_title(df), F.coalesce(article_date(df).cast("string"), F.lit("unknown-date"))
        )
        return F.coalesce(*own, field(df, "url"), fallback)
    parts = (
        F.coalesce(first_of(df, ("source", "side")), F.lit("article")),
        F.coalesce(first_of(df, ("issue_date", "date")), F.lit("unknown")),
        F.coalesce(first_of(df, ("page_number", "page")), F.lit("x")),
        article_title(df, "Untitled"),
    )
    return F.coalesce(*own, F.concat_ws(":", *parts))


def joined_text(df: DataFrame, paths: tuple[str, ...], title: Column, max_chars: int | None = None) -> Column:
    parts = [title] + [field(df, p) for p in paths[1:] if _has(df.schema, p)]
    text = F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])
    return F.substring(text, 1, max_chars) if max_chars else text


def article_text(df: DataFrame) -> Column:
    return joined_text(df, ARTICLE_TEXT, article_title(df))


def anchor_text(df: DataFrame, max_chars: int | None = None) -> Column:
    return joined_text(df, ANCHOR_TEXT, article_title(df, "Untitled"), max_chars)


def headline_text(df: DataFrame) -> Column:
    return joined_text(df, HEADLINE_TEXT, article_title(df, "Untitled"))


def likely_text(df: DataFrame, max_chars: int | None = None) -> Column:
    return joined_text(df, LIKELY_TEXT, article_title(df), max_chars)


def _merged_array(df: DataFrame, path: str, data_type: T.DataType) -> Column:
    empty = F.array().cast(data_type)
    parts = [F.coalesce(field(df, p, data_type), empty) for p in (path, f"extraction.{path}") if _has(df.schema, p)]
    return F.concat(*parts) if parts else empty


def _narrative_terms(df: DataFrame) -> Column:
    strings = T.ArrayType(T.StringType())
    empty = F.array().cast(strings)
    parts = []
    for root in ("narrative", "extraction.narrative"):
        if _has(df.schema, root):
            parts.append(F.array(field(df, f"{root}.core_frame")))
            parts += [F.coalesce(field(df, f"{root}.{name}", strings), empty) for name in NARRATIVE_LISTS]
    return F.concat(*parts) if parts else empty


# Fields that no score depends on, besides date, side and page, which are compared on their own.
NOT_CONTENT = {
    "id", "source_article_id", "side", "source", "issue_date", "date", "published_at", "page_number", "page", "page_name",
    "pos", "url", "author",
}


def page_prominence(page: Column) -> Column:
    return (
        F.when(page == MAX_PAGE, F.lit(0.45))
        .when(page == 1, F.lit(1.0))
        .when(page <= 3, F.lit(0.8))
        .when(page <= 7, F.lit(0.56))
        .otherwise(F.lit(0.34))
    )


def fingerprint(df: DataFrame) -> Column:
    """Digest of everything a score depends on besides date and side; equal for copies of an article."""
    content = [F.col(c) for c in df.columns if c not in NOT_CONTENT]
    return F.sha2(F.to_json(F.struct(*content, page_prominence(page_number(df)).alias("prominence_"))), 256)


def _identity(df: DataFrame) -> list[Column]:
    return [
        fingerprint(df).alias("fingerprint"),
        article_key(df).alias("id"),
        first_of(df, ("side", "source")).alias("side"),
        article_date(df).alias("issue_date"),
        page_number(df).alias("page_number"),
        F.coalesce(field(df, "pos", "long"), F.lit(0)).alias("pos"),
    ]


def identify(df: DataFrame) -> DataFrame:
    """Key columns and digest next to the untouched input row in ``raw``, which holds each text once."""
    return df.select(*_identity(df), F.struct(*df.columns).alias("raw"))


def normalize_articles(df: DataFrame, rules: RuleSet, keep: tuple[str, ...] = ()) -> DataFrame:
    """Resolve all alternative fields once; every later operator reads this flat row. ``keep`` names columns that are carried along and are no part of the article."""
    strings = T.ArrayType(T.StringType())
    rows, df = df, df.drop(*keep)
    return rows.select(
        *_identity(df),
        field(df, "page_name").alias("page_name"),
        article_title(df).alias("title"),
        article_title(df, "Untitled").alias("judge_title"),
        article_text(df).alias("article_text"),
        anchor_text(df, rules.anchor_text_chars).alias("anchor_text"),
        headline_text(df).alias("headline_text"),
        likely_text(df, rules.likely_text_chars).alias("likely_text"),
        _merged_array(df, "keywords", strings).alias("keywords"),
        _merged_array(df, "entities", ENTITY).alias("entities"),
        _narrative_terms(df).alias("narrative_raw"),
        *keep,
    )
