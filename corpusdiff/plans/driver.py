"""The workload on the given tables: how they become articles, rules, decisions, landed pages and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusdiff.rules import AnchorRule, LABELS, RuleSet, TopicRule
from corpusdiff.session import spread

FIRST_DATE = "2024-01-01"
N_DATES = 64

# The documents are invented prose, so the vocabulary is chosen from what occurs in them.
DRIVER_RULES = RuleSet(
    generic_terms=("tiontion", "lement", "mente"),
    generic_judge_terms=("tiontion", "lement", "eaument"),
    military_cues=("hand", "ness", "schen"),
    policy_cues=("tionth", "ement", "ouer"),
    slogan_cues=("eauou", "mente"),
    anchors=(
        AnchorRule("worthless idiot", "worthless.{0,40}idiot|idiot.{0,40}worthless", 1.0, clusterable=True),
        AnchorRule("stupid", "stupid", 0.96, clusterable=True),
        AnchorRule("tiontion", "tiontion", 0.92, clusterable=True),
        AnchorRule("ththtion", "ththtion", 0.94, clusterable=True),
        AnchorRule("queque", "queque", 0.62),
        AnchorRule("oument", "oument", 0.54),
        AnchorRule("threea", "threea", 0.58),
        AnchorRule("thouou", "thouou", 0.42),
        AnchorRule("elletion", "elletion", 0.76),
        AnchorRule("hableha", "hable", 0.8, headline_only=True),
    ),
    anchor_score_patterns=(("stble|enelle|schund", 0.78), ("tion|ment|ung", 0.48)),
    event_pattern="[A-Za-z0-9\\-]{2,26}(?:stble|enelle|schund)",
    scoring_event_pattern="[A-Za-z0-9-]{2,24}(?:stble|enelle|schund)",
    scoring_anchors=(("stupid", "stupid"), ("worthless", "worthless"), ("queque lement", "queque.{0,18}lement")),
    topics=(
        TopicRule("insult", "text", ("stupid|worthless|idiot",)),
        TopicRule("headline_tion", "headline", ("tionth|thtion",)),
        TopicRule("elle_statistics", "text", ("elletion", "tionelle|menttre|queque")),
    ),
    policy_family="elle_statistics",
    ignorable_titles=("In", "The"),
    title_labels=("editorial", "note"),
    labels=LABELS,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_sentence(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, "^[^.\\n]*", 0))


def hashed_date(value: Column) -> Column:
    """A date derived from a text, so that copies of a title meet on the same date."""
    day = F.conv(F.substring(F.md5(value), 1, 2), 16, 10).cast("int") % N_DATES
    return F.date_add(F.lit(FIRST_DATE).cast("date"), day)


def source_number(source: Column) -> Column:
    return F.regexp_extract(source, "^src([0-9]+)", 1).cast("int")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as articles: whole first sentence as title, whole text as body."""
    title = first_sentence(F.col("text"))
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("doc_id").alias("pos"),
        F.when(source_number(F.col("source")) % 2 == 0, F.lit("left")).otherwise(F.lit("right")).alias("side"),
        hashed_date(title).alias("issue_date"),
        (F.col("doc_id") % 8 + 1).cast("int").alias("page_number"),
        F.concat(F.lit("page "), F.col("lang")).alias("page_name"),
        title.alias("title"),
        F.col("text").alias("analysis_text"),
        F.col("source").alias("author"),
    )


def doc_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` per article, the material of pair decisions."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), "quality", "toxic")
