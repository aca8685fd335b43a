"""Topics: members of both sides, frames, keywords, deltas and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIDE_FIELDS = {
    "frames": "core_frame", "actors": "main_actors", "beneficiaries": "beneficiaries", "problems": "problem_terms",
    "solutions": "solution_terms", "authorities": "authority_sources",
}
DELTA_CLAIMS = ("frame", "actor", "goal", "threat", "solution", "authority")


def topic_articles(members: DataFrame, articles: DataFrame) -> DataFrame:
    """Members joined to their articles in list order; ids without an article drop out."""
    return members.join(articles.withColumnRenamed("id", "article_id"), ["side", "article_id"])


def topic(topics: DataFrame, topic_id: str) -> DataFrame:
    return topics.filter(F.col("topic_id") == topic_id)


def first_terms(rows: DataFrame, key: list[str], n: int | None = None) -> DataFrame:
    """Distinct non-empty ``term`` values per key in order of first appearance (``pos``, ``i``).

    The distinct terms are found by aggregation and ranked by a window whose limit applies before the shuffle, so a
    topic of any size only ever gathers the ``n`` terms that are shown.
    """
    seen = rows.filter("term IS NOT NULL AND term <> ''").groupBy(*key, "term").agg(F.min(F.struct("pos", "i")).alias("first"))
    ranked = seen.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("first", "term")))
    return ranked.filter(F.col("rank") <= n) if n else ranked


def narrative_rows(topic_rows: DataFrame) -> DataFrame:
    """``(topic_id, side, field, pos, i, term)`` of all narrative fields."""
    parts = None
    for number, (name, source) in enumerate(SIDE_FIELDS.items()):
        value = F.array(f"narrative.{source}") if source == "core_frame" else F.col(f"narrative.{source}")
        rows = topic_rows.select("topic_id", "side", "pos", F.lit(name).alias("field"), F.posexplode(value).alias("i", "term"))
        rows = rows.withColumn("i", F.col("i") + number * 1000)
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


def side_summary(topic_rows: DataFrame, n: int | None = None) -> DataFrame:
    """Distinct terms per topic, side and field; with ``n`` the frame comparison."""
    return first_terms(narrative_rows(topic_rows), ["topic_id", "side", "field"], n)


def frame_comparison(topic_rows: DataFrame, n: int = 4) -> DataFrame:
    rows = side_summary(topic_rows, n).groupBy("topic_id", "side", "field").agg(
        F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t")
    )
    text = F.array_join(F.transform("t", lambda s: s["term"]), "、")
    return rows.withColumn("text", text).groupBy("topic_id", "field").agg(
        F.max(F.when(F.col("side") == "left", F.col("text"))).alias("left_text"),
        F.max(F.when(F.col("side") == "right", F.col("text"))).alias("right_text"),
    )


def topic_keywords(topic_rows: DataFrame, n: int = 7) -> DataFrame:
    """First ``n`` distinct keywords, problem and solution terms per topic and side."""
    terms = F.concat("keywords", "narrative.problem_terms", "narrative.solution_terms")
    rows = topic_rows.select("topic_id", "side", "pos", F.posexplode(terms).alias("i", "term"))
    return first_terms(rows, ["topic_id", "side"], n)


def evidence_counts(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("topic_id", "claim_type").agg(F.count("*").alias("n"))


def delta_overview(topics: DataFrame, evidence: DataFrame) -> DataFrame:
    """Six claims per topic with their text and the number of evidence rows."""
    claims = F.array(
        *[F.struct(F.lit(i).alias("claim_pos"), F.lit(f"{c}_shift").alias("claim_type"), F.col(f"delta.{c}").alias("text")) for i, c in enumerate(DELTA_CLAIMS)]
    )
    rows = topics.select("topic_id", F.inline(claims))
    return rows.join(evidence_counts(evidence), ["topic_id", "claim_type"], "left").na.fill(0, ["n"])


def lexical_contrast(topics: DataFrame) -> DataFrame:
    """Long form of the per-side term arrays: (topic_id, side, kind, pos, term)."""
    parts = F.array(
        *[
            F.struct(F.lit(side).alias("side"), F.lit(kind).alias("kind"), F.col(f"{kind}_{side}").alias("terms"))
            for kind in ("lexical", "silence") for side in ("left", "right")
        ]
    )
    return topics.select("topic_id", F.inline(parts)).select("topic_id", "side", "kind", F.posexplode("terms").alias("pos", "term"))


def evidence_list(evidence: DataFrame, articles: DataFrame, labels: DataFrame) -> DataFrame:
    """Each snippet with its article title, source label and claim label."""
    source = labels.filter("kind = 'source'").select(F.col("code").alias("side"), F.col("label").alias("source_label"))
    claim = labels.filter("kind = 'claim'").select(F.col("code").alias("claim_type"), F.col("label").alias("claim_label"))
    out = evidence.join(articles.select("side", F.col("id").alias("article_id"), "title"), ["side", "article_id"], "left")
    out = out.join(source, "side", "left").join(claim, "claim_type", "left")
    return out.withColumns(
        {"source_label": F.coalesce("source_label", "side"), "claim_label": F.coalesce("claim_label", "claim_type")}
    )
