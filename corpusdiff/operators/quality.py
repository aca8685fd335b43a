"""Checks and diagnostics over stored match groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusdiff.operators.graph import is_matched_type
from corpusdiff.operators.terms import term_hits
from corpusdiff.session import cut_lineage


KNOWN_TYPES = ("matched", "left_only", "right_only")


def infer_group_type(match_type: Column, n_left: Column, n_right: Column) -> Column:
    """A label that says matched or one-sided stays; any other, or none, goes by the members."""
    return (
        F.when(match_type.isin(*KNOWN_TYPES), match_type)
        .when((n_left > 0) & (n_right > 0), F.lit("matched"))
        .when(n_left > 0, F.lit("left_only"))
        .when(n_right > 0, F.lit("right_only"))
        .otherwise(F.coalesce(match_type, F.lit("unknown")))
    )


def group_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("issue_date", "group_id").agg(
        F.count_if(F.col("side") == "left").alias("n_left"), F.count_if(F.col("side") == "right").alias("n_right")
    ).withColumn("n_total", F.col("n_left") + F.col("n_right"))


def check_invariants(groups: DataFrame, members: DataFrame, stored_counts: DataFrame | None = None, max_total: int = 4, max_side: int = 2) -> DataFrame:
    """Violations as (issue_date, rule, subject, value); an empty result is a pass."""
    matched = groups.filter(is_matched_type(F.col("match_type"))).select("issue_date", "group_id")
    of_matched = members.join(matched, ["issue_date", "group_id"], "left_semi")
    sizes = group_sizes(of_matched)

    def rows(df: DataFrame, rule: str, subject: str, value: str) -> DataFrame:
        return df.select("issue_date", F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"), F.col(value).cast("long").alias("value"))

    out = rows(sizes.filter(F.col("n_total") > max_total), "group_total", "group_id", "n_total")
    side = sizes.withColumn("n_side", F.greatest("n_left", "n_right")).filter(F.col("n_side") > max_side)
    out = out.unionByName(rows(side, "group_side", "group_id", "n_side"))
    reused = of_matched.groupBy("issue_date", "side", "article_id").agg(F.count("*").alias("n")).filter("n > 1")
    out = out.unionByName(rows(reused, "article_reused", "article_id", "n"))
    if stored_counts is not None:
        real = matched.groupBy("issue_date").agg(F.count("*").alias("real"))
        wrong = stored_counts.select("issue_date", "matched_groups").join(real, "issue_date", "full_outer").na.fill(0)
        out = out.unionByName(rows(wrong.filter("matched_groups <> real").withColumn("s", F.lit("matched_groups")), "stored_count", "s", "real"))
    return out


def group_titles(groups: DataFrame, members: DataFrame, articles: DataFrame) -> DataFrame:
    """Left and right titles of the matched groups, at most two each."""
    matched = groups.filter(is_matched_type(F.col("match_type"))).select("issue_date", "group_id")
    titled = members.join(matched, ["issue_date", "group_id"], "left_semi").join(
        articles.select("issue_date", "side", F.col("id").alias("article_id"), "title"), ["issue_date", "side", "article_id"]
    )
    return titled.groupBy("issue_date", "group_id").agg(
        F.collect_list(F.when(F.col("side") == "left", F.col("title"))).alias("left_titles"),
        F.collect_list(F.when(F.col("side") == "right", F.col("title"))).alias("right_titles"),
    )


def _found(terms: str, titles: str, every: bool) -> Column:
    test = F.forall if every else F.exists
    return test(terms, lambda term: F.exists(titles, lambda title: F.contains(title, term)))


def near_titles(rules: DataFrame, titles: DataFrame, keys: str, columns: list[str], rarest: bool) -> DataFrame:
    """Rules next to the groups that can meet them: a title of ``columns`` holds one of the terms in the rule's column ``keys``, or, with ``rarest``, the one that occurs in the fewest groups.

    All terms are looked up in all titles by automata, so the rules are joined with the groups that hold a term and no others. Rules without a date meet groups of any date. A rule
    without keys, or with an empty term as a key that decides, meets every group of its dates.
    """
    rules = cut_lineage(rules.withColumn("rule_", F.monotonically_increasing_id()))
    wanted = rules.select("rule_", F.col("issue_date").alias("on_"), F.explode_outer(keys).alias("term")).na.fill("", ["term"]).distinct()
    each = titles.select("issue_date", "group_id", F.explode(F.array_distinct(F.concat(*columns))).alias("title"))
    hits = cut_lineage(term_hits(each, wanted.select("term")).distinct().unionByName(titles.select("issue_date", "group_id", F.lit("").alias("term"))))
    if rarest:
        often = wanted.join(hits.groupBy("term").agg(F.count("*").alias("n")), "term", "left").na.fill(0, ["n"])
        wanted = often.groupBy("rule_", "on_").agg(F.min(F.struct("n", "term"))["term"].alias("term"))
    dated = wanted.filter("on_ IS NOT NULL").withColumnRenamed("on_", "issue_date").join(hits, ["issue_date", "term"])
    undated = wanted.filter("on_ IS NULL").join(hits, "term")
    met = dated.select("rule_", "issue_date", "group_id").unionByName(undated.select("rule_", "issue_date", "group_id")).distinct()
    return met.join(rules.drop("issue_date"), "rule_").join(titles, ["issue_date", "group_id"]).drop("rule_")


def match_expectations(titles: DataFrame, expectations: DataFrame, mode: str = "all") -> DataFrame:
    """Expectations and the groups whose titles hold their terms: all terms, or any term of each side."""
    every = mode == "all"
    hit = _found("left_terms", "left_titles", every) & _found("right_terms", "right_titles", every)
    return near_titles(expectations, titles, "left_terms", ["left_titles"], every).filter(hit).select("issue_date", "group_id", "label")


def check_expected(groups: DataFrame, titles: DataFrame, dates: DataFrame, expectations: DataFrame) -> DataFrame:
    """Failures: expected group absent on its date (on every date, if it names none), wrong number of groups, group too large, date missing."""
    wanted = expectations.filter("kind = 'group'")
    hit = match_expectations(titles, wanted).select("issue_date", "label").distinct()
    dated = wanted.filter("issue_date IS NOT NULL").join(hit, ["issue_date", "label"], "left_anti")
    undated = wanted.filter("issue_date IS NULL").join(hit.select("label").distinct(), "label", "left_anti")
    out = dated.unionByName(undated).select("issue_date", F.lit("group_missing").alias("failure"), "label")
    counts = groups.filter(is_matched_type(F.col("match_type"))).groupBy("issue_date").agg(F.count("*").alias("n"))
    exact = expectations.filter("kind = 'group_count'").join(counts, "issue_date", "left").na.fill(0, ["n"])
    out = out.unionByName(exact.filter("n <> value").select("issue_date", F.lit("group_count").alias("failure"), "label"))
    sizes = groups.withColumn("n_total", F.size("left_articles") + F.size("right_articles"))
    big = expectations.filter("kind = 'max_total'").join(sizes.select("issue_date", "n_total"), "issue_date").filter("n_total > value")
    out = out.unionByName(big.select("issue_date", F.lit("group_too_large").alias("failure"), "label").distinct())
    absent = expectations.filter("issue_date IS NOT NULL").join(dates, "issue_date", "left_anti")
    return out.unionByName(absent.select("issue_date", F.lit("date_missing").alias("failure"), "label"))


def check_forbidden(titles: DataFrame, rules: DataFrame) -> DataFrame:
    """Violations of forbidden title pairs and forbidden title terms."""
    pairs = match_expectations(titles, rules.filter("kind = 'forbidden_pair'"), mode="any")
    both = F.concat("left_titles", "right_titles")
    any_term = F.exists("left_terms", lambda term: F.exists(both, lambda title: F.contains(title, term)))
    near = near_titles(rules.filter("kind = 'forbidden_term'"), titles, "left_terms", ["left_titles", "right_titles"], False)
    terms = near.filter(any_term).select("issue_date", "group_id", "label")
    return pairs.withColumn("failure", F.lit("forbidden_pair")).unionByName(terms.withColumn("failure", F.lit("forbidden_term")))


STORED_COUNTS = ("matched_left", "matched_right", "left_only", "right_only")


def typed_sizes(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Groups with their sizes and ``kind``."""
    sizes = groups.select("issue_date", "group_id", "match_type").join(group_sizes(members), ["issue_date", "group_id"], "left").na.fill(0)
    return sizes.withColumn("kind", infer_group_type(F.col("match_type"), F.col("n_left"), F.col("n_right")))


def is_oversized(threshold: int) -> Column:
    return (F.col("n_total") >= threshold) | (F.greatest("n_left", "n_right") >= threshold)


def diagnose(groups: DataFrame, members: DataFrame, stored: DataFrame | None = None, threshold: int = 6) -> DataFrame:
    """Per date: groups by kind, articles in them, largest matched group, and number of suspicious matched groups.

    Article counts of ``STORED_COUNTS`` that ``stored`` has replace the computed ones; groups are always counted.
    """
    kind = F.col("kind")
    matched = kind == "matched"
    report = typed_sizes(groups, members).groupBy("issue_date").agg(
        F.count_if(matched).alias("matched_groups"),
        F.count_if(kind == "left_only").alias("left_only_groups"),
        F.count_if(kind == "right_only").alias("right_only_groups"),
        F.coalesce(F.max(F.when(matched, F.col("n_total"))), F.lit(0)).alias("max_group_size"),
        F.count_if(matched & is_oversized(threshold)).alias("suspicious_groups"),
        F.sum(F.when(matched, F.col("n_left")).otherwise(0)).alias("matched_left"),
        F.sum(F.when(matched, F.col("n_right")).otherwise(0)).alias("matched_right"),
        F.sum(F.when(kind == "left_only", F.col("n_left")).otherwise(0)).alias("left_only"),
        F.sum(F.when(kind == "right_only", F.col("n_right")).otherwise(0)).alias("right_only"),
    )
    known = [c for c in STORED_COUNTS if stored is not None and c in stored.columns]
    if not known:
        return report
    own = stored.select("issue_date", *(F.col(c).alias(f"{c}_") for c in known))
    return report.join(own, "issue_date", "left").withColumns({c: F.coalesce(f"{c}_", c) for c in known}).drop(*(f"{c}_" for c in known))


def oversized_groups(groups: DataFrame, members: DataFrame, threshold: int = 6) -> DataFrame:
    """Matched groups with at least ``threshold`` articles in all or on a side, largest first."""
    large = typed_sizes(groups, members).filter((F.col("kind") == "matched") & is_oversized(threshold))
    return large.select("issue_date", "group_id", "n_left", "n_right", "n_total").orderBy(F.desc("n_total"), "issue_date", "group_id")


def issue_problems(issues: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected (source, issue_date) that are missing, failed or without articles."""
    found = expected.join(issues.select("source", "issue_date", "status", "articles"), ["source", "issue_date"], "left")
    problem = (
        F.when(F.col("status").isNull(), F.lit("missing"))
        .when(F.col("status") == "failed", F.lit("failed"))
        .when(F.col("articles") == 0, F.lit("no_articles"))
    )
    return found.withColumn("problem", problem).filter("problem IS NOT NULL").select("source", "issue_date", "problem")


def page_coverage(articles: DataFrame, slots: DataFrame, n_titles: int = 2) -> DataFrame:
    """Per date, side and wanted page: number of articles, first titles, and how many more there are."""
    from pyspark.sql import Window

    key = ["issue_date", "side", "page_number"]
    order = Window.partitionBy(*key).orderBy("pos", "id")
    first = articles.select(*key, "pos", "id", "title").withColumn("n_", F.row_number().over(order)).filter(F.col("n_") <= n_titles)
    titles = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("n_", "title"))).alias("t")).select(
        *key, F.transform("t", lambda s: s["title"]).alias("first_titles")
    )
    counts = articles.groupBy(*key).agg(F.count("*").alias("articles"))
    wanted = slots.select(*key).distinct()
    return (
        wanted.join(counts, key, "left").join(titles, key, "left").na.fill(0, ["articles"])
        .withColumn("first_titles", F.coalesce("first_titles", F.array().cast("array<string>")))
        .withColumn("more", F.col("articles") - F.size("first_titles"))
    )
