"""Signals of an article, computed once per article and never per pair."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusdiff.functions import text as t
from corpusdiff.operators.articles import page_prominence
from corpusdiff.rules import RuleSet
from corpusdiff.session import pin


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def named_matches(rules, text: Column) -> Column:
    """Names of the ``(name, pattern)`` rules found in a text, in rule order."""
    found = [F.when(text.rlike(pattern), F.lit(name)) for name, pattern in rules]
    return F.filter(F.array(*found), lambda name: name.isNotNull()) if found else empty_strings()


def event_phrases(text: Column, pattern: str | None) -> Column:
    """All matches of an event pattern. Texts without one of its endings skip the costly run matching."""
    if not pattern:
        return empty_strings()
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    endings = re.search(r"\(\?:([^()]*)\)$", pattern)
    return F.when(text.rlike(endings.group(1)), found).otherwise(empty_strings()) if endings else found


def clean_terms(terms: Column) -> Column:
    """Normalised terms of 2 to 24 characters, first occurrence kept."""
    normal = F.transform(F.filter(terms, lambda x: x.isNotNull()), t.norm_term)
    return F.array_distinct(F.filter(normal, lambda x: F.length(x).between(2, 24)))


def scoring_anchors(normal: Column, rules: RuleSet) -> Column:
    """Dictionary anchors plus event-like phrases of a normalised text, 4 to 24 characters, not generic."""
    events = event_phrases(normal, rules.scoring_event_pattern)
    terms = F.transform(F.concat(named_matches(rules.scoring_anchors, normal), events), t.norm_term)
    return F.filter(terms, lambda x: F.length(x).between(4, 24) & ~t.is_in(x, rules.generic_terms))


def likely_terms(text: Column, normal: Column, rules: RuleSet) -> Column:
    """Scoring anchors, then the words that contain a cue; the first ``likely_limit``, or all without a limit."""
    cues = rules.military_cues + rules.policy_cues + rules.slogan_cues
    words = F.transform(F.regexp_extract_all(text, F.lit(rules.likely_pattern), F.lit(0)), t.norm_term)
    cued = F.filter(words, lambda x: (F.length(x) >= 2) & t.contains_any(x, cues))
    terms = F.array_distinct(F.concat(scoring_anchors(normal, rules), cued))
    return terms if rules.likely_limit is None else F.slice(terms, 1, rules.likely_limit)


def explicit_terms(keywords: Column, entities: Column, likely: Column) -> Column:
    certain = F.filter(entities, lambda e: F.coalesce(e["confidence"], F.lit(1.0)) >= 0.55)
    return clean_terms(F.concat(keywords, F.transform(certain, lambda e: e["text"]), likely))


def theme_terms(terms: Column, kind: str, rules: RuleSet) -> Column:
    if kind == "slogan":
        return F.filter(terms, lambda x: t.contains_any(x, rules.slogan_cues) | t.is_in(x, rules.generic_terms))
    cues = rules.military_cues if kind == "military" else rules.policy_cues
    return F.filter(terms, lambda x: t.contains_any(x, cues))


def term_weight(term: Column, rules: RuleSet) -> Column:
    return (
        F.when(t.is_in(term, rules.generic_terms), F.lit(0.35))
        .when(t.contains_any(term, rules.military_cues + rules.policy_cues), F.lit(1.2))
        .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.45), F.length(term) / 6)))
    )


def term_strength(terms: Column, rules: RuleSet, scale: float) -> Column:
    """Summed term weights over ``scale``, at most 1."""
    total = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + term_weight(x, rules))
    return F.least(F.lit(1.0), total / scale)


def anchor_score(term: Column, rules: RuleSet) -> Column:
    """What an anchor term is worth: its configured score, else by pattern, else the default."""
    score = F.when(term.isNull(), F.lit(None).cast("double"))
    for rule in rules.anchors:
        score = score.when(term == rule.canonical, F.lit(rule.score))
    for pattern, value in rules.anchor_score_patterns:
        score = score.when(term.rlike(pattern), F.lit(value))
    return score.otherwise(F.lit(rules.anchor_score_default))


def is_high_value(term: Column, rules: RuleSet) -> Column:
    return (anchor_score(term, rules) >= 0.64) & ~t.is_in(term, rules.generic_judge_terms)


def is_strong_short(term: Column, rules: RuleSet) -> Column:
    return (F.length(term) >= 4) & (anchor_score(term, rules) >= 0.9) & ~t.is_in(term, rules.generic_judge_terms)


def anchor_terms(text: Column, headline: Column, rules: RuleSet) -> Column:
    """Anchors of the candidate stage: configured rules, then high-value event phrases."""
    found = [
        F.when((headline if rule.headline_only else text).rlike(rule.pattern), F.lit(rule.canonical))
        for rule in rules.anchors
    ]
    named = F.filter(F.array(*found), lambda name: name.isNotNull()) if found else empty_strings()
    events = F.transform(event_phrases(text, rules.event_pattern), t.norm_anchor)
    events = F.filter(F.array_distinct(events), lambda x: F.length(x).between(4, 24) & is_high_value(x, rules))
    return F.array_distinct(F.concat(named, events))


def topic_families(body: Column, head: Column, rules: RuleSet) -> Column:
    """Families whose patterns are all found; both texts normalised."""
    found = []
    for rule in rules.topics:
        source = head if rule.field == "headline" else body
        condition = F.lit(True)
        for pattern in rule.patterns:
            condition = condition & source.rlike(pattern)
        found.append(F.when(condition, F.lit(rule.family)))
    return F.filter(F.array(*found), lambda name: name.isNotNull()) if found else empty_strings()


def title_triggers(rules: RuleSet) -> tuple[str, ...]:
    """Texts one of which every high-value title phrase contains."""
    spelled = [alternative for pattern, score in rules.anchor_score_patterns if score >= 0.64 for alternative in pattern.split("|")]
    return tuple(dict.fromkeys(spelled + [a.canonical for a in rules.anchors if a.score >= 0.64]))


def is_ignorable_title(canonical: Column, rules: RuleSet) -> Column:
    return t.is_in(canonical, rules.ignorable_titles)


def article_signals(articles: DataFrame, rules: RuleSet, keep: tuple[str, ...] = ()) -> DataFrame:
    """``normalize_articles`` output → one row of term sets, grams and title forms per article."""
    normal = pin(articles).withColumns(
        {
            "likely_normal": t.norm_anchor("likely_text"),
            "anchor_normal": t.norm_anchor("anchor_text"),
            "headline_normal": t.norm_anchor("headline_text"),
        }
    )
    named = pin(normal).select(
        "id",
        "side",
        "issue_date",
        "page_number",
        "pos",
        *keep,
        F.col("title").alias("score_title"),
        F.col("judge_title").alias("title"),
        t.norm_comparable("title").alias("title_cmp"),
        t.canonical_title("judge_title", rules).alias("canon"),
        explicit_terms(F.col("keywords"), F.col("entities"), likely_terms(F.col("likely_text"), F.col("likely_normal"), rules)).alias("explicit"),
        clean_terms(F.col("narrative_raw")).alias("narrative"),
        anchor_terms(F.col("anchor_text"), F.col("headline_text"), rules).alias("anchors"),
        topic_families(F.col("anchor_normal"), F.col("headline_normal"), rules).alias("families"),
        page_prominence(F.col("page_number")).alias("prominence"),
        t.shingle_codes("article_text", 3).alias("text_grams"),
        t.shingle_codes("title", 2).alias("title_grams"),
    )
    themed = F.array_union("explicit", "narrative")
    return pin(
        pin(named).withColumns(
            {
                "ctitle": F.col("canon.title"),
                "cyear": F.col("canon.leading_year"),
                "military": theme_terms(themed, "military", rules),
                "policy": theme_terms(themed, "policy", rules),
                "slogan": theme_terms(themed, "slogan", rules),
            }
        )
        .withColumns(
            {
                "policy_strength": term_strength(F.col("policy"), rules, 6.0),
                "military_strength": term_strength(F.col("military"), rules, 6.0),
                "ignorable": is_ignorable_title(F.col("ctitle"), rules),
            }
        )
        .drop("canon")
    )
