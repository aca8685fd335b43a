"""The daily build over any number of dates at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdiff.operators import accept as a
from corpusdiff.operators import candidates as c
from corpusdiff.operators import graph as g
from corpusdiff.operators import groups as gr
from corpusdiff.operators import pairs as p
from corpusdiff.operators.articles import identify, normalize_articles
from corpusdiff.operators.grouping import Bounds, group_pairs, independence_blocks
from corpusdiff.operators.signals import article_signals
from corpusdiff.rules import NEWSPAPER_RULES, RuleSet
from corpusdiff.session import as_table, cut_lineage


@dataclass(frozen=True)
class BuildOptions:
    """Acceptance and grouping work on all candidate pairs of copy classes; nothing here limits them."""

    aggregate_unmatched: bool = True
    min_candidate: float = 0.12
    min_decision: float = 70
    use_judge: bool = True
    bounds: Bounds = Bounds()


# Options of the archive build.
SNAPSHOT_OPTIONS = BuildOptions(aggregate_unmatched=False, min_candidate=0.1)


def candidate_pool(articles: DataFrame, rules: RuleSet, options: BuildOptions, beside: DataFrame | None = None) -> DataFrame:
    return c.class_pool(c.candidate_pairs(articles, rules, options.min_candidate, sized=True, beside=beside))


def candidate_report(articles: DataFrame, rules: RuleSet, options: BuildOptions, limit: int) -> DataFrame:
    """The best ``limit`` article pairs of each date in order of admission. A report; nothing else is built on it."""
    cands = c.candidate_pairs(articles, rules, options.min_candidate)
    return c.select_pool(cands, p.class_members(identify(articles), limit), limit)


def accepted_pairs(pool: DataFrame, decisions: DataFrame | None, options: BuildOptions, articles: DataFrame | None = None) -> DataFrame:
    """Accepted pairs of copy classes. With ``articles`` a decision on any copies of two classes holds for the pair of classes, else only one on their first articles."""
    if decisions is None or not options.use_judge:
        return a.accept(a.without_decisions(pool), options.min_decision, used_judge=F.lit(False))
    return a.accept(a.attach_decisions(pool, decisions, None if articles is None else identify(articles)), options.min_decision)


def match_groups(accepted: DataFrame, articles: DataFrame, rules: RuleSet, options: BuildOptions) -> DataFrame:
    """Groups of articles: pairs of copy classes are grouped block by block, then the copies are dealt to the groups by rank."""
    prepared = as_table(a.merge_fields(accepted, rules), "accepted")
    grouped = group_pairs(independence_blocks(prepared), rules, options.bounds, by=("issue_date", "block"))
    return gr.expand_copies(cut_lineage(gr.assemble_groups(prepared, grouped, rules)), identify(articles))


def build(
    articles: DataFrame, rules: RuleSet = NEWSPAPER_RULES, decisions: DataFrame | None = None,
    options: BuildOptions = SNAPSHOT_OPTIONS,
) -> dict[str, DataFrame]:
    """Articles of any shape → matched groups, members, one-sided groups and graph of every date."""
    flat = normalize_articles(articles, rules).filter("issue_date IS NOT NULL")
    pool = as_table(candidate_pool(articles, rules, options), "pool")
    matched = cut_lineage(match_groups(accepted_pairs(pool, decisions, options, articles), articles, rules, options))
    members = gr.group_members(matched)
    rest = gr.unmatched(flat, members)
    alone = gr.unmatched_groups(rest, options.aggregate_unmatched)
    own = article_signals(rest, rules, keep=("page_name",))
    groups = gr.union_groups(matched, gr.explained_unmatched(alone, own, rules, options.aggregate_unmatched))
    nodes = g.graph_nodes(flat, members)
    links = g.graph_links(g.group_cross_pairs(matched))
    measured = g.node_measures(nodes, links, members)
    return {
        "articles": flat, "pool": pool, "matched": matched, "members": members, "unmatched": rest, "groups": groups,
        "nodes": measured, "links": links, "metrics": g.graph_metrics(measured, links, matched),
    }
