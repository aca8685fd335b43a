import datetime as dt

from pyspark.sql import functions as F

from corpusdiff.operators import graph as g
from corpusdiff.operators import groups as gr
from corpusdiff.operators import quality as qa
from corpusdiff.operators import scoring as sc
from corpusdiff.operators.grouping import connected_components, greedy_one_to_one
from corpusdiff.operators.similar import is_usable
from corpusdiff.rules import NEWSPAPER_RULES as R

DAY = dt.date(2026, 5, 1)


def test_greedy_takes_the_best_first(spark):
    rows = [("L1", "R1", 0.9), ("L1", "R2", 0.8), ("L2", "R1", 0.7), ("L2", "R2", 0.5), ("L3", "R3", 0.4), ("L4", "R4", 0.47)]
    pairs = spark.createDataFrame([(DAY, a, b, c, "uncertain" if a == "L3" else "same_policy") for a, b, c in rows],
                                  "issue_date date, l_class string, r_class string, confidence double, match_type string")
    articles = [(DAY, "left", f"L{k}", f"L{k}", k, 1) for k in range(1, 5)] + [(DAY, "right", f"R{k}", f"R{k}", k, 1) for k in range(1, 4)]
    members = spark.createDataFrame(articles, "issue_date date, side string, class string, id string, pos int, rank long")
    assert {(r.l_article, r.r_article) for r in greedy_one_to_one(pairs.filter(is_usable()), members).collect()} == {("L1", "R1"), ("L2", "R2"), ("L3", "R3")}


def test_components_of_a_long_chain(spark):
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [("x", "y"), ("y", "z"), ("z", "x")]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a string, b string")).collect()))
    assert set(got.values()) == {"000", "x"} and len(got) == 44


def test_links_of_a_pair_in_two_groups(spark):
    rows = [("g1", "same_event", 0.8, ["t"], ["l"], ["r"]), ("g2", "matched", 0.6, ["t", "u"], ["l"], ["r", "s"]), ("g3", "uncertain", 0.9, [], ["l"], ["q"])]
    groups = spark.createDataFrame(rows, "group_id string, match_type string, confidence double, shared_terms array<string>, left_articles array<string>, right_articles array<string>").withColumn(
        "issue_date", F.lit(DAY)
    )
    links = {r.r_article: r for r in g.graph_links(g.group_cross_pairs(groups)).collect()}
    assert set(links) == {"r", "s"}
    link = links["r"]
    assert (link.weight, round(link.confidence, 3), link.confidence_min, link.confidence_max) == (2, 0.7, 0.6, 0.8)
    assert link.group_ids == ["g1", "g2"] and link.shared_terms == ["t", "u"]


def test_reason_summary(spark):
    row = ("lexical", "title_similarity", 1.0, 0.55, "d", None)
    other = ("narrative", "shared_named_or_policy_terms", 0.5, 0.54, "d", ["a", "b", "c", "d", "e"])
    meta = ("metadata", "date_and_page_prominence", 0.9, 0.18, "d", None)
    df = spark.createDataFrame([([meta, other, row],)], f"reasons {sc.REASON_TYPE}")
    got = sc.summarize_reasons(df, R, n=2, scores=True).first()
    assert got.summary == "語彙・タイトル一致 (100%) / ナラティブ・共有固有名/政策語: a、b、c、d (50%)"
    assert len(got.metadata_reasons) == 1 and [r.signal for r in got.detailed_reasons] == ["title_similarity", "shared_named_or_policy_terms"]


def group_rows(spark):
    reasons = [("narrative", "anchor_topic_component", 0.92, 1.0, "d", ["x"])]
    matched = spark.createDataFrame(
        [("matched:l:r+s", DAY, "same_event", 0.92, 0.5, 0.25, reasons, ["x"], ["p"], [], ["l"], ["r", "s"], 2)],
        f"group_id string, issue_date date, match_type string, confidence double, lexical double, narrative double, reasons {sc.REASON_TYPE}, shared_terms array<string>, "
        "left_only_terms array<string>, right_only_terms array<string>, left_articles array<string>, right_articles array<string>, page_number int",
    )
    rest = spark.createDataFrame([(DAY, "left", "q", 1, "front"), (DAY, "right", "w", 2147483647, "")], "issue_date date, side string, id string, page_number int, page_name string")
    return gr.union_groups(matched, gr.unmatched_groups(rest))


def test_display_form_and_order(spark):
    groups = group_rows(spark)
    shown = {r.group_id: r for r in gr.display_groups(groups, R).collect()}
    hit = shown["matched:l:r+s"]
    assert (hit.match_type, hit.method, hit.size_label, hit.message) == ("matched", "N-to-M match", "1:2", "高信頼 92% / lexical 50% / narrative 25%")
    assert hit.reason == "MATCHED（高信頼 92%）。共有語: x。ナラティブ・アンカートピック束: x" and len(hit.uncertainty_notes) == 4
    assert shown["left_only:1:front"].method == "not matched after adjudication" and "right_only:unknown:page" in shown
    assert [r.match_type for r in gr.order_display(groups).collect()] == ["same_event", "left_only", "right_only"]
    assert [r.group_id for r in gr.order_by_page(groups).collect()] == ["left_only:1:front", "matched:l:r+s", "right_only:unknown:page"]
    assert gr.filter_view(groups, "only").count() == 2 and gr.filter_view(groups, "matched").count() == 1


def test_inferred_types_and_reuse(spark):
    kinds = spark.createDataFrame([(None, 1, 1), (None, 2, 0), (None, 0, 1), ("same_event", 0, 0), (None, 0, 0), ("same_event", 1, 0), ("odd", 1, 1), ("left_only", 1, 1)], "m string, l int, r int")
    got = [x[0] for x in kinds.select(qa.infer_group_type(F.col("m"), F.col("l"), F.col("r"))).collect()]
    assert got == ["matched", "left_only", "right_only", "same_event", "unknown", "left_only", "matched", "left_only"]
    groups = spark.createDataFrame([(DAY, "g1", "matched"), (DAY, "g2", "matched")], "issue_date date, group_id string, match_type string")
    members = spark.createDataFrame([(DAY, "g1", "left", "a"), (DAY, "g2", "left", "a"), (DAY, "g2", "right", "b")], "issue_date date, group_id string, side string, article_id string")
    counts = spark.createDataFrame([(DAY, 3)], "issue_date date, matched_groups int")
    found = {(r.rule, r.subject, r.value) for r in qa.check_invariants(groups, members, counts).collect()}
    assert found == {("article_reused", "a", 2), ("stored_count", "matched_groups", 2)}


def test_graph_order(spark):
    nodes = spark.createDataFrame([(DAY, "right", "r", 1, "t"), (DAY, "left", "b", 2, "t"), (DAY, "left", "a", 2, "t")], "issue_date date, side string, article_id string, page_number int, title string").withColumn(
        "node_id", g.node_id("side", "article_id")
    )
    assert [n.node_id for n in g.order_graph(nodes).collect()] == ["left:a", "left:b", "right:r"]
    links = spark.createDataFrame([(DAY, "left:b", "right:r"), (DAY, "left:a", "right:r"), (DAY, "left:zz", "right:r")], "issue_date date, source string, target string")
    assert [x.source for x in g.order_links(g.valid_links(links, nodes), nodes).collect()] == ["left:a", "left:b"]
    assert spark.range(1).select(g.resolve_date(F.lit(None).cast("date"))).first()[0] == "unknown-date"


def test_diagnosis_measures_matched_groups_only(spark):
    groups = spark.createDataFrame([(DAY, "m", None), (DAY, "big", "left_only")], "issue_date date, group_id string, match_type string")
    rows = [(DAY, "m", "left", "a"), (DAY, "m", "right", "b")] + [(DAY, "big", "left", f"x{i}") for i in range(9)]
    members = spark.createDataFrame(rows, "issue_date date, group_id string, side string, article_id string")
    stored = spark.createDataFrame([(DAY, 7, 3)], "issue_date date, matched_groups int, matched_left int")
    row = qa.diagnose(groups, members, stored, threshold=2).first()
    assert (row.matched_groups, row.max_group_size, row.suspicious_groups) == (1, 2, 1)
    assert (row.matched_left, row.matched_right, row.left_only, row.right_only) == (3, 1, 9, 0)
    assert [r.group_id for r in qa.oversized_groups(groups, members, 2).collect()] == ["m"]
