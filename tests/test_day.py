"""The build of a day against a plain-Python statement of the same rules."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from brute import Brute
from corpusdiff.operators import accept as ac
from corpusdiff.operators import candidates as c
from corpusdiff.operators import groups as gr
from corpusdiff.operators import pairs as p
from corpusdiff.operators import quality as qa
from corpusdiff.operators.articles import identify, normalize_articles
from corpusdiff.operators.grouping import Bounds, group_day, group_pairs, independence_blocks
from corpusdiff.operators.ranks import distributed_rank
from corpusdiff.plans.build import BuildOptions, build
from corpusdiff.plans.driver import DRIVER_RULES as R

WORDS = "stupid queque tiontion handle ththtion onstble elletion oument threea the and of with eauou mentela worthless idiot ement".split()
TITLES = ["Stupid onstble of the day", "The elletion report", "Quiet onstble news", "Short", "And then ththtion came", "thstble thing here", "In"]


def articles(n=60, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 12)))
        rows.append(dict(
            id=f"a{i:03d}", pos=i, side=rng.choice(["left", "right"]), issue_date=f"2024-01-0{rng.randint(1, 2)}",
            page_number=rng.randint(1, 9), title=rng.choice(TITLES), analysis_text=text,
        ))
    # One group of copies holds a third of all rows.
    for i in range(n // 2):
        rows.append(dict(
            id=f"c{i:03d}", pos=n + i, side="left" if i % 2 else "right", issue_date="2024-01-01", page_number=2,
            title="The copied story of today", analysis_text="stupid of the and queque",
        ))
    return rows


@pytest.fixture(scope="module")
def rows():
    return articles()


@pytest.fixture(scope="module")
def raw(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows))


@pytest.fixture(scope="module")
def frame(raw):
    return normalize_articles(raw, R)


def keyed(spark, rows, frame):
    """Brute-force candidates restricted to pairs that share a key, as the daily pool is."""
    from corpusdiff.operators.signals import article_signals

    keys = {r.id: r["keys"] for r in p.block_keys(article_signals(frame, R), R).select("id", "keys").collect()}
    return [x for x in Brute(R).candidates(rows) if set(keys[x["l"]["id"]]) & set(keys[x["r"]["id"]])]


@pytest.mark.parametrize("tile", [3, 128])
@pytest.mark.parametrize("limit", [7, 40, 100])
def test_pool_equals_brute_force(spark, rows, raw, frame, limit, tile):
    cands = c.candidate_pairs(raw, R, 0.1, tile=tile)
    found = c.select_pool(cands, p.class_members(identify(raw), limit), limit)
    mine = {(str(r.issue_date), r.pair_id) for r in found.select("issue_date", "pair_id").collect()}
    brute = Brute(R)
    all_cands = keyed(spark, rows, frame)
    expected = set()
    for day in ("2024-01-01", "2024-01-02"):
        of_day = [x for x in all_cands if x["l"]["issue_date"] == day]
        expected |= {(day, i) for i in brute.pool(of_day, limit)}
    assert mine == expected


def test_blocked_acceptance_loses_nothing(spark, rows, raw):
    """Pairs accepted among all pairs of a date are those accepted among pairs that share a key."""
    limit = 2000
    found = c.select_pool(c.candidate_pairs(raw, R, 0.1), p.class_members(identify(raw), limit), limit)
    mine = {r.pair_id for r in ac.accept(ac.without_decisions(found), used_judge=F.lit(False)).select("pair_id").collect()}
    assert mine == Brute(R).accepted(Brute(R).candidates(rows))


def test_build_properties(spark, rows):
    out = build(spark.createDataFrame(pd.DataFrame(rows)), R, options=BuildOptions())
    assert qa.check_invariants(out["matched"], out["members"]).count() == 0
    members = {(r.side, r.article_id) for r in out["members"].collect()}
    rest = {(r.side, r.id) for r in out["unmatched"].select("side", "id").collect()}
    assert not members & rest and len(members) + len(rest) == len(rows)
    m = out["metrics"].agg(*[F.sum(x).alias(x) for x in ("nodes", "matched_nodes", "isolated_nodes")]).first()
    assert m.nodes == len(rows) == m.matched_nodes + m.isolated_nodes and m.matched_nodes == len(members)


def test_blocks_give_the_result_of_the_date(spark, raw):
    limit = 300
    pool = c.select_pool(c.candidate_pairs(raw, R, 0.1), p.class_members(identify(raw), limit), limit)
    acc = ac.merge_fields(ac.accept(ac.without_decisions(pool), used_judge=F.lit(False)), R).cache()
    whole = {tuple(r) for r in group_pairs(acc, R).collect()}
    blocks = {tuple(r) for r in group_pairs(independence_blocks(acc), R, by=("issue_date", "block")).collect()}
    assert whole == blocks and whole


@pytest.mark.parametrize("n,m", [(1, 1), (5, 3), (4, 7), (6, 6), (3, 1)])
def test_title_groups_follow_from_ranks(spark, n, m):
    pairs = pd.DataFrame(
        [
            dict(issue_date="d", pair_id=f"l{i}r{j}", l_article=f"l{i}", r_article=f"r{j}", l_pos=i, r_pos=j, l_ctitle="samesame", r_ctitle="samesame",
                 title_kind="exact", cluster_key="k", merge_terms=[], concrete=True, accepted_confidence=0.92)
            for i in range(n) for j in range(m)
        ]
    )
    grouped = group_day(pairs, Bounds(), set()).merge(pairs, on="pair_id")
    expected = {
        (tuple(sorted(g.l_article.unique())), tuple(sorted(g.r_article.unique()))) for _, g in grouped.groupby("group_key")
    }
    rows = [("left", f"l{i}", i) for i in range(n)] + [("right", f"r{j}", j) for j in range(m)]
    titles = spark.createDataFrame(rows, "side string, id string, pos long").withColumns(
        {"issue_date": F.lit("2024-01-01").cast("date"), "page_number": F.lit(1), "ctitle": F.lit("samesame"),
         "cyear": F.lit(None).cast("string"), "ignorable": F.lit(False)}
    )
    mine = {(tuple(sorted(r.left_articles)), tuple(sorted(r.right_articles))) for r in gr.title_groups(titles).collect()}
    assert mine == expected


def test_title_years(spark):
    rows = [("left", "a", None, "x"), ("right", "b", "2025", "x"), ("left", "c", "2024", "y"), ("right", "d", "2025", "y"), ("left", "e", "2025", "y")]
    titles = spark.createDataFrame(rows, "side string, id string, cyear string, t string").select(
        "side", "id", "cyear", F.concat(F.lit("longtitle"), "t").alias("ctitle"), F.lit(0).alias("pos"), F.lit(1).alias("page_number"),
        F.lit("2024-01-01").cast("date").alias("issue_date"), F.lit(False).alias("ignorable"),
    )
    assert {r.group_id for r in gr.title_groups(titles).collect()} == {"matched:a:b", "matched:e:d"}


def test_distributed_rank(spark):
    rows = [("a", i) for i in range(500)] + [("b", i) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(5)
    got = {(r.k, r.v): r["rank"] for r in distributed_rank(df, ["k"], ["v"]).collect()}
    assert got == {(k, v): v + 1 for k, v in rows}


def test_decisions(spark):
    df = spark.createDataFrame(
        [("d", "p1", "exact", 0.0, 0.3, False), ("d", "p2", "strong_phrase", 0.0, 0.3, True), ("d", "p3", None, 0.8, 0.3, True), ("d", "p4", None, 0.5, 0.6, True)],
        "issue_date string, pair_id string, title_kind string, anchor_score double, confidence double, has_high_value boolean",
    ).withColumns({"l_article": F.col("pair_id"), "r_article": F.col("pair_id"), "l_ctitle": F.lit("x"), "r_ctitle": F.lit("x")})
    decisions = spark.createDataFrame(
        [("p1", True, 95.0, ""), ("p2", True, 59.5, "r"), ("p3", False, 150.0, None), ("p4", True, 99.0, "n"), ("zz", True, 99.0, "n")],
        "pair_id string, matched boolean, confidence double, reason string",
    )
    joined = ac.attach_decisions(df, decisions)
    rows = {r.pair_id: r for r in joined.withColumn("a", ac.accepted_confidence()).collect()}
    assert set(rows) == {"p1", "p2", "p3", "p4"} and rows["p3"].decision_confidence == 100 and rows["p2"].decision_confidence == 60
    assert (rows["p1"].a, rows["p2"].a, rows["p3"].a, rows["p4"].a) == (0.95, 0.84, 0.72, 0.99)
    assert {r.pair_id for r in ac.accept(joined).collect()} == {"p1", "p2"}
    assert {r.pair_id for r in ac.accept(joined, used_judge=F.lit(False)).collect()} == {"p1", "p2", "p3"}


def test_a_decision_on_any_copy_holds_for_its_classes(spark):
    rows = [("left", f"src:l{k}", "A", k) for k in (1, 2)] + [("right", f"src:r{k}", "B", k) for k in (1, 2)] + [("right", "r9", "C", 9)]
    identified = spark.createDataFrame([("2024-01-01", *r) for r in rows], "issue_date string, side string, id string, fingerprint string, pos int")
    cands = spark.createDataFrame([("2024-01-01", "A", "B", "pair:src:l1:src:r1"), ("2024-01-01", "A", "C", "pair:src:l1:r9")], "issue_date string, l_fingerprint string, r_fingerprint string, pair_id string")
    made = [("pair:src:l2:src:r2", True, 88.0, "yes"), ("pair:src:l1:src:r1", False, 99.0, "no"), ("pair:src:l2:src:r1", True, 40.0, "less"), ("pair:unknown", True, 90.0, "x"), ("pair:src:l7:r9", True, 90.0, "x")]
    decisions = spark.createDataFrame(made, "pair_id string, matched boolean, confidence double, reason string")
    found = {r.pair_id: (r.decision_matched, r.decision_confidence, r.decision_reason) for r in ac.attach_decisions(cands, decisions, identified).collect()}
    assert found == {"pair:src:l1:src:r1": (True, 88.0, "yes"), "pair:src:l1:r9": (None, None, None)}


def test_no_pair_of_the_pool_is_shuffled(spark, raw):
    """Sizes and pages of classes come with the rows of a pair, so what stands above the join of the tiles needs no exchange."""
    from corpusdiff.plans.build import candidate_pool

    pool = candidate_pool(raw, R, BuildOptions())
    plan = pool._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("array_intersect(l_keys")]
    assert "Join" not in above.rsplit("\n", 1)[0] and {"l_copies", "r_copies", "l_page", "r_page"} <= set(pool.columns)
    sizes = {(str(r.issue_date), r.side, r.fingerprint): (r.copies, r.page) for r in p.class_sizes(identify(raw)).collect()}
    for r in pool.collect():
        assert (r.l_copies, r.l_page) == sizes[str(r.issue_date), "left", r.l_fingerprint] and (r.r_copies, r.r_page) == sizes[str(r.issue_date), "right", r.r_fingerprint]


def test_judge_rows_come_with_the_pairs(spark, raw):
    """Both sides of a request are carried by the pairs, so these are not shuffled; the rows are those of a join, also for an id that occurs twice or has no row."""
    from corpusdiff.plans.build import candidate_pool

    flat = normalize_articles(raw, R).join(raw.select("id", F.col("analysis_text").alias("prompt_text")), "id").filter("id <> 'a003'")
    rows = flat.unionByName(flat.filter("id = 'c000'").withColumn("prompt_text", F.lit("another  text")))
    carried = ac.judge_input(candidate_pool(raw, R, BuildOptions(), ac.judge_sides(rows)), None, R)
    joined = ac.judge_input(candidate_pool(raw, R, BuildOptions()), rows, R)
    assert carried.schema == joined.schema
    found = sorted(map(repr, carried.collect()))
    assert found and found == sorted(map(repr, joined.collect()))
    plan = carried._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("array_intersect(l_keys")].rsplit("\n", 1)[0]
