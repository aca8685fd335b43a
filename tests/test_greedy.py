"""Greedy one-to-one matching over classes of copies, and the search for all usable pairs, against looking at every pair."""

import random

import pytest
from pyspark.sql import functions as F

from corpusdiff.operators import similar as s
from corpusdiff.operators.grouping import greedy_one_to_one


def made(rng, n_left, n_right, share):
    """Classes with interleaved articles; few different confidences, so many ties."""
    articles = [("left", f"L{i}") for i in range(n_left)] + [("right", f"R{i}") for i in range(n_right)]
    members = []
    for pos in range(3 * len(articles)):
        side, name = rng.choice(articles) if pos >= len(articles) else articles[pos]
        members.append((side, name, f"a{pos:03d}", pos))
    pairs = [(f"L{i}", f"R{j}", rng.choice([0.5, 0.6, 0.6, 0.9])) for i in range(n_left) for j in range(n_right) if rng.random() < share]
    return members, pairs


def plain(members, pairs):
    of = {}
    for side, name, key, pos in members:
        of.setdefault(name, []).append((pos, key))
    every = sorted((-c, l_at, r_at) for l, r, c in pairs for l_at in of[l] for r_at in of[r])
    used, out = set(), []
    for c, left, right in every:
        if left not in used and right not in used:
            used |= {left, right}
            out.append((left[1], right[1], -c))
    return sorted(out)


@pytest.mark.parametrize("seed, chunk", [(1, 5000), (2, 3), (3, 1), (4, 10)])
def test_equals_taking_articles_one_by_one(spark, seed, chunk):
    rng = random.Random(seed)
    days = {f"2024-01-0{k}": made(rng, rng.randint(1, 7), rng.randint(1, 7), rng.choice([0.3, 1.0])) for k in range(1, 5)}
    rows = [(day, side, name, key, pos) for day, (members, _) in days.items() for side, name, key, pos in members]
    ranked = spark.createDataFrame(rows, "issue_date string, side string, class string, id string, pos long").selectExpr(
        "*", "CAST(row_number() OVER (PARTITION BY issue_date, side, class ORDER BY pos, id) AS BIGINT) AS rank"
    )
    pairs = spark.createDataFrame([(day, *p) for day, (_, found) in days.items() for p in found], "issue_date string, l_class string, r_class string, confidence double")
    got = greedy_one_to_one(pairs, ranked, chunk).collect()
    for day, (members, found) in days.items():
        assert sorted((r.l_article, r.r_article, r.confidence) for r in got if r.issue_date == day) == plain(members, found)


def test_two_equal_articles_on_each_side_make_two_pairs(spark):
    members = spark.createDataFrame([("d", "left", "A", "l1", 1, 1), ("d", "left", "A", "l2", 2, 2), ("d", "right", "B", "r1", 3, 1), ("d", "right", "B", "r2", 4, 2)],
                                    "issue_date string, side string, class string, id string, pos long, rank long")
    pairs = spark.createDataFrame([("d", "A", "B", 0.9)], "issue_date string, l_class string, r_class string, confidence double")
    assert sorted((r.l_article, r.r_article) for r in greedy_one_to_one(pairs, members).collect()) == [("l1", "r1"), ("l2", "r2")]
    assert greedy_one_to_one(pairs.limit(0), members).count() == 0


def test_similar_sets_miss_no_pair(spark):
    rng = random.Random(9)
    rows = []
    for k in range(160):
        base = rng.sample(range(40), rng.randint(1, 12))
        rows.append(("d", rng.choice(["left", "right"]), f"i{k}", rng.choice([0.2, 0.5, 0.8]), sorted(set(base + [rng.randint(0, 3)]))))
    rows += [("d", "left", "none", 0.5, []), ("e", "left", "i0", 0.5, [1, 2]), ("d", "right", "never", 1.5, [1, 2])]
    frame = spark.createDataFrame(rows, "issue_date string, side string, id string, need double, grams array<long>")
    got = {(r.l_id, r.r_id) for r in s.similar_sets(s.ordered_sets(frame, "grams")).collect()}
    need = {
        (a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and a[1] == "left" and b[1] == "right" and a[4] and b[4]
        and len({*a[4]} & {*b[4]}) / len({*a[4]} | {*b[4]}) >= max(a[3], b[3])
    }
    assert need <= got and len(got) < 0.7 * sum(r[1] == "left" for r in rows) * sum(r[1] == "right" for r in rows)


def test_contained_titles_of_any_length(spark):
    from corpusdiff.functions import text as t

    titles = ["a", "ab", "abc", "xabcx", "漢", "漢字", "x漢字x", "", "zz", "b", "ba"]
    frame = spark.createDataFrame([("d", side, f"{side[0]}{i}", x) for side in ("left", "right") for i, x in enumerate(titles)], "issue_date string, side string, id string, title_cmp string")
    frame = frame.withColumn("title_grams", t.shingle_codes("title_cmp", 2)).withColumn("need", F.lit(1.0))
    got = {(r.l_id, r.r_id) for r in s.contained_titles(frame.drop("need")).collect()}
    assert got == {(f"l{i}", f"r{j}") for i, a in enumerate(titles) for j, b in enumerate(titles) if a and b and (a in b or b in a)}
