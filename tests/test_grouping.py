"""Splitting, merging and choosing groups, against the rules stated one step at a time."""

import random
import time
import tracemalloc

import pandas as pd
import pytest

from pyspark.sql import functions as F

from corpusdiff.operators.grouping import Bounds, group_day, group_pairs
from corpusdiff.plans.driver import DRIVER_RULES

PLAIN = {"plainplain"}


def plain_groups(rows, bounds):
    """``{pair_id: (group_key, place)}``. Every step looks at all groups."""
    rows = sorted(rows, key=lambda r: (-r["accepted_confidence"], r["l_pos"], r["l_article"], r["r_pos"], r["r_article"]))
    order = sorted(range(len(rows)), key=lambda k: (rows[k]["l_pos"], rows[k]["l_article"], rows[k]["r_pos"], rows[k]["r_article"]))
    place = {k: n for n, k in enumerate(order)}

    def is_exact(r):
        return r["title_kind"] == "exact" and r["l_ctitle"] and r["l_ctitle"] == r["r_ctitle"]

    def lefts(g):
        return {rows[k]["l_article"] for k in g}

    def rights(g):
        return {rows[k]["r_article"] for k in g}

    def articles(g):
        return {("l", x) for x in lefts(g)} | {("r", x) for x in rights(g)}

    def fits(g):
        return max(len(lefts(g)), len(rights(g))) <= bounds.per_side and len(articles(g)) <= bounds.total and len(g) <= bounds.pairs

    def titles(g):
        return {rows[k]["l_ctitle"] for k in g if is_exact(rows[k])}

    def specific(g):
        return any(is_exact(rows[k]) or rows[k]["concrete"] for k in g)

    def terms(g):
        return {t for k in g if not is_exact(rows[k]) for t in rows[k]["merge_terms"]}

    def repeated(a, b, own, other, own_title):
        if not other(a) & other(b):
            return False
        return any(len(x) >= 8 and x not in PLAIN for x in {rows[k][own_title] for k in a} & {rows[k][own_title] for k in b})

    def mergeable(a, b):
        if not fits(a + b):
            return False
        if titles(a) & titles(b) or repeated(a, b, lefts, rights, "l_ctitle") or repeated(a, b, rights, lefts, "r_ctitle"):
            return True
        if not articles(a) & articles(b):
            return False
        return bool(terms(a) & terms(b)) or bool((titles(a) or titles(b)) and (specific(a) or specific(b)))

    seeds = {}
    for k, r in enumerate(rows):
        seeds.setdefault(r["cluster_key"] or r["pair_id"], []).append(k)
    parts = []
    for seed in seeds.values():
        connected = []
        for k in seed:
            touching = [g for g in connected if articles(g) & articles([k])]
            connected = [g for g in connected if g not in touching] + [sorted(sum(touching, [k]))]
        for g in connected:
            if fits(g):
                parts.append(g)
                continue
            made = []
            for k in g:
                for m in made:
                    if articles(m) & articles([k]) and fits(m + [k]):
                        m.append(k)
                        break
                else:
                    made.append([k])
            parts += made
    parts.sort(key=lambda g: g[0])
    changed = True
    while changed:
        changed = False
        for i in range(len(parts)):
            j = next((j for j in range(i + 1, len(parts)) if mergeable(parts[i], parts[j])), None)
            if j is not None:
                parts[i] = sorted(parts[i] + parts[j])
                del parts[j]
                changed = True
                break

    def selection(g):
        score = rows[g[0]]["accepted_confidence"] + (0.08 if titles(g) else 0) + (0.03 if specific(g) else 0)
        return -(score + (0.02 if len(g) > 1 and fits(g) else 0)), place[g[0]]

    used, out = set(), {}
    for g in sorted(parts, key=selection):
        if not articles(g) & used:
            used |= articles(g)
            out.update({rows[k]["pair_id"]: (rows[g[0]]["pair_id"], n) for n, k in enumerate(g)})
    return out


def pair(l, r, conf, kind, lt, rt, key, terms, concrete):
    return dict(
        issue_date="2024-01-01", pair_id=f"pair:l{l}:r{r}", l_article=f"l{l}", r_article=f"r{r}", l_pos=l, r_pos=r, l_ctitle=lt, r_ctitle=rt,
        title_kind=kind, cluster_key=key, merge_terms=terms, concrete=concrete, accepted_confidence=conf,
    )


def made_pairs(rng, n_left, n_right, share):
    titles = {("l", i): rng.choice(["title one", "title two", "plainplain", "short", f"own title {i}"]) for i in range(n_left)}
    titles |= {("r", i): rng.choice(["title one", "title two", "plainplain", "short", f"own title {i}"]) for i in range(n_right)}
    rows = []
    for l in range(n_left):
        for r in range(n_right):
            lt, rt = titles["l", l], titles["r", r]
            if lt == rt and rng.random() < 0.9:
                rows.append(pair(l, r, rng.choice([0.92, 0.92, 1.0]), "exact", lt, rt, f"exact-title:{lt}", [], True))
            elif rng.random() < share:
                term = rng.choice(["a", "b", "c"])
                key = rng.choice([f"anchor:{term}", f"anchor:{term}", None, f"right-title:{rt}"])
                rows.append(pair(l, r, rng.choice([0.7, 0.72, 0.84, 0.9]), rng.choice(["strong_phrase", None]), lt, rt, key, [term] if rng.random() < 0.7 else [], rng.random() < 0.5))
    return rows


def got(rows, bounds):
    frame = pd.DataFrame(rows).sample(frac=1, random_state=1)
    return {r.pair_id: (r.group_key, r.pair_order) for r in group_day(frame, bounds, PLAIN).itertuples()}


@pytest.mark.parametrize("bounds", [Bounds(), Bounds(3, 5, 7), Bounds(1, 2, 1), Bounds(2, 3, 8), Bounds(4, 8, 3), Bounds(3, 4, 20)])
def test_equals_the_rules_step_by_step(bounds):
    rng = random.Random(str(bounds))
    for _ in range(120):
        rows = made_pairs(rng, rng.randint(1, 9), rng.randint(1, 9), rng.choice([0.05, 0.2, 0.6]))
        if rows:
            assert got(rows, bounds) == plain_groups(rows, bounds)


def test_one_title_of_very_many_articles_takes_time_by_its_pairs():
    seconds = []
    for n in (80, 160):
        rows = [pair(l, r, 0.92 if (l * r) % 7 else 1.0, "exact", "title one", "title one", "exact-title:title one", [], True) for l in range(n) for r in range(n)]
        start = time.time()
        assert len({k for k, _ in got(rows, Bounds()).values()}) >= n // 4
        seconds.append(time.time() - start)
    assert seconds[1] < 10 * seconds[0] + 1 and seconds[1] < 30


def test_one_title_of_very_many_articles_takes_little_memory_a_pair():
    n = 120
    frame = pd.DataFrame([pair(l, r, 0.92 if (l * r) % 7 else 1.0, "exact", "title one", "title one", "exact-title:title one", [], True) for l in range(n) for r in range(n)])
    tracemalloc.start()
    group_day(frame, Bounds(), PLAIN)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 900 * n * n


def test_missing_titles_keys_and_ids_of_pairs(spark):
    """The same groups by date, by block of one frame, and through batches of several dates."""
    rows = [r | {"issue_date": f"2024-01-{1 + k % 3:02d}"} for k in range(3) for r in made_pairs(random.Random(k), 6, 6, 0.4)]
    for k, r in enumerate(rows):
        if k % 5 == 0:
            r |= {"cluster_key": None if k % 2 else "", "l_ctitle": None if k % 3 else r["l_ctitle"]}
    schema = "issue_date string, pair_id string, l_article string, r_article string, l_pos long, r_pos long, l_ctitle string, r_ctitle string, title_kind string, cluster_key string, merge_terms array<string>, concrete boolean, accepted_confidence double"
    frame = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema).withColumn("issue_date", F.col("issue_date").cast("date"))
    together = {(str(r.issue_date), r.pair_id, r.group_key, r.pair_order) for r in group_pairs(frame, DRIVER_RULES).collect()}
    days = {}
    for r in rows:
        days.setdefault(r["issue_date"], []).append(r)
    plain = set(DRIVER_RULES.generic_judge_terms)
    apart = {(d, x.pair_id, x.group_key, x.pair_order) for d, own in days.items() for x in group_day(pd.DataFrame(own), Bounds(), plain).itertuples()}
    assert together == apart and len(days) == 3
