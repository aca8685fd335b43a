from collections import Counter

import corpus_pipeline as p
from corpusdiff.llm.common import stored
from tests.llm.edge_rows import TEXTS, edge_frame, empty_frame
from tests.llm.test_packing import check

SF = "/root/testdata/sf0.001"


def key(r):
    return tuple(str(r[c]) for c in p.COLUMNS)


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def kept_of_groups(rows, similarity=0.8):
    """Of each group of similar texts the row with the smallest id, by comparing all pairs."""
    sets = [shingles(r["text"]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for k, (g, r) in enumerate(zip(group, rows)):
        order = (r["doc_id"] is None, r["doc_id"] or 0, k)
        best[g] = min(best.get(g, (order, r)), (order, r), key=lambda x: x[0])
    return [r for _, r in best.values()]


def test_near_duplicates_of_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = p.near_duplicates(spark, docs, SF).collect()
    assert Counter(map(key, found)) == Counter(map(key, kept_of_groups(docs.collect())))


def test_mixing_drops_no_document_of_a_clean_corpus(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(labels, "doc_id").orderBy("doc_id")
    clean, others = docs.filter("quality = 1 AND toxic = 0"), docs.filter("NOT (quality = 1 AND toxic = 0)")
    n = clean.count()
    mostly = clean.unionByName(others.limit(max(1, n // 19))).select(*p.COLUMNS)
    kept = {r["doc_id"] for r in p.mixing(spark, stored(mostly, "mostly"), sf_dir).collect()}
    lost = {r["doc_id"] for r in clean.collect()} - kept
    assert len(lost) <= n // 50, f"{len(lost)} of {n}"


def test_stages_on_awkward_rows(spark):
    docs, seen = stored(edge_frame(spark), "edge"), {}
    for name, stage in p.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        seen[name] = docs.collect()
        if name != "packing":
            assert tuple(docs.columns) == p.COLUMNS
    letters = [r for r in TEXTS if any(c.isalpha() for c in r[1] or "")]
    assert Counter(r["text"] for r in seen["language_id"]) == Counter(r[1] for r in letters)
    assert all(r["lang"] for r in seen["language_id"])
    assert Counter(map(key, seen["near_duplicates"])) == Counter(map(key, kept_of_groups(seen["language_id"])))
    assert {r["doc_id"] for r in seen["near_duplicates"]} >= {1} and 2 not in {r["doc_id"] for r in seen["near_duplicates"]}
    masked = [r for r in seen["secret_scan"] if "[SECRET]" in r["text"]]
    assert [r["n_chars"] for r in masked] == [len(r["text"]) for r in masked] and len(masked) == 1
    assert {key(r) for r in seen["mixing"]} <= {key(r) for r in seen["secret_scan"]}
    check(seen["packing"], {r["doc_id"]: r["text"] for r in seen["mixing"]}, 2048)


def test_empty_table(spark):
    docs = stored(empty_frame(spark), "edge")
    for name, stage in p.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_run_on_the_given_tables(spark):
    assert p.run(spark, SF).count() > 0
