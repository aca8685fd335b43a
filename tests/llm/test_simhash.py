import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from corpusdiff.llm import simhash_gray as s
from tests.llm.edge_rows import TEXTS, edge_frame, empty_frame


def plain_print(text, width=3):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, bits=3):
    root = {i: i for i in range(len(ids))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= bits:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def clusters(n=150, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n, dtype=np.uint64)
    made = [base]
    for _ in range(5):
        flips = [[1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)] for _ in base]
        made.append(base ^ np.array([np.bitwise_xor.reduce(np.array(f, np.uint64)) if f else 0 for f in flips], np.uint64))
    return np.unique(np.concatenate(made))


def test_fingerprints_equal_a_plain_count():
    for _, text, *_ in TEXTS:
        if text is None or len(text) < 1000:
            assert s.fingerprint(text) == plain_print(text)


def test_index_finds_every_pair():
    values = clusters()
    index = s.GrayIndex(np.zeros(len(values), int), values)
    found = {frozenset((int(index.values[i]), int(index.values[j]))) for a, b in index.pairs(3) for i, j in zip(a, b)}
    true = {frozenset((int(x), int(y))) for k, x in enumerate(values) for y in values[:k] if bin(int(x) ^ int(y)).count("1") <= 3}
    assert found == true


def test_components_with_and_without_tiles(spark):
    values = clusters()
    ids = list(range(len(values)))
    want = plain_components(ids, [int(v) for v in values])
    entries = spark.createDataFrame([(i, i, [int(v.view(np.int64))]) for i, v in zip(ids, values)], "id long, node long, w array<long>")
    for tile in (20_000, 3):
        links = s.connected_components(s.fingerprint_links(entries, tile=tile))
        named = entries.join(links, "node", "left").collect()
        first = {}
        for r in named:
            first[r["component"]] = min(first.get(r["component"], r["id"]), r["id"])
        got = {r["id"]: r["id"] if r["component"] is None else first[r["component"]] for r in named}
        assert [got[i] for i in ids] == want


def test_awkward_rows(spark):
    got = s.simhash_components(edge_frame(spark)).collect()
    prints = [plain_print(t) if t is None or len(t) < 1000 else s.fingerprint(t) for _, t, *_ in TEXTS]
    want = plain_components([r[0] for r in TEXTS], prints)
    assert sorted(map(str, ((r["doc_id"], r["component_id"]) for r in got))) == sorted(map(str, zip([r[0] for r in TEXTS], want)))
    assert s.simhash_components(empty_frame(spark)).count() == 0


def test_similar_texts_meet_and_others_do_not(spark):
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(3000)]
    rows, truth = [], []
    for group in range(25):
        text = list(rng.choice(words, 300))
        rows.append((len(rows), " ".join(text)))
        truth.append(group)
        for _ in range(2):
            copy = list(text)
            for at in rng.choice(300, 4, replace=False):  # about 0.87 of the five-word shingles stay common
                copy[at] = "other"
            rows.append((len(rows), " ".join(copy)))
            truth.append(group)
    found = {r["doc_id"]: r["component_id"] for r in s.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {g: truth.index(g) for g in truth}
    assert sum(found[k] == first[g] for k, g in enumerate(truth)) >= 0.97 * len(rows)
    assert all(truth[found[k]] == g for k, g in enumerate(truth))


def jaccard_components(texts):
    sets = []
    for text in texts:
        ws = text.lower().split()
        sets.append({" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_similar_components_are_those_of_exact_jaccard(spark):
    rng = np.random.default_rng(21)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for group in range(60):  # similarities from 0.6 to 0.95, many close to 0.8 on both sides
        text = list(rng.choice(words, int(rng.integers(8, 300))))
        texts.append(" ".join(text))
        for share in (0.1, 0.12, 0.2, 0.25):
            copy, changed = list(text), max(1, round(share * len(text)))
            at = int(rng.integers(0, len(text) - changed + 1))
            copy[at : at + changed] = list(rng.choice(words, changed))
            texts.append(" ".join(copy))
    texts += ["a b c d e f g h", "a b c d e f g h i", "a b c d e f g h i"]  # four and five shingles: 0.8
    loop = list(rng.choice(words, 20))
    texts += [" ".join(loop * 10 + list(rng.choice(words, 12))) for _ in range(2)]  # equal but for a tail, if repeats counted
    dense = list(rng.choice(words, 200))
    for _ in range(300):  # more than one tile
        copy = list(dense)
        copy[int(rng.integers(0, 200))] = "other"
        texts.append(" ".join(copy))
    found = {r["doc_id"]: r["component_id"] for r in s.similar_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[k] for k in range(len(texts))] == jaccard_components(texts)


def test_similar_awkward_rows(spark):
    rows = s.similar_components(edge_frame(spark)).collect()
    assert len(rows) == len(TEXTS) and s.similar_components(empty_frame(spark)).count() == 0
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1} and {r["component_id"] for r in rows if r["doc_id"] in (3, 4, 5)} == {3}


def test_the_membership_filter_misses_no_key(spark):
    from corpusdiff.llm.common import maybe_among

    df = spark.range(20_000).selectExpr("id", "CAST(id AS STRING) AS name", "'x' AS block")
    marked = maybe_among(df, F.col("name"), df.filter("id % 50 = 0").select("name"), "maybe")
    found = {r["id"] for r in marked.filter("maybe").collect()}
    assert {k for k in range(0, 20_000, 50)} <= found and len(found) < 600 and marked.columns == ["id", "name", "block", "maybe"] and marked.count() == 20_000
    assert maybe_among(df, F.col("name"), df.limit(0).select("name"), "maybe").filter("maybe").count() == 0
