import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusdiff.llm import variants as v
from corpusdiff.llm.common import stored
from corpusdiff.llm.queries import op11_spelling_variants
from tests.llm.edge_rows import edge_frame, empty_frame


def plain_words(docs, least_length=5, least_count=3):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            counts[run if h % 97 else run[:at] + run[at + 1 :]] += 1
    return {w: n for w, n in counts.items() if n >= least_count and len(w) >= least_length}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs, **options):
    counts = plain_words(docs, **options)
    near = {w: [x for x in counts if is_near(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    rows = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(rows)


def got(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def docs_frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS word", "'x' AS n", "'y' AS form")


def made_docs(seed, n=250):
    """Few letters and typing errors, so words have many near ones, chains of forms and ties."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(4, 7))) for _ in range(120)] + ["aaaaaaaa", "AAAAAAA", "ÀÉÿ÷×abc", "été été"]
    def typed():
        w = rng.choice(words[: rng.randint(1, len(words))])
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randint(0, len(w))
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abcéz") + w[at:], w[:at] + rng.choice("abcéz") + w[at + 1 :]])
        return w
    return [(rng.choice([i, 5, None]), rng.choice([None, "", " ".join(typed() for _ in range(60))] + [" ".join(typed() for _ in range(60))] * 6)) for i in range(n)]


def test_equals_all_comparisons(spark):
    docs = made_docs(1)
    expected = plain(docs)
    assert len(expected) > 200 and any(r[2] != r[1] and r[1] for r in expected)  # a chain of forms
    assert got(v.variants(docs_frame(spark, docs).repartition(4))) == expected


def test_small_filters_are_probed_in_passes(spark):
    docs = made_docs(2, 120)
    assert len(v.plan(Counter(map(len, plain_words(docs))), 64)) > 5
    assert got(v.variants(docs_frame(spark, docs), filter_bytes=64)) == plain(docs)


def test_a_full_filter_costs_work_but_no_result(spark, monkeypatch):
    monkeypatch.setattr(v, "BITS_PER_WORD", 1)
    docs = made_docs(3, 60)
    assert got(v.variants(docs_frame(spark, docs))) == plain(docs)


@pytest.mark.parametrize("word", ["abc", "aabb", "é", "aaaa"])
def test_edit_hashes_are_those_of_the_edits(word):
    def full(text):
        return v.hash_parts(np.array([[ord(c) for c in text]], np.uint32).reshape(1, -1))[0][0, -1]

    codes = np.array([[ord(c) for c in word]], np.uint32)
    alphabet = np.array([ord(c) for c in "abé"], np.uint32)
    every = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in "abé" if c > word[i]}
    filters = {}
    for text in sorted(every | {"zz", "zzz", "zzzz"}):
        shard = v.Shard(len(text), 1, 0, 64)
        table = dict(filters.get(len(text), [])).get(shard, np.zeros(64, np.uint64))
        block, mask = v.block_and_mask(v.mixed(np.array([full(text)])), 64)
        table[block] |= mask
        filters[len(text)] = [(shard, table)]
    found = [e for _, e in v.edits(codes, alphabet, filters)]
    assert len(found) == len(set(found)) and set(found) == every


def test_very_long_words_and_awkward_rows(spark):
    long = "xyz" * 30_000
    docs = [(i, long if i % 2 else long[:-1]) for i in range(8)] + [(9, "Word word wOrd wordy wordy wordy")]
    rows = got(v.variants(docs_frame(spark, docs), least_count=2, least_length=4))
    assert rows == plain(docs, least_count=2, least_length=4)
    shown = [(r["doc_id"], r["text"]) for r in edge_frame(spark).collect()]
    assert got(v.variants(edge_frame(spark), least_count=1)) == plain(shown, least_count=1)
    assert got(v.variants(empty_frame(spark))) == []


def test_each_pair_comes_once(spark):
    words = ["aaaaa", "aaaa", "aaaab", "baaaa", "aaaaaa", "zzzzz"]
    vocab = stored(spark.createDataFrame([(w, 5, len(w)) for w in words], "word string, n long, length int"), "vocab")
    pairs = [(r["word"], r["other"]) for r in v.near_words(vocab).collect()]
    assert sorted(map(sorted, pairs)) == sorted(sorted((a, b)) for i, a in enumerate(words) for b in words[:i] if is_near(a, b))


def test_the_query_equals_all_comparisons(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id % 4 = 0").collect()]
    expected = plain(docs)
    spark_docs = docs_frame(spark, docs)
    assert got(v.variants(spark_docs)) == expected
    assert op11_spelling_variants(spark, sf_dir).count() == len(plain_words([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]))
