import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusdiff.llm import packing as p
from corpusdiff.llm import token_counts as t
from corpusdiff.llm.tokens import DEFAULT_PATH, encoder
from tests.llm.edge_rows import TEXTS, edge_frame, empty_frame

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
STRANGE = ["", "a<|endoftext|>b", "Ünï 漢字 😀😀 x\n\n\n y  ", "'s're don't 12³ \x0b  x", "é‍   　z", TEXTS[5][1][:5000]]


@pytest.mark.parametrize("text", STRANGE)
def test_ids_and_offsets_equal_the_library(text):
    encoded = TOKENIZER.encode(text, add_special_tokens=False)
    mine = encoder(DEFAULT_PATH)
    assert mine.ids(text).tolist() == encoded.ids
    starts, ends = mine.spans(text)
    assert list(zip(starts.tolist(), ends.tolist())) == [tuple(o) for o in encoded.offsets]


def test_plan_places_all_and_two_fit_helps():
    assert p.plan({6: 2, 5: 2, 4: 2}, 10) and sum(n for _, n in p.plan({6: 2, 5: 2, 4: 2}, 10)) == 3
    # greedy takes 6 + 3; the gap of 4 is filled by 2 + 2 instead
    assert ([6, 2, 2], 1) in p.plan({6: 1, 3: 1, 2: 2}, 10)
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.randint(5, 60)
        sizes = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 200)))
        made = p.plan(dict(sizes), capacity)
        placed = Counter()
        for lengths, times in made:
            assert sum(lengths) <= capacity and times > 0
            for x in lengths:
                placed[x] += times
        assert placed == sizes


def check(rows, texts, capacity):
    ids = {k: np.append(np.array(TOKENIZER.encode(x or "", add_special_tokens=False).ids, "<u4"), 0).astype("<u4") for k, x in texts.items()}
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    for key, held in by_doc.items():
        repeats = Counter(held)
        at = 0
        for number, (piece, start, length) in enumerate(sorted(repeats)):
            assert (piece, start) == (number, at) and (number == 0 or length == capacity)
            at += length
        assert at == len(ids[key])
    return sequences


def test_packed_rows(spark):
    rows = p.pack(edge_frame(spark), capacity=64).collect()
    texts = {r[0]: r[1] for r in TEXTS}
    sequences = check(rows, texts, 64)
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-total // 64) + 1
    assert {r["doc_id"] for r in rows} == set(texts)
    assert p.pack(empty_frame(spark)).count() == 0


def test_sequences_hold_the_ids(spark):
    packed = p.pack(edge_frame(spark), capacity=64, keep_ids=True)
    whole = {r["sequence_id"]: r["ids"] for r in p.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]


def plain_allocation(starts, ends, bounds, rule):
    counts = [0.0] * (len(bounds) - 1)
    for a, b in zip(starts, ends):
        share = [max(0, min(b, bounds[k + 1]) - max(a, bounds[k])) for k in range(len(counts))]
        if rule == "split":
            for k, x in enumerate(share):
                counts[k] += x / sum(share)
        elif rule == "first":
            counts[next(k for k in range(len(counts)) if bounds[k] <= a < bounds[k + 1])] += 1
        else:
            counts[share.index(max(share))] += 1
    return counts


@pytest.mark.parametrize("rule", t.RULES)
def test_allocation_equals_a_plain_loop(rule):
    text = "ab  \n\n\n  cd Ünï\n\n漢字\n x"
    starts, ends = encoder(DEFAULT_PATH).spans(text)
    for bounds in ([0, 3, 5, 6, 9, len(text)], [0, 0, len(text)], [0, *range(1, len(text) + 1)]):
        got, _ = t.allocate(starts, ends, np.array(bounds), rule)
        assert np.allclose(got, plain_allocation(starts.tolist(), ends.tolist(), bounds, rule))


@pytest.mark.parametrize("rule", t.RULES)
def test_counts_sum_to_the_whole_text(spark, rule):
    rows = t.token_counts(edge_frame(spark), fields=("source", "text"), rule=rule).collect()
    total = Counter()
    for r in rows:
        total[r["doc_id"]] += r["n_tokens"]
    want = Counter()
    for key, text, _, source, _ in TEXTS:
        want[key] += len(TOKENIZER.encode((source or "") + "\n" + (text or ""), add_special_tokens=False).ids)
    assert {k: round(v, 6) for k, v in total.items()} == dict(want)
    assert t.token_counts(empty_frame(spark)).count() == 0
