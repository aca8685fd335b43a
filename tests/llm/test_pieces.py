import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from corpusdiff.llm import piece_rounds as p
from corpusdiff.llm.queries import op12_sentencepiece
from tests.llm.edge_rows import LONG, TEXTS, edge_frame, empty_frame

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
MODEL = p.pieces(p.DEFAULT_PATH)
STRANGE = ["", " ", "   ", "a", " a", "a ", "▁", "▁▁x ▁", "\x00", "\n\n\t", "<s> </s> <unk> <0x0A>", "é 漢字😀　z", "a" * 100, " " * 1000, "ab" * 300, LONG]


def check(texts):
    flat, sizes = p.encode_texts(MODEL, texts)
    ends = np.cumsum(sizes)
    decoded = p.decode_lists(MODEL, flat, sizes)
    for text, end, size, back in zip(texts, ends, sizes, decoded):
        expected = LIBRARY.encode(text or "")
        assert flat[end - size : end].tolist() == expected, text
        assert back == p.decode_ids(MODEL, expected) == LIBRARY.decode(expected), text


def test_strange_texts_equal_the_library():
    check([None, *STRANGE])


@pytest.mark.parametrize("kind", ["letters", "pieces", "codes"])
def test_random_texts_equal_the_library(kind):
    rng = random.Random(kind)
    surfaces = [s for s in MODEL.surface if s]
    one = {
        "letters": lambda: rng.choice("abcdefghinorstu  \n éèTH0123.,"),
        "pieces": lambda: rng.choice(surfaces),
        "codes": lambda: chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(32, 1200), rng.randint(0xE000, 0x10FFFF)])),
    }[kind]
    check(["".join(one() for _ in range(rng.randint(0, 120))) for _ in range(800)])


def test_any_ids_decode_as_in_the_library():
    rng = random.Random(5)
    for _ in range(2000):
        ids = [rng.choice([rng.randint(0, MODEL.count - 1), rng.randint(0, 300)]) for _ in range(rng.randint(0, 12))]
        assert p.decode_ids(MODEL, ids) == LIBRARY.decode(ids), ids
        assert p.decode_lists(MODEL, np.array(ids * 2, np.int64), np.array([len(ids)] * 2)) == [LIBRARY.decode(ids)] * 2


def test_pieces_that_may_be_followed_by_a_better_one_are_merged_one_at_a_time():
    assert MODEL.one_at_a_time.any()
    flagged = [MODEL.surface[i] for i in MODEL.one_at_a_time.nonzero()[0] if MODEL.surface[i]]
    check([s * 7 for s in flagged[:3000]])


def test_the_memory_of_words_stays_bounded(monkeypatch):
    monkeypatch.setattr(p, "MEMORY_WORDS", 10)
    MODEL.forget()
    texts = [" ".join(f"word{i}x{j}" for j in range(20)) for i in range(30)]
    for k in range(0, 30, 3):
        check(texts[k : k + 3])
        assert len(MODEL.memory) <= 10 + 60


def test_awkward_rows(spark):
    rows = p.decode(p.encode(edge_frame(spark))).collect()
    assert len(rows) == len(TEXTS) and set(edge_frame(spark).columns) < set(rows[0].asDict())
    for r in rows:
        assert r["ids"] == LIBRARY.encode(r["text"] or "") and r["decoded"] == (r["text"] or "")
    assert p.decode(p.encode(empty_frame(spark))).count() == 0
    assert p.decode(spark.createDataFrame([(None,), ([],), ([None, 259],)], "ids array<int>")).select("decoded").collect() == [("",), ("",), (" ",)]


def test_the_query_equals_the_library(spark):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = op12_sentencepiece(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids)))
