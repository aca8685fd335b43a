import numpy as np

from corpusdiff.llm import langid_hd as h
from tests.llm.edge_rows import TEXTS, edge_frame, empty_frame

EN = "the house of the river and the wind that blows over the green hills in the morning"
DE = "das haus an dem fluss und der wind der über die grünen hügel am morgen weht"


def plain_vector(text):
    codes = []
    for c in [" ", *text.lower(), " "]:
        code = ord(c) if c.isalpha() else 0
        if code or not codes or codes[-1]:
            codes.append(code)
    total = np.zeros(h.DIMENSIONS)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        total += np.roll(h.letter_vector(a), 2).astype(int) * np.roll(h.letter_vector(b), 1) * h.letter_vector(c)
    return total


def test_bundles_equal_a_plain_sum():
    texts = [EN, DE, "x", "ab 漢字!! 12 é"]
    got = h.bundle([h.letters_of(t) for t in texts], h.Vectors())
    assert np.array_equal(got, np.stack([plain_vector(t) for t in texts]))
    small = h.bundle([h.letters_of(t) for t in texts], h.Vectors(most=5))  # a cache that overflows
    assert np.array_equal(small, got)


def test_predictions_and_awkward_rows(spark):
    training = spark.createDataFrame([(EN, "en"), (DE, "de"), (None, "de"), ("no label", None)], "text string, lang string")
    got = h.identify(edge_frame(spark), training)
    rows = {(r["doc_id"], r["text"]): r for r in got.collect()}
    assert got.count() == len(TEXTS)
    for _, text, *_ in TEXTS:
        row = next(r for k, r in rows.items() if k[1] == text)
        assert 0 <= row["score"] <= 1
        assert (row["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    assert rows[(1, TEXTS[0][1])]["lang_pred"] == "en" and rows[(7, TEXTS[6][1])]["lang_pred"] == "de"


def test_nothing_learned_and_empty_table(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert {r["lang_pred"] for r in h.identify(edge_frame(spark), none).collect()} == {"und"}
    assert h.identify(empty_frame(spark), none).count() == 0


def test_held_out_accuracy(spark):
    from corpusdiff.llm.queries import op2_language_id

    sf = "/root/testdata/sf0.001"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in op2_language_id(spark, sf).collect() if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in rows) >= 0.97 * len(rows) > 0
