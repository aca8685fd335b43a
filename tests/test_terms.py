import random

from corpusdiff.operators import terms as m


def test_terms_in_texts_equal_looking_for_each(spark):
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60)))) for i in range(80)] + [(90, None), (91, "漢字 a 😀")]
    terms = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 5))) for _ in range(150)] + ["", "漢字", "字 a", "😀"]
    frame = spark.createDataFrame(texts, "id long, title string").selectExpr("*", "'x' AS other")
    expected = sorted((i, t) for i, text in texts for t in set(terms) if t and text and t in text)
    for part_chars in (1_000_000, 40):
        parts = list(m.term_parts(spark.createDataFrame([(t,) for t in terms], "term string"), part_chars))
        assert sorted(t for p in parts for t in p) == sorted(set(terms) - {""}) and (len(parts) == 1) == (part_chars > 1000)
        hits = m.term_hits(frame, spark.createDataFrame([(t,) for t in terms], "term string"), part_chars=part_chars)
        assert hits.columns == ["id", "other", "term"] and sorted((r.id, r.term) for r in hits.collect()) == expected
    assert m.term_hits(frame, spark.createDataFrame([("",)], "term string")).count() == 0


def test_fifty_thousand_terms_are_one_pass(spark):
    rng = random.Random(3)
    terms = [("".join(rng.choice("abcdefgh") for _ in range(9)),) for _ in range(50_000)]
    texts = [(0, terms[7][0] + terms[8][0]), (1, "none")]
    hits = m.term_hits(spark.createDataFrame(texts, "id long, title string"), spark.createDataFrame(terms, "term string")).collect()
    assert {r.term for r in hits} >= {terms[7][0], terms[8][0]} and {r.id for r in hits} == {0}
