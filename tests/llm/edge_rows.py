"""Rows with the awkward cases that every operator is held against."""

LONG = "lorem ipsum dolor sit amet " * 8000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away from here today.", "en", "a", 70),
    (2, "The quick brown fox jumps over the lazy dog and runs far away from here today.", "en", "a", 70),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (5, " \t\n\x0b ", "de", "b", 5),
    (6, LONG, "en", "b", len(LONG)),
    (7, "Der schnelle braune Fuchs springt über den faulen Hund und läuft heute sehr weit weg von hier.", "de", "b", 90),
    (8, "a b", "en", "b", 3),
    (8, "a b", "en", "b", 3),
    (None, "Ünï ÇA 漢字 😀 token = \"0123456789abcdef0123456789abcdef\" end", None, "c", 60),
    (9, "1234 5678 !!! ### 漢", "de", "c", 20),
    (10, "word\nword\nword\nother line\nword " * 3, "de", "c", 40),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_frame(spark):
    """The rows, with extra columns whose names clash with what operators add."""
    df = spark.createDataFrame(TEXTS, SCHEMA)
    for name in ("fp", "score", "spans", "rate", "n_words", "kept", "block", "id"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df


def empty_frame(spark):
    return edge_frame(spark).limit(0)
