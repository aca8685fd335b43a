import re

from pyspark.sql import functions as F

from corpusdiff.llm import quality_cascade as q
from tests.llm.edge_rows import TEXTS, edge_frame, empty_frame


def counts(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)} if len(grams) < 500 else None
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), covered


def test_counts_equal_a_plain_count(spark):
    got = q.measure(edge_frame(spark)).collect()
    by_text = {r["text"]: r for r in got}
    assert len(got) == len(TEXTS)
    for _, text, *_ in TEXTS:
        row, (n, chars, symbols, dup, covered) = by_text[text], counts(text)
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"]) == (n, chars, symbols, dup)
        assert row["n_repeat_words"] == (n if covered is None else len(covered))


def test_cascade_names_the_first_rule_and_order_does_not_change_the_verdict(spark):
    df, rules = edge_frame(spark), q.production_rules()
    measured = q.measure(df)
    forward = q.cascade(measured, rules).select("text", "kept", "failed_rule").collect()
    backward = q.cascade(measured, rules[::-1]).select("text", "kept").collect()
    assert sorted((str(r["text"]), r["kept"]) for r in forward) == sorted((str(r["text"]), r["kept"]) for r in backward)
    assert {r["failed_rule"] for r in forward if r["text"] is None} == {"few_words"}
    left = q.filter_rows(df, rules)
    assert left.columns == df.columns and left.count() == sum(r["kept"] for r in forward)


def test_rules_are_ordered_by_rejections_per_cost(spark):
    rules = [q.Rule("never", F.lit(False)), q.Rule("always", F.lit(True))]
    ordered = q.order_rules(edge_frame(spark), rules, fraction=1.0)
    assert [r.name for r in ordered] == ["always", "never"]


def test_empty_table(spark):
    assert q.quality_rules(empty_frame(spark)).count() == 0
