"""Independence blocks of titles with very many pairs."""

from corpusdiff.operators.grouping import block_edges, independence_blocks


def test_blocks_link_the_articles_of_a_title_without_its_pairs(spark):
    exact = [("2024-01-01", f"l{i}", f"r{j}", "exact", "t") for i in range(12) for j in range(12) if (i + j) % 3]
    other = [("2024-01-01", "l3", "r90", None, "x"), ("2024-01-01", "l80", "r91", "strong_phrase", "y"), ("2024-01-02", "l3", "r3", None, "t")]
    pairs = spark.createDataFrame(exact + other, "issue_date string, l_article string, r_article string, title_kind string, l_ctitle string")
    assert block_edges(pairs).count() == 24 + 3
    blocks = {(r.issue_date, r.l_article, r.r_article): r.block for r in independence_blocks(pairs).collect()}
    assert len(blocks) == len(exact) + 3
    assert {blocks[x[:3]] for x in exact} == {blocks["2024-01-01", "l3", "r90"]}
    assert len(set(blocks.values())) == 3
