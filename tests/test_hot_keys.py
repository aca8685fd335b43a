"""What a title of very many different articles costs before its pairs are scored."""

from pyspark.sql import functions as F

from corpusdiff.operators import pairs as p
from corpusdiff.operators.scoring import jaccard
from corpusdiff.plans.driver import DRIVER_RULES as R
from corpusdiff.session import tune


def one_title(spark, n_left, n_right):
    """Signals of different articles of one title."""
    rows = [(f"{side[0]}{i}", side) for side, n in (("left", n_left), ("right", n_right)) for i in range(n)]
    return spark.createDataFrame(rows, "id string, side string").selectExpr(
        "date '2024-01-01' AS issue_date", "id", "side", "'one long title' AS title", "'onelongtitle' AS ctitle", "array()::array<string> AS anchors", "false AS ignorable"
    )


def test_copies_of_a_row_of_a_hot_key_are_bounded(spark):
    found = p.pairs_blocked(one_title(spark, 40, 30), R, tile=1).select("l_id", "r_id", "tl", "tr").collect()
    assert len(found) == len({(r.l_id, r.r_id) for r in found}) == 1200
    for own, other in (("l_id", "tr"), ("r_id", "tl")):
        sent = {(r[own], r[other]) for r in found}
        assert len(sent) <= p.MOST_CUTS * len({r[own] for r in found})


def test_jaccard_of_sets_without_elements(spark):
    rows = spark.createDataFrame([([], []), ([1, 2], []), ([1, 2], [2, 3]), (None, [1])], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in rows.select(jaccard(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 1 / 3, None]


def test_long_methods_are_not_left_to_the_interpreter(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    tune(spark)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
