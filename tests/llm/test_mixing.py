import numpy as np

from corpusdiff.llm import mixing as m
from tests.llm.edge_rows import TEXTS, edge_frame, empty_frame


def members(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([0.4, 0.4, 0.4], n)
    tokens = rng.integers(0, 500, n)
    rows = [(int(k), int(t), x.tolist()) for k, (t, x) in enumerate(zip(tokens, p))]
    return spark.createDataFrame(rows, "doc_id long, n_tokens long, posterior array<double>"), p, tokens


def test_rates_meet_the_targets(spark):
    df, p, tokens = members(spark)
    targets = {"a": 0.7, "b": 0.2, "c": 0.1}
    steps = m.fit_rates(df, targets, ["a", "b", "c"])
    rates = {r["doc_id"]: r["rate"] for r in df.withColumn("rate", m.rates_column(df.posterior, steps)).collect()}
    rate = np.array([rates[k] for k in range(len(p))])
    assert (rate >= 0).all() and (rate == 0).any()
    assert np.allclose((rate * tokens) @ p, np.array([0.7, 0.2, 0.1]) * tokens.sum(), rtol=1e-4)
    assert np.allclose(rate, m._rates(p, steps))


def test_targets_out_of_reach_lower_the_error(spark):
    df = spark.createDataFrame([(1, 100, [0.5, 0.5]), (2, 100, [0.6, 0.4])], "doc_id long, n_tokens long, posterior array<double>")
    steps = m.fit_rates(df, {"a": 0.0, "b": 1.0}, ["a", "b"])
    p = np.array([[0.5, 0.5], [0.6, 0.4]])
    goal = np.array([0, 200.0])
    assert np.linalg.norm((m._rates(p, steps) * 100) @ p - goal) < np.linalg.norm((np.ones(2) * 100) @ p - goal)


def test_classifier_and_awkward_rows(spark):
    labelled = spark.createDataFrame([("good fine words here", "x")] * 30 + [("bad stupid words", "y")] * 30 + [(None, "y"), ("no domain", None)], "text string, domain string")
    mixed = m.mix(edge_frame(spark), labelled, {"x": 1.0, "y": 1.0})
    rows = mixed.collect()
    assert len(rows) == len(TEXTS) and set(edge_frame(spark).columns) <= set(mixed.columns)
    assert all(abs(sum(r["posterior"]) - 1) < 1e-9 and r["rate"] >= 0 for r in rows)
    assert len({r["rate"] for r in rows if r["doc_id"] == 8}) == 1
    names, weights = m.fit_classifier(labelled, "text", "domain")
    tests = spark.createDataFrame([("fine good",), ("stupid bad",)], "text string")
    top = [names[int(np.argmax(r["posterior"]))] for r in m.domain_posteriors(tests, names, weights).collect()]
    assert top == ["x", "y"]


def test_no_labels_and_empty_table(spark):
    none = spark.createDataFrame([], "text string, domain string")
    assert {r["rate"] for r in m.mix(edge_frame(spark), none, {"x": 1.0}).collect()} == {1.0}
    assert m.mix(empty_frame(spark), none, {}).count() == 0


def test_copies_follow_the_rate(spark):
    from pyspark.sql import functions as F

    df = spark.range(4000).withColumn("rate", F.lit(1.3)).select("id", m.copies(F.col("rate"), "id").alias("n"))
    row = df.agg(F.min("n"), F.max("n"), F.avg("n")).first()
    assert row[0] == 1 and row[1] == 2 and abs(row[2] - 1.3) < 0.05
