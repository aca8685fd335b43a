"""Archive of any nesting, index upkeep, navigation over range partitions, reasons of one-sided groups."""

import datetime as dt
import json

from pyspark.sql import functions as F

from corpusdiff.operators import graph as g
from corpusdiff.operators import groups as gr
from corpusdiff.rules import NEWSPAPER_RULES as R
from corpusdiff.sources import archive as ar
from corpusdiff.streaming.refresh import refresh


def test_snapshots_of_any_nesting(spark, tmp_path):
    groups = [{"id": "g1"}, {"id": "g2"}]
    files = {
        "a.json": {"issueDate": "2026-05-01", "matchGroups": groups, "counts": {"n": 1}, "generatedAt": "t"},
        "2026-05-02.json": {"result": {"matchGroups": groups, "counts": {"n": 2}, "leftIssue": {"pages": []}}},
        "c.json": {"snapshot": {"issueDate": "2026-05-03", "matchGroups": groups, "judge": None}, "judge": {"model": "m"}},
        "d.json": {"date": "2026-05-04", "issueDate": "", "groups": groups},
        "x-2026-05-05.json": {"matchGroups": None, "groups": groups[:1]},
        "2026-05-06.json": {"matchGroups": []}, "e.json": {"matchGroups": groups}, "index.json": {"issueDate": "2026-05-07", "matchGroups": groups}, "2026-05-08.json": [1, 2],
    }
    for name, body in files.items():
        (tmp_path / name).write_text(json.dumps(body))
    (tmp_path / "2026-05-09.json").write_text("{broken")
    (tmp_path / "2026-05-10.txt").write_text(json.dumps({"matchGroups": groups}))
    found = ar.scan_archive(spark, str(tmp_path)).select(
        "file_name", "issue_date", "generated_at", F.try_variant_get("counts", "$.n", "int").alias("n"), F.try_variant_get("judge", "$.model", "string").alias("model"),
        F.transform("match_groups", lambda x: F.variant_get(x, "$.id", "string")).alias("ids"),
    )
    got = {r.file_name: (str(r.issue_date), r.generated_at, r.n, r.model, r.ids) for r in found.collect()}
    both = ["g1", "g2"]
    assert got == {
        "a.json": ("2026-05-01", "t", 1, None, both), "2026-05-02.json": ("2026-05-02", None, 2, None, both), "c.json": ("2026-05-03", None, None, "m", both),
        "d.json": ("2026-05-04", None, None, None, both), "x-2026-05-05.json": ("2026-05-05", None, None, None, both[:1]),
    }
    assert [str(r.issue_date) for r in ar.scan_archive(spark, str(tmp_path), start="2026-05-02", days=2).orderBy("issue_date").collect()] == ["2026-05-02", "2026-05-03"]


def test_index_after_refresh_backfill_and_rebuild_is_the_same(spark, tmp_path):
    landed, archive, index = (str(tmp_path / name) for name in ("landed", "archive", "index"))
    entry = lambda rows: rows.groupBy("issue_date").agg(F.count("*").alias("n"), F.sum("v").alias("total"))

    def land(rows):
        spark.createDataFrame(rows, "issue_date date, v int").write.mode("append").parquet(landed)

    def run(checkpoint):
        stream = spark.readStream.schema("issue_date date, v int").parquet(landed)
        refresh(stream, lambda: spark.read.parquet(landed), lambda rows: rows, archive, checkpoint, entry, index).awaitTermination()
        return sorted((str(r.issue_date), r.n, r.total) for r in spark.read.parquet(index).collect())

    days = [dt.date(2026, 5, k) for k in range(1, 5)]
    land([(days[0], 1), (days[1], 2), (days[1], 3)])
    assert run(str(tmp_path / "p1")) == [("2026-05-01", 1, 1), ("2026-05-02", 2, 5)]
    land([(days[1], 10), (days[2], 4)])
    after = [("2026-05-01", 1, 1), ("2026-05-02", 3, 15), ("2026-05-03", 1, 4)]
    assert run(str(tmp_path / "p1")) == after and run(str(tmp_path / "p2")) == after  # a lost progress log repeats all batches
    dates = spark.createDataFrame([(days[3],), (days[2],)], "issue_date date")
    build = lambda todo: todo.withColumn("v", F.lit(7))
    ar.backfill(dates, spark.read.parquet(archive), build, archive, index=entry, index_path=index).collect()
    kept = sorted((str(r.issue_date), r.n, r.total) for r in spark.read.parquet(index).collect())
    assert kept == [*after, ("2026-05-04", 1, 7)]
    ar.rebuild_index(spark.read.parquet(archive), entry, str(tmp_path / "anew"))
    assert sorted((str(r.issue_date), r.n, r.total) for r in spark.read.parquet(str(tmp_path / "anew")).collect()) == kept


def test_navigation_over_many_partitions(spark):
    days = [dt.date(2026, 1, 1) + dt.timedelta(days=3 * k) for k in range(57)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dates = spark.createDataFrame([(x,) for x in days[::-1]], "issue_date date").repartition(5)
        nav = g.date_navigation(dates, radius=20)
        rows = {r.issue_date: r for r in nav.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == len(days)
    for k, day in enumerate(days):
        r = rows[day]
        assert (r.position, r.previous_date, r.next_date) == (k + 1, days[k - 1] if k else None, days[k + 1] if k + 1 < len(days) else None)
        assert r.neighbours == days[max(0, k - 20) : k + 21]
    plan = nav._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert g.date_navigation(dates.limit(0)).count() == 0


def test_one_sided_groups_have_terms_and_a_reason(spark):
    rows = [("a1", "left", 1, "p", ["部队训练", "发展", "abcdef"]), ("a2", "left", 1, "p", ["abcdef", "ab"] + [f"term{k}" for k in range(10)]), ("b1", "right", 2, "", [])]
    articles = spark.createDataFrame([("2026-05-01", *r) for r in rows], "issue_date string, id string, side string, page_number int, page_name string, explicit array<string>")
    found = {r.group_id: r for r in gr.explained_unmatched(gr.unmatched_groups(articles), articles, R).collect()}
    assert set(found) == {"left_only:1:p", "right_only:2:page"}
    page = found["left_only:1:p"]
    assert page.top_terms[:2] == ["部队训练", "abcdef"] and len(page.top_terms) == 8
    assert page.reasons[0].signal == "unmatched" and page.reasons[0].terms == page.top_terms and page.reasons[0].detail.startswith("人民日報側")
    assert found["right_only:2:page"].top_terms == []
    single = {r.group_id: r.top_terms for r in gr.explained_unmatched(gr.unmatched_groups(articles, by_page=False), articles, R, by_page=False).collect()}
    assert single["left_only:a1"] == ["部队训练", "abcdef", "发展"] and single["right_only:b1"] == []


def test_refresh_reads_a_table_of_many_files_and_of_one(spark, tmp_path):
    from corpusdiff.plans.queries import QUERIES

    rows = [(k, f"Title {k % 3}. More text {k}.", "en", f"src{k % 2}") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    (tmp_path / "many").mkdir()
    (tmp_path / "one").mkdir()
    docs.repartition(3).write.parquet(str(tmp_path / "many" / "documents.parquet"))
    docs.toPandas().to_parquet(tmp_path / "one" / "documents.parquet")
    for name, n in (("incremental_refresh", 6), ("index_after_refresh", 6)):
        many, one = (sorted(map(tuple, QUERIES[name](spark, str(tmp_path / kind)).collect())) for kind in ("many", "one"))
        assert len(many) == n and many == one
