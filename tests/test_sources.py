import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from corpusdiff.operators import quality as qa
from corpusdiff.operators import topics as tp
from corpusdiff.sources import archive as ar
from corpusdiff.sources import feed as fd
from corpusdiff.sources import html as h
from corpusdiff.sources import status as st
from corpusdiff.streaming.refresh import refresh


def one(spark, *columns):
    row = spark.range(1).select(*columns).first()
    return list(row) if len(row) > 1 else row[0]


def html_row(spark, html, url="https://x.org/a/b.html"):
    return spark.createDataFrame([(1, url, html)], "page_id int, url string, html string")


def test_article_containers(spark):
    marked = "<h2>Sub</h2><author>An</author><title>D</title><!--enpcontent--><p>one</p><!--/enpcontent--><div id='ozoom'><p>two</p></div>"
    row = h.parse_articles(html_row(spark, marked)).first()
    assert (row.title, row.subtitle, row.author, row.analysis_text) == ("D", "Sub", "An", "one")
    zoom = "<h1>H &amp; x</h1><div class=a id=\"ozoom\"><p>two</p></div>"
    row = h.parse_articles(html_row(spark, zoom)).first()
    assert (row.title, row.analysis_text) == ("H & x", "two")
    row = h.parse_articles(html_row(spark, "<b>none</b>")).first()
    assert (row.title, row.analysis_text, row.excerpt) == (h.DEFAULT_TITLE, "", "")


def test_layout_page(spark):
    page = (
        '<map><area shape="Rect" coords="1,2,x,4,5,6" href="content_9.html"><area coords="" href="no.html"></map>'
        '<ul class="x news-list"><li><a href=\'content_9.html\'>T &amp; t</a><a href="credit.html">2版责编：x</a><a href="new.html">N</a></ul>'
    )
    links = {r.link_url: r for r in h.article_links(html_row(spark, page)).collect()}
    assert set(links) == {"https://x.org/a/content_9.html", "https://x.org/a/new.html"}
    first = links["https://x.org/a/content_9.html"]
    assert first.title == "T & t" and first.region.shape == "rect" and [(p.x, p.y) for p in first.region.points] == [(1, 2), (5, 6)]
    assert links["https://x.org/a/new.html"].region is None


def test_ids_and_addresses(spark):
    d = F.lit("2026-05-01").cast("date")
    assert one(spark, h.article_id("s", F.lit("http://x/content_12.html")), h.article_id("s", F.lit("http://x/y"))) == ["s:12", "s:http://x/y"]
    assert one(spark, h.page_id("s", d, F.lit(3))) == "s:2026-05-01:p03"
    assert one(spark, h.url_from_template("https://e.org/{yyyy}{MM}/{dd}/node_{page}.html", d, F.lit(3))) == "https://e.org/202605/01/node_03.html"


def test_feed_cases(spark):
    item = {"title": " T ", "content": "<p>c</p>", "point": ["1,2", "3"]}
    good = {"paperInfo": [
        {"paperNumber": "02b", "paperBk": "", "xyList": [item, {"title": "", "content": ""}, {"id": "7", "content": "x"}]},
        {"paperNumber": "none", "xyList": [item]},
    ]}
    rows = [(dt.date(2026, 5, 1), json.dumps(good)), (dt.date(2026, 5, 2), "{broken"), (dt.date(2026, 5, 3), "{}")]
    df = fd.parse_feed(spark.createDataFrame(rows, "issue_date date, json string"))
    assert {str(r.issue_date): r.failed for r in df.collect()} == {"2026-05-01": False, "2026-05-02": True, "2026-05-03": False}
    arts = fd.feed_articles(fd.feed_pages(df, wanted=(1, 2)), "f").orderBy("pos").collect()
    assert [(a.id, a.page_number, a.page_name, a.title) for a in arts] == [("f:2026-05-01-2-0", 2, "第02b版", "T"), ("f:7", 2, "第02b版", h.DEFAULT_TITLE)]
    assert arts[0].layout_region.points[0].x == 1 and arts[1].layout_region is None
    status = {str(r.issue_date): r.status for r in fd.feed_issue_status(df, fd.feed_articles(fd.feed_pages(df), "f")).collect()}
    assert status == {"2026-05-01": "ok", "2026-05-02": "failed", "2026-05-03": "empty"}


def test_statuses(spark):
    none, some = F.array().cast("array<string>"), F.array(F.lit("x"))
    got = one(spark, *[st.extract_status(F.lit(a), e, w) for a, e, w in ((True, none, some), (True, none, none), (False, some, none), (False, none, none))])
    assert got == ["partial", "ok", "failed", "empty"]
    cases = ((0, 0, 0, 0, 0, 0), (4, 0, 0, 4, 4, 0), (4, 4, 0, 0, 1, 0), (4, 4, 0, 0, 0, 1), (4, 4, 9, 1, 0, 0), (4, 4, 9, 0, 0, 0))
    assert one(spark, *[st.issue_status(*map(F.lit, c)) for c in cases]) == ["empty", "failed", "failed", "empty", "partial", "ok"]
    units = spark.createDataFrame([("a", "success"), ("a", "empty"), ("b", "partial"), ("b", "failed"), ("c", "ok")], "issue_date string, status string")
    assert dict(map(tuple, ar.snapshot_status(units).collect())) == {"a": "partial", "b": "failed", "c": "success"}


def index_rows(spark, rows):
    schema = "src_priority int, issue_date string, generated_at int, graph int, tag string"
    return spark.createDataFrame(rows, schema)


def test_index_fold_depends_on_order(spark):
    merged = ar.merge_indexes(index_rows(spark, [(0, "d", 10, None, "a"), (1, "d", 5, 1, "b"), (2, "d", 7, None, "c")]))
    assert merged.first().tag == "c"
    entry = index_rows(spark, [(0, "d", 1, None, "new")]).drop("src_priority")
    both = ar.upsert_entry(merged, entry).collect()
    assert [r.tag for r in both] == ["new"]
    five = index_rows(spark, [(0, f"2026-01-0{i}", 1, None, "x") for i in range(1, 6)])
    assert [r.issue_date for r in ar.retain(five, 2).collect()] == ["2026-01-05", "2026-01-04"] and ar.retain(five, None).count() == 5


def test_archive_round_trip(spark, tmp_path):
    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    d1, d2 = dt.date(2026, 5, 1), dt.date(2026, 5, 2)
    frame = lambda rows: spark.createDataFrame(rows, "issue_date date, v string")
    ar.write_snapshot(frame([(d1, "old"), (d2, "keep")]), first)
    ar.write_snapshot(frame([(d1, "new")]), first)
    assert sorted((r.v for r in ar.read_archive(spark, first).collect())) == ["keep", "new"]
    assert [r.v for r in ar.read_snapshot(spark, first, "2026-05-01").collect()] == ["new"]
    ar.write_snapshot(frame([(d1, "fallback"), (dt.date(2026, 5, 3), "only")]), second)
    got = {str(r.issue_date): r.v for r in ar.read_with_fallback(spark, [first, second, str(tmp_path / "none")]).collect()}
    assert got == {"2026-05-01": "new", "2026-05-02": "keep", "2026-05-03": "only"}
    plan = ar.read_snapshot(spark, first, "2026-05-01")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(issue_date" in plan


def test_backfill_and_dates(spark, tmp_path):
    dates = ar.expand_dates(spark, ["2026-05-09", "2026-05-02"], start="2026-05-01", days=3)
    assert [str(r.issue_date) for r in dates.collect()] == ["2026-05-01", "2026-05-02", "2026-05-03", "2026-05-09"]
    have = dates.filter("issue_date < '2026-05-03'")
    result = ar.backfill(dates, dates.filter("issue_date = '2026-05-01'"), lambda todo: todo.join(have, "issue_date").withColumn("v", F.lit(1)), None)
    assert {str(r.issue_date)[-2:]: r.result for r in result.collect()} == {"01": "skipped", "02": "built", "03": "failed", "09": "failed"}


def test_nested_issue_round_trip(spark):
    pages = spark.createDataFrame([("s", dt.date(2026, 5, 1), 1, "front"), ("s", dt.date(2026, 5, 1), 2, "back")], "source string, issue_date date, page_number int, page_name string")
    arts = spark.createDataFrame([("s", dt.date(2026, 5, 1), 1, "a"), ("s", dt.date(2026, 5, 1), 1, "b")], "source string, issue_date date, page_number int, id string")
    nested = ar.nest_issue(pages, arts)
    assert [p.page_name for p in nested.first().pages] == ["front", "back"]
    assert sorted(r.id for r in ar.flatten_articles(nested).collect()) == ["a", "b"]


def test_json_archive(spark, tmp_path):
    (tmp_path / "index.json").write_text("{}")
    (tmp_path / "2026-05-01.json").write_text(json.dumps({"issueDate": "2026-05-04"}))
    (tmp_path / "2026-05-02.json").write_text("{}")
    got = ar.scan_archive_json(spark, str(tmp_path), "issueDate string").collect()
    assert sorted(str(r.issue_date) for r in got) == ["2026-05-02", "2026-05-04"]


def test_refresh_rebuilds_touched_dates(spark, tmp_path):
    landed, archive, progress = (str(tmp_path / x) for x in ("landed", "archive", "progress"))
    rows = lambda xs: spark.createDataFrame(xs, "d string, v int").select(F.to_date("d").alias("issue_date"), "v")
    count = lambda df: df.groupBy("issue_date").agg(F.count("*").alias("n"), F.sum("v").alias("v"))

    def run():
        stream = spark.readStream.schema("issue_date date, v int").parquet(landed)
        refresh(stream, lambda: spark.read.parquet(landed), count, archive, progress).awaitTermination()
        return {str(r.issue_date): (r.n, r.v) for r in spark.read.parquet(archive).collect()}

    rows([("2026-05-01", 1), ("2026-05-02", 2)]).write.parquet(landed)
    assert run() == {"2026-05-01": (1, 1), "2026-05-02": (1, 2)}
    rows([("2026-05-01", 5)]).write.mode("append").parquet(landed)
    assert run() == {"2026-05-01": (2, 6), "2026-05-02": (1, 2)}


def test_rules_without_a_date(spark):
    titles = spark.createDataFrame([("d1", "g1", ["ab c"], ["xy"]), ("d2", "g2", ["zz"], ["ab"])], "issue_date string, group_id string, left_titles array<string>, right_titles array<string>")
    rules = spark.createDataFrame(
        [(None, "everywhere", ["ab", "zz"], ["xy", "ab"], "forbidden_pair"), ("d1", "dated", ["ab", "q"], ["xy"], "group"), (None, "term", ["zz"], [], "forbidden_term")],
        "issue_date string, label string, left_terms array<string>, right_terms array<string>, kind string",
    )
    hits = {(r.group_id, r.label, r.failure) for r in qa.check_forbidden(titles, rules).collect()}
    assert hits == {("g1", "everywhere", "forbidden_pair"), ("g2", "everywhere", "forbidden_pair"), ("g2", "term", "forbidden_term")}
    assert qa.match_expectations(titles, rules.filter("kind = 'group'")).count() == 0
    term = F.when(F.col("id") == 7, "b").otherwise(F.concat(F.lit("no"), F.col("id").cast("string")))
    many = spark.range(3000).select(F.lit(None).cast("string").alias("issue_date"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("label"), F.array(term).alias("left_terms"), F.array(F.lit("x")).alias("right_terms"))
    assert [(r.group_id, r.label) for r in qa.match_expectations(titles, many).collect()] == [("g1", "r7")]
    empty = many.filter("label = 'r7'").withColumns({"left_terms": F.array().cast("array<string>"), "right_terms": F.array(F.lit("y"))})
    assert [r.group_id for r in qa.match_expectations(titles, empty).collect()] == ["g1"]


def test_topic_order(spark):
    rows = spark.createDataFrame([("t", "left", 0, ["b", "a", ""]), ("t", "left", 1, ["c", "b"])], "topic_id string, side string, pos int, keywords array<string>").withColumn(
        "narrative", F.expr("named_struct('problem_terms', array('p'), 'solution_terms', array('b'))")
    )
    got = tp.topic_keywords(rows, 3).orderBy("rank").collect()
    assert [r.term for r in got] == ["b", "a", "p"]


def test_forced_backfill_reports_what_this_run_made(spark, tmp_path):
    path, day = str(tmp_path / "archive"), "issue_date date, v int"
    ar.write_snapshot(spark.createDataFrame([(dt.date(2026, 5, 1), 1), (dt.date(2026, 5, 2), 1)], day), path)
    fresh = spark.createDataFrame([(dt.date(2026, 5, 2), 5), (dt.date(2026, 5, 2), 6)], day)
    dates = ar.expand_dates(spark, start="2026-05-01", days=2)
    done = ar.backfill(dates, spark.read.parquet(path), lambda todo: fresh.join(todo, "issue_date", "left_semi"), path, skip_existing=False)
    assert {str(r.issue_date)[-2:]: (r.result, r.rows) for r in done.collect()} == {"01": ("failed", 0), "02": ("built", 2)}
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 5, 6]


def test_missing_stores_give_an_empty_index(spark, tmp_path):
    for paths in ([], [str(tmp_path / "no"), str(tmp_path / "nor this")]):
        index = ar.read_index(spark, paths)
        assert index.count() == 0 and {"issue_date", "graph", "generated_at", "status"} <= set(index.columns)
    assert ar.read_with_fallback(spark, [str(tmp_path / "no")], "issue_date date, v int").count() == 0
    with pytest.raises(ValueError):
        ar.read_with_fallback(spark, [])


def test_expectations_count_on_their_own_date(spark):
    first, second = dt.date(2026, 5, 1), dt.date(2026, 5, 2)
    titles = spark.createDataFrame([(first, "g", ["a x"], ["b x"])], "issue_date date, group_id string, left_titles array<string>, right_titles array<string>")
    groups = spark.createDataFrame([(first, "g", "matched", ["1"], ["2"])], "issue_date date, group_id string, match_type string, left_articles array<string>, right_articles array<string>")
    schema = "issue_date date, label string, left_terms array<string>, right_terms array<string>, kind string, value int"
    wanted = spark.createDataFrame([(d, "same", ["a"], ["b"], "group", None) for d in (first, second)] + [
        (None, "anywhere", ["a"], ["b"], "group", None), (None, "nowhere", ["z"], ["b"], "group", None),
        (first, "count", [], [], "group_count", 2), (first, "size", [], [], "max_total", 1),
    ], schema)
    dates = spark.createDataFrame([(first,)], "issue_date date")
    found = {(str(r.issue_date), r.failure, r.label) for r in qa.check_expected(groups, titles, dates, wanted).collect()}
    assert found == {
        ("2026-05-02", "group_missing", "same"), ("None", "group_missing", "nowhere"), ("2026-05-01", "group_count", "count"),
        ("2026-05-01", "group_too_large", "size"), ("2026-05-02", "date_missing", "same"),
    }
