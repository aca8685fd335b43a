"""Registered queries on the given tables, with the equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusdiff.functions import labels as lb
from corpusdiff.functions import text as t
from corpusdiff.operators import accept as ac
from corpusdiff.operators import candidates as cd
from corpusdiff.operators import graph as g
from corpusdiff.operators import groups as gr
from corpusdiff.operators import pairs as p
from corpusdiff.operators import quality as qa
from corpusdiff.operators import scoring as sc
from corpusdiff.operators import signals as sg
from corpusdiff.operators import topics as tp
from corpusdiff.operators.articles import identify, normalize_articles
from corpusdiff.operators.grouping import greedy_one_to_one, group_pairs, independence_blocks
from corpusdiff.operators.similar import usable_pairs
from corpusdiff.plans import driver as d
from corpusdiff.plans import sql_text as s
from corpusdiff.plans.build import SNAPSHOT_OPTIONS, accepted_pairs, candidate_pool, candidate_report, match_groups
from corpusdiff.session import as_table, cut_lineage, pin, scratch_table_path, spread, tune
from corpusdiff.sources import archive as ar
from corpusdiff.sources import feed as fd
from corpusdiff.sources import html as h
from corpusdiff.sources import status as st
from corpusdiff.streaming.refresh import refresh

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
R = d.DRIVER_RULES


def query(sql: str | None = None):
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def bar(c: Column | str) -> Column:
    return F.array_join(c, "|")


def day(name: str = "issue_date") -> Column:
    return F.col(name).cast("string").alias("issue_date")


def r6(c: Column | str, to: str) -> Column:
    return F.round(c, 6).alias(to)


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_articles(d.articles(spark, sf_dir), R)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sg.article_signals(flat(spark, sf_dir), R)


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with their canonical titles, nothing else."""
    rows = d.articles(spark, sf_dir).select("id", "pos", "side", "issue_date", "page_number", "title")
    canon = pin(rows.withColumn("c_", t.canonical_title("title", R)))
    return canon.withColumns({"ctitle": F.col("c_.title"), "cyear": F.col("c_.leading_year")}).drop("c_").withColumn(
        "ignorable", sg.is_ignorable_title(F.col("ctitle"), R)
    )


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidate_pool(d.articles(spark, sf_dir), R, SNAPSHOT_OPTIONS)


def decisions(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> DataFrame:
    """Pair decisions out of ``labels``: matched when both articles are of quality, less sure when one is toxic.

    For each pair of copy classes the decision on their best labelled articles, which need not be the first ones.
    """
    labelled = identify(d.articles(spark, sf_dir)).select("issue_date", "side", "fingerprint", "id", "pos").join(d.doc_decisions(spark, sf_dir), "id")
    best = labelled.groupBy("issue_date", "side", "fingerprint").agg(F.min(F.struct((-F.col("quality")).alias("q"), F.col("toxic").alias("t"), "pos", "id")).alias("best"))
    found = pairs.select(*ac.PAIR_OF_CLASSES)
    for side in ("left", "right"):
        own = best.filter(F.col("side") == side).select("issue_date", F.col("fingerprint").alias(f"{side[0]}_fingerprint"), F.col("best").alias(side[0]))
        found = found.join(own, ["issue_date", f"{side[0]}_fingerprint"])
    return found.select(
        F.concat_ws(":", F.lit("pair"), "l.id", "r.id").alias("pair_id"),
        ((F.col("l.q") == -1) & (F.col("r.q") == -1)).alias("matched"),
        (100.0 - 40 * F.greatest("l.t", "r.t")).alias("confidence"),
        F.lit("labels").alias("reason"),
    )


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = as_table(pool(spark, sf_dir), "pool")
    return accepted_pairs(pairs, decisions(spark, sf_dir, pairs), SNAPSHOT_OPTIONS, d.articles(spark, sf_dir))


def full_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_groups(accepted(spark, sf_dir), d.articles(spark, sf_dir), R, SNAPSHOT_OPTIONS)


def equal_title_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.title_groups(titles(spark, sf_dir), SNAPSHOT_OPTIONS.bounds.per_side)


# --- text ----------------------------------------------------------------------------------------------------


@query(f"WITH {s.ART} SELECT pos AS doc_id, {s.nt('title')} AS term, {s.nc('title')} AS comparable, {s.na('title')} AS anchor FROM art")
def norm_terms(spark, sf_dir):
    title = F.col("title")
    return d.articles(spark, sf_dir).select(
        F.col("pos").alias("doc_id"), t.norm_term(title).alias("term"), t.norm_comparable(title).alias("comparable"),
        t.norm_anchor(title).alias("anchor"),
    )


@query(
    f"WITH {s.ART} SELECT pos AS doc_id, len({s.grams(s.nc('full_text'), 3)})::int AS text_grams, len({s.grams(s.nc('title'), 2)})::int AS title_grams FROM art"
)
def shingle_sets(spark, sf_dir):
    return flat(spark, sf_dir).select(
        F.col("pos").alias("doc_id"), F.size(t.shingle_codes("article_text", 3)).alias("text_grams"),
        F.size(t.shingle_codes("title", 2)).alias("title_grams"),
    )


@query(
    f"WITH {s.ART} SELECT pos AS doc_id, {s.excerpt('text', 180)} AS excerpt, CASE WHEN length({s.collapse('text')}) <= 650 THEN {s.collapse('text')} "
    f"ELSE {s.trim(f'substr({s.collapse(chr(116)+chr(101)+chr(120)+chr(116))}, 1, 649)')} || '…' END AS prompt_text FROM art"
)
def excerpts(spark, sf_dir):
    return d.articles(spark, sf_dir).select(
        F.col("pos").alias("doc_id"), t.excerpt("analysis_text", 180).alias("excerpt"),
        t.truncate("analysis_text", 650).alias("prompt_text"),
    )


@query("SELECT doc_id, text || ' < é😀A&#x110000;&#9999999999;&#xD800; ' || length(text) || ' &' AS decoded FROM documents")
def numeric_entities(spark, sf_dir):
    """Whole texts with an entity of each kind behind them: long ones are decoded, numbers that are no character stay."""
    coded = F.concat("text", F.lit(" &lt; &#x0000000E9;&#128512;&#00000000065;&#x110000;&#9999999999;&#xD800; "), F.length("text").cast("string"), F.lit(" &amp;"))
    return d.table(spark, sf_dir, "documents").select("doc_id", t.decode_entities(coded).alias("decoded"))


@query(
    f"WITH {s.ART}, {s.CANON} SELECT pos AS doc_id, ctitle, ctitle IN ({', '.join(s.q(x) for x in R.ignorable_titles)}) AS ignorable FROM canon"
)
def canonical_titles(spark, sf_dir):
    return titles(spark, sf_dir).select(F.col("pos").alias("doc_id"), "ctitle", "ignorable")


@query(
    f"WITH {s.SIG} SELECT term, round({s.term_weight('term')}, 6) AS weight, round({s.anchor_score('term')}, 6) AS score, "
    f"{s.high_value('term')} AS high_value, {s.strong_short('term')} AS strong_short, n FROM "
    "(SELECT term, count(*) AS n FROM (SELECT unnest(list_concat(explicit, anchors)) AS term FROM sig) GROUP BY term)"
)
def term_values(spark, sf_dir):
    term = F.col("term")
    words = signals(spark, sf_dir).select(F.explode(F.concat("explicit", "anchors")).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n")).select(
        "term", r6(sg.term_weight(term, R), "weight"), r6(sg.anchor_score(term, R), "score"),
        sg.is_high_value(term, R).alias("high_value"), sg.is_strong_short(term, R).alias("strong_short"), "n",
    )


@query(
    f"""WITH {s.ART}, {s.CANON}, x AS (SELECT page_number, side, prominence, count(*) AS n FROM canon GROUP BY ALL)
    SELECT page_number, side, prominence, CASE WHEN page_number = 1 THEN 4 WHEN page_number <= 3 THEN 3 WHEN page_number <= 7 THEN 2 ELSE 1 END AS level,
      CASE WHEN page_number = 1 THEN '一面' WHEN page_number <= 3 THEN '高' WHEN page_number <= 7 THEN '中' ELSE '低' END AS level_label,
      floor(prominence * 100 + 0.5)::int || '%' AS percent, CASE WHEN prominence >= 0.85 THEN '高' WHEN prominence >= 0.7 THEN '中' ELSE '低' END AS tone,
      CASE WHEN side = 'left' THEN '人民日報' ELSE '解放軍報' END AS source_label, n FROM x"""
)
def page_levels(spark, sf_dir):
    page = F.col("page_number")
    counts = d.articles(spark, sf_dir).groupBy("page_number", "side").agg(F.count("*").alias("n"))
    score = sg.page_prominence(page)
    labelled = lb.with_label(counts, R.label_table(spark), "source", "side", "source_label")
    return labelled.select(
        "page_number", "side", score.alias("prominence"), lb.page_level(page).alias("level"), lb.page_level_label(page).alias("level_label"),
        lb.fmt_percent(score).alias("percent"), lb.confidence_tone(score).alias("tone"), "source_label", "n",
    )


@query(
    """WITH x AS (SELECT timezone('Asia/Shanghai', ts AT TIME ZONE 'UTC')::date AS dt, value FROM events)
    SELECT strftime(dt, '%Y.%m.%d') AS label, strftime(min(dt) OVER (), '%Y.%m.%d') || ' - ' || strftime(max(dt) OVER (), '%Y.%m.%d') AS range_label,
      n, round(v, 4) AS total FROM (SELECT dt, count(*) AS n, sum(value) AS v FROM x GROUP BY dt)"""
)
def local_dates(spark, sf_dir):
    local = d.table(spark, sf_dir, "events").withColumn("dt", ar.issue_date_in_tz(F.col("ts")))
    per_day = local.groupBy("dt").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    span = per_day.agg(F.min("dt").alias("lo"), F.max("dt").alias("hi")).withColumn("one_", F.lit(1))
    return per_day.withColumn("one_", F.lit(1)).join(F.broadcast(span), "one_").select(
        lb.fmt_date(F.col("dt")).alias("label"), lb.fmt_date_range(F.col("lo"), F.col("hi")).alias("range_label"), "n",
        F.round("v", 4).alias("total"),
    )


@query(
    f"""WITH {s.ART} SELECT id, side, issue_date::varchar AS issue_date, page_number, page_name, length(full_text)::int AS text_length,
      length(title)::int AS title_length, md5(full_text) AS digest FROM art"""
)
def article_rows(spark, sf_dir):
    return flat(spark, sf_dir).select(
        "id", "side", day(), "page_number", "page_name", F.length("article_text").alias("text_length"),
        F.length("headline_text").alias("title_length"), F.md5("anchor_text").alias("digest"),
    )


@query(
    f"""WITH {s.ART} SELECT issue_date::varchar AS issue_date, side, count(*) AS articles, sum(length(text))::bigint AS chars FROM art
      WHERE issue_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-29' GROUP BY ALL"""
)
def date_window(spark, sf_dir):
    rows = ar.in_window(d.articles(spark, sf_dir), start="2024-01-10", days=20)
    return rows.groupBy("issue_date", "side").agg(
        F.count("*").alias("articles"), F.sum(F.length("analysis_text")).cast("long").alias("chars")
    ).select(day(), "side", "articles", "chars")


# --- extraction ----------------------------------------------------------------------------------------------


@query(f"SELECT page_id, {s.strip_html('html')} AS text FROM pages")
def html_text(spark, sf_dir):
    return spread(d.table(spark, sf_dir, "pages")).select("page_id", t.strip_html("html").alias("text"))


_ARTICLE = "regexp_extract(html, '(?i)<article\\b[^>]*>([\\s\\S]*?)</article>', 1)"
_H1 = "regexp_extract(html, '(?i)<h1\\b[^>]*>([\\s\\S]*?)</h1>', 1)"
_TITLE = "regexp_extract(html, '(?i)<title\\b[^>]*>([\\s\\S]*?)</title>', 1)"
_PARSED = f"""parsed AS (
  SELECT page_id, url, coalesce(nullif({s.strip_html(_H1)}, ''), nullif({s.strip_html(_TITLE)}, ''), 'Untitled article') AS title,
    {s.paragraphs(_ARTICLE)} AS analysis_text FROM pages)"""


def _page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    body = F.coalesce(F.nullif(F.regexp_extract(html, "(?i)<article\\b[^>]*>([\\s\\S]*?)</article>", 1), F.lit("")), F.lit(""))
    return h.parse_articles(spread(d.table(spark, sf_dir, "pages")), body=body)


@query(f"WITH {_PARSED} SELECT page_id, title, analysis_text, {s.excerpt('analysis_text', 180)} AS excerpt FROM parsed")
def html_articles(spark, sf_dir):
    return _page_articles(spark, sf_dir).select("page_id", "title", "analysis_text", "excerpt")


_NAV = "regexp_extract(html, '(?i)<nav\\b[^>]*>([\\s\\S]*?)</nav>', 1)"
_LINKS = f"""links AS (
  SELECT page_id, unnest(range(0, len(a))) AS pos, unnest(a) AS attrs, unnest(b) AS body, url FROM (
    SELECT page_id, url, regexp_extract_all({_NAV}, '(?i)<a\\b([^>]+)>([\\s\\S]*?)</a>', 1) AS a,
      regexp_extract_all({_NAV}, '(?i)<a\\b([^>]+)>([\\s\\S]*?)</a>', 2) AS b FROM pages)),
resolved AS (SELECT page_id, pos, {s.strip_html('body')} AS title,
    regexp_extract(url, '^(https?://[^/]+)', 1) || regexp_extract(attrs, '(?i)\\bhref\\s*=\\s*"(.*?)"', 1) AS link_url FROM links)"""


@query(f"WITH {_LINKS} SELECT page_id, link_url, arg_max(title, pos) AS title, min(pos)::int AS title_pos FROM resolved GROUP BY page_id, link_url")
def html_links(spark, sf_dir):
    """The navigation links of each page, merged by address as on a layout page."""
    pages = spread(d.table(spark, sf_dir, "pages"))
    nav = F.coalesce(F.regexp_extract("html", "(?i)<nav\\b[^>]*>([\\s\\S]*?)</nav>", 1), F.lit(""))
    return h.article_links(pages, nav).select("page_id", "link_url", "title", "title_pos")


def layout_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landed layout page per document, built from its columns: heading, area map, link list, image, credit link."""
    rows = d.articles(spark, sf_dir)
    page = F.col("page_number").cast("string")
    return rows.select(
        F.col("pos").alias("page_id"),
        F.concat(F.lit("https://paper.example.org/layout/"), "issue_date", F.lit("/node_0"), page, F.lit(".html")).alias("url"),
        "page_number",
        F.concat(
            F.lit("<html><h3>第 0"), page, F.lit(" 版：&amp; "), "page_name", F.lit("</h3><img src=\"../img/"), "id",
            F.lit(".jpg\" usemap=\"#PagePicMap\"><a href='x.html'>x</a><a href=\"../pdf/"), "id", F.lit(".pdf\">pdf</a><area shape=\"Polygon\" coords=\"1,2,x,"),
            page, F.lit(",5.5, 7\" href=\"content_"), "id", F.lit(".html\"><area shape=\"star\" coords=\"1,2\" href=\"content_"), "id",
            F.lit("9.html\"><ul class=\"a news-list b\"><li><a href=\"content_"), "id", F.lit(".html\"><b>"), F.length("title").cast("string"),
            F.lit(" &copy; "), "page_name", F.lit("</b></a><a href=\"credit.html\">"), page, F.lit("版责编：x</a></ul></html>"),
        ).alias("html"),
    )


_LAYOUT = f"""{s.ART}, lay AS (SELECT *, 'https://paper.example.org/layout/' || issue_date || '/content_' || id AS stem FROM art)"""


@query(
    f"""WITH {_LAYOUT}
    SELECT pos AS page_id, 0 AS area_pos, stem || '.html' AS href, 'polygon' AS shape, '1.0:2.0|5.5:7.0' AS points, 'px' AS unit FROM lay
    UNION ALL SELECT pos, 1, stem || '9.html', 'unknown', '1.0:2.0', 'px' FROM lay"""
)
def layout_regions(spark, sf_dir):
    point = lambda x: F.concat(x["x"].cast("string"), F.lit(":"), x["y"].cast("string"))
    return h.layout_regions(layout_pages(spark, sf_dir)).select(
        "page_id", F.col("pos").alias("area_pos"), "href", "shape", bar(F.transform("points", point)).alias("points"), "unit"
    )


@query(
    f"""WITH {_LAYOUT}
    SELECT pos AS page_id, stem || '.html' AS link_url, 'x:' || id AS article_id, length(title)::varchar || ' &copy; ' || page_name AS title, 'polygon' AS shape FROM lay
    UNION ALL SELECT pos, stem || '9.html', 'x:' || id || '9', NULL, 'unknown' FROM lay"""
)
def layout_links(spark, sf_dir):
    return h.article_links(layout_pages(spark, sf_dir)).select(
        "page_id", "link_url", h.article_id("x", F.col("link_url")).alias("article_id"), "title", F.col("region.shape").alias("shape")
    )


@query(
    f"""WITH {_LAYOUT} SELECT pos AS page_id, '& ' || page_name AS page_name, 'https://paper.example.org/layout/img/' || id || '.jpg' AS image,
      'https://paper.example.org/layout/pdf/' || id || '.pdf' AS pdf FROM lay"""
)
def layout_heads(spark, sf_dir):
    html, url = F.col("html"), F.col("url")
    return layout_pages(spark, sf_dir).select(
        "page_id", h.page_name(html, F.col("page_number")).alias("page_name"), h.page_image(html, url).alias("image"),
        h.first_href(html, url).alias("pdf"),
    )


def feed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed JSON per document. Every seventh is cut to show a broken text, every fifth has no title."""
    rows = d.articles(spark, sf_dir)
    title = F.when(F.col("pos") % 5 != 0, F.col("title"))
    item = F.struct(
        F.when(F.col("pos") % 3 == 0, F.col("id")).alias("id"), title.alias("title"),
        F.concat(F.lit("<p>"), "analysis_text", F.lit("</p>")).alias("content"),
        F.array(F.lit("1,2"), F.lit("x,4"), F.lit("5,6")).alias("point"),
    )
    nothing = F.struct(F.lit(None).cast("string").alias("id"), F.lit(" ").alias("title"), F.lit("").alias("content"), F.array().cast("array<string>").alias("point"))
    page = F.struct(F.lit(" front ").alias("paperBk"), F.concat(F.lit("0"), F.col("page_number").cast("string"), F.lit("a")).alias("paperNumber"), F.array(nothing, item).alias("xyList"))
    bad = F.struct(F.lit("").alias("paperBk"), F.lit("A").alias("paperNumber"), F.array(item).alias("xyList"))
    text = F.to_json(F.struct(F.array(page, bad).alias("paperInfo")))
    return rows.select("pos", "issue_date", F.when(F.col("pos") % 7 == 0, F.concat(F.lit("{"), text)).otherwise(text).alias("json"))


_FEED_ID = "CASE WHEN pos % 3 = 0 THEN 'feed:' || id ELSE 'feed:' || issue_date || '-' || page_number || '-1' END"


@query(
    f"""WITH {s.ART} SELECT {_FEED_ID} AS id, page_number, 'front' AS page_name, CASE WHEN pos % 5 = 0 OR {s.trim('title')} = '' THEN 'Untitled article' ELSE {s.trim('title')} END AS title,
      md5({s.strip_html('text')}) AS digest, '1.0:2.0|5.0:6.0' AS points FROM art WHERE pos % 7 <> 0"""
)
def feed_articles(spark, sf_dir):
    parsed = fd.parse_feed(feed_documents(spark, sf_dir))
    point = lambda x: F.concat(x["x"].cast("string"), F.lit(":"), x["y"].cast("string"))
    return fd.feed_articles(fd.feed_pages(parsed), "feed").select(
        "id", "page_number", "page_name", "title", F.md5("analysis_text").alias("digest"),
        bar(F.transform("layout_region.points", point)).alias("points"),
    )


@query(f"WITH {s.ART} SELECT CASE WHEN pos % 7 = 0 THEN 'failed' ELSE 'parsed' END AS status, issue_date::varchar AS issue_date, count(*) AS n FROM art GROUP BY ALL")
def feed_status(spark, sf_dir):
    parsed = fd.parse_feed(feed_documents(spark, sf_dir))
    status = F.when(F.col("failed"), F.lit("failed")).otherwise(F.lit("parsed")).alias("status")
    return parsed.groupBy(status, "issue_date").agg(F.count("*").alias("n")).select("status", day(), "n")


_HOSTED = f"""{_PARSED}, hosted AS (
  SELECT regexp_extract(url, 'example\\.([a-z]+)', 1) AS source, {s.hashed_date('url')} AS issue_date, (page_id % 4 + 1)::int AS page_number, page_id, title, analysis_text FROM parsed),
counts AS (
  SELECT source, issue_date, page_number, count(*) AS articles, count(*) FILTER (analysis_text = '') AS empty_articles FROM hosted GROUP BY ALL),
status AS (SELECT *, CASE WHEN empty_articles > 0 THEN 'partial' ELSE 'ok' END AS status FROM counts)"""


def _hosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _page_articles(spark, sf_dir).select(
        F.regexp_extract("url", "example\\.([a-z]+)", 1).alias("source"), d.hashed_date(F.col("url")).alias("issue_date"),
        (F.col("page_id") % 4 + 1).cast("int").alias("page_number"), "page_id", "title", "analysis_text",
    )
    return st.with_extraction_info(rows, "bulk-html")


def _page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hosted(spark, sf_dir)
    return st.page_status(st.page_counts(rows, rows))


@query(f"WITH {_HOSTED} SELECT source, issue_date::varchar AS issue_date, page_number, articles, empty_articles, status FROM status")
def page_status(spark, sf_dir):
    return _page_status(spark, sf_dir).select("source", day(), "page_number", "articles", "empty_articles", "status")


@query(
    f"""WITH {_HOSTED} SELECT source, issue_date::varchar AS issue_date, count(*) AS pages, sum(articles)::bigint AS articles, sum(empty_articles)::bigint AS empty_articles,
      CASE WHEN sum(empty_articles) > 0 THEN 'partial' ELSE 'ok' END AS status FROM status GROUP BY source, issue_date"""
)
def issue_status(spark, sf_dir):
    return st.issue_counts(_page_status(spark, sf_dir)).select(
        "source", day(), F.col("pages").cast("long").alias("pages"), "articles", "empty_articles", "status"
    )


@query(
    f"""WITH {_HOSTED}, want AS (SELECT DISTINCT source, issue_date, unnest([1, 2, 3, 4]) AS page_number FROM hosted)
    SELECT w.source, w.issue_date::varchar AS issue_date, w.page_number::int AS page_number, coalesce(s.articles, 0)::bigint AS articles, coalesce(s.status, 'empty') AS status,
      '第0' || w.page_number || '版' AS page_name, s.status IS NULL AS placeholder
    FROM want w LEFT JOIN status s ON w.source = s.source AND w.issue_date = s.issue_date AND w.page_number = s.page_number"""
)
def wanted_pages(spark, sf_dir):
    pages = _page_status(spark, sf_dir).withColumn("page_name", F.lit(None).cast("string"))
    wanted = pages.select("source", "issue_date", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("page_number"))
    return st.materialize_pages(pages, wanted).na.fill(0, ["articles"]).select(
        "source", day(), "page_number", "articles", "status", "page_name", "placeholder"
    )


@query(
    f"""WITH {_HOSTED}, s AS (SELECT DISTINCT source FROM hosted), x AS (SELECT DISTINCT issue_date FROM hosted),
    per AS (SELECT source, issue_date FROM status GROUP BY ALL)
    SELECT s.source, x.issue_date::varchar AS issue_date, 'missing' AS problem FROM s CROSS JOIN x LEFT JOIN per p ON p.source = s.source AND p.issue_date = x.issue_date WHERE p.source IS NULL"""
)
def issue_problems(spark, sf_dir):
    issues = st.issue_counts(_page_status(spark, sf_dir))
    dates = issues.select("issue_date").distinct()
    expected = dates.select("issue_date", F.explode(F.array(*[F.lit(x) for x in ("com", "net", "org")])).alias("source"))
    return qa.issue_problems(issues, expected).select("source", day(), "problem")


@query(
    f"""WITH {_HOSTED} SELECT page_id, CASE WHEN analysis_text = '' THEN 'empty' ELSE 'success' END AS status, 'bulk-html' AS method,
      CASE WHEN analysis_text = '' THEN '一部記事は本文抽出不可。タイトル・版面・参照ボタンのみ表示しています。' END AS message FROM hosted"""
)
def display_extraction(spark, sf_dir):
    return st.display_extraction(_hosted(spark, sf_dir)).select("page_id", "display.*")


# --- signals and pairs ---------------------------------------------------------------------------------------


@query(
    f"""WITH {s.SIG} SELECT id, array_to_string(explicit, '|') AS explicit, array_to_string(military, '|') AS military, array_to_string(policy, '|') AS policy,
      array_to_string(slogan, '|') AS slogan, array_to_string(anchors, '|') AS anchors, array_to_string(families, '|') AS families,
      round({s.strength('policy', '6.0')}, 6) AS policy_strength, round({s.strength('military', '6.0')}, 6) AS military_strength, title_cmp FROM sig"""
)
def article_signals(spark, sf_dir):
    return signals(spark, sf_dir).select(
        "id", *[bar(c).alias(c) for c in ("explicit", "military", "policy", "slogan", "anchors", "families")],
        r6("policy_strength", "policy_strength"), r6("military_strength", "military_strength"), "title_cmp",
    )


@query(
    f"""WITH {s.KEYED}, k AS (SELECT issue_date, side, unnest(keys) AS key FROM keyed)
    SELECT issue_date::varchar AS issue_date, key, count(*) FILTER (side = 'left') AS n_left, count(*) FILTER (side = 'right') AS n_right FROM k GROUP BY issue_date, key"""
)
def block_key_sizes(spark, sf_dir):
    keyed = p.block_keys(signals(spark, sf_dir).filter(~F.col("ignorable")), R)
    return p.key_sizes(keyed).select(day(), "key", "n_left", "n_right")


@query(
    f"""WITH {s.SIG} SELECT issue_date::varchar AS issue_date, ctitle, count(*) FILTER (side = 'left') AS left_articles, count(*) FILTER (side = 'right') AS right_articles,
      (count(*) FILTER (side = 'left') * count(*) FILTER (side = 'right'))::bigint AS pairs FROM sig WHERE ctitle <> '' AND NOT ignorable
      GROUP BY issue_date, ctitle HAVING count(*) FILTER (side = 'left') > 0 AND count(*) FILTER (side = 'right') > 0"""
)
def exact_title_classes(spark, sf_dir):
    return p.exact_title_classes(titles(spark, sf_dir)).select(day(), "ctitle", "left_articles", "right_articles", "pairs")


@query(
    """WITH x AS (SELECT user_id, event_type, ts::date AS dt, count(*) AS n FROM events GROUP BY ALL)
    SELECT CASE WHEN l.dt = r.dt THEN 1.0::double WHEN abs(l.dt - r.dt) <= 1 THEN 0.9::double WHEN abs(l.dt - r.dt) <= 3 THEN 0.75::double WHEN abs(l.dt - r.dt) <= 7 THEN 0.52::double
        WHEN abs(l.dt - r.dt) <= 14 THEN 0.26::double ELSE 0.08::double END AS proximity, sum(l.n * r.n)::bigint AS pairs, count(DISTINCT l.user_id) AS users
    FROM x l JOIN x r ON l.user_id = r.user_id AND l.event_type < r.event_type AND abs(l.dt - r.dt) <= 10 GROUP BY 1"""
)
def date_window_pairs(spark, sf_dir):
    """Pairs of events of two types of a key at most ten days apart by proximity band; rows are counted per key and day before the join."""
    days = d.table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("dt"), "event_type").agg(F.count("*").alias("n"))
    left = days.select("user_id", F.col("event_type").alias("l_type"), F.col("dt").alias("l_issue_date"), F.col("n").alias("ln"))
    right = days.select("user_id", F.col("event_type").alias("r_type"), F.col("dt").alias("r_issue_date"), F.col("n").alias("rn"))
    near = p.pairs_within(left, right, 10, "user_id").filter("l_type < r_type")
    return near.groupBy(sc.date_proximity(F.col("l_issue_date"), F.col("r_issue_date")).alias("proximity")).agg(
        F.sum(F.col("ln") * F.col("rn")).alias("pairs"), F.count_distinct("user_id").alias("users")
    )


_PAIR_SQL = """title_kind, cluster_key, topic_family, match_type, round(anchor_score, 6) AS anchor_score, round(lexical, 6) AS lexical,
      round(narrative, 6) AS narrative, round(metadata, 6) AS metadata, round(confidence, 6) AS confidence, round(priority, 6) AS priority,
      array_to_string(useful_terms[1:8], '|') AS useful_terms, array_to_string(shared_terms[1:12], '|') AS shared_terms"""


def pair_columns() -> list[Column]:
    return [
        *map(F.col, ("title_kind", "cluster_key", "topic_family", "match_type")),
        *[r6(c, c) for c in ("anchor_score", "lexical", "narrative", "metadata", "confidence", "priority")],
        bar(F.slice("useful_terms", 1, 8)).alias("useful_terms"), bar(F.slice("shared_terms", 1, 12)).alias("shared_terms"),
    ]


@query(f"WITH {s.CANDIDATES} SELECT issue_date::varchar AS issue_date, pair_id, l_copies, r_copies, tier, {_PAIR_SQL} FROM pool")
def candidate_pool_report(spark, sf_dir):
    """All candidate pairs of copy classes; ``l_copies`` times ``r_copies`` article pairs stand behind a row."""
    return pool(spark, sf_dir).select(day(), "pair_id", "l_copies", "r_copies", "tier", *pair_columns())


@query(f"WITH {s.TOP} SELECT issue_date::varchar AS issue_date, pair_id, pool_rank, step AS tier, {_PAIR_SQL} FROM pool")
def candidate_report_top(spark, sf_dir):
    """The daily report: the best 96 article pairs of each date in order of admission. The limit is the feature."""
    report = candidate_report(d.articles(spark, sf_dir), R, SNAPSHOT_OPTIONS, 96)
    return report.select(day(), "pair_id", F.col("pool_rank").cast("long").alias("pool_rank"), "tier", *pair_columns())


@query(
    f"""WITH {s.CANDIDATES} SELECT issue_date::varchar AS issue_date, pair_id, round(title_sim, 6) AS title_sim, round(text_overlap, 6) AS text_overlap, round(named, 6) AS named,
      round(policy_score, 6) AS policy_score, round(slogan_score, 6) AS slogan_score, round(bridge, 6) AS bridge,
      array_to_string({s.sort_terms("list_filter(le, lambda e: NOT list_contains(re, e))")}[1:8], '|') AS l_only,
      array_to_string({s.sort_terms("list_filter(re, lambda e: NOT list_contains(le, e))")}[1:8], '|') AS r_only,
      (title_sim > 0)::int + (text_overlap > 0)::int + (named * 0.6 + policy_score * 0.4 > 0)::int + (bridge > 0)::int + (slogan_score > 0)::int + (metadata > 0)::int AS n_reasons FROM pool"""
)
def pair_scores(spark, sf_dir):
    return pool(spark, sf_dir).select(
        day(), "pair_id", *[r6(c, c) for c in ("title_sim", "text_overlap", "named", "policy_score", "slogan_score", "bridge")],
        bar("l_only").alias("l_only"), bar("r_only").alias("r_only"), F.size(sc.match_reasons()).alias("n_reasons"),
    )


@query()
def pair_reasons(spark, sf_dir):
    """The three strongest reasons of each pooled pair as text, split by basis."""
    rows = pool(spark, sf_dir).select("issue_date", "pair_id", sc.match_reasons().alias("reasons"))
    out = sc.summarize_reasons(rows, R, scores=True)
    return out.select(day(), "pair_id", "summary", *[F.size(f"{b}_reasons").alias(b) for b in ("lexical", "narrative", "metadata")])


@query(
    f"""WITH {s.ACCEPTED} SELECT issue_date::varchar AS issue_date, pair_id, l_copies * r_copies AS pairs, title_kind, matched::varchar AS decision_matched, dconf AS decision_confidence,
      round(accepted_confidence, 6) AS accepted_confidence FROM accepted"""
)
def accepted_report(spark, sf_dir):
    return accepted(spark, sf_dir).select(
        day(), "pair_id", (F.col("l_copies") * F.col("r_copies")).alias("pairs"), "title_kind", F.col("decision_matched").cast("string").alias("decision_matched"), "decision_confidence", r6("accepted_confidence", "accepted_confidence")
    )


@query(
    f"""WITH {s.ACCEPTED}, jp AS (SELECT p.*, l.text AS l_text, r.text AS r_text, l.title AS lti, r.title AS rti FROM pool p JOIN art l ON l.id = p.l_id JOIN art r ON r.id = p.r_id)
    SELECT issue_date::varchar AS issue_date, pair_id, array_to_string(useful_terms[1:8], '|') AS shared_terms, topic_family AS topic_signal,
      floor(confidence * 100 + 0.5)::int AS heuristic_confidence, lti AS left_title, rti AS right_title,
      CASE WHEN length({s.collapse('l_text')}) <= 650 THEN {s.collapse('l_text')} ELSE {s.trim(f"substr({s.collapse('l_text')}, 1, 649)")} || '…' END AS left_excerpt FROM jp"""
)
def judge_requests(spark, sf_dir):
    rows = flat(spark, sf_dir).join(
        d.articles(spark, sf_dir).select("id", t.truncate("analysis_text", 650).alias("prompt_text")), "id"
    )
    found = candidate_pool(d.articles(spark, sf_dir), R, SNAPSHOT_OPTIONS, ac.judge_sides(rows))
    return ac.judge_input(found, None, R).select(
        day(), "pair_id", bar("shared_terms").alias("shared_terms"), "topic_signal", "heuristic_confidence",
        F.col("left_article.title").alias("left_title"), F.col("right_article.title").alias("right_title"),
        F.col("left_article.excerpt").alias("left_excerpt"),
    )


def usable_of_day(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All usable pairs of copy classes, and the articles of each class."""
    identified = identify(d.articles(spark, sf_dir))
    unique = sg.article_signals(normalize_articles(p.class_representatives(identified), R), R, keep=("fingerprint",))
    pairs = usable_pairs(unique, R, keep=("l_fingerprint", "r_fingerprint"))
    return pairs, p.class_members(identified)


@query(
    f"""WITH RECURSIVE {s.ALL_PAIRS},
    usable AS (SELECT issue_date, l_id, r_id, confidence, row_number() OVER (PARTITION BY issue_date ORDER BY confidence DESC, l_pos, l_id, r_pos, r_id) AS n
      FROM scored WHERE confidence >= 0.48 OR (match_type = 'uncertain' AND confidence >= 0.34)),
    walk(issue_date, n, used, taken, l_id, r_id, confidence) AS (
      SELECT issue_date, 0::bigint, []::varchar[], false, ''::varchar, ''::varchar, 0.0::double FROM (SELECT DISTINCT issue_date FROM usable)
      UNION ALL
      SELECT w.issue_date, u.n, CASE WHEN list_contains(w.used, 'l' || u.l_id) OR list_contains(w.used, 'r' || u.r_id) THEN w.used ELSE list_concat(w.used, ['l' || u.l_id, 'r' || u.r_id]) END,
        NOT (list_contains(w.used, 'l' || u.l_id) OR list_contains(w.used, 'r' || u.r_id)), u.l_id, u.r_id, u.confidence
      FROM walk w JOIN usable u ON u.issue_date = w.issue_date AND u.n = w.n + 1)
    SELECT issue_date::varchar AS issue_date, l_id AS l_article, r_id AS r_article, round(confidence, 6) AS confidence FROM walk WHERE taken"""
)
def greedy_pairs(spark, sf_dir):
    """Best pair first over all articles of a date and all usable pairs of them, also those without a common key."""
    pairs, members = usable_of_day(spark, sf_dir)
    classed = pairs.select("issue_date", F.col("l_fingerprint").alias("l_class"), F.col("r_fingerprint").alias("r_class"), "confidence")
    ranked = members.select("issue_date", "side", F.col("fingerprint").alias("class"), "id", "pos", F.col("member_rank").cast("long").alias("rank"))
    return greedy_one_to_one(classed, cut_lineage(ranked)).select(day(), "l_article", "r_article", r6("confidence", "confidence"))


@query(
    f"""WITH {s.ALL_PAIRS} SELECT issue_date::varchar AS issue_date, l_id AS l_article, r_id AS r_article, match_type, round(lexical, 6) AS lexical, round(narrative, 6) AS narrative,
      round(confidence, 6) AS confidence, l_copies, r_copies
    FROM scored WHERE l_rank = 1 AND r_rank = 1 AND (confidence >= 0.48 OR (match_type = 'uncertain' AND confidence >= 0.34))"""
)
def usable_pairs_report(spark, sf_dir):
    """Every usable pair of copy classes of a date, found by common terms and by similar titles and texts; the first article stands for its class."""
    pairs, members = usable_of_day(spark, sf_dir)
    sizes = cut_lineage(members.groupBy("issue_date", "side", "fingerprint").agg(F.count("*").alias("copies")))
    for side in ("left", "right"):
        own = sizes.filter(F.col("side") == side)
        pairs = pairs.join(own.select("issue_date", F.col("fingerprint").alias(f"{side[0]}_fingerprint"), F.col("copies").alias(f"{side[0]}_copies")), ["issue_date", f"{side[0]}_fingerprint"])
    return pairs.select(
        day(), F.col("l_id").alias("l_article"), F.col("r_id").alias("r_article"), "match_type", r6("lexical", "lexical"), r6("narrative", "narrative"),
        r6("confidence", "confidence"), "l_copies", "r_copies",
    )


# --- groups --------------------------------------------------------------------------------------------------


@query()
def match_groups_report(spark, sf_dir):
    """The final groups of every date after splitting, merging and overlap resolution."""
    return full_groups(spark, sf_dir).select(
        day(), "group_id", "match_type", r6("confidence", "confidence"), r6("lexical", "lexical"), r6("narrative", "narrative"),
        bar("shared_terms").alias("shared_terms"), bar("left_articles").alias("left_articles"), bar("right_articles").alias("right_articles"),
    )


@query()
def block_groups(spark, sf_dir):
    """The same grouping, one call per independence block instead of per date."""
    prepared = as_table(ac.merge_fields(accepted(spark, sf_dir), R), "accepted")
    return group_pairs(independence_blocks(prepared), R, by=("issue_date", "block")).select(day(), "pair_id", "group_key", "pair_order")


@query()
def display_report(spark, sf_dir):
    matched = cut_lineage(full_groups(spark, sf_dir))
    rows = d.articles(spark, sf_dir)
    rest = gr.unmatched(rows, gr.group_members(matched))
    shown = gr.display_groups(gr.order_display(gr.union_groups(matched, gr.unmatched_groups(rest))), R)
    return shown.select(
        day(), "group_id", "match_type", "reason", "method", "message", "size_label", bar("uncertainty_notes").alias("notes"), "page_number"
    )


@query(
    f"""WITH {s.TITLE_GROUPS} SELECT group_id, issue_date::varchar AS issue_date, ctitle AS shared_terms, array_to_string(l, '|') AS left_articles, array_to_string(r, '|') AS right_articles FROM groups"""
)
def title_groups(spark, sf_dir):
    """All articles with equal titles in groups of at most two a side, from ranks and without forming pairs."""
    return equal_title_groups(spark, sf_dir).select(
        "group_id", day(), bar("shared_terms").alias("shared_terms"), bar("left_articles").alias("left_articles"), bar("right_articles").alias("right_articles")
    )


_REST_SQL = f"""{s.SIG}, {s.TITLE_GROUPS.removeprefix(f"{s.ART}, {s.CANON},")},
    rest AS (SELECT a.*, sig.explicit FROM art a JOIN sig ON sig.id = a.id LEFT JOIN members m ON m.article_id = a.id AND m.side = a.side AND m.issue_date = a.issue_date WHERE m.article_id IS NULL),
    pages AS (SELECT issue_date, side, side || '_only:' || page_number || ':' || page_name AS group_id, count(*) AS n_articles, min(page_number)::int AS page_number FROM rest GROUP BY issue_date, side, rest.page_number, page_name),
    pt AS (SELECT DISTINCT issue_date, side || '_only:' || page_number || ':' || page_name AS group_id, unnest(explicit) AS term FROM rest),
    best AS (SELECT issue_date, group_id, list(term ORDER BY k) AS terms FROM (
      SELECT *, row_number() OVER (PARTITION BY issue_date, group_id ORDER BY {s.term_weight('term')} DESC, length(term) DESC, term) AS k FROM pt) WHERE k <= 8 GROUP BY ALL)"""


@query(
    f"""WITH {_REST_SQL} SELECT p.group_id, p.issue_date::varchar AS issue_date, side || '_only' AS match_type, n_articles, page_number, coalesce(array_to_string(terms, '|'), '') AS top_terms, 'unmatched' AS signal,
      CASE side WHEN 'left' THEN {s.q(R.labels[('source', 'left')])} ELSE {s.q(R.labels[('source', 'right')])} END || {s.q(gr.UNMATCHED_DETAIL)} AS detail
    FROM pages p LEFT JOIN best b ON b.issue_date = p.issue_date AND b.group_id = p.group_id"""
)
def unmatched_by_page(spark, sf_dir):
    """One-sided groups by page with the best terms of their articles and the reason why they stand alone."""
    members = cut_lineage(gr.group_members(equal_title_groups(spark, sf_dir)))
    rest = gr.unmatched(flat(spark, sf_dir), members)
    own = sg.article_signals(rest, R, keep=("page_name",))
    groups = gr.explained_unmatched(gr.unmatched_groups(rest), own, R)
    return groups.select(
        "group_id", day(), "match_type", "n_articles", "page_number", bar("top_terms").alias("top_terms"),
        F.col("reasons")[0]["signal"].alias("signal"), F.col("reasons")[0]["detail"].alias("detail"),
    )


@query(
    f"""WITH {s.SIG}, x AS (SELECT DISTINCT issue_date, side, page_number, unnest(explicit) AS term FROM sig)
    SELECT issue_date::varchar AS issue_date, side, page_number, term, rank::int AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY issue_date, side, page_number ORDER BY {s.term_weight('term')} DESC, length(term) DESC, term) AS rank FROM x) WHERE rank <= 8"""
)
def page_top_terms(spark, sf_dir):
    return gr.page_terms(signals(spark, sf_dir), R).select(day(), "side", "page_number", "term", "rank")


@query(
    f"""WITH {s.TITLE_GROUPS}, rest AS (SELECT a.* FROM art a LEFT JOIN members m ON m.article_id = a.id AND m.issue_date = a.issue_date AND m.side = a.side WHERE m.article_id IS NULL),
    u AS (SELECT issue_date, match_type, count(*) AS groups, sum(n)::bigint AS articles FROM (
        SELECT issue_date, 'matched' AS match_type, len(l) + len(r) AS n FROM groups
        UNION ALL SELECT issue_date, side || '_only', 1 FROM rest) GROUP BY ALL)
    SELECT issue_date::varchar AS issue_date, match_type, groups, articles FROM u"""
)
def group_views(spark, sf_dir):
    """Matched and one-sided groups together, counted per view."""
    matched = equal_title_groups(spark, sf_dir)
    rest = gr.unmatched(d.articles(spark, sf_dir), gr.group_members(matched))
    everything = gr.union_groups(matched, gr.unmatched_groups(rest, by_page=False))
    folded = gr.filter_view(everything, "matched").withColumn("match_type", F.lit("matched")).unionByName(gr.filter_view(everything, "only"))
    return folded.groupBy("issue_date", "match_type").agg(F.count("*").alias("groups"), F.sum("n_articles").alias("articles")).select(
        day(), "match_type", "groups", "articles"
    )


# --- graph ---------------------------------------------------------------------------------------------------


def graph_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    groups = equal_title_groups(spark, sf_dir)
    members = gr.group_members(groups)
    links = g.graph_links(g.group_cross_pairs(groups))
    nodes = g.graph_nodes(d.articles(spark, sf_dir), members)
    return groups, members, links, nodes


_MEASURED = f"""{s.TITLE_GROUPS},
measured AS (
  SELECT a.issue_date, a.side, a.id, a.page_number, coalesce(x.degree, 0)::bigint AS degree FROM art a LEFT JOIN (
    SELECT issue_date, 'left' AS side, l_article AS id, count(*) AS degree FROM links GROUP BY ALL
    UNION ALL SELECT issue_date, 'right', r_article, count(*) FROM links GROUP BY ALL) x
  ON x.issue_date = a.issue_date AND x.side = a.side AND x.id = a.id)"""


@query(
    f"""WITH {s.TITLE_GROUPS} SELECT issue_date::varchar AS issue_date, 'left:' || l_article AS source, 'right:' || r_article AS target, count(*) AS weight, 0.92::double AS confidence,
      string_agg(group_id, '|' ORDER BY group_id) AS group_ids FROM links GROUP BY issue_date, l_article, r_article"""
)
def graph_links(spark, sf_dir):
    _, _, links, nodes = graph_parts(spark, sf_dir)
    return g.valid_links(links, nodes).select(day(), "source", "target", "weight", r6("confidence", "confidence"), bar("group_ids").alias("group_ids"))


@query(f"WITH {s.TITLE_GROUPS} SELECT issue_date::varchar AS issue_date, group_id, side, article_id FROM members")
def resolved_members(spark, sf_dir):
    """Groups that hold id lists only, some ids unknown, resolved against the nodes."""
    groups, _, _, nodes = graph_parts(spark, sf_dir)
    listed = groups.select(
        "issue_date", "group_id", F.concat("left_articles", F.array(F.lit("unknown"))).alias("left_ids"), F.col("right_articles").alias("right_ids")
    )
    return g.resolve_members(listed, nodes).select(day(), "group_id", "side", "article_id")


@query(
    f"""WITH {_MEASURED} SELECT issue_date::varchar AS issue_date, side || ':' || id AS node_id, side, page_number, degree, degree AS matched_degree, degree = 0 AS isolated FROM measured"""
)
def graph_nodes(spark, sf_dir):
    _, members, links, nodes = graph_parts(spark, sf_dir)
    return g.node_measures(nodes, links, members).select(day(), "node_id", "side", "page_number", "degree", "matched_degree", "isolated")


@query(
    f"""WITH {_MEASURED}, n AS (SELECT issue_date, count(*) AS nodes, count(*) FILTER (side = 'left') AS left_nodes, count(*) FILTER (side = 'right') AS right_nodes,
        count(*) FILTER (degree > 0) AS matched_nodes, count(*) FILTER (degree = 0) AS isolated_nodes FROM measured GROUP BY issue_date),
      l AS (SELECT issue_date, count(*) AS links FROM links GROUP BY issue_date), k AS (SELECT issue_date, count(*) AS matched_groups FROM groups GROUP BY issue_date)
    SELECT n.issue_date::varchar AS issue_date, nodes, coalesce(links, 0)::bigint AS links, left_nodes, right_nodes, matched_nodes, isolated_nodes, coalesce(matched_groups, 0)::bigint AS matched_groups
    FROM n LEFT JOIN l ON l.issue_date = n.issue_date LEFT JOIN k ON k.issue_date = n.issue_date"""
)
def graph_metrics(spark, sf_dir):
    groups, _, links, nodes = graph_parts(spark, sf_dir)
    return g.graph_metrics(g.node_measures(nodes, links), links, groups).select(day(), *g.METRICS)


@query(
    f"""WITH {_MEASURED}, n AS (SELECT issue_date, count(*) AS nodes, count(*) FILTER (degree > 0) AS linked_nodes FROM measured GROUP BY issue_date),
      l AS (SELECT issue_date, count(*) AS links FROM links GROUP BY issue_date)
    SELECT n.issue_date::varchar AS issue_date, nodes, linked_nodes, coalesce(links, 0)::bigint AS links, CASE WHEN links > 0 THEN 0.92::double END AS mean_confidence FROM n LEFT JOIN l ON l.issue_date = n.issue_date"""
)
def graph_summary(spark, sf_dir):
    _, _, links, nodes = graph_parts(spark, sf_dir)
    return g.graph_summary(g.node_measures(nodes, links), links).select(day(), "nodes", "linked_nodes", "links", r6("mean_confidence", "mean_confidence"))


@query(
    f"""WITH {s.TITLE_GROUPS}, x AS (SELECT issue_date, side || ':' || article_id AS node_id, min(issue_date || '|' || side || ':' || article_id) OVER (PARTITION BY issue_date, group_id) AS component,
        count(*) OVER (PARTITION BY issue_date, group_id) AS component_size FROM members)
    SELECT a.issue_date::varchar AS issue_date, a.side || ':' || a.id AS node_id, coalesce(component, a.issue_date || '|' || a.side || ':' || a.id) AS component, coalesce(component_size, 1)::bigint AS component_size,
      component IS NOT NULL AS linked FROM art a LEFT JOIN x ON x.node_id = a.side || ':' || a.id AND x.issue_date = a.issue_date"""
)
def graph_components(spark, sf_dir):
    _, _, links, nodes = graph_parts(spark, sf_dir)
    return g.graph_components(nodes, links).select(day(), "node_id", "component", "component_size", "linked")


@query(
    """WITH x AS (SELECT DISTINCT ts::date AS dt FROM events)
    SELECT dt::varchar AS issue_date, lag(dt::varchar) OVER w AS previous_date, lead(dt::varchar) OVER w AS next_date, row_number() OVER w AS position,
      array_to_string(list(dt::varchar) OVER (ORDER BY dt ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), '|') AS neighbours FROM x WINDOW w AS (ORDER BY dt)"""
)
def date_navigation(spark, sf_dir):
    dates = d.table(spark, sf_dir, "events").select(F.to_date("ts").alias("issue_date")).distinct()
    return g.date_navigation(dates).select(
        day(), F.col("previous_date").cast("string").alias("previous_date"), F.col("next_date").cast("string").alias("next_date"), F.col("position").cast("long").alias("position"),
        bar(F.transform("neighbours", lambda x: x.cast("string"))).alias("neighbours"),
    )


# --- archive -------------------------------------------------------------------------------------------------

_COUNTS = f"""{s.TITLE_GROUPS},
flagged AS (SELECT a.*, m.article_id IS NOT NULL AS hit FROM art a LEFT JOIN members m ON m.article_id = a.id AND m.side = a.side AND m.issue_date = a.issue_date),
counts AS (
  SELECT issue_date, count(*) FILTER (side = 'left') AS left_articles, count(*) FILTER (side = 'right') AS right_articles, count(*) FILTER (side = 'left' AND hit) AS matched_left,
    count(*) FILTER (side = 'right' AND hit) AS matched_right, count(*) FILTER (side = 'left' AND NOT hit) AS left_only, count(*) FILTER (side = 'right' AND NOT hit) AS right_only FROM flagged GROUP BY issue_date),
gcount AS (SELECT issue_date, count(*) AS matched_groups FROM groups GROUP BY issue_date),
allcounts AS (SELECT c.*, coalesce(matched_groups, 0)::bigint AS matched_groups FROM counts c LEFT JOIN gcount k ON k.issue_date = c.issue_date)"""

COUNT_COLUMNS = ("left_articles", "right_articles", "matched_groups", "matched_left", "matched_right", "left_only", "right_only")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = equal_title_groups(spark, sf_dir)
    return ar.snapshot_counts(d.articles(spark, sf_dir), gr.group_members(groups), groups)


@query(f"WITH {_COUNTS} SELECT issue_date::varchar AS issue_date, {', '.join(COUNT_COLUMNS)} FROM allcounts")
def snapshot_counts(spark, sf_dir):
    return _counts(spark, sf_dir).select(day(), *COUNT_COLUMNS)


@query(
    f"""WITH {_HOSTED}, units AS (SELECT issue_date, status FROM status UNION ALL SELECT issue_date, CASE WHEN sum(empty_articles) > 0 THEN 'partial' ELSE 'ok' END FROM status GROUP BY source, issue_date)
    SELECT issue_date::varchar AS issue_date, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status IN ('partial', 'empty')) THEN 'partial' ELSE 'success' END AS status FROM units GROUP BY issue_date"""
)
def snapshot_status(spark, sf_dir):
    pages = _page_status(spark, sf_dir)
    units = pages.select("issue_date", "status").unionByName(st.issue_counts(pages).select("issue_date", "status"))
    return ar.snapshot_status(units).select(day(), "status")


@query(
    f"""WITH {_COUNTS} SELECT issue_date::varchar AS issue_date, left_articles + right_articles AS nodes, matched_left + matched_right AS matched_nodes, left_only + right_only AS isolated_nodes,
      matched_groups, 'archive/' || issue_date || '.json' AS path, 'success' AS status, false AS judge_enabled FROM allcounts"""
)
def index_entries(spark, sf_dir):
    groups, members, links, nodes = graph_parts(spark, sf_dir)
    counts = ar.snapshot_counts(d.articles(spark, sf_dir), members, groups)
    metrics = g.graph_metrics(g.node_measures(nodes, links), links, groups)
    status = ar.snapshot_status(counts.select("issue_date", F.lit("ok").alias("status")))
    entries = ar.index_entries(counts, status, metrics)
    return entries.select(day(), "graph.nodes", "graph.matched_nodes", "graph.isolated_nodes", "graph.matched_groups", "path", "status", "judge_enabled")


def index_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as index entries of several stores: one entry per event type and day; some lack graph metrics."""
    per_day = d.table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("issue_date")).agg(
        F.max("ts").alias("generated_at"), F.count("*").alias("n"), F.max("event_id").alias("last_event")
    )
    sizes = [F.col("n").alias(m) for m in g.METRICS]
    graph = F.when(F.col("last_event") % 3 != 0, F.struct(*sizes))
    return per_day.select(
        F.length("event_type").alias("src_priority"), "issue_date", "event_type", "generated_at", graph.alias("graph"),
        F.col("n").alias("matched_groups"), F.col("n").alias("matched_left"), F.col("n").alias("matched_right"),
        F.lit(1).cast("long").alias("left_only"), F.lit(2).cast("long").alias("right_only"),
    )


_INDEX = """per AS (SELECT event_type, ts::date AS dt, max(ts) AS gen, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY ALL),
src AS (SELECT length(event_type) AS prio, dt, event_type, gen, n, last_event % 3 <> 0 AS g FROM per),
firsts AS (SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY dt, prio ORDER BY event_type) = 1),
folded AS (SELECT dt, list_reduce(list({'p': prio, 't': event_type, 'gen': gen, 'n': n, 'g': g} ORDER BY prio), lambda x, y: CASE WHEN (NOT x.g AND y.g) OR y.gen > x.gen THEN y ELSE x END) AS e FROM firsts GROUP BY dt)"""


def _one_per_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of equal length stand for one store; its first entry of a date counts."""
    from pyspark.sql import Window

    first = Window.partitionBy("issue_date", "src_priority").orderBy("event_type")
    return index_sources(spark, sf_dir).withColumn("n_", F.row_number().over(first)).filter("n_ = 1").drop("n_")


@query(f"WITH {_INDEX} SELECT dt::varchar AS issue_date, e.t AS event_type, e.gen AS generated_at, e.g AS has_graph, e.n AS matched_groups FROM folded")
def index_merge(spark, sf_dir):
    return ar.merge_indexes(_one_per_store(spark, sf_dir)).select(
        day(), "event_type", "generated_at", F.col("graph").isNotNull().alias("has_graph"), "matched_groups"
    )


@query(
    f"""WITH {_INDEX} SELECT dt::varchar AS issue_date, e.g AS from_graph, CASE WHEN e.g THEN e.n ELSE 2 * e.n + 3 END AS nodes, e.n AS links, CASE WHEN e.g THEN e.n ELSE e.n + 1 END AS left_nodes,
      CASE WHEN e.g THEN e.n ELSE e.n + 2 END AS right_nodes, CASE WHEN e.g THEN e.n ELSE 2 * e.n END AS matched_nodes, CASE WHEN e.g THEN e.n ELSE 3 END AS isolated_nodes, e.n AS matched_groups FROM folded"""
)
def index_trend(spark, sf_dir):
    return g.trend_metrics(ar.merge_indexes(_one_per_store(spark, sf_dir))).select(day(), "from_graph", *g.METRICS)


@query(f"WITH {_INDEX} SELECT dt::varchar AS issue_date, e.t AS event_type FROM folded ORDER BY dt DESC LIMIT 20")
def index_retention(spark, sf_dir):
    return ar.retain(ar.merge_indexes(_one_per_store(spark, sf_dir)), 20).select(day(), "event_type")


@query(
    f"""WITH {_INDEX}, b AS (SELECT dt, count(*) AS n FROM per WHERE event_type = 'error' GROUP BY dt)
    SELECT f.dt::varchar AS issue_date, CASE WHEN b.dt IS NOT NULL THEN 'rebuilt' ELSE e.t END AS event_type FROM folded f LEFT JOIN b ON b.dt = f.dt"""
)
def index_upsert(spark, sf_dir):
    index = ar.merge_indexes(_one_per_store(spark, sf_dir)).select("issue_date", "event_type")
    entry = index_sources(spark, sf_dir).filter("event_type = 'error'").select("issue_date", F.lit("rebuilt").alias("event_type"))
    return ar.upsert_entry(index, entry).select(day(), "event_type")


@query(
    """WITH src AS (SELECT event_type, ts::date AS dt, max(ts) AS gen FROM events GROUP BY ALL)
    SELECT dt::varchar AS issue_date, event_type, gen AS generated_at FROM src QUALIFY row_number() OVER (PARTITION BY dt ORDER BY gen DESC, length(event_type)) = 1"""
)
def index_newest(spark, sf_dir):
    return ar.newest_per_date(index_sources(spark, sf_dir)).select(day(), "event_type", "generated_at")


@query("SELECT min(ts::date)::varchar AS oldest, max(ts::date)::varchar AS newest, count(DISTINCT ts::date) AS dates, max(ts) AS updated_at FROM events")
def archive_coverage(spark, sf_dir):
    entries = index_sources(spark, sf_dir)
    latest = ar.latest_timestamp(entries).withColumn("one_", F.lit(1))
    return ar.archive_coverage(entries).withColumn("one_", F.lit(1)).join(latest, "one_").select(
        F.col("oldest").cast("string").alias("oldest"), F.col("newest").cast("string").alias("newest"), "dates", "updated_at"
    )


@query(
    f"""WITH {s.ART}, have AS (SELECT DISTINCT issue_date FROM art), done AS (SELECT DISTINCT issue_date FROM art WHERE page_number = 1),
    want AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-03-10', INTERVAL 1 DAY))::date AS issue_date)
    SELECT w.issue_date::varchar AS issue_date, CASE WHEN k.issue_date IS NOT NULL THEN 'skipped' WHEN h.issue_date IS NOT NULL THEN 'built' ELSE 'failed' END AS result
    FROM want w LEFT JOIN done k ON k.issue_date = w.issue_date LEFT JOIN have h ON h.issue_date = w.issue_date"""
)
def backfill_result(spark, sf_dir):
    """All dates of a range in one job: those with a stored front page are skipped, the others built and written."""
    rows = d.articles(spark, sf_dir)
    dates = ar.expand_dates(spark, ["2024-01-05", "2024-01-05"], start="2024-01-01", end="2024-03-10")
    existing = rows.filter("page_number = 1")
    path = scratch_table_path(spark, "backfill")
    done = ar.backfill(dates, existing, lambda todo: ar.display_articles(rows.join(todo, "issue_date", "left_semi")), path)
    return done.select(day(), "result")


def _refreshed(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Documents as a stream of landed rows: every touched date is rebuilt and replaced in the archive, and its entry in the index."""
    landed = spark.read.parquet(f"{sf_dir}/documents.parquet").schema

    def shape(df: DataFrame) -> DataFrame:
        title = d.first_sentence(F.col("text"))
        side = F.when(d.source_number(F.col("source")) % 2 == 0, F.lit("left")).otherwise(F.lit("right"))
        return df.select(d.hashed_date(title).alias("issue_date"), side.alias("side"), title.alias("title"))

    # One file or a folder of files; a stream takes both only from a pattern.
    stream = shape(spark.readStream.schema(landed).parquet(f"{sf_dir}/documents.parque[t]"))
    archive, index, progress = (scratch_table_path(spark, name) for name in ("refresh", "refresh-index", "refresh-progress"))
    counts = lambda rows: rows.groupBy("issue_date", "side").agg(F.count("*").alias("articles"), F.count_distinct("title").alias("titles"))
    refresh(stream, lambda: shape(d.table(spark, sf_dir, "documents")), counts, archive, progress, _index_entry, index).awaitTermination()
    return archive, index


def _index_entry(rows: DataFrame) -> DataFrame:
    of = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("articles"))), F.lit(0)).alias(f"{side}_articles")
    return rows.groupBy("issue_date").agg(of("left"), of("right"), F.sum("titles").alias("titles"))


@query(
    f"""WITH {s.ART} SELECT issue_date::varchar AS issue_date, side, count(*) AS articles, count(DISTINCT title) AS titles FROM art GROUP BY issue_date, side"""
)
def incremental_refresh(spark, sf_dir):
    archive, _ = _refreshed(spark, sf_dir)
    return spark.read.parquet(archive).select(day(), "side", "articles", "titles")


@query(
    f"""WITH {s.ART}, k AS (SELECT issue_date, side, count(*) AS articles, count(DISTINCT title) AS titles FROM art GROUP BY issue_date, side),
    e AS (SELECT issue_date, coalesce(sum(articles) FILTER (side = 'left'), 0)::bigint AS left_articles, coalesce(sum(articles) FILTER (side = 'right'), 0)::bigint AS right_articles,
      sum(titles)::bigint AS titles FROM k GROUP BY issue_date)
    SELECT issue_date::varchar AS issue_date, left_articles, right_articles, titles, made FROM e, (SELECT unnest(['refresh', 'rebuild']) AS made)"""
)
def index_after_refresh(spark, sf_dir):
    """The index as the refresh has kept it, and as it is rebuilt from the archive alone."""
    archive, index = _refreshed(spark, sf_dir)
    anew = scratch_table_path(spark, "rebuilt-index")
    ar.rebuild_index(spark.read.parquet(archive), _index_entry, anew)
    both = spark.read.parquet(index).withColumn("made", F.lit("refresh")).unionByName(spark.read.parquet(anew).withColumn("made", F.lit("rebuild")))
    return both.select(day(), "left_articles", "right_articles", "titles", "made")


@query(
    f"""WITH {s.TITLE_GROUPS} SELECT group_id, issue_date::varchar AS issue_date, 2024 AS counted, array_to_string(l, '|') AS left_articles, array_to_string(r, '|') AS right_articles FROM groups"""
)
def archive_scan(spark, sf_dir):
    """Snapshots of all dates as JSON in three nestings, some with the date in the file name only, read back without a schema."""
    groups = equal_title_groups(spark, sf_dir)
    listed = F.struct(F.col("group_id").alias("id"), F.col("left_articles").alias("left"), F.col("right_articles").alias("right"))
    by_date = groups.groupBy("issue_date").agg(F.collect_list(listed).alias("matchGroups")).withColumn("counts", F.struct(F.year("issue_date").alias("year")))
    date, kind = F.col("issue_date").cast("string"), F.dayofmonth("issue_date") % 4
    plain = F.struct(date.alias("issueDate"), "matchGroups", "counts")
    shapes = [F.to_json(plain), F.to_json(F.struct(plain.alias("result"))), F.to_json(F.struct(F.struct("matchGroups", "counts").alias("snapshot"))),
              F.to_json(F.struct(date.alias("date"), F.col("matchGroups").alias("groups"), "counts"))]
    files = by_date.select(F.concat(date, F.lit(".json")).alias("file_name"), F.element_at(F.array(*shapes), kind + 1).alias("json"))
    more = spark.createDataFrame([("index.json", "{}"), ("2024-01-01-broken.json", "{"), ("none.json", '{"matchGroups": [1]}')], "file_name string, json string")
    found = ar.normalize_snapshots(files.unionByName(more))
    each = found.select("issue_date", F.try_variant_get("counts", "$.year", "int").alias("counted"), F.explode("match_groups").alias("g"))
    names = lambda side: bar(F.variant_get("g", f"$.{side}", "array<string>")).alias(f"{side}_articles")
    return each.select(F.variant_get("g", "$.id", "string").alias("group_id"), day(), "counted", names("left"), names("right"))


@query(
    f"""WITH {s.ART}, x AS (SELECT issue_date, side, page_number, id, pos, title, row_number() OVER (PARTITION BY issue_date, side, page_number ORDER BY pos) AS n FROM art),
    slots AS (SELECT DISTINCT issue_date, s.side, unnest([1, 2, 3, 4]) AS page_number FROM art, (VALUES ('left'), ('right')) s(side))
    SELECT k.issue_date::varchar AS issue_date, k.side, k.page_number::int AS page_number, count(x.id) AS articles, coalesce(string_agg(x.title, '|' ORDER BY n) FILTER (n <= 2), '') AS first_titles,
      greatest(count(x.id) - 2, 0)::bigint AS more FROM slots k LEFT JOIN x ON x.issue_date = k.issue_date AND x.side = k.side AND x.page_number = k.page_number GROUP BY k.issue_date, k.side, k.page_number"""
)
def page_coverage(spark, sf_dir):
    rows = d.articles(spark, sf_dir)
    sides, pages = F.array(F.lit("left"), F.lit("right")), F.array(*[F.lit(i) for i in (1, 2, 3, 4)])
    slots = rows.select("issue_date").distinct().select("issue_date", F.explode(sides).alias("side")).select("*", F.explode(pages).alias("page_number"))
    return qa.page_coverage(rows, slots).select(day(), "side", "page_number", "articles", bar("first_titles").alias("first_titles"), F.col("more").cast("long").alias("more"))


@query(f"WITH {s.ART} SELECT id, side, issue_date::varchar AS issue_date, page_number, page_name, title, author FROM art")
def display_articles(spark, sf_dir):
    return ar.display_articles(d.articles(spark, sf_dir)).withColumn("issue_date", F.col("issue_date").cast("string"))


# --- quality -------------------------------------------------------------------------------------------------


def _title_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of unbounded groups, one per date and title: material for the checks to find something in."""
    rows = titles(spark, sf_dir).filter("ctitle <> ''")
    return rows.select("issue_date", F.concat(F.lit("class:"), "ctitle").alias("group_id"), "side", F.col("id").alias("article_id"))


_CLASSES = f"""{s.ART}, {s.CANON}, cls AS (
  SELECT issue_date, 'class:' || ctitle AS group_id, count(*) FILTER (side = 'left') AS n_left, count(*) FILTER (side = 'right') AS n_right, count(*) AS n_total FROM canon WHERE ctitle <> '' GROUP BY issue_date, ctitle)"""


@query(
    f"""WITH {_CLASSES} SELECT issue_date::varchar AS issue_date, 'group_total' AS rule, group_id AS subject, n_total AS value FROM cls WHERE n_total > 4
    UNION ALL SELECT issue_date::varchar, 'group_side', group_id, greatest(n_left, n_right) FROM cls WHERE greatest(n_left, n_right) > 2"""
)
def invariant_violations(spark, sf_dir):
    members = _title_classes(spark, sf_dir)
    groups = members.select("issue_date", "group_id").distinct().withColumn("match_type", F.lit("matched"))
    return qa.check_invariants(groups, members).select(day(), "rule", "subject", "value")


@query(f"WITH {s.TITLE_GROUPS} SELECT '' AS issue_date, '' AS rule WHERE false")
def invariants_of_groups(spark, sf_dir):
    """Empty when the groups keep their bounds, use each article once and agree with the stored counts."""
    groups = cut_lineage(equal_title_groups(spark, sf_dir))
    members = gr.group_members(groups)
    counts = ar.snapshot_counts(d.articles(spark, sf_dir), members, groups)
    return qa.check_invariants(groups, members, counts).select(day(), "rule")


@query(
    f"""WITH {_CLASSES} SELECT issue_date::varchar AS issue_date, count(*) FILTER (n_left > 0 AND n_right > 0) AS matched_groups, count(*) FILTER (n_right = 0) AS left_only_groups,
      count(*) FILTER (n_left = 0) AS right_only_groups, coalesce(max(n_total) FILTER (n_left > 0 AND n_right > 0), 0) AS max_group_size,
      count(*) FILTER (n_total >= 6 AND n_left > 0 AND n_right > 0) AS suspicious_groups, coalesce(sum(n_left) FILTER (n_right > 0), 0)::BIGINT AS matched_left,
      coalesce(sum(n_right) FILTER (n_left > 0), 0)::BIGINT AS matched_right, coalesce(sum(n_left) FILTER (n_right = 0), 0)::BIGINT AS left_only,
      coalesce(sum(n_right) FILTER (n_left = 0), 0)::BIGINT AS right_only FROM cls GROUP BY issue_date"""
)
def diagnostics(spark, sf_dir):
    members = _title_classes(spark, sf_dir)
    groups = members.select("issue_date", "group_id").distinct().withColumn("match_type", F.lit(None).cast("string"))
    return qa.diagnose(groups, members).select(
        day(), "matched_groups", "left_only_groups", "right_only_groups", "max_group_size", "suspicious_groups", *qa.STORED_COUNTS
    )


@query(f"WITH {_CLASSES} SELECT issue_date::varchar AS issue_date, group_id, n_left, n_right, n_total FROM cls WHERE n_total >= 6 AND n_left > 0 AND n_right > 0")
def oversized_groups(spark, sf_dir):
    members = _title_classes(spark, sf_dir)
    groups = members.select("issue_date", "group_id").distinct().withColumn("match_type", F.lit(None).cast("string"))
    return qa.oversized_groups(groups, members).select(day(), "group_id", "n_left", "n_right", "n_total")


def expectations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` items as dated expectations over all of their words: each word is expected left of the one that follows it in the text."""
    rows = d.table(spark, sf_dir, "benchmark").select("item_id", "text", F.filter(F.split(F.lower("text"), "[^\\p{L}]+"), lambda w: w != "").alias("w"))
    word = rows.select("item_id", "text", "w", F.posexplode("w").alias("i", "left"))
    return word.filter(F.col("i") < F.size("w") - 1).select(
        d.hashed_date(F.col("text")).alias("issue_date"), F.concat(F.lit("item "), F.col("item_id").cast("string"), F.lit(" "), F.col("i").cast("string")).alias("label"),
        F.array("left").alias("left_terms"), F.array(F.get("w", F.col("i") + 1)).alias("right_terms"),
    )


_EXPECT = f"""{s.TITLE_GROUPS}, bw AS (SELECT item_id, text, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda w: w <> '') AS w FROM benchmark),
expect AS (SELECT {s.hashed_date('text')} AS issue_date, 'item ' || item_id || ' ' || i AS label, w[i + 1] AS a, w[i + 2] AS b FROM (SELECT *, unnest(range(len(w) - 1)) AS i FROM bw)),
gt AS (SELECT m.issue_date, m.group_id, list(a.title) FILTER (m.side = 'left') AS lt, list(a.title) FILTER (m.side = 'right') AS rt FROM members m JOIN art a ON a.id = m.article_id GROUP BY m.issue_date, m.group_id),
hit AS (SELECT e.issue_date, gt.group_id, e.label FROM expect e JOIN gt ON gt.issue_date = e.issue_date AND len(list_filter(lt, lambda x: contains(x, e.a))) > 0 AND len(list_filter(rt, lambda x: contains(x, e.b))) > 0)"""


def _group_titles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    groups = cut_lineage(equal_title_groups(spark, sf_dir))
    return groups, qa.group_titles(groups, gr.group_members(groups), d.articles(spark, sf_dir))


@query(f"WITH {_EXPECT} SELECT issue_date::varchar AS issue_date, group_id, label FROM hit")
def expectation_hits(spark, sf_dir):
    _, found = _group_titles(spark, sf_dir)
    return qa.match_expectations(found, expectations(spark, sf_dir)).select(day(), "group_id", "label")


@query(f"WITH {_EXPECT} SELECT issue_date::varchar AS issue_date, 'group_missing' AS failure, label FROM expect WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.label = expect.label AND hit.issue_date = expect.issue_date)")
def expectation_failures(spark, sf_dir):
    groups, found = _group_titles(spark, sf_dir)
    wanted = expectations(spark, sf_dir).withColumns({"kind": F.lit("group"), "value": F.lit(None).cast("int")})
    dates = d.articles(spark, sf_dir).select("issue_date").distinct()
    return qa.check_expected(groups, found, dates, wanted).select(day(), "failure", "label")


@query(
    f"""WITH {_EXPECT} SELECT issue_date::varchar AS issue_date, group_id, label, 'forbidden_pair' AS failure FROM hit
    UNION ALL SELECT gt.issue_date::varchar, group_id, 'global', 'forbidden_term' FROM gt WHERE len(list_filter(list_concat(lt, rt), lambda x: contains(x, 'thble'))) > 0"""
)
def forbidden_hits(spark, sf_dir):
    _, found = _group_titles(spark, sf_dir)
    pairs = expectations(spark, sf_dir).withColumn("kind", F.lit("forbidden_pair"))
    term = spark.createDataFrame([("global", ["thble"], [], "forbidden_term")], "label string, left_terms array<string>, right_terms array<string>, kind string")
    rules = pairs.unionByName(term.withColumn("issue_date", F.lit(None).cast("date")))
    return qa.check_forbidden(found, rules).select(day(), "group_id", "label", "failure")


# --- single operators ----------------------------------------------------------------------------------------


@query(
    """WITH x AS (SELECT page_id, html, strpos(html, '<title>') AS a FROM pages), y AS (SELECT page_id, a, substr(html, a + 7) AS rest FROM x)
    SELECT page_id, CASE WHEN a > 0 AND strpos(rest, '</title>') > 0 THEN substr(rest, 1, strpos(rest, '</title>') - 1) END AS title FROM y"""
)
def marked_parts(spark, sf_dir):
    """What stands between two markers of each page, null where one is missing."""
    return d.table(spark, sf_dir, "pages").select("page_id", t.between("html", "<title>", "</title>").alias("title"))


_YEARS = "CASE WHEN pos % 3 = 0 THEN (1880 + pos % 230)::varchar || '年' ELSE '' END || title"


@query(
    f"""WITH {s.ART}, y AS (SELECT pos, {_YEARS} AS t FROM art), z AS (SELECT pos, nullif(regexp_extract(t, '^((?:19|20)[0-9]{{2}})年', 1), '') AS y FROM y)
    SELECT pos AS doc_id, y AS leading_year, (y IS NOT NULL AND y <> '2024') AS conflict FROM z"""
)
def leading_years(spark, sf_dir):
    """Titles of which every third begins with a number and the sign for year: the year, and whether it conflicts with another."""
    year = F.when(F.col("pos") % 3 == 0, F.concat((1880 + F.col("pos") % 230).cast("string"), F.lit("年"))).otherwise(F.lit(""))
    found = t.leading_year(F.concat(year, "title"))
    return d.articles(spark, sf_dir).select(F.col("pos").alias("doc_id"), found.alias("leading_year"), F.coalesce(t.year_conflict(found, F.lit("2024")), F.lit(False)).alias("conflict"))


@query(
    """WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y/%m/%d') WHEN 2 THEN strftime(ts, '%Y-%m-%d') || ' ' ELSE strftime(ts, '%y-%m-%d') END AS d FROM events)
    SELECT event_id, CASE WHEN regexp_full_match(d, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN d END AS issue_date FROM x"""
)
def written_dates(spark, sf_dir):
    """Dates as written by four hands; only the form of the archive counts."""
    form = F.element_at(F.array(*[F.date_format("ts", f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd ", "yy-MM-dd")]), (F.col("event_id") % 4 + 1).cast("int"))
    return d.table(spark, sf_dir, "events").select("event_id", ar.norm_issue_date(form).alias("issue_date"))


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def last_rows(spark, sf_dir):
    """The last event of each user and type."""
    return ar.dedupe_last(d.table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query(
    f"""WITH {s.ART}, n AS (SELECT issue_date, count(*) AS articles FROM art GROUP BY issue_date), one AS (SELECT issue_date, count(*) AS articles FROM art WHERE day(issue_date) % 2 = 0 AND side = 'left' GROUP BY issue_date)
    SELECT n.issue_date::varchar AS issue_date, CASE WHEN one.issue_date IS NOT NULL THEN 'first' ELSE 'second' END AS store, coalesce(one.articles, n.articles) AS articles
    FROM n LEFT JOIN one ON one.issue_date = n.issue_date"""
)
def archive_stores(spark, sf_dir):
    """Each date whole from the first store that has it: the first holds the left articles of even days, the second all, a third does not exist."""
    rows = d.articles(spark, sf_dir).select("issue_date", "side", "id")
    paths = [scratch_table_path(spark, name) for name in ("store", "store", "store")]
    ar.write_snapshot(rows.filter((F.dayofmonth("issue_date") % 2 == 0) & (F.col("side") == "left")).withColumn("store", F.lit("first")), paths[0])
    ar.write_snapshot(rows.withColumn("store", F.lit("second")), paths[2])
    found = ar.read_with_fallback(spark, paths)
    return found.groupBy("issue_date", "store").agg(F.count("*").alias("articles")).select(day(), "store", "articles")


@query(f"WITH {s.ART} SELECT side AS source, issue_date::varchar AS issue_date, page_number::int AS page_number, id, title FROM art")
def nested_issues(spark, sf_dir):
    """Articles put into pages and issues, and taken out again."""
    rows = d.articles(spark, sf_dir).select(F.col("side").alias("source"), "issue_date", "page_number", "id", "title")
    pages = rows.select("source", "issue_date", "page_number").distinct()
    return ar.flatten_articles(ar.nest_issue(pages, rows)).select("source", day(), "page_number", "id", "title")


@query(f"WITH {s.ART} SELECT pos AS doc_id, CASE WHEN starts_with(title, 'E') AND length(title) >= 6 THEN {s.trim('substr(title, 2)')} ELSE {s.trim('title')} END AS phrase FROM art")
def stray_letters(spark, sf_dir):
    """Shared phrases without one stray first letter."""
    rules = replace(R, stray_title_prefix="E")
    return d.articles(spark, sf_dir).select(F.col("pos").alias("doc_id"), cd.clean_shared_title(F.col("title"), rules).alias("phrase"))


# --- topics --------------------------------------------------------------------------------------------------


def topic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as topics: a turn is an article, its role the side, its words the profile."""
    words = F.split(t.collapse_ws("text"), " ")
    picked = lambda cue: F.filter(words, lambda w: F.contains(w, F.lit(cue)))
    none = F.array().cast("array<string>")
    return d.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("topic_id"),
        F.when(F.col("role") == "user", F.lit("left")).otherwise(F.lit("right")).alias("side"),
        F.col("turn").alias("pos"),
        F.concat_ws("-", "conv_id", "turn").alias("article_id"),
        d.first_sentence(F.col("text")).alias("title"),
        picked("eau").alias("keywords"),
        F.struct(
            F.get(words, F.lit(0)).alias("core_frame"), F.filter(words, lambda w: w.rlike("^[A-ZÉÈ]")).alias("main_actors"),
            none.alias("beneficiaries"), picked("ment").alias("problem_terms"), picked("tion").alias("solution_terms"),
            picked("ung").alias("authority_sources"),
        ).alias("narrative"),
    )


_TOPIC = f"""conv AS (SELECT conv_id AS topic_id, CASE WHEN role = 'user' THEN 'left' ELSE 'right' END AS side, turn AS pos, string_split({s.collapse('text')}, ' ') AS w, trim(regexp_extract(text, '^[^.\\n]*')) AS title FROM conversations),
prof AS (SELECT *, list_filter(w, lambda x: contains(x, 'eau')) AS kw, list_filter(w, lambda x: contains(x, 'ment')) AS pt, list_filter(w, lambda x: contains(x, 'tion')) AS st, list_filter(w, lambda x: contains(x, 'ung')) AS au,
    list_filter(w, lambda x: regexp_matches(x, '^[A-ZÉÈ]')) AS ac FROM conv),
fields AS (
  SELECT topic_id, side, pos, 'frames' AS field, 0 AS i, w[1] AS term FROM prof
  UNION ALL SELECT topic_id, side, pos, 'actors', unnest(range(0, len(ac))), unnest(ac) FROM prof
  UNION ALL SELECT topic_id, side, pos, 'problems', unnest(range(0, len(pt))), unnest(pt) FROM prof
  UNION ALL SELECT topic_id, side, pos, 'solutions', unnest(range(0, len(st))), unnest(st) FROM prof
  UNION ALL SELECT topic_id, side, pos, 'authorities', unnest(range(0, len(au))), unnest(au) FROM prof),
ranked AS (SELECT topic_id, side, field, term, row_number() OVER (PARTITION BY topic_id, side, field ORDER BY f.a, f.b, term) AS rank FROM (
  SELECT topic_id, side, field, term, min({{'a': pos, 'b': i}}) AS f FROM fields WHERE term <> '' GROUP BY ALL))"""


@query(f"WITH {_TOPIC} SELECT topic_id, side, field, term, rank::int AS rank FROM ranked")
def side_summary(spark, sf_dir):
    return tp.side_summary(topic_rows(spark, sf_dir)).select("topic_id", "side", "field", "term", "rank")


@query(
    f"""WITH {_TOPIC} SELECT topic_id, field, string_agg(term, '、' ORDER BY rank) FILTER (side = 'left') AS left_text, string_agg(term, '、' ORDER BY rank) FILTER (side = 'right') AS right_text
    FROM ranked WHERE rank <= 4 GROUP BY topic_id, field"""
)
def frame_comparison(spark, sf_dir):
    return tp.frame_comparison(topic_rows(spark, sf_dir)).select("topic_id", "field", "left_text", "right_text")


@query(
    f"""WITH {_TOPIC}, k AS (SELECT topic_id, side, pos, unnest(range(0, len(x))) AS i, unnest(x) AS term FROM (SELECT topic_id, side, pos, list_concat(kw, pt, st) AS x FROM prof))
    SELECT topic_id, side, term, rank::int AS rank FROM (SELECT topic_id, side, term, row_number() OVER (PARTITION BY topic_id, side ORDER BY f.a, f.b, term) AS rank FROM
      (SELECT topic_id, side, term, min({{'a': pos, 'b': i}}) AS f FROM k WHERE term <> '' GROUP BY ALL)) WHERE rank <= 7"""
)
def topic_keywords(spark, sf_dir):
    return tp.topic_keywords(topic_rows(spark, sf_dir)).select("topic_id", "side", "term", "rank")


def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snippet per turn; the claim type follows from the turn number."""
    claims = F.array(*[F.lit(f"{c}_shift") for c in tp.DELTA_CLAIMS], F.lit("common_ground"), F.lit("other"))
    return topic_rows(spark, sf_dir).select(
        "topic_id", "side", "article_id", "pos", F.get(claims, (F.col("pos") % 8).cast("int")).alias("claim_type"), F.col("title").alias("text")
    )


_CLAIM = "['frame_shift', 'actor_shift', 'goal_shift', 'threat_shift', 'solution_shift', 'authority_shift', 'common_ground', 'other'][pos % 8 + 1]"


@query(f"WITH {_TOPIC} SELECT topic_id, {_CLAIM} AS claim_type, count(*) AS n FROM conv GROUP BY ALL")
def evidence_counts(spark, sf_dir):
    return tp.evidence_counts(evidence_rows(spark, sf_dir))


@query(
    f"""WITH {_TOPIC}, c AS (SELECT topic_id, {_CLAIM} AS claim_type, count(*) AS n, arg_min(title, {{'p': pos, 't': title}}) AS title FROM conv GROUP BY ALL),
    d AS (SELECT topic_id, unnest(['frame', 'actor', 'goal', 'threat', 'solution', 'authority']) AS k, unnest(range(0, 6)) AS claim_pos FROM (SELECT DISTINCT topic_id FROM conv))
    SELECT d.topic_id, claim_pos::int AS claim_pos, k || '_shift' AS claim_type, k || ': ' || coalesce(c.title, '') AS text, coalesce(c.n, 0)::bigint AS n FROM d LEFT JOIN c ON c.topic_id = d.topic_id AND c.claim_type = k || '_shift'"""
)
def delta_overview(spark, sf_dir):
    """Six claims per topic over all of its turns; the first turn of a claim gives its text."""
    turns = cut_lineage(evidence_rows(spark, sf_dir))
    first = lambda c: F.min(F.when(F.col("claim_type") == f"{c}_shift", F.struct("pos", "text")))["text"]
    delta = F.struct(*[F.concat(F.lit(f"{c}: "), F.coalesce(first(c), F.lit(""))).alias(c) for c in tp.DELTA_CLAIMS])
    tops = turns.groupBy("topic_id").agg(delta.alias("delta"))
    return tp.delta_overview(tops, turns).select("topic_id", "claim_pos", "claim_type", "text", "n")


@query(
    f"""WITH {_TOPIC}, lx AS (SELECT DISTINCT topic_id, side, unnest(kw) AS term FROM prof), pr AS (SELECT DISTINCT topic_id, side, unnest(pt) AS term FROM prof),
    si AS (SELECT topic_id, CASE side WHEN 'left' THEN 'right' ELSE 'left' END AS side, term FROM pr p WHERE NOT EXISTS (SELECT 1 FROM pr o WHERE o.topic_id = p.topic_id AND o.term = p.term AND o.side <> p.side))
    SELECT topic_id, side, kind, (row_number() OVER (PARTITION BY topic_id, side, kind ORDER BY term) - 1)::int AS pos, term
    FROM (SELECT *, 'lexical' AS kind FROM lx UNION ALL SELECT *, 'silence' FROM si)"""
)
def lexical_contrast(spark, sf_dir):
    """Keywords of each side over all turns, and the problem terms that only the other side uses."""
    turns = topic_rows(spark, sf_dir)
    terms = lambda c: turns.select("topic_id", "side", F.explode(c).alias("term")).distinct()
    used = cut_lineage(terms("narrative.problem_terms"))
    flip = F.when(F.col("side") == "left", F.lit("right")).otherwise(F.lit("left")).alias("side")
    silent = used.select("topic_id", flip, "term").join(used, ["topic_id", "side", "term"], "left_anti")
    marked = terms("keywords").withColumn("kind", F.lit("lexical")).unionByName(silent.withColumn("kind", F.lit("silence")))
    lists = [
        F.array_sort(F.collect_set(F.when((F.col("kind") == kind) & (F.col("side") == side), F.col("term")))).alias(f"{kind}_{side}")
        for kind in ("lexical", "silence") for side in ("left", "right")
    ]
    return tp.lexical_contrast(marked.groupBy("topic_id").agg(*lists))


@query(
    f"""WITH {_TOPIC} SELECT topic_id, topic_id || '-' || pos AS article_id, title, CASE WHEN side = 'left' THEN '人民日報' ELSE '解放軍報' END AS source_label,
      CASE {_CLAIM} {' '.join(f"WHEN {s.q(c)} THEN {s.q(x)}" for (k, c), x in R.labels.items() if k == 'claim')} ELSE 'other' END AS claim_label FROM conv"""
)
def evidence_list(spark, sf_dir):
    rows = topic_rows(spark, sf_dir).select("side", F.col("article_id").alias("id"), "title")
    return tp.evidence_list(evidence_rows(spark, sf_dir), rows, R.label_table(spark)).select(
        "topic_id", "article_id", "title", "source_label", "claim_label"
    )


@query(
    f"""WITH {_TOPIC}, a AS (SELECT topic_id, side, pos, topic_id || '-' || pos AS article_id FROM conv)
    SELECT topic_id, side, article_id, pos FROM a"""
)
def topic_members(spark, sf_dir):
    rows = topic_rows(spark, sf_dir)
    members = rows.select("topic_id", "side", "article_id", "pos").unionByName(
        rows.select("topic_id", "side", F.concat("article_id", F.lit("-unknown")).alias("article_id"), "pos")
    )
    return tp.topic_articles(members, rows.select("side", F.col("article_id").alias("id"), "title")).select("topic_id", "side", "article_id", "pos")
