"""The date-partitioned archive: snapshots, index, retention and backfill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from corpusdiff.operators.graph import METRICS
from corpusdiff.session import cut_lineage, scratch_table_path

SCHEMA_VERSION = 1


def norm_issue_date(text: Column) -> Column:
    return F.when(text.rlike("^\\d{4}-\\d{2}-\\d{2}$"), text)


def issue_date_in_tz(ts: Column, tz: str = "Asia/Shanghai") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, tz))


def in_window(df: DataFrame, start: str | None = None, end: str | None = None, days: int | None = None) -> DataFrame:
    """Rows of a date window; on a partitioned table this prunes partitions."""
    if days is not None and start and not end:
        df = df.filter(F.col("issue_date") < F.date_add(F.lit(start).cast("date"), days))
    if days is not None and end and not start:
        df = df.filter(F.col("issue_date") > F.date_sub(F.lit(end).cast("date"), days))
    if start:
        df = df.filter(F.col("issue_date") >= F.lit(start).cast("date"))
    return df.filter(F.col("issue_date") <= F.lit(end).cast("date")) if end else df


def expand_dates(
    spark: SparkSession, dates: list[str] = (), start: str | None = None, end: str | None = None, days: int | None = None
) -> DataFrame:
    """Listed dates and a range given by its end or its length; each once, sorted."""
    parts = [spark.createDataFrame([(d,) for d in dates], "d string").select(F.to_date("d").alias("issue_date"))] if dates else []
    if start:
        first = F.lit(start).cast("date")
        last = F.lit(end).cast("date") if end else F.date_add(first, (days or 1) - 1)
        parts.append(spark.range(1).select(F.explode(F.sequence(first, last)).alias("issue_date")))
    if not parts:
        return spark.createDataFrame([], "issue_date date")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.distinct().orderBy("issue_date")


def write_snapshot(df: DataFrame, path: str) -> None:
    """Replace the dates present in ``df``, leave all others. Rows of a date are spread over several files when large."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("issue_date").parquet(path)


def read_archive(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, days: int | None = None) -> DataFrame:
    return in_window(spark.read.parquet(path), start, end, days)


def read_snapshot(spark: SparkSession, path: str, issue_date: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("issue_date") == F.lit(issue_date).cast("date"))


def read_with_fallback(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """All dates over several stores; each date comes whole from the first store that has it.

    Stores that do not exist are passed over; if none does, the result is empty with ``schema``, which is then needed.
    """
    out = None
    for priority, path in enumerate(paths):
        try:
            store = spark.read.parquet(path).withColumn("src_priority", F.lit(priority))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        out = store if out is None else out.unionByName(store, allowMissingColumns=True)
    if out is None:
        if schema is None:
            raise ValueError("none of the stores exists, and no schema is given")
        return spark.createDataFrame([], schema)
    best = out.groupBy("issue_date").agg(F.min("src_priority").alias("src_priority"))
    return out.join(best, ["issue_date", "src_priority"], "left_semi").drop("src_priority")


def scan_archive_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Per-date JSON snapshots; the date comes from the body, else from the file name. Index files are skipped."""
    raw = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file_name", F.col("_metadata.file_name"))
    named = F.regexp_extract("file_name", "(\\d{4}-\\d{2}-\\d{2})", 1)
    own = [F.col(c).cast("string") for c in ("issueDate", "date") if c in raw.columns]
    return raw.filter(F.col("file_name") != "index.json").withColumn(
        "issue_date", F.to_date(F.coalesce(*own, F.nullif(named, F.lit(""))))
    )


#: Where the parts of a snapshot may stand, first place first.
SNAPSHOT_PLACES = ("$", "$.result", "$.snapshot")


def _part(body: Column, *paths: str) -> Column:
    """The first part of a VARIANT that is there and not null."""
    found = [F.try_variant_get(body, path, "variant") for path in paths]
    return F.coalesce(*[F.when(~F.is_variant_null(v), v) for v in found])


def normalize_snapshots(files: DataFrame) -> DataFrame:
    """Snapshots of any nesting as rows: ``file_name, issue_date, generated_at, judge, counts, left_issue, right_issue, match_groups``.

    ``files``: ``file_name`` and ``json``. No schema is given: bodies are VARIANT values, and each part is taken from the body itself, from ``result`` or from ``snapshot``, groups also
    from ``groups``. The date comes from the body, else from the file name. Index files, broken texts, and snapshots without a date or without groups give no row.
    """
    parsed = files.filter(F.col("file_name") != "index.json").withColumn("body", F.try_parse_json("json"))

    def everywhere(name: str) -> Column:
        return _part(F.col("body"), *(f"{place}.{name}" for place in SNAPSHOT_PLACES))

    def text(value: Column) -> Column:
        return F.nullif(F.try_variant_get(value, "$", "string"), F.lit(""))

    dates = [text(_part(F.col("body"), path)) for path in ("$.issueDate", "$.date", "$.result.issueDate", "$.snapshot.issueDate")]
    named = F.nullif(F.regexp_extract("file_name", "\\d{4}-\\d{2}-\\d{2}", 0), F.lit(""))
    groups = _part(F.col("body"), "$.matchGroups", "$.groups", "$.result.matchGroups", "$.snapshot.matchGroups")
    rows = parsed.select(
        "file_name", F.try_to_date(F.coalesce(*dates, named)).alias("issue_date"), text(everywhere("generatedAt")).alias("generated_at"), everywhere("judge").alias("judge"),
        everywhere("counts").alias("counts"), everywhere("leftIssue").alias("left_issue"), everywhere("rightIssue").alias("right_issue"),
        F.try_variant_get(groups, "$", "array<variant>").alias("match_groups"),
    )
    return rows.filter(F.col("issue_date").isNotNull() & (F.size("match_groups") > 0))


def scan_archive(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, days: int | None = None) -> DataFrame:
    """:func:`normalize_snapshots` of the JSON files below ``path``, one snapshot per file, in a window of dates."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    return in_window(normalize_snapshots(files.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("json"))), start, end, days)


def nest_issue(pages: DataFrame, articles: DataFrame) -> DataFrame:
    """Export form: pages with their articles inside. An issue page is a print page, so its article list is small;
    wide outputs should stay flat."""
    key = ["source", "issue_date", "page_number"]
    fields = [c for c in articles.columns if c not in key]
    listed = articles.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("articles"))
    own = [c for c in pages.columns if c not in ("source", "issue_date")]
    return pages.join(listed, key, "left").groupBy("source", "issue_date").agg(
        F.array_sort(F.collect_list(F.struct(*own, "articles"))).alias("pages")
    )


def flatten_articles(issues: DataFrame) -> DataFrame:
    pages = issues.select("source", "issue_date", F.explode("pages").alias("page"))
    return pages.select("source", "issue_date", F.col("page.page_number").alias("page_number"), F.explode("page.articles").alias("a")).select(
        "source", "issue_date", "page_number", "a.*"
    )


DISPLAY_ARTICLE = ("id", "side", "source", "issue_date", "page_number", "page_name", "title", "subtitle", "author", "excerpt", "url")


def display_articles(articles: DataFrame) -> DataFrame:
    """Only fields meant for readers; the whole text is never read from the files."""
    return articles.select(*[c for c in DISPLAY_ARTICLE if c in articles.columns])


# --- counts, status and index --------------------------------------------------------------------------------


def snapshot_counts(articles: DataFrame, matched_members: DataFrame, groups: DataFrame) -> DataFrame:
    """Per date: articles, matched groups, matched and one-sided articles of each side."""
    flagged = articles.select("issue_date", "side", F.col("id").alias("article_id")).join(
        matched_members.select("issue_date", "side", "article_id", F.lit(True).alias("matched")).distinct(),
        ["issue_date", "side", "article_id"],
        "left",
    )
    left, hit = F.col("side") == "left", F.col("matched").isNotNull()
    counts = flagged.groupBy("issue_date").agg(
        F.count_if(left).alias("left_articles"),
        F.count_if(~left).alias("right_articles"),
        F.count_if(left & hit).alias("matched_left"),
        F.count_if(~left & hit).alias("matched_right"),
        F.count_if(left & ~hit).alias("left_only"),
        F.count_if(~left & ~hit).alias("right_only"),
    )
    n_groups = groups.groupBy("issue_date").agg(F.count("*").alias("matched_groups"))
    return counts.join(n_groups, "issue_date", "left").na.fill(0, ["matched_groups"])


def snapshot_status(units: DataFrame) -> DataFrame:
    """``units`` holds (issue_date, status) of issues and pages."""
    severity = F.when(F.col("status") == "failed", 2).when(F.col("status").isin("partial", "empty"), 1).otherwise(0)
    worst = units.groupBy("issue_date").agg(F.max(severity).alias("w"))
    names = F.array(F.lit("success"), F.lit("partial"), F.lit("failed"))
    return worst.select("issue_date", F.get(names, F.col("w")).alias("status"))


INDEX_SCHEMA = (
    "issue_date date, left_articles long, right_articles long, matched_left long, matched_right long, left_only long, right_only long, matched_groups long, "
    "status string, graph struct<" + ", ".join(f"{m}: long" for m in METRICS) + ">, generated_at timestamp, judge_enabled boolean, judge_model string, path string"
)


def index_entries(counts: DataFrame, status: DataFrame, metrics: DataFrame, judge_enabled: bool = False, judge_model: str = "local-heuristic", generated_at: Column | None = None) -> DataFrame:
    graph = metrics.select("issue_date", F.struct(*METRICS).alias("graph"))
    return counts.join(status, "issue_date", "left").join(graph, "issue_date", "left").withColumns(
        {
            "generated_at": F.current_timestamp() if generated_at is None else generated_at,
            "judge_enabled": F.lit(judge_enabled),
            "judge_model": F.lit(judge_model),
            "path": F.concat(F.lit("archive/"), F.col("issue_date").cast("string"), F.lit(".json")),
        }
    )


def merge_indexes(entries: DataFrame) -> DataFrame:
    """Fold the entries of each date in store order (``src_priority``).

    A later entry replaces the kept one when it alone has graph metrics, or else when it is newer. The result depends
    on the order, so it is a fold over the few stores of a date and not a maximum.
    """
    fields = [c for c in entries.columns if c not in ("issue_date", "src_priority")]
    listed = entries.groupBy("issue_date").agg(
        F.array_sort(F.collect_list(F.struct("src_priority", F.struct(*fields).alias("e"))), _by_priority).alias("all")
    )
    folded = F.aggregate(
        F.slice("all", 2, F.size("all")),
        F.get("all", F.lit(0))["e"],
        lambda kept, x: F.when(
            (kept["graph"].isNull() & x["e"]["graph"].isNotNull()) | (x["e"]["generated_at"] > kept["generated_at"]), x["e"]
        ).otherwise(kept),
    )
    return listed.select("issue_date", folded.alias("e")).select("issue_date", "e.*")


def _by_priority(a: Column, b: Column) -> Column:
    return F.when(a["src_priority"] < b["src_priority"], -1).when(a["src_priority"] > b["src_priority"], 1).otherwise(0)


def read_index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The merged index over several stores, first store first. Stores that do not exist are passed over; without any the index is empty."""
    out = None
    for priority, path in enumerate(paths):
        try:
            store = spark.read.parquet(path).withColumn("src_priority", F.lit(priority))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        out = store if out is None else out.unionByName(store, allowMissingColumns=True)
    return spark.createDataFrame([], INDEX_SCHEMA) if out is None else merge_indexes(out)


def upsert_entry(index: DataFrame, entry: DataFrame) -> DataFrame:
    return index.join(entry.select("issue_date"), "issue_date", "left_anti").unionByName(entry, allowMissingColumns=True)


def retain(index: DataFrame, n_entries: int | None) -> DataFrame:
    """The newest ``n_entries`` entries (entries, not days); None keeps all."""
    if n_entries is None:
        return index.orderBy(F.desc("issue_date"))
    return index.orderBy(F.desc("issue_date")).limit(n_entries)


def latest_timestamp(df: DataFrame) -> DataFrame:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp")
    return df.agg(F.coalesce(F.max("generated_at"), epoch).alias("updated_at"))


def archive_coverage(index: DataFrame) -> DataFrame:
    return index.agg(
        F.min("issue_date").alias("oldest"), F.max("issue_date").alias("newest"), F.count_distinct("issue_date").alias("dates")
    )


def newest_per_date(entries: DataFrame) -> DataFrame:
    newest = Window.partitionBy("issue_date").orderBy(F.desc("generated_at"), "src_priority")
    return entries.withColumn("n_", F.row_number().over(newest)).filter("n_ = 1").drop("n_")


def dedupe_last(df: DataFrame, key: list[str], order: str) -> DataFrame:
    last = Window.partitionBy(*key).orderBy(F.desc(order))
    return df.withColumn("n_", F.row_number().over(last)).filter("n_ = 1").drop("n_")


def backfill(
    dates: DataFrame, existing: DataFrame | None, build: Callable[[DataFrame], DataFrame], path: str | None,
    skip_existing: bool = True, index: Callable[[DataFrame], DataFrame] | None = None, index_path: str | None = None,
) -> DataFrame:
    """Build all wanted dates in one job and write them; without ``path`` nothing is written (dry run). With ``index`` the entries of the built dates replace theirs in the index.

    Returns (issue_date, result, rows): built, skipped, or failed if this run made no rows, whatever an earlier run has left.
    """
    wanted = dates.select("issue_date").distinct()
    todo = wanted
    skipped = wanted.limit(0)
    if existing is not None and skip_existing:
        done = existing.select("issue_date").distinct()
        todo, skipped = wanted.join(done, "issue_date", "left_anti"), wanted.join(done, "issue_date", "left_semi")
    spark = dates.sparkSession
    todo = cut_lineage(todo)
    built = build(todo)
    if path is not None:
        own = scratch_table_path(spark, "backfill-run")
        built.write.parquet(own)
        built = spark.read.schema(built.schema).parquet(own)
        write_snapshot(built, path)
        if index is not None and index_path is not None:
            write_snapshot(index(built), index_path)
    made = built.groupBy("issue_date").agg(F.count("*").alias("rows"))
    outcome = F.when(F.col("rows").isNotNull(), F.lit("built")).otherwise(F.lit("failed"))
    return todo.join(made, "issue_date", "left").select("issue_date", outcome.alias("result"), F.coalesce("rows", F.lit(0)).alias("rows")).unionByName(
        skipped.select("issue_date", F.lit("skipped").alias("result"), F.lit(0).cast("long").alias("rows"))
    )


def rebuild_index(archive: DataFrame, index: Callable[[DataFrame], DataFrame], index_path: str) -> None:
    """The whole index from the archive alone: what refreshes and backfills have put there date by date, by the same function ``index`` of the rows of a date."""
    index(archive).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("issue_date").parquet(index_path)
