"""Incremental refresh: new landed rows rebuild the dates they belong to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corpusdiff.session import cut_lineage
from corpusdiff.sources.archive import write_snapshot


def refresh(
    stream: DataFrame, all_articles: Callable[[], DataFrame], build: Callable[[DataFrame], DataFrame], archive_path: str,
    checkpoint: str, index: Callable[[DataFrame], DataFrame] | None = None, index_path: str | None = None,
) -> StreamingQuery:
    """Start the refresh over everything that has landed; it ends when caught up.

    Each batch only names its dates. The articles of those dates are read again from the landed table, so late rows
    rebuild their date whole and a repeated batch writes the same partitions again. With ``index``, a function from the built rows of dates to one entry per date, the entries of the
    touched dates replace theirs in the index, after the rows: a batch that is repeated after a failure writes both again, so data and index end up equal to one run.
    """

    def rebuild(batch: DataFrame, _: int) -> None:
        dates = cut_lineage(batch.select("issue_date").distinct())
        if dates.isEmpty():
            return
        touched = all_articles().join(dates, "issue_date", "left_semi")
        write_snapshot(build(touched), archive_path)
        if index is not None and index_path is not None:
            written = dates.sparkSession.read.parquet(archive_path).join(dates, "issue_date", "left_semi")
            write_snapshot(index(written), index_path)

    return (
        stream.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
