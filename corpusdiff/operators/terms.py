"""Many terms in many titles: which terms occur in which title, by Aho-Corasick automata over all terms.

An automaton reads a title once, whatever the number of terms. Terms are dealt into parts of bounded size; a part is the only thing that is broadcast, and every title is read
once for each part. So a rule set of any size works, in as many passes as it has parts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdiff.session import cut_lineage

#: Characters of the terms that one automaton holds.
PART_CHARS = 2_000_000


@functools.lru_cache(maxsize=2)
def _automaton(terms: tuple[str, ...]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for term in terms:
        made.add_word(term, term)
    made.make_automaton()
    return made


def terms_in(text: str | None, terms: tuple[str, ...]) -> list[str]:
    """The distinct terms that occur in a text, in order."""
    return sorted({term for _, term in _automaton(terms).iter(text)}) if text and terms else []


def term_parts(terms: DataFrame, part_chars: int = PART_CHARS) -> Iterator[tuple[str, ...]]:
    """The distinct, not empty values of ``term`` in parts of at most about ``part_chars`` characters; one part at a time is collected."""
    known = cut_lineage(terms.filter("term <> ''").select("term").distinct())
    chars = known.agg(F.coalesce(F.sum(F.length("term")), F.lit(0))).first()[0]
    parts = -(-chars // part_chars)
    numbered = known.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(max(parts, 1))))
    for part in range(parts):
        yield tuple(sorted(r["term"] for r in numbered.filter(F.col("part") == part).select("term").collect()))


def _looked_up(sent: Broadcast):
    """The terms of a broadcast part in a column of texts."""

    @F.arrow_udf("array<string>")
    def inside(values: pa.Array) -> pa.Array:
        return pa.array([terms_in(text, sent.value) for text in values.to_pylist()], pa.list_(pa.string()))

    return inside


def term_hits(texts: DataFrame, terms: DataFrame, column: str = "title", part_chars: int = PART_CHARS) -> DataFrame:
    """The other columns of ``texts`` and ``term``, for each term that occurs in the text of ``column``. Null texts and empty terms occur nowhere."""
    rest = [c for c in texts.columns if c != column]
    found = None
    for part in term_parts(terms, part_chars):
        inside = _looked_up(texts.sparkSession.sparkContext.broadcast(part))
        hits = texts.select(*rest, F.explode(inside(F.col(column))).alias("term"))
        found = hits if found is None else found.unionAll(hits)
    return texts.limit(0).select(*rest, F.lit("").alias("term")) if found is None else found
