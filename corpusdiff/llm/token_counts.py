"""Token counts of the fields and sections of a document by offset-mapped attribution.

The fields of a row, joined by a separator, are encoded once as one text. Every token has a character span in it; the spans are joined with the
intervals of the sections, which lie one after the other without gaps, by a search in their sorted starts. A token that lies in several sections is
allocated by the rule:

``majority``  to the section with most of its characters, to the earliest of those with equally many (production rule);
``first``     to the section of its first character;
``split``     to each section in proportion to its characters.

Work stays inside a row, so nothing is shuffled and hot keys do not exist.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusdiff.llm.tokens import DEFAULT_PATH, encoder

RULES = ("majority", "first", "split")


def allocate(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens, and crossing tokens allocated (or partly allocated), per section; section i is ``bounds[i]`` to ``bounds[i + 1]``."""
    n = len(bounds) - 1
    counts, crossing = np.zeros(n), np.zeros(n, np.int64)
    if not len(starts):
        return counts, crossing
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    whole = first == last
    counts += np.bincount(first[whole], minlength=n)
    for k in np.flatnonzero(~whole):
        sections = np.arange(first[k], last[k] + 1)
        share = np.minimum(ends[k], bounds[sections + 1]) - np.maximum(starts[k], bounds[sections])
        if rule == "split":
            counts[sections] += share / share.sum()
            crossing[sections[share > 0]] += 1
        else:
            to = sections[np.argmax(share)] if rule == "majority" else first[k]
            counts[to] += 1
            crossing[to] += 1
    return counts, crossing


def sections_of(values: Sequence[str], lines: Sequence[bool], separator: str) -> tuple[str, list[tuple[int, int]], np.ndarray]:
    """The whole text, ``(field, number in the field)`` of each section, and the sections' bounds; a line keeps its line end."""
    names, bounds, text = [], [0], []
    at = 0
    for field, (value, split) in enumerate(zip(values, lines)):
        value += separator if field < len(values) - 1 else ""
        text.append(value)
        ends = [k + 1 for k, c in enumerate(value) if c == "\n"] if split and "\n" in value else []
        if not ends or ends[-1] < len(value):
            ends.append(len(value))
        for number, end in enumerate(ends):
            names.append((field, number))
            bounds.append(at + end)
        at += len(value)
    return "".join(text), names, np.array(bounds)


def token_counts(
    df: DataFrame, fields: Sequence[str] = ("text",), by_line: Sequence[str] = ("text",), id_col: str = "doc_id", rule: str = "majority",
    separator: str = "\n", path: str = DEFAULT_PATH,
) -> DataFrame:
    """Per row, field and section: ``id_col, field, section`` (from 0), ``start, end`` (characters of the whole text), ``n_tokens``, ``n_crossing``.

    Fields in ``by_line`` have a section per line, others one. The separator after a field counts as its last characters. A null or empty field is
    one section, without tokens unless the separator follows. ``n_tokens`` sums to the tokens of the whole text. Equal rows give equal results, each for
    itself; other columns are not read; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = list(fields)
    lines = [f in by_line for f in names]
    schema = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType), T.StructField("field", T.StringType()), T.StructField("section", T.LongType()),
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("n_tokens", T.DoubleType() if rule == "split" else T.LongType()), T.StructField("n_crossing", T.LongType()),
    ])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows, owners, bounds_from, bounds_to, tokens, crossed = [], [], [], [], [], []
            texts = [batch[f"f{k}"].to_pylist() for k in range(len(names))]
            for at in range(batch.num_rows):
                text, owner, bounds = sections_of([t[at] or "" for t in texts], lines, separator)
                n, crossing = allocate(*encode.spans(text), bounds, rule)
                rows += [at] * len(owner)
                owners += owner
                bounds_from.append(bounds[:-1])
                bounds_to.append(bounds[1:])
                tokens.append(n)
                crossed.append(crossing)
            if not rows:
                continue
            counts = np.concatenate(tokens)
            yield pa.RecordBatch.from_arrays([
                batch["id"].take(pa.array(rows)), pa.array([names[f] for f, _ in owners]), pa.array([s for _, s in owners], pa.int64()),
                pa.array(np.concatenate(bounds_from)), pa.array(np.concatenate(bounds_to)),
                pa.array(counts if rule == "split" else counts.astype(np.int64)), pa.array(np.concatenate(crossed)),
            ], schema.names)

    columns = [F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(names)]
    return df.select(F.col(id_col).alias("id"), *columns).mapInArrow(count, schema)
