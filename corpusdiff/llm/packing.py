"""Best-two-fit packing of token sequences.

A document's ids end with a separator id; one longer than ``capacity`` is cut into full pieces, of which the first may be shorter. Then:

1. Pieces are made and written once, with their task and their place among the task's pieces of equal length.
2. Only a histogram of lengths, of at most ``capacity`` rows, goes to the driver. There, sequences are filled greedily with the largest length
   that fits; then the smallest piece of a sequence is replaced with two unpacked pieces if they fill the gap more tightly. A
   filling is repeated as often as the histogram allows, so the plan has a bounded number of lines at any number of documents.
3. A piece's rank among all of its length is the count in earlier tasks plus its place in its own; the rank and the plan give its sequence and
   offset. No piece is ever gathered with others.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusdiff.llm.common import release_memory, stored
from corpusdiff.llm.tokens import DEFAULT_PATH, encoder

MAX_PLAN_LINES = 4_000_000


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document of ``n`` ids; only the first may be shorter than ``capacity``."""
    head = n % capacity
    pieces = [(0, head)] if head else []
    return pieces + [(start, capacity) for start in range(head, n, capacity)]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """``(lengths in a sequence, number of such sequences)``; every piece of the histogram is placed exactly once."""
    left = {length: count for length, count in histogram.items() if count > 0}
    sizes = sorted(left)
    made = []

    def fitting(gap: int, used: Counter) -> int | None:
        """The largest length up to ``gap`` of which a piece is left."""
        at = bisect_right(sizes, gap) - 1
        while at >= 0 and left[sizes[at]] <= used[sizes[at]]:
            at -= 1
        return sizes[at] if at >= 0 else None

    def two_within(gap: int, used: Counter) -> tuple[int, int] | None:
        """Two pieces left with the largest sum up to ``gap``."""
        best, low, high = None, 0, bisect_right(sizes, gap) - 1
        while low <= high:
            a, b = sizes[low], sizes[high]
            free_a, free_b = left[a] - used[a], left[b] - used[b]
            if free_a <= 0:
                low += 1
            elif free_b <= 0 or a + b > gap or (low == high and free_a < 2):
                high -= 1
            else:
                if best is None or a + b > sum(best):
                    best = (a, b)
                low += 1
        return best

    while sizes:
        used: Counter = Counter()
        gap = capacity
        while (size := fitting(gap, used)) is not None:
            used[size] += 1
            gap -= size
        while gap and used.total() > 1:
            smallest = min(x for x in used if used[x])
            rest = used.copy()
            rest[smallest] -= 1
            pair = two_within(gap + smallest, rest)
            if pair is None or sum(pair) <= smallest:
                break
            gap += smallest - sum(pair)
            used = rest
            used.update(pair)
        used = +used
        times = min(left[x] // k for x, k in used.items())
        made.append((sorted(used.elements(), reverse=True), times))
        for x, k in used.items():
            left[x] -= k * times
            if not left[x]:
                sizes.remove(x)
    return made


def _plan_lines(made: list[tuple[list[int], int]]) -> np.ndarray:
    """Per length and filling: length, first rank, pieces per sequence, first sequence, offset in it; sorted by length and rank."""
    lines, ranks, sequence = [], Counter(), 0
    for lengths, times in made:
        offset = 0
        for length, copies in sorted(Counter(lengths).items(), reverse=True):
            lines.append((length, ranks[length], copies, sequence, offset))
            ranks[length] += copies * times
            offset += copies * length
        sequence += times
    if len(lines) > MAX_PLAN_LINES:
        raise ValueError("the packing plan is larger than the bound for a broadcast")
    return np.array(sorted(lines), np.int64).reshape(-1, 5)


def pieces(
    df: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_PATH,
    separator: int = 0, keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, task_ and place_ (for ranks), and ``ids`` if asked for."""
    id_type = df.schema[id_col].dataType
    fields = [(id_col, id_type), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()),
              ("ids_crc32", T.LongType()), ("task_", T.LongType()), ("place_", T.LongType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, placed, task = encoder(path), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            rows, parts, kept = [], [], []
            for at, text in enumerate(batch["text"].to_pylist()):
                ids = np.append(encode.ids(text or ""), np.uint32(separator)).astype("<u4", copy=False)
                for number, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    rows.append(at)
                    parts.append((number, start, length, zlib.crc32(part.tobytes()), task, placed[length]))
                    placed[length] += 1
                    if keep_ids:
                        kept.append(part.astype(np.int32))
            table = np.array(parts, np.int64).reshape(-1, 6)
            columns = [batch["id"].take(pa.array(rows, pa.int64())), pa.array(table[:, 0].astype(np.int32)), *(pa.array(table[:, k].copy()) for k in range(1, 6))]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, schema.names)
            del rows, parts, kept, table, columns
            release_memory()

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(make, schema)


def pack(df: DataFrame, capacity: int = 2048, **options) -> DataFrame:
    """The pieces of ``pieces`` with ``sequence_id`` (from 0, without gaps) and ``offset`` in the sequence, gapless from 0.

    A null or empty text is one piece that holds the separator alone. Equal rows are packed each for itself; a null id stays null.
    Other columns of ``df`` are not read. An empty table gives no rows.
    """
    cut_up = stored(pieces(df, capacity, **options), "pieces")
    counts = stored(cut_up.groupBy("task_", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    lines = _plan_lines(plan(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("task_").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task_", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before_"))
    ranked = cut_up.join(stored(before, "ranks"), ["task_", "length"]).withColumn("rank_", F.col("before_") + F.col("place_"))
    kept = [c for c in cut_up.columns if c not in ("task_", "place_")]
    schema = T.StructType([*(ranked.schema[c] for c in kept), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    first_rank = lines[:, 0] * (1 << 44) + lines[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "rank_"))
            _, start, copies, sequence, offset = lines[np.searchsorted(first_rank, length * (1 << 44) + rank, "right") - 1].T
            columns = [batch[c] for c in kept]
            columns += [pa.array(sequence + (rank - start) // copies), pa.array(offset + (rank - start) % copies * length)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` of pieces packed with ``keep_ids=True``; a group is bounded by the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
