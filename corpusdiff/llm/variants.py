"""Spelling variants: words of a corpus that differ by one inserted, deleted or replaced character, grouped under the more frequent form.

1. Words and their counts: built-in expressions and one partial aggregate. The vocabulary is written, partitioned by word length.
2. Its words fill blocked Bloom filters, one per length: a word sets some bits of one 64-bit block. Blocks are joined by ``bit_or`` in Spark.
3. Each word generates its edits and probes the filter of their length: one character left out, or one replaced by a later one of the alphabet (every pair of words
   is thus met from one side only, an insertion being the other side's deletion). Edits are never built as strings: their polynomial hashes follow from those
   of the word's parts, all edits of a word at once.
4. Only positives become strings. They are shuffled to an exact join with the vocabulary, which removes the false ones.
5. A word's form is its most frequent near word, if that is frequent enough; roots follow by doubling the forms' steps in rounds of joins.

The filters are all that is broadcast. One pass takes filters of at most ``filter_bytes``; a vocabulary with larger ones is probed in several passes, by length, and a
length that alone is larger in shares of its words by hash. So every word is probed against every filter, whatever the size of the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusdiff.llm.common import discard, lower_ascii, slices, stored

#: A run of Latin letters, and how often (one in so many, by checksum) the rule of the workload spoils an occurrence.
RUN = r"[A-Za-zÀ-ÿ]+"
SPOILED = 97
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BITS_PER_WORD, PROBES = 20, 5
#: Hashes of edits that a task holds at once.
AT_ONCE = 1 << 19
#: Words whose edits one task probes.
TASK_WORDS = 50_000


def runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({RUN})"), F.lit(1))


def spoiled(doc_id: Column, run: Column) -> Column:
    """The run, without one of its characters where the checksum of id and run says so; a null id counts as empty."""
    check = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (check % F.length(run)).cast("int")
    return F.when(check % SPOILED == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(df: DataFrame, least_length: int = 5, least_count: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n, length)`` of the words of all whole texts that are long and frequent enough."""
    found = df.select(F.col(id_col).alias("id"), F.explode(runs(F.col(text_col))).alias("run"))
    words = found.select(spoiled(F.col("id"), lower_ascii(F.col("run"))).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count).withColumn("length", F.length("word"))


def hash_parts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words as rows of code points: hashes of all beginnings (one more than letters), and the powers of the base. The hash of a word is the sum of code times power."""
    powers = np.cumprod(np.append(np.uint64(1), np.full(codes.shape[1], BASE)), dtype=np.uint64)
    terms = codes.astype(np.uint64) * powers[:-1]
    return np.concatenate([np.zeros((len(codes), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1), powers


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Hashes whose bits depend on all bits of the given ones."""
    h = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def block_and_mask(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each mixed hash, and the bits it sets there."""
    block = ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    mask = np.zeros(hashes.shape, np.uint64)
    for k in range(PROBES):
        mask |= np.uint64(1) << ((hashes >> np.uint64(6 * k)) & np.uint64(63))
    return block.astype(np.int64), mask


@dataclass(frozen=True)
class Shard:
    """A filter: the words of a length whose hash leaves ``part`` modulo ``parts``."""

    length: int
    parts: int
    part: int
    blocks: int


def plan(counts: dict[int, int], filter_bytes: int) -> list[list[Shard]]:
    """Shards, gathered into passes whose filters together take at most ``filter_bytes``."""
    passes: list[list[Shard]] = []
    free = 0
    for length, n in sorted(counts.items()):
        parts = max(1, -(-n * BITS_PER_WORD // (8 * filter_bytes)))
        blocks = max(1, min(filter_bytes // 8, -(-n * BITS_PER_WORD // (64 * parts))))
        for part in range(parts):
            if not passes or free < 8 * blocks:
                passes.append([])
                free = filter_bytes
            passes[-1].append(Shard(length, parts, part, blocks))
            free -= 8 * blocks
    return passes


def _part_of(mixed_hashes: np.ndarray, parts: int) -> np.ndarray:
    return (mixed_hashes >> np.uint64(11)) % np.uint64(parts)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """Length, row numbers, and code points of the words of a batch, in blocks of bounded size."""
    length = batch["length"].to_numpy()
    order = np.argsort(length, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
        if len(rows):
            words = batch["word"].take(pa.array(rows)).to_pylist()
            size = int(length[rows[0]])
            each = max(1, AT_ONCE // size)
            for i in range(0, len(rows), each):
                codes = np.frombuffer("".join(words[i : i + each]).encode("utf-32-le"), np.uint32).reshape(-1, size)
                yield size, rows[i : i + each].tolist(), codes


def _filters(vocab: DataFrame, shards: list[Shard]) -> dict[Shard, np.ndarray]:
    """The filled filters; only their blocks, of a bounded number, go to the driver."""
    of = {}
    for number, shard in enumerate(shards):
        of.setdefault(shard.length, []).append((number, shard))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, codes in _by_length(batch):
                hashes = mixed(hash_parts(codes)[0][:, -1])
                for number, shard in of[length]:
                    own = hashes[_part_of(hashes, shard.parts) == shard.part]
                    block, mask = block_and_mask(own, shard.blocks)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), number)), pa.array(block), pa.array(mask.view(np.int64))], ["shard", "block", "mask"])

    words = vocab.filter(F.col("length").isin(list(of))).select("word", "length")
    bits = words.mapInArrow(run, "shard long, block long, mask long").groupBy("shard", "block").agg(F.bit_or("mask").alias("mask"))
    table = bits.toArrow()
    shard, block, mask = (table[c].to_numpy() for c in ("shard", "block", "mask"))
    found = {}
    for number, s in enumerate(shards):
        found[s] = np.zeros(s.blocks, np.uint64)
        own = shard == number
        found[s][block[own]] = mask[own].view(np.uint64)
    return found


def _positive(hashes: np.ndarray, filters: list[tuple[Shard, np.ndarray]]) -> np.ndarray:
    """Which hashes of edits a filter may hold."""
    hashes = mixed(hashes)
    out = np.zeros(hashes.shape, bool)
    for shard, table in filters:
        block, mask = block_and_mask(hashes, shard.blocks)
        hit = (table[block] & mask) == mask
        out |= hit if shard.parts == 1 else hit & (_part_of(hashes, shard.parts) == shard.part)
    return out


def edits(codes: np.ndarray, alphabet: np.ndarray, filters: dict[int, list[tuple[Shard, np.ndarray]]]) -> Iterator[tuple[int, str]]:
    """``(row, edit)`` for the edits of equally long words that the filters may hold. Of equal deletions, those in a run of one letter, there is one."""
    size = codes.shape[1]
    ahead, powers = hash_parts(codes)
    whole = ahead[:, -1]

    def found(rows: np.ndarray, places: np.ndarray, letters: np.ndarray | None) -> Iterator[tuple[int, str]]:
        for k, (row, at) in enumerate(zip(rows.tolist(), places.tolist())):
            word = codes[row].tobytes().decode("utf-32-le")
            yield row, word[:at] + (chr(letters[k]) if letters is not None else "") + word[at + 1 :]

    if size - 1 in filters:
        without = ahead[:, :-1] + (whole[:, None] - ahead[:, 1:]) * BASE_INVERSE
        new = np.ones(codes.shape, bool)
        new[:, 1:] = codes[:, 1:] != codes[:, :-1]
        rows, places = np.nonzero(new)
        hit = _positive(without[rows, places], filters[size - 1])
        yield from found(rows[hit], places[hit], None)
    if size in filters:
        for letter in alphabet.tolist():
            rows, places = np.nonzero(codes < letter)
            old = codes[rows, places].astype(np.uint64)
            hit = _positive(whole[rows] + (np.uint64(letter) - old) * powers[places], filters[size])
            yield from found(rows[hit], places[hit], np.full(int(hit.sum()), letter))


def _probed(vocab: DataFrame, shards: list[Shard], alphabet: np.ndarray, words: int) -> DataFrame:
    """``(word, n, edit)`` that the filters of one pass let through, written; ``words`` is how many words there are."""
    spark = vocab.sparkSession
    filters: dict[int, list[tuple[Shard, np.ndarray]]] = {}
    for shard, table in _filters(vocab, shards).items():
        filters.setdefault(shard.length, []).append((shard, table))
    sent = spark.sparkContext.broadcast(filters)
    lengths = sorted({x for length in filters for x in (length, length + 1)})
    names = ["word", "n", "edit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, numbers, codes in _by_length(batch):
                at, made = [], []
                for row, edit in edits(codes, alphabet, sent.value):
                    at.append(numbers[row])
                    made.append(edit)
                    if len(at) >= 100_000:
                        yield pa.RecordBatch.from_arrays([batch["word"].take(pa.array(at)), batch["n"].take(pa.array(at)), pa.array(made)], names)
                        at, made = [], []
                if at:
                    yield pa.RecordBatch.from_arrays([batch["word"].take(pa.array(at)), batch["n"].take(pa.array(at)), pa.array(made)], names)

    own = vocab.filter(F.col("length").isin(lengths)).repartition(slices(spark, words, TASK_WORDS))
    found = stored(own.mapInArrow(run, "word string, n long, edit string"), "edits")
    sent.unpersist()
    return found


def near_words(vocab: DataFrame, filter_bytes: int = 32 << 20) -> DataFrame:
    """``(word, n, other, other_n)`` for every pair of words that differ by one character, once and in either order.

    ``vocab`` is a written table of word, n, length with distinct words.
    """
    counts = {r["length"]: r["n"] for r in vocab.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row per word length
    letters = vocab.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").distinct().collect()  # at most the letters of RUN
    alphabet = np.array(sorted(ord(r["c"]) for r in letters), np.uint32)
    found = vocab.sparkSession.createDataFrame([], "word string, n long, edit string")
    for shards in plan(counts, filter_bytes):
        words = sum(counts.get(x, 0) for x in {y for s in shards for y in (s.length, s.length + 1)})
        found = found.unionAll(_probed(vocab, shards, alphabet, words))
    known = vocab.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    return found.withColumnRenamed("edit", "other").join(known, "other").select("word", "n", "other", "other_n")


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of words with a form: forms followed to their end. Every round doubles the steps taken."""
    reached = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next_"))
        longer = stored(reached.join(further, "root", "left").select("word", F.coalesce("next_", "root").alias("root"), F.col("next_").isNotNull().alias("moved_")), "roots")
        discard(reached)
        if longer.filter("moved_").isEmpty():
            return longer.select("word", "root")
        reached = longer


def variants(
    df: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2, filter_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per word of the corpus: word, form, root, n, n_near, form_n.

    Words are the runs of Latin letters of all whole texts, with A-Z in lower case and one in 97 occurrences spoiled as ``spoiled`` says, of at least ``least_length`` characters
    that occur at least ``least_count`` times. ``n_near`` counts the near words; ``form`` is that with the largest ``n`` (of equal ones the first in code-point order) if its ``n`` is at least
    ``ratio`` times the word's, else null, ``form_n`` its ``n``. ``root`` is reached from the word by following forms, the word itself without one. A null or empty text has no words,
    repeated rows count as often as they occur, other columns are not read, and an empty table gives no rows.
    """
    vocab = stored(vocabulary(df, least_length, least_count, id_col, text_col).sortWithinPartitions("length"), "vocabulary")
    links = near_words(vocab, filter_bytes)
    sides = F.array(
        F.struct("word", F.col("other").alias("near"), F.col("other_n").alias("near_n")),
        F.struct(F.col("other").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )
    both = links.select(F.inline(sides))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("other"))).alias("best"))
    frequent = -F.col("best.less") >= ratio * F.col("n")
    formed = stored(
        vocab.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(frequent, F.col("best.other")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
