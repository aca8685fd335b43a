"""SimHash near-duplicates with a Gray-order hierarchical index.

1. Each text becomes a 64-bit fingerprint of its word shingles (a Python function over Arrow batches, nothing is shuffled).
2. Equal fingerprints are one entry: a partial aggregate, so a text with millions of copies is one row afterwards.
3. Two fingerprints at no more than ``max_bits`` = 3 differing bits agree in at least one of four 16-bit bands. Entries are dealt by (band, its
   value) over partitions sized by their number. A band value with more than ``tile`` entries is cut into tiles and the
   pairs of its tiles are dealt, so no task holds an unbounded group.
4. In each partition the index is built: entries sorted by Gray rank, leaves of consecutive entries, upper nodes over runs of leaves; a node
   keeps the bits that all its entries share. Pairs of nodes are walked from the roots; a pair whose shared bits already differ in
   more than ``max_bits`` is pruned with everything below it.
5. Each partition sends the links of a spanning forest, at most one per entry, and the components are joined in rounds.

Every pair within ``max_bits`` ends in the same component; none beyond it is ever linked. ``similar_components`` uses the same index for fingerprints of 256 bits,
only to find candidates: bands are MinHash keys, and the exact shingle similarity of the candidates decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusdiff.llm.common import discard, maybe_among, release_memory, slices, stored
from corpusdiff.llm.components import connected_components
from corpusdiff.llm.nn_descent import _by_group

SEED = 42
BAND_BITS = 16
WIDE = 4
KEYS, KEY_HASHES = 28, 6
LEAF, FAN = 8, 8
PAIRS_AT_ONCE = 1 << 18
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The fingerprint of one text as an unsigned number: bit i is 1 if it is set in over half of the shingles' hashes.

    Lower-cases A-Z only, splits at the ASCII white space, keeps repeated shingles. A text of fewer words than ``width`` is one
    shingle; a null text or one without words has fingerprint 0.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(starts, (ends[width - 1 :] - 1).tolist())], np.uint64)
    places = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(places[:, k], minlength=256) @ _BITS for k in range(8)])
    bits = 2 * ones > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column, width: int = 3) -> Column:
    """``fingerprint`` as a long column (the same 64 bits, signed)."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return of(text)


def gray_rank(values: np.ndarray) -> np.ndarray:
    """The place of each 64-bit value in the Gray sequence."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchical index over entries in several groups; only entries of one group are compared."""

    def __init__(self, group: np.ndarray, values: np.ndarray):
        """``values``: a 64-bit number per entry, or a row of them."""
        first = values if values.ndim == 1 else values[:, 0]
        self.order = np.lexsort((gray_rank(first), group))
        self.values = values[self.order]
        group = group[self.order]
        rows = self.values.reshape(len(values), -1)
        heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        sizes = np.diff(np.concatenate((heads, [len(group)])))
        # levels[0] are the entries themselves; a level: first child of each node, all and any of its bits
        self.levels = [(np.arange(len(group) + 1), rows, rows)]
        step = LEAF
        while True:
            counts = -(-sizes // step)
            first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            starts = np.repeat(first, counts) + step * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
            _, every, some = self.levels[-1]
            self.levels.append(
                (np.concatenate((starts, [len(every)])), np.bitwise_and.reduceat(every, starts, axis=0), np.bitwise_or.reduceat(some, starts, axis=0))
            )
            sizes = counts
            if (counts == 1).all():
                break
            step = FAN

    def pairs(self, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places (in sorted order) whose values differ in at most ``max_bits`` bits, in parts of bounded size."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][1]))
        stack = [(top, roots, roots)]
        while stack:
            level, left, right = stack.pop()
            if level == 0:
                yield left, right
                continue
            child, _, _ = self.levels[level]
            n_left, n_right = child[left + 1] - child[left], child[right + 1] - child[right]
            made = np.cumsum(n_left * n_right)
            if made[-1] > PAIRS_AT_ONCE and len(left) > 1:
                half = max(1, min(len(left) - 1, int(np.searchsorted(made, made[-1] // 2))))
                stack += [(level, left[half:], right[half:]), (level, left[:half], right[:half])]
                continue
            each = np.repeat(np.arange(len(left)), n_left * n_right)
            inside = np.arange(made[-1]) - np.repeat(made - n_left * n_right, n_left * n_right)
            a, b = child[left][each] + inside // n_right[each], child[right][each] + inside % n_right[each]
            _, every, some = self.levels[level - 1]
            # a bit is shared in a node if all or none of its entries have it; differences of shared bits are a lower bound
            apart = (every[a] & ~some[b]) | (every[b] & ~some[a])
            keep = (np.bitwise_count(apart).sum(axis=1) <= max_bits) & ((a < b) if level == 1 else (a <= b))
            if keep.any():
                stack.append((level - 1, a[keep], b[keep]))


def _join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` after the links between ``a`` and ``b``: equal labels, the smallest ones, for all that hang together."""
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for side in (a, b):
            np.minimum.at(label, side, low)
            np.minimum.at(label, before[side], low)
        while (label[label] != label).any():
            label = label[label]
        if (label[a] == label[b]).all():
            return label


def forest(group: np.ndarray, values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest over all pairs within ``max_bits`` inside the groups: places of entries and of their roots."""
    index = GrayIndex(group, values)
    label = np.arange(len(values))
    for a, b in index.pairs(max_bits):
        label = _join_labels(label, a, b)
    linked = np.flatnonzero(label != np.arange(len(values)))
    return index.order[linked], index.order[label[linked]]


def _band_rows(entries: DataFrame, band_bits: int, n_words: int, tile: int) -> DataFrame:
    """Every entry under each of its bands (its ``keys``, if it has that column), entries of large bands under each pair of their tile with another."""
    per_word = 64 // band_bits
    mask = (1 << band_bits) - 1
    bands = [
        F.shiftrightunsigned(F.get("w", F.lit(word)), band_bits * k).bitwiseAND(F.lit(mask)) + (word * per_word + k) * (mask + 1)
        for word in range(n_words) for k in range(per_word)
    ]
    rows = entries.select("node", "w", F.explode("keys" if "keys" in entries.columns else F.array(*bands)).alias("band"))
    large = stored(rows.groupBy("band").count().filter(F.col("count") > tile).withColumn("tiles", F.ceil(F.col("count") / tile)), "bands")
    if large.isEmpty():
        return rows.select("band", F.lit(0).cast("long").alias("pair"), "node", "w")
    sized = rows.join(large.select("band", "tiles"), "band", "left")
    tiles = F.coalesce(F.col("tiles"), F.lit(1)).cast("long")
    own = F.pmod(F.xxhash64("node"), tiles)
    return sized.select("band", "node", "w", tiles.alias("tiles"), own.alias("own")).select(
        "band", "node", "w",
        F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda other: (
            F.least(other, F.col("own")) * F.col("tiles") + F.greatest(other, F.col("own"))
        ))).alias("pair"),
    ).select("band", "pair", "node", "w")


def fingerprint_links(
    entries: DataFrame, max_bits: int = 3, band_bits: int = 16, n_words: int = 1, tile: int = 20_000, rows_per_task: int = 100_000
) -> DataFrame:
    """Links ``(a, b)`` between nodes whose components are those of all pairs within ``max_bits`` that agree in a band.

    ``entries``: ``node`` and ``w``, an array of ``n_words`` 64-bit numbers; an array ``keys``, if there, replaces the bands. If there are more bands than ``max_bits``, every pair within ``max_bits`` agrees in one.
    """
    dealt = _band_rows(entries, band_bits, n_words, tile)
    amount = entries.count() * (64 // band_bits) * n_words
    parts = slices(entries.sparkSession, amount, rows_per_task, entries.sparkSession.sparkContext.defaultParallelism)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b["band"].to_numpy(), b["pair"].to_numpy(), b["node"].to_numpy(), b["w"].flatten().to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        band, pair, node, words = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((pair, band))
        band, pair, node, words = band[order], pair[order], node[order], words.reshape(len(node), -1)[order]
        group = np.cumsum(np.concatenate(([False], (band[1:] != band[:-1]) | (pair[1:] != pair[:-1]))))
        a, b = forest(group, words.view(np.uint64), max_bits)
        release_memory()
        yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    return dealt.repartition(parts, "band", "pair").mapInArrow(search, "a long, b long").distinct()


def _components(prints: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``prints`` (``id``, ``fp``) with ``component_id``; ``links`` makes links between the distinct fingerprints ``fp``."""
    entries = stored(prints.groupBy("fp").agg(F.min("id").alias("first")).withColumn("node", F.monotonically_increasing_id()), "entries")
    return _named(prints, entries, connected_components(links(entries)), "fp")


def _named(prints: DataFrame, entries: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """``prints`` with the smallest id of their component; ``entries`` are the distinct values of ``key``, ``parts`` the components of those that have links."""
    linked = stored(parts.join(entries, "node"), "linked")
    roots = stored(linked.groupBy("component").agg(F.min("first").alias("root")), "roots")
    placed = linked.join(roots, "component").select("node", "root")
    named = stored(entries.join(placed, "node", "left").select(key, F.coalesce("root", "first").alias("component_id")), "named")
    discard(linked, roots)
    return prints.join(named, key)


def simhash_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 3, tile: int = 20_000
) -> DataFrame:
    """``(id_col, fp, component_id)`` per row of ``df``: the fingerprint and the smallest id reachable by links.

    Null texts and texts without words have fingerprint 0 and link like any other. Repeated rows give repeated rows. A null id
    keeps its row and never names a component unless all ids of the component are null. Other columns of ``df`` are not read.
    """
    if not 0 <= max_bits < 64 // BAND_BITS:
        raise ValueError("max_bits must be below the number of bands")
    prints = stored(df.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), width).alias("fp")), "fingerprints")
    found = _components(prints, lambda e: fingerprint_links(e.select("node", F.array("fp").alias("w")), max_bits, BAND_BITS, 1, tile))
    return found.select(F.col("id").alias(id_col), "fp", "component_id")


def _digests(text: str | None, width: int) -> np.ndarray:
    """Two seeded 128-bit hashes, a row of ``8 * WIDE`` bytes, of each distinct shingle; the first 64 bits name the shingle."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros((0, 8 * WIDE), np.uint8)
    joined = b" ".join(found)
    starts, ends = [0], [len(joined)]
    if len(found) > width:
        after = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts, ends = np.concatenate(([0], after[:-width])).tolist(), (after[width - 1 :] - 1).tolist()
    digest = xxhash.xxh3_128_digest
    distinct = {joined[i:j] for i, j in zip(starts, ends)}
    return np.frombuffer(b"".join([digest(x, seed) for x in distinct for seed in (SEED, SEED + 1)]), np.uint8).reshape(len(distinct), 8 * WIDE)


def _shingles(digests: np.ndarray) -> np.ndarray:
    return np.sort(np.ascontiguousarray(digests[:, :8]).view(np.uint64).ravel())


def _wide(digests: np.ndarray) -> np.ndarray:
    if not len(digests):
        return np.zeros(WIDE, np.uint64)
    ones = np.concatenate([np.bincount(digests[:, k], minlength=256) @ _BITS for k in range(8 * WIDE)])
    return np.packbits(2 * ones > len(digests), bitorder="little").view(np.uint64)


def wide_fingerprint(text: str | None, width: int = 5) -> np.ndarray:
    """Like ``fingerprint``, of ``WIDE`` 64-bit numbers, from two seeded 128-bit hashes of each distinct shingle."""
    return _wide(_digests(text, width))


_FLIP, _FACTOR = np.random.default_rng(SEED).integers(0, 1 << 64, (2, KEYS * KEY_HASHES), np.uint64, endpoint=False)
_FACTOR |= np.uint64(1)


def minhash_keys(shingles: np.ndarray) -> np.ndarray:
    """``KEYS`` numbers, each from ``KEY_HASHES`` MinHash values: sets of similarity s have a given key in common with probability ``s ** KEY_HASHES``."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    least = np.full(KEYS * KEY_HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 256):
        np.minimum(least, ((shingles[k : k + 256, None] ^ _FLIP) * _FACTOR).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(KEYS, KEY_HASHES))], np.uint64)


def _verified_links(members: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs of at least ``similarity`` inside the candidate components.

    ``members``: component, node, key, n (number of shingles); ``texts``: key, text. A component is cut into tiles by entries and by shingles, and pairs of tiles are
    dealt over tasks; in each the common shingles of all pairs are counted, and the links of a spanning forest are sent.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("all"))
    tiles = F.greatest(F.ceil(F.col("m") / 1024), F.ceil(F.col("all") / 400_000)).cast("long")
    sizes = stored(sizes.select("component", tiles.alias("tiles")), "component-sizes")
    placed = stored(members.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles"))), "placed")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_shingles(_digests(t, width)).view(np.int64) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("component", "node", "tiles", "own")), pa.array(sets, pa.list_(pa.int64()))], ["component", "node", "tiles", "own", "s"]
            )
            del sets
            release_memory()

    near = maybe_among(texts, F.col("key"), placed.select("key"), "near_").filter("near_").drop("near_")
    sets = near.join(placed, "key").select("component", "node", "tiles", "own", "text")
    sets = sets.mapInArrow(shingle, "component long, node long, tiles long, own long, s array<long>")
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda o: F.struct(F.least(o, "own").alias("a"), F.greatest(o, "own").alias("b")))
    dealt = sets.withColumn("pair", F.explode(every)).select(
        F.xxhash64("component", "pair.a", "pair.b").alias("task"), "component", "own", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), "node", "s"
    )

    def compare(t: pa.Table) -> list[np.ndarray]:
        node, first = np.unique(t["node"].to_numpy(), return_index=True)
        t = t.take(pa.array(first)).combine_chunks()
        own, a, b = (t[c].to_numpy() for c in ("own", "a", "b"))
        column = t["s"].combine_chunks()
        size = np.diff(column.offsets.to_numpy())
        _, at, times = np.unique(column.flatten().to_numpy(), return_inverse=True, return_counts=True)
        common = times[at] > 1
        owner, at = np.repeat(np.arange(len(node)), size)[common], (np.cumsum(times > 1) - 1)[at[common]]
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
        both = np.zeros((len(left), len(right)), np.float32)
        step = 4096
        for low in range(0, int(at[-1]) + 1 if len(at) else 0, step):
            part = slice(*np.searchsorted(at, (low, low + step)))
            has = np.zeros((len(node), step), np.float32)
            has[owner[part], at[part] - low] = 1
            both += has[left] @ has[right].T
        linked = both / (size[left][:, None] + size[right][None, :] - both.astype(np.float64)) >= similarity
        x, y = np.nonzero(linked)
        del both, linked
        release_memory()
        label = _join_labels(np.arange(len(node)), left[x], right[y])
        moved = np.flatnonzero(label != np.arange(len(node)))
        return [node[moved], node[label[moved]]]

    return _by_group(dealt, "task", compare, "a long, b long")


def similar_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, max_bits: int = 76, tile: int = 20_000
) -> DataFrame:
    """``(id_col, component_id)`` per row of ``df``: texts hang together by pairs whose distinct shingles of ``width`` words have a Jaccard similarity of ``similarity`` or more.

    Texts of equal shingle sets are one entry. Entries that have one of 28 keys of six MinHash values in common and differ in at most ``max_bits`` of 256 bits are candidates,
    found by the Gray index. At a similarity of 0.8 a pair has a key in common with probability 1 - (1 - 0.8 ** 6) ** 28 = 0.9998 and differs in 39 bits, give or take 6 (48 at most,
    for sets of four and five); neither depends on the number of documents. Inside the components of the candidates all pairs are compared by their exact similarity, and only
    that decides. Nulls, empty texts and repeated rows as in ``simhash_components``; texts without words are equal.
    """

    @F.pandas_udf("same binary, n long, w array<long>, keys array<long>")
    def described(texts: pd.Series) -> pd.DataFrame:
        made = []
        for text in texts:
            digests = _digests(text, width)
            shingles = _shingles(digests)
            made.append((xxhash.xxh3_128_digest(shingles.tobytes()), len(shingles), _wide(digests).view(np.int64), minhash_keys(shingles).view(np.int64)))
        release_memory()
        return pd.DataFrame(made, columns=["same", "n", "w", "keys"])

    key = F.unhex(F.md5(F.concat_ws("|", F.to_json(F.struct("id")), "text")))
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", key.alias("key"), "text")
    prints = stored(texts.select("id", "key", described("text").alias("d")).select("id", "key", "d.*"), "fingerprints")
    entries = prints.groupBy("same").agg(F.min("id").alias("first"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("w").alias("w"), F.first("keys").alias("keys"))
    entries = stored(entries.withColumn("node", F.monotonically_increasing_id()), "entries")
    near = connected_components(fingerprint_links(entries.select("node", "w", "keys"), max_bits, 64 * WIDE // KEYS, WIDE, tile))
    members = stored(near.join(entries.select("node", "key", "n"), "node"), "candidates")
    links = _verified_links(members, texts.select("key", "text"), width, similarity)
    found = _named(prints.select("id", "same"), entries, connected_components(links), "same")
    discard(members, entries)
    return found.select(F.col("id").alias(id_col), "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
