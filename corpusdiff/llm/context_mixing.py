"""Language-model scoring by logistic context mixing.

The model reads the bytes of a lower-cased text and one end byte. A byte is a path of binary decisions in a code tree. For each decision several predictors, keyed by
the hash of the last 1 to 5 bytes, give a probability from how often the trained texts took either branch in that context. Their logits are
combined with weights chosen by a gate: how many contexts are known, how often the longest known one was seen, and the depth in the tree. Several
mixers differ in how far they trust short and long contexts; while a text is read, each mixer's share is refined after every byte by Bayes' rule. (The product of these
mixtures over a text is the mean of the mixers' probabilities of the whole text, which is how it is computed.) The bits of a text are the sum over its
decisions, so scores are log-probabilities of a proper model.

How the corpus is gathered, at any size:

1. Texts are dealt into blocks of about ``block_bytes``. A block reduces its texts to its distinct grams (a byte and the five before it) with counts in trained texts, and these to its
   distinct contexts, the bytes that follow them, and their counts; likewise its distinct words (64-bit hashes).
2. These lists are dealt over shards by hash. A shard sums the counts of all blocks and answers each block with the totals of the contexts that
   block asked for. A context that every block has is one entry per block, so no key is hot and no task holds the model as a whole.
3. The texts meet the grams and the answers of their block and are scored; the grams are looked up, not gathered again. Nothing that grows with the corpus is broadcast.

Weights are fitted by Newton steps on the trained texts of every block, which its grams with their counts stand for, so that texts are not read again; there the block's own counts are taken off the totals. The weights of the blocks are averaged by the
decisions behind them, in Spark; only the mean, a fixed number of weights, goes through the driver.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusdiff.llm.common import slices, stored

ORDERS = 5
DELTA = np.float32(0.1)
CONFIDENCE = (2, 4, 16)  # bounds of the gate's classes of counts
GATES = (ORDERS + 1) * (len(CONFIDENCE) + 1) * 2
GAINS = np.array([(1, 1), (1.1, 1.1), (1.15, 1), (1, 1.15)], np.float32)  # of short and of long contexts, by mixer
SHORT = 3  # orders that count as short
PART_BYTES = 1 << 20
PAIRS_AT_ONCE = 1 << 16
TABLED_AT_ONCE = 1 << 14  # each may have a row of up to 257 counts
SPREAD = 3  # partitions per block, so that few hold several
U = np.uint64
_MIX, _GOLD = U(0xBF58476D1CE4E5B9), U(0x9E3779B97F4A7C15)
_RANDOM = np.random.default_rng(99).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BASE = 0x5851F42D4C957F2D
_IN_WORD = bytes(b not in (9, 10, 11, 12, 13, 32) for b in range(256))


def code_tree(histogram: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """A binary code tree over all bytes. Returns each byte's leaf place, and its path as rows (first leaf, leaf after the last) from the root down."""
    total = max(int(histogram.sum()), 1)
    heap = [(int(n) + total // 20_000 + 1, b, (b,)) for b, n in enumerate(histogram.tolist())]
    heapq.heapify(heap)
    kids: dict[tuple, tuple] = {}
    while len(heap) > 1:
        n, tie, left = heapq.heappop(heap)
        m, other, right = heapq.heappop(heap)
        kids[left + right] = (left, right)
        heapq.heappush(heap, (n + m, min(tie, other), left + right))
    leaves, paths = np.zeros(256, np.int64), [None] * 256
    stack = [(heap[0][2], 0, [(0, 256)])]
    while stack:
        node, first, path = stack.pop()
        if len(node) == 1:
            leaves[node[0]], paths[node[0]] = first, np.array(path, np.int64)
            continue
        left, right = kids[node]
        middle, last = first + len(left), first + len(node)
        stack.append((left, first, [*path, (first, middle)]))
        stack.append((right, middle, [*path, (middle, last)]))
    return leaves, paths


def _powers(n: int, base: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * _MIX
    return h ^ (h >> U(29))


class Part:
    """Some texts, trained ones first, each after five zero bytes, as one byte array."""

    def __init__(self, texts: list[bytes], trained: int, powers: tuple[np.ndarray, np.ndarray]):
        gap = b"\0" * ORDERS
        self.data = gap + gap.join(texts) + gap
        self.bytes = np.frombuffer(self.data, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.lengths = sizes + 1  # with the end byte
        self.starts = np.cumsum(sizes + ORDERS) - sizes
        self.ends = self.starts + sizes
        self.trained = int(self.lengths[:trained].sum())
        self.powers = powers

    def grams(self) -> np.ndarray:
        """The last five bytes and the byte of every position, as one number, text after text."""
        two = self.bytes.astype(np.uint16)
        two = two[1:] | two[:-1] << np.uint16(8)  # a byte and the one before it
        four = two.astype(np.uint32)
        four = four[2:] | four[:-2] << np.uint32(16)
        n = len(self.bytes) - ORDERS
        packed = two[:n].astype(np.uint64) << U(32) | four[2:]
        scored = np.ones(n, bool)
        for k in range(1, ORDERS):
            scored[self.ends[:-1] - ORDERS + k] = False  # of the zero bytes after a text only the first, its end, is scored
        scored[self.ends[-1] - ORDERS + 1 :] = False
        return packed[scored]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Token keys (last bit 1) and the text of each: words, then the end of each text."""
        inside = np.frombuffer(bytearray(self.data.translate(_IN_WORD)), bool)
        inside[: ORDERS] = False
        for k in range(ORDERS):
            inside[np.minimum(self.ends + k, len(inside) - 1)] = False
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        start, end = edges[::2], edges[1::2]
        up, down = self.powers
        sums = np.empty(len(self.bytes) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_RANDOM[self.bytes] * up[: len(self.bytes)], out=sums[1:])
        keys = _mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _GOLD)
        owner = np.repeat(np.arange(len(self.ends)), np.diff(np.searchsorted(start, self.ends), prepend=0))
        return np.concatenate((keys, np.zeros(len(self.ends), np.uint64))) | U(1), np.concatenate((owner, np.arange(len(self.ends))))


def _in_runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of some values in order its place among the distinct ones, and these."""
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    return np.cumsum(first) - 1, values[first]


def _order(values: np.ndarray) -> np.ndarray:
    """Order of numbers from 0 on, equal ones as they come. Where a number and its place fit 64 bits, a plain sort does."""
    if not len(values) or values.max() >> 32 or len(values) >> 32:
        return np.argsort(values, kind="stable")
    both = np.sort(values.astype(np.uint64) << U(32) | np.arange(len(values), dtype=np.uint64))
    return (both & U(0xFFFFFFFF)).view(np.int64)


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    values = np.sort(values)
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return values[at], np.diff(np.concatenate((at, [len(values)])))


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of some values of at most 48 bits its place among the distinct ones, and these in order. Places inside a piece fit the free bits, so that plain sorts do."""
    pieces = []
    for i in range(0, len(values), 1 << 16):
        own = values[i : i + (1 << 16)]
        both = np.sort(own << U(16) | np.arange(len(own), dtype=np.uint64))
        value, number = both >> U(16), np.empty(len(own), np.int32)
        first = np.concatenate(([True], value[1:] != value[:-1]))
        number[(both & U(0xFFFF)).astype(np.int64)] = np.cumsum(first, dtype=np.int32) - 1
        pieces.append((value[first], number))
    values = np.concatenate([value for value, _ in pieces])
    order = np.argsort(values, kind="stable")  # merges runs that are in order
    values, place = values[order], np.empty(len(values), np.int32)
    first = np.concatenate(([True], values[1:] != values[:-1]))
    place[order] = np.cumsum(first, dtype=np.int32) - 1
    parts = np.split(place, np.cumsum([len(value) for value, _ in pieces])[:-1])
    return np.concatenate([part[number] for part, (_, number) in zip(parts, pieces)]), values[first]


class _Places:
    """Finds the places of values in a list of distinct ones in order, by two tables of hashes; what neither table holds is searched for."""

    def __init__(self, values: np.ndarray):
        self.values, self.tables, left = values, [], np.arange(len(values), dtype=np.int32)
        for factor in (_GOLD, _MIX):
            shift = U(64 - max(3, int(len(left)).bit_length() + 2))
            table = np.zeros(1 << (64 - int(shift)), np.int32)
            at = (values[left] * factor >> shift).astype(np.int64)
            table[at] = left
            self.tables.append((factor, shift, table))
            left = left[table[at] != left]

    def of(self, values: np.ndarray) -> np.ndarray:
        """The place of each of some values, all of which are in the list."""
        place = self._looked_up(0, values)
        for k in range(1, len(self.tables) + 1):
            left = np.flatnonzero(self.values.take(place) != values) if k == 1 else left[self.values.take(place[left]) != rest]
            if not len(left):
                break
            rest = values[left]
            place[left] = self._looked_up(k, rest) if k < len(self.tables) else np.searchsorted(self.values, rest)
        return place

    def _looked_up(self, k: int, values: np.ndarray) -> np.ndarray:
        factor, shift, table = self.tables[k]
        return table.take((values * factor >> shift).view(np.int64))


def _merged(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of several lists in order, and the sums of their counts."""
    values, counts = np.concatenate([x[0] for x in lists]), np.concatenate([x[1] for x in lists])
    if not len(values):
        return values, counts
    order = np.argsort(values, kind="stable")  # merges runs that are in order
    values, counts = values[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[at], np.add.reduceat(counts, at)


class Block:
    """The distinct grams, contexts and words of a block, from its texts; ``learn`` says which texts count.

    Where the distinct ``grams`` of the texts are known already, in order, they are not counted again.
    """

    def __init__(self, keep: bool, grams: np.ndarray | None = None):
        self.keep, self.grams, self.words, self.kept = keep, [], [], []
        self.places = None
        if grams is not None:
            self.places, self.grams = _Places(grams), [(grams, np.zeros(len(grams), np.int64))]
        self.powers = (np.empty(0, np.uint64), np.empty(0, np.uint64))
        self.waiting, self.size, self.tokens = [], 0, 0

    @classmethod
    def of_grams(cls, packed: np.ndarray, count: np.ndarray) -> Block:
        """A block, closed, from its distinct grams in order and their counts; it knows no words."""
        block = cls(False)
        block.grams, block.words = [(packed, count)], [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        block.close()
        return block

    def add(self, text: str | None, learn: bool, tag: int) -> None:
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        self.waiting.append((data, learn, tag))
        self.size += len(data) + ORDERS
        if self.size >= PART_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        size = self.size + ORDERS
        if len(self.powers[0]) < size:
            n = max(size, PART_BYTES + (PART_BYTES >> 2))
            self.powers = (_powers(n, _BASE), _powers(n, pow(_BASE, -1, 1 << 64)))
        self.waiting.sort(key=lambda x: not x[1])
        texts, learn, tags = zip(*self.waiting)
        self.waiting, self.size = [], 0
        part, learn = Part(list(texts), sum(learn), self.powers), np.array(learn, bool)
        packed = part.grams()
        keys, owner = part.words()
        self.tokens += int(np.count_nonzero(learn[owner]))
        if self.keep:
            at, words = pd.factorize(keys)
            if self.places is not None:
                number = self.places.of(packed)
            else:
                number, found = _numbered(packed)
                self.grams.append((found, np.bincount(number[: part.trained], minlength=len(found))))
            self.kept.append((tags, part.lengths, number, at.astype(np.int32), words, owner.astype(np.int32), learn))
            self.words.append((words, np.bincount(at[learn[owner]], minlength=len(words))))
        else:
            mine = learn[owner]
            for lists, trained, others in ((self.grams, packed[: part.trained], packed[part.trained :]), (self.words, keys[mine], keys[~mine])):
                lists.append(_counted(trained))
                found = _counted(others)[0]
                lists.append((found, np.zeros(len(found), np.int64)))
        for lists in (self.grams, self.words):
            if sum(len(x[0]) for x in lists[1:]) > 1 << 20:
                lists[:] = [_merged(lists)]

    def only_trained(self) -> None:
        """After ``close``: leave the grams of trained texts alone; keys and pairs stay."""
        seen = self.count > 0
        self.packed, self.byte, self.count, self.laid = self.packed[seen], self.byte[seen], self.count[seen], self.laid[:, seen]

    @property
    def pair_of(self) -> np.ndarray:
        """The place of each gram's pair in ``pairs``, by order and gram."""
        place = np.empty(len(self.order), np.int32)
        place[self.order] = np.arange(len(self.order), dtype=np.int32)
        return place[self.laid]

    def close(self) -> None:
        """Merge the parts: ``packed`` grams with ``byte, count``; the ``keys`` of all contexts, and ``pairs`` of a key's number and a byte with ``pair_counts``; ``word_keys`` with ``word_counts``.

        ``laid`` numbers each gram's pairs as the grams meet them, so that what is kept in this order is read almost in a row; ``order`` has these numbers in the order of ``pairs``.
        """
        self.flush()
        self.packed, self.count = self.grams[0] if len(self.grams) == 1 else _merged(self.grams)
        self.word_keys, self.word_counts = _merged(self.words)
        self.grams, self.words = [], []
        self.byte = (self.packed & U(255)).astype(np.int64)
        contexts, numbers, offset = [], [], 0  # pairs of different orders have different keys, so each order is reduced by itself
        for k in range(1, ORDERS + 1):
            last = (self.packed >> U(8)) & U((1 << 8 * k) - 1)
            number, distinct = _in_runs(last) if k == ORDERS else pd.factorize(last)
            contexts.append(_mixed((distinct | U(k << 56)) * _GOLD) & ~U(1))
            numbers.append(number + offset)
            offset += len(distinct)
        keys = np.concatenate(contexts)
        order = np.argsort(keys)
        self.keys, place = keys[order], np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        del keys, order
        codes, counts, at, base = [], [], [], 0
        for k, n in enumerate(numbers, 1):
            own, distinct = place[n] * 256 + self.byte, None
            if k == ORDERS:  # a gram is a pair of its longest context
                own, distinct, count = np.arange(len(own)), own, self.count.astype(np.int64)
            else:
                own, distinct = pd.factorize(own)
                count = np.bincount(own, self.count, len(distinct)).astype(np.int64)
            codes.append(distinct)
            counts.append(count)
            at.append((own + base).astype(np.int32))
            base += len(distinct)
        del numbers, contexts
        codes, counts = np.concatenate(codes), np.concatenate(counts)
        order = _order(codes)
        self.pairs, self.pair_counts = codes[order], counts[order]
        self.order, self.laid = order.astype(np.int32), np.concatenate(at).reshape(ORDERS, -1)


def _blob(array: np.ndarray, kind: str) -> bytes:
    """A compressed array, behind the number of its bytes."""
    data = array.astype(kind).tobytes()
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def _array(blob: bytes, kind: str) -> np.ndarray:
    if len(blob) <= 8 or not any(blob[:8]):
        return np.zeros(0, kind)
    return np.frombuffer(pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True), kind)


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of keys, so the keys of a block stay in order over them."""
    return ((keys >> U(32)) * U(shards) >> U(32)).astype(np.int64)


def _starts(shard: np.ndarray, shards: int) -> np.ndarray:
    return np.searchsorted(shard, np.arange(shards + 1))


class Totals:
    """Corpus counts of a block's keys: for key i the entries ``lo[i]`` to ``lo[i + 1]`` with leaf place and count."""

    def __init__(self, lengths: np.ndarray, syms: np.ndarray, counts: np.ndarray, leaves: np.ndarray):
        key = np.repeat(np.arange(len(lengths)), lengths)
        code = key * 256 + leaves[syms]
        order = np.argsort(code, kind="stable")
        self.code, self.counts = code[order], counts[order].astype(np.int64)
        self.sums = np.concatenate(([0], np.cumsum(self.counts)))
        self.heads = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))  # of the keys' entries

    def without(self, pairs: np.ndarray, counts: np.ndarray, leaves: np.ndarray) -> None:
        """Take the block's own counts off."""
        code = pairs // 256 * 256 + leaves[pairs % 256]
        code, counts = code[counts > 0], counts[counts > 0]
        self.counts[np.searchsorted(self.code, code)] -= counts
        self.sums = np.concatenate(([0], np.cumsum(self.counts)))

    def before(self, code: np.ndarray) -> np.ndarray:
        """Counts of all entries before a key's number times 256 plus a leaf place."""
        return self.sums[np.searchsorted(self.code, code)]

    def within(self, key: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return self.before(key * 256 + last) - self.before(key * 256 + first)


def depths(paths: list[np.ndarray]) -> np.ndarray:
    """Decisions of each byte."""
    return np.array([len(p) - 1 for p in paths])


def decisions(block: Block, totals: Totals, leaves: np.ndarray, paths: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For some grams after others their decisions in a row: how many each has, the predictors' logits for the branch taken (by order and decision), and the gate."""
    depth = depths(paths)
    longest = depth.max()
    middle, goes_left = np.zeros((longest, 256), np.int64), np.zeros((longest, 256), bool)
    for b, path in enumerate(paths):
        for level, (node, child) in enumerate(zip(path, path[1:])):
            goes_left[level, b] = node[0] == child[0]
            middle[level, b] = child[1] if goes_left[level, b] else child[0]
    used = np.zeros(len(block.pairs), bool)
    used[block.laid] = True
    at = np.flatnonzero(used[block.order])
    key, byte = block.pairs[at] & ~255, block.pairs[at] & 255
    sizes = np.zeros(len(used), np.int64)
    sizes[block.order[at]] = depth[byte]
    n_bits = sizes.sum()
    first_bit = (np.cumsum(sizes) - sizes).astype(np.int32)
    bit, sizes = first_bit[block.order[at]], depth[byte]
    known = np.empty(n_bits, np.uint64)  # count of the node above and logit, two floats that are read together below
    # columns of the leaves that occur; a place between leaves is the number of such leaves before it
    occurs = np.zeros(257, np.int64)
    occurs[1:][np.unique(totals.code & 255)] = 1
    column = np.cumsum(occurs)
    width, middle = column[-1] + 1, column[middle]
    first_code, first_counts = np.append(totals.code, -1), np.append(totals.counts, 0)
    for i in range(0, len(at), TABLED_AT_ONCE):
        part = slice(i, i + TABLED_AT_ONCE)
        k, b, n, to = key[part], byte[part], sizes[part], bit[part]
        first, last = totals.heads[k >> 8], totals.heads[(k >> 8) + 1]
        whole = totals.sums[last] - totals.sums[first]
        # contexts never seen, and those only ever followed by this byte, are alike at every level
        alone = (whole == first_counts[first]) & (first_code[first] == k + leaves[b]) | (whole == 0)
        count = whole[alone].astype(np.float32)
        both = np.stack((count, np.log((count + DELTA) / DELTA)), 1).view(np.uint64).ravel()
        places = np.repeat(to[alone] - (np.cumsum(n[alone]) - n[alone]), n[alone]) + np.arange(n[alone].sum())
        known[places] = np.repeat(both, n[alone])
        # a row for each other context: the counts of all leaves before a column
        rest = np.flatnonzero(~alone)
        if not len(rest):
            continue
        row, heads = _in_runs(k[rest])
        held = rest[np.searchsorted(k[rest], heads)]
        size = last[held] - first[held]
        entry = np.repeat(first[held] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        table = np.zeros((len(heads), width), np.int64)
        table[np.repeat(np.arange(len(heads)), size), column[totals.code[entry] & 255] + 1] = totals.counts[entry]
        table = np.cumsum(table, 1, out=table).ravel()
        deep = np.argsort(-n[rest].astype(np.int16), kind="stable")  # the deepest first, so that a level has the first ones
        row, rest = row[deep] * width, rest[deep]
        b, n, to, lo, hi = b[rest], n[rest], to[rest], np.zeros(len(rest), np.int64), whole[rest]
        for level in range(longest):  # from the root down; a step to a child moves one end of the node's interval of leaves
            if level:
                deeper = np.searchsorted(-n, -level)
                row, b, n, to, lo, hi = row[:deeper], b[:deeper], n[:deeper], to[:deeper], lo[:deeper], hi[:deeper]
            cut, left = table.take(row + middle[level].take(b)), goes_left[level].take(b)
            both = np.empty((len(b), 2), np.float32)
            above = (hi - lo).astype(np.float32)
            np.copyto(hi, cut, where=left)
            np.copyto(lo, cut, where=~left)
            taken = (hi - lo).astype(np.float32)
            both[:, 0], both[:, 1] = above, np.log((taken + DELTA) / (above - taken + DELTA))
            known[to + level] = both.view(np.uint64).ravel()
    gram_size = depth[block.byte]
    for i in range(0, len(gram_size), PAIRS_AT_ONCE):
        n = gram_size[i : i + PAIRS_AT_ONCE]
        heads = np.cumsum(n) - n
        own = np.repeat(np.arange(len(n)), n)
        level = np.arange(len(own)) - heads.take(own)
        logits = np.empty((ORDERS, len(own)), np.float32)
        orders, seen = np.zeros(len(own), np.int8), np.zeros(len(own), np.float32)
        for k in range(ORDERS):
            found = known.take(first_bit.take(block.laid[k, i : i + len(n)]).take(own) + level).view(np.float32).reshape(-1, 2)
            logits[k] = found[:, 1]
            above = found[:, 0]
            some = above > 0
            orders += some
            np.copyto(seen, above, where=some)
        sure = sum((seen >= c).astype(np.int8) for c in CONFIDENCE)
        yield n, logits, (orders * np.int8(len(CONFIDENCE) + 1) + sure) * np.int8(2) + (level > 0)


def fit(logits: np.ndarray, gate: np.ndarray, times: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Weights per gate that minimise the cost of the branches taken, each decision counted ``times``; Newton steps with a small ridge."""
    weights = np.full((GATES, ORDERS), 1.0 / ORDERS)
    order = np.argsort(gate, kind="stable")  # of bytes: by counting
    edges = np.concatenate(([0], np.cumsum(np.bincount(gate, minlength=GATES))))
    for g in range(GATES):
        at = order[edges[g] : edges[g + 1]]
        at = at[times[at] > 0]
        if not len(at):
            continue
        parts = [at[i : i + PAIRS_AT_ONCE] for i in range(0, len(at), PAIRS_AT_ONCE)]
        parts = [(logits.take(part, 1), times[part].astype(np.float32)) for part in parts]  # taken out once for all rounds
        parts = [(np.ascontiguousarray(flat.T), flat, n) for flat, n in parts]
        for _ in range(rounds):
            slope, curve = weights[g] * -1.0 + 1.0 / ORDERS, np.eye(ORDERS)
            for x, flat, n in parts:
                p = x @ weights[g].astype(np.float32)
                np.exp(np.negative(np.clip(p, -30, 30, out=p), out=p), out=p)
                p = np.divide(1, np.add(p, 1, out=p), out=p)
                rest = 1 - p
                slope = slope + x.T @ (n * rest)
                curve = curve + (flat * (n * p * rest)) @ x
            step = np.linalg.solve(curve, slope)
            largest = np.abs(step).max()
            weights[g] += step * min(1.0, 1.0 / max(largest, 1e-9))
            if largest < 1e-4:
                break
    return weights


def gram_bits(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], weights: np.ndarray) -> np.ndarray:
    """Bits of each gram's byte, by mixer and gram, from the decisions of grams after grams."""
    bits, by_order = [np.empty((len(GAINS), 0))], np.ascontiguousarray(weights.astype(np.float32).T)
    for n, logits, gate in parts:
        own = gate.astype(np.intp)
        weighted = [x * w.take(own) for x, w in zip(logits, by_order)]
        short, long = (functools.reduce(np.add, some) for some in (weighted[:SHORT], weighted[SHORT:]))
        found, heads = np.empty((len(GAINS), len(n))), np.cumsum(n) - n
        for m, (a, b) in enumerate(GAINS):
            z = a * short + b * long
            found[m] = np.add.reduceat(np.log(1 + np.exp(-np.abs(z))) + np.maximum(-z, 0), heads) / np.float32(np.log(2))
        bits.append(found)
    return np.concatenate(bits, 1)


def text_bits(bits: np.ndarray, grams: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bits of each text; ``bits``: by mixer and gram, ``grams``: of all positions, text after text."""
    heads = np.cumsum(lengths) - lengths
    total = np.stack([np.add.reduceat(own.take(grams), heads) for own in bits], 1)
    least = total.min(1)
    return least - np.log2(np.exp2(least[:, None] - total).mean(1))


def _packed(rows: DataFrame, blocks: int) -> DataFrame:
    """``(block, data)``: the rows of a batch that fall into a block, compressed, so that texts are shuffled at a fraction of their size."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            keys = batch["block"].to_numpy(zero_copy_only=False)
            order = np.argsort(keys, kind="stable")
            keys, batch = keys[order], batch.take(pa.array(order)).select(["id", "text", "learn"])
            number, data = [], []
            for i, j in _runs(keys):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
                    writer.write_batch(batch.slice(i, j - i))
                number.append(int(keys[i]))
                data.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(data, pa.binary())], ["block", "data"])

    return rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))).mapInArrow(pack, "block long, data binary")


def _unpacked(data: bytes) -> Iterator[pa.RecordBatch]:
    with pa.ipc.open_stream(data) as reader:
        yield from reader


def _texts(rows: pa.RecordBatch) -> Iterator[tuple[str | None, bool]]:
    return zip(rows["text"].to_pylist(), rows["learn"].to_pylist())


def _release() -> None:
    """Give freed memory back to the system: a worker takes block after block, and two of them share an executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return list(zip(cuts, cuts[1:])) if len(keys) else []


def score(
    df: DataFrame, learn: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20
) -> DataFrame:
    """Per row ``id_col, learn, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte``; ``learn`` names the boolean column of trained rows.

    ``base_score`` is the smoothed word model: words and one end per text, each log10((c + 0.5) / (N + 0.5 (V + 1))). A null text is an empty one: its end only.
    A null in ``learn`` counts as false. If nothing was learned, N and V are 0 and the predictors know nothing. Equal rows get equal scores. Texts of any length are
    read whole; one text must fit a worker's memory. Other columns are not read; an empty table gives no rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(learn), F.lit(False)).alias("learn"))

    size = rows.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("n")).first()["n"]
    blocks = slices(spark, size or 0, block_bytes, 2 * spark.sparkContext.defaultParallelism)
    shards = blocks
    dealt = _packed(rows, blocks)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "block", "keys", "lengths", "syms", "counts", "words", "word_counts", "grams", "gram_counts", "tokens", "bytes"]
        kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 8, pa.int64(), pa.list_(pa.int64()))

        def close(number: int, block: Block) -> pa.RecordBatch:
            block.close()
            key, sym = block.pairs // 256, (block.pairs % 256).astype(np.uint8)
            lengths = np.bincount(key, minlength=len(block.keys))
            keys_at = _starts(_shard_of(block.keys, shards), shards)
            pairs_at = np.concatenate(([0], np.cumsum(lengths)))[keys_at]
            words_at = _starts(_shard_of(block.word_keys, shards), shards)
            # one row holds the grams, for the fit; it passes by the shards
            apart = np.diff(block.packed, prepend=U(0))
            made = [(number % shards, number, *[None] * 6, _blob(apart, "<u8"), _blob(block.count, "<u4"), block.tokens, np.bincount(block.byte, block.count, 256).astype(np.int64).tolist())]
            for s in np.flatnonzero(np.diff(keys_at) + np.diff(words_at)).tolist():
                k, p, w = slice(keys_at[s], keys_at[s + 1]), slice(pairs_at[s], pairs_at[s + 1]), slice(words_at[s], words_at[s + 1])
                asked = (_blob(block.keys[k], "<u8"), _blob(lengths[k], "<u2"), _blob(sym[p], "u1"), _blob(block.pair_counts[p], "<u4"), _blob(block.word_keys[w], "<u8"), _blob(block.word_counts[w], "<u4"))
                made.append((s, number, *asked, None, None, 0, None))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], names)

        block, number = None, None
        for batch in batches:
            keys = batch["block"].to_numpy(zero_copy_only=False)
            for i, j in _runs(keys):
                if number != keys[i]:
                    if block is not None:
                        yield close(number, block)
                        block = None
                        _release()
                    block, number = Block(keep=False), int(keys[i])
                for data in batch["data"][i:j]:
                    for part in _unpacked(data.as_py()):
                        for text, trained in _texts(part):
                            block.add(text, trained, 0)
        if block is not None:
            yield close(number, block)

    sent = dealt.repartition(SPREAD * blocks, "block").sortWithinPartitions("block").mapInArrow(
        gather, "shard long, block long, keys binary, lengths binary, syms binary, counts binary, words binary, word_counts binary, grams binary, gram_counts binary, tokens long, bytes array<long>"
    )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "shard", "lengths", "syms", "counts", "word_counts", "grams", "gram_counts", "tokens", "types", "bytes"]
        kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 6, pa.int64(), pa.int64(), pa.list_(pa.int64()))

        def row(*values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names)

        def close(shard: int, held: list[dict]) -> Iterator[pa.RecordBatch]:
            asked = [_array(r["keys"], "<u8") for r in held]
            keys, at = np.unique(np.concatenate(asked), return_inverse=True)
            lengths = np.concatenate([_array(r["lengths"], "<u2") for r in held]).astype(np.int64)
            code = np.repeat(at, lengths) * 256 + np.concatenate([_array(r["syms"], "u1") for r in held])
            order = _order(code)
            place, code = np.empty(len(order), np.int64), code[order]
            place[order], code = _in_runs(code)
            counts = np.bincount(place, np.concatenate([_array(r["counts"], "<u4") for r in held]), len(code)).astype(np.int64)
            code, counts = code[counts > 0], counts[counts > 0]
            first = np.concatenate(([0], np.cumsum(np.bincount(code >> 8, minlength=len(keys)))))
            words = [_array(r["words"], "<u8") for r in held]
            found, word = np.unique(np.concatenate(words), return_inverse=True)
            word_counts = np.bincount(word, np.concatenate([_array(r["word_counts"], "<u4") for r in held]), len(found)).astype(np.int64)
            types = int(np.count_nonzero(word_counts))
            parts = zip(held, np.split(at, np.cumsum([len(a) for a in asked])[:-1]), np.split(word, np.cumsum([len(a) for a in words])[:-1]))
            for r, own, own_words in parts:
                size = first[own + 1] - first[own]
                entry = np.repeat(first[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                totals = (_blob(size, "<u2"), _blob(code[entry] % 256, "u1"), _blob(counts[entry], "<u8"), _blob(word_counts[own_words], "<u8"))
                yield row(r["block"], shard, *totals, None, None, 0, types, None)
                types = 0

        held, shard = [], None
        for batch in batches:
            for r in batch.to_pylist():
                if r["grams"] is not None:
                    yield row(r["block"], -1, *[None] * 4, r["grams"], r["gram_counts"], r["tokens"], 0, r["bytes"])
                    continue
                if shard != r["shard"]:
                    if held:
                        yield from close(shard, held)
                    held, shard = [], r["shard"]
                held.append(r)
        if held:
            yield from close(shard, held)

    answers = stored(
        sent.repartition(SPREAD * shards, "shard").sortWithinPartitions("shard").mapInArrow(
            answer,
            "block long, shard long, lengths binary, syms binary, counts binary, word_counts binary, grams binary, gram_counts binary, tokens long, types long, bytes array<long>",
        ), "lm-answers",
    )
    seen = answers.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    n_train, n_types = seen["n"] or 0, seen["v"] or 0
    histogram = np.zeros(256, np.int64)
    for r in answers.select(F.posexplode("bytes")).groupBy("pos").agg(F.sum("col").alias("n")).collect():  # 256 rows
        histogram[r["pos"]] = r["n"]
    leaves, paths = code_tree(histogram)

    def with_answers(source: DataFrame, own: DataFrame) -> DataFrame:
        """Texts and answers of a block in one partition: first its grams, then the answers in the order of their shards."""
        asked = ("lengths", "syms", "counts", "word_counts", "grams")
        left = own.select("block", F.lit(0).alias("kind"), "shard", *asked, F.lit(None).cast("binary").alias("data"))
        empty = (F.lit(None).cast("binary").alias(c) for c in asked)
        right = source.select("block", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("shard"), *empty, "data")
        return left.unionByName(right).repartition(SPREAD * blocks, "block").sortWithinPartitions("block", "kind", "shard")

    def grams_of(r: dict) -> np.ndarray:
        return np.cumsum(_array(r["grams"], "<u8"), dtype=np.uint64)

    def totals_of(got: list[dict]) -> Totals:
        return Totals(*(np.concatenate([_array(r[c], k) for r in got]) for c, k in (("lengths", "<u2"), ("syms", "u1"), ("counts", "<u8"))), leaves)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, Totals, np.ndarray, list]]:
        """Each block with its totals, those of its words, and the ids of its texts."""
        def close(block, got, ids):
            block.close()
            _release()
            return block, totals_of(got), np.concatenate([_array(r["word_counts"], "<u8") for r in got]).astype(np.int64), ids

        block, number, got, ids = None, None, [], []
        for batch in batches:
            keys = batch["block"].to_numpy(zero_copy_only=False)
            for i, j in _runs(keys):
                if number != keys[i]:
                    if block is not None and ids:
                        yield close(block, got, ids)
                        block = got = ids = None
                        _release()
                    block, number, got, ids = None, int(keys[i]), [], []
                own = batch.slice(i, j - i)
                asked = pc.equal(own["kind"], 0)
                for r in own.select(["lengths", "syms", "counts", "word_counts", "grams"]).filter(asked).to_pylist():
                    if r["grams"] is None:
                        got.append(r)
                    else:
                        block = Block(keep=True, grams=grams_of(r))
                own = own.filter(pc.invert(asked))
                for data in own["data"]:
                    for part in _unpacked(data.as_py()):
                        for (text, trained), key in zip(_texts(part), part["id"]):
                            block.add(text, trained, len(ids))
                            ids.append(key)
        if block is not None and ids:
            yield close(block, got, ids)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(grams: dict, got: list[dict]) -> Iterator[pa.RecordBatch]:
            block = Block.of_grams(grams_of(grams), _array(grams["gram_counts"], "<u4").astype(np.int64))
            totals = totals_of(got)
            totals.without(block.pairs, block.pair_counts, leaves)
            block.only_trained()
            if len(block.count):
                sizes, logits, gate = depths(paths)[block.byte], [], []
                for _, some, own in decisions(block, totals, leaves, paths):
                    logits.append(some)
                    gate.append(own)
                logits, gate = np.concatenate(logits, 1), np.concatenate(gate)
                each = np.repeat(block.count.astype(np.uint32), sizes)
                weights, mass = fit(logits, gate, each), np.zeros(GATES)
                for i in range(0, len(gate), PAIRS_AT_ONCE):
                    mass += np.bincount(gate[i : i + PAIRS_AT_ONCE], each[i : i + PAIRS_AT_ONCE], GATES)
                kinds = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([(weights * mass[:, None]).ravel().tolist()], kinds), pa.array([mass.tolist()], kinds)], ["w", "n"])

        grams, got = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["grams"] is None:
                    got.append(r)
                    continue
                if grams is not None:
                    yield from close(grams, got)
                    _release()
                grams, got = r, []
        if grams is not None:
            yield from close(grams, got)
            _release()

    # Of a block first the grams, then the answers in the order of their shards.
    learned = answers.select("block", "shard", "lengths", "syms", "counts", "grams", "gram_counts").repartition(SPREAD * blocks, "block").sortWithinPartitions("block", "shard")
    # A row per block. Its parts come at their places, so the sums by place are those of the whole lists.
    fitted = learned.mapInArrow(train, "w array<double>, n array<double>").select(F.posexplode(F.concat("w", "n")))
    sums = np.zeros(GATES * ORDERS + GATES)
    for r in fitted.groupBy("pos").agg(F.array_sort(F.collect_list("col")).alias("parts")).select("pos", F.aggregate("parts", F.lit(0.0), lambda a, x: a + x).alias("total")).collect():
        sums[r["pos"]] = r["total"]
    total, mass = sums[: GATES * ORDERS].reshape(GATES, ORDERS), sums[GATES * ORDERS :, None]
    weights = np.where(mass > 0, total / np.maximum(mass, 1e-9), 1.0 / ORDERS).astype(np.float32)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, totals, counts, ids in opened(batches):
            bits_of = gram_bits(decisions(block, totals, leaves, paths), weights)
            _release()
            for tags, lengths, number, word, words, owner, learned in block.kept:
                bits = text_bits(bits_of, number, lengths)
                c = counts[np.searchsorted(block.word_keys, words)][word]
                n_tokens = np.bincount(owner, minlength=len(tags))
                known = np.bincount(owner, c > 0, len(tags)).astype(np.int64)
                logs = np.bincount(owner, np.log10(c + 0.5), len(tags))
                base = logs - n_tokens * np.log10(n_train + 0.5 * (n_types + 1))
                own = pa.array([ids[t].as_py() for t in tags], ids[0].type)
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(learned), pa.array(n_tokens), pa.array(known), pa.array(np.full(len(tags), n_train)), pa.array(base), pa.array(-bits * np.log10(2)),
                     pa.array(lengths), pa.array(bits / lengths)],
                    ["id", "learn", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"],
                )
            del block, totals, ids, bits_of, counts, number, word, words, owner

    id_type = df.schema[id_col].dataType.simpleString()
    found = with_answers(dealt, answers).mapInArrow(
        apply, f"id {id_type}, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    )
    return found.withColumnRenamed("id", id_col)
