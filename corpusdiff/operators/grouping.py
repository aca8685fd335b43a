"""From accepted pairs to small N-to-M groups, greedy one-to-one matching, and connected components."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusdiff.session import cut_lineage


@dataclass(frozen=True)
class Bounds:
    per_side: int = 2
    total: int = 4
    pairs: int = 8


@dataclass
class _Group:
    """Pairs (by rank) that belong together, with everything the merge rules look at; articles and titles are numbers."""

    ranks: list[int]
    left: dict[int, int] = field(default_factory=dict)
    right: dict[int, int] = field(default_factory=dict)
    exact_titles: set[int] = field(default_factory=set)
    terms: set[str] = field(default_factory=set)
    specific: bool = False

    def joined(self, other: _Group) -> _Group:
        return _Group(
            sorted({*self.ranks, *other.ranks}),
            self.left | other.left,
            self.right | other.right,
            self.exact_titles | other.exact_titles,
            self.terms | other.terms,
            self.specific or other.specific,
        )

    def shares_article(self, other: _Group) -> bool:
        return not self.left.keys().isdisjoint(other.left) or not self.right.keys().isdisjoint(other.right)


class _Pairs:
    """The accepted pairs of some dates or blocks in columns, best first. Articles, titles and seeds of different ones have different numbers, so no step looks across them.

    A pair takes some 60 bytes, whatever its texts; what the merge rules look at is put together for the groups that are compared.
    """

    def __init__(self, table: pa.Table, by: tuple[str, ...], plain_titles: set[str]):
        table = table.unify_dictionaries().combine_chunks()
        key = np.zeros(len(table), np.int64)
        for c in by:
            key = _numbers(key, _codes(table[c])[0] if pa.types.is_dictionary(table[c].type) else _dense(table[c]))
        l, r = (_codes(table[f"{side}_article"]) for side in "lr")
        titles: dict[str, int] = {}
        lt, rt = (_codes(table[f"{side}_ctitle"], titles) for side in "lr")
        cluster = _codes(table["cluster_key"])
        exact = table["exact_kind"].to_numpy() & (lt[0] == rt[0]) & (lt[0] >= 0)
        exact &= np.array([bool(x) for x in titles] + [False])[lt[0]]
        places = [rank for side, (codes, names) in (("l", l), ("r", r)) for rank in (_dense(table[f"{side}_pos"]), np.append(_dense(pa.array(names, pa.string())), len(names) + 1)[codes])]
        order = np.lexsort(places[::-1])
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        conf = table["accepted_confidence"].to_numpy()
        order = order[np.argsort(-conf[order], kind="stable")]
        seeded = np.array([bool(x) for x in cluster[1]] + [False])[cluster[0]]
        seed = cluster[0].copy()
        seed[~seeded] = len(cluster[1]) + 1 + _codes(table["pair_id"].filter(pa.array(~seeded)).dictionary_encode())[0]
        self.row, self.place, self.conf = order.astype(np.int32), place[order], conf[order]
        self.left, self.right = (_listed(_numbers(key, codes)[order]) for codes, _ in (l, r))
        self.seed = _numbers(key, seed)[order]
        self.l_title, self.r_title = (x[0][order].astype(np.int32) for x in (lt, rt))
        self.exact, self.exact_title = exact[order], _numbers(key, lt[0])[order].astype(np.int32)
        self.specific = self.exact | table["concrete"].fill_null(False).to_numpy()[order]
        terms = _codes(table["terms"])
        self.terms, self.term_sets = terms[0][order].astype(np.int32), [*(frozenset(json.loads(x)) for x in terms[1]), frozenset()]
        self.telling = [*(len(x) >= 8 and x not in plain_titles for x in titles), False]

    def group(self, ranks: list[int]) -> _Group:
        """Some pairs, best first, as a group."""
        found = _Group(ranks)
        for k in ranks:
            found.left[self.left[k]] = int(self.l_title[k])
            found.right[self.right[k]] = int(self.r_title[k])
            if self.exact[k]:
                found.exact_titles.add(int(self.exact_title[k]))
            else:
                found.terms |= self.term_sets[self.terms[k]]
            found.specific |= bool(self.specific[k])
        return found


def _codes(column: pa.Array | pa.ChunkedArray, known: dict[str, int] | None = None) -> tuple[np.ndarray, list[str]]:
    """The numbers of a column's texts, -1 for null, and the texts; ``known`` texts have their numbers, others get the next ones."""
    known = {} if known is None else known
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out = [np.zeros(0, np.int64)]
    for chunk in chunks:
        to = np.array([*(known.setdefault(x, len(known)) for x in chunk.dictionary.to_pylist()), -1], np.int64)
        out.append(to[chunk.indices.fill_null(-1).to_numpy(zero_copy_only=False)])
    return np.concatenate(out), list(known)


def _dense(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ranks of values in order, null last."""
    return pc.rank(column, tiebreaker="dense").to_numpy().astype(np.int64)


def _numbers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers from 0 on of the distinct pairs of two numbers of at least -1."""
    return pd.factorize(a * (int(b.max(initial=0)) + 2) + b + 1)[0]


def _listed(numbers: np.ndarray) -> list[int]:
    """As a list that holds each number as one object."""
    known = list(range(int(numbers.max(initial=-1)) + 1))
    return [known[k] for k in numbers]


def _fits(left: set, right: set, n_pairs: int, bounds: Bounds) -> bool:
    return (
        len(left) <= bounds.per_side
        and len(right) <= bounds.per_side
        and len(left) + len(right) <= bounds.total
        and n_pairs <= bounds.pairs
    )


def _same_story(a: _Group, b: _Group, telling: list[bool]) -> bool:
    """Whether two groups speak of one thing: a common exact title, a repeated title against a common counterpart, or a
    common article together with a common anchor or with exact and specific signals. ``telling`` titles are long and not plain."""
    if a.exact_titles & b.exact_titles:
        return True

    def repeated(own_a: dict, own_b: dict, other_a: dict, other_b: dict) -> bool:
        if other_a.keys().isdisjoint(other_b):
            return False
        return any(telling[x] for x in set(own_a.values()) & set(own_b.values()))

    if repeated(a.left, b.left, a.right, b.right) or repeated(a.right, b.right, a.left, b.left):
        return True
    if not a.shares_article(b):
        return False
    exact = bool(a.exact_titles or b.exact_titles)
    return bool(a.terms & b.terms) or (exact and (a.specific or b.specific))


def _connected(ranks: np.ndarray, pairs: _Pairs) -> list[np.ndarray]:
    """Pairs that hang together by articles, each list in order."""
    if len(ranks) == 1:
        return [ranks]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    left, right = pairs.left, pairs.right
    for k in ranks:
        parent[root(left[k])] = root(~right[k])
    own = np.fromiter((left[k] for k in ranks), np.int64, len(ranks))
    distinct, at = np.unique(own, return_inverse=True)
    component = np.array([root(int(x)) for x in distinct])[at]
    order = np.argsort(component, kind="stable")
    return np.split(ranks[order], np.flatnonzero(np.diff(component[order])) + 1)


class _Parts:
    """Groups within the bounds, as tuples of their articles, and the group of each pair."""

    def __init__(self, pairs: _Pairs, bounds: Bounds):
        self.pairs, self.bounds = pairs, bounds
        self.left: list[tuple[int, ...]] = []
        self.right: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.of_pair = np.empty(len(pairs.row), np.int32)

    def room(self, left: int, right: int, n_pairs: int) -> tuple[bool, bool]:
        """Whether a group of that many articles and pairs may take a further article, left and right."""
        some = left + right < self.bounds.total and n_pairs < self.bounds.pairs
        return some and left < self.bounds.per_side, some and right < self.bounds.per_side

    def _may_take(self, i: int, left: bool) -> bool:
        return self.room(len(self.left[i]), len(self.right[i]), self.sizes[i])[not left]

    def _added(self, left: tuple[int, ...], right: tuple[int, ...], ranks: np.ndarray | int, size: int) -> int:
        self.left.append(left)
        self.right.append(right)
        self.sizes.append(size)
        self.of_pair[ranks] = len(self.sizes) - 1
        return len(self.sizes) - 1

    def split(self, ranks: np.ndarray) -> None:
        """Pairs that hang together: each, best first, joins the first group that it touches and fits.

        A group is looked up by its articles. One that can take no further article of a side is left out of the lists of the other side's articles; it is then found only
        by pairs of which it holds both articles. So the work of a pair does not grow with the number of groups its articles are in.
        """
        bounds, left_of, right_of = self.bounds, self.pairs.left, self.pairs.right
        if len(ranks) <= bounds.pairs:
            left, right = (tuple(dict.fromkeys(x[k] for k in ranks)) for x in (left_of, right_of))
            if _fits(left, right, len(ranks), bounds):
                self._added(left, right, ranks, len(ranks))
                return
        roomy_left: dict[int, list[int]] = {}  # by left article: groups that may take a right one
        roomy_right: dict[int, list[int]] = {}
        holding: dict[tuple[int, int], list[int]] = {}  # by both articles of a pair
        both = np.fromiter(((left_of[k] << 32) | right_of[k] for k in ranks), np.int64, len(ranks))
        once = len(np.unique(both)) == len(both)  # then a pair of articles need not be kept when it has come
        del both
        for rank in map(int, ranks):
            l, r = left_of[rank], right_of[rank]
            near = {i for i in roomy_left.get(l, ()) if self._may_take(i, False)}
            roomy_left[l] = sorted(near)
            more = [i for i in roomy_right.get(r, ()) if self._may_take(i, True)]
            roomy_right[r] = more
            near.update(more)
            near.update(holding.pop((l, r), ()) if once else holding.get((l, r), ()))
            at = None
            for i in sorted(near):
                n_left, n_right = len(self.left[i]) + (l not in self.left[i]), len(self.right[i]) + (r not in self.right[i])
                if self.sizes[i] < bounds.pairs and n_left <= bounds.per_side and n_right <= bounds.per_side and n_left + n_right <= bounds.total:
                    at = i
                    break
            if at is None:
                at = self._added((), (), rank, 0)
            new_left, new_right = l not in self.left[at], r not in self.right[at]
            self.sizes[at] += 1
            self.of_pair[rank] = at
            if new_left:
                self.left[at] += (l,)
            if new_right:
                self.right[at] += (r,)
            if new_left:
                roomy_left[l].append(at)
                for x in self.right[at]:
                    if not (once and x == r):
                        holding.setdefault((l, x), []).append(at)
            if new_right:
                roomy_right[r].append(at)
                for x in self.left[at]:
                    if not (x == l and (new_left or once)):
                        holding.setdefault((x, r), []).append(at)

    def in_order(self) -> None:
        """Number the groups by their best pairs."""
        first = np.full(len(self.sizes), len(self.of_pair), np.int64)
        np.minimum.at(first, self.of_pair, np.arange(len(self.of_pair)))
        order = np.argsort(first)
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        self.of_pair = number[self.of_pair]
        self.left, self.right, self.sizes = ([x[i] for i in order] for x in (self.left, self.right, self.sizes))


class _Merging:
    """Groups in rank order, found by what two mergeable ones must have in common.

    They share an article or an exact title. Two that share no article have room on both sides; two of which neither has room have the same articles. So a group
    without room meets only groups with room and those of its own articles, however many groups its articles are in.

    The groups of an article and those of equal articles are looked up in sorted arrays of all groups as they were at first; ``now`` tells in which group one is since. Only groups with room
    and merged ones are kept in sets.
    """

    def __init__(self, parts: _Parts):
        self.parts, self.pairs, self.bounds = parts, parts.pairs, parts.bounds
        n = len(parts.sizes)
        self.now = list(range(n))
        self.groups: dict[int, _Group] = {}
        self.ranks = np.argsort(parts.of_pair, kind="stable").astype(np.int32)
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(parts.of_pair, minlength=n))))
        flat = [np.fromiter(itertools.chain.from_iterable(x), np.int64) for x in (parts.left, parts.right)]
        owner = [np.repeat(np.arange(n, dtype=np.int32), np.fromiter(map(len, x), np.int64, n)) for x in (parts.left, parts.right)]
        node, owner = np.concatenate((flat[0] * 2, flat[1] * 2 + 1)), np.concatenate(owner)
        mixed = self._mixed(node)
        self.marks = np.zeros(n, np.uint64)
        np.add.at(self.marks, owner, mixed)
        order = np.argsort(node, kind="stable")
        self.owners, node = owner[order], node[order]
        self.nodes, at = np.unique(node, return_index=True)
        self.edges = np.append(at, len(node))
        self.by_mark = np.argsort(self.marks, kind="stable").astype(np.int32)
        self.sorted_marks = self.marks[self.by_mark]
        alone = np.ones(n, bool)
        same = self.sorted_marks[1:] == self.sorted_marks[:-1]
        alone[1:][same] = False
        alone[:-1][same] = False
        self.alone = np.empty(n, bool)
        self.alone[self.by_mark] = alone
        self.roomy_of_article: dict[int, set[int]] = {}
        self.roomy_of_title: dict[int, set[int]] = {}
        self.merged_of_mark: dict[int, set[int]] = {}
        for i in range(n):
            if any(self.room(i)):
                self._list(i)

    @staticmethod
    def _mixed(node: np.ndarray) -> np.ndarray:
        """Numbers whose sum tells a set of articles from others, but for chance; sets of equal sums are compared."""
        x = (node.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))

    def articles(self, i: int):
        group = self.groups.get(i)
        left, right = (self.parts.left[i], self.parts.right[i]) if group is None else (group.left, group.right)
        return left, right

    def nodes_of(self, i: int) -> list[int]:
        left, right = self.articles(i)
        return [*(2 * x for x in left), *(2 * x + 1 for x in right)]

    def size(self, i: int) -> int:
        return len(self.groups[i].ranks) if i in self.groups else self.parts.sizes[i]

    def room(self, i: int) -> tuple[bool, bool]:
        left, right = self.articles(i)
        return self.parts.room(len(left), len(right), self.size(i))

    def group(self, i: int) -> _Group:
        return self.groups.get(i) or self.pairs.group(self.ranks[self.starts[i] : self.starts[i + 1]].tolist())

    def current(self, i: int) -> int:
        now = self.now
        while now[i] != i:
            now[i] = i = now[now[i]]
        return i

    def _list(self, i: int, take_out: bool = False) -> None:
        """Note a group with room under its articles and titles, or take it out."""
        left, right = self.room(i)
        places = [(self.roomy_of_article, x) for x in self.nodes_of(i)] if left or right else []
        if left and right:
            places += [(self.roomy_of_title, x) for x in self.group(i).exact_titles]
        for index, key in places:
            if take_out:
                index[key].discard(i)
            else:
                index.setdefault(key, set()).add(i)

    def near(self, i: int) -> set[int]:
        left, right = self.room(i)
        nodes = self.nodes_of(i)
        found = set()
        if not (left or right):
            for x in nodes:
                found |= self.roomy_of_article.get(x, set())
        else:
            for x in nodes:
                at = np.searchsorted(self.nodes, x)
                found.update({self.current(j) for j in self.owners[self.edges[at] : self.edges[at + 1]].tolist()})
            if left and right:
                for title in self.group(i).exact_titles:
                    found |= self.roomy_of_title.get(title, set())
        # Groups of the same articles share an article, so only one without room has not met them yet.
        if not (left or right):
            mark = int(self.marks[i])
            found |= {j for j in self.merged_of_mark.get(mark, ()) if set(self.nodes_of(j)) == set(nodes)}
            if i in self.groups or not self.alone[i]:
                low, high = np.searchsorted(self.sorted_marks, self.marks[i]), np.searchsorted(self.sorted_marks, self.marks[i], "right")
                same = (j for j in self.by_mark[low:high].tolist() if self.now[j] == j and self.marks[j] == mark)
                found |= {j for j in same if set(self.nodes_of(j)) == set(nodes)}
        return found - {i}

    def can_join(self, i: int, j: int) -> bool:
        n = self.size(i) + self.size(j)
        if n > self.bounds.pairs:
            return False
        (al, ar), (bl, br) = self.articles(i), self.articles(j)
        return _fits({*al, *bl}, {*ar, *br}, n, self.bounds)

    def merge(self, i: int, j: int) -> None:
        group = self.group(i).joined(self.group(j))
        for x in (i, j):
            self._list(x, True)
            self.merged_of_mark.get(int(self.marks[x]), set()).discard(x)
        self.groups.pop(j, None)
        self.groups[i], self.now[j] = group, i
        self._list(i)
        nodes = np.array(self.nodes_of(i), np.int64)
        self.marks[i] = self._mixed(nodes).sum(dtype=np.uint64)
        self.merged_of_mark.setdefault(int(self.marks[i]), set()).add(i)


def _merge(parts: _Parts) -> _Merging:
    """Join the first mergeable two groups in rank order, again and again, until none is left.

    What has been refused needs another look only at a group that has changed since.
    """
    held = _Merging(parts)
    telling = parts.pairs.telling

    def first(i: int, others: list[int]) -> int | None:
        fitting = (j for j in others if held.can_join(i, j))
        return next((j for j in fitting if _same_story(held.group(i), held.group(j), telling)), None)

    i, last = 0, len(held.now)
    while i < last:
        if held.now[i] != i or (j := first(i, sorted(x for x in held.near(i) if x > i))) is None:
            i += 1
            continue
        held.merge(i, j)
        while (k := first(i, sorted(x for x in held.near(i) if x < i))) is not None:
            held.merge(k, i)
            i = k
    return held


def _grouped(pairs: _Pairs, bounds: Bounds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of the pairs in final groups, the row of the best pair of their group, and their place in it."""
    parts = _Parts(pairs, bounds)
    order = np.argsort(pairs.seed, kind="stable")
    for seed in np.split(order, np.flatnonzero(np.diff(pairs.seed[order])) + 1) if len(order) else ():
        for ranks in _connected(seed, pairs):
            parts.split(ranks)
    parts.in_order()
    held = _merge(parts)
    now = np.array([held.current(i) for i in range(len(held.now))], np.int32)
    of_pair = now[parts.of_pair] if len(now) else parts.of_pair
    ranks = np.argsort(of_pair, kind="stable")
    starts = np.flatnonzero(np.diff(of_pair[ranks], prepend=-1))
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    groups, sizes = of_pair[ranks[starts]], np.diff(np.append(starts, len(ranks)))
    n_left, n_right = (np.array([len(held.articles(i)[side]) for i in groups.tolist()]) for side in (0, 1))
    within = (n_left <= bounds.per_side) & (n_right <= bounds.per_side) & (n_left + n_right <= bounds.total) & (sizes <= bounds.pairs)
    score = pairs.conf[ranks[starts]]
    score = score + np.where(np.logical_or.reduceat(pairs.exact[ranks], starts), 0.08, 0.0)
    score = score + np.where(np.logical_or.reduceat(pairs.specific[ranks], starts), 0.03, 0.0)
    score = score + np.where((sizes > 1) & within, 0.02, 0.0)
    used: set[int] = set()
    chosen = []
    for k in np.lexsort((pairs.place[ranks[starts]], -score)).tolist():
        nodes = held.nodes_of(int(groups[k]))
        if used.isdisjoint(nodes):
            used.update(nodes)
            chosen.append(k)
    at, n = starts[chosen], sizes[chosen]
    order = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    own = ranks[np.repeat(at, n) + order]
    return pairs.row[own], pairs.row[np.repeat(ranks[at], n)], order


def group_day(pairs: pd.DataFrame, bounds: Bounds, plain_titles: set[str]) -> pd.DataFrame:
    """Group the accepted pairs of one date or independence block."""
    columns = {c: pa.array(pairs[c].tolist()) for c in ("l_pos", "r_pos")}
    columns |= {c: pa.array(pairs[c].tolist(), pa.string()) for c in ("pair_id", "l_article", "r_article", "l_ctitle", "r_ctitle", "cluster_key")}
    columns["terms"] = pa.array([None if x is None else json.dumps([*x]) for x in pairs["merge_terms"]], pa.string())
    columns |= {"exact_kind": pa.array((pairs["title_kind"] == "exact").tolist()), "concrete": pa.array(pairs["concrete"].tolist(), pa.bool_())}
    columns["accepted_confidence"] = pa.array(pairs["accepted_confidence"].tolist(), pa.float64())
    row, head, order = _grouped(_Pairs(_encoded(pa.table(columns)), (), plain_titles), bounds)
    found = pairs.iloc[row][["issue_date", "pair_id"]].reset_index(drop=True)
    return found.assign(group_key=pairs["pair_id"].to_numpy()[head], pair_order=order)


def _encoded(table: pa.Table) -> pa.Table:
    """Texts that come often as numbers and a list of the distinct ones."""
    for k, c in enumerate(table.schema):
        if pa.types.is_string(c.type) and c.name != "pair_id":
            table = table.set_column(k, c.name, pc.dictionary_encode(table[c.name]))
    return table


GROUP_INPUT = (
    "issue_date", "pair_id", "l_article", "r_article", "l_pos", "r_pos", "l_ctitle", "r_ctitle", "title_kind", "cluster_key",
    "merge_terms", "concrete", "accepted_confidence",
)
PACKED_ROWS = 1 << 16


def group_pairs(
    accepted: DataFrame, rules, bounds: Bounds | None = None, by: tuple[str, ...] = ("issue_date",)
) -> DataFrame:
    """``(issue_date, pair_id, group_key, pair_order)`` of the pairs in final groups.

    The build calls it with the ``block`` column of :func:`independence_blocks` in ``by``, so a date spreads over tasks, with the same
    result as one call per date. Rows are pairs of copy classes, so copies do not enlarge a block. Pairs are shuffled as compressed batches, in which a text stands once, and a task
    holds them as numbers.
    """
    bounds = bounds or Bounds()
    plain = set(rules.generic_judge_terms)
    buckets = int(accepted.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    exact = F.coalesce(F.col("title_kind") == "exact", F.lit(False))
    names = [c for c in GROUP_INPUT if c not in ("title_kind", "merge_terms")]
    rows = accepted.select(
        F.pmod(F.xxhash64(*by), F.lit(buckets)).alias("bucket_"), *names, *[c for c in by if c not in names],
        exact.alias("exact_kind"), F.to_json("merge_terms").alias("terms"),
    ).withColumn("accepted_confidence", F.col("accepted_confidence").cast("double"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd", unify_dictionaries=True)

        def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            own = table["bucket_"].to_numpy()
            order = np.argsort(own, kind="stable")
            cuts = np.flatnonzero(np.diff(own[order], prepend=-1))
            table, data = table.drop_columns("bucket_"), []
            for at in np.split(order, cuts[1:]):
                part = _encoded(table.take(at)).combine_chunks()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as writer:
                    writer.write_table(part)
                data.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(own[order][cuts], pa.int64()), pa.array(data, pa.binary())], ["bucket_", "data"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= PACKED_ROWS:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: list[pa.Table]) -> pa.RecordBatch:
            table = pa.concat_tables(held)
            held.clear()
            ids, dates = table["pair_id"], table["issue_date"]
            row, head, order = _grouped(_Pairs(table, by, plain), bounds)
            found = [dates.take(row), ids.take(row), ids.take(head)]
            return pa.RecordBatch.from_arrays([*(x.combine_chunks() for x in found), pa.array(order, pa.int32())], ["issue_date", "pair_id", "group_key", "pair_order"])

        held, bucket = [], None
        for batch in batches:
            for own, data in zip(batch["bucket_"].to_pylist(), batch["data"]):
                if own != bucket and held:
                    yield close(held)
                bucket = own
                with pa.ipc.open_stream(data.as_buffer()) as reader:
                    held.append(reader.read_all())
        if held:
            yield close(held)

    sent = rows.mapInArrow(pack, "bucket_ long, data binary").repartition("bucket_").sortWithinPartitions("bucket_")
    return sent.mapInArrow(group, "issue_date date, pair_id string, group_key string, pair_order int")


def _first_in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """What the sequential pass takes of the best pairs of a date (``place`` numbers them), one article per class.

    A class with copies stands at a later place once its next article is used. A pair with such a class is therefore left for the next round, with both of its classes from there on, since
    either may be used by it; pairs of other classes are decided.
    """
    pdf = pdf.sort_values("place")
    out, used, waiting = [], set(), set()
    for k, l, r, l_free, r_free in zip(pdf.index, pdf.l_class, pdf.r_class, pdf.l_free, pdf.r_free):
        left, right = ("l", l), ("r", r)
        if left in used or right in used:
            continue
        if left in waiting or right in waiting:
            waiting |= {left, right}
            continue
        out.append(k)
        for x, free in ((left, l_free), (right, r_free)):
            (used if free == 1 else waiting).add(x)
    return pdf.loc[out].drop(columns="place")


def greedy_one_to_one(pairs: DataFrame, members: DataFrame, chunk: int = 5000) -> DataFrame:
    """Best pair first, each article once, over usable pairs: ``(issue_date, l_article, r_article)`` and the columns of its pair.

    ``pairs`` are pairs of copy classes (``issue_date``, ``l_class``, ``r_class``, ``confidence``), ``members`` the articles of every class (``issue_date``, ``side``, ``class``, ``id``,
    ``pos``, ``rank`` from 1 in order of position and id). A pair of classes stands for all pairs of their articles; pairs of articles are taken in order of confidence,
    then position and id on the left, then on the right.

    Rounds instead of one sequential pass. A class gives its articles in order, so its next free article stands for it. A pair of classes that is the best one of both is what the sequential pass
    would take, so all such pairs are taken at once. Such a pair takes as many articles as both classes have left; if a pair of equal confidence competes for one of
    its classes, only those that come before the competitor's next article. Long chains, in which each pair waits for the one before, would need as many rounds; so every second round takes
    the ``chunk`` best pairs of each date in order instead, a bounded group.
    """
    rest = cut_lineage(pairs)
    state = cut_lineage(
        members.groupBy("issue_date", "side", "class").agg(F.count("*").alias("copies"), F.min(F.struct("pos", "id")).alias("front")).withColumn("used", F.lit(0).cast("long"))
    )
    taken: DataFrame | None = None
    turn = 0
    while True:
        live = rest
        for side in ("l", "r"):
            own = state.filter(F.col("side") == ("left" if side == "l" else "right")).filter("used < copies")
            live = live.join(
                own.select("issue_date", F.col("class").alias(f"{side}_class"), (F.col("copies") - F.col("used")).alias(f"{side}_free"), F.col("used").alias(f"{side}_used"), F.col("front").alias(f"{side}_front")),
                ["issue_date", f"{side}_class"],
            )
        live = cut_lineage(live)
        if live.isEmpty():
            break
        order = (F.desc("confidence"), "l_front", "r_front")
        turn += 1
        if turn % 2 == 0:
            first = live.withColumn("place", F.row_number().over(Window.partitionBy("issue_date").orderBy(*order))).filter(F.col("place") <= chunk)
            best = cut_lineage(first.groupBy("issue_date").applyInPandas(_first_in_order, live.schema).withColumn("times", F.lit(1).cast("long")))
            state, taken = _after(best, state, members), best if taken is None else taken.unionByName(best)
            rest = live.select(*rest.columns)
            continue
        of_left, of_right = Window.partitionBy("issue_date", "l_class"), Window.partitionBy("issue_date", "r_class")
        level_left, level_right = Window.partitionBy("issue_date", "l_class", "confidence"), Window.partitionBy("issue_date", "r_class", "confidence")
        best = live.withColumns({
            "ln_": F.row_number().over(of_left.orderBy(*order)), "rn_": F.row_number().over(of_right.orderBy(*order)),
            "r_limit": F.lead("r_front").over(level_left.orderBy("r_front")), "l_limit": F.lead("l_front").over(level_right.orderBy("l_front")),
        }).filter("ln_ = 1 AND rn_ = 1").drop("ln_", "rn_")
        best = cut_lineage(best.withColumn("times", F.least("l_free", "r_free")))
        if not best.filter("l_limit IS NOT NULL OR r_limit IS NOT NULL").isEmpty():
            best = cut_lineage(_before_competitors(best, members))
        best = best.drop("l_limit", "r_limit")
        state, taken = _after(best, state, members), best if taken is None else taken.unionByName(best)
        rest = live.select(*rest.columns)
    if taken is None:
        return rest.withColumns({"l_article": F.lit(""), "r_article": F.lit("")}).drop("l_class", "r_class")
    each = taken.withColumn("turn_", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    for side in ("l", "r"):
        own = members.filter(F.col("side") == ("left" if side == "l" else "right")).select("issue_date", F.col("class").alias(f"{side}_class"), F.col("rank").alias("rank_"), F.col("id").alias(f"{side}_article"))
        each = each.withColumn("rank_", F.col(f"{side}_used") + F.col("turn_")).join(own, ["issue_date", f"{side}_class", "rank_"]).drop("rank_")
    return each.select("l_article", "r_article", *[c for c in pairs.columns if c not in ("l_class", "r_class")])


def _after(best: DataFrame, state: DataFrame, members: DataFrame) -> DataFrame:
    """The state of the classes when the articles of ``best`` are used."""
    key = ["issue_date", "side", "class"]
    more = best.select("issue_date", F.lit("left").alias("side"), F.col("l_class").alias("class"), "times").unionByName(
        best.select("issue_date", F.lit("right").alias("side"), F.col("r_class").alias("class"), "times")
    )
    moved = state.join(more, key).withColumn("used", F.col("used") + F.col("times")).drop("times", "front")
    following = members.select(*key, (F.col("rank") - 1).alias("used"), F.struct("pos", "id").alias("front"))
    moved = moved.join(following, [*key, "used"], "left")
    return cut_lineage(state.join(more, key, "left_anti").unionByName(moved))


def _before_competitors(best: DataFrame, members: DataFrame) -> DataFrame:
    """``times`` lowered to the free articles of each class that come before the next article of a class that competes at equal confidence."""
    for side in ("l", "r"):
        own = members.filter(F.col("side") == ("left" if side == "l" else "right")).select("issue_date", F.col("class").alias(f"{side}_class"), "rank", F.struct("pos", "id").alias("at"))
        tied = best.filter(F.col(f"{side}_limit").isNotNull()).select("issue_date", f"{side}_class", f"{side}_used", f"{side}_limit")
        first = (
            tied.join(own, ["issue_date", f"{side}_class"]).filter((F.col("rank") > F.col(f"{side}_used")) & (F.col("at") < F.col(f"{side}_limit")))
            .groupBy("issue_date", f"{side}_class").agg(F.count("*").alias("n_"))
        )
        best = best.join(first, ["issue_date", f"{side}_class"], "left").withColumn("times", F.least("times", F.coalesce("n_", "times"))).drop("n_")
    return best


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of an edge list ``(a, b)``; the component is its smallest node.

    Each round every node takes the smallest label around it and then its label's own label, which shortens long
    chains. Neighbour labels are aggregated before the shuffle, so a hub does not gather its neighbours in one task.
    """
    both = cut_lineage(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        around = (
            both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        )
        lowered = labels.join(around.withColumnRenamed("a", "node"), "node", "left").select(
            "node", F.least("label", "near").alias("label"), F.col("label").alias("old")
        )
        root = lowered.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = cut_lineage(
            lowered.join(root, "label", "left").select("node", F.least("label", "root").alias("label"), "old")
        )
        labels = new.select("node", "label")
        if new.filter("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")


def _vertex(kind: str, value: str) -> Column:
    return F.concat_ws("|", F.col("issue_date").cast("string"), F.lit(kind), F.col(value))


def block_edges(accepted: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that link what :func:`independence_blocks` links. An exact pair links each of its articles with the title instead of with
    each other, so a title gives as many edges as it has articles, not as it has pairs."""
    exact = F.coalesce(F.col("title_kind") == "exact", F.lit(False))
    by_title = [accepted.filter(exact).select(_vertex(side, f"{side}_article").alias("a"), _vertex("t", "l_ctitle").alias("b")).distinct() for side in "lr"]
    others = accepted.filter(~exact).select(_vertex("l", "l_article").alias("a"), _vertex("r", "r_article").alias("b"))
    return others.union(by_title[0]).union(by_title[1])


def independence_blocks(accepted: DataFrame) -> DataFrame:
    """Adds ``block``: pairs linked by articles or by an exact title. No grouping step looks across blocks."""
    components = connected_components(block_edges(accepted))
    keyed = accepted.withColumn("node", _vertex("l", "l_article"))
    return keyed.join(components, "node").withColumnRenamed("component", "block").drop("node")
