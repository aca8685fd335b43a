"""Near-duplicate vectors by NN-descent.

Vectors of one label are compared by cosine in double precision. Equal vectors are one node with a size, so exact copies cost one row.

1. A first neighbour list of ``k`` per node comes from hashed sign patterns of random directions: nodes of one leaf, cut into chunks, are compared.
2. NN-descent: the forward and reverse neighbours of a node are compared with each other in one local join; better neighbours enter the lists. Rounds go on until
   no link is new.
3. Entries of at least the threshold are links. A node whose whole list is links is saturated: it may have more than ``k``. Its component is compared in full, in tiles
   dealt over tasks, which counts its links instead of listing them. Full lists on both sides may hide the links between two such components, so those of one label
   are joined before: a component lies within an angle of its smallest node, pairs of components that these bounds do not hold apart are compared in full, and linked ones
   become one. So a dense group of any size loses nothing and sends no pairs.
4. Audit: the links of a bounded sample of nodes are counted against all vectors, in blocks. If one is missing, lists and trees are doubled and the descent goes on.

Group sizes: a leaf chunk has ``chunk`` nodes, a local join 2k + 1, a pair of tiles twice the tile size; none grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusdiff.llm.common import stored
from corpusdiff.llm.components import connected_components

SEED = 11
CODE_BITS = 20


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of one key each, from batches sorted by it; a group is held as a whole."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch[key].to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if rest and rest[0][key][0].as_py() != keys[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        for i, j in zip(cuts, cuts[1:]):
            rest.append(batch.slice(i, j - i))
            if j < len(keys):
                yield pa.Table.from_batches(rest)
                rest = []
    if rest:
        yield pa.Table.from_batches(rest)


def _by_group(df: DataFrame, key: str, work: Callable[[pa.Table], list[np.ndarray] | None], schema: str) -> DataFrame:
    """``work`` for the rows of each key; it returns arrays for the columns of ``schema``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for group in _grouped(batches, key):
            made = work(group.combine_chunks())
            if made is not None and len(made[0]):
                held.append(made)
                rows += len(made[0])
            if rows > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)
                held, rows = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)

    return df.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(run, schema)


def _all_pairs(ids: np.ndarray, group: np.ndarray, vectors: np.ndarray, k: int) -> list[np.ndarray]:
    """The best ``k`` others of each row among the rows of its own group: node, other, cosine."""
    ids, first = np.unique(ids, return_index=True)
    group, unit = group[first], _unit(vectors[first])
    cosines = unit @ unit.T
    cosines[group[:, None] != group[None, :]] = -2
    np.fill_diagonal(cosines, -2)
    k = min(k, len(ids) - 1)
    if k < 1:
        return [ids[:0], ids[:0], cosines[:0, :0].ravel()]
    best = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    found = np.take_along_axis(cosines, best, axis=1)
    node, other = np.repeat(ids, k), ids[best.ravel()]
    keep = found.ravel() > -2
    return [node[keep], other[keep], found.ravel()[keep]]


def _nodes(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows as ``(id, node)``, node null where a vector links with nothing; and the nodes with group, size and smallest id."""
    v = F.col("v")
    norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & (norm > 0) & (norm < float("inf")), F.lit(False))
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    rows = stored(rows.withColumn("key", F.when(usable, F.sha2(F.concat_ws("|", F.to_json(F.struct("label")), F.to_json(F.struct("v"))), 256))), "vectors")
    nodes = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("size"), F.first("v").alias("v"), F.first("label").alias("label"))
    nodes = nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("group", F.xxhash64("label", F.size("v")))
    nodes = stored(nodes, "nodes")
    return rows.select("id", "key"), nodes


def _first_lists(nodes: DataFrame, k: int, trees: int, chunk: int) -> DataFrame:
    """Neighbours from leaves of sign patterns: ``(node, other, cosine)``."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.zeros((batch.num_rows, trees), np.int64)
            sizes = np.diff(batch["v"].offsets.to_numpy())
            for size in np.unique(sizes):  # rows of one length at a time
                at = np.flatnonzero(sizes == size)
                unit = _unit(_matrix(batch["v"].take(pa.array(at))))
                for tree in range(trees):
                    directions = np.random.default_rng((SEED, tree, int(size))).standard_normal((int(size), CODE_BITS))
                    made[at, tree] = (unit @ directions > 0) @ (1 << np.arange(CODE_BITS)[::-1])
            yield pa.RecordBatch.from_arrays([batch["node"], batch["group"], batch["v"], pa.array(list(made), pa.list_(pa.int64()))], ["node", "group", "v", "codes"])

    coded = nodes.select("node", "group", "v").mapInArrow(codes, "node long, group long, v array<double>, codes array<long>")
    sizes = stored(nodes.groupBy("group").count(), "group-sizes")
    bits = F.least(F.lit(CODE_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("count") / (chunk / 2))).cast("int")))
    leaves = coded.join(sizes.select("group", bits.alias("bits")), "group").select("node", "group", "v", "bits", F.posexplode("codes").alias("tree", "code"))
    leaf = F.xxhash64("group", "tree", F.expr(f"shiftright(code, {CODE_BITS} - bits)"))
    leaves = stored(leaves.select("node", "group", "v", leaf.alias("leaf")), "leaves")
    counts = stored(leaves.groupBy("leaf").agg(F.ceil(F.count("*") / chunk).alias("chunks")), "leaf-sizes")
    cut = leaves.join(counts, "leaf").withColumn("part", F.xxhash64("leaf", F.pmod(F.xxhash64("node"), F.col("chunks"))))

    def compare(t: pa.Table) -> list[np.ndarray] | None:
        if t.num_rows < 2:
            return None
        return _all_pairs(t["node"].to_numpy(), t["group"].to_numpy(), _matrix(t["v"].combine_chunks()), k)

    return _by_group(cut.select("part", "node", "group", "v"), "part", compare, "node long, other long, cosine double")


def _best(pairs: DataFrame, k: int) -> DataFrame:
    unique = pairs.groupBy("node", "other").agg(F.max("cosine").alias("cosine"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("cosine"), "other"))
    return unique.withColumn("place", place).filter(F.col("place") <= k).select("node", "other", "cosine")


def _descend(nodes: DataFrame, lists: DataFrame, k: int, change: float, threshold: float) -> DataFrame:
    """Rounds of local joins until at most the share ``change`` of the entries that are links is new in a round; 0 for none.

    Entries below the threshold go on improving for longer, but no result depends on them.
    """
    lists = stored(_best(lists, k), "lists")
    while not lists.isEmpty():
        hashed = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("node", "other")))
        back = lists.select(F.col("other").alias("node"), F.col("node").alias("other")).withColumn("place", hashed)
        around = lists.select("node", "other").union(back.filter(F.col("place") <= k).select("node", "other"))
        around = around.union(nodes.select("node", F.col("node").alias("other"))).withColumnRenamed("node", "center")
        worst = lists.groupBy("node").agg(F.when(F.count("*") >= k, F.min("cosine")).alias("worst"))
        members = stored(nodes.select("node", "group", "v").join(worst, "node", "left"), "members")
        around = around.join(members, around["other"] == members["node"]).select("center", "node", "group", "v", F.coalesce("worst", F.lit(-2.0)).alias("worst"))

        def improve(t: pa.Table) -> list[np.ndarray]:
            ids, worst = t["node"].to_numpy(), t["worst"].to_numpy()
            node, other, cosine = _all_pairs(ids, t["group"].to_numpy(), _matrix(t["v"].combine_chunks()), k)
            unique, first = np.unique(ids, return_index=True)
            keep = cosine > worst[first][np.searchsorted(unique, node)]
            return [node[keep], other[keep], cosine[keep]]

        found = _by_group(around, "center", improve, "node long, other long, cosine double")
        new = stored(_best(lists.union(found), k), "lists")
        near = new.filter(F.col("cosine") >= threshold)
        fresh = near.join(lists, ["node", "other"], "left_anti").count()
        lists = new
        if fresh <= change * near.count():
            break
    return lists


def _tile_count(rows: Column) -> Column:
    return F.greatest(F.least(F.lit(8), F.ceil(rows / 128)), F.ceil(rows / 4096)).cast("long")


def _tiled(members: DataFrame, key: str, *columns: str) -> DataFrame:
    """The rows of each ``key`` under each pair of their tile with another: task, own, a, b and ``columns``."""
    sizes = stored(members.groupBy(key).agg(F.count("*").alias("n")), "tile-sizes")
    placed = members.join(sizes.select(key, _tile_count(F.col("n")).alias("tiles")), key).withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda o: F.struct(F.least(o, "own").alias("a"), F.greatest(o, "own").alias("b")))
    return placed.withColumn("pair", F.explode(every)).select(
        F.xxhash64(key, "pair.a", "pair.b").alias("task"), "own", F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), *columns
    )


def _joined(members: DataFrame, threshold: float) -> DataFrame:
    """``(node, component)``: which of the components in ``members`` (component, node, group, v) a link joins, and the smallest of those joined."""
    centers = stored(members.filter(F.col("node") == F.col("component")).select("component", "group", F.col("v").alias("center")), "centers")

    def away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = np.zeros(batch.num_rows)
            sizes = np.diff(batch["v"].offsets.to_numpy())
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                v, c = (_unit(_matrix(batch[x].take(pa.array(at)))) for x in ("v", "center"))
                angles[at] = np.arccos(np.clip((v * c).sum(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([batch["component"], pa.array(angles)], ["component", "angle"])

    angles = members.select("component", "v").join(centers.select("component", "center"), "component").mapInArrow(away, "component long, angle double")
    reach = angles.groupBy("component").agg(F.max("angle").alias("reach"))
    balls = stored(centers.join(reach, "component").select(F.col("component").alias("node"), "group", F.col("center").alias("v"), "reach"), "balls")
    widest = float(np.arccos(threshold)) + 1e-6

    def close(t: pa.Table) -> list[np.ndarray]:
        own, a, b = (t[c].to_numpy() for c in ("own", "a", "b"))
        ids, reach, unit = t["node"].to_numpy(), t["reach"].to_numpy(), _unit(_matrix(t["v"].combine_chunks()))
        left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
        found = [(ids[:0], ids[:0])]
        for k in range(0, len(left), 1024):
            rows = left[k : k + 1024]
            near = np.arccos(np.clip(unit[rows] @ unit[right].T, -1, 1)) <= reach[rows][:, None] + reach[right][None, :] + widest
            if a[0] == b[0]:
                near &= ids[rows][:, None] < ids[right][None, :]
            x, y = np.nonzero(near)
            found.append((ids[rows[x]], ids[right[y]]))
        return [np.concatenate(c) for c in zip(*found)]

    pairs = stored(_by_group(_tiled(balls, "group", "node", "v", "reach"), "task", close, "x long, y long"), "close")
    sizes = stored(members.groupBy("component").agg(_tile_count(F.count("*")).alias("tiles")), "tile-sizes")
    placed = stored(members.join(sizes, "component").select("component", "node", "v", F.pmod(F.xxhash64("node"), F.col("tiles")).alias("own")), "placed")
    sides = []
    for side, (mine, theirs) in enumerate((("x", "y"), ("y", "x"))):
        against = pairs.join(sizes.select(F.col("component").alias(theirs), "tiles"), theirs).join(placed.withColumnRenamed("component", mine), mine)
        against = against.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        task = F.xxhash64("x", "y", *(("own", "with") if side == 0 else ("with", "own")))
        sides.append(against.select(task.alias("task"), "x", "y", F.lit(side).alias("side"), "v"))

    def meet(t: pa.Table) -> list[np.ndarray] | None:
        side, unit = t["side"].to_numpy(), _unit(_matrix(t["v"].combine_chunks()))
        left, right = unit[side == 0], unit[side == 1]
        for k in range(0, len(left), 1024):
            if (left[k : k + 1024] @ right.T >= threshold).any():
                return [t["x"].to_numpy()[:1], t["y"].to_numpy()[:1]]
        return None

    return connected_components(_by_group(sides[0].union(sides[1]), "task", meet, "x long, y long").distinct(), "x", "y")


def _tile_links(members: DataFrame, threshold: float) -> DataFrame:
    """Exact links inside each component: ``(node, links)``, links counting the rows of linked nodes. ``members``: component, node, size, v."""
    dealt = _tiled(members, "component", "node", "size", "v")

    def count(t: pa.Table) -> list[np.ndarray]:
        own, a, b = (t[c].to_numpy() for c in ("own", "a", "b"))
        ids, size, unit = t["node"].to_numpy(), t["size"].to_numpy(), _unit(_matrix(t["v"].combine_chunks()))
        left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
        links = np.zeros(len(ids), np.int64)
        for k in range(0, len(left), 1024):
            rows = left[k : k + 1024]
            linked = unit[rows] @ unit[right].T >= threshold
            linked &= ids[rows][:, None] != ids[right][None, :]
            links[rows] += linked @ size[right]
            if a[0] != b[0]:
                links[right] += size[rows] @ linked
        return [ids, links]

    counted = _by_group(dealt, "task", count, "node long, links long")
    return counted.groupBy("node").agg(F.sum("links").alias("links"))


def _audit(nodes: DataFrame, links: DataFrame, threshold: float, sample: int) -> float:
    """Found over true links of ``sample`` nodes, those with the smallest hashes, each compared with all nodes of its group in blocks.

    Cosines that rounding could take below the threshold do not count as true.
    """
    asked = nodes.orderBy(F.xxhash64("key")).limit(sample).select("node", "group", "v").collect()  # a bounded query set
    if not asked:
        return 1.0
    queries: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for group in {r["group"] for r in asked}:
        own = [r for r in asked if r["group"] == group]
        queries[group] = (np.array([r["node"] for r in own]), _unit(np.array([r["v"] for r in own])))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            groups = batch["group"].to_numpy()
            for group in np.unique(groups):
                if group not in queries:
                    continue
                at = np.flatnonzero(groups == group)
                ids, size = batch["node"].to_numpy()[at], batch["size"].to_numpy()[at]
                linked = queries[group][1] @ _unit(_matrix(batch["v"].take(pa.array(at)))).T >= threshold + 1e-12
                linked &= queries[group][0][:, None] != ids[None, :]
                for node, n in zip(queries[group][0].tolist(), (linked @ size).tolist()):
                    total[node] = total.get(node, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["node", "links"])

    true = nodes.select("node", "group", "size", "v").mapInArrow(compare, "node long, links long").groupBy("node").agg(F.sum("links").alias("truth"))
    both = true.join(links, "node", "left").agg(F.sum("truth").alias("t"), F.sum(F.least("truth", F.coalesce("links", F.lit(0)))).alias("f")).first()
    return both["f"] / both["t"] if both["t"] else 1.0


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, k: int = 16,
    trees: int = 8, change: float = 0.0, chunk: int = 64, audit_sample: int = 400, recall: float = 1.0,
) -> DataFrame:
    """``(id_col, n_links, component_id, kept)`` per row: linked rows, smallest id reachable, and whether that is the row's own id.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without label, link with nothing. Vectors of different lengths never
    link. Equal rows link with each other. A null id is kept only if it reaches no other. Other columns of ``df`` are not read.
    """
    rows, nodes = _nodes(df, id_col, vector_col, label_col)
    lists = None
    while True:
        first = _first_lists(nodes, k, trees, chunk)
        lists = _descend(nodes, first if lists is None else lists.union(first), k, change, threshold)
        links = stored(lists.filter(F.col("cosine") >= threshold).select("node", "other"), "near")
        both = stored(links.union(links.select("other", "node")).distinct(), "near")
        parts = stored(connected_components(both, "node", "other"), "components")
        full = stored(links.groupBy("node").count().filter(F.col("count") >= k).join(parts, "node").select("component").distinct(), "saturated")
        sparse = both.join(parts.join(full, "component", "left_anti"), "node").select("node", "other")
        dense = stored(parts.join(full, "component").join(nodes.select("node", "group", "size", "v"), "node").select("component", "node", "group", "size", "v"), "dense")
        joined = stored(_joined(dense, threshold).select(F.col("node").alias("component"), F.col("component").alias("whole")), "joined")
        parts = stored(parts.join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component")), "components")
        dense = dense.join(joined, "component", "left").select(F.coalesce("whole", "component").alias("component"), "node", "size", "v")
        sizes = nodes.select(F.col("node").alias("other"), "size")
        listed = sparse.join(sizes, "other").groupBy("node").agg(F.sum("size").alias("links"))
        counted = stored(listed.union(_tile_links(dense, threshold)), "link-counts")
        if _audit(nodes, counted, threshold, audit_sample) >= recall:
            break
        k, trees = 2 * k, 2 * trees
    named = nodes.select("node", "key", "first", "size").join(parts, "node", "left").join(counted, "node", "left")
    named = stored(named.withColumn("component", F.coalesce("component", "node")), "named")
    roots = stored(named.groupBy("component").agg(F.min("first").alias("root")), "roots")
    final = stored(named.join(roots, "component").select("key", "root", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "final")
    found = rows.join(final, "key", "left")
    own = F.coalesce(F.col("root"), F.col("id"))
    return found.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
        F.col("id").eqNullSafe(own).alias("kept"),
    )
