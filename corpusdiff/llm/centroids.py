"""Clustering around centroids (Lloyd's rounds) with bounds that loosen by less than the centroids moved.

Components are integers, distances exact squared Euclidean ones, so a result does not depend on the order of any sum. Every vector carries its cluster, the
squared distance to that centroid and a lower bound of its distance to all others. After the centroids moved:

1. Each cluster lies in a sphere around its old centroid, whose radius is the largest distance in it. For each other centroid that moves from p to q, the sphere's centre,
   p and q span a plane, and no vector of the sphere comes nearer to that centroid by more than a path integral of cosines in this plane allows: on every
   stretch of the way the gain is at most its length times the cosine of the smallest angle between the way and the disc, seen from the stretch's start. That is never
   more than the full drift, and negative where the centroid moves away from the whole sphere.
2. A vector's lower bound loosens by the largest of its cluster's values. If the exact distance to its own centroid is below that bound, or below half of the way to the
   next centroid, it stays; the others are ambiguous and scanned exactly against all centroids.
3. Only vectors that changed cluster change the sums.

A round is one scan of a written table and one small aggregate; vectors are never shuffled. Centroids, spheres and bounds (``k`` rows, ``k`` squared numbers) go through the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusdiff.llm.common import discard, stored

#: Components up to this size have distances that fit 64-bit integers; larger ones are computed with Python's integers.
SMALL = 1 << 26
#: Components up to this size have products that are exact in double precision.
EXACT = 1 << 22
LIMB = 40
STRETCHES = 8
#: Bounds are rounded; this share of them is given up.
SLACK = 1e-9
LONG_MAX = (1 << 63) - 1


def whole_components(vectors: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of doubles, as 64-bit integers, or as Python's if one is large."""
    if not len(vectors) or np.abs(vectors).max() < SMALL / scale:
        return np.floor(vectors * scale).astype(np.int64)
    exact = [[math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale for x in row] for row in vectors.tolist()]
    return np.array(exact, object).reshape(vectors.shape)


def doubles(numbers: np.ndarray) -> np.ndarray:
    """Integers in double precision; what is too large is infinite."""
    if numbers.dtype != object:
        return numbers.astype(float)
    return np.array([float(x) if abs(x) < 10**300 else (math.inf if x > 0 else -math.inf) for x in numbers.ravel()], float).reshape(numbers.shape)


def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row per vector and a column per centroid."""
    if vectors.dtype == object or centroids.dtype == object:
        vectors, centroids = vectors.astype(object), centroids.astype(object)
        return np.array([[sum((x - c) ** 2 for x, c in zip(v, centroid)) for centroid in centroids] for v in vectors], object).reshape(len(vectors), len(centroids))
    most = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0))
    if most <= EXACT and vectors.shape[1] * 4 * most * most < 1 << 53:
        a, b = vectors.astype(float), centroids.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(1) for c in centroids], axis=1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray, stretches: int = STRETCHES) -> np.ndarray:
    """Entry (i, j): by how much at most the distance from a vector in the sphere of cluster i to centroid j shrinks as that moves from old to new."""
    k = len(old)
    out = np.zeros((k, k))
    for j in range(k):
        way = new[j] - old[j]
        drift = np.linalg.norm(way)
        if not drift:
            continue
        if not math.isfinite(drift):
            out[:, j] = math.inf
            continue
        for i in range(k):
            across = old[i] - old[j]
            along = across @ way / drift
            height = math.sqrt(max(across @ across - along * along, 0.0))
            for s in range(stretches):
                ahead = along - drift * s / stretches
                far = math.hypot(ahead, height)
                if not math.isfinite(far) or far <= radius[i] * (1 + SLACK):
                    cosine = 1.0
                else:
                    cosine = math.cos(max(math.atan2(height, ahead) - math.asin(radius[i] / far), 0.0))
                out[i, j] += drift / stretches * (cosine + SLACK)
    return out


class Move:
    """What a task needs to assign vectors: the centroids, and for known clusters how their bounds change."""

    def __init__(self, centroids: list[list[int]], bound_change: np.ndarray | None = None):
        wide = any(abs(x) > SMALL for c in centroids for x in c)
        self.centroids = np.array(centroids, object if wide else np.int64).reshape(len(centroids), -1)
        self.change = bound_change
        apart = np.sqrt(doubles(squared_distances(self.centroids, self.centroids)))
        np.fill_diagonal(apart, np.inf)
        self.half_way = apart.min(1) / 2 * (1 - SLACK)

    def scan(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster (of equal distances the smaller number), squared distance, and distance to the second nearest centroid."""
        found = squared_distances(vectors, self.centroids)
        cluster = found.argmin(1)
        rows = np.arange(len(vectors))
        least = found[rows, cluster]
        others = doubles(found)
        others[rows, cluster] = np.inf
        return cluster, least, np.sqrt(others.min(1)) * (1 - SLACK)

    def assign(self, vectors: np.ndarray, cluster: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cluster, squared distance, lower bound, and whether the vector was scanned against all centroids."""
        if cluster is None or self.change is None:
            return *self.scan(vectors), np.ones(len(vectors), bool)
        lower = lower - self.change[cluster] - SLACK * np.abs(lower)
        own = self.centroids[cluster]
        if vectors.dtype == object or own.dtype == object:
            least = np.array([sum((x - c) ** 2 for x, c in zip(v, w)) for v, w in zip(vectors, own)], object)
        else:
            least = ((vectors - own) ** 2).sum(1)
        unclear = ~(np.sqrt(doubles(least)) * (1 + SLACK) < np.maximum(lower, self.half_way[cluster]))
        at = np.flatnonzero(unclear)
        if len(at):
            cluster, least, lower = cluster.copy(), least.copy(), lower.copy()
            cluster[at], least[at], lower[at] = self.scan(vectors[at])
        return cluster, least, lower, unclear


def _bytes(vectors: np.ndarray) -> tuple[list[bytes | None], list[list[str] | None]]:
    """Small vectors as little-endian 32-bit integers, others as decimal numbers."""
    if vectors.dtype != object:
        raw = vectors.astype("<i4")
        return [row.tobytes() for row in raw], [None] * len(raw)
    small = [max(map(abs, v), default=0) <= SMALL for v in vectors.tolist()]
    return (
        [np.array(v.tolist(), "<i4").tobytes() if s else None for v, s in zip(vectors, small)],
        [None if s else [str(x) for x in v] for v, s in zip(vectors.tolist(), small)],
    )


def _vectors(batch: pa.RecordBatch, size: int) -> np.ndarray:
    packed, wide = batch["packed"], batch["wide"]
    if not packed.null_count:
        return np.frombuffer(b"".join(packed.to_pylist()), "<i4").astype(np.int64).reshape(-1, size)
    rows = [np.frombuffer(p, "<i4").tolist() if p is not None else [int(x) for x in w] for p, w in zip(packed.to_pylist(), wide.to_pylist())]
    return np.array(rows, object).reshape(-1, size)


def usable(df: DataFrame, vec_col: str, size: int) -> DataFrame:
    """Rows whose vector has exactly ``size`` components, none null or not finite."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter((F.size(vec_col) == size) & ~F.coalesce(bad, F.lit(True)))


def _state_schema(id_type: T.DataType) -> T.StructType:
    fields = [("id", id_type), ("packed", T.BinaryType()), ("wide", T.ArrayType(T.StringType())), ("cluster", T.IntegerType()), ("before", T.IntegerType()),
              ("distance", T.DecimalType(38, 0)), ("lower", T.DoubleType()), ("scanned", T.BooleanType())]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def _distance(least: np.ndarray) -> pa.Array:
    """Squared distances; those beyond 38 digits stand as the largest number of 38 digits."""
    if least.dtype != object:
        return pa.array(least).cast(pa.decimal128(38, 0))
    return pa.array([min(int(x), 10**38 - 1) for x in least], pa.decimal128(38, 0))


def _assigned(df: DataFrame, move: Move, size: int, schema: T.StructType, scale: int | None = None) -> DataFrame:
    """One pass: new clusters, distances and bounds. With ``scale`` the rows are (id, vector), else a state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if scale is not None:
                flat = batch["vector"].flatten().to_numpy(zero_copy_only=False).astype(float)
                vectors = whole_components(flat.reshape(-1, size), scale)
                packed, wide = _bytes(vectors)
                before = lower = None
            else:
                vectors = _vectors(batch, size)
                packed, wide = batch["packed"], batch["wide"]
                before, lower = batch["cluster"].to_numpy(), batch["lower"].to_numpy()
            cluster, least, bound, scanned = move.assign(vectors, before, lower)
            yield pa.RecordBatch.from_arrays([
                batch["id"], pa.array(packed, pa.binary()) if scale is not None else packed, pa.array(wide, pa.list_(pa.string())) if scale is not None else wide,
                pa.array(cluster.astype(np.int32)), pa.array(np.full(len(cluster), -1, np.int32) if before is None else before.astype(np.int32)),
                _distance(least), pa.array(bound.astype(float)), pa.array(scanned),
            ], schema.names)

    return df.mapInArrow(run, schema)


def _changed_sums(state: DataFrame, k: int, size: int) -> dict[tuple[int, int], int]:
    """By (cluster, component): what the vectors that changed cluster add and take away. Large numbers are summed in limbs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, size), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _vectors(batch, size)
            for column, sign in (("cluster", 1), ("before", -1)):
                of = batch[column].to_numpy()
                for c in np.unique(of[of >= 0]).tolist():
                    total[c] += sign * vectors[of == c].sum(0).astype(object)
        rows = []
        for c, at in zip(*np.nonzero(total)):
            rest, limb, sign = abs(int(total[c, at])), 0, 1 if total[c, at] > 0 else -1
            while rest:
                rows.append((int(c), int(at), limb, sign * (rest & ((1 << LIMB) - 1))))
                rest, limb = rest >> LIMB, limb + 1
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["cluster", "at", "limb", "part"])

    moved = state.filter("cluster <> before").select("packed", "wide", "cluster", "before")
    parts = moved.mapInArrow(run, "cluster long, at long, limb long, part long")
    out: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("cluster", "at", "limb").agg(F.sum("part").alias("part")).collect():  # k x size rows, a few times
        key = (r["cluster"], r["at"])
        out[key] = out.get(key, 0) + (r["part"] << (LIMB * r["limb"]))
    return out


def first_centroids(df: DataFrame, k: int, size: int, scale: int, seed: str) -> list[list[int]]:
    """The vectors of the ``k`` rows with the smallest hashes of seed and id; of equal hashes the smaller vector first."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = df.select(order.alias("hash"), F.col("vector").cast("array<double>").alias("vector")).orderBy("hash", "vector").limit(k).collect()
    return [[int(x) for x in whole_components(np.array([r["vector"]], float), scale)[0]] for r in rows]


def clusters(
    df: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: str = "1", id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """Per usable vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid (decimal numbers joined by commas), centroid_sha256, scanned (in the last pass).

    Usable are vectors of exactly ``size`` components, none null or not finite; others give no row. Components are ``floor(scale * x)``. Centroids start as the ``k`` vectors with the
    smallest sha256 of ``seed:id`` (a null id counts as empty; repeated rows count as often as they occur, of equal hashes the smaller vector comes first); with fewer vectors there
    are fewer centroids. A round assigns every vector to the nearest centroid (of equal ones the smaller number) and replaces each centroid that has vectors by the floor of their exact mean. Then
    vectors are assigned once more. Distances and inertia beyond the range of a long stand as its largest number. Other columns are not read; an empty table gives no rows.
    """
    if size < 1 or k < 1:
        raise ValueError("at least one centroid and one component are needed")
    id_type = df.schema[id_col].dataType
    schema = _state_schema(id_type)
    rows = usable(df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vector")), "vector", size)
    centroids = first_centroids(rows, k, size, scale, seed)
    move = Move(centroids) if centroids else None
    if move is None:
        return _result(df.sparkSession.createDataFrame([], schema), [], id_col)
    sums = np.zeros((len(centroids), size), object)
    state = stored(_assigned(rows, move, size, schema, scale), "vectors")
    for _ in range(rounds):
        for (c, at), change in _changed_sums(state, len(centroids), size).items():
            sums[c, at] += change
        seen = {r["cluster"]: r for r in state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far")).collect()}
        old = doubles(np.array(centroids, object))
        centroids = [[int(x) // seen[c]["n"] for x in sums[c]] if c in seen else centroids[c] for c in range(len(centroids))]
        radius = np.array([math.sqrt(float(seen[c]["far"])) * (1 + SLACK) if c in seen else 0.0 for c in range(len(centroids))])
        radius[radius >= 0.99e19] = np.inf  # the distance may have been cut to 38 digits
        loose = loosening(old, doubles(np.array(centroids, object)), radius)
        np.fill_diagonal(loose, -np.inf)
        change = loose.max(1) if len(centroids) > 1 else np.zeros(1)
        state, last = stored(_assigned(state, Move(centroids, change), size, schema), "vectors"), state
        discard(last)
    return _result(state, centroids, id_col)


def _result(state: DataFrame, centroids: list[list[int]], id_col: str) -> DataFrame:
    spark = state.sparkSession
    as_long = lambda c: F.least(c, F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")
    inertia = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(F.sum(F.least("distance", F.lit(LONG_MAX).cast("decimal(38,0)"))).alias("s")).collect()}
    total = min(sum(inertia.values()), LONG_MAX)
    texts = [",".join(map(str, c)) for c in centroids]
    of = spark.createDataFrame(
        [(c, min(inertia.get(c, 0), LONG_MAX), total, x, hashlib.sha256(x.encode()).hexdigest()) for c, x in enumerate(texts)],
        "cluster int, cluster_inertia long, inertia long, centroid string, centroid_sha256 string",
    )
    return state.select(F.col("id").alias(id_col), "cluster", as_long(F.col("distance")).alias("distance"), "scanned").join(F.broadcast(of), "cluster").select(
        id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256", "scanned"
    )
