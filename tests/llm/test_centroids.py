import hashlib
import math

import numpy as np
import pytest

from corpusdiff.llm import centroids as c
from corpusdiff.llm.queries import op13_centroid_clustering


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").selectExpr("*", "'x' AS cluster", "1 AS id", "2 AS distance")


def plain(rows, k, rounds, size, scale=64, kind=np.float32):
    """The rules as they are written, with Python's integers."""
    kept = []
    for vec_id, v, _ in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(kind(x)) for x in v):
            exact = [float(kind(x)) for x in v]
            kept.append((vec_id, tuple(math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale for x in exact)))
    order = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centers = [list(v) for _, v in order[:k]]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, m)), j) for j, m in enumerate(centers))
    for _ in range(rounds):
        found = [nearest(v)[1] for _, v in kept]
        for j in range(len(centers)):
            own = [v for (_, v), f in zip(kept, found) if f == j]
            if own:
                centers[j] = [sum(x) // len(own) for x in zip(*own)]
    most = (1 << 63) - 1
    last = [(i, *nearest(v)) for i, v in kept]
    inertia = [sum(min(d, most) for _, d, f in last if f == j) for j in range(len(centers))]
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in centers]
    return sorted(str((i, f, min(d, most), min(inertia[f], most), min(sum(inertia), most), sha[f])) for i, d, f in last)


def got(df):
    return sorted(str(tuple(r[n] for n in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))) for r in df.collect())


@pytest.mark.parametrize("kind", ["float", "double"])
def test_equals_the_plain_rules(spark, kind):
    rng = np.random.default_rng(3)
    groups = rng.standard_normal((6, 8))
    rows = [(i, (groups[i % 6] + 0.3 * rng.standard_normal(8)).tolist(), 1) for i in range(400)]
    rows += [(400 + i, rows[7][1], 1) for i in range(150)] + [(9, rows[9][1], 1)] * 3  # copies, and rows that repeat
    rows += [(None, rows[11][1], 2), (990, None, 1), (991, rows[1][1][:7], 1), (992, [*rows[1][1], 0.0], 1), (993, [None] * 8, 1), (994, [math.nan] * 8, 1), (995, [math.inf] * 8, 1), (996, [], 1)]
    expected = plain(rows, 7, 4, 8, kind=np.float32 if kind == "float" else float)
    assert got(c.clusters(frame(spark, rows, kind).repartition(5), k=7, rounds=4, size=8)) == expected


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(i, [float(i % 3), 0.0], 1) for i in range(30)]  # more centroids than different vectors
    assert got(c.clusters(frame(spark, rows), k=12, rounds=3, size=2)) == plain(rows, 12, 3, 2)
    assert got(c.clusters(frame(spark, rows[:2]), k=12, rounds=3, size=2)) == plain(rows[:2], 12, 3, 2)
    assert got(c.clusters(frame(spark, rows), k=1, rounds=2, size=2)) == plain(rows, 1, 2, 2)


def test_numbers_of_any_size(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.standard_normal(4) * 10.0 ** (i % 5 * 9)).tolist(), 1) for i in range(60)]
    assert got(c.clusters(frame(spark, rows), k=5, rounds=3, size=4)) == plain(rows, 5, 3, 4)
    rows += [(100 + i, (rng.standard_normal(4) * 10.0**307).tolist(), 1) for i in range(20)]
    assert got(c.clusters(frame(spark, rows, "double"), k=5, rounds=3, size=4)) == plain(rows, 5, 3, 4, kind=float)


def test_an_empty_table_gives_no_rows(spark):
    found = c.clusters(frame(spark, [(1, [1.0], 1)]).limit(0))
    assert found.count() == 0 and found.columns[:2] == ["vec_id", "cluster"]


def test_bounds_hold_and_are_tighter_than_the_drift():
    rng = np.random.default_rng(1)
    tighter = total = 0
    for _ in range(60):
        old = rng.standard_normal((5, 3)) * rng.choice([1, 4])
        new = old + rng.standard_normal((5, 3)) * rng.choice([0.01, 0.3, 2])
        new[2] = old[2]
        radius = rng.uniform(0, 2, 5)
        loose = c.loosening(old, new, radius)
        drift = np.linalg.norm(new - old, axis=1)
        assert (loose <= drift * (1 + 1e-6) + 1e-12).all()
        tighter += (loose < 0.9 * drift).sum()
        total += loose.size
        for i in range(5):
            way = rng.standard_normal((400, 3))
            points = old[i] + way / np.linalg.norm(way, axis=1, keepdims=True) * radius[i] * rng.uniform(0, 1, (400, 1)) ** 0.2
            for j in range(5):
                shrunk = np.linalg.norm(points - old[j], axis=1) - np.linalg.norm(points - new[j], axis=1)
                assert shrunk.max() <= loose[i, j] + 1e-9
    assert tighter > total / 3


def test_most_vectors_of_clear_groups_are_not_scanned_again(spark):
    rng = np.random.default_rng(5)
    groups = 4 * rng.standard_normal((4, 8))
    rows = [(i, (groups[i % 4] + 0.2 * rng.standard_normal(8)).tolist(), 1) for i in range(400)]
    found = c.clusters(frame(spark, rows), k=4, rounds=3, size=8).collect()
    assert sum(r["scanned"] for r in found) < 200


def test_the_query_equals_the_plain_rules(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"], 1) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(op13_centroid_clustering(spark, sf_dir)) == plain(rows, 16, 3, 64)
