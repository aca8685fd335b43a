import math

import numpy as np

from corpusdiff.llm import nn_descent as n


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS node", "'x' AS v")


def plain(rows, threshold=0.98):
    usable = []
    for k, (_, v, label) in enumerate(rows):
        good = label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        usable.append(np.array(v, np.float32).astype(float) if good else None)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = usable[i], usable[j]
            if a is None or b is None or rows[i][2] != rows[j][2] or len(a) != len(b):
                continue
            if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted(str((rows[i][0], links[i], least.get(find(i)), rows[i][0] == least.get(find(i)))) for i in range(len(rows)))


def got(df):
    return sorted(str((r["vec_id"], r["n_links"], r["component_id"], r["kept"])) for r in df.collect())


def test_links_equal_brute_force_with_dense_groups(spark):
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for size in [1] * 150 + [2] * 10 + [7, 30, 120]:
        center = rng.standard_normal(16)
        for _ in range(size):
            rows.append((k, (center + 0.02 * rng.standard_normal(16)).astype(np.float32).tolist(), k % 2 if size == 1 else 1))
            k += 1
    rows += [(k + i, rows[5][1], rows[5][2]) for i in range(40)]  # exact copies
    assert got(n.near_duplicates(frame(spark, rows), k=8, trees=6, chunk=32)) == plain(rows)


def test_dense_groups_that_only_touch_are_one_component(spark):
    rng = np.random.default_rng(6)
    one, other, alone = np.linalg.qr(rng.standard_normal((16, 3)))[0].T
    rows = []
    for angle in (0.0, 0.16):  # a cosine of 0.987 between the groups, nearly 1 inside
        for _ in range(40):
            v = np.cos(angle) * one + np.sin(angle) * other + 0.002 * rng.standard_normal(16)
            rows.append((len(rows), v.astype(np.float32).tolist(), 1))
    rows += [(len(rows) + i, (alone + 0.002 * rng.standard_normal(16)).astype(np.float32).tolist(), 1) for i in range(40)]
    rows += [(len(rows) + i, rows[i][1], 2) for i in range(40)]
    assert got(n.near_duplicates(frame(spark, rows), audit_sample=0)) == plain(rows)


def test_awkward_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1),
        (8, [1.0, float("nan")], 1), (9, [1.0, float("inf")], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.001], 2), (11, [1.0, 0.001], 2), (12, [1.0, 0.001], 1), (13, [1.0, 0.0], 3),
    ]
    assert got(n.near_duplicates(frame(spark, rows))) == plain(rows)
    assert n.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_a_null_id_never_names_a_component(spark):
    rows = [(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1)]
    assert got(n.near_duplicates(frame(spark, rows))) == ["(4, 1, 4, True)", "(None, 1, 4, False)"]
