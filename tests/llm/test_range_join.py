"""The range join against all pairs, with pivots and blocks forced small."""

import numpy as np

from stateweave.llm.range_join import near_vectors


def plain(rows):
    sound = [(k, i, np.array(v, float), lab) for k, (i, v, lab) in enumerate(rows) if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    n, parent = [0] * len(rows), {i: i for i, _, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i, a, la in sound:
        for m, j, b, lb in sound:
            if k != m and la == lb and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                n[k] += 1
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, n[k], root(i), root(i) == i) for k, (i, _, _) in enumerate(rows))


def test_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 6))
    rows = [(i, (base[i % 12] + rng.normal(scale=0.18, size=6)).astype(np.float32).tolist(), i % 2) for i in range(260)]
    rows += [(300 + i, rows[0][1], 0) for i in range(20)]  # copies
    rows += [(400, None, 0), (401, [0.0] * 6, 0), (402, [float("nan")] * 6, 1), (403, [None, 1.0], 1), (404, rows[3][1], None), (405, [1.0, 2.0], 1), (406, [2.0, 4.0], 1), (407, [], 0), (408, [float("inf")] * 6, 0)]
    rows.append((5, rows[7][1], 1))  # a vec_id that comes twice
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, component_id string")
    for cell, block in ((2048, 2048), (20, 16)):
        got = sorted(tuple(r) for r in near_vectors(df, cell=cell, block=block).collect())
        assert got == plain(rows)


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
