import numpy as np

from lensframe.llm import neighbours as N


def exact(items, x, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    out = set()
    for i in range(len(items)):
        row = s[i].copy()
        row[i] = -9
        for j in np.lexsort((items, -row))[:k]:
            if row[j] >= least and j != i:
                out.add((int(items[i]), int(items[j])))
    return out


def test_hot_copies_and_clusters_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 16))
    x = centres[rng.integers(0, 12, 500)] + 0.15 * rng.standard_normal((500, 16))
    x = np.concatenate((x, np.repeat(x[:1], 200, 0), 3 * x[1:40])).astype(np.float32)
    items = rng.permutation(len(x)) + 1
    df = spark.createDataFrame([(int(i), [float(v) for v in r], "s") for i, r in zip(items, x)], "item_id bigint, vec array<float>, rep string")
    got = {(r.item, r.other) for r in N.nearest(df, "item_id", "vec", 16, 5, 0.8, block=64, probes=8, lists_most=16).collect()}
    want = exact(items, x.astype(np.float64), 5, 0.8)
    assert len(got & want) / len(want) >= 0.97 and len(got & want) / len(got) >= 0.97


def test_bad_vectors_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [None, 1.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "item_id bigint, vec array<float>")
    assert {tuple(r) for r in N.similar_pairs(df, "item_id", "vec", 2).collect()} == {(1, 2)}
    assert N.similar_pairs(df.limit(0), "item_id", "vec", 2).count() == 0
    assert N.similar_pairs(df.where("item_id = 1"), "item_id", "vec", 2).count() == 0


def test_scan_keeps_near_and_abandons_far():
    rng = np.random.default_rng(0)
    c = N._units(rng.standard_normal((2000, 64)))
    q = N._units(c[:50] + 0.05 * rng.standard_normal((50, 64)))
    rows, cols = N.scan_block(q, c, 5, 0.85, N.rotation(64))
    near = {(i, j) for i, j in zip(*np.nonzero(q @ c.T >= 0.85))}
    assert near <= set(zip(rows.tolist(), cols.tolist())) and len(rows) < 0.01 * q.shape[0] * c.shape[0]
