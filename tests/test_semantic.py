import math
import random

from lensframe.operators import semantic

COLS = "id bigint, v array<float>"


def test_each_query_gets_its_own_top(spark):
    rng = random.Random(3)
    data = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(100, [0.0] * 4), (101, [1.0, 2.0]), (102, [2.0, 4.0]), (103, None), (104, [None, 1.0]), (105, [])]
    data += [(200 + i, data[7][1]) for i in range(5)]  # equal ones rank by key
    store = spark.createDataFrame(data, COLS)
    kept = store.collect()
    asked = [r for r in kept if r.id in (0, 7, 20, 100, 101, 103)]

    def like(a, b):
        norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / norm, 5) if norm else 0.0

    want = set()
    for q in asked:
        if q.v is not None:
            all_ = [(like(q.v, r.v), r.id) for r in kept if r.v is not None and None not in r.v and len(r.v) == len(q.v)]
            want |= {(q.id, i, s) for s, i in sorted(all_, key=lambda x: (-x[0], x[1]))[:4]}
    for block in (7, 2_048):
        got = semantic.cosine_topk_each(spark.createDataFrame(asked, COLS), store, "v", "id", 4, block)
        assert {tuple(r) for r in got.collect()} == want
    one = semantic.cosine_topk(list(kept[7].v), store, "v", "id", 4)
    assert {(7, *r) for r in one.collect()} == {w for w in want if w[0] == 7}
    assert semantic.cosine_topk_each(store.limit(0), store, "v", "id").count() == 0
