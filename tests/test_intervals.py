import random

from lensframe.operators.intervals import DAY_MS, merge_intervals, periods_and_gaps


def brute(rows, longest=None):
    out = []
    by = {}
    for e, a, b in rows:
        if e is not None and a is not None and b is not None and a < b:
            by.setdefault(e, []).append((a, b))
    for e, spans in by.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [(e, "period", a, b) for a, b in merged]
        out += [(e, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:]) if longest is None or y[0] - x[1] <= longest]
    return sorted(out)


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, "e string, a bigint, b bigint")
    got = sorted(tuple(r) for r in periods_and_gaps(df, "e", "a", "b", **kw).collect())
    assert got == brute(rows, kw.get("longest_gap_ms"))


def test_overlap_nest_touch_and_gap(spark):
    d = DAY_MS
    base = 1_600_000_000_000
    rows = [("x", base, base + 5), ("x", base + 3, base + 4), ("x", base + 5, base + 9), ("x", base + 20, base + 21), ("y", base, base + 40 * d), ("y", base + d, base + 2 * d), ("y", base + 40 * d, base + 41 * d), ("y", base + 60 * d, base + 61 * d)]
    check(spark, rows + rows[:2])
    check(spark, rows, longest_gap_ms=10)


def test_defined_results_for_bad_rows(spark):
    base = 1_600_000_000_000
    check(spark, [(None, base, base + 1), ("x", None, base), ("x", base, None), ("x", base + 1, base), ("x", base, base), ("x", base, base + 1)])
    empty = spark.createDataFrame([], "e string, a bigint, b bigint, kind string")
    assert periods_and_gaps(empty, "e", "a", "b").count() == 0


def test_random_against_brute_force_across_chunks(spark):
    rng = random.Random(3)
    base = 1_500_000_000_000
    rows = []
    for _ in range(600):
        a = base + rng.randrange(0, 40) * 7 + rng.randrange(3)
        rows.append((rng.choice(["hot", "hot", "hot", "a", "b"]), a, a + rng.choice([1, 2, 3, 7, 30, 90])))
    for chunk in (5, 50, 10_000):
        df = spark.createDataFrame(rows, "e string, a bigint, b bigint")
        got = sorted((r.e, r.from_ms, r.to_ms) for r in merge_intervals(df, "e", "a", "b", chunk).collect())
        assert got == sorted((e, a, b) for e, k, a, b in brute(rows) if k == "period")
