import math
import random

from tarn.llm import topk


def brute(rows, k=20, every=20):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, w in good:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in good if i != q)[:k]
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS score", "2 AS rank", "3 AS v", "4 AS batch")
    return sorted(tuple(r) for r in topk.top_k(df.repartition(3), **options).collect())


def test_random_with_ties(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, [r.choice([0.0, 0.25, -0.5, r.uniform(-1, 1)]) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[40][1]) for i in range(60)]
    assert run(spark, rows) == brute(rows)
    monkeypatch.setattr(topk, "QUERIES_PER_PASS", 4)  # several passes
    assert run(spark, rows) == brute(rows)


def test_defined_cases(spark):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [2.0, 0.0]), (20, [1.0, 0.5])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(7, [1.0])]) == [] and run(spark, []) == []
    # a repeated query row is a query each, and no candidate of its own number
    twice = run(spark, [(0, [1.0]), (0, [1.0]), (1, [2.0])])
    assert twice == [(0, 1, 1, 64 * 128), (0, 1, 1, 64 * 128)]
    # shorter vectors are zero beyond their length; large values need more than 32 bits
    assert run(spark, [(0, [1.0, 1.0]), (1, [1.0]), (2, [3e6, 3e6])]) == [(0, 1, 2, 2 * 64 * 64 * 3_000_000), (0, 2, 1, 64 * 64)]


def test_large_components_are_exact(spark):
    # on both sides of what 32 bits, 64 bits and a long can hold
    for size in (2.0**24, 3.0e7, 2.0**30, 3.0e9, 2.0**31):
        rows = [(0, [size, 1.0]), (1, [size, 0.5]), (2, [-size, size]), (3, [0.0, size + 1]), (20, [1.0, 1.0])]
        want = [(q, r, i, max(-(2**63), min(2**63 - 1, s))) for q, r, i, s in brute(rows)]
        assert run(spark, rows) == want
    rows = [(0, [1e30, 1.0])] + [(i, [1e30 * i, 0.0]) for i in range(1, 40)] + [(50 + i, [-1e30 * i, 1.0]) for i in range(1, 40)]
    got = run(spark, rows, k=5)
    assert [(r, i) for q, r, i, s in got if q == 0] == [(1, 39), (2, 38), (3, 37), (4, 36), (5, 35)]
    assert all(s == 2**63 - 1 for q, _, _, s in got if q == 0)
