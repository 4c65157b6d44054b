import hashlib
import random

from tarn.llm import substring

from .helpers import documents


def brute(docs, width):
    first = {}
    for i, t in docs:
        w = (t or "").encode().split()
        for p in range(len(w) - width + 1):
            k = tuple(w[p : p + width])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in docs:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - width + 1):
            if i is not None and first[tuple(w[p : p + width])] < i:
                gone |= set(range(p, p + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(spark, docs, width):
    return sorted((tuple(r) for r in substring.report(documents(spark, docs).repartition(3), width).collect()), key=repr)


def test_against_brute_force(spark):
    r = random.Random(6)
    passages = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(8, 40))) for _ in range(6)]
    docs = []
    for i in range(80):
        docs.append((i, "  ".join(r.choice([*passages, " ".join(r.choice("xyzé") for _ in range(r.randint(1, 20)))]) for _ in range(r.randint(0, 5)))))
    docs += [(100 + k, docs[k][1]) for k in range(0, 40, 4)]  # copies
    for width in (10, 7, 2, 1):
        assert run(spark, docs, width) == brute(docs, width)


def test_defined_cases(spark):
    line = " ".join(f"w{i}" for i in range(60))
    docs = [(0, None), (1, ""), (2, line), (3, line), (3, line), (4, "x " * 100_000), (5, "y " + "x " * 60 + "z"), (6, line + " tail"), (7, " ".join(line.split()[:49]))]
    assert run(spark, docs, 50) == brute(docs, 50)
    assert run(spark, [], 50) == []
    got = {r["doc_id"]: r for r in substring.dedup(documents(spark, [(2, line), (6, "head " + line + " tail")]), 50).collect()}
    assert got[6]["kept"] == "head tail" and [tuple(s) for s in got[6]["spans"]] == [(1, 61)] and got[2]["spans"] == []


def test_rows_are_judged_apart(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    docs = [(1, a), (2, a), (2, b), (None, a), (None, b), (3, b + " end"), (4, "x " + b), (4, None)]
    assert run(spark, docs, 50) == brute(docs, 50)
    assert run(spark, [(1, a), (2, b), (None, a)], 50) == brute([(1, a), (2, b), (None, a)], 50)  # nothing survives


def test_levels_double():
    assert substring.lengths(50) == [13, 25, 50] and substring.lengths(2) == [1, 2] and substring.lengths(1) == [1]
    for width in range(1, 70):
        own = substring.lengths(width)
        assert own[-1] == width and all(b <= 2 * a for a, b in zip(own, own[1:]))
