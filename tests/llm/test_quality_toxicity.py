import random
import zlib

import pytest

from tarn.llm import quality, toxicity

from .helpers import documents

WORDS = "the and of stone river green quiet window morning paper table light".split()


def corpus(n=400, seed=8):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text = " ".join(r.choice(WORDS) for _ in range(r.randint(3, 80))) + "."
        bad, toxic = r.random() < 0.3, r.random() < 0.3
        if bad:
            text = r.choice([text.upper().replace(" ", "!! "), " ".join(w + "%%%" for w in text.split()), " ".join([r.choice(WORDS)] * 60)])
        elif toxic:
            w = text.split()
            w.insert(r.randrange(len(w)), r.choice(["blorgish", "blorging", "blorged"]) + " " + r.choice(["blorgster", "blorgy"]))
            text = " ".join(w)
        rows.append((i, text))
        labels.append((i, int(not bad), int(toxic and not bad)))
    return rows, labels


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = corpus()
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").selectExpr("*", "1 AS text", "2 AS score"), labels


@pytest.mark.parametrize(("module", "column"), [(quality, 1), (toxicity, 2)])
def test_held_out_accuracy(tables, module, column):
    docs, labels, truth = tables
    got = {r["doc_id"]: r for r in module.classify(docs, labels).collect()}
    assert len(got) == len(truth)
    held = [t for t in truth if zlib.crc32(str(t[0]).encode()) % 5 == 0]
    assert {t[0] for t in held} == {i for i, r in got.items() if r["held_out"]}
    assert sum(got[t[0]]["predicted"] == t[column] for t in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= module.THRESHOLD) for r in got.values())


@pytest.mark.parametrize("module", [quality, toxicity])
def test_defined_cases(spark, tables, module):
    _, labels, _ = tables
    rows = [(0, None), (1, ""), (1, ""), (None, "the stone"), (2, "word " * 60_000), (3, "\x00\n \t"), (4, "é" * 5000)]
    train = documents(spark, corpus()[0] + rows)
    got = module.classify(train, labels).collect()
    assert len(got) == 407 and all(0 <= r["score"] <= 1 for r in got)
    few = documents(spark, [(1, "a"), (2, "b")])
    none = labels.limit(0)
    assert {r["score"] for r in module.classify(few, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 1), (1, None, None), (None, 1, 1), (2, 7, 7)], "doc_id bigint, quality int, toxic int")
    assert {r["score"] for r in module.classify(few, one).collect()} == {1.0}
    assert module.classify(few.limit(0), labels).collect() == []


def test_labels_of_the_held_out_fold_do_not_count(spark, tables):
    docs, labels, truth = tables
    flipped = spark.createDataFrame([(i, (1 - q) if zlib.crc32(str(i).encode()) % 5 == 0 else q, (1 - t) if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in truth], "doc_id bigint, quality int, toxic int")
    for module in (quality, toxicity):
        a = sorted((r["doc_id"], round(r["score"], 9)) for r in module.classify(docs, labels).collect())
        b = sorted((r["doc_id"], round(r["score"], 9)) for r in module.classify(docs, flipped).collect())
        assert a == b


def test_keep_good(spark, tables):
    docs, labels, truth = tables
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert sum((t[0] in ids) == bool(t[1]) for t in truth) / len(truth) > 0.97


def best_segments(place, score, n, cost):
    """The maximal segments by their definition, by brute force over all sub-sequences."""
    x = [-cost] * n
    for p, s in zip(place, score):
        x[p] = s
    out = []

    def split(lo, hi):
        best = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += x[j]
                if total > 1e-12 and (best is None or total > best[0] + 1e-9):
                    best = (total, i, j + 1)
        if best:
            split(lo, best[1])
            out.append(best)
            split(best[2], hi)

    split(0, n)
    return out


def test_segments_are_maximal():
    import numpy as np

    r = random.Random(3)
    for _ in range(200):
        n = r.randint(1, 25)
        place = sorted(r.sample(range(n), r.randint(0, min(6, n))))
        score = [r.choice([0.5, 1.0, 2.5, r.uniform(0.1, 3)]) for _ in place]
        got = toxicity.segments(np.array(place, int), np.array(score), 0.3)
        want = best_segments(place, score, n, 0.3)
        assert sum(s for s, _, _ in got) == pytest.approx(sum(s for s, _, _ in want))
        assert max((s for s, _, _ in got), default=0) == pytest.approx(max((s for s, _, _ in want), default=0))


def test_passages(spark, tables):
    docs, labels, _ = tables
    rows = [r for r in toxicity.find(docs, labels).collect() if r["predicted"]]
    assert rows and all(s["first"] < s["last"] for r in rows for s in r["segments"])


def test_scan_is_linear():
    import time

    import numpy as np

    r = random.Random(5)

    def seconds(n):
        place = np.arange(n) * 40  # each hit is a segment of its own
        score = np.array([r.uniform(0.5, 1.5) for _ in range(n)])
        began = time.perf_counter()
        assert len(toxicity.segments(place, score)) == n
        return time.perf_counter() - began

    small, large = min(seconds(20_000) for _ in range(3)), min(seconds(80_000) for _ in range(3))
    assert large < 10 * small + 0.05


def test_copies_count_once_whatever_their_order(spark, tables):
    docs, labels, truth = tables
    rows = corpus()[0]
    more = [(1000 + i, rows[i % 40][1]) for i in range(400)]  # copies, many of them in other folds
    train = spark.createDataFrame([*truth, *((1000 + i, truth[i % 40][1], truth[i % 40][2]) for i in range(400))], "doc_id bigint, quality int, toxic int")
    a, b = (sorted((r["doc_id"], r["score"]) for r in toxicity.classify(documents(spark, order), train).collect()) for order in (rows + more, more[::-1] + rows[::-1]))
    assert all(x[0] == y[0] and abs(x[1] - y[1]) < 1e-9 for x, y in zip(a, b, strict=True))


def test_discriminant_against_densities():
    import numpy as np

    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(80, 5)) @ rng.normal(size=(5, 5)), 1.5 + rng.normal(size=(50, 5))])
    y = np.array([0.0] * 80 + [1.0] * 50)
    model = quality.Discriminant.fit(x, y, 0.2, 0.3)

    def log_density(k, row):
        own = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
        pooled = (80 * own[0] + 50 * own[1]) / 130
        c = 0.8 * own[k] + 0.2 * pooled
        c = 0.7 * c + 0.3 * np.diag(np.diag(c)) + 1e-4 * np.eye(5)
        gap = row - x[y == k].mean(axis=0)
        return np.log((80, 50)[k] / 130) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * gap @ np.linalg.inv(c) @ gap

    d = np.array([log_density(1, row) - log_density(0, row) for row in x])
    assert np.allclose(model.difference(x), np.sign(d) * np.log1p(np.abs(d)))


def statistics_by_hand(text):
    """The transformed statistics of one text, in plain Python."""
    import math

    raw = (text or "").encode()
    words = raw.split()
    kinds = lambda f: sum(map(f, raw))
    upper, digits = kinds(lambda c: 65 <= c <= 90), kinds(lambda c: 48 <= c <= 57)
    lower, white, marks = kinds(lambda c: 97 <= c <= 122 or c >= 128), kinds(lambda c: c == 32 or 9 <= c <= 13), kinds(lambda c: c in b".,;:'\"()-?")
    is_other = lambda c: not (65 <= c <= 90 or 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c == 32 or 9 <= c <= 13 or c in b".,;:'\"()-?")
    fold = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    n, share = len(words), lambda x, of, usual: math.log((x + 20 * usual) / (of + 20))
    chars = max(len(raw) - white, 1)
    return [
        math.log1p(n), share(len(raw) - white, n, 5.0), share(upper, chars, 0.03), share(digits, chars, 0.002), share(marks, n, 0.2), share(kinds(is_other), n, 0.01), math.log1p(len(set(fold))) - math.log1p(n),
        share(sum(a == b for a, b in zip(fold, fold[1:])), n, 0.01), share(raw.count(b"\n"), n, 0.02), share(sum(len(w) <= 3 for w in words), n, 0.3), share(sum(is_other(w[-1]) for w in words), n, 0.01),
        math.log1p(len(set(zip(fold, fold[1:])))) - math.log1p(n),
    ]


def test_statistics_against_brute_force():
    import numpy as np
    import pyarrow as pa

    texts = [t for _, t in corpus(60)[0]] + [None, "", " ", "a", "A a a!", "é É 12\n3 ###", "x\ty\x0bz"]
    assert np.allclose(quality.statistics(pa.array(texts)), [statistics_by_hand(t) for t in texts])
