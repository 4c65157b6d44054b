import hashlib
import random
import re

from tarn.llm import decontam

from .helpers import documents, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, width=10):
    out = []
    for i, t in docs:
        w, hit, got = words(t), set(), set()
        for item, text in items:
            g = words(text)
            n = min(width, len(g))
            for s in range(len(g) - n + 1) if g else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == g[s : s + n]:
                        hit |= set(range(p, p + n))
                        got.add(item)
        ids = ",".join(sorted(map(str, got)))
        out.append((i, len(w), len(hit), len(got), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS doc_id", "2 AS items")


def test_against_brute_force(spark):
    r = random.Random(9)
    text = lambda n: " ".join(r.choice("aa Bb cé d, e-f ßx 9".split()) for _ in range(n))
    items = [(i, text(r.randint(1, 25))) for i in range(12)]
    docs = [(i, text(r.randint(0, 40)) + " " + r.choice(items)[1].upper() + " " + text(5)) for i in range(60)]
    got = sorted((tuple(x) for x in decontam.report(documents(spark, docs), bench(spark, items)).drop("n_near").collect()), key=repr)
    assert got == brute(docs, items)
    blocks = decontam.find(documents(spark, docs), bench(spark, items), block_words=20)
    merged = sorted((x["doc_id"], x["n_hit"]) for x in blocks.select("doc_id", decontam.covered("spans").alias("n_hit")).collect())
    assert merged == sorted((x[0], x[2]) for x in brute(docs, items))


def test_defined_cases(spark):
    docs = [(None, "one two"), (None, None), (0, None), (1, ""), (2, "one two"), (2, "one two"), (3, "x " * 100_000 + "one two"), (4, "one"), (5, "two one")]
    items = [(7, "One, two!"), (7, "two one"), (8, None), (9, "..."), (None, "one")]
    real = [(i, t) for i, t in items if i is not None]
    got = sorted((tuple(x) for x in decontam.report(documents(spark, docs), bench(spark, items)).drop("n_near").collect()), key=repr)
    assert got == brute(docs, real)
    for d, i in (([], items), (docs, [])):
        got = sorted((tuple(x) for x in decontam.report(documents(spark, d), bench(spark, i)).drop("n_near").collect()), key=repr)
        assert got == brute(d, [x for x in i if x[0] is not None])


def test_proximity_and_dropping(spark):
    items = [(1, "a b c d")]
    docs = [(0, "a b c d"), (1, "a x b c d"), (2, "a b c"), (3, "d c b a x x")]
    close = {r["doc_id"]: r["items"] for r in decontam.find(documents(spark, docs), bench(spark, items), width=4, slop=1).collect()}
    assert close[0] == [1] and close[1] == [1] and close[2] == []
    kept = decontam.drop_contaminated(documents(spark, docs), bench(spark, items), width=4)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3] and kept.columns == documents(spark, docs).columns


def test_index_table(spark):
    import numpy as np

    shards = [s.asDict() for s in decontam.build_index(documents(spark, [(0, "a c A"), (1, "b, a"), (None, None)]).coalesce(1)).collect()]
    found = {}
    for s in shards:
        ends, counts = np.frombuffer(s["word_ends"], np.int64), np.frombuffer(s["counts"], np.int32)
        places = np.split(np.frombuffer(s["positions"], np.int32), np.cumsum(counts)[:-1])
        for k, own in enumerate(places):
            found[bytes(s["words"][ends[k - 1] if k else 0 : ends[k]]).decode()] = own.tolist()
    assert found == {"a": [0, 2, 4], "c": [1], "b": [3]} and shards[0]["doc_ids"] == [0, 1, None]
    assert np.frombuffer(shards[0]["sizes"], np.int64).tolist() == [3, 2, 0]


def near_items(docs, items, width, slop):
    out = []
    for i, t in docs:
        w, got = words(t), set()
        for item, text in items:
            g = words(text)
            n = min(width, len(g))
            for s in range(len(g) - n + 1) if g else ():
                for p in range(-slop, len(w) + slop):
                    if all(g[s + k] in w[max(0, p + k - slop) : max(0, p + k + slop + 1)] for k in range(n)):
                        got.add(item)
        out.append((i, sorted(got)))
    return sorted(out)


def test_proximity_against_brute_force(spark):
    r = random.Random(11)
    text = lambda n: " ".join(r.choice("a b c d e f g".split()) for _ in range(n))
    items, docs = [(i, text(r.randint(2, 9))) for i in range(8)], [(i, text(r.randint(0, 30))) for i in range(40)]
    for slop in (1, 2):
        got = decontam.find(documents(spark, docs), bench(spark, items), width=5, slop=slop)
        assert sorted((x["doc_id"], x["items"]) for x in got.collect()) == near_items(docs, items, 5, slop)
    got = decontam.matches(decontam.build_index(documents(spark, docs)), bench(spark, items), 5, (0, 2), block_words=7)
    assert sorted((x["doc_id"], x["near"]) for x in got.collect()) == near_items(docs, items, 5, 2)


def test_long_items_come_in_pieces(spark):
    r = random.Random(12)
    text = " ".join(f"w{r.randrange(30)}" for _ in range(300))
    docs = [(i, " ".join(text.split()[i * 7 : i * 7 + 14])) for i in range(40)]
    whole, blocks = ([(x["doc_id"], x["n_words"], x["spans"], x["items"]) for x in decontam.find(documents(spark, docs), bench(spark, [(5, text)]), block_words=n).collect()] for n in (10**6, 25))
    assert sorted(whole) == sorted(blocks) and all(x[3] == [5] for x in whole)


def test_blocks_report_each_row(spark):
    docs = [(2, "a b c d e f"), (2, "a b c d e f"), (2, "x x x x e f"), (3, "x x x"), (3, "a b x"), (3, "x x x"), (4, None), (5, "c d a b e f a b c d")]
    items = [(i, t) for i, t in enumerate(["a b", "c d", "e f", "b c d", "one two three", "d e"])]
    listed = lambda df: sorted((r["doc_id"], r["n_words"], [tuple(s) for s in r["spans"]], r["items"]) for r in df.collect())
    find = lambda n: listed(decontam.find(documents(spark, docs), bench(spark, items), block_words=n))
    whole = find(decontam.BLOCK_WORDS)
    assert sorted((i, n, sum(b - a for a, b in s), len(x)) for i, n, s, x in whole) == sorted((i, n, h, x) for i, n, h, x, _, _ in brute(docs, items))
    assert find(3) == find(8) == whole


def test_dropping_judges_each_row(spark):
    docs = [(None, "x a b c d"), (None, "clean"), (1, "a b c d"), (1, "clean too"), (2, None), (3, "f g h i"), (3, "a b c"), (None, None)]
    items = [(1, "a b c d"), (2, "f g h i"), (3, "one two three four")]
    df, kept = documents(spark, docs), [(None, "clean"), (1, "clean too"), (2, None), (3, "a b c"), (None, None)]
    for n in (decontam.BLOCK_WORDS, 3):
        out = decontam.drop_contaminated(df, bench(spark, items), 4, block_words=n)
        assert out.dtypes == df.dtypes and rows(out, "doc_id", "text") == sorted(kept, key=repr)
    assert decontam.drop_contaminated(documents(spark, []), bench(spark, items), 4).collect() == []
    assert decontam.drop_contaminated(df, bench(spark, []), 4).count() == len(docs)
