import random

import pytest

from tarn.llm import ngram_join

from .helpers import documents


def sets(t, k=5):
    w = (t or "").encode().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, threshold=0.8):
    s = [sets(t) for _, t in docs]
    ids = [i for i, _ in docs]
    links = {k: [j for j in range(len(docs)) if j != k and s[k] and s[j] and len(s[k] & s[j]) >= threshold * len(s[k] | s[j]) - 1e-9] for k in range(len(docs))}
    seen, out = {}, []
    for k in range(len(docs)):
        todo, group = [k], {k}
        while todo:
            for j in links[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        named = lambda of: min((ids[j] for j in of if ids[j] is not None), default=None)
        seen[k] = named(group)
        out.append((ids[k], named([k, *(j for j in links[k] if s[j] == s[k])]), seen[k], len(links[k])))
    return sorted(out, key=repr)


def near_corpus(seed, n=120):
    r = random.Random(seed)
    base = [[f"w{r.randrange(4000)}" for _ in range(r.randint(6, 90))] for _ in range(n // 6)]
    docs = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = f"x{r.randrange(9)}"
        docs.append((i, " ".join(w)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    docs = near_corpus(seed)
    if seed == 2:
        monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 4)  # split work groups
        monkeypatch.setattr(ngram_join, "NODE_BLOCK", 3)  # and nodes
    assert run(spark, docs) == brute(docs)


def run(spark, docs, **options):
    found = ngram_join.join(documents(spark, docs), **options)
    return sorted((tuple(r) for r in found.select("doc_id", "copy_id", "class_id", "n_links").collect()), key=repr)


def test_defined_cases(spark):
    docs = [(0, None), (1, ""), (2, "a b"), (3, "a  b"), (4, "a b c"), (5, "q " * 100_000), (6, "q " * 90_000), (7, "one two three four five six"), (7, "one two three four five six")]
    docs += [(8, "a b a b a b a b"), (9, "b a b a b a b a b"), (None, "a b"), (None, "alone here"), (None, "alone here")]
    docs += [(10, "p q r s t u v w"), (11, "p q r s t u v w"), (11, "not at all the same text as that"), (None, None)]
    assert run(spark, docs) == brute(docs)
    assert ngram_join.join(documents(spark, [])).collect() == []
    kept = ngram_join.keep_first(documents(spark, docs))
    want = [(0, None), (1, ""), (2, "a b"), (4, "a b c"), (5, "q " * 100_000), (7, "one two three four five six"), (8, "a b a b a b a b"), (None, "alone here"), (10, "p q r s t u v w"), (11, "not at all the same text as that"), (None, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert kept.columns == documents(spark, docs).columns


def test_exact_shingles_are_those_of_the_words():
    import numpy as np
    import pyarrow as pa

    from tarn.llm import _text

    r = random.Random(8)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(60)]
    _, _, data, bounds = next(_text.chunks(pa.array(texts)))
    doc, words, names = _text.word_codes(data, bounds, _text.NON_SPACE)
    assert [names[int(w)].as_py().decode() for w in words] == " ".join(texts).split()
    grams, owner = ngram_join.exact_shingles(words, doc, len(texts))
    own = [set(grams[owner == i]) for i in range(len(texts))]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(own[i] & own[j]) == len(sets(texts[i]) & sets(texts[j])), (texts[i], texts[j])
    assert np.all(np.diff(owner) >= 0)


def test_half_alike_texts_do_not_chain(spark):
    r = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    docs = [(i, " ".join([*base[:40], *(f"o{i}_{k}" for k in range(18))])) for i in range(300)]  # any two: 0.49
    rows, row = ngram_join._store.numbered(documents(spark, docs))
    classes = rows.select(row, "doc_id", "text").mapInArrow(ngram_join._sign(5, 20, 7), ngram_join._SIGNED).selectExpr("row AS rep", "labels")
    edges = ngram_join._met(classes, None, 5, 7, 0.8)
    assert edges.count() < 15  # of 44,850 pairs, about half of which share a node


def test_prefixes_are_shortened_until_the_target(spark):
    docs = near_corpus(5, 60)
    rows, row = ngram_join._store.numbered(documents(spark, docs))
    for target in (0.9, 0.99999):
        _, _, recalls = ngram_join._joined(rows, row, 5, 0.8, 20, 7, 0.9, target)
        assert recalls[0][0] == 7 and all(x < target for _, x in recalls[:-1])
        assert recalls[-1][1] >= target or recalls[-1][0] == ngram_join.prefix_length(0.8, 20, 7, target)
    assert len(recalls) > 1


def test_prefix_is_shortened_to_the_target():
    for trees, target in ((4, 0.9), (20, 0.9995), (50, 0.99)):
        d = ngram_join.prefix_length(0.8, trees, 12, target)
        recall = lambda n: 1 - (1 - 0.8**n) ** trees  # noqa: B023, E731
        assert recall(d) >= target or d == 1
        assert d == 12 or recall(d + 1) < target


def test_components(spark):
    chain = [(i + 1, i) for i in range(30)] + [(100, 101), (102, 101)]
    got = {r["node"]: r["first"] for r in ngram_join.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}
