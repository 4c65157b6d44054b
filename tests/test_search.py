import asyncio
import math
import random

import pytest
from pyspark.sql import functions as F

from tarn.functions.scoring import BM25, Dot
from tarn.operators import approx, evaluate, transforms
from tarn.operators import search as search_module
from tarn.operators.index import BuildOptions, dense, from_impacts, from_positions, from_text
from tarn.operators.search import from_map, search, search_async, search_text, search_wand
from tarn.operators.segments import SegmentedIndex
from tarn.plans.analyzer import Analyzer, chain, pipeline


def collection(seed=3, n=120, vocabulary=40):
    r = random.Random(seed)
    return [(d, sorted({int(r.random() ** 2 * vocabulary) for _ in range(r.randint(0, 15))})) for d in range(n)], r


@pytest.fixture(scope="module")
def impacts(spark):
    docs, r = collection()
    rows = [(d, [str(t) for t in terms], [round(r.uniform(0.05, 5), 3) for _ in terms]) for d, terms in docs if terms]
    index = from_impacts(spark.createDataFrame(rows, "doc_id bigint, terms array<string>, values array<double>"), BuildOptions(dtype="float64"))
    queries = {q: {str(r.randrange(45)): r.uniform(0.5, 1.5) for _ in range(r.randint(2, 7))} for q in range(8)}
    return index, rows, queries


def brute(rows, queries, k, keep=lambda d: True):
    out = {}
    for q, weights in queries.items():
        s = [(-round(sum(weights.get(t, 0) * v for t, v in zip(terms, values)), 9), d) for d, terms, values in rows if keep(d)]
        out[q] = [(d, round(-x, 6)) for x, d in sorted(x for x in s if x[0] < 0)[:k]]
    return out


def as_map(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append((r["doc_id"], round(r["score"], 6)))
    return out


def test_exact_search(impacts):
    index, rows, queries = impacts
    table = from_map(index, queries)
    want = brute(rows, queries, 10)
    assert as_map(search(index, table, 10)) == want
    assert as_map(search_wand(index, table, 10, width=8)) == want
    with pytest.MonkeyPatch.context() as m:
        m.setattr(search_module, "BATCH", 3)  # joined instead
        assert as_map(search(index, table, 10)) == want
        m.undo()
        m.setattr(search_module, "CELLS", 200)  # a few queries at once
        m.setattr(search_module, "PUSHED", 5)
        assert as_map(search_wand(index, table, 3, width=4)) == brute(rows, queries, 3)
    negative = from_map(index, {0: {"1": -1.0, "2": 2.0, "7": 0.5}})
    assert as_map(search_wand(index, negative, 10, width=4)) == brute(rows, {0: {"1": -1.0, "2": 2.0, "7": 0.5}}, 10)
    got = asyncio.run(search_async(index, table, 10))
    assert len(got) == sum(map(len, want.values()))
    with pytest.raises(ValueError, match="k must"):
        search(index, table, 0)


def test_filters(impacts):
    index, rows, queries = impacts
    table = from_map(index, queries)
    gone = list(range(0, 120, 3))
    assert as_map(search(index, table, 10, deleted=gone)) == {q: h for q, h in brute(rows, queries, 10, lambda d: d % 3 != 0).items() if h}
    mask = [d % 2 == 0 for d in range(120)]
    assert as_map(search(index, table, 10, allowed=mask, deleted=gone)) == {q: h for q, h in brute(rows, queries, 10, lambda d: d % 2 == 0 and d % 3 != 0).items() if h}


def test_bm25_against_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(r.choice(words[: r.randint(2, 30)]) for _ in range(r.randint(0, 40))) for _ in range(80)]
    docs = spark.createDataFrame([(2 * i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")  # odd numbers are gaps
    index = from_text(docs, Analyzer("pisa"))
    n, lengths = 159, {2 * i: len(t.split()) for i, t in enumerate(texts)}
    assert index.stats().n == n and dense(index.docs).count() == n and index.stats().min_dl == 0
    avg = sum(lengths.values()) / n
    query = {"w1": 2.0, "w3": 1.0, "w20": 0.5}
    scores = {}
    for w, weight in query.items():
        df = sum(w in t.split() for t in texts)
        idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
        for i, t in enumerate(texts):
            if tf := t.split().count(w):
                scores[2 * i] = scores.get(2 * i, 0) + weight * idf * tf / (1.2 * (0.25 + 0.75 * lengths[2 * i] / avg) + tf)
    want = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:10]
    got = search(index, from_map(index, {1: query}), 10, BM25()).collect()
    assert [r["doc_id"] for r in got] == [d for d, _ in want]
    assert [r["score"] for r in got] == pytest.approx([s for _, s in want])
    same = search_wand(index, from_map(index, {1: query}), 10, BM25(), width=16).collect()
    assert [r["doc_id"] for r in same] == [d for d, _ in want]


def test_build_checks(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, terms array<string>, values array<double>")
    for rows, message in (([(0, ["a"], [0.0])], "greater than zero"), ([(0, ["a", "a"], [1.0, 2.0])], "more than once"), ([(0, ["a", "b"], [1.0])], "differ in length")):
        with pytest.raises(Exception, match=message):
            from_impacts(frame(rows)).postings.collect()
    bad = spark.createDataFrame([(0, ["a"], [[3, 1]])], "doc_id bigint, terms array<string>, positions array<array<int>>")
    with pytest.raises(Exception, match="increasing"):
        from_positions(bad).postings.collect()
    with pytest.raises(ValueError, match="dtype"):
        BuildOptions(dtype="x")


def test_empty_collection(spark):
    index = from_text(spark.createDataFrame([], "doc_id bigint, text string"), Analyzer("pisa"))
    assert index.stats().n == 0 and search(index, from_map(index, {1: {"a": 1.0}}), 5, BM25()).collect() == []


def test_pipelines(spark):
    assert pipeline() is None
    p = pipeline("pyserini")
    assert (p.tokenizer, p.stemmer, p.position_gaps, len(p.stop_words)) == ("lucene-english", "porter", True, 33)
    t = pipeline("terrier-pisa")
    assert t.stop_words == () and "the" in t.query_stop_words
    assert pipeline(stemmer="porter", stop_words=["x"]).stop_mode == "both"
    assert Analyzer.from_json(p.to_json()) == p
    docs = spark.createDataFrame([(0, "The running dogs")], "doc_id bigint, text string")
    assert sorted(r["term"] for r in p.tokens(docs).collect()) == ["dog", "run"]
    index = from_text(docs, t)
    assert {r["term"] for r in index.postings.collect()} == {"the", "run", "dog"}
    got = search_text(index, spark.createDataFrame([(1, "the dog")], "qid bigint, text string"), 5, model=Dot()).collect()
    assert [r["score"] for r in got] == [1.0]
    assert chain("de").stemmer == "german"
    with pytest.raises(ValueError, match="analyzer"):
        chain("estonian")


def test_vocabulary(spark):
    docs = spark.createDataFrame([(0, "b a b"), (1, "c a")], "doc_id bigint, text string")
    index = from_text(docs, Analyzer("pisa"), BuildOptions(positions=True, dtype="int32"))
    assert {r["term"]: r["term_id"] for r in index.vocabulary().collect()} == {"b": 0, "a": 1, "c": 2}


def test_blocks_and_split(impacts):
    index, rows, queries = impacts
    lists = {}
    for d, terms, values in rows:
        for t, v in zip(terms, values):
            lists.setdefault(t, []).append((d, v))
    got = transforms.blocks(index.postings, 4).collect()
    assert len(got) == sum(-(-len(x) // 4) for x in lists.values())
    for b in got:
        part = lists[b["term"]][4 * b["block_no"] : 4 * b["block_no"] + 4]
        assert (b["doc_ids"], b["max_value"]) == ([d for d, _ in part], max(v for _, v in part))
    for r in transforms.split_thresholds(index.postings, [0.5, 1.0]).collect():
        v = sorted(x for _, x in lists[r["term"]])
        assert r["thresholds"] == [v[int(0.5 * len(v))], None]
    with pytest.raises(ValueError, match="quantiles"):
        transforms.split_thresholds(index.postings, [0.9, 0.1])


def test_quantiser(impacts):
    index, _, _ = impacts
    p = transforms.quantizer(index.postings, 8)
    worst = transforms.quantized(index.postings.withColumn("was", F.col("value")), p).agg(F.max(F.abs(F.col("was") - F.col("value")))).first()[0]
    assert worst <= p.step / 2 + 1e-9
    assert transforms.clamped(index.postings, p) == 0
    with pytest.raises(ValueError, match="range"):
        transforms.QuantizerParams(8, 1.0, 1.0)
    _, report = transforms.compress(index, 4)
    assert report["params"].nbits == 4 and transforms.quantizer(index.postings, 8, reference=report["params"]).nbits == 4


def test_compose_and_guards(spark, impacts):
    index, _, _ = impacts
    halves = lambda df: df.where("value >= 2")
    assert transforms.int_packed(index.postings, sink=halves).count() == index.postings.withColumn("value", F.round("value")).where("value >= 2").count()
    positional = from_text(spark.createDataFrame([(0, "a b")], "doc_id bigint, text string"), Analyzer("pisa"), BuildOptions(positions=True, dtype="int32"))
    with pytest.raises(ValueError, match="lossless"):
        transforms.compress(positional, 8)
    with pytest.raises(ValueError, match="codec"):
        transforms.compress(index, 0, codec="x")
    same, report = transforms.compress(index, 0, codec="pfor")
    assert report["clamped"] == 0 and same.postings.count() == index.postings.count()


def test_reorder(spark):
    r = random.Random(1)
    rows = [(d, sorted({f"{d % 4}-{r.randrange(12)}" for _ in range(8)} | {f"n{r.randrange(50)}"})) for d in range(400)]
    docs = spark.createDataFrame([(d, t, [1.0] * len(t)) for d, t in rows], "doc_id bigint, terms array<string>, values array<double>")
    index = from_impacts(docs)
    m = transforms.reorder_map(index, leaf=16).collect()
    assert sorted(x["new_id"] for x in m) == sorted(x["doc_id"] for x in m) == list(range(400))
    mapping = spark.createDataFrame([(x["new_id"], x["doc_id"]) for x in m], "new_id bigint, doc_id bigint")
    before = transforms.log_gap(index.postings).first()[0]
    assert transforms.log_gap(transforms.renumbered(index.postings, mapping)).first()[0] < 0.9 * before


def test_approximate_is_exact_when_nothing_is_pruned(impacts):
    index, rows, queries = impacts
    table = from_map(index, queries)
    built = approx.PrunedIndex.build(index, n_postings=10**6, centroid_fraction=0.3, knn=3)
    assert as_map(built.search(table, 10, query_cut=99, heap_factor=0.0)) == brute(rows, queries, 10)
    loose = built.search(table, 10, query_cut=3, heap_factor=0.9, n_knn=3)
    assert 0.3 < evaluate.exact_recall(loose, search(index, table, 10)).first()[0] <= 1
    bmp = approx.BlockMaxIndex.build(index, 8)
    exact = bmp.search(table, 5)
    assert evaluate.exact_recall(bmp.search(table, 5, alpha=0.7, beta=0.8), exact, 5).first()[0] <= 1
    assert bmp.super_blocks(4).count() > 0


def test_variants_are_stored(impacts, tmp_path):
    from tarn.sources import store

    index, _, queries = impacts
    table = from_map(index, queries)
    for i, built in enumerate((approx.BlockMaxIndex.build(index, 8), approx.PrunedIndex.build(index), approx.PrunedIndex.build(index, knn=2))):
        opened = store.save_variant(built, f"file://{tmp_path}/v{i}")
        assert as_map(opened.search(table, 5)) == as_map(built.search(table, 5))


def test_segments(impacts):
    index, rows, queries = impacts
    part = lambda i: from_impacts(index.spark.createDataFrame([r for r in rows if r[0] % 3 == i], "doc_id bigint, terms array<string>, values array<double>"), BuildOptions(dtype="float64"))
    seg = SegmentedIndex([part(i) for i in range(3)])
    got = {}
    for r in seg.search(from_map(index, queries), 10).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(round(r["score"], 6))
        assert r["segment"] == r["doc_id"] % 3
    assert got == {q: [s for _, s in h] for q, h in brute(rows, queries, 10).items() if h}
    assert seg.merged().postings.count() == index.postings.count()
    with pytest.raises(ValueError, match="entries"):
        seg.search(from_map(index, queries), deleted=[None])
    with pytest.raises(ValueError, match="algorithm"):
        seg.search(from_map(index, queries), algorithm="x")
    with pytest.raises(TypeError):
        SegmentedIndex(["x"])


def test_metrics(spark):
    run = spark.createDataFrame([(1, 1, 10, 3.0), (1, 2, 11, 2.0), (2, 1, 20, 1.0), (3, 1, 5, 1.0)], "qid bigint, rank int, doc_id bigint, score double")
    qrels = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (2, 21, 1), (4, 1, 1)], "qid bigint, doc_id bigint, relevance int")
    assert tuple(evaluate.mrr(run, qrels).first()) == (0.25, 2)
    m = {r["qid"]: r for r in evaluate.metrics(run, qrels).collect()}
    assert m[1]["ndcg"] == pytest.approx((1 / math.log2(3)) / (2 + 1 / math.log2(3))) and m[1]["recall"] == 0.5 and m[2]["ndcg"] == 0
    assert evaluate.overlap(run, run.where("doc_id <> 11")).where("qid = 1").first()["overlap"] == 0.5
    assert set(evaluate.query_families(["a", "b"])) == {"bow", "phrase", "uw8", "syn", "band", "sdm"}


def test_postings_scan_reads_no_positions(spark, tmp_path):
    from tarn.sources import store

    docs = spark.createDataFrame([(0, "a b a"), (1, "b c")], "doc_id bigint, text string")
    index = store.save(from_text(docs, Analyzer("pisa"), BuildOptions(positions=True, dtype="int32")), f"file://{tmp_path}/i")
    plan = search(index, from_map(index, {1: {"a": 1.0}}), 5, BM25())._jdf.queryExecution().toString()
    scans = [line.split("ReadSchema")[1] for line in plan.splitlines() if "FileScan" in line]
    assert scans and any("value" in s for s in scans) and not any("positions" in s for s in scans)


def test_document_sets(spark):
    from tarn.operators.search import Documents

    a, b = Documents.of(spark, [1, 2, 3, 3]), Documents.from_mask(spark, [False, False, True, True, True])
    ids = lambda x: sorted(r["doc_id"] for r in x.rows.collect())
    assert ids(a | b) == [1, 2, 3, 4] and ids(a & b) == [2, 3] and ids(a - b) == [1] and len(a) == 3
    assert ids(a.insert(9).remove(1, 7)) == [2, 3, 9] and 2 in a and 5 not in a and ids(a.complement(5)) == [0, 4]


def test_merged_segments_keep_versions_and_positions(spark):
    from tarn.operators.structured import search_structured

    build = lambda rows: from_text(spark.createDataFrame(rows, "doc_id bigint, text string"), Analyzer("pisa"), BuildOptions(positions=True, dtype="int32"))
    whole = SegmentedIndex([build([(1, "a b c"), (2, "a b")]), build([(1, ""), (3, "b a b")])]).merged()
    assert sorted((r["doc_id"], r["dl"]) for r in whole.docs.collect()) == [(1, 0), (2, 2), (3, 3)]
    assert {r["doc_id"] for r in search(whole, from_map(whole, {1: {"a": 1.0}}), 5, Dot()).collect()} == {2, 3}
    assert {r["doc_id"] for r in search_structured(whole, {1: "#1(b a)"}, 5, Dot()).collect()} == {3}


def test_pruned_index_recall(spark):
    r = random.Random(4)
    rows = [(d, [str(t) for t in terms], [r.uniform(0.05, 2) for _ in terms]) for d in range(600) for terms in [sorted(r.sample(range(60), 20))]]
    index = from_impacts(spark.createDataFrame(rows, "doc_id bigint, terms array<string>, values array<double>"), BuildOptions(dtype="float64"))
    table = from_map(index, {q: {str(t): r.uniform(0.1, 1) for t in r.sample(range(60), 15)} for q in range(15)})
    exact = {(x["qid"], x["doc_id"]) for x in search(index, table, 10, Dot()).collect()}
    found = {(x["qid"], x["doc_id"]) for x in approx.PrunedIndex.build(index).search(table, 10).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_pruned_lists_keep_their_strongest_whatever_the_others_hold(spark):
    r = random.Random(8)
    rows = [(d, [str(t) for t in range(4)], [r.choice((0.5, 1.0, 1.5)) + t for t in range(4)]) for d in range(50)]
    index = from_impacts(spark.createDataFrame(rows, "doc_id bigint, terms array<string>, values array<double>"), BuildOptions(dtype="float64"))
    cells = [(-v, t, d) for d, terms, values in rows for t, v in zip(terms, values)]
    strongest = {(t, d) for t in "0123" for _, _, d in sorted(x for x in cells if x[1] == t)[:15]}
    lists = lambda **more: {(x["term"], x["doc_id"]) for x in approx.PrunedIndex.build(index, n_postings=10, **more).lists.collect()}
    assert lists() == strongest
    first = sorted(cells)[:40]  # ten a term, of all lists together
    assert lists(global_threshold=True) == {(t, d) for t in "0123" for _, _, d in sorted(x for x in first if x[1] == t)[:15]}


def test_no_search_joins_queries_with_postings(impacts):
    """However many queries there are, scores are added within blocks of documents: no row for each query and document."""
    index, rows, queries = impacts
    table, wanted = from_map(index, queries), brute(rows, queries, 4)
    part = lambda i: type(index)(index.postings.where(f"doc_id % 3 = {i}"), index.docs.where(f"doc_id % 3 = {i}"), options=index.options)
    with pytest.MonkeyPatch.context() as m:
        for most, cells in ((12, 1 << 22), (10**6, 300)):
            m.setattr(search_module, "BATCH", most)
            m.setattr(search_module, "CELLS", cells)
            built = approx.BlockMaxIndex.build(index, 8)
            found = [search(index, table, 4), SegmentedIndex([part(i) for i in range(3)]).search(table, 4), built.search(table, 4)]
            for df in found:
                plan = df._jdf.queryExecution().optimizedPlan().toString()
                assert "MapInArrow" in plan and "Aggregate [qid" not in plan
            assert as_map(found[0]) == wanted
            assert {q: [s for _, s in h] for q, h in as_map(found[1]).items()} == {q: [s for _, s in h] for q, h in wanted.items() if h}
            weights = {(x["qid"], x["term"]): x["weight"] for x in approx.quantised_queries(table).collect()}
            scores = {}
            for x in built.forward.collect():
                for q in queries:
                    if (q, x["term"]) in weights:
                        scores[q, x["doc_id"]] = scores.get((q, x["doc_id"]), 0) + weights[q, x["term"]] * x["q"]
            for q in queries:
                assert as_map(found[2]).get(q, []) == [(d, float(s)) for s, d in sorted(((s, d) for (a, d), s in scores.items() if a == q and s > 0), key=lambda x: (-x[0], x[1]))[:4]]


def test_reorder_does_not_depend_on_where_parts_are_halved(spark):
    r = random.Random(2)
    rows = [(d * 3, sorted({f"{r.randrange(4)}-{r.randrange(9)}" for _ in range(6)})) for d in range(150)]
    index = from_impacts(spark.createDataFrame([(d, t, [1.0] * len(t)) for d, t in rows], "doc_id bigint, terms array<string>, values array<double>"))
    order = lambda most: [x["doc_id"] for x in transforms.reorder_map(index, leaf=16, rounds=4, bucket_docs=most).orderBy("new_id").collect()]
    whole = order(1000)
    assert sorted(whole) == [d for d, _ in rows] and whole != sorted(whole)
    assert order(40) == whole


def test_what_leaves_a_search_does_not_grow_with_blocks(impacts):
    index, rows, queries = impacts
    table, k = from_map(index, {q: {str(t): 1.0 for t in range(40)} for q in queries}), 2
    batch = list(search_module.batches(search_module.weighted(index, table, Dot())))
    found = search_module.candidates(index.postings, F.col("value"), batch, k, width=1)
    assert found.count() <= 12 * len(queries) * k < len(queries) * sum(1 for _ in rows)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(search_module, "HELD", 3)  # given away before the end
        assert as_map(search(index, table, k, width=4)) == brute(rows, {q: {str(t): 1.0 for t in range(40)} for q in queries}, k)


def test_batches_share_what_is_shuffled(impacts):
    index, rows, queries = impacts
    with pytest.MonkeyPatch.context() as m:
        m.setattr(search_module, "BATCH", 12)
        df = search(index, from_map(index, queries), 5)
        assert as_map(df) == brute(rows, queries, 5)
        assert df._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
        m.setattr(search_module, "PASS", 2)
        assert as_map(search(index, from_map(index, queries), 5)) == brute(rows, queries, 5)


def test_impacts_of_one_row_a_document_are_not_shuffled(spark, impacts):
    index, rows, _ = impacts
    docs = spark.createDataFrame(rows, "doc_id bigint, terms array<string>, values array<double>")
    own = from_impacts(docs, BuildOptions(dtype="float64"), keep=False)
    assert "Exchange" not in own.postings._jdf.queryExecution().executedPlan().toString()
    same = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    for c in (("postings", "term", "doc_id", "value", "dl"), ("docs", "doc_id", "dl")):
        assert same(getattr(own, c[0]), *c[1:]) == same(getattr(index, c[0]), *c[1:])
    twice = docs.unionByName(spark.createDataFrame([(rows[0][0], ["new"], [2.5])], docs.schema))
    again = from_impacts(twice, BuildOptions(dtype="float64"), keep=False)
    assert same(again.postings, "term", "doc_id", "dl") == same(from_impacts(twice, BuildOptions(dtype="float64")).postings, "term", "doc_id", "dl")
    with pytest.raises(Exception, match="more than once"):
        from_impacts(spark.createDataFrame([(0, ["a", "a"], [1.0, 2.0])], docs.schema), keep=False).postings.collect()


def test_picked_values_need_no_ranking(spark):
    from tarn.operators import ranking

    r = random.Random(6)
    lists = {"a": [r.gauss(0, 1) for _ in range(300)], "b": [-0.0, 0.0, 5e-324, -1e300, float("inf"), 1.5, 1.5, 1.5], "c": [2.0]}
    rows = spark.createDataFrame([(t, v) for t, own in lists.items() for v in own], "term string, value double").repartition(3)
    wanted = [(t, j, rank) for t, own in lists.items() for j, rank in enumerate((1, 2, len(own) // 2 + 1, len(own), len(own) + 1))]
    expected = {(t, j): sorted(lists[t])[rank - 1] if rank <= len(lists[t]) else None for t, j, rank in wanted}
    places = spark.createDataFrame(wanted, "term string, j int, rank bigint")
    with pytest.MonkeyPatch.context() as m:
        assert {(x["term"], x["j"]): x["value"] for x in ranking.picked(rows, places).collect()} == expected
        m.setattr(ranking, "ranked", None)  # not needed for a few places
        ranking.picked(rows, places)
        m.undo()
        m.setattr(ranking, "FEW", 3)
        assert {(x["term"], x["j"]): x["value"] for x in ranking.picked(rows, places).collect()} == expected


def test_bisection_holds_few_numbers_a_pair():
    import tracemalloc

    import numpy as np

    g = np.random.default_rng(3)
    n = 4000
    doc, term = np.repeat(np.arange(n, dtype=np.int32), 100), (g.random(100 * n) ** 2 * 20_000).astype(np.int32)
    with pytest.MonkeyPatch.context() as m:
        wanted = transforms.bisect(doc[:40_000], term[:40_000], 400, rounds=3)
        m.setattr(transforms, "PAIRS", 150)
        assert (transforms.bisect(doc[:40_000], term[:40_000], 400, rounds=3) == wanted).all()
    tracemalloc.start()
    try:
        assert sorted(transforms.bisect(doc, term, n, leaf=n - 1, rounds=2)) == list(range(n))
        assert tracemalloc.get_traced_memory()[1] < 35 * len(doc)
    finally:
        tracemalloc.stop()


def test_lists_are_clustered_around_documents(spark):
    """Documents of one kind share blocks, whatever the list and however few centres are broadcast at once."""
    r = random.Random(9)
    rows = [(d, ["all", *(f"{d % 3}-{i}" for i in range(3))], [r.uniform(0.5, 1), *(r.uniform(5, 6) for _ in range(3))]) for d in range(120)]
    index = from_impacts(spark.createDataFrame(rows, "doc_id bigint, terms array<string>, values array<double>"), BuildOptions(dtype="float64"))
    told = []
    with pytest.MonkeyPatch.context() as m:
        for most in (approx.ROUND, 40):
            m.setattr(approx, "CENTRES", most)
            m.setattr(approx, "ROUND", most)
            m.setattr(approx, "CELLS", most)
            built = approx.PrunedIndex.build(index, min_cluster_size=4)
            blocks = {}
            for x in built.lists.collect():
                blocks.setdefault((x["term"], x["block"]), set()).add(x["doc_id"])
            assert sum(len(b) for (t, _), b in blocks.items() if t == "all") == 120 and sum(t == "all" for t, _ in blocks) >= 3
            assert all(len(b) >= 4 and len({d % 3 for d in b}) == 1 for b in blocks.values())
            sums = {}
            for x in built.summaries.collect():
                sums.setdefault((x["term"], x["block"]), {})[x["component"]] = round(x["value"], 9)
            want = {}
            for at, own in blocks.items():
                peaks = {}
                for d in own:
                    for t, v in zip(rows[d][1], rows[d][2]):
                        peaks[t] = max(peaks.get(t, 0), v)
                total, before, kept = sum(peaks.values()), 0.0, {}
                for t, v in sorted(peaks.items(), key=lambda x: (-x[1], x[0])):
                    if before < 0.4 * total:
                        kept[t] = round(v, 9)
                    before += v
                want[at] = kept
            assert sums == want
            told.append(sorted(map(sorted, blocks.values())))
    assert told[0] == told[1]


def test_pruned_search_joins_no_documents(impacts):
    """Found documents are scored where they are packed, for groups of queries; no row for each query and document is shuffled."""
    index, rows, queries = impacts
    table, built = from_map(index, queries), approx.PrunedIndex.build(index, n_postings=10**6)
    usual = as_map(built.search(table, 4, query_cut=3))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(approx, "GROUP", 3)
        m.setattr(approx, "BITS", 60)
        assert as_map(built.search(table, 10, query_cut=99, heap_factor=0.0)) == brute(rows, queries, 10)
        assert as_map(built.search(table, 4, query_cut=3)) == usual
        assert built.search(table.limit(0), 4).count() == 0
    index.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = built.search(table, 4)._jdf.queryExecution().executedPlan().toString()
    finally:
        index.spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan


def test_opened_blocks_alone_are_scored_from_packed_documents():
    """What a worker keeps of documents is packed exactly and small; only documents in a query's blocks are scored."""
    import numpy as np
    import pyarrow as pa

    class Sent:
        def __init__(self, value):
            self.value = value

    r = np.random.default_rng(2)
    for a in (np.arange(5), np.array([-(2**40), 7]), np.array([0.1, 1e300]), r.random(9).astype(np.float32), np.zeros(0), np.array([1, 0], np.int8)):
        assert (approx._unpack(approx._pack(a))[0] == a).all()
    x = r.random((300, 8)).astype(np.float32).astype(float)
    column, codes = np.tile(np.arange(300), 8), np.arange(8)
    part = approx.Part(np.arange(300) * 20, codes, 300 * (codes + 1), column, x.T.ravel(), np.full(2400, 0))
    docs, term = np.arange(300) * 20, np.tile(codes, 300)
    (centres,) = approx._centres([(c, docs[[1, 0, 2]]) for c in range(8)], docs, 8 * (np.arange(300) + 1), term, x.ravel())
    part = approx._settled(approx.Part.of(part.packed()), approx.Centres.of(centres.packed()), 8)
    want = (x @ x[[1, 0, 2]].T).argmax(axis=1) + 1
    assert (part.block.reshape(8, 300) == want).all() and len(part.packed()) < 8 * x.size
    batch = lambda: iter([pa.RecordBatch.from_arrays([pa.array([part.packed()], pa.binary())], names=["data"])])
    asked = approx.Asked(2, np.array([1, 5]), np.array([0, 2, 3]), np.array([0, 1, 1], np.int32), np.array([1.0, 2.0, 0.5]), np.array([True, True, False]))
    bits = np.zeros((4, 1), np.int8)
    bits[1, 0], bits[2, 0] = -128, 64  # the first query opens block 1 of list 1, the second one block 2
    got = {}
    for found in approx._scoring(Sent(asked), Sent({1: (1, approx._pack(bits.ravel()))}), 10)(batch()):
        for q, d, s in zip(*(c.to_pylist() for c in found.columns)):
            got.setdefault(q, []).append((d, round(s, 9)))
    score = {0: x[:, 1], 1: 2 * x[:, 1] + 0.5 * x[:, 5]}
    for q, s in score.items():
        own = np.flatnonzero(want == q + 1)
        own = own[np.argsort(-s[own])][:10]
        assert sorted(got[q]) == sorted((int(d) * 20, round(float(s[d]), 9)) for d in own)
