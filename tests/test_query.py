import pytest

from tarn.operators.index import BuildOptions, from_impacts, from_text
from tarn.operators.search import from_map, search
from tarn.operators.structured import evaluate, read, search_structured
from tarn.functions.scoring import BM25, Dot
from tarn.plans import query as Q
from tarn.plans.analyzer import Analyzer

KNOWN = {"a": "a", "b": "b", "c": "c", "new": "new", "york": "york", "bank": "bank", "america": "america", "of": Q.STOP, "the": Q.STOP}


def parse(text):
    return Q.parse(text, lambda w: KNOWN.get(w, Q.UNKNOWN))


T = Q.Term


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("#combine:0=2:1=1(a #1(new york))", Q.Combine(((2.0, T("a")), (1.0, Q.Phrase(("new", "york")))))),
        ("#combine(a unknown b)", Q.Combine(((1.0, T("a")), (1.0, T("b"))))),
        ("#combine:2=3(a unknown b)", Q.Combine(((1.0, T("a")), (3.0, T("b"))))),
        ("a unknown", T("a")),
        ("#band(#syn(a b) c)", Q.Band((Q.Syn(("a", "b")), T("c")))),
        ("#band(a unknown)", Q.Combine(())),
        ("#1(new unknown)", Q.Combine(())),
        ("#uw8(new york)", Q.Window(("new", "york"), 8)),
        ("#1(bank of america)", Q.Phrase(("bank", "america"))),
        ("#uw8(the bank america)", Q.Window(("bank", "america"), 8)),
        ("#band(bank of america)", Q.Band((T("bank"), T("america")))),
        ("bank #1(bank zork)", T("bank")),
        ("#syn(a unknown)", Q.Syn(("a",))),
        ("#syn(unknown)", Q.Combine(())),
        ("", Q.Combine(())),
    ],
)
def test_parse(text, want):
    assert parse(text) == want


@pytest.mark.parametrize("text", ["#combine(a b", "#bogus(a b)", "a b)", "#combine:oops(a b)", "#combine:0=x(a)", "#uw1(a b)", "#uw(a b)", "#syn(#1(a b))", "#1(a #syn(b))", "#combine", "#syn:0=1(a)"])
def test_parse_errors(text):
    with pytest.raises(Q.QueryError):
        parse(text)


def test_dictionaries():
    assert Q.from_dict({"combine": [[2, {"term": 3}], [1.5, {"window": {"terms": [1, 2], "width": 4}}]]}) == Q.Combine(((2.0, T("3")), (1.5, Q.Window(("1", "2"), 4))))
    assert Q.from_dict({"band": [1, {"syn": [2, 3]}]}) == Q.Band((T("1"), Q.Syn(("2", "3"))))
    assert Q.from_dict({"term": [7, 0.5]}) == T("7", 0.5)
    for bad in ({"nope": 1}, {"term": 1, "syn": [1]}, {"combine": [1]}, {"window": {"terms": [1]}}, {"syn": 3}, [1], {"term": [1, 2, 3]}):
        with pytest.raises(Q.QueryError):
            Q.from_dict(bad)


def test_clauses_flatten_and_merge():
    node = Q.Combine(((0.5, Q.Combine(((1.0, T("a")), (4.0, T("b"))))), (2.0, Q.Phrase(("new", "york"))), (1.0, T("a"))))
    assert Q.clauses(node) == [(1.5, T("a")), (2.0, T("b")), (2.0, Q.Phrase(("new", "york")))]
    with pytest.raises(Q.QueryError, match="combine"):
        Q.validate(Q.Band((Q.Combine(((1.0, T("a")),)),)))


CORPUS = [
    "new york city guide", "new the york again", "new york new york today", "old york city guide", "alpha beta gamma", "alpha gamma", "beta gamma", "alpha beta extra",
    "delta epsilon", "delta delta epsilon", "epsilon only", "cat sat on the mat", "cat mat", "mat cat", "rock jazz rock jazz rock",
]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id bigint, text string")
    return from_text(docs, Analyzer("pisa", stop_words=("the",)), BuildOptions(positions=True, dtype="int32"))


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("#1(new york)", [(0, 1), (2, 2)]),
        ("#uw3(cat mat)", [(12, 1), (13, 1)]),
        ("#uw5(cat mat)", [(11, 1), (12, 1), (13, 1)]),
        ("#uw3(rock jazz)", [(14, 2)]),
        ("#band(alpha beta)", [(4, 2), (7, 2)]),
        ("#syn(delta epsilon)", [(8, 2), (9, 3), (10, 1)]),
        ("#1(rock)", [(14, 3)]),
        ("#band(#syn(alpha delta) #1(beta gamma))", [(4, 2)]),
        ("#uw2(rock rock)", []),
        ("#uw3(rock rock)", [(14, 3)]),
        ("#combine:0=2:1=3(cat mat)", [(11, 5), (12, 5), (13, 5)]),
    ],
)
def test_raw_values(index, query, want):
    got = sorted((r["doc_id"], r["score"]) for r in evaluate(index, read(index, {1: query}), Dot()).collect())
    assert got == [(d, float(v)) for d, v in want]


def test_empty_and_errors(spark, index):
    assert search_structured(index, {1: "#band(alpha zork)", 2: "the"}).collect() == []
    with pytest.raises(Q.QueryError, match="query 1:"):
        search_structured(index, {5: "alpha", 6: "#bogus(a)"})
    flat = from_text(spark.createDataFrame([(0, "a b")], "doc_id bigint, text string"), Analyzer("pisa"))
    with pytest.raises(Q.QueryError, match="positions"):
        search_structured(flat, {1: "#1(a b)"})


def test_flat_equals_structured(index):
    text = "new york city cat"
    a = search_structured(index, {1: text}, 5, BM25()).collect()
    b = search(index, from_map(index, {1: dict.fromkeys(text.split(), 1.0)}), 5, BM25()).collect()
    assert [(r["doc_id"], round(r["score"], 6)) for r in a] == [(r["doc_id"], round(r["score"], 6)) for r in b]


def test_position_gaps(spark):
    docs = spark.createDataFrame([(0, "bank of the america")], "doc_id bigint, text string")
    for gaps, want in ((True, [0, 3]), (False, [0, 1])):
        rows = Analyzer("pisa", stop_words=("of", "the"), position_gaps=gaps).tokens(docs).collect()
        assert sorted(r["pos"] for r in rows) == want


def test_numbered_terms(spark):
    docs = spark.createDataFrame([(0, [1, 2], [0.5, 1.5]), (2, [2], [2.0])], "doc_id bigint, terms array<bigint>, values array<double>")
    index = from_impacts(docs)
    assert index.num_terms() == 3 and index.stats().n == 3 and index.value_range(2) == (0.0, 2.0) and index.term_row(9)["df"] == 0
    got = search_structured(index, {1: {"combine": [[1, 1], [2, 2]]}}).collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [(2, 4.0), (0, 3.5)]


def test_table_of_queries_and_bounds(spark, monkeypatch):
    from tarn.operators import structured

    docs = spark.createDataFrame([(0, "a b a c"), (1, "b c"), (2, "a a a")], "doc_id bigint, text string")
    index = from_text(docs, Analyzer("pisa"), BuildOptions(positions=True, dtype="int32"))
    texts = {1: "#1(a b)", 2: "#syn(b c)", 3: '{"band": ["a", "c"]}', 4: "a"}
    table = spark.createDataFrame(list(texts.items()), "qid bigint, query string")
    want = sorted(tuple(r) for r in search_structured(index, texts | {3: {"band": ["a", "c"]}}, 5, BM25()).collect())
    assert sorted(tuple(r) for r in search_structured(index, table, 5, BM25()).collect()) == want
    monkeypatch.setattr(structured, "QUERIES", 2)
    monkeypatch.setattr(structured, "SMALL", 0)
    assert sorted(tuple(r) for r in search_structured(index, table, 5, BM25()).collect()) == want
    nodes = [T("a"), T("zork"), Q.Syn(("a", "b")), Q.Phrase(("a", "c")), Q.Window(("a", "zork"), 4), Q.Band((T("a"), T("b")))]
    assert list(structured.bounds(index, nodes).values()) == [3.0, 0.0, 4.0, 1.0, 0.0, 1.0]
