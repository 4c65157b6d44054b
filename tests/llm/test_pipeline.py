import pytest

import corpus_pipeline
from tarn.llm import decontam, ngram_join, packing, pii, quality, queries

from .helpers import DATA, HAS_DATA
from .test_decontam import brute as contaminated
from .test_ngram_join import brute as near
from .test_pii import brute as private

pytestmark = pytest.mark.skipif(not HAS_DATA, reason="needs the driver's tables")


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_copies", "decontamination", "personal_data", "packing"]

    def step(name, df):
        out = stages[name](spark, df, DATA)
        return spark.createDataFrame(out.toPandas(), out.schema)

    good = step("quality", docs)
    scores = {r["doc_id"]: r["predicted"] for r in quality.classify(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    assert {r["doc_id"] for r in good.collect()} == {i for i, p in scores.items() if p} and good.columns == columns
    apart = step("near_copies", good)
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert {r["doc_id"] for r in apart.collect()} == {c for _, _, c, _ in near(rows)} and apart.columns == columns
    clean = step("decontamination", apart)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in apart.collect()]
    assert {r["doc_id"] for r in clean.collect()} == {x[0] for x in contaminated(rows, items) if not x[5]} and clean.columns == columns
    safe = step("personal_data", clean)
    assert safe.columns == columns and safe.count() == clean.count()
    for r in safe.collect():
        n, _ = private(r["text"])
        assert sum(n.values()) == 0 and r["n_chars"] == len(r["text"])
    packed = step("packing", safe)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in safe.collect()}
    whole = corpus_pipeline.run(spark, DATA)
    place = lambda df: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert place(whole) == place(packed)


def test_stages_take_any_rows(spark):
    """Null and repeated ids, null, empty and repeated texts, clashing columns, and no rows at all."""
    from .helpers import documents

    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    good = next(r["text"] for r in quality.keep_good(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")).where("length(text) between 200 and 900").take(1))
    rows = [(None, None), (None, ""), (1, good), (1, good), (1, good[::-1]), (None, good), (2, item), (None, item), (3, "mail a@b.c " + good.upper()[:90]), (4, " " * 20_000)]
    docs = documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, DATA)
        got = out.collect()
        if name == "near_copies":  # empty texts stay, one row of each other text does
            assert sorted((r["doc_id"] is None, r["text"] or "") for r in got) == sorted([(True, ""), (True, ""), (False, good), (False, good[::-1]), (False, item), (False, rows[8][1]), (False, rows[9][1])])
        elif name == "decontamination":
            assert sorted(r["text"] or "" for r in got) == sorted(t or "" for _, t in rows if t != item)
        elif name == "personal_data":
            assert len(got) == len(rows) and not any("a@b.c" in (r["text"] or "") for r in got)
        if name != "packing":
            assert out.columns == docs.columns
        else:
            assert sum(r["piece"] == 0 for r in got) == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).collect() == []


def test_all_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert all((decontam, ngram_join, packing, pii))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    res = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in res.description]
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(res.fetchall(), key=repr)
