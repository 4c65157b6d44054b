import asyncio
import json

import pytest

from tarn.functions.scoring import BM25
from tarn.operators.docstore import DocStore
from tarn.operators.index import BuildOptions, from_text
from tarn.operators.search import from_map, search
from tarn.plans.analyzer import Analyzer
from tarn.sources import store
from tarn.streaming.ingest import Incremental


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_round_trip_and_manifest(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    built = from_text(docs(spark, [(0, "a b a"), (3, "b c")]), Analyzer("pisa", stop_words=("x",)), BuildOptions(positions=True, dtype="int32"))
    opened = store.save(built, path)
    assert opened.analyzer == built.analyzer and opened.options == built.options and opened.stats() == built.stats()
    assert sorted(map(tuple, opened.postings.select("term", "doc_id", "value", "dl").collect())) == [("a", 0, 2, 3), ("b", 0, 1, 3), ("b", 3, 1, 2), ("c", 3, 1, 2)]
    assert store.manifest(spark, path)["features"] == ["positions", "analyzer"]
    with pytest.raises(store.ManifestError, match="no _manifest"):
        store.load(spark, f"file://{tmp_path}")
    told = json.loads((tmp_path / "index/_manifest.json").read_text())
    store.write_text(spark, f"{path}/_manifest.json", json.dumps(told | {"version": 99}))
    with pytest.raises(store.ManifestError, match="newer release"):
        store.load(spark, path)


def test_migrate(spark, tmp_path):
    old, new = f"file://{tmp_path}/old", f"file://{tmp_path}/new"
    built = from_text(docs(spark, [(0, "a b a"), (1, "b c")]), Analyzer("pisa"))
    built.postings.drop("dl").write.parquet(f"{old}/postings")
    built.docs.write.parquet(f"{old}/docs")
    store.write_text(spark, f"{old}/_manifest.json", json.dumps({"format": "tarn", "version": 1, "kind": "index", "analyzer": None, "options": {}, "info": {}}))
    with pytest.raises(store.ManifestError, match="migrate"):
        store.load(spark, old)
    assert store.migrate(spark, old, new)["version"] == store.VERSION
    opened = store.load(spark, new)
    assert sorted(r["dl"] for r in opened.postings.collect()) == [2, 2, 3, 3]
    assert json.loads((tmp_path / "old/_manifest.json").read_text())["version"] == 1


def test_docstore(spark, tmp_path):
    rows = [(n, f"d\t{n}", f"http://x/{n}" if n % 4 == 0 else None, f"body é {n}") for n in range(0, 40, 2)]
    frame = spark.createDataFrame(rows, "n bigint, docno string, url string, body string")
    s = store.save_docstore(DocStore.build(frame, "n", {"docno": "docno", "url": "url"}, "body"), f"file://{tmp_path}/ds")
    assert s.key_names() == ["docno", "url"] and s.meta() == {"num_documents": 39, "stored": 20, "has_content": True}
    got = s.get_by_number([6, 0, 6]).collect()
    assert [(r["doc_id"], bytes(r["content"]).decode()) for r in got] == [(6, "body é 6"), (0, "body é 0"), (6, "body é 6")]
    with pytest.raises(KeyError, match="no document 7"):
        s.get_by_number([7])
    assert [r["doc_id"] for r in s.get_numbers("docno", ["d\t4", "nope"]).collect()] == [4, None]
    assert [r["value"] for r in s.get_keys("url", [8, 2, 99]).collect()] == ["http://x/8", None, None]
    assert s.get_by_key("docno", ["d\t8"]).first()["keys"] == {"docno": "d\t8", "url": "http://x/8"}
    with pytest.raises(KeyError, match="unknown key"):
        s.get_keys("nope", [1])
    assert not s.keys_only().meta()["has_content"]
    assert len(asyncio.run(s.get_by_number_async([0]))) == 1
    with pytest.raises(ValueError, match="duplicate value"):
        DocStore.build(spark.createDataFrame([(0, "a"), (1, "a")], "n bigint, k string"), "n", {"k": "k"})
    numbered = DocStore.build(frame.drop("n"), None, {"docno": "docno"}, "body")
    assert numbered.meta()["num_documents"] == 20


def test_stream_of_segments(spark, tmp_path):
    source, root = tmp_path / "in", f"file://{tmp_path}/root"
    source.mkdir()
    schema = "doc_id bigint, text string, version bigint, deleted boolean"
    inc = Incremental(spark, root, Analyzer("pisa"))
    assert inc.search(spark.createDataFrame([(1, "a", 1.0)], "qid bigint, term string, weight double")).collect() == []
    batches = [
        [(0, "cat dog", 1, False), (1, "cat cat", 1, False), (2, "bird", 1, False)],
        [(0, "fish", 2, False), (1, None, 2, True), (3, "cat", 1, False)],
        [(0, "cat stale", 1, False)],  # late: an older version must lose
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{source}/b{i}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"file://{source}")
        inc.follow(stream, f"file://{tmp_path}/check").awaitTermination()
    query = spark.createDataFrame([(1, "cat", 1.0), (2, "fish", 1.0)], "qid bigint, term string, weight double")
    hits = lambda x: sorted((r["qid"], r["doc_id"]) for r in x.search(query).collect())
    assert hits(inc) == [(1, 3), (2, 0)]
    buffered = inc.search_with_buffer(query, docs(spark, [(3, "fish"), (9, "cat")])).collect()
    assert sorted((r["qid"], r["doc_id"]) for r in buffered) == [(1, 9), (2, 0), (2, 3)]
    inc.write_segment(spark.createDataFrame(batches[1], schema), 1)  # the same batch again changes nothing
    assert hits(inc) == [(1, 3), (2, 0)]
    scratch = from_text(docs(spark, [(0, "fish"), (2, "bird"), (3, "cat")]), Analyzer("pisa"))
    want = [(r["qid"], r["doc_id"]) for r in search(scratch, from_map(scratch, {1: {"cat": 1.0}, 2: {"fish": 1.0}}), 5, BM25()).collect()]
    inc.merge()
    assert hits(inc) == sorted(want)
    assert len(list((tmp_path / "root/postings").glob("segment=*"))) == 1
    # deletions outlive the merge: older data of a deleted document that arrives late changes nothing
    inc.write_segment(spark.createDataFrame([(1, "cat old", 1, False), (0, "cat older", 1, False)], schema), 50)
    assert hits(inc) == sorted(want)
    inc.merge()
    inc.write_segment(spark.createDataFrame([(1, "cat new", 3, False)], schema), 60)
    assert hits(inc) == sorted([*want, (1, 1)])
