"""Indexes and document stores as directories of Parquet with a JSON manifest, on any file system Spark reads."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from tarn import schema
from tarn.operators.approx import BlockMaxIndex, PrunedIndex
from tarn.operators.docstore import DocStore
from tarn.operators.index import BuildOptions, Index
from tarn.operators.ranking import tidy
from tarn.plans.analyzer import Analyzer

FORMAT, VERSION = "tarn", 2
MANIFEST = "_manifest.json"


class ManifestError(ValueError):
    """A directory that isn't an index, or of a version this code can't read."""


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small file: written beside it, then renamed."""
    fs, where = _fs(spark, path)
    _, beside = _fs(spark, f"{path}.new")
    stream = fs.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.exists(where):
        fs.delete(where, False)
    fs.rename(beside, where)


def manifest(spark: SparkSession, path: str) -> dict:
    """The manifest of a directory; errors say what to do."""
    text = read_text(spark, f"{path}/{MANIFEST}")
    if text is None:
        raise ManifestError(f"'{path}' has no {MANIFEST}: it isn't an index, or its write didn't end; build it again")
    found = json.loads(text)
    if found.get("format") != FORMAT:
        raise ManifestError(f"'{path}' has format '{found.get('format')}', expected '{FORMAT}'")
    if found["version"] > VERSION:
        raise ManifestError(f"'{path}' has version {found['version']}, this code reads up to {VERSION}: use a newer release")
    if found["version"] < VERSION:
        raise ManifestError(f"'{path}' has version {found['version']}: update it with migrate(spark, path, destination)")
    return found


def _describe(spark: SparkSession, path: str, kind: str, features: list[str], more: dict) -> None:
    told = {"format": FORMAT, "version": VERSION, "kind": kind, "created": int(time.time()), "builder": {"spark": spark.version}, "features": features}
    write_text(spark, f"{path}/{MANIFEST}", json.dumps(told | more, indent=1, sort_keys=True))


def save(index: Index, path: str, partitions: int | None = None) -> Index:
    """Writes an index and opens it. Postings lie in ranges of (term, doc_id), so readers of a few terms skip most files.

    Ranges keep a frequent term from filling one file; the manifest comes last, so a broken write is no index.
    """
    spark = index.spark
    rows = index.postings.repartitionByRange(partitions, "term", "doc_id") if partitions else index.postings.repartitionByRange("term", "doc_id")
    with tidy(spark):
        rows.sortWithinPartitions("term", "doc_id").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings")
    index.docs.repartitionByRange(*([partitions] if partitions else []), "doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{path}/docs")
    written = spark.read.parquet(f"{path}/postings")
    Index(written, index.docs).terms.write.mode("overwrite").parquet(f"{path}/terms")
    features = [f for f, has in (("positions", index.options.positions), ("analyzer", index.analyzer is not None), ("numbered", index.info.get("numbered", False))) if has]
    options = {"block_size": index.options.block_size, "positions": index.options.positions, "dtype": index.options.dtype}
    _describe(spark, path, "index", features, {"options": options, "analyzer": json.loads(index.analyzer.to_json()) if index.analyzer else None, "info": {k: v for k, v in index.info.items() if isinstance(v, bool | int | float | str)}})
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index | DocStore | BlockMaxIndex | PrunedIndex:
    """Opens whatever the manifest says is there."""
    told = manifest(spark, path)
    if told["kind"] == "docstore":
        return DocStore(spark.read.schema(schema.DOCSTORE).parquet(f"{path}/documents"))
    if told["kind"] in ("block-max", "pruned"):
        tables = {n: spark.read.parquet(f"{path}/{n}") for n in told["features"]}
        if told["kind"] == "block-max":
            return BlockMaxIndex(**tables, block_size=told["block_size"], n_docs=told["n_docs"])
        if "packed" not in tables:
            raise ManifestError(f"'{path}' has no clusters, as pruned indexes had before: build it again")
        return PrunedIndex(**({"neighbours": None} | tables), n_docs=told["n_docs"])
    if told["kind"] != "index":
        raise ManifestError(f"unknown kind '{told['kind']}' in '{path}'")
    postings = spark.read.parquet(f"{path}/postings")
    analyzer = Analyzer.from_json(json.dumps(told["analyzer"])) if told["analyzer"] else None
    return Index(postings, spark.read.schema(schema.DOCS).parquet(f"{path}/docs"), analyzer, BuildOptions(**told["options"]), info=dict(told["info"]), _terms=spark.read.schema(schema.TERMS).parquet(f"{path}/terms"))


def save_docstore(store: DocStore, path: str) -> DocStore:
    spark = store.docs.sparkSession
    store.docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/documents")
    _describe(spark, path, "docstore", [], {})
    return load(spark, path)


def save_variant(built: BlockMaxIndex | PrunedIndex, path: str) -> BlockMaxIndex | PrunedIndex:
    """Writes a block-max or a pruned index, each table in ranges of its key, and opens it."""
    kind = "block-max" if isinstance(built, BlockMaxIndex) else "pruned"
    tables = {"block-max": ("forward", "block_max", "kth"), "pruned": ("terms", "packed", "sums", "neighbours")}[kind]
    spark = built.forward.sparkSession
    for name in tables:
        df = getattr(built, name)
        if df is not None:
            by = [c for c in ("term", "block", "doc_id") if c in df.columns] or df.columns[:1]
            df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    present = [n for n in tables if getattr(built, n) is not None]
    _describe(spark, path, kind, present, {"n_docs": built.n_docs, "block_size": getattr(built, "block_size", None)})
    return load(spark, path)


def keeper(path: str) -> Callable[[DataFrame], DataFrame]:
    """For operators.index.from_text: writes each table below the path and reads it back, so that texts are analysed once."""
    names = iter(("postings", "docs", *(f"table{i}" for i in range(1000))))

    def keep(df: DataFrame) -> DataFrame:
        where = str(PurePosixPath("x") / next(names))[2:]
        df.write.mode("overwrite").parquet(f"{path}/{where}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{where}")

    return keep


# --- versions


def _from_1(spark: SparkSession, path: str, told: dict) -> dict:
    """Version 1 had no lengths in postings and no term statistics."""
    postings, docs = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs")
    full = postings.join(docs, "doc_id").select("term", "doc_id", "value", "dl", "positions")
    fresh = f"{path}/postings.new"
    full.write.mode("overwrite").parquet(fresh)
    fs, old = _fs(spark, f"{path}/postings")
    fs.delete(old, True)
    fs.rename(_fs(spark, fresh)[1], old)
    Index(spark.read.parquet(f"{path}/postings"), docs).terms.write.mode("overwrite").parquet(f"{path}/terms")
    return told | {"version": 2}


STEPS: dict[int, Callable[[SparkSession, str, dict], dict]] = {1: _from_1}


def migrate(spark: SparkSession, path: str, destination: str | None = None) -> dict:
    """Brings an index to this version, step by step, in place or in a copy; returns the manifest."""
    text = read_text(spark, f"{path}/{MANIFEST}")
    if text is None:
        raise ManifestError(f"'{path}' has no {MANIFEST}")
    told = json.loads(text)
    if told["version"] > VERSION:
        raise ManifestError(f"'{path}' has version {told['version']}, which is newer than {VERSION}")
    if destination:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        (fs, a), (fs2, b) = _fs(spark, path), _fs(spark, destination)
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, fs2, b, False, conf)
        path = destination
    while told["version"] < VERSION:
        told = STEPS[told["version"]](spark, path, told)
        write_text(spark, f"{path}/{MANIFEST}", json.dumps(told, indent=1, sort_keys=True))
    return told
