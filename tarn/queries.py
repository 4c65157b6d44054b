"""The retrieval operators as queries over the driver's tables, each with the SQL that says what it must return.

Collections: `text` is documents with words of the plain tokenizer; `dot` is embeddings as learned impacts (positive
components, the dimension as term); `lines` is lineitem as a large sparse matrix. Indexes are built once for each
folder and session and then read by many queries, as a service would.
"""

from __future__ import annotations

import tempfile
import time
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import stopwords
from tarn.functions import tokenizers as tok
from tarn.functions.scoring import BM25, Dot
from tarn.operators import approx, evaluate, transforms
from tarn.operators.docstore import DocStore
from tarn.operators.index import BuildOptions, Index, dense, from_impacts, from_text, numbered
from tarn.operators.search import Documents, search, search_one, search_text, search_wand
from tarn.operators.segments import SegmentedIndex
from tarn.operators.structured import search_structured
from tarn.plans.analyzer import Analyzer
from tarn.sources import store
from tarn.streaming.ingest import Incremental

_open: dict[tuple, tuple[weakref.ref, Index]] = {}
STOPS = ("the", "of", "and", "a", "to", "in")


def _folder(spark: SparkSession) -> str:
    """A place for indexes: the cluster's shared folder, where it names one; else a temporary or the home folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return f"{where.rstrip('/')}/indexes"
    if spark.sparkContext.master.split("[")[0] == "local":
        return "file://" + tempfile.mkdtemp(prefix="tarn-index-")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    return f"{jvm.org.apache.hadoop.fs.FileSystem.get(conf).getHomeDirectory().toString()}/.tarn/indexes"


def _once(spark: SparkSession, key: tuple, build: Callable[[], Index]) -> Index:
    known = _open.get(key)
    if known is None or known[0]() is not spark:
        index = build()
        saved = store.save(index, f"{_folder(spark)}/{abs(hash(key))}-{len(_open)}")
        for df in (index.postings, index.docs):
            df.unpersist()
        known = _open[key] = (weakref.ref(spark), saved)
    return known[1]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_index(spark: SparkSession, sf_dir: str, analyzer: Analyzer | None = None, positions: bool = True) -> Index:
    analyzer = analyzer or Analyzer("pisa")
    return _once(spark, (sf_dir, "text", analyzer.to_json(), positions), lambda: from_text(read(spark, sf_dir, "documents"), analyzer, BuildOptions(positions=positions, dtype="int32")))


def dot_index(spark: SparkSession, sf_dir: str) -> Index:
    def build() -> Index:
        pairs = F.filter(F.transform("embedding", lambda x, i: F.struct(i.cast("string").alias("t"), x.cast("double").alias("v"))), lambda p: p["v"] > 0)
        rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), pairs.alias("p"))
        return from_impacts(rows.select("doc_id", F.transform("p", lambda p: p["t"]).alias("terms"), F.transform("p", lambda p: p["v"]).alias("values")), BuildOptions(dtype="float64"), keep=False)

    return _once(spark, (sf_dir, "dot"), build)


def _pruned(spark: SparkSession, sf_dir: str, **options: float) -> approx.PrunedIndex:
    return approx.PrunedIndex.build(dot_index(spark, sf_dir), store=store.keeper(f"{_folder(spark)}/clusters-{time.monotonic_ns()}"), **options)


def lines_index(spark: SparkSession, sf_dir: str) -> Index:
    def build() -> Index:
        cells = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("t")).agg(F.sum("l_quantity").cast("double").alias("v"))
        return from_impacts(cells.groupBy("doc_id").agg(F.collect_list(F.col("t").cast("string")).alias("terms"), F.collect_list("v").alias("values")), BuildOptions(dtype="float64"))

    return _once(spark, (sf_dir, "lines"), build)


def dot_queries(spark: SparkSession, sf_dir: str, every: int = 20) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").where(F.col("vec_id") % every == 0)
    return rows.select(F.col("vec_id").alias("qid"), F.posexplode("embedding").alias("t", "w")).where("w > 0").select("qid", F.col("t").cast("string").alias("term"), F.col("w").cast("double").alias("weight"))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _scored(df: DataFrame, digits: int = 4) -> DataFrame:
    """Scores rounded: engines add in different orders."""
    return df.withColumn("score", F.round("score", digits))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def note(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return note


# Words in SQL, without looking around: letters may hold signs between two letters, digits between two digits.
_UNICODE_WORD = r"_*(?:[\p{L}\p{M}]+(?:[''’‘.·:]\p{L}[\p{L}\p{M}]*)*|\p{N}+(?:[.,;''’]\p{N}+)*)(?:[\p{L}\p{M}]+(?:[''’‘.·:]\p{L}[\p{L}\p{M}]*)*|\p{N}+(?:[.,;''’]\p{N}+)*|_+)*"
_UNICODE = f"u AS (SELECT doc_id, lang, list_transform(regexp_extract_all(coalesce(text, ''), '{_UNICODE_WORD}'), lambda x: lower(x)) AS t FROM documents), ut AS (SELECT doc_id, lang, unnest(t) AS term, unnest(range(0, len(t))) AS pos FROM u)"

# Shared SQL: tokens, postings and statistics of the text collection; postings of the others.
_WORDS = r"""w AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '(?:[a-zA-Z]+\.){2,}|[a-zA-Z0-9]+''[a-zA-Z]+|[a-zA-Z0-9]+'), lambda x: lower(split_part(replace(x, '.', ''), '''', 1))), lambda x: true) AS t FROM documents)"""
_TOKENS = _WORDS + """, tokens AS (SELECT doc_id, unnest(t) AS term, unnest(range(0, len(t))) AS pos FROM w)"""
_POST = _TOKENS + """, post AS (SELECT term, doc_id, count(*) AS tf FROM tokens GROUP BY 1, 2), dls AS (SELECT doc_id, count(*) AS dl FROM tokens GROUP BY 1)"""
_STATS = _POST + """, st AS (SELECT CAST((SELECT max(doc_id) + 1 FROM documents) AS DOUBLE) AS n, (SELECT sum(dl) FROM dls) / CAST((SELECT max(doc_id) + 1 FROM documents) AS DOUBLE) AS avgdl), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1)"""
_QWORDS = r"""qw AS (SELECT item_id AS qid, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '(?:[a-zA-Z]+\.){2,}|[a-zA-Z0-9]+''[a-zA-Z]+|[a-zA-Z0-9]+'), lambda x: lower(split_part(replace(x, '.', ''), '''', 1)))) AS term FROM benchmark), q AS (SELECT qid, term, CAST(count(*) AS DOUBLE) AS weight FROM qw GROUP BY 1, 2)"""
_ROBERTSON = "greatest(ln((st.n - df + 0.5) / (df + 0.5)), 1e-6)"
_TF = "tf / (1.2 * 0.25 + 1.2 * 0.75 * dl / st.avgdl + tf)"
_DOT = """dp AS (SELECT CAST(vec_id AS BIGINT) AS doc_id, CAST(p AS VARCHAR) AS term, v AS value FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(0, len(embedding))) AS p FROM embeddings) WHERE v > 0)"""
_DOTQ = _DOT + """, dq AS (SELECT doc_id AS qid, term, value AS weight FROM dp WHERE doc_id % 20 = 0)"""
_LINES = """lp AS (SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(l_partkey AS VARCHAR) AS term, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2)"""


def _ranked(scores: str, k: int = 10) -> str:
    return f"SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ({scores}) WHERE score > 0) WHERE rank <= {k}"


def _bm25(extra: str = "", idf: str = _ROBERTSON, weight: str = "q.weight", source: str = "q", where: str = "") -> str:
    return f"WITH {_STATS}, {_QWORDS}{extra} " + _ranked(f"SELECT qid, post.doc_id, sum({weight} * {idf} * {_TF}) AS score FROM {source} JOIN post ON post.term = {source}.term JOIN dls ON dls.doc_id = post.doc_id JOIN dfs ON dfs.term = post.term, st {where} GROUP BY 1, 2")


def _virtual(freq: str, df: str, k: int = 10) -> str:
    """SQL of a clause: freq gives qid, doc_id, tf; df an expression."""
    return f"WITH {_STATS}, v AS ({freq}) " + _ranked(f"SELECT qid, v.doc_id, greatest(ln((st.n - least({df}, st.n) + 0.5) / (least({df}, st.n) + 0.5)), 1e-6) * {_TF} AS score FROM v JOIN dls USING (doc_id), st", k)


# ------------------------------------------------------------------------------------------- sources and statistics


@query(f"WITH {_LINES} SELECT term, doc_id, value FROM lp")
def src_forward(spark, sf_dir):  # noqa: ANN001, ANN201
    return lines_index(spark, sf_dir).postings.select("term", "doc_id", "value")


@query(f"WITH {_POST} SELECT doc_id, CAST(tf AS INTEGER) AS value FROM post WHERE term = 'the'")
def src_postings(spark, sf_dir):  # noqa: ANN001, ANN201
    return text_index(spark, sf_dir).postings_of("the").select("doc_id", "value")


@query("SELECT CAST(max(p) + 1 AS BIGINT) AS num_terms FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(0, len(embedding))) AS p FROM embeddings) WHERE v > 0")
def src_num_terms(spark, sf_dir):  # noqa: ANN001, ANN201
    return dot_index(spark, sf_dir).postings.agg((F.max(F.col("term").cast("bigint")) + 1).alias("num_terms"))


@query(f"WITH {_POST} SELECT x.term, CAST(count(post.doc_id) AS BIGINT) AS df FROM (SELECT unnest(['the', 'and', 'no such word']) AS term) x LEFT JOIN post ON post.term = x.term GROUP BY 1")
def src_term_postings(spark, sf_dir):  # noqa: ANN001, ANN201
    asked = spark.createDataFrame([("the",), ("and",), ("no such word",)], "term string")
    return asked.join(text_index(spark, sf_dir).terms, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


@query(f"WITH {_LINES} SELECT term, CAST(0 AS DOUBLE) AS low, max(value) AS high FROM lp GROUP BY 1")
def src_value_range(spark, sf_dir):  # noqa: ANN001, ANN201
    return lines_index(spark, sf_dir).terms.select("term", F.lit(0.0).alias("low"), F.col("max_value").alias("high"))


@query("SELECT CAST(max(l_orderkey) AS BIGINT) AS max_doc_id FROM lineitem")
def src_max_doc_id(spark, sf_dir):  # noqa: ANN001, ANN201
    return lines_index(spark, sf_dir).postings.agg(F.max("doc_id").alias("max_doc_id"))


@query(f"WITH {_TOKENS} SELECT doc_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM tokens WHERE term IN ('the', 'la', 'der', 'le') GROUP BY doc_id, term")
def src_positions(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = text_index(spark, sf_dir).postings.where(F.col("term").isin("the", "la", "der", "le"))
    return rows.select("doc_id", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


@query(f"WITH {_STATS} SELECT CAST(n AS BIGINT) AS n, round(avgdl, 6) AS avgdl, CAST((SELECT min(coalesce(dl, 0)) FROM documents LEFT JOIN dls USING (doc_id)) AS BIGINT) AS min_dl FROM st")
def src_docmeta(spark, sf_dir):  # noqa: ANN001, ANN201
    s = text_index(spark, sf_dir).stats()
    return spark.createDataFrame([(s.n, round(s.avgdl, 6), s.min_dl)], "n bigint, avgdl double, min_dl bigint")


@query(f"WITH {_TOKENS} SELECT term, CAST(row_number() OVER (ORDER BY d, p, term) - 1 AS BIGINT) AS term_id FROM (SELECT term, min(doc_id) AS d, min_by(pos, doc_id * 10000000 + pos) AS p FROM tokens GROUP BY 1)")
def src_vocab(spark, sf_dir):  # noqa: ANN001, ANN201
    return text_index(spark, sf_dir).vocabulary()


@query(f"WITH {_POST} SELECT post.term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS DOUBLE) AS cf, CAST(max(tf) AS DOUBLE) AS max_value, max(post.doc_id) AS max_doc_id, CAST(min(dl) AS INTEGER) AS min_dl FROM post JOIN dls USING (doc_id) GROUP BY 1")
def src_term_statistics(spark, sf_dir):  # noqa: ANN001, ANN201
    return text_index(spark, sf_dir).terms


# ------------------------------------------------------------------------------------------------------- builders


@query(f"WITH {_DOT} SELECT term, doc_id, round(value, 6) AS value FROM dp")
def build_impacts(spark, sf_dir):  # noqa: ANN001, ANN201
    return dot_index(spark, sf_dir).postings.select("term", "doc_id", F.round("value", 6).alias("value"))


@query(f"WITH {_TOKENS} SELECT term, doc_id, CAST(count(*) AS INTEGER) AS value, CAST(min(pos) AS INTEGER) AS first, CAST(max(pos) AS INTEGER) AS last, CAST(sum(pos) AS BIGINT) AS total FROM tokens GROUP BY 1, 2")
def build_positions(spark, sf_dir):  # noqa: ANN001, ANN201
    total = F.aggregate("positions", F.lit(0).cast("bigint"), lambda a, p: a + p)
    return text_index(spark, sf_dir).postings.select("term", "doc_id", "value", F.array_min("positions").alias("first"), F.array_max("positions").alias("last"), total.alias("total"))


@query(f"WITH {_LINES} SELECT doc_id, CAST(sum(floor(value)) AS INTEGER) AS dl FROM lp GROUP BY 1")
def build_bow_terms(spark, sf_dir):  # noqa: ANN001, ANN201
    return lines_index(spark, sf_dir).docs.where("dl > 0")


@query(f"WITH {_POST} SELECT term, doc_id, CAST(tf AS INTEGER) AS value, CAST(dl AS INTEGER) AS dl FROM post JOIN dls USING (doc_id)")
def build_bow_text(spark, sf_dir):  # noqa: ANN001, ANN201
    return text_index(spark, sf_dir).postings.select("term", "doc_id", "value", "dl")


@query("SELECT CAST(x.r AS BIGINT) AS doc_id, CAST(coalesce(d.n, 0) AS INTEGER) AS dl FROM (SELECT unnest(range(0, (SELECT max(l_orderkey) + 1 FROM lineitem))) AS r) x LEFT JOIN (SELECT l_orderkey, sum(floor(v)) AS n FROM (SELECT l_orderkey, l_partkey, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1) d ON d.l_orderkey = x.r")
def build_dense_lengths(spark, sf_dir):  # noqa: ANN001, ANN201
    return dense(lines_index(spark, sf_dir).docs).select("doc_id", "dl")


@query(f"WITH {_POST} SELECT CAST((SELECT sum(tf) FROM post) AS BIGINT) AS tokens, CAST((SELECT count(*) FROM post) AS BIGINT) AS postings, CAST((SELECT count(DISTINCT term) FROM post) AS BIGINT) AS terms")
def build_bow_batch(spark, sf_dir):  # noqa: ANN001, ANN201
    """All texts at once: the only way to build."""
    return from_text(read(spark, sf_dir, "documents"), Analyzer("pisa")).postings.agg(F.sum("value").cast("bigint").alias("tokens"), F.count("*").alias("postings"), F.countDistinct("term").alias("terms"))


# ----------------------------------------------------------------------------------------------------------- sinks


@query(f"WITH {_LINES} SELECT 'postings' AS part, CAST(count(*) AS BIGINT) AS n FROM lp UNION ALL SELECT 'terms', CAST(count(DISTINCT term) AS BIGINT) FROM lp UNION ALL SELECT 'docs', CAST((SELECT max(l_orderkey) + 1 FROM lineitem) AS BIGINT)")
def sink_build(spark, sf_dir):  # noqa: ANN001, ANN201
    """What a written index holds, table by table."""
    index = lines_index(spark, sf_dir)
    part = lambda name, df: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    return part("postings", index.postings).unionByName(part("terms", index.terms)).unionByName(part("docs", dense(index.docs)))


@query(f"WITH {_LINES}, m AS (SELECT max(value) AS m FROM lp), r AS (SELECT term, (CAST(greatest(0, least(trunc(value / (m / 16)), 15)) AS BIGINT)) * (m / 16) + m / 32 AS v, floor((row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) / 128) AS b FROM lp, m) SELECT term, CAST(b AS INTEGER) AS block_no, CAST(count(*) AS INTEGER) AS len, max(v) AS max_value FROM r GROUP BY 1, 2")
def sink_compress(spark, sf_dir):  # noqa: ANN001, ANN201
    """Blocks of 4-bit values; a block's largest value is that of the decoded ones."""
    packed, _ = transforms.compress(lines_index(spark, sf_dir), 4)
    return transforms.blocks(packed.postings, 128, lists=False).select("term", "block_no", "len", "max_value")


@query(f"WITH {_DOT}, mx AS (SELECT max(value) AS m FROM dp), f AS (SELECT term, CAST(floor(doc_id / 64) AS BIGINT) AS block, CAST(least(greatest(trunc(value * 256 / m), 0), 255) AS INTEGER) AS q FROM dp, mx) SELECT term, block, max(q) AS q FROM f GROUP BY 1, 2")
def sink_bmp(spark, sf_dir):  # noqa: ANN001, ANN201
    """The block-max form, written and opened again."""
    return store.save_variant(approx.BlockMaxIndex.build(dot_index(spark, sf_dir)), f"{_folder(spark)}/bmp-{time.monotonic_ns()}").block_max


_LISTS = """l AS (SELECT term, doc_id FROM (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY value DESC, doc_id) AS r FROM dp) WHERE r <= 9000)"""


@query(f"WITH {_DOT}, {_LISTS} SELECT term, doc_id FROM l")
def sink_seismic(spark, sf_dir):  # noqa: ANN001, ANN201
    """The pruned form with its usual parameters, written and opened again: what its lists hold."""
    return store.save_variant(_pruned(spark, sf_dir), f"{_folder(spark)}/pruned-{time.monotonic_ns()}").lists.select("term", "doc_id")


# ------------------------------------------------------------------------------------------------------ tokenizers


@query(f"WITH {_TOKENS} SELECT term, CAST(count(*) AS BIGINT) AS n FROM tokens GROUP BY 1")
def tok_pisa(spark, sf_dir):  # noqa: ANN001, ANN201
    return read(spark, sf_dir, "documents").select(F.explode(tok.pisa(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"WITH {_UNICODE} SELECT term, CAST(count(*) AS BIGINT) AS n FROM ut GROUP BY 1")
def tok_standard(spark, sf_dir):  # noqa: ANN001, ANN201
    return read(spark, sf_dir, "documents").select(F.explode(tok.standard(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"WITH {_UNICODE} SELECT regexp_replace(term, '[''’＇]s$', '') AS term, CAST(count(*) AS BIGINT) AS n FROM ut GROUP BY 1")
def tok_lucene_english(spark, sf_dir):  # noqa: ANN001, ANN201
    return read(spark, sf_dir, "documents").select(F.explode(tok.lucene_english(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"WITH {_UNICODE} SELECT term, CAST(count(*) AS BIGINT) AS n, CAST(max(pos) AS INTEGER) AS last FROM ut WHERE length(term) <= 255 GROUP BY 1")
def tok_lucene_std(spark, sf_dir):  # noqa: ANN001, ANN201
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(tok.lucene_standard(F.col("text"))).alias("pos", "term")).where("term is not null").groupBy("term").agg(F.count("*").alias("n"), F.max("pos").alias("last"))


@query(r"SELECT term, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x1C-\x20\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]{1,255}')) AS term FROM documents) GROUP BY 1")
def tok_whitespace(spark, sf_dir):  # noqa: ANN001, ANN201
    return read(spark, sf_dir, "documents").select(F.explode(tok.whitespace(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(r"SELECT lower(term) AS term, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '(?:[\p{L}\p{N}_]\p{M}*)+')) AS term FROM documents) GROUP BY 1")
def tok_cjk(spark, sf_dir):  # noqa: ANN001, ANN201
    return read(spark, sf_dir, "documents").select(F.explode(tok.cjk(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------------------------- stems and stop words


def _stemmed(spark: SparkSession, sf_dir: str, stemmer: str, language: str) -> DataFrame:
    return Analyzer("standard", stemmer, language).tokens(read(spark, sf_dir, "documents")).groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("df"))


# The stemmers in SQL, over distinct words: each step a column of its own. Porter's measure is told by patterns.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_M0, _M1 = f"'^(?:{_C})?{_V}{_C}'", f"'^(?:{_C})?{_V}{_C}{_V}{_C}'"
_VOWEL, _SHORT = "'^(?:[^aeiou][^aeiouy]*)?[aeiouy]'", f"'^{_C}[aeiouy][^aeiouwxy]$'"
_SUFFIX2 = "ational|tional|enci|anci|izer|bli|alli|entli|eli|ousli|ization|ation|ator|alism|iveness|fulness|ousness|aliti|iviti|biliti|logi"
_SUFFIX3 = "icate|ative|alize|iciti|ical|ful|ness"
_SUFFIX4 = "al|ance|ence|er|ic|able|ible|ant|ement|ment|ent|ion|ou|ism|ate|iti|ous|ive|ize"


def _replaced(column: str, suffixes: str, to: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in to.items())
    base, end = (f"regexp_extract({column}, '^(.*?)({suffixes})$', {k})" for k in (1, 2))
    return f"CASE WHEN {end} <> '' AND regexp_matches({base}, {_M0}) THEN {base} || CASE {end} {whens} ELSE '' END ELSE {column} END"


_PORTER = (
    f"""p0 AS (SELECT DISTINCT term AS word, term AS w FROM ut WHERE length(term) >= 3 AND regexp_matches(term, '^[\\x00-\\x7F]+$')),
p1 AS (SELECT word, CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN left(w, -2) WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, -1) ELSE w END AS w FROM p0),
p2 AS (SELECT word, w, CASE WHEN w LIKE '%eed' THEN NULL WHEN w LIKE '%ed' AND regexp_matches(left(w, -2), {_VOWEL}) THEN left(w, -2) WHEN w LIKE '%ing' AND regexp_matches(left(w, -3), {_VOWEL}) THEN left(w, -3) END AS cut FROM p1),
p3 AS (SELECT word, CASE WHEN cut IS NOT NULL THEN CASE WHEN regexp_matches(cut, '(?:at|bl|iz)$') THEN cut || 'e' WHEN length(cut) > 1 AND right(cut, 1) = substring(cut, -2, 1) AND NOT regexp_matches(cut, '[aeiouylsz]$') THEN left(cut, -1)
       WHEN regexp_matches(cut, {_SHORT}) THEN cut || 'e' ELSE cut END WHEN w LIKE '%eed' AND regexp_matches(left(w, -3), {_M0}) THEN left(w, -1) ELSE w END AS w FROM p2),
p4 AS (SELECT word, CASE WHEN w LIKE '%y' AND regexp_matches(left(w, -1), {_VOWEL}) THEN left(w, -1) || 'i' ELSE w END AS w FROM p3),
p5 AS (SELECT word, {_replaced('w', _SUFFIX2, {'ational': 'ate', 'tional': 'tion', 'enci': 'ence', 'anci': 'ance', 'izer': 'ize', 'bli': 'ble', 'alli': 'al', 'entli': 'ent', 'eli': 'e', 'ousli': 'ous', 'ization': 'ize', 'ation': 'ate', 'ator': 'ate', 'alism': 'al', 'iveness': 'ive', 'fulness': 'ful', 'ousness': 'ous', 'aliti': 'al', 'iviti': 'ive', 'biliti': 'ble', 'logi': 'log'})} AS w FROM p4),
p6 AS (SELECT word, {_replaced('w', _SUFFIX3, {'icate': 'ic', 'alize': 'al', 'iciti': 'ic', 'ical': 'ic'})} AS w FROM p5),
p7 AS (SELECT word, w, regexp_extract(w, '^(.*?)({_SUFFIX4})$', 1) AS base, regexp_extract(w, '^(.*?)({_SUFFIX4})$', 2) AS suffix FROM p6),
p8 AS (SELECT word, CASE WHEN suffix <> '' AND regexp_matches(base, {_M1}) AND (suffix <> 'ion' OR regexp_matches(base, '[st]$')) THEN base ELSE w END AS w FROM p7),
p9 AS (SELECT word, CASE WHEN w LIKE '%e' AND (regexp_matches(left(w, -1), {_M1}) OR (regexp_matches(left(w, -1), {_M0}) AND NOT regexp_matches(left(w, -1), {_SHORT}))) THEN left(w, -1) ELSE w END AS w FROM p8),
st AS (SELECT word, CASE WHEN w LIKE '%ll' AND regexp_matches(w, {_M1}) THEN left(w, -1) ELSE w END AS stem FROM p9)"""
)


_BRIEF = "'^[aeiouy][^aeiouy]$|[^aeiouy][aeiouy][^aeiouywxY]$'"
_ENDS2 = "tional|enci|anci|abli|entli|izer|ization|ational|ation|ator|alism|aliti|alli|fulness|ousli|ousness|iveness|iviti|biliti|bli|ogi|fulli|lessli|li"
_ENDS3 = "tional|ational|alize|icate|iciti|ical|ful|ness|ative"
_ENDS4 = "al|ance|ence|er|ic|able|ible|ant|ement|ment|ent|ism|ate|iti|ous|ive|ize|ion"


def _porter2() -> str:
    """The second algorithm: regions as lengths, told by patterns on the word once its consonant y are marked."""
    end = lambda ends, k: f"regexp_extract(w, '^(.*?)({ends})$', {k})"
    to = lambda pairs: "CASE e " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items()) + " ELSE '' END"
    forms = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
    same = "'sky', 'news', 'howe', 'atlas', 'cosmos', 'bias', 'andes'"
    two = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less"}
    three = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic"}
    marked = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(term, '^''+', ''), '^y', 'Y'), '([aeiouyY])y', '\\1Y', 'g'), '([aeiouyY])y', '\\1Y', 'g')"
    return ", ".join(
        [
            f"a0 AS (SELECT DISTINCT term AS word, {marked} AS w FROM ut WHERE length(term) >= 3 AND regexp_matches(term, '^[\\x00-\\x7F]+$') AND term NOT IN ({same}, {', '.join(repr(k) for k in forms)}))",
            "a1 AS (SELECT word, w, CASE WHEN regexp_matches(w, '^(?:gener|commun|arsen)') THEN length(regexp_extract(w, '^(?:gener|commun|arsen)')) WHEN regexp_matches(w, '^[^aeiouy]*[aeiouy]+[^aeiouy]') THEN length(regexp_extract(w, '^[^aeiouy]*[aeiouy]+[^aeiouy]')) ELSE length(w) END AS r1 FROM a0)",
            "a2 AS (SELECT word, w, r1, CASE WHEN regexp_matches(substring(w, r1 + 1), '^[^aeiouy]*[aeiouy]+[^aeiouy]') THEN r1 + length(regexp_extract(substring(w, r1 + 1), '^[^aeiouy]*[aeiouy]+[^aeiouy]')) ELSE length(w) END AS r2 FROM a1)",
            "a3 AS (SELECT word, r1, r2, regexp_replace(w, '(?:''s''|''s|'')$', '') AS w FROM a2)",
            "a4 AS (SELECT word, r1, r2, CASE WHEN w LIKE '%sses' THEN left(w, -2) WHEN w LIKE '%ied' OR w LIKE '%ies' THEN CASE WHEN length(w) > 4 THEN left(w, -2) ELSE left(w, -1) END WHEN w LIKE '%s' AND w NOT LIKE '%us' AND w NOT LIKE '%ss' AND regexp_matches(left(w, -2), '[aeiouy]') THEN left(w, -1) ELSE w END AS w FROM a3)",
            "kept AS (SELECT word, w FROM a4 WHERE w IN ('inning', 'outing', 'canning', 'herring', 'earring', 'proceed', 'exceed', 'succeed'))",
            f"a5 AS (SELECT word, r1, r2, w, {end('eedly|eed|edly|ed|ingly|ing', 1)} AS b, {end('eedly|eed|edly|ed|ingly|ing', 2)} AS e FROM a4 WHERE word NOT IN (SELECT word FROM kept))",
            f"a6 AS (SELECT word, r1, r2, CASE WHEN e IN ('eed', 'eedly') THEN CASE WHEN length(b) >= r1 THEN b || 'ee' ELSE w END WHEN e <> '' AND regexp_matches(b, '[aeiouy]') THEN CASE WHEN regexp_matches(b, '(?:at|bl|iz)$') THEN b || 'e' WHEN regexp_matches(b, '(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(b, -1) WHEN r1 >= length(b) AND regexp_matches(b, {_BRIEF}) THEN b || 'e' ELSE b END ELSE w END AS w FROM a5)",
            "a7 AS (SELECT word, r1, r2, CASE WHEN length(w) > 2 AND regexp_matches(w, '[^aeiouy][yY]$') THEN left(w, -1) || 'i' ELSE w END AS w FROM a6)",
            f"a8 AS (SELECT word, r1, r2, w, {end(_ENDS2, 1)} AS b, {end(_ENDS2, 2)} AS e FROM a7)",
            f"a9 AS (SELECT word, r1, r2, CASE WHEN e = '' OR length(b) < r1 THEN w WHEN e = 'li' THEN CASE WHEN regexp_matches(b, '[cdeghkmnrt]$') THEN b ELSE w END WHEN e = 'ogi' AND b NOT LIKE '%l' THEN w ELSE b || {to(two)} END AS w FROM a8)",
            f"b0 AS (SELECT word, r1, r2, w, {end(_ENDS3, 1)} AS b, {end(_ENDS3, 2)} AS e FROM a9)",
            f"b1 AS (SELECT word, r1, r2, CASE WHEN e = '' OR length(b) < r1 OR (e = 'ative' AND length(b) < r2) THEN w ELSE b || {to(three)} END AS w FROM b0)",
            f"b2 AS (SELECT word, r1, r2, w, {end(_ENDS4, 1)} AS b, {end(_ENDS4, 2)} AS e FROM b1)",
            "b3 AS (SELECT word, r1, r2, CASE WHEN e = '' OR length(b) < r2 OR (e = 'ion' AND NOT regexp_matches(b, '[st]$')) THEN w ELSE b END AS w FROM b2)",
            f"b4 AS (SELECT word, CASE WHEN w LIKE '%e' THEN CASE WHEN length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT regexp_matches(left(w, -1), {_BRIEF})) THEN left(w, -1) ELSE w END WHEN w LIKE '%ll' AND length(w) - 1 >= r2 THEN left(w, -1) ELSE w END AS w FROM b3)",
            "st AS (SELECT word, lower(w) AS stem FROM (SELECT * FROM b4 UNION ALL SELECT * FROM kept UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({a!r}, {b!r})" for a, b in forms.items()) + ") f(word, w)))",
        ]
    )


def _first_case(column: str, endings: list[tuple[str, int, str, str]]) -> str:
    """The first ending of the list that a word longer than a length has, replaced; a condition may be added."""
    return "CASE " + " ".join(f"WHEN length({column}) > {n} AND {column} LIKE '%{e}'{more} THEN left({column}, -{len(e)}) || '{to}'" for e, n, to, more in endings) + f" ELSE {column} END"


_GERMAN_1 = [("ern", 5, "", ""), *((e, 4, "", "") for e in ("em", "en", "er", "es")), ("e", 3, "", ""), ("s", 3, "", " AND regexp_matches(w, '[bdfghklmnt]s$')")]
_GERMAN_2 = [("est", 5, "", ""), ("er", 4, "", ""), ("en", 4, "", ""), ("st", 4, "", " AND regexp_matches(w, '[bdfghklmnt]st$')")]
_GERMAN = (
    "g0 AS (SELECT DISTINCT term AS word, translate(replace(regexp_replace(regexp_replace(term, '([ao])e', '\\1', 'g'), '(^|[^aeiouqyäöü])ue', '\\1u', 'g'), 'ß', 'ss'), 'äàáâöòóôïìíîüùúû', 'aaaaooooiiiiuuuu') AS w FROM ut), "
    f"g1 AS (SELECT word, {_first_case('w', _GERMAN_1)} AS w FROM g0), st AS (SELECT word, {_first_case('w', _GERMAN_2)} AS stem FROM g1)"
)
_SPANISH = (
    "s0 AS (SELECT DISTINCT term AS word, translate(term, 'àáâäòóôöèéêëùúûüìíîï', 'aaaaooooeeeeuuuuiiii') AS w FROM ut), "
    f"st AS (SELECT word, {_first_case('w', [('o', 4, '', ''), ('a', 4, '', ''), ('e', 4, '', ''), ('eses', 4, 'es', ''), ('ces', 4, 'z', ''), ('os', 4, '', ''), ('as', 4, '', ''), ('es', 4, '', '')])} AS stem FROM s0)"
)
_FRENCH_WORD = [
    [("issement", 9, "ir"), ("issant", 8, "ir"), ("ement", 6, "e"), ("ficatrice", 11, "fier"), ("ficateur", 10, "fier"), ("catrice", 9, "quer"), ("cateur", 8, "quer"), ("atrice", 8, "er"), ("ateur", 7, "er")],
    [("ième", 5, ""), ("teuse", 7, "ter"), ("teur", 6, "ter"), ("euse", 5, "eu"), ("ère", 8, "er"), ("ive", 7, "if"), ("folle", 4, "fou"), ("molle", 4, "mou"), ("nnelle", 9, "n"), ("nnel", 9, "n")],
    [("esse", 8, "e"), ("inage", 7, "in"), ("isation", 9, ""), ("isateur", 9, ""), ("ation", 8, ""), ("ition", 8, "")],
]


def _french() -> str:
    """Three runs of endings, each of which ends the work; between them one ending each that doesn't."""
    hit = lambda group: "(" + " OR ".join(f"(length(w) > {n} AND w LIKE '%{e}')" for e, n, _ in group) + ")"
    step = lambda name, source, group, after: f"{name} AS (SELECT word, done OR {hit(group)} AS done, CASE WHEN done THEN w WHEN {hit(group)} THEN {_first_case('w', [(*x, '') for x in group])} ELSE {after} END AS w FROM {source})"
    one = lambda end, n, to, other: f"CASE WHEN length(w) > {n} AND w LIKE '%{end}' THEN left(w, -{len(end)}) || '{to}' ELSE {other} END"
    return ", ".join(
        [
            "f0 AS (SELECT DISTINCT term AS word, regexp_replace(term, '^(?:l|m|t|qu|n|s|j|d|c|jusqu|quoiqu|lorsqu|puisqu)[''’](.)', '\\1') AS w FROM ut)",
            "f1 AS (SELECT word, CASE WHEN length(w) > 5 AND w LIKE '%x' THEN CASE WHEN w LIKE '%aux' AND w NOT LIKE '%eaux' THEN left(w, -2) || 'l' ELSE left(w, -1) END ELSE w END AS w FROM f0)",
            "f2 AS (SELECT word, CASE WHEN length(w) > 3 AND w LIKE '%x' THEN left(w, -1) ELSE w END AS w FROM f1)",
            "f3 AS (SELECT word, false AS done, CASE WHEN length(w) > 3 AND w LIKE '%s' THEN left(w, -1) ELSE w END AS w FROM f2)",
            step("f4", "f3", _FRENCH_WORD[0], one("trice", 6, "teur", "w")),
            "f5 AS (SELECT f4.word, f4.done, CASE WHEN f4.done AND length(f3.w) > 6 AND f3.w LIKE '%iveement' THEN left(f4.w, -2) || 'f' ELSE f4.w END AS w FROM f4 JOIN f3 USING (word))",
            step("f6", "f5", _FRENCH_WORD[1], one("ète", 4, "et", "w")),
            f"f7 AS (SELECT word, done, CASE WHEN done THEN w ELSE {one('ique', 8, '', 'w')} END AS w FROM f6)",
            step("f8", "f7", _FRENCH_WORD[2], "w"),
            "f9 AS (SELECT f8.word, CASE WHEN f7.w LIKE '%isation' AND NOT f7.done AND length(f7.w) > 9 AND length(f8.w) > 5 AND f8.w LIKE '%ual' THEN left(f8.w, -2) || 'el' ELSE f8.w END AS w FROM f8 JOIN f7 USING (word))",
            "fa AS (SELECT word, CASE WHEN length(w) > 4 THEN translate(w, 'àáâôèéêùûîç', 'aaaoeeeuuic') ELSE w END AS w, length(w) > 4 AS long FROM f9)",
            "fb AS (SELECT word, CASE WHEN long THEN array_to_string(list_filter(string_split(w, ''), lambda c, i: i = 1 OR c <> substring(w, CAST(i - 1 AS BIGINT), 1) OR NOT regexp_matches(c, '\\p{L}')), '') ELSE w END AS w FROM fa)",
            "fc AS (SELECT word, CASE WHEN length(w) > 4 AND w LIKE '%ie' THEN left(w, -2) ELSE w END AS w FROM fb)",
            "fd AS (SELECT word, length(w) > 4 AS long, CASE WHEN length(w) > 4 THEN regexp_replace(w, '(?:e{0,2}r|e{1,2})$', '') ELSE w END AS w FROM fc)",
            "st AS (SELECT word, CASE WHEN long AND length(w) > 1 AND right(w, 1) = substring(w, -2, 1) AND regexp_matches(w, '\\p{L}$') THEN left(w, -1) ELSE w END AS stem FROM fd)",
        ]
    )


_COUNTED = " SELECT stem AS term, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM (SELECT doc_id, coalesce(st.stem, ut.term) AS stem FROM ut LEFT JOIN st ON st.word = ut.term) WHERE stem <> '' GROUP BY 1"


@query(f"WITH {_UNICODE}, {_PORTER}{_COUNTED}")
def stem_porter(spark, sf_dir):  # noqa: ANN001, ANN201
    return _stemmed(spark, sf_dir, "porter", "english")


@query(f"WITH {_UNICODE}, {_porter2()}{_COUNTED}")
def stem_snowball(spark, sf_dir):  # noqa: ANN001, ANN201
    return _stemmed(spark, sf_dir, "snowball", "english")


@query(f"WITH {_UNICODE}, {_GERMAN}{_COUNTED}")
def stem_de(spark, sf_dir):  # noqa: ANN001, ANN201
    return _stemmed(spark, sf_dir, "german", "german")


@query(f"WITH {_UNICODE}, {_french()}{_COUNTED}")
def stem_fr(spark, sf_dir):  # noqa: ANN001, ANN201
    return _stemmed(spark, sf_dir, "french", "french")


@query(f"WITH {_UNICODE}, {_SPANISH}{_COUNTED}")
def stem_es(spark, sf_dir):  # noqa: ANN001, ANN201
    return _stemmed(spark, sf_dir, "spanish", "spanish")


@query(f"WITH {_TOKENS} SELECT term, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM tokens GROUP BY 1")
def stem_none(spark, sf_dir):  # noqa: ANN001, ANN201
    return Analyzer("pisa").tokens(read(spark, sf_dir, "documents")).groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("df"))


_STOP = "('the', 'of', 'and', 'a', 'to', 'in')"
# The two lists that the query below takes from the library.
_STOP_EN = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
_STOP_LISTED = "('" + "', '".join(_STOP_EN.split()) + "')"


@query(f"WITH {_TOKENS} SELECT doc_id, CAST(count(*) AS BIGINT) AS dl FROM tokens WHERE term NOT IN {_STOP_LISTED} GROUP BY 1")
def stop_lists(spark, sf_dir):  # noqa: ANN001, ANN201
    return Analyzer("pisa", stop_words=tuple(stopwords.stop_words("english", "lucene"))).tokens(read(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("dl"))


@query(f"WITH {_TOKENS} SELECT doc_id, CAST(count(*) AS BIGINT) AS dl, CAST(sum(pos) AS BIGINT) AS places FROM tokens WHERE term NOT IN {_STOP} GROUP BY 1")
def stop_mode(spark, sf_dir):  # noqa: ANN001, ANN201
    return Analyzer("pisa", stop_words=STOPS, stop_mode="both").tokens(read(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("dl"), F.sum("pos").alias("places"))


@query(f"WITH {_QWORDS} SELECT qid, term, weight FROM q WHERE term NOT IN {_STOP}")
def stop_query_only(spark, sf_dir):  # noqa: ANN001, ANN201
    return Analyzer("pisa", query_stop_words=STOPS).query_terms(text_queries(spark, sf_dir))


@query(f"WITH {_TOKENS}, k AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos FROM tokens WHERE term NOT IN {_STOP}) SELECT doc_id, CAST(max(pos) AS INTEGER) AS last, CAST(sum(pos * length(term)) AS BIGINT) AS mixed FROM k GROUP BY 1")
def pos_gaps(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = Analyzer("pisa", stop_words=STOPS, position_gaps=False).tokens(read(spark, sf_dir, "documents"))
    return rows.groupBy("doc_id").agg(F.max("pos").alias("last"), F.sum(F.col("pos").cast("bigint") * F.length("term")).alias("mixed"))


@query(f"WITH {_TOKENS} SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf, CAST(min(pos) AS INTEGER) AS first FROM tokens GROUP BY 1, 2")
def analyze_doc(spark, sf_dir):  # noqa: ANN001, ANN201
    return Analyzer("pisa").tokens(read(spark, sf_dir, "documents")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.min("pos").alias("first"))


@query(f"WITH {_POST}, {_QWORDS} SELECT qid, term, weight FROM q WHERE term IN (SELECT term FROM post)")
def analyze_query(spark, sf_dir):  # noqa: ANN001, ANN201
    index = text_index(spark, sf_dir)
    return index.analyzer.query_terms(text_queries(spark, sf_dir)).join(index.terms.select("term"), "term", "left_semi").select("qid", "term", "weight")


# --------------------------------------------------------------------------------------------------------- scoring


@query(f"WITH {_DOTQ} " + _ranked("SELECT qid, dp.doc_id, sum(weight * value) AS score FROM dq JOIN dp ON dp.term = dq.term GROUP BY 1, 2"))
def score_dot(spark, sf_dir):  # noqa: ANN001, ANN201
    return _scored(search(dot_index(spark, sf_dir), dot_queries(spark, sf_dir), 10, Dot()))


@query(f"WITH {_STATS} SELECT term, round({_ROBERTSON}, 6) AS idf FROM dfs, st")
def idf_robertson(spark, sf_dir):  # noqa: ANN001, ANN201
    index = text_index(spark, sf_dir)
    return index.terms.select("term", F.round(BM25().term_factor(F.col("df"), index.stats()), 6).alias("idf"))


@query(f"WITH {_STATS} SELECT term, round(ln((st.n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM dfs, st")
def idf_lucene(spark, sf_dir):  # noqa: ANN001, ANN201
    index = text_index(spark, sf_dir)
    return index.terms.select("term", F.round(BM25(variant="lucene").term_factor(F.col("df"), index.stats()), 6).alias("idf"))


@query(f"WITH {_STATS} SELECT term, post.doc_id, round({_TF}, 6) AS part FROM post JOIN dls USING (doc_id), st")
def bm25_tf(spark, sf_dir):  # noqa: ANN001, ANN201
    index = text_index(spark, sf_dir)
    return index.postings.select("term", "doc_id", F.round(BM25().posting_factor(F.col("value"), F.col("dl"), index.stats()), 6).alias("part"))


@query(f"WITH {_POST}, {_QWORDS}, m AS (SELECT *, weight / max(weight) OVER (PARTITION BY qid) AS w FROM q) SELECT qid, term, round(9.0 * w / (8.0 + w), 6) AS weight FROM m")
def bm25_k3(spark, sf_dir):  # noqa: ANN001, ANN201
    terms = text_index(spark, sf_dir).analyzer.query_terms(text_queries(spark, sf_dir))
    return BM25(k3=8.0).query_weights(terms).select("qid", "term", F.round("weight", 6).alias("weight"))


@query(f"WITH {_STATS}, m AS (SELECT term, max(tf) AS tf, min(dl) AS dl FROM post JOIN dls USING (doc_id) GROUP BY 1) SELECT term, round({_TF}, 6) AS bound FROM m, st")
def bm25_bound(spark, sf_dir):  # noqa: ANN001, ANN201
    index = text_index(spark, sf_dir)
    return index.terms.select("term", F.round(BM25().upper_bound(F.col("max_value"), F.col("min_dl"), index.stats()), 6).alias("bound"))


# ----------------------------------------------------------------------------------------------------------- top-k


@query(_bm25())
def topk_maxscore(spark, sf_dir):  # noqa: ANN001, ANN201
    return _scored(search_text(text_index(spark, sf_dir), text_queries(spark, sf_dir), 10, model=BM25()))


@query(_bm25())
def topk_wand(spark, sf_dir):  # noqa: ANN001, ANN201
    index = text_index(spark, sf_dir)
    return _scored(search_wand(index, index.analyzer.query_terms(text_queries(spark, sf_dir)), 10, BM25()))


@query(_bm25(idf="ln((st.n - df + 0.5) / (df + 0.5) + 1)"))
def search_many(spark, sf_dir):  # noqa: ANN001, ANN201
    return _scored(search_text(text_index(spark, sf_dir), text_queries(spark, sf_dir), 10, model=BM25(variant="lucene")))


@query(_bm25(where="WHERE post.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)"))
def filter_deleted(spark, sf_dir):  # noqa: ANN001, ANN201
    return _scored(search_text(text_index(spark, sf_dir), text_queries(spark, sf_dir), 10, model=BM25(), deleted=read(spark, sf_dir, "labels").where("toxic = 1")))


@query(_bm25(where="WHERE post.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"))
def filter_allowed(spark, sf_dir):  # noqa: ANN001, ANN201
    return _scored(search_text(text_index(spark, sf_dir), text_queries(spark, sf_dir), 10, model=BM25(), allowed=read(spark, sf_dir, "labels").where("quality = 1")))


@query(_bm25(where="WHERE post.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND post.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)"))
def filter_both(spark, sf_dir):  # noqa: ANN001, ANN201
    labels = read(spark, sf_dir, "labels")
    return _scored(search_text(text_index(spark, sf_dir), text_queries(spark, sf_dir), 10, model=BM25(), deleted=labels.where("toxic = 1"), allowed=labels.where("quality = 1")))


@query(_virtual("SELECT CAST(1 AS BIGINT) AS qid, doc_id, tf FROM post WHERE term = 'and'", "(SELECT df FROM dfs WHERE term = 'and')").replace("SELECT qid, CAST(rank", "SELECT CAST(rank"))
def topk_heap(spark, sf_dir):  # noqa: ANN001, ANN201
    return _scored(search_one(text_index(spark, sf_dir), {"and": 1.0}, 10, BM25()))


@query(_bm25())
def unknown_terms(spark, sf_dir):  # noqa: ANN001, ANN201
    """Terms that no document has change nothing."""
    index = text_index(spark, sf_dir)
    terms = index.analyzer.query_terms(text_queries(spark, sf_dir))
    extra = terms.select("qid").distinct().select("qid", F.lit("no such term").alias("term"), F.lit(5.0).alias("weight"))
    return _scored(search(index, terms.unionByName(extra), 10, BM25()))


@query("SELECT CAST(doc_id AS BIGINT) AS doc_id FROM (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT unnest([1, 2, 3])) WHERE doc_id IS NOT NULL AND doc_id NOT IN (2, 5) AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def docset(spark, sf_dir):  # noqa: ANN001, ANN201
    labels = read(spark, sf_dir, "labels")
    bad = Documents(labels.where("toxic = 1")) | Documents(labels.where("quality = 0"))
    return (bad.insert(1, 2, 3).remove(2, 5) & Documents(read(spark, sf_dir, "documents").where("lang = 'en'"))).rows


# ------------------------------------------------------------------------------------------------------ structured


def _structured(spark: SparkSession, sf_dir: str, queries: dict, k: int = 10, model=None) -> DataFrame:  # noqa: ANN001
    return _scored(search_structured(text_index(spark, sf_dir), queries, k, model or BM25()))


_DF2 = "(SELECT sum(df) FROM dfs WHERE term IN ('the', 'and'))"


@query(_virtual("SELECT CAST(1 AS BIGINT) AS qid, doc_id, tf FROM post WHERE term = 'the'", "(SELECT df FROM dfs WHERE term = 'the')"))
def q_term(spark, sf_dir):  # noqa: ANN001, ANN201
    return _structured(spark, sf_dir, {1: "the"})


@query(_virtual("SELECT CAST(1 AS BIGINT) AS qid, doc_id, sum(tf) AS tf FROM post WHERE term IN ('the', 'and') GROUP BY 2", _DF2))
def q_syn(spark, sf_dir):  # noqa: ANN001, ANN201
    return _structured(spark, sf_dir, {1: "#syn(the and)"})


@query(_virtual("SELECT CAST(1 AS BIGINT) AS qid, doc_id, 1 AS tf FROM post WHERE term IN ('the', 'and') GROUP BY 2 HAVING count(*) = 2", _DF2))
def q_band(spark, sf_dir):  # noqa: ANN001, ANN201
    return _structured(spark, sf_dir, {1: "#band(the and)"})


@query(_virtual("SELECT CAST(1 AS BIGINT) AS qid, a.doc_id, count(*) AS tf FROM tokens a JOIN tokens b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'in' AND b.term = 'the' GROUP BY 2", "(SELECT floor(n / 100) FROM st)"))
def q_phrase(spark, sf_dir):  # noqa: ANN001, ANN201
    return _structured(spark, sf_dir, {1: "#1(in the)"})


_SEED = "CASE WHEN (SELECT count(*) FROM tokens t WHERE t.doc_id = d.doc_id AND t.term = 'of') <= (SELECT count(*) FROM tokens t WHERE t.doc_id = d.doc_id AND t.term = 'the') THEN 'of' ELSE 'the' END"


@query(
    _virtual(
        "SELECT CAST(1 AS BIGINT) AS qid, s.doc_id, count(DISTINCT s.pos) AS tf FROM (SELECT a.doc_id, CASE WHEN a.tf <= b.tf THEN 'of' ELSE 'the' END AS seed, CASE WHEN a.tf <= b.tf THEN 'the' ELSE 'of' END AS other FROM post a JOIN post b ON a.doc_id = b.doc_id WHERE a.term = 'of' AND b.term = 'the') d "
        "JOIN tokens s ON s.doc_id = d.doc_id AND s.term = d.seed JOIN tokens o ON o.doc_id = d.doc_id AND o.term = d.other AND abs(o.pos - s.pos) < 8 GROUP BY 2",
        "(SELECT floor(n / 100) FROM st)",
    )
)
def q_window(spark, sf_dir):  # noqa: ANN001, ANN201
    return _structured(spark, sf_dir, {1: "#uw8(of the)"})


@query(
    f"WITH {_STATS}, c AS (SELECT doc_id, 2.0 AS w, tf, (SELECT df FROM dfs WHERE term = 'the') AS df FROM post WHERE term = 'the' UNION ALL SELECT doc_id, 0.5, sum(tf), (SELECT sum(df) FROM dfs WHERE term IN ('of', 'and')) FROM post WHERE term IN ('of', 'and') GROUP BY 1) "
    + _ranked(f"SELECT CAST(1 AS BIGINT) AS qid, c.doc_id, sum(w * greatest(ln((st.n - least(df, st.n) + 0.5) / (least(df, st.n) + 0.5)), 1e-6) * {_TF}) AS score FROM c JOIN dls USING (doc_id), st GROUP BY 2")
)
def q_combine(spark, sf_dir):  # noqa: ANN001, ANN201
    return _structured(spark, sf_dir, {1: "#combine:0=2:1=0.5(the #syn(of and))"})


@query(
    f"WITH {_STATS}, c AS (SELECT doc_id, 3.0 AS w, tf, (SELECT df FROM dfs WHERE term = 'the') AS df FROM post WHERE term = 'the' UNION ALL SELECT doc_id, 2.0, tf, (SELECT df FROM dfs WHERE term = 'with') FROM post WHERE term = 'with') "
    + _ranked(f"SELECT CAST(1 AS BIGINT) AS qid, c.doc_id, sum(w * greatest(ln((st.n - df + 0.5) / (df + 0.5)), 1e-6) * {_TF}) AS score FROM c JOIN dls USING (doc_id), st GROUP BY 2")
)
def q_flatten(spark, sf_dir):  # noqa: ANN001, ANN201
    return _structured(spark, sf_dir, {1: "#combine(the #combine:0=2:1=2(the with))"})


@query(_virtual("SELECT CAST(1 AS BIGINT) AS qid, a.doc_id, 1 AS tf FROM (SELECT DISTINCT doc_id FROM post WHERE term IN ('is', 'was')) a JOIN (SELECT DISTINCT a.doc_id FROM tokens a JOIN tokens b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'in' AND b.term = 'the') b USING (doc_id)", "(SELECT sum(df) FROM dfs WHERE term IN ('is', 'was')) + (SELECT floor(n / 100) FROM st)"))
def q_virtual_df(spark, sf_dir):  # noqa: ANN001, ANN201
    return _structured(spark, sf_dir, {1: "#band(#syn(is was) #1(in the))"})


@query(
    f"WITH {_POST}, v AS (SELECT CAST(1 AS BIGINT) AS qid, doc_id, CAST(sum(tf) AS DOUBLE) AS score FROM post WHERE term IN ('the', 'and') GROUP BY 2 HAVING count(*) = 2) " + _ranked("SELECT * FROM v")
)
def q_raw(spark, sf_dir):  # noqa: ANN001, ANN201
    return _structured(spark, sf_dir, {1: {"band": ["the", "and"]}}, model=Dot())


@query(
    f"WITH {_STATS}, {_QWORDS}, b AS (SELECT qid, term, weight FROM q WHERE term IN (SELECT term FROM post)) "
    + _ranked(f"SELECT qid, post.doc_id, sum(b.weight * {_ROBERTSON} * {_TF}) AS score FROM b JOIN post ON post.term = b.term JOIN dls ON dls.doc_id = post.doc_id JOIN dfs ON dfs.term = post.term, st GROUP BY 1, 2")
)
def q_search_many(spark, sf_dir):  # noqa: ANN001, ANN201
    """Every benchmark text as a bag of words: a table of queries."""
    words = F.array_join(tok.pisa(F.col("text")), " ")
    return _scored(search_structured(text_index(spark, sf_dir), text_queries(spark, sf_dir).select("qid", words.alias("query")), 10, BM25()))


@query(f"WITH {_POST} SELECT CAST(1 AS BIGINT) AS qid, CAST(1 AS INTEGER) AS rank, doc_id, CAST(1 AS DOUBLE) AS score FROM post WHERE false")
def q_empty(spark, sf_dir):  # noqa: ANN001, ANN201
    return _structured(spark, sf_dir, {1: "#band(the nosuchwordatall)"})


# ----------------------------------------------------------------------------------------------------- approximate


_BMP = _DOTQ + """, mx AS (SELECT max(value) AS m FROM dp), f AS (SELECT term, doc_id, CAST(floor(doc_id / 64) AS BIGINT) AS block, CAST(least(greatest(trunc(value * 256 / m), 0), 255) AS INTEGER) AS q FROM dp, mx), wq AS (SELECT qid, term, CAST(ceil(weight / max(weight) OVER (PARTITION BY qid) * 32) AS BIGINT) AS weight FROM dq)"""


@query(f"WITH {_BMP} SELECT term, doc_id, q FROM f")
def bmp_quant(spark, sf_dir):  # noqa: ANN001, ANN201
    return approx.BlockMaxIndex.build(dot_index(spark, sf_dir)).forward.select("term", "doc_id", "q")


@query(f"WITH {_BMP} SELECT term, block, max(q) AS q FROM f GROUP BY 1, 2")
def bmp_blockmax(spark, sf_dir):  # noqa: ANN001, ANN201
    return approx.BlockMaxIndex.build(dot_index(spark, sf_dir)).block_max


@query(f"WITH {_BMP}, r AS (SELECT term, q, row_number() OVER (PARTITION BY term ORDER BY q DESC, doc_id) AS k FROM f) SELECT t.term, x.k, coalesce(r.q, 0) AS q FROM (SELECT DISTINCT term FROM f) t, (SELECT unnest([10, 100, 1000]) AS k) x LEFT JOIN r ON r.term = t.term AND r.k = x.k")
def bmp_kth(spark, sf_dir):  # noqa: ANN001, ANN201
    return approx.BlockMaxIndex.build(dot_index(spark, sf_dir)).kth


@query(f"WITH {_BMP} SELECT block, term, string_agg(CAST(doc_id - block * 64 AS VARCHAR) || ':' || CAST(q AS VARCHAR), ',' ORDER BY doc_id) AS entries FROM f GROUP BY 1, 2")
def bmp_fwd(spark, sf_dir):  # noqa: ANN001, ANN201
    packed = approx.BlockMaxIndex.build(dot_index(spark, sf_dir)).packed()
    return packed.select("block", "term", F.array_join(F.transform("entries", lambda e: F.concat_ws(":", e["place"].cast("string"), e["q"].cast("string"))), ",").alias("entries"))


@query(f"WITH {_BMP} " + _ranked("SELECT qid, f.doc_id, CAST(sum(wq.weight * f.q) AS DOUBLE) AS score FROM wq JOIN f ON f.term = wq.term GROUP BY 1, 2"))
def bmp_search(spark, sf_dir):  # noqa: ANN001, ANN201
    return _scored(approx.BlockMaxIndex.build(dot_index(spark, sf_dir)).search(dot_queries(spark, sf_dir)))


@query(f"WITH {_DOT}, {_LISTS} SELECT term, CAST(count(*) AS BIGINT) AS n, true AS grouped FROM l GROUP BY 1")
def seismic_build(spark, sf_dir):  # noqa: ANN001, ANN201
    """Lists and whether each is in blocks of two documents at least, but for the block of what is left."""
    blocks = _pruned(spark, sf_dir).lists.groupBy("term", "block").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))
    return blocks.groupBy("term").agg(F.sum("n").alias("n"), F.bool_and((F.col("docs") == F.col("n")) & ((F.col("block") == -1) | (F.col("n") >= 2))).alias("grouped"))


@query("SELECT true AS enough")
def seismic_recall(spark, sf_dir):  # noqa: ANN001, ANN201
    """With default parameters, whether nine in ten of the exact ten best are found."""
    index, queries = dot_index(spark, sf_dir), dot_queries(spark, sf_dir)
    found = _pruned(spark, sf_dir).search(queries, 10).select("qid", "doc_id", F.lit(1).alias("hit"))
    return search(index, queries, 10, Dot()).join(found, ["qid", "doc_id"], "left").agg((F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("enough"))


@query(f"WITH {_DOTQ} " + _ranked("SELECT qid, dp.doc_id, sum(weight * value) AS score FROM dq JOIN dp ON dp.term = dq.term GROUP BY 1, 2"))
def seismic_search(spark, sf_dir):  # noqa: ANN001, ANN201
    """With parameters that prune nothing the result is exact."""
    built = _pruned(spark, sf_dir, n_postings=10**7, centroid_fraction=0.02)
    return _scored(built.search(dot_queries(spark, sf_dir), 10, query_cut=10**6, heap_factor=0.0))


# ------------------------------------------------------------------------------------------------------ transforms


@query(f"WITH {_POST}, r AS (SELECT term, doc_id, tf, dl, floor((row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) / 128) AS b FROM post JOIN dls USING (doc_id)) SELECT term, CAST(b AS INTEGER) AS block_no, min(doc_id) AS min_doc_id, max(doc_id) AS max_doc_id, CAST(count(*) AS INTEGER) AS len, CAST(max(tf) AS DOUBLE) AS max_value, CAST(min(dl) AS INTEGER) AS min_dl FROM r GROUP BY 1, 2")
def tx_blocks(spark, sf_dir):  # noqa: ANN001, ANN201
    return transforms.blocks(text_index(spark, sf_dir).postings, 128, lists=False)


_QUANT = "CAST(greatest(0, least(trunc((value - 0.0) / (50.0 / 16)), 15)) AS BIGINT)"


@query(f"WITH {_LINES} SELECT term, doc_id, {_QUANT} AS level, {_QUANT} * (50.0 / 16) + (50.0 / 32) AS value FROM lp")
def tx_quant(spark, sf_dir):  # noqa: ANN001, ANN201
    return transforms.quantized(lines_index(spark, sf_dir).postings, transforms.QuantizerParams(4, 0.0, 50.0)).select("term", "doc_id", "level", "value")


@query(f"WITH {_LINES} SELECT CAST(8 AS INTEGER) AS nbits, CAST(0 AS DOUBLE) AS low, max(value) AS high FROM lp")
def tx_quant_range(spark, sf_dir):  # noqa: ANN001, ANN201
    p = transforms.quantizer(lines_index(spark, sf_dir).postings, 8)
    return spark.createDataFrame([(p.nbits, p.min, p.max)], "nbits int, low double, high double")


@query(f"WITH {_LINES} SELECT CAST(count(*) FILTER (WHERE value < 2 OR value > 40) AS BIGINT) AS clamped FROM lp")
def tx_clamped(spark, sf_dir):  # noqa: ANN001, ANN201
    n = transforms.clamped(lines_index(spark, sf_dir).postings, transforms.QuantizerParams(8, 2.0, 40.0))
    return spark.createDataFrame([(n,)], "clamped bigint")


@query(f"WITH {_DOT} SELECT term, doc_id, CAST(round(value * 10) AS BIGINT) AS value FROM dp")
def tx_intpack(spark, sf_dir):  # noqa: ANN001, ANN201
    return transforms.int_packed(dot_index(spark, sf_dir).postings.withColumn("value", F.col("value") * 10)).select("term", "doc_id", "value")


@query(f"WITH {_DOT}, t AS (SELECT term, list_sort(list(value)) AS v, count(*) AS n FROM dp GROUP BY 1) SELECT dp.term, dp.doc_id, CAST((CASE WHEN value >= v[CAST(trunc(0.5 * n) AS BIGINT) + 1] THEN 1 ELSE 0 END) + (CASE WHEN value >= v[CAST(trunc(0.9 * n) AS BIGINT) + 1] THEN 1 ELSE 0 END) AS INTEGER) AS split FROM dp JOIN t USING (term)")
def tx_split(spark, sf_dir):  # noqa: ANN001, ANN201
    return transforms.split(dot_index(spark, sf_dir).postings, [0.5, 0.9]).select("term", "doc_id", "split")


@query(f"WITH {_DOTQ} " + _ranked("SELECT qid, dp.doc_id, sum(weight * value) AS score FROM dq JOIN dp ON dp.term = dq.term GROUP BY 1, 2"))
def tx_split_search(spark, sf_dir):  # noqa: ANN001, ANN201
    """Scores from the shares of the split lists: their sums are the unsplit ones."""
    index = dot_index(spark, sf_dir)
    limits = transforms.split_thresholds(index.postings, [0.5, 0.9])
    parts = index.postings.join(limits, "term").select("term", "doc_id", "dl", F.explode(transforms.split_parts(F.col("value"), F.col("thresholds"))).alias("value")).where("value > 0")
    return _scored(search(Index(parts.withColumn("positions", F.lit(None).cast("array<int>")), index.docs, model=Dot()), dot_queries(spark, sf_dir), 10))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS distinct_new, CAST(count(*) AS BIGINT) AS distinct_old, CAST(0 AS BIGINT) AS least, CAST(count(*) - 1 AS BIGINT) AS most, true AS closer FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)")
def tx_reorder(spark, sf_dir):  # noqa: ANN001, ANN201
    """The permutation is one: as many new as old numbers, without gaps; and it brings like documents closer: log-gaps fall."""
    index = text_index(spark, sf_dir)
    m = transforms.reorder_map(index)
    gap = lambda postings: transforms.log_gap(postings.select("term", "doc_id"))
    both = gap(transforms.renumbered(index.postings.select("term", "doc_id"), m)).withColumnRenamed("log_gap", "after").crossJoin(gap(index.postings))  # one row each
    counts = m.agg(F.count("*").alias("n"), F.countDistinct("new_id").alias("distinct_new"), F.countDistinct("doc_id").alias("distinct_old"), F.min("new_id").alias("least"), F.max("new_id").alias("most"))
    return counts.crossJoin(both.select((F.col("after") < F.col("log_gap")).alias("closer")))


@query()
def tx_reorder_map(spark, sf_dir):  # noqa: ANN001, ANN201
    return transforms.reorder_map(text_index(spark, sf_dir))


@query(f"WITH {_LINES}, g AS (SELECT doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), -1) AS gap FROM lp) SELECT round(sum(log2(gap + 1)), 2) AS log_gap FROM g")
def tx_loggap(spark, sf_dir):  # noqa: ANN001, ANN201
    return transforms.log_gap(lines_index(spark, sf_dir).postings).select(F.round("log_gap", 2).alias("log_gap"))


# -------------------------------------------------------------------------------------------------------- segments


def _segments(spark: SparkSession, sf_dir: str) -> SegmentedIndex:
    index = dot_index(spark, sf_dir)
    part = lambda i: Index(index.postings.where(F.col("doc_id") % 3 == i), index.docs.where(F.col("doc_id") % 3 == i), options=index.options)
    return SegmentedIndex([part(i) for i in range(3)])


def _segmented(where: str = "") -> str:
    return f"WITH {_DOTQ}, s AS (SELECT qid, CAST(dp.doc_id % 3 AS INTEGER) AS segment, dp.doc_id, sum(weight * value) AS score FROM dq JOIN dp ON dp.term = dq.term {where} GROUP BY 1, 2, 3) SELECT qid, CAST(rank AS INTEGER) AS rank, segment, doc_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, segment, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"


@query(_segmented())
def seg_search(spark, sf_dir):  # noqa: ANN001, ANN201
    return _scored(_segments(spark, sf_dir).search(dot_queries(spark, sf_dir)))


@query(_segmented("WHERE NOT (dp.doc_id % 3 = 1 AND dp.doc_id % 2 = 0)"))
def seg_filter(spark, sf_dir):  # noqa: ANN001, ANN201
    gone = dot_index(spark, sf_dir).docs.where("doc_id % 2 = 0").select("doc_id")
    return _scored(_segments(spark, sf_dir).search(dot_queries(spark, sf_dir), deleted=[None, gone, None]))


_EDITED = """CASE WHEN doc_id % 10 = 0 THEN 'replaced text ' || CAST(doc_id AS VARCHAR) ELSE text END"""
_NOW = _STATS.replace("FROM documents)", f"FROM (SELECT doc_id, {_EDITED} AS text FROM documents WHERE doc_id % 7 <> 3))", 1)
# n: one more than the largest number that is left
_NOW = _NOW.replace("(SELECT max(doc_id) + 1 FROM documents)", "(SELECT max(doc_id) + 1 FROM documents WHERE doc_id % 7 <> 3)")


_NOW_SQL = f"WITH {_NOW}, {_QWORDS} " + _ranked(f"SELECT qid, post.doc_id, sum(q.weight * {_ROBERTSON} * {_TF}) AS score FROM q JOIN post ON post.term = q.term JOIN dls ON dls.doc_id = post.doc_id JOIN dfs ON dfs.term = post.term, st GROUP BY 1, 2")


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All documents, replacements of every tenth, deletions of every seventh (from the third on)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.lit(1).cast("bigint").alias("version"), F.lit(False).alias("deleted"))
    edits = docs.where("doc_id % 10 = 0").withColumn("text", F.concat(F.lit("replaced text "), F.col("doc_id").cast("string"))).withColumn("version", F.lit(2).cast("bigint"))
    return docs, edits, docs.where("doc_id % 7 = 3").withColumn("deleted", F.lit(True)).withColumn("version", F.lit(3).cast("bigint"))


def _maintained(spark: SparkSession, batches: tuple[DataFrame, ...]) -> Incremental:
    kept = Incremental(spark, f"{_folder(spark)}/segments-{time.monotonic_ns()}", Analyzer("pisa"))
    for number, batch in enumerate(batches):
        kept.write_segment(batch, number)
    return kept


@query(_NOW_SQL)
def seg_upsert(spark, sf_dir):  # noqa: ANN001, ANN201
    kept = _maintained(spark, _changes(spark, sf_dir))
    return _scored(kept.search(kept.analyzer.query_terms(text_queries(spark, sf_dir)), 10, BM25()))


@query(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version, CAST(CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS INTEGER) AS segment FROM documents WHERE doc_id % 7 <> 3")
def seg_delete(spark, sf_dir):  # noqa: ANN001, ANN201
    """The latest version of each document that isn't deleted, and the segment that holds it."""
    return _maintained(spark, _changes(spark, sf_dir)).current().select("doc_id", "version", "segment")


@query(_NOW_SQL)
def seg_merge(spark, sf_dir):  # noqa: ANN001, ANN201
    """After all segments were rewritten as one nothing changes."""
    kept = _maintained(spark, _changes(spark, sf_dir))
    kept.merge()
    return _scored(kept.search(kept.analyzer.query_terms(text_queries(spark, sf_dir)), 10, BM25()))


@query(_bm25())
def seg_buffer_search(spark, sf_dir):  # noqa: ANN001, ANN201
    """Half of the documents in a segment, the others not flushed yet."""
    docs = _changes(spark, sf_dir)[0]
    kept = _maintained(spark, (docs.where("doc_id % 2 = 0"),))
    return _scored(kept.search_with_buffer(kept.analyzer.query_terms(text_queries(spark, sf_dir)), docs.where("doc_id % 2 = 1").select("doc_id", "text"), 10, BM25()))


# -------------------------------------------------------------------------------------------------- document store


def _pages(spark: SparkSession, sf_dir: str) -> DocStore:
    pages = read(spark, sf_dir, "pages").where("page_id is not null")
    return DocStore.build(pages, "page_id", {"url": "url", "page": "page_id"}, "html", check=False)


@query("SELECT CAST(page_id AS BIGINT) AS doc_id, url, CAST(page_id AS VARCHAR) AS page, CAST(strlen(html) AS INTEGER) AS n_bytes FROM pages WHERE page_id IS NOT NULL")
def ds_build(spark, sf_dir):  # noqa: ANN001, ANN201
    return _pages(spark, sf_dir).docs.select("doc_id", F.try_element_at("keys", F.lit("url")).alias("url"), F.try_element_at("keys", F.lit("page")).alias("page"), F.octet_length("content").alias("n_bytes"))


@query("SELECT 'url' AS key, url AS value, CAST(count(*) AS BIGINT) AS n FROM pages WHERE url IS NOT NULL GROUP BY 2 HAVING count(*) > 1")
def ds_unique(spark, sf_dir):  # noqa: ANN001, ANN201
    return _pages(spark, sf_dir).duplicates()


@query("SELECT CAST(item_id AS BIGINT) AS place, CAST(item_id * 3 AS BIGINT) AS doc_id, CAST(strlen(html) AS INTEGER) AS n_bytes FROM benchmark LEFT JOIN pages ON page_id = item_id * 3")
def ds_get_number(spark, sf_dir):  # noqa: ANN001, ANN201
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("place"), (F.col("item_id") * 3).alias("doc_id"))
    return _pages(spark, sf_dir).get_by_number(asked, check=False).select("place", "doc_id", F.octet_length("content").alias("n_bytes"))


@query("SELECT CAST(page_id AS BIGINT) AS place, CAST(page_id * 2 AS VARCHAR) AS value, (SELECT CAST(p.page_id AS BIGINT) FROM pages p WHERE p.page_id = pages.page_id * 2) AS doc_id FROM pages")
def ds_get_numbers(spark, sf_dir):  # noqa: ANN001, ANN201
    asked = read(spark, sf_dir, "pages").select(F.col("page_id").alias("place"), (F.col("page_id") * 2).cast("string").alias("value"))
    return _pages(spark, sf_dir).get_numbers("page", asked)


@query("SELECT CAST(page_id AS BIGINT) AS place, CAST(page_id AS BIGINT) AS doc_id, url AS value FROM pages")
def ds_get_keys(spark, sf_dir):  # noqa: ANN001, ANN201
    asked = read(spark, sf_dir, "pages").select(F.col("page_id").alias("place"), F.col("page_id").alias("doc_id"))
    return _pages(spark, sf_dir).get_keys("url", asked)


@query("SELECT CAST(page_id AS BIGINT) AS place, CAST(page_id AS BIGINT) AS doc_id, CAST(strlen(html) AS INTEGER) AS n_bytes FROM pages")
def ds_get_by_key(spark, sf_dir):  # noqa: ANN001, ANN201
    asked = read(spark, sf_dir, "pages").select(F.col("page_id").alias("place"), F.col("page_id").cast("string").alias("value"))
    return _pages(spark, sf_dir).get_by_key("page", asked).select("place", "doc_id", F.octet_length("content").alias("n_bytes"))


@query("SELECT CAST(page_id AS BIGINT) AS doc_id, url, true AS without_content FROM pages WHERE page_id IS NOT NULL")
def ds_keys_only(spark, sf_dir):  # noqa: ANN001, ANN201
    return _pages(spark, sf_dir).keys_only().docs.select("doc_id", F.try_element_at("keys", F.lit("url")).alias("url"), F.col("content").isNull().alias("without_content"))


@query("SELECT CAST(max(page_id) + 1 AS BIGINT) AS num_documents, CAST(count(*) AS BIGINT) AS stored, count(html) > 0 AS has_content FROM pages WHERE page_id IS NOT NULL")
def ds_meta(spark, sf_dir):  # noqa: ANN001, ANN201
    m = _pages(spark, sf_dir).meta()
    return spark.createDataFrame([(m["num_documents"], m["stored"], m["has_content"])], "num_documents bigint, stored bigint, has_content boolean")


@query("SELECT CAST(x.r AS BIGINT) AS doc_id, p.page_id IS NOT NULL AS stored FROM (SELECT unnest(range(0, 2 * (SELECT count(*) FROM pages), 7)) AS r) x LEFT JOIN pages p ON p.page_id = x.r")
def ds_contains(spark, sf_dir):  # noqa: ANN001, ANN201
    n = read(spark, sf_dir, "pages").count()
    return _pages(spark, sf_dir).contains(spark.range(0, 2 * n, 7).withColumnRenamed("id", "doc_id"))


# ------------------------------------------------------------------------------------------------------ evaluation


def _qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled document is relevant, if of good quality, for the query numbered by its remainder."""
    return read(spark, sf_dir, "labels").select((F.col("doc_id") % 40).alias("qid"), "doc_id", F.col("quality").alias("relevance"))


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    index = text_index(spark, sf_dir)
    queries = index.analyzer.query_terms(text_queries(spark, sf_dir))
    return search(index, queries, 10, BM25()), search(index, queries, 10, BM25(k1=0.9, b=0.4))


def _run_sql(name: str, tf: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (SELECT qid, post.doc_id, sum(q.weight * {_ROBERTSON} * {tf}) AS score FROM q JOIN post ON post.term = q.term JOIN dls ON dls.doc_id = post.doc_id JOIN dfs ON dfs.term = post.term, st GROUP BY 1, 2)) WHERE rank <= 10)"


_TF2 = "tf / (0.9 * 0.6 + 0.9 * 0.4 * dl / st.avgdl + tf)"
_EVAL = f"WITH {_STATS}, {_QWORDS}, {_run_sql('r', _TF)}, {_run_sql('r2', _TF2)}, rel AS (SELECT doc_id % 40 AS qid, doc_id, quality AS relevance FROM labels)"


@query(f"{_EVAL}, b AS (SELECT r.qid, min(rank) AS k FROM r JOIN rel ON rel.qid = r.qid AND rel.doc_id = r.doc_id AND relevance > 0 GROUP BY 1) SELECT round(avg(coalesce(1.0 / b.k, 0)), 6) AS mrr, CAST(count(*) AS BIGINT) AS n_queries FROM (SELECT DISTINCT qid FROM r WHERE qid IN (SELECT qid FROM rel)) a LEFT JOIN b USING (qid)")
def ev_mrr(spark, sf_dir):  # noqa: ANN001, ANN201
    return evaluate.mrr(_runs(spark, sf_dir)[0], _qrels(spark, sf_dir)).select(F.round("mrr", 6).alias("mrr"), "n_queries")


@query(
    f"{_EVAL}, g AS (SELECT DISTINCT qid, doc_id, relevance FROM rel WHERE relevance > 0), i AS (SELECT qid, sum(CASE WHEN p <= 10 THEN relevance / log2(p + 1) ELSE 0 END) AS best, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, doc_id) AS p FROM g) GROUP BY 1), "
    "h AS (SELECT r.qid, sum(relevance / log2(rank + 1)) AS dcg, count(*) AS found, min(rank) AS first FROM r JOIN g ON g.qid = r.qid AND g.doc_id = r.doc_id GROUP BY 1) "
    "SELECT i.qid, round(coalesce(dcg / best, 0), 6) AS ndcg, round(coalesce(1.0 / first, 0), 6) AS rr, round(coalesce(found / n, 0), 6) AS recall FROM i LEFT JOIN h USING (qid)"
)
def ev_metrics(spark, sf_dir):  # noqa: ANN001, ANN201
    return evaluate.metrics(_runs(spark, sf_dir)[0], _qrels(spark, sf_dir)).select("qid", *(F.round(c, 6).alias(c) for c in ("ndcg", "rr", "recall")))


@query(f"{_EVAL} SELECT round(CAST(count(r2.doc_id) AS DOUBLE) / count(*), 6) AS exact_recall FROM r LEFT JOIN r2 ON r2.qid = r.qid AND r2.doc_id = r.doc_id")
def ev_exact_recall(spark, sf_dir):  # noqa: ANN001, ANN201
    a, b = _runs(spark, sf_dir)
    return evaluate.exact_recall(b, a).select(F.round("exact_recall", 6).alias("exact_recall"))


@query(f"{_EVAL} SELECT coalesce(r.qid, r2.qid) AS qid, round(CAST(count(*) FILTER (WHERE r.doc_id IS NOT NULL AND r2.doc_id IS NOT NULL) AS DOUBLE) / count(*), 6) AS overlap FROM r FULL JOIN r2 ON r2.qid = r.qid AND r2.doc_id = r.doc_id GROUP BY 1")
def ev_overlap(spark, sf_dir):  # noqa: ANN001, ANN201
    return evaluate.overlap(*_runs(spark, sf_dir)).select("qid", F.round("overlap", 6).alias("overlap"))


# ------------------------------------------------------------------------------------------------------- numbering


@query(SQL["src_vocab"])
def build_vocab_ids(spark, sf_dir):  # noqa: ANN001, ANN201
    return text_index(spark, sf_dir).vocabulary()


@query("SELECT item_id, CAST(row_number() OVER (ORDER BY text, item_id) - 1 AS BIGINT) AS place FROM benchmark")
def numbering(spark, sf_dir):  # noqa: ANN001, ANN201
    return numbered(read(spark, sf_dir, "benchmark"), ["text", "item_id"], "place").select("item_id", "place")
