"""Ranking evaluation. Runs are (qid, rank, doc_id, score); judgements (qid, doc_id, relevance), relevant above zero."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reciprocal_ranks(run: DataFrame, qrels: DataFrame, k: int = 10, asked: DataFrame | None = None) -> DataFrame:
    """qid, rr over queries of `asked` (by default those in the run) that have judgements; no hit counts 0."""
    judged = qrels.select("qid").distinct()
    queries = (asked if asked is not None else run).select("qid").distinct().join(judged, "qid", "left_semi")
    hits = run.where(F.col("rank") <= k).join(qrels.where("relevance > 0").select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_semi")
    return queries.join(hits.groupBy("qid").agg(F.min("rank").alias("r")), "qid", "left").select("qid", F.coalesce(1 / F.col("r").cast("double"), F.lit(0.0)).alias("rr"))


def mrr(run: DataFrame, qrels: DataFrame, k: int = 10, asked: DataFrame | None = None) -> DataFrame:
    return reciprocal_ranks(run, qrels, k, asked).agg(F.avg("rr").alias("mrr"), F.count("*").alias("n_queries"))


def metrics(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """qid, ndcg, rr, recall at k for each judged query."""
    good = qrels.where("relevance > 0").groupBy("qid", "doc_id").agg(F.max("relevance").alias("relevance"))
    gain = lambda place: F.col("relevance").cast("double") / F.log2(F.col(place).cast("double") + 1)
    ideal = good.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("relevance").desc(), "doc_id")))
    ideal = ideal.groupBy("qid").agg(F.sum(F.when(F.col("place") <= k, gain("place")).otherwise(0.0)).alias("best"), F.count("*").alias("relevant"))
    hits = run.where(F.col("rank") <= k).join(good, ["qid", "doc_id"])
    got = hits.groupBy("qid").agg(F.sum(gain("rank")).alias("dcg"), F.count("*").alias("found"), F.min("rank").alias("first"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.join(got, "qid", "left").select("qid", zero(F.col("dcg") / F.col("best")).alias("ndcg"), zero(1 / F.col("first").cast("double")).alias("rr"), zero(F.col("found") / F.col("relevant")).alias("recall"))


def exact_recall(run: DataFrame, exact: DataFrame, k: int = 10) -> DataFrame:
    """The share of an exact run's top k that a run has."""
    want = exact.where(F.col("rank") <= k).select("qid", "doc_id")
    have = run.where(F.col("rank") <= k).select("qid", "doc_id", F.lit(1).alias("_h"))
    return want.join(have, ["qid", "doc_id"], "left").agg((F.count("_h") / F.count("*")).alias("exact_recall"))


def overlap(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """qid, overlap: Jaccard of the two top-k sets of each query that has either."""
    x = a.where(F.col("rank") <= k).select("qid", "doc_id", F.lit(1).alias("_a"))
    y = b.where(F.col("rank") <= k).select("qid", "doc_id", F.lit(1).alias("_b"))
    both = x.join(y, ["qid", "doc_id"], "full_outer")
    return both.groupBy("qid").agg((F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()) / F.count("*")).alias("overlap"))


def query_families(words: list[str]) -> dict[str, str]:
    """Structured forms of a bag of words, as a workload: bow, phrase, uw8, syn, band and a sequential dependence mix."""
    text, pairs = " ".join(words), list(zip(words, words[1:], strict=False))
    out = {"bow": text}
    if pairs:
        phrases = " ".join(f"#1({a} {b})" for a, b in pairs)
        near = " ".join(f"#uw8({a} {b})" for a, b in pairs)
        out |= {"phrase": phrases, "uw8": near, "syn": f"#syn({text})", "band": f"#band({text})"}
        out["sdm"] = f"#combine:0=0.85:1=0.1:2=0.05(#combine({text}) #combine({phrases}) #combine({near}))"
    return out
