"""The relations of an index, and checks of what is put into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSTINGS = "term string, doc_id bigint, value double, dl int, positions array<int>"
DOCS = "doc_id bigint, dl int"
TERMS = "term string, df bigint, cf double, max_value double, max_doc_id bigint, min_dl int"
RESULTS = "qid bigint, rank int, doc_id bigint, score double"
SEGMENT_RESULTS = "qid bigint, rank int, segment int, doc_id bigint, score double"
QUERIES = "qid bigint, term string, weight double"
DOCSTORE = "doc_id bigint, keys map<string,string>, content binary"

#: Names of value types and the Spark types that hold them; half-width floats are kept as float.
DTYPES = {"float16": "float", "bfloat16": "float", "float32": "float", "float64": "double", "int32": "int", "int64": "bigint"}


def demand(condition: Column, value: Column, message: str) -> Column:
    """value where the condition holds; elsewhere the job fails with the message."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)).cast("string").try_cast("double"))


def check_postings(postings: DataFrame) -> DataFrame:
    """Fails, when it runs, on values that aren't above zero and on positions that aren't one for each occurrence, ascending.

    The checks ride along as a projection; no pass over the data is added.
    """
    value = demand(F.col("value") > 0, F.col("value"), "impact values must be greater than zero")
    checked = postings.withColumn("value", value)
    if "positions" in postings.columns:
        p = F.col("positions")
        ascending = F.size(F.array_distinct(p)) == F.size(p)
        good = p.isNull() | ((F.size(p) > 0) & ascending & (F.array_sort(p) == p) & (F.size(p) == F.col("value")))
        checked = checked.withColumn("value", demand(good, F.col("value"), "positions must be non-empty, strictly increasing and as many as the term frequency"))
    return checked
