import os

DATA = "/root/testdata/sf0.001"
HAS_DATA = os.path.isdir(DATA)
#: Columns whose names clash with those that operators use within.
EXTRA = {"score": "1.0D", "label": "'x'", "count": "2", "first": "3", "text_": "'y'", "_pii": "4", "spans": "5", "n": "6", "rank": "7"}


def documents(spark, rows, extra=True):
    """rows of (doc_id, text) as documents with all columns, and more."""
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return df.selectExpr("*", *(f"{v} AS {k}" for k, v in EXTRA.items())) if extra else df


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
