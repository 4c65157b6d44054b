"""Scores as column expressions: a model says how postings weigh, given collection statistics."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Stats:
    """Of a collection: n is the largest document number plus one, gaps included."""

    n: int
    avgdl: float
    min_dl: int


class Model(Protocol):
    """What search needs of a scoring model; each part is a column expression."""

    needs_df: bool

    def term_factor(self, df: Column, stats: Stats) -> Column: ...

    def posting_factor(self, value: Column, dl: Column, stats: Stats) -> Column: ...

    def query_weights(self, queries: DataFrame) -> DataFrame: ...

    def upper_bound(self, max_value: Column, min_dl: Column, stats: Stats) -> Column: ...


@dataclass(frozen=True)
class Dot:
    """The stored impacts themselves."""

    needs_df: bool = False

    def term_factor(self, df: Column, stats: Stats) -> Column:  # noqa: ARG002
        return F.lit(1.0)

    def posting_factor(self, value: Column, dl: Column, stats: Stats) -> Column:  # noqa: ARG002
        return value.cast("double")

    def query_weights(self, queries: DataFrame) -> DataFrame:
        return queries

    def upper_bound(self, max_value: Column, min_dl: Column, stats: Stats) -> Column:  # noqa: ARG002
        return max_value.cast("double")


def idf(df: Column, n: int, variant: str = "robertson") -> Column:
    """robertson: ln((n - df + .5) / (df + .5)), at least 1e-6; lucene: ln(1 + the same ratio)."""
    df = F.least(df.cast("double"), F.lit(float(n)))
    ratio = (F.lit(float(n)) - df + 0.5) / (df + 0.5)
    return F.greatest(F.ln(ratio), F.lit(1e-6)) if variant == "robertson" else F.log1p(ratio)


@dataclass(frozen=True)
class BM25:
    """idf * tf / (k1 * (1 - b + b * dl / avgdl) + tf); with k3, query weights saturate."""

    k1: float = 1.2
    b: float = 0.75
    variant: str = "robertson"
    k3: float | None = None
    needs_df: bool = True

    def __post_init__(self) -> None:
        if self.variant not in ("robertson", "lucene"):
            raise ValueError(f"unknown BM25 variant '{self.variant}', expected 'robertson' or 'lucene'")

    def norm(self, dl: Column, stats: Stats) -> Column:
        return F.lit(self.k1 * (1 - self.b)) + F.lit(self.k1 * self.b) * dl.cast("double") / F.lit(stats.avgdl or 1.0)

    def term_factor(self, df: Column, stats: Stats) -> Column:
        return idf(df, stats.n, self.variant)

    def posting_factor(self, value: Column, dl: Column, stats: Stats) -> Column:
        return value.cast("double") / (self.norm(dl, stats) + value.cast("double"))

    def query_weights(self, queries: DataFrame) -> DataFrame:
        """Weights divided by the query's largest, w, then (k3 + 1) w / (k3 + w); as they are without k3 or where none is above zero."""
        if self.k3 is None:
            return queries
        top = F.max("weight").over(Window.partitionBy("qid"))
        w = F.col("weight") / F.col("_top")
        return queries.withColumn("_top", top).withColumn("weight", F.when(F.col("_top") > 0, (self.k3 + 1) * w / (self.k3 + w)).otherwise(F.col("weight"))).drop("_top")

    def upper_bound(self, max_value: Column, min_dl: Column, stats: Stats) -> Column:
        """What no posting exceeds whose value is at most max_value in documents of at least min_dl tokens."""
        return max_value.cast("double") / (self.norm(F.coalesce(min_dl, F.lit(0)), stats) + max_value.cast("double"))
