"""Ranks within keys, for keys of any size: one key's rows may be spread over many tasks."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs within go once these have ended, so that disk holds one of them at a time."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def ranked(rows: DataFrame, key: str, order: list[str], rank: str = "rank", previous: str | None = None) -> DataFrame:
    """rows with a rank from 1 within the key, by ascending order columns; previous: the row before's first order column.

    Rows are dealt by ranges of (key, order), so a frequent key fills several partitions. Each is ranked by itself;
    only keys that span partitions (fewer than there are partitions) need the counts of the partitions before.
    """
    parts = rows.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    counts = parts.groupBy(key, "_part").agg(F.count("*").alias("n"), F.max(order[0]).alias("last"))
    wide = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_part", "n", "last"))).alias("parts")).where(F.size("parts") > 1)
    shifts = []
    for r in wide.toLocalIterator():
        before, last = 0, None
        for p in r["parts"]:
            shifts.append((r[key], p["_part"], before, last))
            before, last = before + p["n"], p["last"]
    kinds = dict(rows.dtypes)
    shift = rows.sparkSession.createDataFrame(shifts, f"`{key}` {kinds[key]}, _part int, _before bigint, _last {kinds[order[0]]}")
    own = Window.partitionBy("_part", key).orderBy(*order)
    out = parts.withColumn(rank, F.row_number().over(own).cast("bigint"))
    if previous:
        out = out.withColumn(previous, F.lag(order[0]).over(own))
    out = out.join(F.broadcast(shift), [key, "_part"], "left").withColumn(rank, F.col(rank) + F.coalesce("_before", F.lit(0)))
    if previous:
        out = out.withColumn(previous, F.coalesce(previous, "_last"))
    return out.drop("_part", "_before", "_last")


#: Places that picked() looks up by counts, at most; for more of them, values are ranked.
FEW = 1000
#: Bits of a value that a pass settles.
STEP = 16


def _places(values: np.ndarray) -> np.ndarray:
    """Doubles as whole numbers in the same order."""
    return _flipped((values + 0.0).view(np.int64))


def _flipped(bits: np.ndarray) -> np.ndarray:
    """Negative doubles' bits descend: all but the sign are turned; its own inverse."""
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def picked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (term, j, rank) with the value at that rank from 1 of the term's ascending values (term, value); null past the end.

    The bits of the values are settled from the first ones on, by counts of values that begin alike: four passes over
    the rows, and no list is shuffled or sorted.
    """
    values = rows.select(F.col("term").cast("string").alias("term"), F.col("value").cast("double").alias("value"))
    wanted = wanted.select("term", F.col("j").cast("int").alias("j"), F.col("rank").cast("bigint").alias("rank"))
    asked = wanted.limit(FEW + 1).collect()
    if len(asked) > FEW:
        return wanted.join(ranked(values, "term", ["value"]), ["term", "rank"], "left").select("term", "j", "rank", "value")
    spark, sought = rows.sparkSession, [(r["term"], r["j"], 0, r["rank"]) for r in asked]
    for done in range(STEP, 65, STEP):
        starts: dict[str, set[int]] = {}
        for term, _, start, _ in sought:
            starts.setdefault(term, set()).add(start)

        def count(batches: Iterator[pa.RecordBatch], done=done, starts=starts) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                coded = batch.column(0).dictionary_encode()
                code, key = coded.indices.to_numpy(zero_copy_only=False), _places(batch.column(1).to_numpy(zero_copy_only=False))
                for i, term in enumerate(coded.dictionary.to_pylist()):
                    own = key[code == i]
                    if done > STEP:
                        own = own[np.isin(own >> (64 - done + STEP), list(starts.get(term, ())))]
                    part, n = np.unique(own >> (64 - done), return_counts=True)
                    start = part >> STEP if done > STEP else np.zeros(len(part), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([term] * len(part), pa.string()), pa.array(start), pa.array(part), pa.array(n.astype(np.int64))], names=["term", "start", "part", "n"])

        counts = values.mapInArrow(count, "term string, start bigint, part bigint, n bigint").groupBy("term", "start", "part").agg(F.sum("n").alias("n"))
        counts = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("term", "start").orderBy("part")))  # 2**STEP rows at most
        table = F.broadcast(spark.createDataFrame(sought, "term string, j int, start bigint, rank bigint"))
        found = counts.join(table, ["term", "start"]).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        with tidy(spark):
            sought = [(r["term"], r["j"], r["part"], r["rank"] - r["upto"] + r["n"]) for r in found.collect()]
    exact = {(term, j): float(_flipped(np.array([key])).view(float)[0]) for term, j, key, _ in sought}
    out = spark.createDataFrame([(r["term"], r["j"], r["rank"], exact.get((r["term"], r["j"]))) for r in asked], "term string, j int, rank bigint, value double")
    out._tarn_few = True
    return out
