"""A store of documents by number and by keys: keys map<string,string>, content binary."""

from __future__ import annotations

import asyncio
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators.index import numbered


@dataclass
class DocStore:
    docs: DataFrame

    @staticmethod
    def build(docs: DataFrame, numbers: str | None = "doc_id", keys: dict[str, str] | None = None, content: str | None = None, order: list[str] | None = None, check: bool = True) -> DocStore:
        """keys: {key name: column}. Without a column of numbers documents are numbered in the given order.

        Numbers must not repeat, nor a key's value: checking is one aggregation over keys alone.
        """
        rows = docs if numbers else numbered(docs, order or list((keys or {}).values()), "doc_id")
        pairs = [F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("v")) for k, c in (keys or {}).items()]
        present = F.filter(F.array(*pairs), lambda x: x["v"].isNotNull()) if pairs else F.array().cast("array<struct<k:string,v:string>>")
        body = F.col(content).cast("binary") if content else F.lit(None).cast("binary")
        store = DocStore(rows.select(F.col(numbers or "doc_id").cast("bigint").alias("doc_id"), F.map_from_entries(present).alias("keys"), body.alias("content")))
        if check:
            store.check()
        return store

    def check(self) -> None:
        twice = self.duplicates().first()
        if twice is not None:
            raise ValueError(f"duplicate value '{twice['value']}' for key '{twice['key']}'")
        again = self.docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").first()
        if again is not None:
            raise ValueError(f"document number {again['doc_id']} is given twice")

    def exploded(self) -> DataFrame:
        """doc_id, key, value."""
        return self.docs.select("doc_id", F.explode("keys").alias("key", "value"))

    def duplicates(self) -> DataFrame:
        """key, value, n of values that more than one document has."""
        return self.exploded().groupBy("key", "value").agg(F.count("*").alias("n")).where("n > 1")

    def key_names(self) -> list[str]:
        return sorted(r["key"] for r in self.exploded().select("key").distinct().collect())

    def meta(self) -> dict:
        """num_documents (largest number + 1), stored documents and whether there is content."""
        r = self.docs.agg(F.coalesce(F.max("doc_id") + 1, F.lit(0)).alias("n"), F.count("*").alias("stored"), F.count("content").alias("with_content")).first()
        return {"num_documents": r["n"], "stored": r["stored"], "has_content": r["with_content"] > 0}

    def _known(self, key: str) -> None:
        if key not in self.key_names():
            raise KeyError(f"unknown key '{key}'")

    def get_by_number(self, numbers: list[int] | DataFrame, check: bool = True) -> DataFrame:
        """place, doc_id, keys, content in the order of the request (place, doc_id); a number that isn't stored is an error."""
        asked = numbers if isinstance(numbers, DataFrame) else self.docs.sparkSession.createDataFrame(list(enumerate(map(int, numbers))), "place bigint, doc_id bigint")
        got = asked.join(self.docs.withColumn("_found", F.lit(True)), "doc_id", "left")
        if check:
            missing = got.where("_found is null").select("doc_id").first()
            if missing is not None:
                raise KeyError(f"no document {missing['doc_id']}")
        return got.select("place", "doc_id", "keys", "content").orderBy("place")

    def get_numbers(self, key: str, values: list[str] | DataFrame, check: bool = True) -> DataFrame:
        """place, value, doc_id (null where no document has the value)."""
        if check:
            self._known(key)
        asked = values if isinstance(values, DataFrame) else self.docs.sparkSession.createDataFrame(list(enumerate(values)), "place bigint, value string")
        own = self.exploded().where(F.col("key") == key).select("value", "doc_id")
        return asked.join(own, "value", "left").select("place", "value", "doc_id").orderBy("place")

    def get_keys(self, key: str, numbers: list[int] | DataFrame, check: bool = True) -> DataFrame:
        """place, doc_id, value (null where the document is missing or lacks the key)."""
        if check:
            self._known(key)
        asked = numbers if isinstance(numbers, DataFrame) else self.docs.sparkSession.createDataFrame(list(enumerate(map(int, numbers))), "place bigint, doc_id bigint")
        own = self.exploded().where(F.col("key") == key).select("doc_id", "value")
        return asked.join(own, "doc_id", "left").select("place", "doc_id", "value").orderBy("place")

    def get_by_key(self, key: str, values: list[str] | DataFrame, check: bool = True) -> DataFrame:
        """place, value, doc_id, keys, content."""
        found = self.get_numbers(key, values, check)
        return found.join(self.docs, "doc_id", "left").select("place", "value", "doc_id", "keys", "content").orderBy("place")

    def keys_only(self) -> DocStore:
        return DocStore(self.docs.withColumn("content", F.lit(None).cast("binary")))

    def contains(self, numbers: DataFrame) -> DataFrame:
        """doc_id, stored."""
        return numbers.join(self.docs.select("doc_id", F.lit(True).alias("_f")), "doc_id", "left").select("doc_id", F.col("_f").isNotNull().alias("stored"))

    async def get_by_number_async(self, numbers: list[int]) -> list:
        return await asyncio.to_thread(lambda: self.get_by_number(numbers).collect())
