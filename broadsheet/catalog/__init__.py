"""Catalogue of analyses and collections: small metadata tables in Parquet, appended to and listed newest first."""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, kind string, title string, collection string, created_at timestamp, metadata string"


class Catalog:
    """Records under ``root``; every change appends a row, a deletion appends a mark, so writers don't meet."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _append(self, table: str, rows: list[tuple], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{table}")

    def _read(self, table: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")

    def save(self, df: DataFrame, kind: str, title: str, collection: str | None = None, **metadata) -> str:
        key = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/data/{key}")
        self._append("analyses", [(key, kind, title, collection, datetime.now(UTC), json.dumps(metadata, ensure_ascii=False))], SCHEMA)
        return key

    def analyses(self, collection: str | None = None, kind: str | None = None) -> DataFrame:
        df = self._read("analyses", SCHEMA).join(self._read("deleted", "id string"), "id", "left_anti")
        df = df.filter(F.col("collection") == collection) if collection else df
        df = df.filter(F.col("kind") == kind) if kind else df
        return df.orderBy(F.desc("created_at"), "id")

    def load(self, key: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/data/{key}")

    def delete(self, key: str) -> None:
        self._append("deleted", [(key,)], "id string")

    def create_collection(self, name: str, description: str = "") -> None:
        self._append("collections", [(name, description, datetime.now(UTC))], "name string, description string, created_at timestamp")

    def collections(self) -> DataFrame:
        """Collections with the number of their analyses."""
        c = self._read("collections", "name string, description string, created_at timestamp").groupBy("name").agg(F.max_by("description", "created_at").alias("description"), F.min("created_at").alias("created_at"))
        n = self.analyses().groupBy(F.col("collection").alias("name")).agg(F.count("*").alias("n"))
        return c.join(n, "name", "left").select("name", "description", "created_at", F.coalesce("n", F.lit(0)).alias("n")).orderBy("name")

    def export(self, collection: str, target: str) -> int:
        """Every analysis of a collection as Parquet under ``target``; a loop over a handful of records."""
        keys = [r["id"] for r in self.analyses(collection).select("id").collect()]
        for k in keys:
            self.load(k).write.mode("overwrite").parquet(f"{target}/{k}")
        return len(keys)

    def available(self) -> DataFrame:
        """Kinds of analyses there are, with their number."""
        return self.analyses().groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind")


def cache_key(*parts) -> str:
    """A digest of what a cached step depends on: path, settings, counts."""
    return hashlib.md5(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


class StepCache:
    """Results of pre-processing steps under ``root``, by the digest of what they depend on, with an inventory."""

    SCHEMA = "key string, source string, settings string, articles long, created_at timestamp"

    def __init__(self, spark: SparkSession, root: str):
        self.records, self.spark, self.root = Catalog(spark, root), spark, root.rstrip("/")

    def get(self, source: str, settings: dict, articles: int, changed: str, make) -> DataFrame:
        """The stored result for these settings, else what ``make()`` gives, stored under them."""
        key = cache_key(source, settings, articles, changed)
        if self.inventory().filter(F.col("key") == key).isEmpty():
            make().write.mode("overwrite").parquet(f"{self.root}/steps/{key}")
            self.records._append("steps_made", [(key, source, json.dumps(settings, sort_keys=True, ensure_ascii=False), articles, datetime.now(UTC))], self.SCHEMA)
        return self.spark.read.parquet(f"{self.root}/steps/{key}")

    def inventory(self) -> DataFrame:
        """``key, source, settings, articles, created_at`` of what is stored, the newest first."""
        return self.records._read("steps_made", self.SCHEMA).orderBy(F.desc("created_at"), "key")

    def sizes(self) -> dict[str, int]:
        """Bytes of each stored step."""
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        on = fs.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return {r["key"]: on.getContentSummary(path(f"{self.root}/steps/{r['key']}")).getLength() for r in self.inventory().select("key").distinct().collect()}
