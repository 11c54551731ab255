"""Named collections of vectors with contents and metadata, in folders of Parquet files."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import search

SPACES = ("cosine", "l2", "ip")
ROWS = "id string, vector array<float>, content string, metadata map<string,string>"


class Collection:
    """A collection of rows(id, vector, content, metadata) with a space for its distances and free properties.

    The first one to name a collection sets its space and properties; later ones get those, whatever they ask for. Each
    change writes the next version of the rows and then points to it, so readers never see half a change.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str, space: str = "cosine", properties: dict[str, Any] | None = None) -> None:
        if space not in SPACES:
            raise ValueError(f"unknown space {space}")
        self.spark, self.name, self.path = spark, name, f"{folder.rstrip('/')}/{name}"
        heads = self._read("heads", "version int, space string, properties string").orderBy(F.desc("version")).limit(1).collect()
        if heads:
            self.version, self.space, self.properties = heads[0]["version"], heads[0]["space"], json.loads(heads[0]["properties"])
        else:
            self.space, self.properties, self.version = space, dict(properties or {}), -1
            self._point(0)

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:  # not written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _point(self, version: int) -> None:
        head = [(version, self.space, json.dumps(self.properties, ensure_ascii=False))]
        self.spark.createDataFrame(head, "version int, space string, properties string").coalesce(1).write.mode("append").parquet(f"{self.path}/heads")
        self.version = version

    def _write(self, rows: DataFrame) -> None:
        rows.select("id", "vector", "content", "metadata").write.mode("overwrite").parquet(f"{self.path}/rows/version={self.version + 1}")
        self._point(self.version + 1)

    def rows(self) -> DataFrame:
        return self._read(f"rows/version={self.version}", ROWS)

    def add(self, rows: DataFrame) -> int:
        """Add rows with new ids, one for each; those with ids that are there, with a null id or vector, or a length unlike that
        of the rows there, are left out. Gives the number added."""
        old = self.rows()
        dim = old.select(F.size("vector").alias("n")).limit(1).collect() or rows.where("vector is not null").select(F.size("vector").alias("n")).limit(1).collect()
        good = rows.where(F.col("id").isNotNull() & (F.size("vector") == (dim[0]["n"] if dim else -1)))
        new = good.join(old.select("id"), "id", "left_anti").groupBy("id").agg(F.first(F.struct("vector", "content", "metadata")).alias("r")).select("id", F.col("r.vector").cast("array<float>").alias("vector"), "r.content", "r.metadata")
        before = old.count()
        self._write(old.unionByName(new))
        return self.count() - before

    def delete(self, ids: DataFrame) -> None:
        """Remove the rows of ids(id); unknown ones are ignored."""
        self._write(self.rows().join(ids.select("id").distinct(), "id", "left_anti"))

    def count(self) -> int:
        return self.rows().count()

    def stats(self) -> dict[str, Any]:
        return {"name": self.name, "space": self.space, "properties": self.properties, "count": self.count()}

    def query(self, queries: DataFrame, k: int = 5, where: str | None = None) -> DataFrame:
        """(query_id, rank, id, score, content, metadata) of the k best rows for queries(query_id BIGINT, vector); `where` filters the rows first."""
        rows = self.rows().where(where) if where else self.rows()
        own = rows.withColumn("key", F.xxhash64("id"))
        hits = search.top_k(queries.select(F.col("query_id").alias("key"), "vector"), own, "key", "vector", k, self.space)
        return hits.join(own.drop("vector"), "key").select("query_id", "rank", "id", "score", "content", "metadata")
