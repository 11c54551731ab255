"""Directory to searchable corpus: scan, parse, clean, chunk, deduplicate, encode; then retrieve."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import chunk, dedup, encode, search, tables
from quire.sources import files, parse


@dataclass(frozen=True)
class Config:
    chunk_size: int = 500
    chunk_overlap: int = 50
    min_chunk_length: int = 20
    min_file_size: int = tables.MIN_FILE_SIZE
    simhash_threshold: int = 3
    extensions: list[str] = field(default_factory=lambda: list(parse.LOADERS))
    incremental: bool = True
    encoder: Callable[[Column], Column] = encode.dense_hash
    top_k: int = 5
    threshold: float | None = 0.5


CHUNK = "chunk_id string, source_file string, chunk_index int, start_pos int, end_pos int, content string, content_hash string"
SCHEMAS = {
    "files": "file_path string, file_hash string, loaded_run int", "errors": "file_path string, file_hash string, reason string",
    "chunk_log": CHUNK + ", run int", "kept": "chunk_id string, content_hash string", "vector_log": "chunk_id string, content_hash string, vector array<float>, run int",
}


class Corpus:
    """Tables below a folder: files, errors and kept with one subfolder a run, and two logs of what each run added: chunk_log and vector_log.

    A run writes what is new of a stage and then notes the stage, so a build that broke off goes on with the stage after
    the last one noted, and readers see the last complete run until the next one is. Chunks and vectors of files that didn't
    change are never written again: `files` says which run a file's chunks come from, `kept` which chunks count.
    """

    def __init__(self, spark: SparkSession, folder: str, config: Config = Config()) -> None:
        self.spark, self.folder, self.config = spark, folder, config

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except Exception as e:  # not written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def stages(self) -> DataFrame:
        return self._read("stages", "run int, stage string")

    def _note(self, run: int, stage: str) -> None:
        self.spark.createDataFrame([(run, stage)], "run int, stage string").write.mode("append").parquet(f"{self.folder}/stages")

    def _write(self, rows: DataFrame, name: str, run: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/run={run}")

    def last_complete(self) -> int:
        return self.stages().where("stage = 'complete'").agg(F.coalesce(F.max("run"), F.lit(0))).first()[0]

    def table(self, name: str, run: int | None = None) -> DataFrame:
        """files, errors, chunks_all (of all files), chunks (those kept) or vectors (of those) of a run, the last complete one by default."""
        run = self.last_complete() if run is None else run
        if name == "chunks_all":
            own = self.table("files", run).select(F.col("file_path").alias("source_file"), F.col("loaded_run").alias("run"))
            return self._read("chunk_log", SCHEMAS["chunk_log"]).join(own, ["source_file", "run"], "left_semi").drop("run")
        if name == "chunks":
            return self.table("chunks_all", run).join(self._kept(run), ["chunk_id", "content_hash"], "left_semi")
        if name == "vectors":
            log = self._read("vector_log", SCHEMAS["vector_log"]).where(F.col("run") <= run).drop("run")
            return log.join(self._kept(run), ["chunk_id", "content_hash"], "left_semi")
        return self._read(f"{name}/run={run}", SCHEMAS[name])

    def _kept(self, run: int) -> DataFrame:
        return self._read(f"kept/run={run}", SCHEMAS["kept"])

    def _load(self, folder: str, run: int) -> None:
        c = self.config
        found = files.scan(self.spark, folder, c.extensions).where(F.col("length") >= c.min_file_size)
        current = found.select(F.col("path").alias("file_path"), F.md5("content").alias("file_hash"))
        before = self.table("files")
        errors = self.table("errors").select("file_path", "file_hash")
        reasons = tables.classify_files(current, before.drop("loaded_run"), errors, c.incremental)
        todo = reasons.where("reason not in ('unchanged', 'error_skipped')").select("file_path")
        loaded = parse.load(found.join(todo.withColumnRenamed("file_path", "path"), "path", "left_semi"))
        good = loaded.where("error is null").select(F.col("path").alias("source_file"), text.clean_structure(F.col("content")).alias("cleaned")).where(F.length("cleaned") > 0)
        new = chunk.recursive_chunks(good, "source_file", "cleaned", c.chunk_size, c.chunk_overlap, c.min_chunk_length)
        new = new.select(F.concat("source_file", F.lit("#"), F.col("chunk_index").cast("string")).alias("chunk_id"), "source_file", "chunk_index", "start_pos", "end_pos", "content", F.md5(F.col("content").cast("binary")).alias("content_hash"))
        self._write(new, "chunk_log", run)
        failed = loaded.where("error is not null").select(F.col("path").alias("file_path"), F.col("error").alias("reason")).join(current, "file_path")
        old_errors = self.table("errors").join(current.select("file_path"), "file_path", "left_semi").join(todo, "file_path", "left_anti")
        self._write(old_errors.unionByName(failed.select("file_path", "file_hash", "reason")), "errors", run)
        again = todo.withColumn("again", F.lit(run))
        known = current.join(before.select("file_path", "loaded_run"), "file_path", "left").join(again, "file_path", "left")
        self._write(known.select("file_path", "file_hash", F.coalesce("again", "loaded_run", F.lit(run)).alias("loaded_run")), "files", run)

    def _dedup(self, run: int) -> None:
        """Keep-first over the whole corpus, as a file that goes may give its place to a later one; only ids and hashes are written."""
        rows = self.table("chunks_all", run)
        kept, _ = dedup.deduplicate(rows, "content", "chunk_id", dedup.Strategy(simhash_threshold=self.config.simhash_threshold))
        self._write(kept.select("chunk_id", "content_hash"), "kept", run)

    def _encode(self, run: int) -> None:
        rows = self.table("chunks", run).select("chunk_id", "content_hash", "content")
        old = self._read("vector_log", SCHEMAS["vector_log"]).where(F.col("run") < run)
        new = encode.cache_misses(rows, old)
        self._write(new.select("chunk_id", "content_hash", self.config.encoder(F.col("content")).alias("vector")), "vector_log", run)

    def build(self, folder: str) -> dict[str, int]:
        """Bring the corpus up to the files of a folder; gives the counts of status()."""
        run = self.last_complete() + 1
        done = {r["stage"] for r in self.stages().where(F.col("run") == run).collect()}
        for stage, work in (("chunks", lambda: self._load(folder, run)), ("dedup", lambda: self._dedup(run)), ("encode", lambda: self._encode(run))):
            if stage not in done:
                work()
                self._note(run, stage)
        self._note(run, "complete")
        return self.status()

    def status(self) -> dict[str, int]:
        return {name: self.table(name).count() for name in ("files", "errors", "chunks_all", "chunks", "vectors")}

    def retrieve(self, queries: DataFrame, top_k: int | None = None, threshold: float | None = None) -> DataFrame:
        """(query_id, rank, chunk_id, score, source_file, content) for queries(query_id BIGINT, query STRING)."""
        k = top_k or self.config.top_k
        vectors = self.table("vectors").withColumn("vec_id", F.xxhash64("chunk_id"))
        asked = queries.select(F.col("query_id").cast("bigint").alias("vec_id"), self.config.encoder(F.col("query")).alias("vector"))
        hits = search.retrieve(search.top_k(asked, vectors, "vec_id", "vector", k), k, self.config.threshold if threshold is None else threshold)
        return hits.join(vectors.select("vec_id", "chunk_id"), "vec_id").join(self.table("chunks").select("chunk_id", "source_file", "content"), "chunk_id").select("query_id", "rank", "chunk_id", "score", "source_file", "content")
