"""The chunk, file and task tables as DataFrame upserts, anti-joins and state transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import extension

# Order in which file types are processed, quick ones first.
PRIORITY = {"txt": 1, "csv": 2, "json": 3, "html": 4, "rtf": 5, "doc": 6, "docx": 7, "wps": 8, "ppt": 9, "pptx": 10, "xls": 11, "xlsx": 12, "pdf": 13, "caj": 14}
# Words of an error that name the module it came from, in the order they are tried.
MODULES = [("chunker", ("未生成分块", "chunk", "分块")), ("loader", ("加载失败", "load", "加载")), ("cleaner", ("清洗失败", "clean", "清洗")), ("encoder", ("编码失败", "encode", "编码")), ("vector_store", ("存储失败", "store", "存储"))]
MIN_FILE_SIZE = 1024


def upsert_by(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the keys that new has, and all of new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_by(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def update_existing(rows: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """rows with `column` replaced where changes(key, column) knows the key; unknown keys are ignored, repeated ones take the least value."""
    new = changes.groupBy(key).agg(F.min(column).alias("_new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def latest(rows: DataFrame, key: str, time: str, column: str) -> DataFrame:
    """(key, column) of the row of greatest time for each key; ties take the greatest value."""
    return rows.groupBy(key).agg(F.max(F.struct(time, column)).alias("m")).select(key, F.col(f"m.{column}").alias(column))


def classify_files(current: DataFrame, state: DataFrame, errors: DataFrame, enabled: bool = True) -> DataFrame:
    """current(file_path, file_hash) with `reason`: why each file is to be processed or not.

    full_update if updates are off; hash_error without a hash; error_skipped or modified where an error is on
    record, by whether the hash is still the same; new if unknown; else modified or unchanged.
    """
    s = state.select("file_path", F.col("file_hash").alias("old_hash"), F.lit(True).alias("known"))
    e = errors.select("file_path", F.col("file_hash").alias("error_hash"), F.lit(True).alias("failed"))
    reason = (
        F.when(F.lit(not enabled), "full_update")
        .when(F.col("file_hash").isNull(), "hash_error")
        .when(F.col("failed") & F.col("error_hash").eqNullSafe(F.col("file_hash")), "error_skipped")
        .when(F.col("failed"), "modified")
        .when(F.col("known").isNull(), "new")
        .when(~F.col("old_hash").eqNullSafe(F.col("file_hash")), "modified")
        .otherwise("unchanged")
    )
    return current.join(s, "file_path", "left").join(e, "file_path", "left").select(*current.columns, reason.alias("reason"))


def size_filter(files: DataFrame, least: int = MIN_FILE_SIZE) -> DataFrame:
    """The files(size_bytes, ...) that are too small to be processed; those of unknown size aren't."""
    return files.where(F.col("size_bytes") < least)


def priority(path: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))
    return F.coalesce(kinds[extension(path)], F.lit(99))


def module_of(error: Column) -> Column:
    low = F.lower(error)
    out = None
    for module, words in MODULES:
        test = F.lit(False)
        for w in words:
            test = test | F.contains(low, F.lit(w))
        out = F.when(test, module) if out is None else out.when(test, module)
    return out.otherwise("unknown")


def task_plan(files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Next status of files(file_path, size_bytes, reason), given the table tasks(file_path, status).

    Small files are filtered. A completed or failed file becomes pending if it was modified; a skipped one if
    it needs processing; one that was being processed starts again; any other keeps its status. A new file is
    pending, or skipped if nothing is to be done.
    """
    needs = ~F.col("reason").isin("unchanged", "error_skipped")
    status = (
        F.when(F.col("size_bytes") < MIN_FILE_SIZE, "filtered")
        .when(F.col("status").isin("completed", "error"), F.when(F.col("reason") == "modified", "pending").otherwise(F.col("status")))
        .when(F.col("status") == "skipped", F.when(needs, "pending").otherwise("skipped"))
        .when(F.col("status") == "processing", "pending")
        .when(F.col("status").isNotNull(), F.col("status"))
        .otherwise(F.when(needs, "pending").otherwise("skipped"))
    )
    return files.join(tasks.select("file_path", "status"), "file_path", "left").select(*files.columns, status.alias("next_status"), priority(F.col("file_path")).alias("priority"))


STATUSES = ("pending", "processing", "completed", "error", "skipped", "filtered")


def record_results(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """tasks(file_path, status, error, retry_count) after results(file_path, status, error): an error that comes with a
    message is kept and, with the status 'error', counted as one more try; files that aren't tasks are ignored. Of
    several results of a file an error wins, then the least message."""
    bad = F.when(F.col("status") == "error", 0).otherwise(1)
    one = results.groupBy("file_path").agg(F.min(F.struct(bad.alias("bad"), F.col("error").isNull().alias("none"), "error", "status")).alias("r"))
    new = one.select("file_path", F.col("r.status").alias("new_status"), F.col("r.error").alias("new_error"))
    failed = (F.col("new_status") == "error") & F.col("new_error").isNotNull()
    tries = F.coalesce("retry_count", F.lit(0))
    return tasks.join(new, "file_path", "left").select("file_path", F.coalesce("new_status", "status").alias("status"), F.coalesce("new_error", "error").alias("error"), (tries + F.when(failed, 1).otherwise(0)).alias("retry_count"))


def reset_errors(tasks: DataFrame) -> DataFrame:
    """tasks with the failed ones pending again, without an error and with no tries."""
    failed = F.col("status") == "error"
    return tasks.select("file_path", F.when(failed, "pending").otherwise(F.col("status")).alias("status"), F.when(~failed, F.col("error")).alias("error"), F.when(failed, 0).otherwise(F.coalesce("retry_count", F.lit(0))).alias("retry_count"))


def task_statistics(tasks: DataFrame) -> DataFrame:
    """One row: all tasks, those of each status, 0 where there are none, and whether none is left to do."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    return tasks.agg(F.count("*").alias("total"), *(n(s).alias(s) for s in STATUSES), (n("pending") + n("processing") == 0).alias("is_completed"))


def merge_log(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both logs, one row for each key; the old one wins, ties take the least value."""
    both = old.select(*keys, value, F.lit(0).alias("_n")).unionByName(new.select(*keys, value, F.lit(1).alias("_n")))
    return both.groupBy(*keys).agg(F.min(F.struct("_n", value)).alias("m")).select(*keys, F.col(f"m.{value}").alias(value))


def flatten_metadata(columns: dict[str, Column]) -> Column:
    """A map of the columns as text; nulls are dropped. Lists go in by `list_value`."""
    m = F.create_map(*(x for k, v in columns.items() for x in (F.lit(k), v)))
    return F.map_filter(m, lambda _, v: v.isNotNull())


def list_value(c: Column, most: int = 10) -> Column:
    """A list as JSON, cut to `most` values; null for an empty or null one."""
    return F.when(F.size(c) > 0, F.to_json(F.slice(c, 1, most)))
