"""Outputs of the stages, switched by mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAGES = ("loaded", "cleaned", "chunks", "dedup_report", "embeddings", "retrieval", "evaluation")
# The stages that each mode saves.
MODES = {"test": set(STAGES), "production": {"dedup_report", "evaluation"}, "minimal": set()}


class Outputs:
    """Writes a stage's table below a folder if the mode, or a later switch, has it saved."""

    def __init__(self, folder: str, mode: str = "test", custom: set[str] | None = None) -> None:
        if mode not in (*MODES, "custom"):
            raise ValueError(f"unknown mode {mode}")
        self.folder = folder
        self.on = set(custom or ()) if mode == "custom" else set(MODES[mode])

    def switch(self, stage: str, on: bool) -> None:
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage}")
        (self.on.add if on else self.on.discard)(stage)

    def save(self, stage: str, rows: DataFrame, fmt: str = "parquet") -> str | None:
        """Path written to, or None where the stage isn't saved. fmt: parquet, json or text (one string column)."""
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage}")
        if stage not in self.on:
            return None
        path = f"{self.folder}/{stage}"
        rows.write.mode("overwrite").format(fmt).save(path)
        return path


def loaded_text(rows: DataFrame) -> DataFrame:
    """One `value` a document: a head of three lines, a rule of 80 signs, an empty line, and the content."""
    head = F.concat_ws("\n", F.concat(F.lit("文件: "), "path"), F.concat(F.lit("解析器: "), F.coalesce("loader", F.lit("unknown"))), F.concat(F.lit("大小: "), F.coalesce(F.col("length"), F.lit(0)).cast("string"), F.lit(" 字节")), F.lit("=" * 80))
    return rows.select(F.concat(head, F.lit("\n\n"), F.coalesce("content", F.lit(""))).alias("value"))


def chunk_report(chunks: DataFrame) -> DataFrame:
    """(source_file, chunk_count) of each file; the chunks themselves are written beside it, partitioned, not nested."""
    return chunks.groupBy("source_file").agg(F.count("*").alias("chunk_count"))


def cleaned_text(rows: DataFrame) -> DataFrame:
    """One `value` a result of rows(filename, original_text, cleaned_text): a head with the lengths, a rule of 80 signs, an empty line, and the text."""
    size = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))).cast("string")
    head = F.concat_ws("\n", F.concat(F.lit("原始文件: "), F.coalesce("filename", F.lit(""))), F.concat(F.lit("原始长度: "), size("original_text"), F.lit(" 字符")), F.concat(F.lit("清洗后长度: "), size("cleaned_text"), F.lit(" 字符")), F.lit("=" * 80))
    return rows.select(F.concat(head, F.lit("\n\n"), F.coalesce("cleaned_text", F.lit(""))).alias("value"))


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """One JSON object as `value` for each chunk, to be written beside chunk_report, partitioned by source_file."""
    return chunks.select("source_file", F.to_json(F.struct(*(c for c in chunks.columns))).alias("value"))


def dedup_report(removed: DataFrame, original: DataFrame, now: str) -> DataFrame:
    """One row: timestamp, rows before and after, removed ones in all and as JSON by step, and the share removed."""
    steps = original.select(F.lit(None).cast("string").alias("step")).unionByName(removed.select("step")).groupBy("step").agg(F.count("*").alias("n"))
    n = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    entries = F.filter(F.array_sort(F.collect_list(F.struct("step", "n"))), lambda x: x["step"].isNotNull())
    one = steps.agg(n(F.col("step").isNull()).alias("original_count"), n(F.col("step").isNotNull()).alias("removed_count"), F.to_json(F.map_from_entries(entries)).alias("by_step"))
    return one.select(F.lit(now).alias("timestamp"), "original_count", (F.col("original_count") - F.col("removed_count")).alias("kept_count"), "removed_count", "by_step", F.coalesce(F.round(F.col("removed_count") / F.nullif("original_count", F.lit(0)), 4), F.lit(0.0)).alias("dedup_rate"))


def embedding_meta(vectors: DataFrame, vector: str) -> DataFrame:
    """One row: number of vectors that aren't null, their length if all have one, and their type."""
    kind = dict(vectors.dtypes)[vector].removeprefix("array<").rstrip(">")
    size = F.size(vector)
    return vectors.where(F.col(vector).isNotNull()).agg(F.count("*").alias("count"), F.when(F.min(size) == F.max(size), F.max(size)).alias("dim"), F.lit(kind).alias("dtype"))


def failed_report(rows: DataFrame, path: str) -> str:
    """Write the failed rows of a stage; this report is saved whatever the mode."""
    rows.write.mode("overwrite").json(path)
    return path
