"""Directory scans as DataFrames of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import extension, file_name


def scan(spark: SparkSession, folder: str, extensions: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content, filename, extension) of the files below a folder.

    The content is only read where a plan needs it. Extensions are compared without case and dot.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    files = files.withColumn("filename", file_name(F.col("path"))).withColumn("extension", extension(F.col("path")))
    wanted = [e.lower().lstrip(".") for e in extensions or []]
    return files.where(F.col("extension").isin(wanted)) if wanted else files


def file_hashes(files: DataFrame, algorithm: str = "md5") -> DataFrame:
    """(path, file_hash) by md5 or sha256 of the bytes."""
    digest = F.md5("content") if algorithm == "md5" else F.sha2("content", 256)
    return files.select("path", digest.alias("file_hash"))
