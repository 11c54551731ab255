"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table `name` below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    A folder of this machine is chosen only where that setting is absent and the master is local.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        path = os.path.join(tempfile.gettempdir(), "quire-checkpoints")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage; survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


SHUFFLING = re.compile(r"\b(?:\w*Join|Aggregate|Window|Repartition\w*|RebalancePartitions|Sort|Distinct|Deduplicate)\b")


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Repartition a plain scan that has fewer partitions than the cluster has cores.

    What comes from a shuffle is left as it is: to count its partitions would run it.
    """
    if SHUFFLING.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    n = least or df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)
