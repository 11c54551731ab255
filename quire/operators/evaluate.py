"""Precision and recall of retrieved sets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_detail(retrieved: DataFrame, relevant: DataFrame, queries: DataFrame, n_relevant: DataFrame | None = None) -> DataFrame:
    """(query_id, n_retrieved, n_relevant, hits, precision, recall) for each query; sets, so repeats count once.

    Nothing retrieved gives a precision of 0, nothing relevant a recall of 0. Where the relevant items of a query are too many to be
    listed, n_relevant(query_id, n_relevant) gives their number, and `relevant` needs only those among the retrieved.
    """
    got = retrieved.select("query_id", "item").distinct()
    want = relevant.select("query_id", "item").distinct()
    hits = got.join(want, ["query_id", "item"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    n_got = got.groupBy("query_id").agg(F.count("*").alias("n_retrieved"))
    n_want = n_relevant if n_relevant is not None else want.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    all_ = queries.select("query_id").distinct().join(n_got, "query_id", "left").join(n_want, "query_id", "left").join(hits, "query_id", "left").fillna(0)
    share = lambda n: F.when(F.col(n) > 0, F.col("hits") / F.col(n)).otherwise(F.lit(0.0))
    return all_.select("query_id", "n_retrieved", "n_relevant", "hits", share("n_retrieved").alias("precision"), share("n_relevant").alias("recall"))


def retrieval_metrics(detail: DataFrame) -> DataFrame:
    """One row: mean precision and recall; null where there is no query."""
    return detail.agg(F.avg("precision").alias("context_precision"), F.avg("recall").alias("context_recall"))


def average_score(metrics: DataFrame) -> DataFrame:
    """Mean of all metrics of a one-row table; 0 where there are none."""
    names = metrics.columns
    stacked = metrics.select(F.explode(F.array(*(F.col(c).cast("double") for c in names))).alias("v"))
    return stacked.agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("average_score"))


def judged(samples: DataFrame, key: str, metrics: list[str], load_judge) -> DataFrame:
    """(key, one column a metric, error) of samples(key, question, contexts, answer, ground_truth): scores by a judge.

    load_judge() is called once a task and gives a callable from (metric, sample) to a score of 0 to 1, or None where it
    can't tell. No score is made up: what the judge fails on is null, with its words in `error`.
    """
    fields = ["question", "contexts", "answer", "ground_truth"]
    kind = dict(samples.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = load_judge()
        for batch in batches:
            out: list[list] = [[] for _ in (*metrics, "error")]
            for row in batch.to_pylist():
                errors = []
                for col, m in zip(out, metrics):
                    try:
                        col.append(judge(m, {f: row[f] for f in fields}))
                    except Exception as e:  # the row says what failed
                        col.append(None)
                        errors.append(f"{m}: {e}")
                out[-1].append("; ".join(errors) or None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in out[:-1]), pa.array(out[-1], pa.string())], names=[key, *metrics, "error"])

    return samples.select(key, *fields).mapInArrow(run, f"`{key}` {kind}, " + "".join(f"`{m}` double, " for m in metrics) + "error string")


def judged_metrics(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: the mean of each metric over the samples that have it."""
    return scores.agg(*(F.avg(m).alias(m) for m in metrics))
