"""Mixing sources to target shares of the tokens by entropy balancing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import cut

CELL = 50_000


def source_name(col: Column) -> Column:
    """One spelling of a source: trimmed, lower case, with underscores."""
    return F.regexp_replace(F.lower(F.trim(col)), r"[\s-]+", "_")


def balance(docs: DataFrame, targets: dict[str, float], rounds: int = 50, tol: float = 1e-12) -> dict[str, float]:
    """Dual solution by source: documents of source s have the tilted rate exp(lambda_s), up to a common factor.

    Among all rates that meet the token shares, these have the least token-weighted entropy relative to
    one copy of each document. Newton steps on the dual log sum_i t_i exp(lambda . (e_s(i) - p)); each
    step is one aggregate over docs(source, n_tokens). As all documents of a source have the same tilt, their
    totals by source give the same steps, so that is what mix() passes.
    """
    names = sorted(targets)
    p = np.array([targets[s] for s in names])
    lam = np.zeros(len(names))
    for _ in range(rounds):
        tilt = F.create_map(*(F.lit(x) for s, v in zip(names, lam) for x in (s, float(v))))
        got = {r["source"]: r["m"] for r in docs.groupBy("source").agg(F.sum(F.col("n_tokens") * F.exp(tilt[F.col("source")])).alias("m")).collect()}
        m = np.array([got.get(s, 0.0) or 0.0 for s in names])
        mean = m / m.sum()
        grad = mean - p
        if np.abs(grad).max() < tol:
            break
        hess = np.diag(mean) - np.outer(mean, mean)
        step = np.linalg.lstsq(hess, grad, rcond=1e-14)[0]
        lam = lam - step * min(1.0, 2.0 / max(1e-300, np.abs(step).max()))
    return dict(zip(names, lam.tolist()))


def _round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole copies, longest document first in each cell: a rate is rounded to whichever side keeps the tokens given out so far nearest to those due."""
    now, due, given = None, 0.0, 0
    for batch in batches:
        out = []
        for source, n, rate, cell in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
            if (source, cell) != now:
                now, due, given = (source, cell), 0.0, 0
            due += rate * n
            low = math.floor(rate + 1e-9)
            high = low + (rate - low > 1e-9)
            copies = high if due - given - low * n >= n / 2 else low
            given += copies * n
            out.append(copies)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(out, pa.int32())], names=["item", "source", "n_tokens", "rate", "copies"])


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(copies, report): how often each document is used, and the shares reached.

    docs: item BIGINT, source STRING, n_tokens BIGINT; targets: source, target_share, max_repeats, with one
    row per source (a driver-side table of a few rows). Documents without a source, of a source without
    target, or of no tokens get no copies. Shares are taken relative to the sources that have tokens; the collection
    is as large as the caps allow, or total_tokens if that is less. Rates become whole copies in cells of about
    CELL documents of a source, split by a hash, so no source is rounded in one task; a cell misses its
    tokens by about half of its shortest document.
    """
    want = {r["source"]: r for r in targets.where("target_share > 0").collect()}
    totals = cut(docs.where(F.col("source").isin(list(want) or [""]) & (F.col("n_tokens") > 0)).groupBy("source").agg(F.sum("n_tokens").alias("n_tokens")))
    have = {r["source"]: r["n_tokens"] for r in totals.collect()}
    share = sum(want[s]["target_share"] for s in have)
    p = {s: want[s]["target_share"] / share for s in have}
    rates: dict[str, float] = {}
    if have:
        lam = balance(totals, p)
        tilt = {s: float(np.exp(v)) for s, v in lam.items()}
        scale = min(want[s]["max_repeats"] / tilt[s] for s in have)
        if total_tokens is not None:
            scale = min(scale, total_tokens / sum(have[s] * tilt[s] for s in have))
        rates = {s: min(float(want[s]["max_repeats"]), tilt[s] * scale) for s in have}
    rate = F.create_map(*(F.lit(x) for kv in (rates or {"": 0.0}).items() for x in kv))
    used = docs.where((F.col("n_tokens") > 0) & F.col("source").isin(list(rates) or [""])).withColumn("rate", rate[F.col("source")])
    sizes = used.groupBy("source").agg(F.count("*").alias("n")).withColumn("cells", F.ceil(F.col("n") / CELL).cast("int")).select("source", "cells")
    cell = used.join(F.broadcast(sizes), "source").withColumn("cell", F.pmod(F.xxhash64("item"), F.col("cells")).cast("int"))
    ordered = cell.repartition("source", "cell").sortWithinPartitions("source", "cell", F.desc("n_tokens"), "item")
    copies = cut(ordered.select("item", "source", "n_tokens", "rate", "cell").mapInArrow(_round, "item bigint, source string, n_tokens bigint, rate double, copies int").where("copies > 0"))
    reached = copies.groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"))
    all_tokens = copies.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("all_tokens"))
    report = (
        targets.join(reached, "source", "left").fillna(0, ["documents", "copies", "most_copies", "tokens"]).join(F.broadcast(all_tokens))
        .select("source", "target_share", "max_repeats", "documents", "copies", "most_copies", "tokens", F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("reached_share"))
    )
    return copies, report
