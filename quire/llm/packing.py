"""Filling containers of fixed capacity with items, by bounded-space best fit."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut

OPEN_WINDOWS = 64
ITEMS_PER_TASK = 50_000
MERGE = 64
PLACED = "container_kind string, window bigint, item bigint, part_no int, n_tokens bigint, open boolean"


class Packer:
    """At most `open_windows` open windows of one capacity; sizes must not exceed it."""

    def __init__(self, capacity: int, open_windows: int | None, first: int) -> None:
        self.capacity, self.most, self.next = capacity, open_windows, first
        self.free: list[tuple[int, int]] = []  # (room left, window), ascending
        self.open: dict[int, list] = {}

    def put(self, size: int, item) -> list | None:
        """Place an item in the window it fits best; gives the items of a window that had to be closed."""
        closed = None
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):
            room, window = self.free.pop(at)
        else:
            if self.most and len(self.free) >= self.most:
                closed = self.open.pop(self.free.pop(0)[1])
            room, window = self.capacity, self.next
            self.next += 1
            self.open[window] = []
        self.open[window].append((window, size, item))
        if room > size:
            insort(self.free, (room - size, window))
        else:
            closed = (closed or []) + self.open.pop(window)
        return closed


def _pack(kinds: dict[str, int], parts: int, open_windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        packers = {k: Packer(c, open_windows, task << 40) for k, c in kinds.items()}
        cols: list[list] = [[] for _ in range(6)]

        def out(kind: str, rows: list, still: bool) -> None:
            for window, size, (item, part) in rows:
                for col, x in zip(cols, (kind, window, item, part, size, still)):
                    col.append(x)

        def batch_of() -> pa.RecordBatch:
            types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_()]
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["container_kind", "window", "item", "part_no", "n_tokens", "open"])
            for c in cols:
                c.clear()
            return made

        for batch in batches:
            for item, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, p in packers.items():
                    for part in range(max(1, -(-n // p.capacity))):
                        size = min(p.capacity, n - part * p.capacity)
                        if closed := p.put(size, (item, part)):
                            out(kind, closed, False)
            yield batch_of()
        for kind, p in packers.items():
            for rows in p.open.values():
                out(kind, rows, True)
        yield batch_of()

    return run


def _merge(kinds: dict[str, int]):
    """Open windows of several tasks, fullest first, into as few as best fit gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: (r[0], -r[2], r[1]))
        packers = {k: Packer(c, None, 0) for k, c in kinds.items()}
        out = []
        for kind, window, fill in rows:
            for w in packers[kind].put(fill, window) or []:
                out.append((kind, w))
        for kind, p in packers.items():
            out += [(kind, w) for ws in p.open.values() for w in ws]
        least: dict[tuple[str, int], int] = {}
        for kind, (into, _, window) in out:
            least[kind, into] = min(window, least.get((kind, into), window))
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in out], pa.string()), pa.array([w for _, (_, _, w) in out], pa.int64()), pa.array([least[k, i] for k, (i, _, _) in out], pa.int64())],
            names=["container_kind", "window", "container"],
        )

    return run


def pack(items: DataFrame, kinds: dict[str, int], open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """(container_kind, container, item, part_no, n_tokens): every item in a container of each kind.

    items: item BIGINT, n_tokens BIGINT. An item above the capacity is cut into full parts and a rest, any
    other is kept whole; items of no tokens or with null sizes are placed as size 0. Repeated ids are
    separate items. Rows are spread by a hash of id and size, so no source or key makes a task large; a task holds
    `open_windows` open windows per kind. Windows left open at its end meet those of up to 63 other tasks,
    round by round, until all have met; so what is shuffled last is a bounded number of windows per task.
    """
    if not kinds or min(kinds.values()) < 1:
        raise ValueError("capacities must be positive")
    rows = items.select("item", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))
    tasks = max(1, -(-rows.count() // ITEMS_PER_TASK))
    spread = rows.repartition(tasks, F.xxhash64("item", "n_tokens")).sortWithinPartitions(F.xxhash64("item"), "n_tokens")
    placed = cut(spread.mapInArrow(_pack(kinds, tasks, open_windows), PLACED))
    windows = placed.where("open").groupBy("container_kind", "window").agg(F.sum("n_tokens").alias("fill"))
    into = None
    while tasks > 1:
        tasks = -(-tasks // MERGE)
        group = F.shiftright("window", 40) % F.lit(tasks)
        one = windows.select("container_kind", "window", "fill").withColumn("g", group.cast("int")).repartition(tasks, "g").select("container_kind", "window", "fill")
        step = cut(one.mapInArrow(_merge(kinds), "container_kind string, window bigint, container bigint"))
        into = step if into is None else cut(into.join(step.toDF("container_kind", "container", "next"), ["container_kind", "container"]).select("container_kind", "window", F.col("next").alias("container")))
        windows = windows.join(step, ["container_kind", "window"]).groupBy("container_kind", F.col("container").alias("window")).agg(F.sum("fill").alias("fill"))
    if into is None:
        return placed.select("container_kind", F.col("window").alias("container"), "item", "part_no", "n_tokens")
    return placed.join(into, ["container_kind", "window"], "left").select("container_kind", F.coalesce("container", "window").alias("container"), "item", "part_no", "n_tokens")


def fill_report(packed: DataFrame, kinds: dict[str, int]) -> DataFrame:
    """Per kind: containers used, tokens placed, and the share of the room that is filled."""
    size = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    return (
        packed.groupBy("container_kind", "container").agg(F.sum("n_tokens").alias("fill"))
        .groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("fill").alias("tokens"))
        .withColumn("fill_rate", F.round(F.col("tokens") / (F.col("containers") * size[F.col("container_kind")]), 6))
    )
