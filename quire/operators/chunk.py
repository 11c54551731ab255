"""Cutting texts into chunks: fixed windows in the JVM, recursive separators in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators from strong to weak; the empty one cuts anywhere.
SEPARATORS = ["\n\n", "\n", "。", "？", "?", "！", "!", "……", "；", "，", ";", ",", " ", ""]


def fixed_windows(rows: DataFrame, text: str, size: int = 500, overlap: int = 50) -> DataFrame:
    """rows without `text`, and one row per window: chunk_index, start_pos, end_pos, content.

    Windows start every size - overlap code points, as long as the one before doesn't reach the end. Null
    and empty texts give no row.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below the size")
    step = size - overlap
    n = F.length(text)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - overlap) / step).cast("int") - 1))
    cut = rows.where(n > 0).select("*", F.posexplode(starts).alias("chunk_index", "_k"))
    start = F.col("_k") * step
    return cut.select("*", start.alias("start_pos"), F.least(start + size, n).alias("end_pos"), F.substring(F.col(text), start + 1, F.lit(size)).alias("content")).drop("_k", text)


def _split(text: str, size: int, overlap: int, separators: list[str]) -> list[str]:
    sep, rest = separators[-1], []
    for i, s in enumerate(separators):
        if not s or s in text:
            sep, rest = s, separators[i + 1 :]
            break
    if sep:
        first, *others = text.split(sep)
        parts = [p for p in [first, *(sep + x for x in others)] if p]
    else:
        step = size - overlap
        return [text[a : a + size] for a in range(0, max(1, len(text) - overlap), step)]
    out: list[str] = []
    fit: list[str] = []
    for p in parts:
        if len(p) <= size:
            fit.append(p)
            continue
        out += _join(fit, size, overlap)
        fit = []
        out += _split(p, size, overlap, rest or [""])
    return out + _join(fit, size, overlap)


def _join(parts: list[str], size: int, overlap: int) -> list[str]:
    """Parts put together up to the size; a chunk begins with the last parts of the one before, up to the overlap."""
    out: list[str] = []
    now: list[str] = []
    total = 0
    for p in parts:
        if now and total + len(p) > size:
            out.append("".join(now))
            while now and (total > overlap or total + len(p) > size):
                total -= len(now.pop(0))
        now.append(p)
        total += len(p)
    return out + ["".join(now)] if now else out


def chunk_text(text: str, size: int = 500, overlap: int = 50, separators: list[str] = SEPARATORS) -> list[tuple[str, int, int]]:
    """(content, start, end) of the chunks of a text, stripped, empty ones dropped.

    A chunk is sought from the end of the one before less the overlap, but not before the text's start; one
    that isn't found is placed there.
    """
    out = []
    cursor = 0
    for c in _split(text, size, overlap, separators):
        if not (c := c.strip()):
            continue
        at = text.find(c, cursor)
        start = at if at >= 0 else cursor
        out.append((c, start, start + len(c)))
        cursor = max(0, start + len(c) - overlap)
    return out


def recursive_chunks(rows: DataFrame, key: str, text: str, size: int = 500, overlap: int = 50, min_length: int = 20, keep: tuple[str, ...] = (), merge: bool = False) -> DataFrame:
    """(key, the columns of `keep`, chunk_index, start_pos, end_pos, content): chunks by separators, numbered from 0.

    Short ones are dropped, or with merge=True joined by a newline to what follows, which then begins where they do. The
    columns of `keep` are the document's metadata, the same on each of its chunks.
    """
    kinds = dict(rows.dtypes)
    own = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            cols: list[list] = [[], [], [], []]
            for row, t in enumerate(batch.column(len(own)).to_pylist()):
                found = chunk_text(t, size, overlap)
                found = merge_pieces(found, min_length) if merge else [c for c in found if len(c[0]) >= min_length]
                for i, (c, a, b) in enumerate(found):
                    at.append(row)
                    for col, x in zip(cols, (i, a, b, c)):
                        col.append(x)
            types = [pa.int32(), pa.int32(), pa.int32(), pa.string()]
            index = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(index) for i in range(len(own))), *(pa.array(c, t) for c, t in zip(cols, types))], names=[*own, "chunk_index", "start_pos", "end_pos", "content"])

    shape = "".join(f"`{c}` {kinds[c]}, " for c in own) + "chunk_index int, start_pos int, end_pos int, content string"
    return rows.select(*own, text).where(F.length(text) > 0).mapInArrow(run, shape)


def merge_pieces(found: list[tuple[str, int, int]], least: int) -> list[tuple[str, int, int]]:
    """Chunks (content, start, end) with each short one joined by a newline to what follows; a short last one stays."""
    out: list[tuple[str, int, int]] = []
    for c, a, b in found:
        if out and len(out[-1][0]) < least:
            before = out.pop()
            c, a = before[0] + "\n" + c, before[1]
        out.append((c, a, b))
    return out


def merge_short(chunks: Column, least: int = 20) -> Column:
    """An array of contents with each short one joined by a newline to what follows; a short last one stays."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("now"))
    fold = F.aggregate(
        chunks,
        start,
        lambda s, x: F.when(s["now"].isNull(), F.struct(s["done"].alias("done"), x.alias("now")))
        .when(F.length(s["now"]) < least, F.struct(s["done"].alias("done"), F.concat(s["now"], F.lit("\n"), x).alias("now")))
        .otherwise(F.struct(F.concat(s["done"], F.array(s["now"])).alias("done"), x.alias("now"))),
    )
    return F.when(F.size(chunks) > 0, F.concat(fold["done"], F.array(fold["now"]))).otherwise(F.array().cast("array<string>"))
