"""Splitting oversized texts at natural boundaries by recursive bisection."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Boundaries from strong to weak; a cut is made at the end of a match.
LEVELS = [
    re.compile(r"\n[ \t\r]*\n\s*"),
    re.compile(r"\n\s*"),
    re.compile(r"[。！？!?…]+[”’」』）\")]*\s*|\.(?:[”’\")]*)\s+"),
    re.compile(r"[；;：:]\s*"),
    re.compile(r"[，、]|,\s+"),
    re.compile(r"\s+"),
]
# A cut before one of these would tear a visible character apart.
JOINED = re.compile(r"[̀-ͯ‍︀-️\U0001f3fb-\U0001f3ff]")
PIECES = "item_table string, item_key string, piece_no int, start_pos int, end_pos int, text string"


def _whole(text: str, at: int) -> int:
    """The nearest position at or before `at` that tears no visible character apart."""
    low = max(1, at - 32)
    while at > low and (JOINED.match(text, at) or text[at - 1] == "‍"):
        at -= 1
    return at


def cuts(text: str, limit: int, overlap: int) -> list[int]:
    """Cut positions, ascending, such that no core piece is longer than limit - overlap."""
    room = limit - overlap
    ends = [[m.end() for m in level.finditer(text)] for level in LEVELS]
    found: list[int] = []
    todo = [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= (limit if a == 0 else room):
            continue
        mid, at = (a + b) // 2, 0
        low, high = a + (b - a) // 4, b - (b - a) // 4
        for at_level in ends:
            k = bisect_left(at_level, mid)
            near = [p for p in at_level[max(0, k - 1) : k + 1] if low <= p <= high]
            if near:
                at = min(near, key=lambda p: (abs(p - mid), p))
                break
        at = at or _whole(text, mid)
        found.append(at)
        todo += [(a, at), (at, b)]
    return sorted(found)


def pieces(text: str, limit: int = 500, overlap: int = 50) -> list[tuple[int, int]]:
    """(start, end) of each piece; from the second on, a piece starts up to `overlap` before its cut.

    The start moves to a word's beginning within the last two fifths of the overlap where there is one.
    Concatenating each piece without what it shares with the one before gives the text again.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be below half the limit")
    at = cuts(text, limit, overlap)
    out = []
    for a, b in zip([0, *at], [*at, len(text)]):
        start = max(0, a - overlap)
        if a and overlap:
            head = text[max(0, start - 1) : a - overlap * 3 // 5]
            if (m := re.search(r"(?<=\s)\S|(?<=[。！？；，、])", head)) and start - 1 + m.start() >= start:
                start = start - 1 + m.start()
            elif JOINED.match(text, start):
                start += 1
        out.append((start, b))
    return out


def split_oversized(items: DataFrame, limit: int = 500, overlap: int = 50) -> DataFrame:
    """Pieces of every item longer than `limit` code points, each of at most `limit`.

    items: item_table STRING, item_key STRING, text STRING; further columns are ignored. Null, empty and
    short texts give no row; copied rows give their pieces once. The length filter runs in the JVM, so
    only oversized texts reach Python; there is no shuffle but the one that removes copied rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for table, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                for n, (a, b) in enumerate(pieces(text, limit, overlap)):
                    for col, x in zip(cols, (table, key, n, a, b, text[a:b])):
                        col.append(x)
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)],
                names=["item_table", "item_key", "piece_no", "start_pos", "end_pos", "text"],
            )

    big = items.select("item_table", "item_key", "text").where(F.length("text") > limit).distinct()
    return big.mapInArrow(run, PIECES)
