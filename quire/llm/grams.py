"""Character n-grams in one global order, cut into fragments; shared by the near-duplicate operators.

The global order of n-grams is that of a fixed 48-bit hash, so it needs no pass over the corpus and never
changes as records arrive. FRAGMENTS ranges of it are the vertical fragments. A record's part in a fragment
is its segment; the segment's key combines its first n-grams, `prefix_of(least)` of them, which for similarity s are the
same in two records with a chance of about s ** prefix per fragment (more for short segments). For the similarity 0.70
these are 5: such a pair shares no key with a chance of 0.003, one at 0.75 with 0.0002.

Of a pair that shares a key, the overlaps are counted fragment by fragment and summed; the sizes of the segments
bound the sum, which drops most false candidates before anything is counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 5
FRAGMENTS = 32
BINS = 128
MIN_LENGTH = 80
# Chance that a pair at the least similarity shares no key, and deviations that its sketches may be apart more than usual (a chance of 0.0001).
LOST = 0.003
DEVIATIONS = 3.8
LOWEST = 0.5
SPLIT_AT = 1_000_000
_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def prefix_of(least: float) -> int:
    """N-grams of a segment in its key: as many as keep the chance to lose a pair at `least` about LOST; at most 16.

    Below LOWEST too few n-grams would be left to tell anything, so smaller similarities are refused.
    """
    if not LOWEST <= least <= 1:
        raise ValueError(f"least has to be from {LOWEST} to 1")
    needed = 1 - (1.1 * LOST) ** (1 / FRAGMENTS)
    return min(16, int(math.log(needed) / math.log(least))) if least < 1 else 16


def least_bits(least: float) -> int:
    """Least number of equal sketch bits of a pair at similarity `least`; for 0.70 the mean of 108.8 less 3.8 deviations of 4.04."""
    p = (1 + least) / 2
    return max(0, int(BINS * p - DEVIATIONS * math.sqrt(BINS * p * (1 - p))))


def normal(content: Column) -> Column:
    """Lower case, each run of ASCII white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(content), r"[ \t\n\x0B\f\r]+", " "))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def sorted_grams(texts: list[str]) -> np.ndarray:
    """Distinct n-grams of each text as (index of the text) << 48 | hash, ascending; at most 65536 texts."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    if len(codes) < SIZE:
        return np.empty(0, np.uint64)
    n = len(codes) - SIZE + 1
    h = codes[:n].copy()
    for k in range(1, SIZE):
        h = h * _P + codes[k : k + n]
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), lens)
    inside = doc[:n] == doc[SIZE - 1 :]
    keys = (doc[:n] << np.uint64(48)) | (_mix(h) >> np.uint64(16))
    keys = keys[inside]
    keys.sort()
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))


def segment_keys(grams: np.ndarray, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, key) of every segment that isn't empty."""
    bits = np.uint64(48 - (FRAGMENTS - 1).bit_length())
    seg = grams >> bits
    at = _starts(seg)
    end = np.append(at[1:], len(grams))
    low = grams & np.uint64((1 << 48) - 1)
    key = seg[at] & np.uint64(FRAGMENTS - 1)
    for j in range(prefix):
        pos = at + j
        there = pos < end
        key = _mix(key * _P + np.where(there, low[np.where(there, pos, at)], np.uint64(j + 1)) + np.uint64(j))
    return (grams[at] >> np.uint64(48)).astype(np.int64), key.view(np.int64)


def sketches(grams: np.ndarray, n: int) -> np.ndarray:
    """Two 64-bit words per text: one bit of the first n-gram in each of 128 ranges of the order."""
    bits = np.uint64(48 - (BINS - 1).bit_length())
    bin_ = grams >> bits
    at = _starts(bin_)
    out = np.zeros((n, BINS), dtype=bool)
    b = bin_[at]
    out[(b >> np.uint64(7)).astype(np.int64), (b & np.uint64(BINS - 1)).astype(np.int64)] = (_mix(grams[at] & np.uint64((1 << 48) - 1)) & np.uint64(1)).astype(bool)
    return np.packbits(out, axis=1).view(np.int64)


def parts(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(offset, texts) such that no part is much above SPLIT_AT code points."""
    a, n = 0, 0
    for b, t in enumerate(texts):
        if b > a and (n + len(t) > SPLIT_AT or b - a == 65535):
            yield a, texts[a:b]
            a, n = b, 0
        n += len(t)
    if a < len(texts):
        yield a, texts[a:]


def keyed(texts: DataFrame, least: float) -> DataFrame:
    """Rows (key, id, s1, s2) of texts(id BIGINT, text STRING): one for each segment that isn't empty.

    Copies within a task come out once, so that a hot text reaches its keys once per task at most.
    """

    prefix = prefix_of(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            fresh = {}
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i not in seen:
                    seen.add(i)
                    fresh[i] = t
            ids = np.fromiter(fresh, dtype=np.int64, count=len(fresh))
            for a, part in parts(list(fresh.values())):
                grams = sorted_grams(part)
                if not len(grams):
                    continue
                doc, key = segment_keys(grams, prefix)
                words = sketches(grams, len(part))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[a + doc]), pa.array(words[doc, 0]), pa.array(words[doc, 1])], names=["key", "id", "s1", "s2"])

    return texts.select("id", "text").mapInArrow(run, "key bigint, id bigint, s1 bigint, s2 bigint")


def alike(a: str, b: str, least: float, sketch: bool = True) -> Column:
    """Whether the sketches in the rows aliased a and b leave a similarity of `least` possible; all do without the sketch."""
    if not sketch:
        return F.lit(True)
    differ = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in ("s1", "s2")), F.lit(0))
    return differ <= BINS - least_bits(least)


def fragment_of(grams: np.ndarray) -> np.ndarray:
    """The fragment of each n-gram of a text."""
    return (grams >> np.uint64(48 - (FRAGMENTS - 1).bit_length())).astype(np.int64) & (FRAGMENTS - 1)


def overlaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Shared n-grams of two texts by fragment."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    return np.bincount(fragment_of(both[1:][both[1:] == both[:-1]]), minlength=FRAGMENTS)


def similarity(x: np.ndarray, y: np.ndarray, sizes_x: np.ndarray, sizes_y: np.ndarray, least: float = 0.0) -> float:
    """Shared n-grams over all distinct n-grams: the overlaps of the fragments, counted separately and summed.

    sizes: n-grams by fragment. 0 where these alone leave less than `least`, or where a text is too short for an n-gram.
    """
    n = len(x) + len(y)
    most = int(np.minimum(sizes_x, sizes_y).sum())
    if not n or most < least * (n - most) - 1e-9:
        return 0.0
    shared = int(overlaps(x, y).sum())
    return shared / (n - shared)


def gram_arrays(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted n-grams, their number by fragment) of each text."""
    out = []
    for _, part in parts(texts):
        grams = sorted_grams(part)
        ends = np.searchsorted(grams, np.arange(1, len(part), dtype=np.uint64) << np.uint64(48)) if len(part) > 1 else []
        for own in np.split(grams & np.uint64((1 << 48) - 1), ends):
            out.append((own, np.bincount(fragment_of(own), minlength=FRAGMENTS)))
    return out


def verified(pairs: DataFrame, least: float) -> DataFrame:
    """pairs(id_a, id_b, text_a, text_b) whose exact similarity is at least `least`: (id_a, id_b, similarity)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                ids_a, ids_b, texts_a, texts_b = (c.to_pylist() for c in some.columns)
                known = {**dict(zip(ids_a, texts_a)), **dict(zip(ids_b, texts_b))}
                grams = dict(zip(known, gram_arrays(list(known.values()))))
                s = np.array([similarity(x[0], y[0], x[1], y[1], least) for a, b in zip(ids_a, ids_b) for x, y in ((grams[a], grams[b]),)], dtype=np.float64)
                keep = pa.array(s >= least - 1e-12)
                yield pa.RecordBatch.from_arrays([some.column(0).filter(keep), some.column(1).filter(keep), pa.array(s).filter(keep)], names=["id_a", "id_b", "similarity"])

    return pairs.select("id_a", "id_b", "text_a", "text_b").mapInArrow(run, "id_a bigint, id_b bigint, similarity double")
