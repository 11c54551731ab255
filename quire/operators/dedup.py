"""Exact, SimHash and embedding deduplication that keeps the first of each group."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut


def first_of(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """rows with `first`: the order columns of the first row of the same key, as a struct.

    The first is found by an aggregate with map-side combine, not by a window, so a key that a third of
    the rows have is never sorted in one task. Null keys are their own first.
    """
    keyed = rows.withColumn("_key", key)
    heads = keyed.where("_key is not null").groupBy("_key").agg(F.min(F.struct(*order)).alias("first"))
    return keyed.join(heads, "_key", "left").withColumn("first", F.coalesce("first", F.struct(*order))).drop("_key")


def dedup_exact(rows: DataFrame, content: str, order: list[str]) -> DataFrame:
    """rows with `kept`: whether the row is the first of its content, in the order of `order`, a unique key."""
    return first_of(rows, F.md5(F.col(content).cast("binary")), order).withColumn("kept", F.struct(*order) == F.col("first"))


def dedup_incremental(rows: DataFrame, content: str, order: list[str], seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows kept, hashes to append): the first rows of contents whose md5 isn't in seen(hash)."""
    new = rows.withColumn("hash", F.md5(F.col(content).cast("binary"))).join(seen.select("hash").distinct(), "hash", "left_anti")
    kept = dedup_exact(new, content, order).where("kept").drop("kept", "first")
    return kept, kept.select("hash").where("hash is not null")


def dedup_stats(original: Column, kept: Column) -> list[Column]:
    """Aggregates: rows, rows kept, rows removed, and the share removed to four digits, 0 for no rows."""
    n, k = F.count(original), F.count(F.when(kept, 1))
    return [n.alias("original_count"), k.alias("kept_count"), (n - k).alias("removed_count"), F.coalesce(F.round((n - k) / n, 4), F.lit(0.0)).alias("dedup_rate")]


CACHED_GRAMS = 1_000_000
GRAMS_AT_ONCE = 500_000


class Fingerprints:
    """SimHash of texts in batches: each distinct trigram is hashed once, the bits are counted by numpy."""

    def __init__(self) -> None:
        self.known: dict[int, int] = {}

    def _words(self, keys: np.ndarray) -> np.ndarray:
        if len(self.known) > CACHED_GRAMS:
            self.known.clear()
        out = []
        for k in keys.tolist():
            if (word := self.known.get(k)) is None:
                gram = chr(k >> 42) + chr(k >> 21 & 0x1FFFFF) + chr(k & 0x1FFFFF)
                word = self.known[k] = _low(gram)
            out.append(word)
        return np.array(out, dtype=np.uint64)

    def of(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        part: list[str] = []
        size = 0
        for t in texts:
            if part and size + len(t) > GRAMS_AT_ONCE:
                out += self._of(part)
                part, size = [], 0
            part.append(t)
            size += len(t)
        return out + self._of(part) if part else out

    def _of(self, texts: list[str]) -> list[int]:
        lens = np.array([len(t) for t in texts])
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        counts = np.maximum(lens - 2, 0)
        ones = np.zeros((len(texts), 64), dtype=np.int64)
        if counts.any():
            doc = np.repeat(np.arange(len(texts)), lens)
            keys = (codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[doc[:-2] == doc[2:]]
            distinct, at = np.unique(keys, return_inverse=True)
            bits = np.unpackbits(self._words(distinct).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[at]
            starts = (np.cumsum(counts) - counts)[counts > 0]
            ones[counts > 0] = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        for i in np.flatnonzero(counts == 0):  # a text of one or two characters, or none, is its own gram
            ones[i] = np.unpackbits(np.array([_low(texts[i])], dtype=">u8").view(np.uint8))
        most = 2 * ones > np.maximum(counts, 1)[:, None]
        return np.packbits(most, axis=1).view(">i8").ravel().tolist()


def _low(gram: str) -> int:
    return int.from_bytes(hashlib.md5(gram.encode("utf-8", "surrogatepass")).digest()[8:], "big")


def simhash(c: Column) -> Column:
    """64-bit SimHash: majority of each bit of the low 8 md5 bytes of the text's trigrams, ties to 0. Null gives null."""

    @F.pandas_udf("bigint")
    def prints(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = Fingerprints()
        for texts in parts:
            distinct = texts.dropna().unique().tolist()
            known = dict(zip(distinct, made.of(distinct)))
            # by way of a list: a series of numbers and nulls would be of floats, which don't hold 64 bits
            yield pd.Series(pd.array([known.get(t) for t in texts], dtype="Int64"))

    return prints(c)


def masks(threshold: int, blocks: int) -> list[int]:
    """Masks of 64 bits, as signed numbers: all choices of blocks - threshold blocks of about equal width. Two fingerprints within the
    threshold differ in at most that many blocks, so they agree under one of the masks."""
    ends = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [(1 << ends[i + 1]) - (1 << ends[i]) for i in range(blocks)]
    found = [sum(block[i] for i in some) for some in combinations(range(blocks), blocks - threshold)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def near_fingerprints(prints: DataFrame, threshold: int = 3, blocks: int | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints prints(fp) within the Hamming threshold.

    Of `blocks` blocks of bits, all but `threshold` must be equal, so an equi-join on choices of blocks finds every pair. By default there
    is one block more than the threshold, so keys have 16 bits at a threshold of 3. With two more, there are 20 keys of
    32 bits instead of 4: more rows, but few that meet by chance. Equal fingerprints are joined as one.
    """
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks(threshold, blocks or threshold + 1)))))
    rows = prints.select("fp").where("fp is not null").distinct().select("fp", keys.alias("k")).select("fp", "k.mask", "k.bits")
    a, b = rows.alias("a"), rows.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= threshold
    return a.join(b, (F.col("a.mask") == F.col("b.mask")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.fp") < F.col("b.fp")) & near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def blocks_for(n: int, threshold: int) -> int:
    """Blocks for n fingerprints: the pairs are the same, but where some tens meet under each key of 16 bits, longer keys are cheaper."""
    return threshold + (1 if n < 4_000_000 else 3)


def keep_first(nodes: DataFrame, pairs: DataFrame, rounds: int = 200) -> DataFrame:
    """(id) of nodes(id, place) to remove, taken in order of place: those near an earlier kept node of pairs(a, b).

    Each round keeps the nodes without an undecided earlier neighbour and removes their later neighbours,
    which gives the same as taking them one by one (Blelloch, Fineman and Shun 2012).
    """
    pa_, pb = nodes.toDF("a", "place_a"), nodes.toDF("b", "place_b")
    first = F.col("place_a") < F.col("place_b")
    now = cut(pairs.join(pa_, "a").join(pb, "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("late")).distinct())
    removed = nodes.select("id").limit(0)
    for _ in range(rounds):
        if now.isEmpty():
            return removed
        kept = now.select(F.col("early").alias("id")).distinct().join(now.select(F.col("late").alias("id")), "id", "left_anti")
        out = cut(now.join(kept, now["early"] == kept["id"], "left_semi").select(F.col("late").alias("id")).distinct())
        removed = removed.unionByName(out)
        rest = now.join(out, now["early"] == out["id"], "left_anti").join(kept, now["early"] == kept["id"], "left_anti")
        now = cut(rest.join(out, rest["late"] == out["id"], "left_anti"))
    raise RuntimeError("the order did not settle")


def dedup_simhash(rows: DataFrame, content: str, order: str, threshold: int = 3) -> DataFrame:
    """(order, fp, kept): a row is removed if an earlier row that isn't removed is within the threshold.

    Rows of one fingerprint are one node at the place of the first; the later ones are always removed. Null contents are kept.
    """
    prints = cut(rows.select(F.col(order), simhash(F.col(content)).alias("fp")))
    nodes = cut(prints.where("fp is not null").groupBy(F.col("fp").alias("id")).agg(F.min(order).alias("place")))
    pairs = cut(near_fingerprints(nodes.select(F.col("id").alias("fp")), threshold, blocks_for(nodes.count(), threshold)))
    out = keep_first(nodes, pairs).withColumn("gone", F.lit(True))
    return prints.join(nodes.withColumnRenamed("id", "fp"), "fp", "left").join(out.withColumnRenamed("id", "fp"), "fp", "left").select(order, "fp", (F.col("fp").isNull() | (F.col("gone").isNull() & (F.col(order) == F.col("place")))).alias("kept"))


def dedup_embedding(vectors: DataFrame, key: str, vector: str, least: float = 0.95, pairs: DataFrame | None = None) -> DataFrame:
    """(key, kept): keep-first by cosine of at least `least`. pairs(a, b) may come from any index; else all blocks are compared."""
    found = pairs if pairs is not None else cosine_pairs(vectors, key, vector, least)
    nodes = vectors.select(F.col(key).alias("id"), F.col(key).alias("place")).distinct()
    gone = keep_first(nodes, found).withColumn("gone", F.lit(True))
    return nodes.join(gone, "id", "left").select(F.col("id").alias(key), F.col("gone").isNull().alias("kept"))


def cosine_pairs(vectors: DataFrame, key: str, vector: str, least: float, block: int = 4096) -> DataFrame:
    """Pairs (a, b), a < b, with cosine of at least `least`, exactly: blocks of vectors against blocks, as matrix products.

    Vectors are packed by a hash into blocks of about `block`; a block meets each other block once, as
    two rows of a join on the pair of block numbers, so a task holds two blocks whatever the collection.
    """
    n = vectors.count()
    k = max(1, -(-n // block))
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(k)).cast("int").alias("blk")).where("v is not null")
    cells = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select(F.least("blk", "o").alias("x"), F.greatest("blk", "o").alias("y"), "blk", "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        x, y, blk, ids = (table.column(c).to_numpy() for c in ("x", "y", "blk", "id"))
        v = np.array(table.column("v").to_pylist(), dtype=np.float64)
        norm = np.linalg.norm(v, axis=1)
        v = v / np.where(norm > 0, norm, 1)[:, None]
        for cell in {*zip(x.tolist(), y.tolist())}:
            at = np.flatnonzero((x == cell[0]) & (y == cell[1]))
            p, q = at[blk[at] == cell[0]], at[blk[at] == cell[1]]
            i, j = np.nonzero(v[p] @ v[q].T >= least)
            a, b = ids[p[i]], ids[q[j]]
            ok = a < b if cell[0] == cell[1] else a != b
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)[ok]), pa.array(np.maximum(a, b)[ok])], names=["a", "b"])

    return cells.repartition(max(1, k * (k + 1) // 2), "x", "y").mapInArrow(run, "a bigint, b bigint").distinct()


def duplicate_groups(rows: DataFrame, key: str, content: str, order: str, kept: str) -> DataFrame:
    """(removed id, kept id or null): for each removed row the first kept row with the same first 100 characters."""
    head = F.substring(content, 1, 100)
    keepers = rows.where(kept).groupBy(head.alias("head")).agg(F.min_by(key, order).alias("kept_id"))
    return rows.where(f"not {kept}").select(F.col(key).alias("removed_id"), head.alias("head")).join(keepers, "head", "left").select("removed_id", "kept_id")


@dataclass(frozen=True)
class Strategy:
    """Which steps a deduplication takes, and what becomes of the removed rows: keep_first drops them, merge joins their contents to the kept ones."""

    use_hash: bool = True
    use_simhash: bool = True
    use_embedding: bool = False
    simhash_threshold: int = 3
    embedding_threshold: float = 0.95
    duplicates: str = "keep_first"

    @staticmethod
    def of(name: str, config: dict | None = None) -> Strategy:
        """'test' never compares embeddings; 'production' does unless the settings say otherwise."""
        if name not in ("test", "production"):
            raise ValueError(f"unknown strategy {name}")
        own = {k: v for k, v in (config or {}).items() if k in Strategy.__dataclass_fields__}
        return Strategy(**{"use_embedding": name == "production", **own, **({"use_embedding": False, "embedding_threshold": 0.95} if name == "test" else {})})


def simhash_heads(rows: DataFrame, content: str, order: str, threshold: int = 3) -> DataFrame:
    """(order, kept, head): for each row that SimHash removes the first kept row within the threshold, for a kept one itself."""
    marked = cut(dedup_simhash(rows, content, order, threshold))
    nodes = marked.where("fp is not null").groupBy("fp").agg(F.min(order).alias("place"), F.max("kept").alias("stays"))
    pairs = near_fingerprints(nodes.select("fp"), threshold)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    stay = nodes.where("stays").select(F.col("fp").alias("b"), F.col("place").alias("head"))
    near = both.join(stay, "b").groupBy(F.col("a").alias("fp")).agg(F.min("head").alias("head"))
    known = nodes.join(near, "fp", "left").select("fp", F.when(F.col("stays"), F.col("place")).otherwise(F.col("head")).alias("head"))
    return marked.join(known, "fp", "left").select(order, "kept", F.coalesce("head", order).alias("head"))


def merged(rows: DataFrame, content: str, order: str, heads: DataFrame) -> DataFrame:
    """(order, content, merged_count) of the rows that heads(order, kept, head) keeps: the different contents of those removed in favour of one
    are joined to its own by newlines, in their order."""
    own = rows.select(order, F.col(content).alias("content"))
    kept = heads.where("kept").select(order).join(own, order)
    gone = heads.where("not kept").select(order, "head").join(own, order).join(kept.select(F.col(order).alias("head"), F.col("content").alias("first")), "head").where("content <> first")
    added = gone.groupBy("head").agg(F.array_sort(F.collect_list(F.struct(order, "content"))).alias("more"))
    text = F.array_join(F.concat(F.array("content"), F.transform(F.coalesce("more", F.array().cast(added.schema["more"].dataType)), lambda x: x["content"])), "\n")
    text = F.when(F.col("more").isNull(), F.col("content")).otherwise(text)
    return kept.join(added.withColumnRenamed("head", order), order, "left").select(order, text.alias("content"), F.coalesce(F.size("more"), F.lit(0)).alias("merged_count"))


def deduplicate(rows: DataFrame, content: str, order: str, strategy: Strategy = Strategy(), vector: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept rows, removed (order, step)) by the strategy's steps in turn: hash, simhash, embedding. order is a unique key; with
    duplicates='merge' the kept rows' contents have those of similar ones joined on. An embedding step needs a `vector` column."""
    now, removed = rows, rows.select(order, F.lit("").alias("step")).limit(0)
    if strategy.use_hash:
        marked = cut(dedup_exact(now, content, [order]))
        removed = removed.unionByName(marked.where("not kept").select(order, F.lit("hash").alias("step")))
        now = marked.where("kept").drop("kept", "first")
    if strategy.use_simhash:
        heads = cut(simhash_heads(now, content, order, strategy.simhash_threshold))
        removed = removed.unionByName(heads.where("not kept").select(order, F.lit("simhash").alias("step")))
        texts = merged(now, content, order, heads).drop("merged_count") if strategy.duplicates == "merge" else None
        now = now.join(heads.where("kept").select(order), order, "left_semi")
        if texts is not None:
            now = now.drop(content).join(texts.withColumnRenamed("content", content), order).select(*rows.columns)
    if strategy.use_embedding and vector:
        marked = cut(dedup_embedding(now.where(F.col(vector).isNotNull()), order, vector, strategy.embedding_threshold)).where("not kept").select(order)
        removed = removed.unionByName(marked.withColumn("step", F.lit("embedding")))
        now = now.join(marked, order, "left_anti")
    return now, removed
