"""The most similar vectors of every vector by multiprobe p-stable hashing.

A table hashes a unit vector v by M functions floor((a.v + b) / W) with normal a (Datar et al. 2004). A vector
looks into its own bucket and into perturbed ones, in the order of estimated success (Lv et al. 2007). The
candidates of all tables are merged, and their distances to the query are worked out exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut, spread

DIM = 64
WORDS = 3
SLOTS = 1 << 18
RECALL = 0.97
FAR, FAR_RECALL = 0.5, 0.97


@dataclass(frozen=True)
class Tables:
    """functions: M; width: W; tables: L; probes: perturbed buckets visited in each table."""

    functions: int
    width: float
    tables: int
    probes: int
    seed: int = 7

    @staticmethod
    def near(n: int) -> Tables:
        """For neighbours of cosine 0.90 or more among n vectors; buckets keep their size as n grows.

        There are as many tables as find a pair at cosine 0.90 with a chance of RECALL, which is worked out
        for the number of functions; so the tables grow in number with n, and the recall stays.
        """
        functions = int(np.clip(round(12 + np.log2(max(n, 1) / 1e5)), 5, 40))
        one = success(Tables(functions, 2.4, 1, 4), 0.90)
        return Tables(functions, 2.4, int(np.ceil(np.log(1 - RECALL) / np.log1p(-one))), 4)

    @staticmethod
    def wide(n: int) -> Tables:
        """For the nearest whatever their distance: few functions and many probes, as such neighbours differ much.

        Functions and probes grow with n, and tables so that a pair at cosine FAR meets with a chance of FAR_RECALL: of 10^5 vectors
        nearly all are visited, of 10^7 four tenths, so the work grows more slowly than the square of n.
        """
        functions = 6 + max(0, round(2 * np.log10(max(n, 1) / 1e5)))
        one = Tables(functions, 1.8, 1, int(140 * 2 ** ((functions - 6) / 2)))
        return replace(one, tables=int(np.ceil(np.log(1 - FAR_RECALL) / np.log1p(-success(one, FAR, 500, 4, both=False)))))


def probe_sets(functions: int, most: int) -> list[tuple[int, ...]]:
    """Perturbations as positions among the 2M distances to bucket walls, sorted ascending; likeliest first.

    The expected squared distance at each position orders the sets; one set never moves a function both ways.
    """
    m = functions
    j = np.arange(1, 2 * m + 1)
    z = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)))
    heap: list[tuple[float, tuple[int, ...]]] = [(z[0], (0,))]
    out: list[tuple[int, ...]] = []
    while heap and len(out) < most:
        cost, a = heapq.heappop(heap)
        if all((2 * m - 1 - x) not in a for x in a):
            out.append(a)
        if (last := a[-1]) + 1 < 2 * m:
            heapq.heappush(heap, (cost - z[last] + z[last + 1], (*a[:-1], last + 1)))
            heapq.heappush(heap, (cost + z[last + 1], (*a, last + 1)))
    return out


class Hasher:
    """The tables' functions, drawn from a seed, so that every task has the same ones."""

    def __init__(self, t: Tables, dim: int = DIM) -> None:
        rng = np.random.default_rng(t.seed)
        self.t = t
        self.a = rng.standard_normal((t.tables, dim, t.functions)).astype(np.float32)
        self.b = rng.random((t.tables, t.functions)).astype(np.float32) * t.width
        self.mult = rng.integers(1, 2**62, (t.tables, t.functions), dtype=np.int64) | 1
        self.sets = probe_sets(t.functions, t.probes)
        self.signs = rng.standard_normal((dim, 64 * WORDS)).astype(np.float32)

    def keys(self, v: np.ndarray, probes: bool = True) -> Iterator[tuple[bool, np.ndarray]]:
        """(is the own bucket, key of each vector) for each bucket visited, tables in turn."""
        t = self.t
        for n in range(t.tables):
            x = (v @ self.a[n] + self.b[n]) / t.width
            k = np.floor(x)
            frac = x - k
            with np.errstate(over="ignore"):
                own = (k.astype(np.int64) * self.mult[n]).sum(1) * np.int64(2 * n + 1)
                yield True, own
                if not probes:
                    continue
                order = np.argsort(np.concatenate([frac, 1 - frac], 1), 1)
                move = np.concatenate([-self.mult[n], self.mult[n]]) * np.int64(2 * n + 1)
                for chosen in self.sets:
                    yield False, own + move[order[:, list(chosen)]].sum(1)

    def words(self, v: np.ndarray) -> np.ndarray:
        """WORDS 64-bit words of the signs of random projections."""
        return np.packbits(v @ self.signs > 0, axis=1).view(np.int64)


def success(t: Tables, cosine: float, pairs: int = 2000, draws: int = 8, both: bool = True) -> float:
    """Chance that a pair of unit vectors at this cosine meets in some table when either looks for the other, by simulation from a seed.

    both=False: when only one of them looks.
    """
    rng = np.random.default_rng(13)
    hits = 0
    for n in range(draws):
        v, w = rng.standard_normal((2, pairs, DIM))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        w -= (v * w).sum(1, keepdims=True) * v
        w = cosine * v + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
        h, met = Hasher(replace(t, seed=t.seed + n)), np.zeros(pairs, bool)
        for (own, a), (_, b) in zip(h.keys(v.astype(np.float32)), h.keys(w.astype(np.float32))):
            if own:
                at_v, at_w = a, b
            met |= (a == at_w) | (b == at_v) & both
        hits += int(met.sum())
    return hits / (pairs * draws)


def usable(vectors: DataFrame, key: str, vector: str, dim: int = DIM) -> DataFrame:
    """(id, cls, unit) of the vectors that take part, at length 1: not null, of `dim` values, finite, not all zero.

    cls is a hash of the direction to six decimals, the same for all vectors of it.
    """
    mult = np.random.default_rng(11).integers(1, 2**62, dim, dtype=np.int64) | 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.fromiter((len(x) == dim and x.values.null_count == 0 if x.is_valid else False for x in batch.column(1)), dtype=bool, count=batch.num_rows) & np.asarray(batch.column(0).is_valid())
            part = batch.filter(pa.array(ok))
            if not part.num_rows:
                continue
            v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            with np.errstate(all="ignore"):
                norm = np.sqrt((v * v).sum(1))
                good = np.isfinite(norm) & (norm > 0)
                u = v[good] / norm[good, None]
                cls = (np.round(u * 1e6).astype(np.int64) * mult).sum(1)
            flat = pa.array(u.astype(np.float32).ravel())
            unit = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1, dtype=np.int32) * dim), flat)
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(good)), pa.array(cls), unit], names=["id", "cls", "unit"])

    return vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v")).mapInArrow(run, "id bigint, cls bigint, unit array<float>")


def _matrix(col: pa.ListArray) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(col), -1)


def _bits(cosine: float) -> int:
    """Most differing sign bits of a pair at this cosine: the mean and 3.8 deviations."""
    p, n = float(np.arccos(cosine) / np.pi), 64 * WORDS
    return int(np.ceil(n * p + 3.8 * np.sqrt(n * p * (1 - p))))


def near_pairs(units: DataFrame, least: float, t: Tables) -> DataFrame:
    """Distinct (a, b), a < b, and cosine, of vectors units(cls BIGINT, unit) with cosine of at least `least`.

    A row of 40 bytes stands for a vector in each bucket; words of signs drop most false candidates in
    the join, before any vector is moved. Vectors are moved once for the classes that are left. Copies of a
    class meet their buckets once per task at most; AQE splits a bucket that holds very many rows.
    """
    words = [f"w{i}" for i in range(WORDS)]

    def hashed(probes: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h, seen = Hasher(t), set()
            for batch in batches:
                cls = batch.column(0).to_pylist()
                fresh = list({c: i for i, c in reversed(list(enumerate(cls))) if c not in seen}.values())
                seen.update(cls)
                part = batch.take(pa.array(fresh, pa.int64()))
                if part.num_rows:
                    v = _matrix(part.column(1))
                    w = [pa.array(np.ascontiguousarray(x)) for x in h.words(v).T]
                    for _, key in h.keys(v, probes):
                        yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0), *w], names=["key", "id", *words])

        return units.select("cls", "unit").mapInArrow(run, "key bigint, id bigint, " + ", ".join(f"{w} bigint" for w in words))

    a, b = hashed(False).alias("a"), hashed(True).alias("b")
    differ = sum((F.bit_count(F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}"))) for w in words), F.lit(0))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.id") != F.col("b.id")) & (differ <= _bits(least)))
    pairs = cut(met.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct())
    slot = lambda c: F.pmod(c, F.lit(SLOTS)).cast("int")
    slots = pairs.select(F.explode(F.array("a", "b")).alias("c")).select(slot(F.col("c")).alias("slot")).distinct()
    some = units.withColumn("slot", slot(F.col("cls"))).join(F.broadcast(slots), "slot", "left_semi").dropDuplicates(["cls"])
    left, right = some.select(F.col("cls").alias("a"), F.col("unit").alias("va")), some.select(F.col("cls").alias("b"), F.col("unit").alias("vb"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return pairs.join(left, "a").join(right, "b").select("a", "b", dot.alias("cosine")).where(F.col("cosine") >= least)


def near_neighbours(vectors: DataFrame, key: str, vector: str, k: int = 5, least: float = 0.90) -> DataFrame:
    """(id, neighbour, cosine, rank): of each usable vector, its k most similar of cosine of at least `least`.

    Ties are ranked by id. Vectors of one direction, to six decimals, form a class that is hashed once; of a class
    only the k + 1 least ids can be among the k most similar of any vector, so a hot class never multiplies
    rows. Null, all-zero, short and non-finite vectors take no part; copied rows count once.
    """
    units = cut(usable(spread(vectors), key, vector))
    members = cut(units.select("id", "cls").distinct())
    pairs = cut(near_pairs(units.select("cls", "unit"), least, Tables.near(members.count())))
    first = members.withColumn("n", F.row_number().over(Window.partitionBy("cls").orderBy("id"))).where(F.col("n") <= k + 1).select(F.col("cls").alias("other"), F.col("id").alias("neighbour"))
    many = members.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls", F.col("cls").alias("other"), F.lit(1.0).alias("cosine"))
    sides = pairs.select(F.col("a").alias("cls"), F.col("b").alias("other"), "cosine").unionByName(pairs.select(F.col("b").alias("cls"), F.col("a").alias("other"), "cosine"))
    near = sides.unionByName(many).join(first, "other").join(members, "cls").where("id <> neighbour")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))
    return near.select("id", "neighbour", "cosine", rank.alias("rank")).where(F.col("rank") <= k)


def nearest(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int = 5, t: Tables | None = None, block: int = 4096) -> DataFrame:
    """(id, neighbour, cosine, rank): of each query, its k most similar other vectors at any distance.

    All vectors are indexed; a query visits its own and its perturbed buckets in every table. A bucket is
    cut into blocks of about `block` vectors, and each visit goes to all of them, so no bucket is held
    in one task. A block scores its visitors by one matrix product on 8-bit copies and keeps the k + 2 best of each;
    the merged candidates are ranked by their exact cosines, ties by id. Copies of a vector all count as others.
    """
    base = cut(usable(spread(vectors), key, vector).select("id", "unit").dropDuplicates(["id"]))
    asked = cut(usable(queries, key, vector).select("id", "unit").dropDuplicates(["id"]))
    tables = t or Tables.wide(base.count())

    def hashed(probes: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h = Hasher(tables)
            for batch in batches:
                for start in range(0, batch.num_rows, 1000):
                    part = batch.slice(start, 1000)
                    v = _matrix(part.column(1))
                    small = np.round(v * 127).astype(np.int8)
                    code = pa.array([r.tobytes() for r in small], pa.binary())
                    for _, key in h.keys(v, probes):
                        yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0), code], names=["key", "id", "code"])

        return run

    shape = "key bigint, id bigint, code binary"
    index = cut(base.mapInArrow(hashed(False), shape))
    sizes = index.groupBy("key").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).select("key", "blocks")
    placed = index.join(sizes, "key").select("key", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("ask"), "id", "code")
    visits = asked.mapInArrow(hashed(True), shape).join(sizes, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("ask"), "id", "code")
    rows = placed.unionByName(visits).repartition("key", "block").sortWithinPartitions("key", "block", "ask")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, codes = None, [], []

        def visit(base_ids: np.ndarray, base_codes: np.ndarray, q_ids: np.ndarray, q_codes: np.ndarray) -> pa.RecordBatch:
            s = q_codes @ base_codes.T
            s[q_ids[:, None] == base_ids[None, :]] = -np.inf
            n = min(k + 2, s.shape[1])
            top = np.argpartition(-s, n - 1, 1)[:, :n] if n < s.shape[1] else np.broadcast_to(np.arange(n), s.shape)
            a, b = np.repeat(q_ids, n), base_ids[top].ravel()
            v = np.take_along_axis(s, top, 1).ravel()
            ok = np.isfinite(v)
            return pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(v[ok].astype(np.float32))], names=["id", "neighbour", "s"])

        base_ids, base_codes = np.empty(0, np.int64), np.empty((0, DIM), np.float32)
        for batch in batches:
            key = batch.column(0).to_numpy()
            blk = batch.column(1).to_numpy()
            ask = batch.column(2).to_numpy()
            vid = batch.column(3).to_numpy()
            code = np.frombuffer(b"".join(batch.column(4).to_pylist()), dtype=np.int8).reshape(len(vid), DIM).astype(np.float32)
            edge = np.flatnonzero((key[1:] != key[:-1]) | (blk[1:] != blk[:-1]) | (ask[1:] != ask[:-1])) + 1
            for a, b in zip([0, *edge], [*edge, len(vid)]):
                if (key[a], blk[a]) != now:
                    now, ids, codes = (key[a], blk[a]), [], []
                    base_ids = np.empty(0, np.int64)
                if ask[a] == 0:
                    ids.append(vid[a:b])
                    codes.append(code[a:b])
                elif ids:
                    if not len(base_ids):
                        base_ids, base_codes = np.concatenate(ids), np.concatenate(codes)
                    yield visit(base_ids, base_codes, vid[a:b], code[a:b])

    met = rows.mapInArrow(score, "id bigint, neighbour bigint, s float").groupBy("id", "neighbour").agg(F.max("s").alias("s"))
    some = met.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"), "neighbour"))).where(F.col("n") <= 4 * k).select("id", "neighbour")
    cosine = F.aggregate(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    exact = some.join(asked.toDF("id", "va"), "id").join(base.toDF("neighbour", "vb"), "neighbour").select("id", "neighbour", cosine.alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= k)
