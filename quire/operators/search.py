"""Exact top-k search over vectors and terms, and what follows it: thresholds, reranking, previews."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import token_bag
from quire.operators.encode import Bm25, bm25_weight, hybrid_score
from quire.session import cut, spread

BLOCK = 10_000
DENSE = 1000  # terms of which a block of documents holds a full row


def _scores(q: np.ndarray, v: np.ndarray, space: str) -> np.ndarray:
    if space == "ip":
        return q @ v.T
    qn, vn = (q * q).sum(1), (v * v).sum(1)
    if space == "cosine":
        n = np.sqrt(qn)[:, None] * np.sqrt(vn)[None, :]
        cos = np.divide(q @ v.T, n, out=np.zeros((len(q), len(v))), where=n > 0)
        return 1 - (1 - cos) / 2
    return np.exp(-np.maximum(0.0, qn[:, None] + vn[None, :] - 2 * (q @ v.T)))


def top_k(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int = 5, space: str = "cosine", digits: int = 6, block: int = BLOCK) -> DataFrame:
    """(query_id, key, score, rank): the k best vectors of each query, by score to `digits` digits, ties by key.

    space is cosine (score (1 + cos) / 2), l2 (exp of minus the squared distance) or ip (dot product). Queries and
    vectors are cut into blocks by a hash of their ids; each block of queries meets each block of vectors in one cell of a
    join on the two numbers, so a task holds a block of both whatever the sizes, and nothing passes the driver. A cell scores by a
    matrix product and passes on k rows a query. A query finds itself unless the caller filters it. Null vectors take no part.
    """
    if space not in ("cosine", "l2", "ip"):
        raise ValueError(f"unknown space {space}")
    asked = queries.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    n_asked, n_rows = asked.count(), rows.count()
    across = max(1, -(-n_asked // block))
    down = max(1, min(-(-n_rows // 256), max(-(-n_rows // block), asked.sparkSession.sparkContext.defaultParallelism)))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    q = asked.select(place(across).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("y"), F.lit(0).alias("side"), "id", "v")
    r = rows.select(F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("x"), place(down).alias("y"), F.lit(1).alias("side"), "id", "v")
    cells = q.unionByName(r).repartition(across * down, "x", "y").sortWithinPartitions("x", "y", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        now = ids = asked_v = None
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def done() -> Iterator[pa.RecordBatch]:
            if best is not None and best.n:
                yield best.batch(key)

        for batch in batches:
            x, y, side, vid = (batch.column(c).to_numpy() for c in range(4))
            col = batch.column(4)
            flat, ends = col.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(np.asarray(pa.compute.list_value_length(col))))
            edges = np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(x)]):
                v = flat[ends[a] : ends[b]].reshape(b - a, -1)
                if (x[a], y[a]) != now:
                    yield from done()
                    now, best, parts, ids = (x[a], y[a]), None, [], None
                if side[a] == 0:
                    parts.append((vid[a:b], v))
                elif parts:
                    if best is None:
                        ids, asked_v = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                        best = _Best(ids, k)
                    for i in range(0, b - a, 2048):
                        best.add(vid[a:b][i : i + 2048], np.round(_scores(asked_v, v[i : i + 2048], space), digits))
        yield from done()

    found = cells.mapInArrow(run, f"query_id bigint, `{key}` bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


class _Best:
    """The k best of what was added for each query: by score, ties by id."""

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.ids, self.k, self.n = ids, k, 0
        self.score = np.empty((len(ids), 0))
        self.id = np.empty((len(ids), 0), np.int64)

    def add(self, vid: np.ndarray, s: np.ndarray) -> None:
        score = np.concatenate((self.score, s), 1)
        id_ = np.concatenate((self.id, np.broadcast_to(vid, s.shape)), 1)
        if score.shape[1] > self.k:
            # all that are as good as the k-th stay until ties are settled by id
            least = -np.partition(-score, self.k - 1, 1)[:, self.k - 1 : self.k]
            width = int((score >= least).sum(1).max())
            some = np.argpartition(-score, width - 1, 1)[:, :width] if width < score.shape[1] else np.broadcast_to(np.arange(score.shape[1]), score.shape)
            score, id_ = np.take_along_axis(score, some, 1), np.take_along_axis(id_, some, 1)
        order = np.lexsort((id_, -score), axis=1)[:, : self.k]
        self.score, self.id = np.take_along_axis(score, order, 1), np.take_along_axis(id_, order, 1)
        self.n = self.score.size

    def batch(self, key: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, self.score.shape[1])), pa.array(self.id.ravel()), pa.array(self.score.ravel())], names=["query_id", key, "score"])


def retrieve(hits: DataFrame, k: int, threshold: float | None, rerank: Column | None = None, order: str = "vec_id") -> DataFrame:
    """Hits of score threshold or more; with rerank, that score replaces theirs and decides the order. A threshold of None or 0 passes all."""
    kept = hits.where(F.col("score") >= threshold) if threshold else hits
    if rerank is not None:
        kept = kept.withColumn("score", rerank)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), order))
    return kept.drop("rank").withColumn("rank", rank).where(F.col("rank") <= k)


def bm25_search(query_terms: DataFrame, docs: DataFrame, key: str, text: str, fit: Bm25, k: int = 5, block: int = 200_000) -> DataFrame:
    """(query_id, key, score, rank): the k documents of greatest sum of BM25 weights over the query's distinct terms.

    query_terms(query_id, term). Ties go by key, null last; rows that share a key are one document, and a term's dl is
    that of the first of them that has it. Only the counts of terms that some query asks for leave the texts, a row a
    document. Blocks of queries meet blocks of documents in cells, one a task: it holds the queries, the documents pass in the
    order of their keys, and k rows a query are left. It is exact, so its work is queries times documents.
    """
    s = docs.sparkSession
    asked = query_terms.distinct()
    terms = fit.vocabulary.join(asked.select("term").distinct(), "term", "left_semi").orderBy("term_index").toPandas()  # at most max_features
    known, idf, dense = pa.array(terms["term"].tolist(), pa.string()), terms["idf"].to_numpy(np.float64), min(DENSE, int((terms["df"] * 16 > fit.n_docs).sum()))
    numbers = s.createDataFrame(pa.table({"term": known, "ix": pa.array(np.arange(len(known), dtype=np.int32))}))
    queries = cut(asked.join(F.broadcast(numbers), "term").groupBy("query_id").agg(F.array_sort(F.collect_set("ix")).alias("ts")))
    n_asked, avgdl = queries.count(), fit.avgdl
    across = max(1, -(-n_asked // block))
    down = max(1, min(-(-fit.n_docs // 256), max(-(-fit.n_docs // 500_000), 2 * s.sparkContext.defaultParallelism)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = batch.column("t")
            dl = pa.compute.fill_null(pa.compute.list_value_length(bags), 0).to_numpy().astype(np.int64)
            ix = pa.compute.fill_null(pa.compute.index_in(bags.flatten(), value_set=known), -1).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(dl)), dl)
            cell, tf = np.unique((row * len(known) + ix)[ix >= 0], return_counts=True)
            ends = np.append(0, np.cumsum(np.bincount(cell // max(1, len(known)), minlength=len(dl)))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (cell % max(1, len(known)), tf)]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("at"), pa.array(dl.astype(np.int32)), *lists], names=[key, "at", "dl", "ts", "tf"])

    kind, asked_kind = docs.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    bags = spread(docs.select(key, F.monotonically_increasing_id().alias("at"), text)).select(key, "at", token_bag(F.col(text)).alias("t"))
    bags = bags.mapInArrow(count, f"`{key}` {kind}, at bigint, dl int, ts array<int>, tf array<int>").where("size(ts) > 0")
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    none = lambda t: F.lit(None).cast(t)
    parts = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(place("query_id", across).alias("x"), parts(down).alias("y"), "query_id", none(kind).alias(key), none("bigint").alias("at"), none("int").alias("dl"), "ts", none("array<int>").alias("tf"))
    r = bags.select(parts(across).alias("x"), place(key, down).alias("y"), none(asked_kind).alias("query_id"), key, "at", "dl", "ts", "tf")
    cells = q.unionByName(r).repartitionById(across * down, F.col("x") * down + F.col("y")).drop("x", "y").sortWithinPartitions(F.col("tf").isNotNull(), F.asc_nulls_last(key), "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_: list[pa.RecordBatch] = []
        best, rest = None, None
        for batch in batches:
            n = batch.column("tf").null_count  # queries come first
            if n:
                asked_.append(batch.slice(0, n))
            if n == len(batch):
                continue
            best = best or _Terms(asked_, idf, dense, avgdl, k, key)
            rows = pa.Table.from_batches([batch.slice(n)])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            # the last key may go on in the next batch
            code = _codes(rows.column(key))
            last = int(np.searchsorted(code, code[-1]))
            best.add(rows.slice(0, last), code[:last])
            rest = rows.slice(last)
        if best is not None:
            best.add(rest, _codes(rest.column(key)))
            yield from best.batches()

    found = cells.mapInArrow(run, f"query_id {asked_kind}, `{key}` {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last(key)))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _codes(keys: pa.ChunkedArray) -> np.ndarray:
    """0 for the first of sorted keys, and one more wherever another begins."""
    ix = keys.combine_chunks().dictionary_encode("encode").indices.to_numpy()
    return np.cumsum(np.append(0, ix[1:] != ix[:-1])) if len(ix) else ix


class _Terms:
    """The k best documents of each query, by rounded score, ties by the order in which they come."""

    def __init__(self, asked: list[pa.RecordBatch], idf: np.ndarray, dense: int, avgdl: float, k: int, key: str) -> None:
        rows = pa.Table.from_batches(asked).combine_chunks() if asked else None
        self.ids = rows.column("query_id") if rows else None
        sets = [np.asarray(x, np.int64) for x in rows.column("ts").to_pylist()] if rows else []
        self.sets = [(x[x < dense], x[x >= dense].tolist()) for x in sets]
        self.idf, self.dense, self.avgdl, self.k, self.key = idf, dense, avgdl, k, key
        self.score, self.at = [np.empty(0)] * len(sets), [np.empty(0, np.int64)] * len(sets)
        self.least = np.zeros(len(sets))
        self.keys: list[pa.ChunkedArray] = []
        self.n = 0

    def add(self, rows: pa.Table, code: np.ndarray) -> None:
        """rows of whole documents in the order of their keys; code: the document of each."""
        step = 4096
        for first in range(0, int(code[-1]) + 1 if len(code) else 0, step):
            a, b = np.searchsorted(code, [first, first + step])
            self._block(rows.slice(a, b - a), code[a:b] - first)

    def _block(self, rows: pa.Table, code: np.ndarray) -> None:
        n = int(code[-1]) + 1
        ts = rows.column("ts").combine_chunks()
        size = pa.compute.list_value_length(ts).to_numpy()
        t, tf = (rows.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("ts", "tf"))
        doc, dl = np.repeat(code, size), np.repeat(rows.column("dl").to_numpy(), size)
        order = np.argsort(t, kind="stable")  # of the rows of a document the first one comes first
        t, doc, tf, dl = t[order], doc[order], tf[order], dl[order]
        if len(rows) > n:
            at = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (doc[1:] != doc[:-1])))
            t, doc, tf, dl = t[at], doc[at], np.add.reduceat(tf, at), dl[at]
        w = bm25_weight(self.idf[t], tf, dl, self.avgdl)
        ends = np.searchsorted(t, np.arange(len(self.idf) + 1))
        table = np.zeros((self.dense, n))
        cut_ = ends[self.dense]
        table[t[:cut_], doc[:cut_]] = w[:cut_]
        ends = ends.tolist()
        for i, (often, rare) in enumerate(self.sets):
            s = np.add.reduce(table[often], 0)
            for x in rare:
                a, b = ends[x], ends[x + 1]
                if a < b:
                    s[doc[a:b]] += w[a:b]
            some = np.flatnonzero(s > self.least[i])
            if len(some):
                self._keep(i, s[some], some)
        keys = rows.column(self.key).combine_chunks()
        self.keys.append(keys.take(pa.array(np.flatnonzero(np.append(True, code[1:] != code[:-1])))))
        self.n += n

    def _keep(self, i: int, s: np.ndarray, some: np.ndarray) -> None:
        k = self.k
        if len(s) > 4 * k:
            # all whose rounded score may be that of the k-th
            near = s >= np.partition(s, len(s) - k)[len(s) - k] - 2e-6
            s, some = s[near], some[near]
        score, at = np.append(self.score[i], np.floor(s * 1e6 + 0.5) / 1e6), np.append(self.at[i], some + self.n)
        top = np.argsort(-score, kind="stable")[:k]
        self.score[i], self.at[i] = score[top], at[top]
        if len(top) == k:
            self.least[i] = max(0.0, score[top[-1]] + 4e-7)  # a later one has to be better by 1e-6 when rounded

    def batches(self) -> Iterator[pa.RecordBatch]:
        keys = pa.concat_arrays(self.keys)
        for a in range(0, len(self.sets), 10_000):
            n = [len(x) for x in self.score[a : a + 10_000]]
            if sum(n):
                ids = self.ids.take(pa.array(np.repeat(np.arange(a, a + len(n)), n))).combine_chunks()
                yield pa.RecordBatch.from_arrays([ids, keys.take(pa.array(np.concatenate(self.at[a : a + len(n)]))), pa.array(np.concatenate(self.score[a : a + len(n)]))], names=["query_id", self.key, "score"])


def hybrid_search(dense: DataFrame, sparse: DataFrame, key: str, k: int = 5, dense_weight: float = 0.7, sparse_weight: float = 0.3) -> DataFrame:
    """(query_id, key, score, rank) of hits(query_id, key, score) of a dense and a term search, by their weighted sum.

    Sparse scores are divided by the query's greatest one; a hit that only one search has counts 0 in the other.
    The weights are scaled to a sum of 1.
    """
    top = sparse.groupBy("query_id").agg(F.max("score").alias("top"))
    scaled = sparse.join(top, "query_id").select("query_id", key, F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0).alias("sparse"))
    both = dense.select("query_id", key, F.col("score").alias("dense")).join(scaled, ["query_id", key], "full")
    fused = both.select("query_id", key, F.round(hybrid_score(F.col("dense"), F.col("sparse"), dense_weight, sparse_weight), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return fused.withColumn("rank", rank).where(F.col("rank") <= k)


def preview(content: Column, n: int = 300) -> Column:
    return F.substring(content, 1, n)


def query_file_key(query: Column) -> Column:
    return F.substring(F.md5(query.cast("binary")), 1, 8)
