"""Sparse, dense and hybrid encodings as long tables of weights."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import token_bag, tokens
from quire.session import cut

K1, B = 1.5, 0.75


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, dl): one row per distinct term of a document; dl counts all its tokens."""
    bags = docs.select(key, tokens(F.col(text)).alias("t")).withColumn("dl", F.size("t"))
    # explode_outer, as for explode a filter on the whole token expression is put on the scan, which cuts each text twice more
    return bags.select(key, "dl", F.explode_outer("t").alias("term")).where("term is not null").groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def bm25_stats(docs: DataFrame, text: str) -> DataFrame:
    """One row: documents, and their mean number of tokens; null texts count as empty."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.coalesce(F.size(tokens(F.coalesce(F.col(text), F.lit("")))), F.lit(0))).alias("avgdl"))


def bm25_fit(docs: DataFrame, key: str, text: str, max_features: int = 50_000) -> tuple[DataFrame, DataFrame, float]:
    """(term counts, vocabulary, mean number of tokens) of docs: tokens are cut once, and their counts kept for what follows."""
    counts = cut(term_counts(docs, key, text))
    n = docs.count()
    avgdl = (counts.agg(F.sum("tf")).first()[0] or 0) / max(1, n)
    return counts, bm25_vocabulary(counts, n, max_features), avgdl


class Bm25(NamedTuple):
    """vocabulary(term, term_index, df, idf), number of documents, and their mean number of tokens."""

    vocabulary: DataFrame
    n_docs: int
    avgdl: float


def bm25_terms(docs: DataFrame, key: str, text: str, max_features: int = 50_000) -> Bm25:
    """The vocabulary and means of bm25_fit where no counts are kept: terms are summed up where the texts are, so what is
    shuffled and written grows with the terms, not with the documents. Rows that share a key count as one document in df."""
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    terms = lambda rows: rows.select(key, token_bag(F.col(text)).alias("t")).select(key, F.coalesce(F.array_size("t"), F.lit(0)).alias("dl"), F.posexplode_outer(F.array_distinct("t")).alias("pos", "term"))
    seen = cut(terms(docs).groupBy("term").agg(F.count("term").alias("df"), F.sum(first.cast("bigint")).alias("rows"), F.sum(F.when(first, F.col("dl").cast("bigint"))).alias("tokens")))
    n, tokens_ = seen.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    df = seen.select("term", "df").where("term is not null")
    copied = docs.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")).where("_n > 1").select("_k")
    if not copied.isEmpty():
        again = terms(docs.join(copied, F.col(key).eqNullSafe(F.col("_k")), "left_semi")).where("term is not null").groupBy(key, "term").agg((F.count("*") - 1).alias("more"))
        df = df.join(again.groupBy("term").agg(F.sum("more").alias("more")), "term", "left").select("term", (F.col("df") - F.coalesce("more", F.lit(0))).alias("df"))
    return Bm25(_most_used(df, n, max_features), n, tokens_ / max(1, n))


def bm25_vocabulary(counts: DataFrame, n_docs: int, max_features: int = 50_000) -> DataFrame:
    """(term, term_index, df, idf) of the max_features terms of most documents, ties by term."""
    return _most_used(counts.groupBy("term").agg(F.count("*").alias("df")), n_docs, max_features)


def _most_used(df: DataFrame, n_docs: int, max_features: int) -> DataFrame:
    top = df.orderBy(F.desc("df"), "term").limit(max_features)
    rank = F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1  # of at most max_features rows
    return top.select("term", rank.alias("term_index"), "df", F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def bm25_weight(idf, tf, dl, avgdl: float, k1: float = K1, b: float = B):
    """Of columns or of arrays."""
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def bm25_vectors(counts: DataFrame, vocabulary: DataFrame, avgdl: float, k1: float = K1, b: float = B) -> DataFrame:
    """(key..., term, term_index, weight) with weight above 0; the vocabulary has a bounded size, so it is broadcast."""
    weight = bm25_weight(F.col("idf"), F.col("tf"), F.col("dl"), avgdl, k1, b)
    return counts.join(F.broadcast(vocabulary), "term").withColumn("weight", weight).where("weight > 0").drop("tf", "dl", "df", "idf")


def word_ngrams(text: Column, longest: int = 2) -> Column:
    """Words, as runs of letters, digits and underscores of any script, in lower case, and adjacent ones joined up to `longest`."""
    w = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))

    out, last = [w], w
    for n in range(2, longest + 1):
        behind = F.slice(w, n, F.greatest(F.size(w), F.lit(1)))
        last = F.filter(F.zip_with(last, behind, lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())
        out.append(last)
    return F.concat(*out)


def tfidf_fit(docs: DataFrame, key: str, text: str, max_features: int = 50_000, max_df: float = 0.95, min_df: int = 1, longest: int = 2) -> tuple[DataFrame, DataFrame]:
    """(counts(key, term, tf), vocabulary(term, idf)). The vocabulary has the max_features terms of most sightings among those that
    min_df documents and at most a share of max_df of them have, ties by term; idf is ln((1 + N) / (1 + df)) + 1."""
    n = docs.count()
    counts = cut(docs.select(key, F.explode_outer(word_ngrams(F.col(text), longest)).alias("term")).where("term is not null").groupBy(key, "term").agg(F.count("*").alias("tf")))
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("all")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    top = terms.orderBy(F.desc("all"), "term").limit(max_features)
    return counts, top.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_vectors(counts: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """(key, term, weight): tf * idf, of length 1 in each document. The vocabulary has a bounded size, so it is broadcast."""
    raw = counts.join(F.broadcast(vocabulary), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def hash_vector(text: str, dim: int) -> np.ndarray:
    v = np.zeros(dim, dtype=np.float64)
    for i in range(max(0, len(text) - 2)):
        h = int.from_bytes(hashlib.blake2b(text[i : i + 3].encode(), digest_size=8).digest(), "little")
        v[h % dim] += 1.0 if h >> 63 else -1.0
    n = np.linalg.norm(v)
    return v / n if n else v


def dense_hash(text: Column, dim: int = 256, instruction: str = "") -> Column:
    """Feature-hashed trigrams as a unit vector: the stand-in where no model is given. Null gives null."""

    @F.pandas_udf("array<float>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: None if t is None else hash_vector(instruction + t, dim).astype(np.float32))

    return encode(text)


def dense_model(text: Column, load, dim: int, instruction: str = "") -> Column:
    """Vectors of a model that load() gives, loaded once a task: a callable from a list of texts to an array."""

    @F.pandas_udf("array<float>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            made = np.asarray(model([instruction + (t or "") for t in part]), dtype=np.float32).reshape(len(part), dim)
            norm = np.linalg.norm(made, axis=1, keepdims=True)
            yield pd.Series(list(made / np.where(norm > 0, norm, 1)))

    return encode(text)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; null for a null vector."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a vector has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def hybrid_score(dense: Column, sparse: Column, dense_weight: float = 0.7, sparse_weight: float = 0.3) -> Column:
    """Weighted sum of both similarities, the weights scaled to a sum of 1; a missing side counts 0."""
    total = dense_weight + sparse_weight
    return F.coalesce(dense, F.lit(0.0)) * (dense_weight / total) + F.coalesce(sparse, F.lit(0.0)) * (sparse_weight / total)


def cache_misses(chunks: DataFrame, encodings: DataFrame) -> DataFrame:
    """chunks(chunk_id, content_hash, ...) without an encoding of the same content, hex case ignored."""
    known = encodings.select("chunk_id", F.lower("content_hash").alias("content_hash")).distinct()
    own = chunks.withColumn("_h", F.lower("content_hash"))
    k = known.toDF("_id", "_kh")
    return own.join(k, (own["chunk_id"] == k["_id"]) & (own["_h"] == k["_kh"]), "left_anti").drop("_h")


def sparse_cosine(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, cosine) of pairs(a, b) of ids in a(a, term, tf) and b(b, term, tf); 0 where they share no term."""
    norm = lambda rows, key, name: rows.groupBy(key).agg(F.sqrt(F.sum((F.col("tf") * F.col("tf")).cast("double"))).alias(name))
    met = pairs.join(a.withColumnRenamed("tf", "x"), "a").join(b.withColumnRenamed("tf", "y"), ["b", "term"])
    dots = met.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    cos = dots.join(norm(a, "a", "na"), "a").join(norm(b, "b", "nb"), "b").select("a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine"))
    return pairs.join(cos, ["a", "b"], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
