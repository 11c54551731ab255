"""Queries of the training-data operators, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import admission, canonical, encoding, mixing, near_dup, ocr, packing, similar_vectors, split, tokens, toxicity
from quire.llm.sql import SQL as SQL
from quire.session import cut, spread, table


def _long_items(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select(F.lit("chunks").alias("item_table"), F.col("chunk_id").alias("item_key"), F.col("content").alias("text"))
    cleaned = table(spark, d, "cleaning_results").select(F.lit("cleaning_results").alias("item_table"), F.col("result_id").cast("string").alias("item_key"), F.col("cleaned_text").alias("text"))
    return chunks.unionByName(cleaned)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Items above 500 code points: those that the splitter cut."""
    return split.split_oversized(_long_items(spark, d)).where("piece_no = 1").select("item_table", "item_key").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every oversized item, each of at most 500 code points."""
    return split.split_oversized(_long_items(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of results whose cleaned_text differs as stored but looks the same."""
    rows = spread(table(spark, d, "cleaning_results").select("result_id", "cleaned_text"))
    return canonical.same_look_pairs(rows, "result_id", "cleaned_text").toDF("result_id_a", "result_id_b")


def p3_canonical(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every cleaned_text, and its case-folded form as a comparison key."""
    rows = spread(table(spark, d, "cleaning_results").select("result_id", "cleaned_text"))
    both = canonical.with_canonical(rows, "cleaned_text", "canonical_text")
    return canonical.with_canonical(both, "canonical_text", "folded_text", fold_case=True).drop("cleaned_text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks whose contents differ as stored and share at least 0.70 of their 5-grams."""
    rows = table(spark, d, "chunks").select("chunk_id", "content")
    return near_dup.similar_rows(rows, "chunk_id", "content").toDF("chunk_id_a", "chunk_id_b")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of near-duplicates of every chunk, and its number of links."""
    rows = table(spark, d, "chunks").select("chunk_id", "content")
    return near_dup.near_dup_classes(rows, "chunk_id", "content").withColumnRenamed("key", "chunk_id")


def _kinds(spark: SparkSession, d: str) -> dict[str, int]:
    return {r["container_kind"]: r["capacity_tokens"] for r in table(spark, d, "container_sizes").collect()}


def _packed(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    sizes = cut(tokens.token_counts(docs, "doc_id", "text"))
    return packing.pack(sizes.withColumnRenamed("doc_id", "item"), _kinds(spark, d))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or part of one above the capacity, for each kind of container."""
    return _packed(spark, d).withColumnRenamed("item", "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and the share of room filled, by kind of container."""
    return packing.fill_report(_packed(spark, d), _kinds(spark, d))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = spread(table(spark, d, "documents").select("doc_id", mixing.source_name(F.col("source")).alias("source"), "text"))
    sizes = cut(tokens.token_counts(docs, "doc_id", "text", keep=("source",)))
    targets = table(spark, d, "source_targets").withColumn("source", mixing.source_name(F.col("source")))
    return mixing.mix(sizes.withColumnRenamed("doc_id", "item"), targets)


def p9_copies(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used so that each source has its share of all tokens."""
    return _mixed(spark, d)[0].withColumnRenamed("item", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of all tokens that each source was to have and has."""
    return _mixed(spark, d)[1]


def _reached_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The rows of dense_vectors that some encoding points to."""
    paths = table(spark, d, "encodings").select("dense_vector_path").where(F.col("dense_vector_path").isNotNull()).distinct()
    return table(spark, d, "dense_vectors").join(paths, "dense_vector_path", "left_semi").select("vec_id", "dense_vector")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with cosine of at least 0.90 of which one is among the 5 most similar of the other."""
    near = similar_vectors.near_neighbours(_reached_vectors(spark, d), "vec_id", "dense_vector")
    return near.select(F.least("id", "neighbour").alias("vec_id_a"), F.greatest("id", "neighbour").alias("vec_id_b")).distinct()


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar of all vectors, for each vector whose id is divisible by 20."""
    vectors = _reached_vectors(spark, d)
    found = similar_vectors.nearest(vectors.where("vec_id % 20 = 0"), vectors, "vec_id", "dense_vector")
    return found.select(F.col("id").alias("vec_id"), F.col("neighbour").alias("neighbour_id"), F.round("cosine", 6).alias("cosine"), "rank")


def p6_refused(spark: SparkSession, d: str) -> DataFrame:
    """The incoming rows to refuse, and why, all batches in their order against an index of the history."""
    encodings, chunks = table(spark, d, "encodings"), table(spark, d, "chunks").select("chunk_id", "content")
    # only ids meet the encodings; the texts of those accepted are picked where their copies are brought together
    ids = near_dup.texts_of(chunks, "chunk_id", "content").select("key", "id")
    accepted = ids.join(encodings.select(F.col("chunk_id").alias("key")).distinct(), "key", "left_semi").select("id").distinct()
    texts = near_dup.texts_of(chunks, "chunk_id", "content").groupBy("id").agg(F.min("text").alias("text"))
    index = admission.HistoryIndex(spark)
    index.append_hashes(encodings.select(F.col("content_hash").alias("hash")))
    index.append(texts.join(accepted, "id", "left_semi"), chunks.count())
    batch = table(spark, d, "incoming_chunks").select("incoming_id", "batch_no", "content")
    refused = admission.admit(index, batch, "incoming_id", "content", ["batch_no", "incoming_id"])
    index.drop()
    return refused.select(F.col("key").alias("incoming_id"), "reason")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The incoming rows to refuse."""
    return p6_refused(spark, d).select("incoming_id").distinct()


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled fields of cleaning_results with the chains undone and the text so restored."""
    rows = table(spark, d, "cleaning_results").select("result_id", "original_text", "cleaned_text")
    model = encoding.train_on(rows, "result_id", "cleaned_text")
    return encoding.garbled_fields(spread(rows), "result_id", ["original_text", "cleaned_text"], model).withColumnRenamed("key", "result_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Fields garbled through a wrong encoding."""
    return p7_restored(spark, d).select("result_id", "field_name").distinct()


def _toxicity(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("source", mixing.source_name(F.col("source")))
    rows = spread(docs.select("doc_id", *keep, "text"))
    scorer = toxicity.train(rows, table(spark, d, "content_labels"))
    return toxicity.scored(rows, scorer, keep)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with an abusive, hateful or sexually explicit statement."""
    return toxicity.flagged(_toxicity(spark, d)).where("found").select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of every document: -log10 of the chance of such passages in a harmless text."""
    return _toxicity(spark, d)


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    """Rates of such documents by source."""
    return toxicity.source_rates(_toxicity(spark, d, "source"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "loaded_pages").select(F.lit("loaded_pages").alias("record_table"), F.col("page_id").alias("record_id"), "file_path", "page_num", F.col("content").alias("text"))
    cleaned = table(spark, d, "cleaning_results").select(F.lit("cleaning_results").alias("record_table"), F.col("result_id").alias("record_id"), F.col("filename").alias("file_path"), F.lit(None).cast("int").alias("page_num"), F.col("original_text").alias("text"))
    return spread(pages.unionByName(cleaned))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of scanned texts that carry marks of page layout or recognition."""
    records = _records(spark, d)
    pages = ocr.scanned_pages(records)
    return ocr.defects(pages, ocr.train(records, pages))


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The scanned texts as continuous paragraphs."""
    records = _records(spark, d)
    pages = ocr.scanned_pages(records)
    return ocr.repaired(pages, ocr.train(records, pages))


QUERIES = {
    "p1_found": p1_found, "p1_neighbours": p1_neighbours,
    "p2_found": p2_found, "p2_pieces": p2_pieces,
    "p3_found": p3_found, "p3_canonical": p3_canonical,
    "p4_found": p4_found, "p4_groups": p4_groups,
    "p5_found": p5_found, "p5_repaired": p5_repaired,
    "p6_found": p6_found, "p6_refused": p6_refused,
    "p7_found": p7_found, "p7_restored": p7_restored,
    "p8_containers": p8_containers, "p8_fill": p8_fill,
    "p10_found": p10_found, "p10_scores": p10_scores, "p10_sources": p10_sources,
    "p9_copies": p9_copies, "p9_shares": p9_shares,
}
