"""Queries of the engine by name, each over whole tables, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import rules, text
from quire.operators import chunk, dedup, encode, evaluate, search, tables
from quire.plans import office, sql
from quire.session import spread, table
from quire.sources import parse, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = sql.SQL


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# Sources and sinks


@query
def scan_filter_ext(s: SparkSession, d: str) -> DataFrame:
    """Files of the wanted types, in the order of their paths."""
    files = table(s, d, "file_records").select("file_path").distinct().withColumn("ext", text.extension(F.col("file_path")))
    return files.where(F.col("ext").isin("pdf", "docx", "txt", "md")).orderBy("file_path")


@query
def loader_registry(s: SparkSession, d: str) -> DataFrame:
    """Files by the loader that takes them."""
    files = table(s, d, "file_records").select("file_path").distinct()
    return files.groupBy(parse.loader_of(F.col("file_path")).alias("loader")).agg(F.count("*").alias("files"))


@query
def load_csv_join(s: SparkSession, d: str) -> DataFrame:
    """Nations as the text of one CSV file per region."""
    rows = table(s, d, "nation").select("n_regionkey", "n_nationkey", F.concat_ws(" | ", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")).alias("line"))
    return rows.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "line"))), lambda x: x["line"]), "\n").alias("content"), F.count("*").alias("row_count"))


@query
def render_sheet_rows(s: SparkSession, d: str) -> DataFrame:
    """Parts as the rows of a sheet: cells that aren't null, joined by bars."""
    cells = [F.col("p_partkey").cast("string"), F.col("p_name"), F.col("p_brand"), F.nullif(F.col("p_type"), F.lit("")), F.col("p_size").cast("string")]
    return table(s, d, "part").select("p_partkey", F.concat_ws(" | ", *cells).alias("line"))


@query
def html_title(s: SparkSession, d: str) -> DataFrame:
    """Titles of documents that were written as HTML pages."""
    page = F.concat(F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title></head><body><h1>h</h1></body></html>"))
    return table(s, d, "documents").select("doc_id", F.regexp_extract(page, r"<title>([^<]*)</title>", 1).alias("title"), F.length(page).cast("bigint").alias("raw_length"))


@query
def html_text(s: SparkSession, d: str) -> DataFrame:
    """Text of documents that were written as HTML pages, by the parser."""
    body = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("</p><p>"))
    page = F.concat(F.lit("<html><head><title>t</title><script>var x;</script></head><body><p>"), body, F.lit("</p></body></html>"))
    return spread(table(s, d, "documents")).select("doc_id", parse.html_text(page).alias("content"))


@query
def page_group(s: SparkSession, d: str) -> DataFrame:
    """Pages of each file: how many, the first and last number, and the code points in all. Copied pages count once."""
    pages = table(s, d, "loaded_pages").select("page_id", "file_path", "page_num", F.length("content").alias("n")).distinct()
    return pages.groupBy("file_path").agg(F.count("*").alias("pages"), F.min("page_num").alias("first_page"), F.max("page_num").alias("last_page"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("chars"))


def _loaded(s: SparkSession, d: str) -> DataFrame:
    """Suppliers as one file of each format, read by the parsers."""
    rows = table(s, d, "supplier").select("s_suppkey", F.col("s_name").alias("title"), F.array(F.concat(F.lit("key "), F.col("s_suppkey").cast("string")), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"))).alias("lines"), F.explode(F.array(*map(F.lit, office.WRITERS))).alias("kind"))
    files = rows.select(F.concat_ws(".", F.col("s_suppkey").cast("string"), "kind").alias("path"), office.written(F.col("kind"), F.col("title"), F.col("lines")).alias("content"))
    return parse.load(files)


@query
def load_files(s: SparkSession, d: str) -> DataFrame:
    """Text, author, title and counts of files of every format, and the error of those that need a recogniser."""
    m = F.col("metadata")
    return _loaded(s, d).select("path", "loader", "content", "error", m["title"].alias("title"), m["author"].alias("author"), F.coalesce(m["slide_count"], m["sheet_count"], m["row_count"]).alias("parts"), m["encoding"].alias("encoding"))


@query
def load_slides(s: SparkSession, d: str) -> DataFrame:
    """The slides of the presentations."""
    return parse.page_rows(_loaded(s, d))


@query
def page_elements(s: SparkSession, d: str) -> DataFrame:
    """Pages put together from their lines, of which only the first one of a page bears its number."""
    pages = table(s, d, "loaded_pages").where("content is not null").groupBy("file_path", "page_num").agg(F.min_by("content", F.struct("page_id", "content")).alias("content"))
    lines = pages.select("file_path", "page_num", F.posexplode(F.split("content", "\n")).alias("line", "text")).where(F.length(F.trim("text")) > 0)
    first = lines.groupBy("file_path", "page_num").agg(F.min("line").alias("first"))
    marked = lines.join(first, ["file_path", "page_num"]).select("file_path", (F.col("page_num") * 100_000 + F.col("line")).alias("element_no"), F.when(F.col("line") == F.col("first"), F.col("page_num")).alias("page_num"), "text")
    return parse.pages_of_elements(marked).select("file_path", "page_num", F.md5(F.col("content").cast("binary")).alias("content_hash"))


@query
def file_metadata(s: SparkSession, d: str) -> DataFrame:
    """Name, extension and size of every file record, 0 where the size isn't known."""
    return table(s, d, "file_records").select("file_path", text.file_name(F.col("file_path")).alias("filename"), text.extension(F.col("file_path")).alias("extension"), F.coalesce(F.col("metadata")["size_bytes"].cast("bigint"), F.lit(0)).alias("size_bytes"))


@query
def failed_rows(s: SparkSession, d: str) -> DataFrame:
    """Report of what failed."""
    return table(s, d, "cleaning_results").where("error is not null or not success").select("result_id", "filename", F.col("error").alias("reason"))


@query
def query_file_key(s: SparkSession, d: str) -> DataFrame:
    """Names of the result files of title queries."""
    return table(s, d, "documents").where("title is not null").select("doc_id", search.query_file_key(F.col("title")).alias("file_key"))


# Cleaning


@query
def clean_structure(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "cleaning_results").select("result_id", text.clean_structure(F.col("original_text")).alias("cleaned"))


@query
def clean_quality_report(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "cleaning_results").select("result_id", text.quality_report(F.col("original_text"), F.col("cleaned_text")).alias("q"))
    return q.select("result_id", "q.original_length", "q.cleaned_length", F.round("q.length_ratio", 6).alias("length_ratio"), "q.char_set_valid", "q.min_length_check", "q.passed", F.concat_ws(",", "q.issues").alias("issues"))


@query
def clean_drop_empty(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").where(F.length(text.clean_structure(F.col("content"))) > 0).select("chunk_id")


@query
def clean_report(s: SparkSession, d: str) -> DataFrame:
    """Texts cleaned again with their reports; rows without a text are errors."""
    r = table(s, d, "cleaning_results").select("result_id", text.clean_with_report(F.col("original_text"), F.col("filename")).alias("r"))
    q = F.col("r.quality_report")
    return r.select("result_id", "r.filename", "r.success", "r.error", F.md5(F.col("r.cleaned_text").cast("binary")).alias("cleaned_hash"), q["cleaned_length"].alias("cleaned_length"), q["passed"].alias("passed"))


@query
def out_cleaned(s: SparkSession, d: str) -> DataFrame:
    """What is written of each cleaned text: the head with its lengths, and the text."""
    return sinks.cleaned_text(table(s, d, "cleaning_results")).select(F.md5(F.col("value").cast("binary")).alias("value_hash"), F.length("value").alias("length"))


def _rule(s: SparkSession, d: str, *names: str) -> DataFrame:
    return table(s, d, "loaded_pages").select("page_id", rules.apply_rules(F.col("content"), only=set(names) or None).alias("content"))


@query
def rule_url(s: SparkSession, d: str) -> DataFrame:
    linked = F.concat(F.coalesce("content", F.lit("")), F.lit(" see https://example.org/a?b=1 and me@example.org."))
    return table(s, d, "chunks").select("chunk_id", rules.apply_rules(linked, only={"remove_url"}).alias("content"))


@query
def rule_email(s: SparkSession, d: str) -> DataFrame:
    linked = F.concat(F.coalesce("content", F.lit("")), F.lit(" see https://example.org/a?b=1 and me@example.org."))
    return table(s, d, "chunks").select("chunk_id", rules.apply_rules(linked, only={"remove_email"}).alias("content"))


@query
def rule_page_header(s: SparkSession, d: str) -> DataFrame:
    return _rule(s, d, "remove_page_headers")


@query
def rule_page_number(s: SparkSession, d: str) -> DataFrame:
    """The page-number rule on single lines, as it only fires on a text that is nothing but a number."""
    lines = table(s, d, "loaded_pages").select("page_id", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    return lines.select("page_id", "line_no", rules.apply_rules(F.col("line"), only={"remove_page_numbers"}).alias("line"))


@query
def rules_all(s: SparkSession, d: str) -> DataFrame:
    return _rule(s, d)


@query
def ocr_dehyphenate(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "loaded_pages").select("page_id", text.join_hyphens(F.col("content")).alias("content"))


@query
def ocr_merge_lines(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "loaded_pages")).where("content is not null").select("page_id", text.merge_lines(F.col("content")).alias("content"))


@query
def ocr_quotes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "cleaning_results").select("result_id", text.plain_quotes(F.col("cleaned_text")).alias("cleaned"))


@query
def strip_bullets(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "loaded_pages").select("page_id", text.strip_bullets(F.concat(F.lit("• "), F.col("content"))).alias("content"))


@query
def remove_punct(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select("chunk_id", text.drop_punctuation(F.col("content")).alias("content"))


@query
def non_ascii(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select("chunk_id", text.drop_non_ascii(F.col("content")).alias("content"))


@query
def to_simplified(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select("chunk_id", text.simplified(s, F.col("content")).alias("content"))


@query
def fix_encoding(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "cleaning_results")).select("result_id", parse.fix_encoding(F.col("cleaned_text")).alias("cleaned"))


# Chunking


@query
def chunk_fixed(s: SparkSession, d: str) -> DataFrame:
    return chunk.fixed_windows(table(s, d, "documents").select("doc_id", "text"), "text").select("doc_id", "chunk_index", "start_pos", "end_pos", "content")


@query
def chunk_recursive(s: SparkSession, d: str) -> DataFrame:
    return chunk.recursive_chunks(spread(table(s, d, "documents")), "doc_id", "text")


@query
def chunk_metadata(s: SparkSession, d: str) -> DataFrame:
    """Recursive chunks with the metadata of their documents: by language and source, documents and whether any has no chunk but should."""
    chunks = chunk.recursive_chunks(spread(table(s, d, "documents")), "doc_id", "text", keep=("lang", "source", "title"))
    return chunks.where("chunk_index = 0").select("doc_id", "lang", "source", "title")


@query
def chunk_filter_short(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").where(F.length("content") >= 20).select("chunk_id", "chunk_index")


@query
def chunk_merge_short(s: SparkSession, d: str) -> DataFrame:
    """Sentences of each document, short ones joined to the next, numbered from 0."""
    parts = F.split("text", r"(?<=[.。!?])\s*")
    return table(s, d, "documents").select("doc_id", F.posexplode(chunk.merge_short(parts)).alias("chunk_index", "content"))


# Chunk and file tables


@query
def content_hash(s: SparkSession, d: str) -> DataFrame:
    c = F.col("content").cast("binary")
    return table(s, d, "chunks").select("chunk_id", F.md5(c).alias("md5"), F.sha2(c, 256).alias("sha256"), F.coalesce(F.md5(c) == F.lower("content_hash"), F.lit(False)).alias("as_stored"))


@query
def out_dedup_report(s: SparkSession, d: str) -> DataFrame:
    """The report of an exact deduplication of the documents."""
    removed = dedup.deduplicate(_docs(s, d), "text", "doc_id", dedup.Strategy(use_simhash=False))[1]
    return sinks.dedup_report(removed, _docs(s, d), CUTOFF)


@query
def out_embedding_meta(s: SparkSession, d: str) -> DataFrame:
    return sinks.embedding_meta(table(s, d, "embeddings"), "embedding")


@query
def chunk_ids(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select("chunk_id", F.concat("source_file", F.lit("#"), F.col("chunk_index").cast("string")).alias("rebuilt_id"))


def _incoming(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "incoming_chunks").select("chunk_id", F.regexp_extract("chunk_id", "^(.*)#", 1).alias("source_file"), "content")


@query
def chunk_upsert(s: SparkSession, d: str) -> DataFrame:
    old = table(s, d, "chunks").select("chunk_id", "source_file", "content")
    return tables.upsert_by(old, _incoming(s, d), "source_file").select("source_file", "chunk_id", "content")


@query
def chunks_by_file(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select("source_file", "chunk_index", "chunk_id").orderBy("source_file", "chunk_index")


@query
def chunk_delete_file(s: SparkSession, d: str) -> DataFrame:
    return tables.delete_by(table(s, d, "chunks").select("source_file", "chunk_id"), _incoming(s, d), "source_file")


@query
def chunk_delete_ids(s: SparkSession, d: str) -> DataFrame:
    return tables.delete_by(table(s, d, "chunks").select("chunk_id", "source_file"), table(s, d, "incoming_chunks"), "chunk_id")


@query
def file_chunk_counts(s: SparkSession, d: str) -> DataFrame:
    """Chunks that each file record still lists once those with equal ids among the incoming are deleted."""
    listed = table(s, d, "file_records").select("file_path", "processed_at", F.explode_outer("chunk_ids").alias("chunk_id"))
    gone = table(s, d, "incoming_chunks").select("chunk_id", F.lit(1).alias("gone")).distinct()
    return listed.join(gone, "chunk_id", "left").groupBy("file_path", "processed_at").agg(F.count(F.when(F.col("gone").isNull(), F.col("chunk_id"))).alias("chunks"))


@query
def chunk_update(s: SparkSession, d: str) -> DataFrame:
    return tables.update_existing(table(s, d, "chunks").select("chunk_id", "content"), table(s, d, "incoming_chunks").select("chunk_id", "content"), "chunk_id", "content")


@query
def chunk_stats(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").agg(F.count("*").alias("rows"), F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("source_file").alias("files"), F.countDistinct("content_hash").alias("contents"))


CUTOFF = "2025-06-01"


def _state(s: SparkSession, d: str) -> DataFrame:
    return tables.latest(table(s, d, "file_records").where(F.col("processed_at") < CUTOFF), "file_path", "processed_at", "file_hash")


def _current(s: SparkSession, d: str) -> DataFrame:
    return tables.latest(table(s, d, "file_records"), "file_path", "processed_at", "file_hash")


@query
def file_unchanged(s: SparkSession, d: str) -> DataFrame:
    old = _state(s, d).withColumnRenamed("file_hash", "old_hash")
    return _current(s, d).join(old, "file_path", "left").select("file_path", F.coalesce(F.col("file_hash") == F.col("old_hash"), F.lit(False)).alias("unchanged"))


# Deduplication


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text")


@query
def clean_hash_dedup(s: SparkSession, d: str) -> DataFrame:
    """Documents cleaned, hashed, and marked as the first of their content or not; empty ones are dropped."""
    cleaned = _docs(s, d).select("doc_id", text.clean_structure(F.col("text")).alias("cleaned")).where(F.length("cleaned") > 0)
    hashed = cleaned.select("doc_id", F.length("cleaned").alias("cleaned_length"), F.md5(F.col("cleaned").cast("binary")).alias("content_hash"))
    return dedup.first_of(hashed, F.col("content_hash"), ["doc_id"]).select("doc_id", "cleaned_length", "content_hash", (F.col("doc_id") == F.col("first.doc_id")).alias("kept"))


@query
def dedup_exact(s: SparkSession, d: str) -> DataFrame:
    return dedup.dedup_exact(_docs(s, d), "text", ["doc_id"]).where("kept").select("doc_id")


@query
def dedup_exact_removed(s: SparkSession, d: str) -> DataFrame:
    return dedup.dedup_exact(_docs(s, d), "text", ["doc_id"]).where("not kept").select("doc_id", F.col("first.doc_id").alias("first_id"))


@query
def dedup_stats(s: SparkSession, d: str) -> DataFrame:
    marked = dedup.dedup_exact(_docs(s, d), "text", ["doc_id"])
    return marked.agg(*dedup.dedup_stats(F.col("doc_id"), F.col("kept")))


@query
def dedup_incremental(s: SparkSession, d: str) -> DataFrame:
    """Incoming rows whose content isn't in the accepted history, first of each content."""
    seen = table(s, d, "encodings").select(F.lower("content_hash").alias("hash"))
    return dedup.dedup_incremental(table(s, d, "incoming_chunks").select("incoming_id", "content"), "content", ["incoming_id"], seen)[0].select("incoming_id", "hash")


@query
def dedup_groups(s: SparkSession, d: str) -> DataFrame:
    marked = dedup.dedup_exact(_docs(s, d), "text", ["doc_id"])
    return dedup.duplicate_groups(marked, "doc_id", "text", "doc_id", "kept")


@query
def simhash_fp(s: SparkSession, d: str) -> DataFrame:
    return spread(_docs(s, d)).select("doc_id", dedup.simhash(F.col("text")).alias("fp"))


@query
def simhash_links(s: SparkSession, d: str) -> DataFrame:
    """Number of other fingerprints within the threshold, by fingerprint, and the documents that have it."""
    prints = spread(_docs(s, d)).select("doc_id", dedup.simhash(F.col("text")).alias("fp"))
    pairs = dedup.near_fingerprints(prints)
    links = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("links"))
    return prints.groupBy("fp").agg(F.count("*").alias("documents")).join(links, "fp", "left").fillna(0)


@query
def dedup_simhash(s: SparkSession, d: str) -> DataFrame:
    return dedup.dedup_simhash(spread(_docs(s, d)), "text", "doc_id")


@query
def dedup_embedding(s: SparkSession, d: str) -> DataFrame:
    return dedup.dedup_embedding(table(s, d, "embeddings"), "vec_id", "embedding")


@query
def dedup_global(s: SparkSession, d: str) -> DataFrame:
    """Chunks kept by content hash, then by SimHash, in the order of their ids."""
    rows = table(s, d, "chunks").select("chunk_id", "content").distinct()
    first = dedup.dedup_exact(rows, "content", ["chunk_id"]).where("kept").select("chunk_id", "content")
    return dedup.dedup_simhash(spread(first), "content", "chunk_id").where("kept").select("chunk_id")


@query
def dedup_merge(s: SparkSession, d: str) -> DataFrame:
    """Documents kept by SimHash, with the contents of those removed in their favour joined on."""
    rows = _docs(s, d)
    text_ = dedup.merged(rows, "text", "doc_id", dedup.simhash_heads(spread(rows), "text", "doc_id"))
    return text_.select("doc_id", "merged_count", F.length("content").alias("length"), F.md5(F.col("content").cast("binary")).alias("content_hash"))


@query
def dedup_strategy(s: SparkSession, d: str) -> DataFrame:
    """Documents removed by each step of the test strategy."""
    removed = dedup.deduplicate(_docs(s, d), "text", "doc_id", dedup.Strategy.of("test"))[1]
    return removed.groupBy("step").agg(F.count("*").alias("documents"))


# Encoding


def _bm25(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    counts, vocabulary, avgdl = encode.bm25_fit(spread(_docs(s, d)), "doc_id", "text")
    return vocabulary, encode.bm25_vectors(counts, vocabulary, avgdl)


@query
def tokens(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select("chunk_id", F.array_join(text.tokens(F.coalesce("content", F.lit(""))), " ").alias("tokens"))


@query
def bm25_stats(s: SparkSession, d: str) -> DataFrame:
    return encode.bm25_stats(_docs(s, d), "text").select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query
def bm25_vocab(s: SparkSession, d: str) -> DataFrame:
    return _bm25(s, d)[0].select("term", F.col("term_index").cast("bigint").alias("term_index"), "df", F.round("idf", 6).alias("idf"))


@query
def bm25_vectors(s: SparkSession, d: str) -> DataFrame:
    return _bm25(s, d)[1].select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query
def tfidf_vectors(s: SparkSession, d: str) -> DataFrame:
    counts, vocabulary = encode.tfidf_fit(spread(_docs(s, d)), "doc_id", "text")
    return encode.tfidf_vectors(counts, vocabulary, "doc_id").select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query
def dense_encode_hash(s: SparkSession, d: str) -> DataFrame:
    return spread(table(s, d, "chunks")).select("chunk_id", encode.dense_hash(F.col("content")).alias("vector"))


@query
def hybrid_rows(s: SparkSession, d: str) -> DataFrame:
    """Which encodings have a dense vector that is there, a sparse one, and both."""
    vectors = table(s, d, "dense_vectors").where("dense_vector is not null").select("dense_vector_path", F.lit(True).alias("dense"))
    rows = table(s, d, "encodings").select("chunk_id", "content_hash", "dense_vector_path", F.col("sparse_vector_path").isNotNull().alias("has_sparse")).join(vectors, "dense_vector_path", "left")
    dense = F.coalesce("dense", F.lit(False))
    return rows.select("chunk_id", "content_hash", dense.alias("has_dense"), "has_sparse", (dense & F.col("has_sparse")).alias("is_hybrid"))


@query
def sparse_cosine(s: SparkSession, d: str) -> DataFrame:
    """Cosine of term counts, and hybrid score without dense vectors, of incoming chunks against the stored ones of their id."""
    rows = table(s, d, "incoming_chunks").select(F.col("incoming_id").alias("a"), F.col("chunk_id").alias("b"), "content")
    new = encode.term_counts(rows, "a", "content").drop("dl")
    old = encode.term_counts(table(s, d, "chunks").select(F.col("chunk_id").alias("b"), "content").distinct(), "b", "content").drop("dl")
    cos = encode.sparse_cosine(new, old, rows.select("a", "b").distinct()).where("cosine > 0")
    return cos.select(F.col("a").alias("incoming_id"), F.col("b").alias("chunk_id"), F.round("cosine", 6).alias("sparse_cosine"), F.round(encode.hybrid_score(F.lit(None).cast("double"), F.col("cosine")), 6).alias("hybrid"))


@query
def hybrid_similarity(s: SparkSession, d: str) -> DataFrame:
    """Dense, sparse and hybrid similarity of each document to the next one, of those that have an embedding."""
    vectors = table(s, d, "embeddings").select("vec_id", "embedding").where("embedding is not null").dropDuplicates(["vec_id"])
    docs = _docs(s, d).join(vectors.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    ids = docs.select("doc_id").distinct()
    pairs = ids.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b")).join(ids.select(F.col("doc_id").alias("b")), "b", "left_semi")
    counts = encode.term_counts(docs, "doc_id", "text").drop("dl")
    sparse = encode.sparse_cosine(counts.withColumnRenamed("doc_id", "a"), counts.withColumnRenamed("doc_id", "b"), pairs)
    both = sparse.join(vectors.toDF("a", "va"), "a").join(vectors.toDF("b", "vb"), "b").withColumn("dense", encode.cosine(F.col("va"), F.col("vb")))
    return both.select("a", "b", F.round("dense", 5).alias("dense"), F.round("cosine", 5).alias("sparse"), F.round(encode.hybrid_score(F.col("dense"), F.col("cosine")), 5).alias("hybrid"))


@query
def encode_cache_miss(s: SparkSession, d: str) -> DataFrame:
    return encode.cache_misses(table(s, d, "chunks").select("chunk_id", "content_hash").distinct(), table(s, d, "encodings"))


@query
def encode_pending(s: SparkSession, d: str) -> DataFrame:
    return tables.delete_by(table(s, d, "chunks").select("chunk_id").distinct(), table(s, d, "encodings"), "chunk_id")


@query
def vector_dims(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "dense_vectors").groupBy(F.coalesce(F.size("dense_vector"), F.lit(0)).alias("dim")).agg(F.count("*").alias("vectors"))


# Vector store, search and retrieval


def _asked(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").where("vec_id % 20 = 0")


def _top(s: SparkSession, d: str, space: str, k: int = 5) -> DataFrame:
    return search.top_k(_asked(s, d), table(s, d, "embeddings"), "vec_id", "embedding", k, space)


@query
def topk_cosine(s: SparkSession, d: str) -> DataFrame:
    return _top(s, d, "cosine")


@query
def topk_l2(s: SparkSession, d: str) -> DataFrame:
    return _top(s, d, "l2")


@query
def topk_ip(s: SparkSession, d: str) -> DataFrame:
    return _top(s, d, "ip")


@query
def topk_filtered(s: SparkSession, d: str) -> DataFrame:
    """The 5 best among the vectors of label 3; the filter comes before the scores."""
    return search.top_k(_asked(s, d), table(s, d, "embeddings").where("label = 3"), "vec_id", "embedding")


@query
def retrieve_threshold(s: SparkSession, d: str) -> DataFrame:
    """Of the 10 best, those of score 0.6 or more, and of these 5."""
    return search.retrieve(_top(s, d, "cosine", 10), 5, 0.6)


@query
def retrieve_rerank(s: SparkSession, d: str) -> DataFrame:
    """The 10 best by cosine, those of the query's own label first."""
    hits = _top(s, d, "cosine", 10)
    labels = table(s, d, "embeddings").select("vec_id", "label")
    both = hits.join(labels, "vec_id").join(labels.toDF("query_id", "query_label"), "query_id")
    rescored = F.round(F.col("score") + F.when(F.col("label") == F.col("query_label"), 1.0).otherwise(0.0), 6)
    return search.retrieve(both, 5, None, rescored).select("query_id", "vec_id", "score", "rank")


def _title_terms(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("doc_id % 20 = 0 and title is not null").select(F.col("doc_id").alias("query_id"), F.explode(text.tokens(F.col("title"))).alias("term"))


def _term_search(s: SparkSession, d: str, k: int) -> DataFrame:
    return search.bm25_search(_title_terms(s, d), _docs(s, d), "doc_id", "text", encode.bm25_terms(spread(_docs(s, d)), "doc_id", "text"), k)


@query
def bm25_search(s: SparkSession, d: str) -> DataFrame:
    """The 5 best documents for the title of every document whose id is divisible by 20."""
    return _term_search(s, d, 5)


@query
def hybrid_search(s: SparkSession, d: str) -> DataFrame:
    """The 5 best of both searches for the documents whose id is divisible by 20: by their embeddings, and by their titles."""
    dense = _top(s, d, "cosine", 10).withColumnRenamed("vec_id", "doc_id")
    sparse = _term_search(s, d, 10)
    return search.hybrid_search(dense, sparse, "doc_id").select("query_id", "doc_id", F.round("score", 5).alias("score"))


@query
def retrieve_preview(s: SparkSession, d: str) -> DataFrame:
    # cut before the join, which then doesn't move whole texts
    previews = _docs(s, d).select("doc_id", search.preview(F.col("text")).alias("preview"))
    return _term_search(s, d, 1).join(previews, "doc_id").select("query_id", "doc_id", F.round("score", 4).alias("score"), "preview")


@query
def store_add_new(s: SparkSession, d: str) -> DataFrame:
    """Incoming chunks with ids that the store doesn't have, one row for each id."""
    return tables.delete_by(table(s, d, "incoming_chunks").select("chunk_id").distinct(), table(s, d, "encodings"), "chunk_id")


@query
def store_delete(s: SparkSession, d: str) -> DataFrame:
    """Encodings that outlived their chunk are deleted: those left."""
    return table(s, d, "encodings").select("chunk_id", "content_hash").join(table(s, d, "chunks").select("chunk_id").distinct(), "chunk_id", "left_semi")


@query
def store_stats(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "encodings").groupBy(F.col("metadata")["model"].alias("model")).agg(F.count("*").alias("rows"), F.countDistinct("chunk_id").alias("chunks"))


@query
def meta_flatten(s: SparkSession, d: str) -> DataFrame:
    """Chunk metadata as the store takes it: scalars, null ones dropped."""
    m = tables.flatten_metadata({"source": F.col("source_file"), "chunk_index": F.col("chunk_index").cast("string"), "lang": F.col("metadata")["lang"], "parser": F.col("metadata")["parser"]})
    return table(s, d, "chunks").select("chunk_id", F.size(m).alias("entries"), m["source"].alias("source"), m["lang"].alias("lang"), m["parser"].alias("parser"))


# Evaluation


def _detail(s: SparkSession, d: str) -> DataFrame:
    asked = _asked(s, d).select(F.col("vec_id").alias("query_id"), "label")
    hits = search.top_k(_asked(s, d), table(s, d, "embeddings"), "vec_id", "embedding", 6).where("vec_id <> query_id").select("query_id", F.col("vec_id").alias("item"))
    items = table(s, d, "embeddings").select(F.col("vec_id").alias("item"), "label")
    relevant = hits.join(asked, "query_id").join(items, ["item", "label"], "left_semi")
    others = asked.join(items.groupBy("label").agg((F.countDistinct("item") - 1).alias("n_relevant")), "label").select("query_id", "n_relevant")
    return evaluate.retrieval_detail(hits, relevant, asked, others)


@query
def eval_retrieval_detail(s: SparkSession, d: str) -> DataFrame:
    return _detail(s, d).select("query_id", "n_retrieved", "n_relevant", "hits", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query
def eval_retrieval(s: SparkSession, d: str) -> DataFrame:
    return evaluate.retrieval_metrics(_detail(s, d)).select(F.round("context_precision", 6).alias("context_precision"), F.round("context_recall", 6).alias("context_recall"))


@query
def eval_average(s: SparkSession, d: str) -> DataFrame:
    return evaluate.average_score(evaluate.retrieval_metrics(_detail(s, d))).select(F.round("average_score", 6).alias("average_score"))


# Incremental state and tasks


def _failed(s: SparkSession, d: str) -> DataFrame:
    failed = table(s, d, "cleaning_results").where("error is not null and filename is not null").select(F.col("filename").alias("file_path")).distinct()
    return failed.join(_state(s, d), "file_path", "left")


def _classified(s: SparkSession, d: str) -> DataFrame:
    return tables.classify_files(_current(s, d), _state(s, d), _failed(s, d))


@query
def inc_classify(s: SparkSession, d: str) -> DataFrame:
    return _classified(s, d).select("file_path", "reason")


@query
def inc_stats(s: SparkSession, d: str) -> DataFrame:
    return _classified(s, d).groupBy("reason").agg(F.count("*").alias("files"))


@query
def inc_upsert(s: SparkSession, d: str) -> DataFrame:
    changed = _classified(s, d).where("reason in ('new', 'modified')").select("file_path", "file_hash")
    return tables.upsert_by(_state(s, d), changed, "file_path")


@query
def inc_orphans(s: SparkSession, d: str) -> DataFrame:
    """Records of files that no chunk comes from any more."""
    return _state(s, d).join(table(s, d, "chunks").select(F.col("source_file").alias("file_path")).distinct(), "file_path", "left_anti")


def _files(s: SparkSession, d: str) -> DataFrame:
    sizes = table(s, d, "file_records").groupBy("file_path").agg(F.max(F.col("metadata")["size_bytes"].cast("bigint")).alias("size_bytes"))
    return _classified(s, d).join(sizes, "file_path").select("file_path", "size_bytes", "reason")


def _tasks(s: SparkSession, d: str) -> DataFrame:
    """A task table from what happened before: failed files, processed ones, and those begun with an empty list of chunks."""
    last = tables.latest(table(s, d, "file_records").where(F.col("processed_at") < CUTOFF).withColumn("n", F.coalesce(F.size("chunk_ids"), F.lit(-1))), "file_path", "processed_at", "n")
    failed = _failed(s, d).select("file_path", F.lit(True).alias("failed"))
    return last.join(failed, "file_path", "left").select("file_path", F.when(F.col("failed"), "error").when(F.col("n") < 0, "skipped").when(F.col("n") == 0, "processing").otherwise("completed").alias("status"))


@query
def task_size_filter(s: SparkSession, d: str) -> DataFrame:
    """Files of fewer than 6000 bytes; no file of these tables is below the usual least size."""
    return tables.size_filter(_files(s, d), 6000).select("file_path", "size_bytes")


@query
def task_plan(s: SparkSession, d: str) -> DataFrame:
    return tables.task_plan(_files(s, d), _tasks(s, d)).select("file_path", "reason", "next_status", "priority")


@query
def task_pending(s: SparkSession, d: str) -> DataFrame:
    return tables.task_plan(_files(s, d), _tasks(s, d)).where("next_status = 'pending'").select("file_path", "priority").orderBy("priority", "file_path")


@query
def task_status_counts(s: SparkSession, d: str) -> DataFrame:
    return tables.task_plan(_files(s, d), _tasks(s, d)).groupBy(F.col("next_status").alias("status")).agg(F.count("*").alias("files"))


def _recorded(s: SparkSession, d: str) -> DataFrame:
    """The task table once what cleaning did is on record."""
    tasks = _tasks(s, d).withColumn("error", F.lit(None).cast("string")).withColumn("retry_count", F.lit(0))
    done = table(s, d, "cleaning_results").where("filename is not null").select(F.col("filename").alias("file_path"), F.when(F.col("error").isNull(), "completed").otherwise("error").alias("status"), "error")
    return tables.record_results(tasks, done)


@query
def task_record(s: SparkSession, d: str) -> DataFrame:
    return _recorded(s, d)


@query
def task_reset(s: SparkSession, d: str) -> DataFrame:
    return tables.reset_errors(_recorded(s, d))


@query
def task_statistics(s: SparkSession, d: str) -> DataFrame:
    return tables.task_statistics(_recorded(s, d))


@query
def log_merge(s: SparkSession, d: str) -> DataFrame:
    logs = table(s, d, "cleaning_results").where("error is not null and filename is not null")
    old = logs.select(F.col("filename").alias("file_path"), F.col("error").alias("reason"), F.col("result_id"))
    new = logs.select(F.col("filename").alias("file_path"), F.col("error").alias("reason"), (F.col("result_id") + 1).alias("result_id"))
    return tables.merge_log(old, new, ["file_path", "reason"], "result_id")


@query
def log_module(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "cleaning_results").where("error is not null").groupBy("error", tables.module_of(F.col("error")).alias("module")).agg(F.count("*").alias("rows"))


@query
def build_stats(s: SparkSession, d: str) -> DataFrame:
    """One row of what a build did: files, cleaned texts, chunks, distinct contents, encodings and errors."""
    files = table(s, d, "file_records").agg(F.countDistinct("file_path").alias("total_files"))
    cleaned = table(s, d, "cleaning_results").agg(F.countDistinct("result_id").alias("cleaned"), F.countDistinct(F.when(F.col("error").isNotNull(), F.col("result_id"))).alias("errors"))
    chunks = table(s, d, "chunks").agg(F.countDistinct("chunk_id").alias("total_chunks"), F.countDistinct("content").alias("unique_chunks"))
    encoded = table(s, d, "encodings").agg(F.countDistinct("chunk_id").alias("encoded_chunks"))
    one = files.join(cleaned).join(chunks).join(encoded)  # of one row each
    return one.select("*", F.round((F.col("total_chunks") - F.col("unique_chunks")) / F.col("total_chunks"), 4).alias("dedup_rate"))
