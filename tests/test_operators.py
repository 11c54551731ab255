import math
import random
import re
import zipfile
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quire.operators import chunk, dedup, encode, evaluate, search, tables
from quire.plans.queries import QUERIES
from quire.sources import files, parse, sinks
from quire.streaming import incremental


def test_fixed_windows(spark):
    rows = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None), (4, "ab")], "id int, text string")
    got = [(r["id"], r["chunk_index"], r["content"]) for r in chunk.fixed_windows(rows, "text", 4, 1).orderBy("id", "chunk_index").collect()]
    assert got == [(1, 0, "abcd"), (1, 1, "defg"), (1, 2, "ghij"), (4, 0, "ab")]


@pytest.mark.parametrize("text", ["这是一段测试文本。" * 20, "a" * 350, "one two three. " * 40 + "\n\n" + "x" * 130, "", " \n "])
def test_recursive_chunks(text):
    got = chunk.chunk_text(text, 100, 20)
    assert all(0 < len(c) <= 100 and 0 <= a <= b for c, a, b in got)
    assert bool(got) == bool(text.strip())
    assert {c for c in text if not c.isspace()} == {c for t, _, _ in got for c in t if not c.isspace()}


def test_merge_short(spark):
    rows = spark.createDataFrame([(["ab", "cd", "x" * 25, "e"],), ([],)], "a array<string>")
    assert [r[0] for r in rows.select(chunk.merge_short(F.col("a"))).collect()] == [["ab\ncd\n" + "x" * 25, "e"], []]


def test_exact_dedup_keeps_the_first_and_nulls(spark):
    rows = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None), (5, "")], "id int, t string")
    assert {r["id"] for r in dedup.dedup_exact(rows, "t", ["id"]).where("kept").collect()} == {1, 2, 4, 5}


def test_simhash_keep_first_is_the_sequential_loop(spark):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(200)) for _ in range(12)]
    texts = [t if rnd.random() < 0.4 else t[: (k := rnd.randrange(200))] + "z" + t[k + 1 :] for t in base for _ in range(5)]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(999, None)], "id int, t string")
    got = {r["id"]: r["kept"] for r in dedup.dedup_simhash(rows, "t", "id", 6).collect()}
    kept: list[int] = []
    for i, t in enumerate(texts):
        f = dedup.Fingerprints().of([t])[0]
        near = any(bin((f ^ g) & (2**64 - 1)).count("1") <= 6 for g in kept)
        assert got[i] == (not near)
        if not near:
            kept.append(f)
    assert got[999]


def test_embedding_dedup(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, [0.0, 1.0]), (4, None)], "id bigint, v array<double>")
    assert {r["id"] for r in dedup.dedup_embedding(rows, "id", "v").where("kept").collect()} == {1, 3, 4}


@pytest.mark.parametrize("space", ["cosine", "l2", "ip"])
def test_top_k_is_brute_force(spark, space):
    rnd = random.Random(1)
    data = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, None)]
    rows = spark.createDataFrame(data, "vec_id bigint, v array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in search.top_k(rows.where("vec_id < 5"), rows, "vec_id", "v", 3, space).collect()}
    import numpy as np

    v = np.array([x for _, x in data[:60]])
    for q in range(5):
        s = search._scores(v[q : q + 1], v, space)[0].round(6)
        order = sorted(range(60), key=lambda i: (-s[i], i))[:3]
        assert [got[q, k + 1] for k in range(3)] == order


def test_hybrid_and_cosine(spark):
    row = spark.createDataFrame([([3.0, 4.0], [6.0, 8.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = row.select(encode.cosine(F.col("a"), F.col("b")), encode.cosine(F.col("a"), F.col("z")), encode.hybrid_score(F.lit(1.0), F.lit(None).cast("double"))).first()
    assert r[0] == pytest.approx(1) and r[1] == 0 and r[2] == pytest.approx(0.7)


def test_evaluation_of_empty_sets(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    got = spark.createDataFrame([(1, 5), (1, 5), (1, 6)], "query_id int, item int")
    want = spark.createDataFrame([(1, 5)], "query_id int, item int")
    r = {x["query_id"]: (x["precision"], x["recall"]) for x in evaluate.retrieval_detail(got, want, q).collect()}
    assert r == {1: (0.5, 1.0), 2: (0.0, 0.0)}
    assert evaluate.average_score(evaluate.retrieval_metrics(evaluate.retrieval_detail(got, want, q))).first()[0] == pytest.approx(0.375)


def test_classification_of_files(spark):
    shape = "file_path string, file_hash string"
    now = spark.createDataFrame([("n", "1"), ("s", "1"), ("m", "2"), ("e", "1"), ("f", "2"), ("h", None)], shape)
    state = spark.createDataFrame([("s", "1"), ("m", "1"), ("e", "1"), ("f", "1")], shape)
    errors = spark.createDataFrame([("e", "1"), ("f", "1")], shape)
    got = {r["file_path"]: r["reason"] for r in tables.classify_files(now, state, errors).collect()}
    assert got == {"n": "new", "s": "unchanged", "m": "modified", "e": "error_skipped", "f": "modified", "h": "hash_error"}
    assert {r["reason"] for r in tables.classify_files(now, state, errors, enabled=False).collect()} == {"full_update"}


def test_parsers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("中文".encode("gbk"))
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    (tmp_path / "c.HTML").write_text("<title>T</title><script>no</script><h1>H</h1><p>a  b</p>")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="w"><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:p><w:t>two</w:t></w:p></w:d>')
    got = {r["path"][-6:].lstrip("/"): r for r in parse.load(files.scan(spark, str(tmp_path))).collect()}
    assert got["/a.txt"[1:]]["content"] == "中文"
    assert got["b.csv"]["content"] == "x | y\n1 | 2"
    assert got["c.HTML"]["content"] == "T\nH\na\nb"
    assert "recogniser" in got["d.pdf"]["error"] and got["d.pdf"]["content"] == ""
    assert got["e.docx"]["content"] == "one\n\ntwo"
    assert files.scan(spark, str(tmp_path), [".html"]).count() == 1
    assert len(files.file_hashes(files.scan(spark, str(tmp_path))).first()["file_hash"]) == 32


def test_outputs(spark, tmp_path):
    out = sinks.Outputs(str(tmp_path), "production")
    rows = spark.range(3)
    assert out.save("chunks", rows) is None
    out.switch("chunks", True)
    assert spark.read.parquet(out.save("chunks", rows)).count() == 3
    with pytest.raises(ValueError):
        out.save("nothing", rows)


def test_stream_resumes_and_keeps_first(spark, tmp_path):
    src, dst, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "chunk_id string, content string").coalesce(1).write.parquet(src)
    incremental.run(spark, src, dst, state)
    spark.createDataFrame([("d", "y"), ("e", "z")], "chunk_id string, content string").coalesce(1).write.mode("append").parquet(src)
    incremental.run(spark, src, dst, state)
    assert {r["chunk_id"] for r in spark.read.parquet(dst).collect()} == {"a", "b", "e"}


def test_fingerprints_beside_nulls_keep_all_bits(spark):
    texts = ["a glossary of the estuary", None, "", "ab", "a glossary of the harvest"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    got = {r["id"]: r["fp"] for r in rows.select("id", dedup.simhash(F.col("t")).alias("fp")).collect()}
    assert got[1] is None and [got[i] for i in (0, 2, 3, 4)] == dedup.Fingerprints().of([t for t in texts if t is not None])


def test_word_ngrams(spark):
    row = spark.createDataFrame([("A bc_1 Été 中文 d",), ("x",), ("",), (None,)], "t string")
    got = [r[0] for r in row.select(encode.word_ngrams(F.col("t"), 3)).collect()]
    assert got[0] == ["a", "bc_1", "été", "中文", "d", "a bc_1", "bc_1 été", "été 中文", "中文 d", "a bc_1 été", "bc_1 été 中文", "été 中文 d"]
    assert got[1:] == [["x"], [], None]


def test_top_k_over_many_blocks(spark):
    rnd = random.Random(4)
    data = [(i, [float(rnd.randrange(3)) for _ in range(4)]) for i in range(900)] + [(900, None), (901, [0.0] * 4)]
    rows = spark.createDataFrame(data, "vec_id bigint, v array<double>")
    few = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in search.top_k(rows.where("vec_id < 40"), rows, "vec_id", "v", 7, "ip").collect()}
    many = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in search.top_k(rows.where("vec_id < 40"), rows, "vec_id", "v", 7, "ip", block=11).collect()}
    brute = {}
    for q, v in data[:40]:
        order = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in data if w)[:7]
        brute |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(order)}
    assert few == many == brute
    assert search.top_k(rows.limit(0), rows, "vec_id", "v").count() == search.top_k(rows, rows.limit(0), "vec_id", "v").count() == 0


def test_results_are_recorded_and_errors_reset(spark):
    tasks = spark.createDataFrame([("a", "pending", None, None), ("b", "error", "old", 2), ("c", "completed", None, 0)], "file_path string, status string, error string, retry_count int")
    results = spark.createDataFrame([("a", "completed", None), ("b", "error", "new"), ("b", "completed", None), ("x", "error", "no task")], "file_path string, status string, error string")
    got = {r["file_path"]: tuple(r)[1:] for r in tables.record_results(tasks, results).collect()}
    assert got == {"a": ("completed", None, 0), "b": ("error", "new", 3), "c": ("completed", None, 0)}
    again = tables.reset_errors(tables.record_results(tasks, results))
    assert {r["file_path"]: tuple(r)[1:] for r in again.collect()}["b"] == ("pending", None, 0)
    assert tables.task_statistics(again).first().asDict() == {"total": 3, "pending": 1, "processing": 0, "completed": 2, "error": 0, "skipped": 0, "filtered": 0, "is_completed": False}
    assert tables.task_statistics(again.limit(0)).first()["is_completed"]


def test_strategies(spark):
    assert not dedup.Strategy.of("test", {"use_embedding": True}).use_embedding and dedup.Strategy.of("production").use_embedding
    with pytest.raises(ValueError):
        dedup.Strategy.of("other")
    text = "the glossary of the estuary simplified the harvest at a rate of units per hour " * 3
    rows = spark.createDataFrame([(1, text, [1.0, 0.0]), (2, text, [1.0, 0.0]), (3, text + "!", [0.0, 1.0]), (4, "quite another thing about valves and turbines", [1.0, 0.01]), (5, None, None)], "id int, t string, v array<double>")
    kept, removed = dedup.deduplicate(rows, "t", "id", dedup.Strategy(use_embedding=True, duplicates="merge"), "v")
    assert {tuple(r) for r in removed.collect()} == {(2, "hash"), (3, "simhash"), (4, "embedding")}
    assert {r["id"]: r["t"] for r in kept.collect()} == {1: text + "\n" + text + "!", 5: None}


@pytest.mark.parametrize(("threshold", "blocks"), [(3, None), (3, 6), (2, 5), (0, 1), (6, 8)])
def test_near_fingerprints_are_brute_force(spark, threshold, blocks):
    rnd = random.Random(7)
    base = [rnd.getrandbits(64) for _ in range(20)]
    prints = base + [b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randrange(1, 8))) for b in base for _ in range(6)] + base[:2]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = spark.createDataFrame([(p,) for p in signed] + [(None,)], "fp bigint")
    got = {tuple(r) for r in dedup.near_fingerprints(rows, threshold, blocks).collect()}
    distinct = sorted(set(signed))
    assert got == {(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= threshold}


def test_bm25_search_is_brute_force(spark):
    rnd = random.Random(5)
    words = ["ab", "cd", "ef", "gh", "12", "345", "土", "质"] + [f"w{'xyz'[i % 3]}{'abcdefgh'[i // 3]}" for i in range(24)]
    texts = [(i, " ".join(rnd.choice(words[: 8 + i % 24]) for _ in range(rnd.randrange(1, 30)))) for i in range(300)]
    texts += [(i + 300, t) for i, t in texts[:40]]  # copies tie
    texts += [(7, texts[7][1]), (None, "ab 土"), (None, "ab 土"), (900, None), (901, ""), (902, "AB,cd12")]
    asked = [(q, t) for q in range(25) for t in rnd.choices([*words, "absent"], k=6)] + [(3, None)]
    docs, terms = spark.createDataFrame(texts, "id bigint, t string"), spark.createDataFrame(asked, "query_id bigint, term string")
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in search.bm25_search(terms, docs, "id", "t", encode.bm25_terms(docs, "id", "t", 30), 7, block=9).collect()}

    bags: dict = {}
    for i, t in texts:
        ts = re.findall("[a-z]+|[一-鿿]|[0-9]+", (t or "").lower())
        bags.setdefault(i, []).append(ts)
    df = Counter(x for rows in bags.values() for x in {x for ts in rows for x in ts})
    top = dict(sorted(df.items(), key=lambda x: (-x[1], x[0]))[:30])
    n, avgdl = len(texts), sum(len(ts) for rows in bags.values() for ts in rows) / len(texts)
    want = {}
    for q in range(25):
        scores = {}
        for i, rows in bags.items():
            for x in {t for p, t in asked if p == q and t in top}:
                if tf := sum(ts.count(x) for ts in rows):
                    idf = math.log((n - top[x] + 0.5) / (top[x] + 0.5) + 1)
                    scores[i] = scores.get(i, 0) + idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(next(ts for ts in rows if x in ts)) / avgdl))
        for rank, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0] is None, x[0]))[:7], 1):
            want[q, rank] = (i, pytest.approx(s, abs=1e-6))
    assert got == want
    assert search.bm25_search(terms.limit(0), docs, "id", "t", encode.bm25_terms(docs, "id", "t")).count() == 0
    assert search.bm25_search(terms, docs.limit(0), "id", "t", encode.bm25_terms(docs.limit(0), "id", "t")).count() == 0


def test_bm25_terms_is_bm25_fit(spark):
    docs = spark.createDataFrame([(1, "a b a 土"), (1, "a c"), (2, "B, c 12"), (2, None), (None, "c"), (None, "c d")], "id bigint, t string")
    _, vocabulary, avgdl = encode.bm25_fit(docs, "id", "t", 5)
    fit = encode.bm25_terms(docs, "id", "t", 5)
    assert sorted(fit.vocabulary.collect()) == sorted(vocabulary.collect())
    assert (fit.n_docs, fit.avgdl) == (6, avgdl)


def written(spark, folder) -> int:
    """Bytes of all shuffles so far and of the checkpoints below the folder."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size())) + sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())


@pytest.mark.parametrize("name", ["bm25_search", "hybrid_search", "retrieve_preview"])
def test_search_writes_less_than_the_texts(spark, tmp_path, name):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(500)]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(250)), " ".join(rnd.choice(words[:60]) for _ in range(6))) for i in range(800)]
    spark.createDataFrame(docs, "doc_id bigint, text string, title string").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(i, [rnd.gauss(0, 1) for _ in range(4)], i % 3) for i in range(60)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    shared = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    before = written(spark, shared)
    QUERIES[name](spark, str(tmp_path)).collect()
    assert written(spark, shared) - before < sum(len(t) for _, t, _ in docs)
