from quire.plans.pipeline import Config, Corpus


def paragraph(word, n=30):
    return " ".join(f"{word} {word[::-1]} {i} number {i * 7 % 13} of the {word}." for i in range(n))


def test_build_update_resume_and_retrieve(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for name, word in (("a.txt", "harbour"), ("b.txt", "glossary"), ("c.txt", "turbine"), ("copy.txt", "turbine")):
        (src / name).write_text(paragraph(word))
    (src / "bad.pdf").write_bytes(b"%PDF" + b"x" * 200)
    (src / "small.txt").write_text("tiny")
    corpus = Corpus(spark, out, Config(min_file_size=100, threshold=0.0))
    first = corpus.build(str(src))
    assert first["files"] == 5 and first["errors"] == 1 and first["vectors"] == first["chunks"] < first["chunks_all"]
    hit = corpus.retrieve(spark.createDataFrame([(1, "glossary yrassolg number of the glossary")], "query_id bigint, query string"), 1).first()
    assert hit["source_file"].endswith("b.txt") and hit["rank"] == 1
    assert corpus.build(str(src)) == first
    added = {r["run"]: r["count"] for r in corpus._read("chunk_log", "run int").groupBy("run").count().collect()}
    assert set(added) == {1}  # the second run wrote no chunk again

    (src / "a.txt").write_text(paragraph("lantern"))
    (src / "b.txt").unlink()
    corpus._load(str(src), 3)
    corpus._note(3, "chunks")  # as if the build had broken off here
    assert corpus.last_complete() == 2
    corpus.build(str(src))
    contents = [r["content"] for r in corpus.table("chunks").collect()]
    assert any("lantern" in c for c in contents) and not any("glossary" in c or "harbour" in c for c in contents)
    assert corpus._read("chunk_log", "source_file string, run int").where("run = 3").select("source_file").distinct().count() == 1
    assert corpus.table("vectors").count() == corpus.table("chunks").count()
    assert corpus.table("vectors").join(corpus.table("chunks"), ["chunk_id", "content_hash"], "left_anti").count() == 0
