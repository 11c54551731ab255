import json

import pytest
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import chunk, dedup, evaluate
from quire.operators.store import Collection
from quire.plans import office
from quire.sources import parse, sinks

ELEMENTS = "file_path string, element_no bigint, page_num int, text string"


@pytest.mark.parametrize("block", [2, 3, 10_000])
def test_pages_of_elements(spark, block):
    rows = [("f", 0, None, "a"), ("f", 1, None, " "), ("f", 2, 2, "b"), ("f", 3, None, "c"), ("f", 4, 3, "d"), ("f", 5, 2, "e"), ("f", 6, None, "f"), ("g", 7, 1, "x"), ("g", 8, 1, None), ("h", 1, 4, "")]
    got = {tuple(r) for r in parse.pages_of_elements(spark.createDataFrame(rows, ELEMENTS), block).collect()}
    assert got == {("f", 0, 1, "a"), ("f", 1, 2, "b\nc"), ("f", 2, 3, "d"), ("f", 3, 2, "e\nf"), ("g", 0, 1, "x")}
    assert parse.pages_of_elements(spark.createDataFrame([], ELEMENTS)).count() == 0


def test_parsers_of_archives():
    got = parse.parse_xlsx(office.xlsx("t & u", ["x < y", ""]))
    assert got.content == "=== Sheet: head ===\nt & u\n=== Sheet: body ===\nx < y" and json.loads(got.metadata["sheet_names"]) == ["head", "body"]
    slides = parse.parse_pptx(office.pptx("t", ["one", " ", "two"]))
    assert slides.pages == [(1, "one"), (3, "two")] and slides.metadata == {"slide_count": "2", "author": "t", "title": "t"}
    assert parse.parse_docx(office.docx("t", ["a", "", "b"])).content == "a\n\nb"
    assert parse.parse_csv("城,1\n\n".encode("gbk")).metadata == {"encoding": "gbk", "row_count": "1"}


def test_a_registered_parser_may_give_text_alone(spark, monkeypatch):
    monkeypatch.setattr(parse, "LOADERS", dict(parse.LOADERS))
    monkeypatch.setattr(parse, "PARSERS", dict(parse.PARSERS))
    parse.register(".doc", "old_word", lambda raw: raw.decode().upper())
    files = spark.createDataFrame([("a.doc", bytearray(b"x")), ("b.none", bytearray(b"")), ("c.docx", bytearray(b"no archive")), ("d.doc", None)], "path string, content binary")
    got = {r["path"]: (r["loader"], r["content"], r["error"] is None) for r in parse.load(files).collect()}
    assert got == {"a.doc": ("old_word", "X", True), "b.none": ("none", "", False), "c.docx": ("word", "", False), "d.doc": ("old_word", "", True)}


def test_recognise_keeps_failed_pages(spark):
    def load():
        def read(image):
            if not image:
                raise ValueError("blank")
            return image.decode()

        return read

    images = spark.createDataFrame([("f", 1, bytearray(b"one")), ("f", 2, None)], "path string, page_num int, image binary")
    assert [tuple(r) for r in parse.recognise(images, load).orderBy("page_num").collect()] == [("f", 1, "one", None), ("f", 2, "", "ValueError: blank")]


def test_clean_with_report(spark):
    rows = spark.createDataFrame([(1, "a\x00  b\r\n\r\n\r\nlong enough a text", "f"), (2, None, None), (3, "", "g")], "id int, t string, n string")
    got = {r["id"]: r["r"] for r in rows.select("id", text.clean_with_report(F.col("t"), F.col("n"), min_length=5).alias("r")).collect()}
    assert got[1]["cleaned_text"] == "a b\n\nlong enough a text" and got[1]["quality_report"]["passed"] and got[1]["error"] is None
    assert not got[2]["success"] and got[2]["error"] == "no text" and got[2]["quality_report"] is None and got[2]["filename"] == ""
    assert got[3]["success"] and got[3]["cleaned_text"] == "" and not got[3]["quality_report"]["passed"]


def test_chunks_carry_metadata_and_merge_short_ones(spark):
    rows = spark.createDataFrame([(1, "ab.\n\n" + "word " * 30, "en", {"k": "v"}), (2, None, None, None)], "id int, t string, lang string, m map<string,string>")
    got = chunk.recursive_chunks(rows, "id", "t", 60, 10, 20, keep=("lang", "m"), merge=True).collect()
    assert all(r["lang"] == "en" and r["m"] == {"k": "v"} for r in got) and got[0]["content"].startswith("ab.\nword") and [r["chunk_index"] for r in got] == list(range(len(got)))
    assert chunk.merge_pieces([("a", 0, 1), ("b", 1, 2), ("long enough", 2, 13), ("c", 13, 14)], 4) == [("a\nb\nlong enough", 0, 13), ("c", 13, 14)]


def test_judged_metrics_are_never_made_up(spark):
    def load():
        def judge(metric, sample):
            if sample["answer"] is None:
                raise ValueError("no answer")
            return None if metric == "b" else len(sample["contexts"]) / 2

        return judge

    rows = spark.createDataFrame([(1, "q", ["x"], "a", None), (2, "q", ["x", "y"], "a", None), (3, "q", [], None, None)], "id int, question string, contexts array<string>, answer string, ground_truth string")
    scores = evaluate.judged(rows, "id", ["a", "b"], load)
    got = {r["id"]: (r["a"], r["b"], r["error"]) for r in scores.collect()}
    assert got == {1: (0.5, None, None), 2: (1.0, None, None), 3: (None, None, "a: no answer; b: no answer")}
    assert evaluate.judged_metrics(scores, ["a", "b"]).first().asDict() == {"a": 0.75, "b": None}


def test_collections(spark, tmp_path):
    c = Collection(spark, str(tmp_path), "docs", "l2", {"M": 16})
    rows = spark.createDataFrame([("a", [1.0, 0.0], "x", {"lang": "en"}), ("b", [0.0, 1.0], "y", None), ("b", [0.0, 1.0], "y", None), ("c", [1.0], "z", None), ("d", None, "w", None), (None, [1.0, 1.0], "n", None)], "id string, vector array<float>, content string, metadata map<string,string>")
    assert c.add(rows) == 2 and c.add(rows) == 0
    again = Collection(spark, str(tmp_path), "docs", "cosine", {"M": 1})
    assert again.stats() == {"name": "docs", "space": "l2", "properties": {"M": 16}, "count": 2}
    asked = spark.createDataFrame([(1, [1.0, 0.1])], "query_id bigint, vector array<float>")
    assert [r["id"] for r in again.query(asked, 2).orderBy("rank").collect()] == ["a", "b"]
    assert [r["id"] for r in again.query(asked, 2, "metadata['lang'] = 'en'").collect()] == ["a"]
    again.delete(spark.createDataFrame([("a",), ("zz",)], "id string"))
    assert again.count() == 1 and Collection(spark, str(tmp_path), "docs").count() == 1
    with pytest.raises(ValueError):
        Collection(spark, str(tmp_path), "other", "manhattan")


def test_reports(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, t string")
    removed = dedup.deduplicate(docs, "t", "id", dedup.Strategy(use_simhash=False))[1]
    assert sinks.dedup_report(removed, docs, "now").first().asDict() == {"timestamp": "now", "original_count": 3, "kept_count": 2, "removed_count": 1, "by_step": '{"hash":1}', "dedup_rate": 0.3333}
    assert sinks.dedup_report(removed.limit(0), docs.limit(0), "now").first()["dedup_rate"] == 0
    lines = sinks.chunk_lines(spark.createDataFrame([("f", 0, "x")], "source_file string, chunk_index int, content string")).first()
    assert json.loads(lines["value"]) == {"source_file": "f", "chunk_index": 0, "content": "x"}
    assert spark.read.json(sinks.failed_report(docs, str(tmp_path / "failed"))).count() == 3
