import os
import random

import pytest
from pyspark.sql import functions as F

from quire.llm import admission, grams, mixing, near_dup, packing, tokens
from quire.llm import queries as llm
from quire.session import cut

WORDS = [a + b for a in ("ka", "to", "mi", "re", "su", "vel", "nor", "pix") for b in ("ra", "den", "lo", "quin", "st", "wem", "ik")]


def texts(n=40, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        t = [rnd.choice(WORDS) for _ in range(40)]
        out.append(" ".join(t))
        for k in (2, 6, 12):
            u = list(t)
            for _ in range(k):
                u[rnd.randrange(40)] = rnd.choice(WORDS)
            out.append(" ".join(u))
    return out


def gram_set(t):
    t = " ".join(t.lower().split())
    return {t[i : i + 5] for i in range(len(t) - 4)}


def jaccard(a, b):
    x, y = gram_set(a), gram_set(b)
    return len(x & y) / len(x | y)


def test_similarity_counts_exactly():
    a, b = texts(1)[:2]
    (x, m), (y, n) = grams.gram_arrays([a, b])
    assert grams.similarity(x, y, m, n) == pytest.approx(jaccard(a, b))
    assert grams.overlaps(x, y).sum() == len(gram_set(a) & gram_set(b)) and grams.similarity(x, y, m, n, 0.999) == 0
    assert [len(g) for g, _ in grams.gram_arrays(["", "abcd", "abcde", a])] == [0, 0, 1, len(gram_set(a))]


def test_keys_and_bits_follow_the_least_similarity():
    assert (grams.prefix_of(0.7), grams.least_bits(0.7)) == (5, 93) and grams.prefix_of(0.5) < 5 < grams.prefix_of(0.9) and grams.least_bits(0.5) < 93
    with pytest.raises(ValueError):
        grams.prefix_of(0.4)


def test_smaller_similarities_are_found_as_well(spark):
    t = texts(25, 9)
    rows = spark.createDataFrame(list(enumerate(t)), "k bigint, c string")
    want = {(i, j) for i in range(len(t)) for j in range(i + 1, len(t)) if jaccard(t[i], t[j]) >= 0.5}
    got = {tuple(r) for r in near_dup.similar_rows(rows, "k", "c", 0.5).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and any(jaccard(t[i], t[j]) < 0.6 for i, j in got)


def test_a_hot_key_is_split(spark):
    # a quarter of the rows under one key: the join has to be one that AQE splits
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(6000).select(F.when(F.col("id") < 2000, -1).otherwise(F.col("id")).alias("key"), "id", F.lit(1).cast("long").alias("s1"), F.lit(1).cast("long").alias("s2"))
        pairs = near_dup.candidate_pairs(rows, 0.7)
        assert len(pairs.collect()) == 2000 * 1999 // 2
        assert "skew=true" in pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_copies_of_two_forms_meet_only_across(spark):
    a, b = texts(1)[0], texts(1)[0].upper()
    rows = spark.createDataFrame([(i, a) for i in range(50)] + [(50, b), (51, b)], "k bigint, c string")
    got = {tuple(r) for r in near_dup.similar_rows(rows, "k", "c").collect()}
    assert got == {(i, j) for i in range(50) for j in (50, 51)}


def test_similarity_of_a_batch_is_that_of_brute_force(spark):
    t = texts(4)
    rows = spark.createDataFrame([(i, j, t[i], t[j]) for i in range(8) for j in range(i)], "id_a bigint, id_b bigint, text_a string, text_b string")
    got = {(r["id_a"], r["id_b"]): r["similarity"] for r in grams.verified(rows, 0.6).collect()}
    want = {(i, j): jaccard(t[i], t[j]) for i in range(8) for j in range(i) if jaccard(t[i], t[j]) >= 0.6}
    assert got == pytest.approx(want)


def test_near_duplicates_are_those_of_brute_force(spark):
    t = texts()
    data = [(f"c{i:03}", x) for i, x in enumerate(t)] + [("d0", t[0]), ("d1", t[0].upper()), ("d2", None), ("d3", ""), ("d4", "short"), ("c000", t[0])]
    rows = spark.createDataFrame(data, "chunk_id string, content string")
    got = {(r["key_a"], r["key_b"]) for r in near_dup.similar_rows(rows, "chunk_id", "content").collect()}
    long = sorted({x for x in data if x[1] and len(x[1]) >= 80})
    want = {(a, b) for i, (a, x) in enumerate(long) for b, y in long[i + 1 :] if a != b and x != y and jaccard(x, y) >= 0.7}
    assert len(want) > 40 and got == want
    classes = {r["key"]: r for r in near_dup.near_dup_classes(rows, "chunk_id", "content").collect()}
    assert len(classes) == len({k for k, _ in data})
    assert all(classes[a]["class_id"] == classes[b]["class_id"] for a, b in want)
    assert classes["d2"]["class_id"] is None and near_dup.similar_rows(rows.limit(0), "chunk_id", "content").count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "id_a bigint, id_b bigint")
    got = {r["id"]: r["class_id"] for r in near_dup.components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100


def brute(history, incoming):
    accepted, seen, out = [gram_set(h) for h in history if len(h) >= 80], set(), {}
    for i, t in incoming:
        why = "known" if t in history else "copy" if t in seen else None
        seen.add(t)
        if not why and len(t) >= 80:
            s = gram_set(t)
            if any(len(s & a) / len(s | a) >= 0.7 for a in accepted):
                why = "similar"
            else:
                accepted.append(s)
        if why:
            out[i] = why
    return out


def test_admission_at_once_and_batch_by_batch(spark):
    t = texts(30, 5)
    history, new = t[:40], [*t[30:], t[5], t[60], "tiny", "tiny", t[100].upper()]
    random.Random(2).shuffle(new)
    want = brute(history, list(enumerate(new)))
    lookup = near_dup.texts_of(spark.createDataFrame([(str(i), h) for i, h in enumerate(history)], "k string, c string"), "k", "c").select("id", "text")
    batch = spark.createDataFrame([(i, i // 40, c) for i, c in enumerate(new)], "id bigint, b int, c string")

    def fresh():
        index = admission.HistoryIndex(spark)
        import hashlib

        index.append_hashes(spark.createDataFrame([(hashlib.md5(h.encode()).hexdigest().upper(),) for h in history], "hash string"))
        index.append(lookup, len(history))
        return index

    at_once = {r["key"]: r["reason"] for r in admission.admit(fresh(), batch, "id", "c", ["b", "id"]).collect()}
    assert at_once == want
    index, got = fresh(), {}
    for b in (0, 1, 2):
        part = batch.where(f"b = {b}")
        if part.isEmpty():
            continue
        out = {r["key"]: r["reason"] for r in admission.admit(index, part, "id", "c", ["b", "id"]).collect()}
        got |= out
    assert set(got) == set(want)
    index.drop()
    assert not os.path.exists(index.path)


def test_a_probe_reads_as_much_however_long_the_history_is(spark):
    """Keys read for a batch of one text, of a history and of one of ten times its size."""
    read = []
    for n in (20, 200):
        t = texts(n, 11)
        rows = near_dup.texts_of(spark.createDataFrame([(str(i), h) for i, h in enumerate(t)], "k string, c string"), "k", "c").select("id", "text")
        index = admission.HistoryIndex(spark, part_rows=32)
        index.append(rows, len(t))
        index.append_hashes(rows.select(F.md5("text").alias("hash")))
        asked = cut(grams.keyed(rows.orderBy("id").limit(1), index.least))
        keys = index._probe("keys", "key bigint, id bigint, s1 bigint, s2 bigint", "key", asked.select(F.col("key").alias("value"))).count()
        assert index.known(rows.select(F.md5("text").alias("hash")).limit(2)).count() == 2
        assert keys <= asked.count() * 32 * 1.5
        assert index.similar(rows.orderBy("id").limit(1)).count() >= 1
        read.append(keys / asked.count())
        index.drop()
    assert read[1] < 1.5 * read[0]


def test_what_a_lost_append_leaves_is_not_read(spark):
    index = admission.HistoryIndex(spark)
    rows = near_dup.texts_of(spark.createDataFrame([("a", texts(1)[0])], "k string, c string"), "k", "c").select("id", "text")
    index._write("texts", rows, "id", 4)
    assert index.texts(rows.select("id")).count() == 0
    index.append(rows, 1)
    assert index.texts(rows.select("id")).count() == 1
    index.drop()


def test_contents_without_comparable_text_are_not_alike(spark):
    rows = [(1, "one short"), (2, "another"), (3, None), (4, None), (5, ""), (6, "one short"), (7, "")]
    batch = spark.createDataFrame(rows, "id bigint, c string")
    got = {r["key"]: r["reason"] for r in admission.admit(admission.HistoryIndex(spark), batch, "id", "c", ["id"]).collect()}
    assert got == {6: "copy", 7: "copy"}


def test_packing_is_whole_and_tight(spark):
    rnd = random.Random(3)
    sizes = [(i, rnd.randrange(1, 700)) for i in range(3000)] + [(3000, 5000), (3001, 0), (3002, None), (5, 9)]
    rows = spark.createDataFrame(sizes, "item bigint, n_tokens bigint")
    kinds = {"a": 512, "b": 2048}
    packed = packing.pack(rows, kinds).cache()
    for kind, cap in kinds.items():
        got = packed.where(f"container_kind = '{kind}'")
        assert got.groupBy("container").sum("n_tokens").agg({"sum(n_tokens)": "max"}).first()[0] <= cap
        assert got.agg({"n_tokens": "sum"}).first()[0] == sum(n or 0 for _, n in sizes)
        whole = got.where("item < 3000 and item <> 5").groupBy("item").count().where("count > 1").join(rows.where(f"n_tokens > {cap}"), "item", "left_semi")
        assert got.where("item < 3000 and item <> 5").groupBy("item").count().where("count > 1").count() == whole.count()
    fill = {r["container_kind"]: r["fill_rate"] for r in packing.fill_report(packed, kinds).collect()}
    assert fill["b"] > 0.97
    assert packing.pack(rows.limit(0), kinds).count() == 0


def test_leftovers_of_many_tasks_are_merged(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", 20)
    monkeypatch.setattr(packing, "MERGE", 4)
    rows = spark.createDataFrame([(i, 1 + i * 37 % 90) for i in range(600)], "item bigint, n_tokens bigint")
    fill = packing.fill_report(packing.pack(rows, {"k": 100}), {"k": 100}).first()
    assert fill["tokens"] == sum(1 + i * 37 % 90 for i in range(600)) and fill["fill_rate"] > 0.85


def test_mixing_reaches_the_shares_within_the_caps(spark):
    rnd = random.Random(6)
    data = [(i, ("big", "mid", "small")[0 if i < 4000 else 1 if i < 5000 else 2], rnd.randrange(5, 900)) for i in range(5200)] + [(9, None, 5), (10, "other", 5), (11, "big", 0)]
    docs = spark.createDataFrame(data, "item bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 4), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    copies, report = mixing.mix(docs, targets)
    got = {r["source"]: r for r in report.collect()}
    assert got["gone"]["tokens"] == 0
    for s in ("big", "mid", "small"):
        assert got[s]["reached_share"] == pytest.approx(got[s]["target_share"] / 0.9, abs=0.003)
        assert got[s]["most_copies"] <= got[s]["max_repeats"]
    assert mixing.mix(docs.limit(0), targets)[0].count() == 0


def test_tokens_of_special_strings_and_nulls():
    n = tokens.counts(["<|endoftext|>", None, "", "hello world"])
    assert n[0] > 1 and n[1] == n[2] == 0
    ids = tokens.encoder().encode_ordinary("hello world")
    assert n[3] == len(ids) and tokens.encoder().decode(ids) == "hello world"


def test_queries_have_the_columns_asked_for(spark):
    from conftest import DATA

    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    want = {"p1_found": "vec_id_a vec_id_b", "p2_found": "item_table item_key", "p3_found": "result_id_a result_id_b", "p4_found": "chunk_id_a chunk_id_b", "p5_found": "record_table record_id line_no defect", "p6_found": "incoming_id", "p7_found": "result_id field_name", "p10_found": "doc_id"}
    for name, columns in want.items():
        df = llm.QUERIES[name](spark, DATA)
        assert df.columns == columns.split()
        assert df.count() == df.distinct().count()
