"""Near-duplicate texts by vertical partitioning of the n-gram order, and their groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import grams
from quire.session import cut, spread

SLOTS = 1 << 18


def texts_of(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, id, raw, text) of the rows long enough to compare; id is a hash of the normal form, raw of the text as stored.

    Null, empty and short contents give no row.
    """
    text = grams.normal(F.col(content))
    return (
        rows.where(F.length(content) >= grams.MIN_LENGTH)
        .select(F.col(key).alias("key"), F.xxhash64(content).alias("raw"), text.alias("text"))
        .withColumn("id", F.xxhash64("text"))
    )


def involved_texts(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """One (id, text) for each id of `ids`.

    The ids are first reduced to at most SLOTS slots, which are broadcast (2 MB at most) to drop most other
    texts in the scan; the rest meet the ids in an ordinary join.
    """
    slot = lambda c: F.pmod(c, F.lit(SLOTS)).cast("int")
    slots = ids.select(slot(F.col("id")).alias("slot")).distinct()
    near = texts.select("id", "text").withColumn("slot", slot(F.col("id"))).join(F.broadcast(slots), "slot", "left_semi")
    return near.join(ids, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))


def candidate_pairs(keyed: DataFrame, least: float, sketch: bool = True) -> DataFrame:
    """Distinct (id_a, id_b), a < b, that share a segment key and whose sketches leave the similarity possible.

    keyed has one row for each key of an id. Both sides of the join are one exchange, which lies right below the sort,
    so that AQE splits a hot key over several tasks.
    """
    a, b = keyed.alias("a"), keyed.alias("b")
    return (
        a.join(b.hint("merge"), (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & grams.alike("a", "b", least, sketch))
        .select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
        .distinct()
    )


def similar_texts(rows: DataFrame, key: str, content: str, least: float = 0.70, sketch: bool = True) -> DataFrame:
    """Pairs (id_a, id_b, similarity) of different normal texts with similarity of at least `least`, which may be from 0.5.

    Fragments give candidates, the sketch drops most false ones before anything but 32 bytes a row is
    shuffled, and the overlaps of the rest are counted by fragment and summed. sketch=False leaves the sketch out: then
    only pairs without a common key are lost. The result is cut from its lineage.
    """
    texts = spread(texts_of(rows, key, content))
    # copies are dropped first, with a combine before the shuffle, so that a hot text costs a row a task
    one = texts.groupBy("id").agg(F.min("text").alias("text"))
    pairs = cut(candidate_pairs(grams.keyed(one, least), least, sketch))
    ids = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()
    found = cut(involved_texts(texts, ids))
    a = found.toDF("id_a", "text_a")
    b = found.toDF("id_b", "text_b")
    return cut(grams.verified(pairs.join(a, "id_a").join(b, "id_b"), least))


def members_of(rows: DataFrame, key: str, content: str) -> DataFrame:
    """Distinct (key, id, raw); the text itself is dropped before the shuffle."""
    return texts_of(rows, key, content).select("key", "id", "raw").distinct()


def similar_rows(rows: DataFrame, key: str, content: str, least: float = 0.70) -> DataFrame:
    """Pairs (key_a, key_b), a < b, of rows whose contents differ as stored and are similar.

    Texts are first paired as stored, one row for each; only then do the keys of both come in. So rows of
    equal content never meet each other, however many there are.
    """
    pairs = similar_texts(rows, key, content, least)
    members = cut(members_of(rows, key, content))
    stored = members.select("id", "raw").distinct()
    mixed = stored.groupBy("id").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("id")
    forms = stored.join(mixed, "id", "left_semi")
    one_look = forms.toDF("id_a", "raw_a").join(forms.toDF("id_b", "raw_b"), F.expr("id_a = id_b and raw_a < raw_b"))
    edges = pairs.join(stored.toDF("id_a", "raw_a"), "id_a").join(stored.toDF("id_b", "raw_b"), "id_b").select("id_a", "raw_a", "id_b", "raw_b").unionByName(one_look)
    near = edges.join(members.toDF("key_x", "id_a", "raw_a"), ["id_a", "raw_a"]).join(members.toDF("key_y", "id_b", "raw_b"), ["id_b", "raw_b"])
    return (
        near.where("key_x <> key_y")
        .select(F.least("key_x", "key_y").alias("key_a"), F.greatest("key_x", "key_y").alias("key_b"))
        .distinct()
    )


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(id, class_id) of every id in edges(id_a, id_b): the least id reachable from it.

    Large-star and small-star steps alternate until the edges no longer change; each state is written to the
    shared folder. The number of rounds is logarithmic in the length of the longest path.
    """
    both = lambda e: e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    now = cut(edges.select(F.least("id_a", "id_b").alias("v"), F.greatest("id_a", "id_b").alias("u")).where("u <> v").distinct())
    mark = None
    for _ in range(rounds):
        around = both(now)
        low = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = around.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = cut(small.select("v", "u"))
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("u").agg(F.min("v").alias("class_id")).toDF("id", "class_id").unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("class_id")).distinct())


def near_dup_classes(rows: DataFrame, key: str, content: str, least: float = 0.70) -> DataFrame:
    """One row per distinct key with a content: (key, class_id, n_links).

    class_id is the least id of the group of texts connected by similarity; n_links counts the other normal
    texts similar to this one. Contents too short to compare, empty or null are their own class: class_id
    is then the hash of the content, or null for a null content.
    """
    pairs = similar_texts(rows, key, content, least)
    links = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    classes = components(pairs)
    text = grams.normal(F.col(content))
    ids = rows.select(F.col(key).alias("key"), F.xxhash64(text).alias("id"), F.col(content).isNull().alias("none")).distinct()
    return (
        ids.join(classes, "id", "left").join(links, "id", "left")
        .select("key", F.when(~F.col("none"), F.coalesce("class_id", "id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
