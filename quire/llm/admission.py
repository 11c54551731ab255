"""Checking new batches against all history through a persisted index of minwise band keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import grams, near_dup
from quire.session import cut, shared_dir, spread

# Rows of a part of the index, about: what one probe of a key, a text or a hash reads at most.
PART_ROWS = 1 << 18
# Keys that one text counts as, as it takes as much room.
TEXT_ROWS = 16
WORD_SLOTS = 1 << 19


class HistoryIndex:
    """Band keys with signatures, texts and content hashes of everything accepted, in a folder of Parquet files.

    keys: (key, id, s1, s2), texts: (id, text), hashes: content md5 in lower case. Each append is a run of its own,
    cut into parts by a hash of the key, id or md5, of about `part_rows` rows whatever its size. So a batch reads the parts
    its own keys, candidates and hashes fall in: at most one for each of them in a run, of a size that doesn't
    grow with the history. Nothing written is written again; a run counts from the line in `runs` that ends it, so
    what a lost append left behind is never read. A key that very many texts share gets several files in its part.
    An index keeps the least similarity it was made for.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, least: float = 0.70, part_rows: int = PART_ROWS) -> None:
        self.spark, self.least, self.part_rows = spark, least, part_rows
        self.path = path or f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:  # a folder that nothing was appended to yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def runs(self, name: str) -> dict[int, list[str]]:
        """Finished runs of a table by their number of parts."""
        out: dict[int, list[str]] = {}
        for r in self._read("runs", "name string, run string, parts int").where(F.col("name") == name).collect():
            out.setdefault(r["parts"], []).append(r["run"])
        return out

    def _write(self, name: str, rows: DataFrame, by: str, parts: int, rebalance: bool = True) -> str:
        """Write rows as a run, each part by as few tasks as its size allows. The run doesn't count yet."""
        run = uuid.uuid4().hex
        placed = rows.withColumn("run", F.lit(run)).withColumn("part", part_of(F.col(by), parts))
        (placed.hint("rebalance", "part") if rebalance else placed).write.mode("append").option("compression", "zstd").partitionBy("run", "part").parquet(f"{self.path}/{name}")
        return run

    def _finish(self, runs: Iterable[tuple[str, str, int]]) -> None:
        lines = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(r).alias("run"), F.lit(p).alias("parts")) for n, r, p in runs)))
        self.spark.range(0, 1, 1, 1).select(lines.alias("x")).select("x.*").write.mode("append").parquet(f"{self.path}/runs")

    def _probe(self, name: str, schema: str, by: str, asked: DataFrame) -> DataFrame:
        """The rows of the parts that the values asked(value) fall in; their numbers are all that reaches the driver."""
        wanted = F.lit(False)
        for parts, runs in self.runs(name).items():
            hit = [r[0] for r in asked.select(part_of(F.col("value"), parts)).distinct().collect()]
            wanted = wanted | (F.col("run").isin(runs) & F.col("part").isin(hit or [-1]))
        return self._read(name, f"{schema}, run string, part int").where(wanted).drop("run", "part")

    def append_hashes(self, hashes: DataFrame) -> None:
        """Hashes of contents that count as seen; null ones are left out."""
        rows = cut(hashes.select(F.lower("hash").alias("hash")).where("hash is not null").distinct())
        parts = 1 + rows.count() // self.part_rows
        self._finish([("hashes", self._write("hashes", rows, "hash", parts), parts)])

    def append(self, texts: DataFrame, about: int) -> None:
        """Accept texts(id, text), of which there are about so many; copies are stored once."""
        # The shuffle that brings copies together cuts texts as their parts are cut, if these divide its partitions: no second one is needed.
        cuts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        parts = max(n for n in range(1, cuts + 1) if cuts % n == 0 and n <= 1 + TEXT_ROWS * about // self.part_rows)
        texts_run = self._write("texts", texts.groupBy("id").agg(F.min("text").alias("text")), "id", parts, rebalance=False)
        stored = self._read("texts", "id bigint, text string, run string, part int").where(F.col("run") == texts_run).select("id", "text")
        key_parts = 1 + stored.count() * grams.FRAGMENTS // self.part_rows
        keys_run = self._write("keys", grams.keyed(stored, self.least), "key", key_parts)
        self._finish([("texts", texts_run, parts), ("keys", keys_run, key_parts)])

    def known(self, hashes: DataFrame) -> DataFrame:
        """The hashes(hash) that were seen before, once each; most of those stored are dropped before they are shuffled."""
        slot = F.pmod(F.xxhash64("hash"), F.lit(near_dup.SLOTS)).cast("int").alias("slot")
        stored = self._probe("hashes", "hash string", "hash", hashes.select(F.col("hash").alias("value")))
        near = stored.withColumn("slot", slot).join(F.broadcast(hashes.select(slot).distinct()), "slot", "left_semi")
        return hashes.select("hash").distinct().join(near.select("hash"), "hash", "left_semi")

    def texts(self, ids: DataFrame) -> DataFrame:
        """(id, text) of the ids(id), from the parts they fall in."""
        return near_dup.involved_texts(self._probe("texts", "id bigint, text string", "id", ids.select(F.col("id").alias("value"))), ids)

    def _met(self, asked: DataFrame) -> DataFrame:
        """Stored keys that may be among the batch's, by a bitmap of 2**25 bits of the batch's keys.

        The bitmap is a table of at most WORD_SLOTS words of 64 bits, 8 MB whatever the batch, and is
        broadcast; so nearly all stored keys that no row of the batch has are dropped before any shuffle.
        """
        slot = F.pmod("key", F.lit(WORD_SLOTS * 64))
        bits = asked.select((slot / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(key, {WORD_SLOTS * 64}) & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
        stored = self._probe("keys", "key bigint, id bigint, s1 bigint, s2 bigint", "key", asked.select(F.col("key").alias("value"))).withColumn("word", (slot / 64).cast("int"))
        return stored.join(F.broadcast(bits), "word").where(F.expr(f"(shiftright(bits, cast(pmod(key, {WORD_SLOTS * 64}) & 63 as int)) & 1) = 1")).drop("word", "bits")

    def similar(self, batch: DataFrame) -> DataFrame:
        """(id_a of the batch, id_b accepted before, similarity) for batch(id, text)."""
        asked = cut(grams.keyed(batch, self.least))
        a, b = asked.alias("a"), self._met(asked).alias("b")
        met = a.join(b, (F.col("a.key") == F.col("b.key")) & grams.alike("a", "b", self.least)).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()
        pairs = cut(met)
        left = near_dup.involved_texts(batch, pairs.select(F.col("id_a").alias("id")).distinct()).toDF("id_a", "text_a")
        right = self.texts(pairs.select(F.col("id_b").alias("id")).distinct()).toDF("id_b", "text_b")
        return grams.verified(pairs.join(left, "id_a").join(right, "id_b"), self.least)

    def drop(self) -> None:
        """Remove the index's folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def part_of(value: Column, parts: int) -> Column:
    """The part that a key, id or hash belongs to: by the hash that shuffles go by."""
    return F.pmod(F.hash(value), F.lit(parts)).cast("int").alias("part")


def keep_first(nodes: DataFrame, edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(id) of the nodes to refuse, taking nodes in the order of `place`: one with an earlier kept neighbour.

    nodes: (id, place), edges: (id_a, id_b) without direction. Each round keeps the nodes all of whose
    earlier neighbours are refused and refuses those with an earlier kept one; a state is written to the
    shared folder. Nodes without edges are never looked at again.
    """
    a, b = nodes.toDF("id_a", "place_a"), nodes.toDF("id_b", "place_b")
    ordered = edges.join(a, "id_a").join(b, "id_b").select(F.when(F.col("place_a") < F.col("place_b"), F.col("id_a")).otherwise(F.col("id_b")).alias("early"), F.when(F.col("place_a") < F.col("place_b"), F.col("id_b")).otherwise(F.col("id_a")).alias("late"))
    open_ = cut(ordered.where("early <> late").distinct())
    refused = open_.sparkSession.createDataFrame([], "id bigint")
    for _ in range(rounds):
        if open_.isEmpty():
            return refused
        heads = open_.select(F.col("early").alias("id")).distinct().join(open_.select(F.col("late").alias("id")), "id", "left_anti")
        out = cut(open_.join(heads, open_["early"] == heads["id"], "left_semi").select(F.col("late").alias("id")).distinct())
        refused = refused.unionByName(out)
        left = open_.join(out, open_["early"] == out["id"], "left_anti")
        left = left.join(out, left["late"] == out["id"], "left_anti")
        open_ = cut(left.join(heads, left["early"] == heads["id"], "left_anti"))
    raise RuntimeError("the order did not settle")


def admit(index: HistoryIndex, batch: DataFrame, key: str, content: str, order: list[str]) -> DataFrame:
    """(key, reason) of the rows of a batch to refuse; the rest is appended to the index.

    reason is 'known' (content hash in the index), 'copy' (equal content earlier in the batch) or 'similar' (to an
    accepted text, or to an earlier row of the batch that isn't refused), by the index's least similarity. Rows are taken
    in the order of the columns `order`, so several batches may come in one call. Null content is neither copy nor
    similar and is accepted; contents below 80 code points are only compared exactly. Rows repeated with equal
    order columns are copies of each other and refused but for one.
    """
    rows = spread(batch.select(F.col(key).alias("key"), F.struct(*order).alias("place"), F.col(content).alias("content"), F.md5(F.col(content).cast("binary")).alias("hash")))
    sized = cut(rows.withColumn("text", F.when(F.length("content") >= grams.MIN_LENGTH, grams.normal(F.col("content")))).withColumn("id", F.when(F.col("text").isNotNull(), F.xxhash64("text"))).drop("content"))
    first = sized.where("hash is not null").groupBy("hash").agg(F.min(F.struct("place", "key")).alias("f"))
    known = index.known(sized.select("hash").where("hash is not null")).withColumn("known", F.lit(True))
    state = cut(
        sized.drop("text").join(first, "hash", "left").join(known, "hash", "left")
        .withColumn("reason", F.when(F.col("known"), "known").when(F.col("hash").isNotNull() & (F.struct("place", "key") != F.col("f")), "copy"))
        .select("key", "place", "hash", "id", "reason")
    )
    texts = sized.where("text is not null").select("id", "text")
    fresh = state.where("reason is null and id is not null")
    nodes = cut(fresh.groupBy("id").agg(F.min("place").alias("place")))
    asked = cut(texts.join(nodes, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))
    near = cut(index.similar(asked).select(F.col("id_a").alias("id")).distinct())
    rest = cut(asked.join(near, "id", "left_anti"))
    pairs = cut(near_dup.candidate_pairs(grams.keyed(rest, index.least), index.least))
    edges = grams.verified(pairs.join(rest.toDF("id_a", "text_a"), "id_a").join(rest.toDF("id_b", "text_b"), "id_b"), index.least)
    late = keep_first(nodes, edges.select("id_a", "id_b"))
    bad = cut(near.unionByName(late).distinct())
    judged = (
        state.join(bad.withColumn("bad", F.lit(True)), "id", "left").join(nodes.withColumnRenamed("place", "first_place"), "id", "left")
        .withColumn("reason", F.coalesce("reason", F.when(F.col("bad") | (F.col("place") > F.col("first_place")), "similar")))
    )
    index.append(rest.join(bad, "id", "left_anti"), rest.count())
    index.append_hashes(state.select("hash"))
    return judged.where("reason is not null").select("key", "reason").distinct()
