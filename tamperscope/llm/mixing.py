"""Mixing sources to target weights, block by block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamperscope.llm.common import SPACE_RUN, text_hash
from tamperscope.session import materialize

BLOCK = 64
SLOTS = 4096
SHARDS = 16_384
MAX_EPOCHS = 3
SEED = 20_240_607
#: Sources are a mixing setting; their table is held on the driver up to this.
MAX_SOURCES = 100_000
#: Documents that are numbered together.
EACH = 2000


def target_sizes(sizes: list[int], weights: list[float], most: float = MAX_EPOCHS) -> list[float]:
    """All sizes shared out by weight, a source at most ``most`` times its
    size; the excess goes to the others by weight until none is above."""
    out = [0.0] * len(sizes)
    open_, left = list(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / total for i in open_}
        above = [i for i in open_ if share[i] > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = share[i]
            break
        for i in above:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(above)]
    return out


def shard_draws(slots: list[int], shard_slots: int, seed: int = SEED) -> list[tuple[int, int, int, int]]:
    """(source, shard, first, n): how many slots of each output shard go to
    each source, by multinomial draws in proportion to what its target still
    lacks. A draw beyond that is drawn again among the others, so the shards
    vary and their sums are the targets."""
    random = np.random.Generator(np.random.Philox(seed))
    left = np.array(slots, np.int64)
    first = np.zeros(len(left), np.int64)
    out = []
    shard = 0
    while left.sum():
        want = min(shard_slots, int(left.sum()))
        counts = np.zeros(len(left), np.int64)
        while want:
            free = left - counts
            draw = np.minimum(random.multinomial(want, free / free.sum()), free)
            counts += draw
            want -= int(draw.sum())
        out += [(int(s), shard, int(first[s]), int(counts[s])) for s in np.flatnonzero(counts)]
        first += counts
        left -= counts
        shard += 1
    return out


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def permuted(k: np.ndarray, n: np.ndarray, source: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Block of slot k of a source of n blocks: each round of n slots is a
    permutation of the blocks, keyed by seed, source and round: four Feistel
    rounds over an even number of bits, walked until the value is below n."""
    k, n, source = (np.asarray(x).astype(np.uint64) for x in (k, n, source))
    key = _scatter(_scatter(np.uint64(seed) + source) + k // n)
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, np.uint64(2)).astype(float)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    value = k % n
    todo = np.arange(len(k))
    while len(todo):
        h, m, c = half[todo], mask[todo], key[todo]
        a, b = value[todo] >> h, value[todo] & m
        for i in range(4):
            a, b = b, a ^ (_scatter(b + c + np.uint64(i)) & m)
        value[todo] = (a << h) | b
        todo = todo[value[todo] >= n[todo]]
    return value.astype(np.int64)


def _permute(k: pd.Series, n: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series(permuted(k.to_numpy(), n.to_numpy(), source.to_numpy()))


class Mix:
    """A mix of ``docs``: its sources and targets, the packed documents and
    the drawn blocks."""

    def __init__(self, docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> None:
        spark = docs.sparkSession
        self.block = block
        self.sizes = materialize(docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_key"),
            F.struct(F.col("source").cast("string").alias("source")).alias("host"),
            F.coalesce(F.regexp_count("text", F.lit(SPACE_RUN.replace("[", "[^", 1))), F.lit(0)).cast("long").alias("size")), "mix-sizes")
        by_source = self.sizes.groupBy("host").agg(F.sum("size").alias("size"), F.count("*").alias("docs"))
        found = by_source.limit(MAX_SOURCES + 1).collect()
        if len(found) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        found.sort(key=lambda r: (r["host"]["source"] is None, r["host"]["source"] or ""))
        sizes = [r["size"] for r in found]
        targets = target_sizes(sizes, [1 + i % 3 for i in range(len(found))])
        blocks = [-(-s // block) for s in sizes]
        # A source's blocks hold its size, so its target is so many of them.
        slots = [min(MAX_EPOCHS * b, round(t * b / s)) if s else 0 for s, t, b in zip(sizes, targets, blocks, strict=True)]
        shard_slots = max(SLOTS, -(-sum(slots) // SHARDS))
        rows = [((r["host"]["source"],), i, s, t, b) for i, (r, s, t, b) in enumerate(zip(found, sizes, targets, blocks, strict=True))]
        self.sources = F.broadcast(spark.createDataFrame(
            rows, "host struct<source:string>, source_no int, source_size long, target double, blocks long"))
        self.draws = spark.createDataFrame(shard_draws(slots, shard_slots, seed), "source_no int, shard int, first long, n long")
        self.buckets = max(1, sum(r["docs"] for r in found) // EACH)

    def slots(self) -> DataFrame:
        """(source_no, shard, slot, block): the mix in its output order."""
        step = 1 << 16
        parts = self.draws.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))))
        each = parts.select("source_no", "shard", F.explode(F.sequence(
            F.col("first") + F.col("low"), F.col("first") + F.least(F.col("low") + step, F.col("n")) - 1)).alias("slot"))
        # The draws are few rows, which become many here.
        each = each.repartition("shard", "source_no").join(self.sources.select("source_no", "blocks"), "source_no")
        permute = F.pandas_udf(_permute, "long")
        return each.select("source_no", "shard", "slot", permute("slot", "blocks", "source_no").alias("block"))

    def packed(self) -> DataFrame:
        """Documents with the place of their first word among the words of
        their source: documents go in a hashed order, numbered in buckets."""
        rows = self.sizes.join(self.sources, "host").withColumn(
            "bucket", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(self.buckets)))
        sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
        earlier = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.select("source_no", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
        inside = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "text_key").rowsBetween(Window.unboundedPreceding, 0)
        return rows.join(starts, ["source_no", "bucket"]).select(
            "doc_id", "text_key", "size", "source_no", "source_size", "target",
            (F.col("base") + F.sum("size").over(inside) - F.col("size")).alias("start"))

    def pieces(self) -> DataFrame:
        """Documents cut at block borders, (low, high) in their own words,
        with the number of times that the mix takes each piece."""
        size, start = F.col("size"), F.col("start")
        cut = self.packed().withColumn("block", F.explode_outer(F.when(size > 0, F.sequence(
            F.floor(start / self.block), F.floor((start + size - 1) / self.block)))))
        low = F.greatest(F.col("block") * self.block - start, F.lit(0))
        high = F.least((F.col("block") + 1) * self.block - start, size)
        times = self.slots().groupBy("source_no", "block").agg(F.count("*").alias("times"))
        return cut.withColumn("low", low).withColumn("high", high).join(times, ["source_no", "block"], "left")


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row of ``docs``.

    Size is a document's number of words (a null text has none). Sources by
    code point, null last, weigh 1, 2, 3 and so on; see ``target_sizes``. The
    words of a source are packed into blocks; each output shard draws how many
    of its slots go to each source, slots map to blocks through keyed
    permutations, and a document is taken as often as its blocks are, at most
    three times. A null doc_id and repeated rows are documents like others; an
    empty table gives no rows. The same rows give the same mix.
    """
    taken = F.coalesce(F.sum((F.col("high") - F.col("low")) * F.col("times")), F.lit(0)).cast("long")
    keys = ["doc_id", "text_key", "size", "source_no", "start", "source_size", "target"]
    pieces = Mix(docs).pieces()
    # Documents without words share their start; each is a row of its own.
    some = pieces.where("size > 0").groupBy(*keys).agg(taken.alias("taken"))
    none = pieces.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return some.select(*columns).union(none.select(*columns))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: what is taken of a
    document once, twice or three times becomes so many rows; pieces are
    joined by a space, a document taken whole keeps its text, one that is not
    taken goes. Of rows equal in doc_id and text one gives the other columns."""
    pieces = Mix(docs).pieces().where("times > 0")
    copies = pieces.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    each = copies.groupBy("doc_id", "text_key", "size", "source_no", "start", "copy").agg(
        F.sort_array(F.collect_list(F.struct("low", "high"))).alias("ranges"),
        F.sum(F.col("high") - F.col("low")).alias("words"))
    lists = each.groupBy(F.struct("doc_id", "text_key").alias("key")).agg(
        F.collect_list(F.struct((F.col("words") == F.col("size")).alias("whole"), "ranges")).alias("copies"))
    keyed = docs.select(F.struct("*").alias("row"), F.struct(
        F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_key")).alias("key"))
    rows = keyed.join(lists, "key").dropDuplicates(["key"]).select(
        "row", F.filter(F.split("row.text", SPACE_RUN), lambda w: w != "").alias("words"), F.explode("copies").alias("copy"))

    def cut(words: Column) -> Column:
        return F.flatten(F.transform("copy.ranges", lambda r: F.slice(words, (r["low"] + 1).cast("int"), (r["high"] - r["low"]).cast("int"))))

    text = F.when(F.col("copy.whole"), F.col("row.text")).otherwise(F.array_join(cut(F.col("words")), " "))
    made = rows.select("row", text.alias("text"))
    new = {"text": F.col("text"), "n_chars": F.char_length("text")}
    return made.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])
