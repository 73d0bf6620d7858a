"""Bottom-k sketches of shingle hashes: mergeable document fingerprints."""

from __future__ import annotations

import base64
import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamperscope.llm.common import by_size, shuffle_partitions, text_hash

K = 128
SHINGLE = 5

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_TABLE = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:8], "little") for b in range(256)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = {"n": 0, "up": np.zeros(0, np.uint64), "down": np.zeros(0, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, 0 to n."""
    if _POWERS["n"] <= n:
        size = max(2 * n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _UNBASE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
        _POWERS["n"] = size
    return _POWERS["up"], _POWERS["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that scatters neighbouring values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all word shingles, A-Z in lower case and runs of white space
    as one space; fewer words than ``size`` make one shingle, none make none.
    Each is a difference of prefix sums, so the work is linear in the bytes."""
    raw = _LOWER[np.frombuffer(text, np.uint8)]
    space = _SPACE[raw]
    keep = ~space
    if keep.size:
        keep[1:] |= ~space[:-1]  # the first white space after a word stays
    data = raw[keep]
    gap = space[keep]
    solid = np.concatenate(([False], ~gap, [False]))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    data[gap] = 0x20
    size = min(size, len(starts))
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[:len(data)], out=sums[1:])
    first, last = starts[:len(starts) - size + 1], ends[size - 1:]
    lengths = (last - first).astype(np.uint64)
    return _mix((sums[last] - sums[first]) * down[first] + lengths * np.uint64(0x2545F4914F6CDD1D))


def sketch(text: bytes | None, k: int = K, size: int = SHINGLE) -> np.ndarray:
    """The k smallest distinct shingle hashes, ascending."""
    hashes = shingle_hashes(text or b"", size)
    if len(hashes) > 4 * k:
        # The smallest k distinct values lie below a cut that leaves enough.
        cut = 4 * k
        while True:
            low = np.unique(np.partition(hashes, cut - 1)[:cut])
            if len(low) >= k or cut >= len(hashes):
                return low[:k]
            cut = min(len(hashes), cut * 8)
    return np.unique(hashes)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Jaccard similarity estimated from two sketches: the share of the k
    smallest hashes of the union that both hold; exact for sets within k.
    Two empty sets are alike, an empty and another are not."""
    union = np.union1d(a, b)[:k]
    if not len(union):
        return 1.0
    return float((np.isin(union, a) & np.isin(union, b)).mean())


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Distinct shingles: exact below k, else (k - 1) over the k-th hash as a
    share of the hash range."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of a's shingles that b holds, from resemblance and counts."""
    if not len(a):
        return 1.0
    if len(a) < k and len(b) < k:
        return float(np.isin(a, b).mean())
    joint = resemblance(a, b, k)
    total = distinct_count(np.union1d(a, b)[:k], k)
    return min(1.0, joint * total / distinct_count(a, k))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def sketches(docs: DataFrame, k: int = K, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, hashes) per row of ``docs``: hashes is the sketch
    as an array of longs (unsigned order), n_shingles the estimated distinct
    count. A null text is an empty one; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 1):
            made = [sketch(t.as_py(), k, size) for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([distinct_count(a, k) for a in made]),
                 pa.array([a.view(np.int64) for a in made], pa.list_(pa.int64()))], ["doc_id", "n_shingles", "hashes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_shingles double, hashes array<long>")


def merge(parts: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """(*by, hashes): the sketch of each group's union. Each task keeps the k
    smallest hashes of a group before the shuffle, so a group of any size
    meets as k values a task. Null keys form a group; empty sketches add none."""
    low = F.col("h").bitwiseXOR(F.lit(-(1 << 63)))  # in signed order as h in unsigned order
    order = Window.partitionBy(*by).orderBy("u")
    each = parts.select(*by, F.explode("hashes").alias("h")).distinct().withColumn("u", low)
    return (each.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
            .groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("u", "h"))), lambda x: x["h"]).alias("hashes")))


def _place(cuts: list[int]) -> Column:
    """Number of cuts up to doc_id, by a search in two steps; a null doc_id
    comes after all others."""
    null = F.lit(len(cuts) + 1)
    if not cuts:
        return F.when(F.col("doc_id").isNull(), null).otherwise(0)
    step = math.isqrt(len(cuts)) + 1

    def upto(values: Column) -> Column:
        return F.size(F.filter(values, lambda c: c <= F.col("doc_id")))

    coarse = F.from_json(F.lit(json.dumps(cuts[::step])), "array<bigint>")
    fine = F.from_json(F.lit(json.dumps([cuts[i:i + step] for i in range(0, len(cuts), step)])), "array<array<bigint>>")
    block = upto(coarse)
    inner = F.when(block == 0, 0).otherwise((block - 1) * step + upto(fine[F.greatest(block - 1, F.lit(0))]))
    return F.when(F.col("doc_id").isNull(), null).otherwise(inner)


def in_ranges(docs: DataFrame, each: int = 4000) -> DataFrame:
    """Rows (bucket, look, doc_id, text_key, text): the documents in ranges of
    doc_id, and with look = 1 the first document after each range, which after
    the last range is the very first. A range is cut at quantiles of doc_id
    and holds about ``each`` documents, up to 20,000 ranges; only the cuts and
    the first key of each range reach the driver."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_key"), "text")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    stats = ids.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).head()
    wanted = min(max(1, stats["n"] // each), 20_000)
    cuts: list[int] = []
    if stats["ids"] and wanted > 1:
        marks = [i / wanted for i in range(1, wanted)]
        cuts = sorted({int(x) for x in ids.approxQuantile("doc_id", marks, 0.2 / wanted)})
    placed = slim.withColumn("bucket", _place(cuts))
    key = F.struct("doc_id", "text_key")
    # Without the text this reads one column more than the ids; the order of a
    # struct puts nulls first, and a null doc_id has a bucket of its own.
    firsts = sorted((r["bucket"], r["k"]["doc_id"], r["k"]["text_key"])
                    for r in placed.groupBy("bucket").agg(F.min(key).alias("k")).collect())
    before = [firsts[-1][0], *[f[0] for f in firsts[:-1]]] if firsts else []
    looks = [(doc_id, text_key, b) for (_, doc_id, text_key), b in zip(firsts, before, strict=True)]
    look = docs.sparkSession.createDataFrame(looks, "doc_id long, text_key long, look_bucket int").select(
        key.alias("key"), "look_bucket")
    own = F.struct(F.col("bucket"), F.lit(0).alias("look"))
    also = F.struct(F.col("look_bucket").alias("bucket"), F.lit(1).alias("look"))
    return (placed.withColumn("key", key).join(F.broadcast(look), "key", "left")
            .withColumn("at", F.explode(F.when(F.col("look_bucket").isNull(), F.array(own)).otherwise(F.array(own, also))))
            .select("at.bucket", "at.look", "doc_id", "text_key", "text"))


_COMPARED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")


def edited_neighbours(docs: DataFrame, k: int = K, size: int = SHINGLE) -> DataFrame:
    """Each document's sketch, that of its text with the second half replaced
    by the head of the next document, and the resemblance of its sketch to
    that one and to the next document's.

    Documents go by doc_id (null last), equal ids by text; the next of the
    last is the first, which for a single document is itself. A null text is
    an empty one; repeated rows are neighbours; other columns are not read.
    Each task reads sorted rows as a stream and holds one document at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _COMPARED.replace(" long", "").replace(" string", "").replace(" double", "").split(", ")
        schema = pa.schema([(n, pa.int64() if n in ("doc_id", "n_chars") else pa.float64() if n.startswith("near") else pa.string())
                            for n in names])
        prev = None
        for batch in by_size(batches, 3, 2 << 20):
            out = []
            for bucket, look, doc_id, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = value or ""
                made = sketch(text.encode(), k, size)
                if prev is not None and prev[0] == bucket:
                    _, prev_id, prev_text, prev_made = prev
                    n = len(prev_text)
                    edited = (prev_text[:n - n // 2] + text[:n // 2]).encode()
                    other = sketch(edited, k, size)
                    out.append((prev_id, n, hashlib.sha256(edited).hexdigest(), to_text(prev_made), to_text(other),
                                resemblance(prev_made, other, k), resemblance(prev_made, made, k)))
                prev = None if look else (bucket, doc_id, text, made)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    rows = in_ranges(docs)
    dealt = rows.repartition(shuffle_partitions(docs.sparkSession), "bucket").sortWithinPartitions(
        "bucket", "look", F.col("doc_id").asc_nulls_last(), "text_key")
    return dealt.select("bucket", "look", "doc_id", "text").mapInArrow(run, _COMPARED)
