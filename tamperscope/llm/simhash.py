"""SimHash near-duplicates: fingerprints compared as vertical bit planes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperscope.llm.common import shuffle_partitions, text_hash
from tamperscope.llm.components import components
from tamperscope.session import materialize

RADIUS = 3
#: Distinct fingerprints compared in one block; larger buckets are split.
BLOCK = 4096
#: Shingles hashed at a time, which bounds memory for very long texts.
CHUNK = 1 << 16

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of a UTF-8 text as a signed long: A-Z in lower case, words
    between white space, shingles of ``shingle`` words with repeats (fewer
    words: one shingle of all). No words, or a null text, give zero."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    digest = partial(xxhash.xxh64_intdigest, seed=42)
    size = min(shingle, len(tokens))
    total = len(tokens) - size + 1
    counts = np.zeros((8, 256), np.int64)
    planes = np.arange(8, dtype=np.int64) * 256
    for lo in range(0, total, CHUNK):
        part = tokens[lo:lo + CHUNK + size - 1]
        hashes = np.array(list(map(digest, map(b" ".join, zip(*(part[i:] for i in range(size)), strict=False)))), np.uint64)
        cells = hashes.view(np.uint8).reshape(-1, 8) + planes
        counts += np.bincount(cells.ravel(), minlength=2048).reshape(8, 256)
    above = (counts @ _BITS).ravel() * 2 > total
    return int(np.packbits(above, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_key, fp) per row of ``docs``; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            prints = [fingerprint(t.as_py(), shingle) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints, pa.int64())], ["doc_id", "text_key", "fp"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_key"), "text")
    return slim.mapInArrow(run, "doc_id long, text_key long, fp long")


def _planes(prints: np.ndarray) -> np.ndarray:
    """Bit b of every fingerprint as packed row b, with a spare zero word."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    rows = np.packbits(bits.T, axis=1, bitorder="little")
    out = np.zeros((64, (len(prints) + 63) // 64 * 8 + 8), np.uint8)
    out[:, :rows.shape[1]] = rows
    return out.view(np.uint64)


def _lanes(flags: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(width * 8, np.uint8)
    packed = np.packbits(flags, bitorder="little")
    out[:len(packed)] = packed
    return out.view(np.uint64)


def near_at(planes: np.ndarray, valid: np.ndarray, offset: int, radius: int) -> np.ndarray:
    """Lanes i, among the valid ones, whose fingerprint differs from that of
    lane i + offset in at most ``radius`` bits.

    Differences are counted in carry-save counters, one bit of the count per
    word array, 64 lanes at a time, with as many digits as the radius has. A
    block of 64 lanes is abandoned as soon as the counters of all its lanes
    have overflowed; the counters left are compared with the radius, digit by
    digit.
    """
    digits = radius.bit_length()
    jump, shift = divmod(offset, 64)
    live = np.flatnonzero(valid)
    over = ~valid[live]
    count = [np.zeros(len(live), np.uint64) for _ in range(digits)]
    last = planes.shape[1] - 1
    for b, row in enumerate(planes):
        there = row[np.minimum(live + jump, last)]
        if shift:
            there = (there >> np.uint64(shift)) | (row[np.minimum(live + jump + 1, last)] << np.uint64(64 - shift))
        carry = row[live] ^ there
        for k in range(digits):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        if b % 8 == 7:
            keep = over != _FULL
            if not keep.any():
                return np.zeros(0, np.int64)
            if not keep.all():
                live, over, count = live[keep], over[keep], [c[keep] for c in count]
    equal = np.full(len(live), _FULL)
    for k in reversed(range(digits)):
        if radius >> k & 1:
            equal &= count[k]
        else:
            over |= equal & count[k]
            equal &= ~count[k]
    word, bit = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return live[word] * 64 + bit


def block_links(prints: np.ndarray, ends: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links of a block of rows sorted by bucket: ``ends[i]`` is the end of
    row i's bucket. Each bucket gives a spanning star of each of its linked
    groups, not all of its pairs."""
    n = len(prints)
    label = np.arange(n)

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    planes = _planes(prints)
    width = planes.shape[1] - 1
    at = np.arange(n)
    for offset in range(1, int((ends - at).max(initial=0))):
        valid = np.zeros(n, bool)
        valid[:n - offset] = (at[:n - offset] + offset < ends[:n - offset]) & (label[:n - offset] != label[offset:])
        if not valid.any():
            continue
        found = near_at(planes, _lanes(valid, width), offset, radius)
        for i in found.tolist():
            a, b = root(i), root(i + offset)
            if a != b:
                label[max(a, b)] = min(a, b)
        if len(found):
            while True:  # flat labels let later offsets skip what is joined
                flat = label[label]
                if (flat == label).all():
                    break
                label[:] = flat
    moved = np.flatnonzero(label != at)
    return prints[moved], prints[label[moved]]


def _scan(radius: int, block: int):
    def links(keys: list, prints: list) -> pa.RecordBatch | None:
        key, fp = np.concatenate(keys), np.concatenate(prints)
        change = np.flatnonzero(np.append((key[1:] != key[:-1]).any(axis=1), True)) + 1
        sizes = np.diff(change, prepend=0)
        ends = np.repeat(change, sizes)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        large = np.repeat(sizes > 64, sizes)
        if (~large).any():  # many small buckets share one pass
            place = np.flatnonzero(~large)
            moved = np.cumsum(~large)
            out.append(block_links(fp[place], moved[ends[place] - 1], radius))
        for end, size in zip(change[sizes > 64], sizes[sizes > 64], strict=True):
            out.append(block_links(fp[end - size:end], np.full(size, size), radius))
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        prints: list[np.ndarray] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            fp = batch.column(2).to_numpy().view(np.uint64)
            # Rows arrive sorted; the last bucket of a batch may go on.
            cut = int(np.flatnonzero((key != key[-1]).any(axis=1)).max(initial=-1)) + 1
            if held and cut == 0 and (keys[-1][-1] != key[0]).any():
                yield links(keys, prints)
                keys, prints, held = [], [], 0
            if cut and held + cut >= block:
                yield links([*keys, key[:cut]], [*prints, fp[:cut]])
                keys, prints, held = [key[cut:]], [fp[cut:]], len(fp) - cut
            else:
                keys.append(key)
                prints.append(fp)
                held += len(fp)
        if held:
            yield links(keys, prints)

    return run


def _parts(mask: int, pieces: int) -> list[int]:
    """The free bits of a mask, dealt in turn to so many masks, each joined to it."""
    free = [b for b in range(64) if not mask >> b & 1]
    made = [mask] * pieces
    for i, b in enumerate(free):
        made[i % pieces] |= 1 << b
    return made


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _choice(masks: list[int], pieces: int, mask: Column | None) -> Column:
    if mask is None:
        return F.array(*[F.lit(_signed(m)) for m in _parts(0, pieces)])
    chosen = None
    for m in masks:
        parts = F.array(*[F.lit(_signed(x)) for x in _parts(m, pieces)])
        chosen = F.when(mask == _signed(m), parts) if chosen is None else chosen.when(mask == _signed(m), parts)
    return chosen


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) within
    ``radius`` bits: their connected components are those of all such pairs.

    Two fingerprints within the radius agree on one of radius + 1 bit groups,
    so each is filed under that many keys. A bucket of more than ``block``
    fingerprints is filed anew under radius + 1 groups of the bits left over,
    again and again: every pair still meets, no bucket outgrows a block, and
    nothing is dropped.
    """
    spark = prints.sparkSession
    pieces = radius + 1
    masks = _parts(0, pieces)
    filed = prints.select("fp").distinct().withColumn("mask", F.explode(_choice([], pieces, None)))
    filed = filed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    ready: list[DataFrame] = []
    while True:
        filed = materialize(filed, "simhash-filed")
        hot = materialize(filed.groupBy("mask", "key").count().where(F.col("count") > block).drop("count"), "simhash-hot")
        if hot.isEmpty() or min(64 - m.bit_count() for m in masks) < block.bit_length():
            ready.append(filed)
            break
        ready.append(filed.join(hot, ["mask", "key"], "left_anti").select("fp", "mask", "key"))
        again = filed.join(hot, ["mask", "key"], "left_semi")
        again = again.withColumn("mask", F.explode(_choice(masks, pieces, F.col("mask"))))
        filed = again.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        masks = [x for m in masks for x in _parts(m, pieces)]
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.unionByName(more)
    dealt = (rows.select("mask", "key", "fp").repartition(shuffle_partitions(spark), "mask", "key")
             .sortWithinPartitions("mask", "key"))
    return dealt.mapInArrow(_scan(radius, block), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = 3) -> DataFrame:
    """(doc_id, text_key, fp, component_id, keep) per row of ``docs``.

    Documents link when their fingerprints differ in at most ``radius`` bits;
    component_id is the smallest doc_id of the connected group. ``keep`` marks
    one document of each group, by doc_id (null last), then text. Null and
    blank texts have fingerprint zero and link to each other. Rows equal in
    doc_id and text are one document. A null doc_id never names a group unless
    the group has no other; an empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, shingle), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "text_key")).alias("first")
    each = rows.groupBy("fp").agg(first)
    linked = components(fingerprint_links(rows, radius))
    named = each.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = named.groupBy("root").agg(F.min("first").alias("head"))
    groups = named.select("fp", "root").join(heads, "root").select("fp", "head")
    return rows.join(groups, "fp").select(
        "doc_id", "text_key", "fp", F.col("head.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_key") == F.col("head.text_key"))).alias("keep"))


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, every column
    as it was. Of rows equal in doc_id and text, one stays."""
    kept = near_duplicates(docs, radius).where("keep").select("doc_id", "text_key").distinct()
    kept = kept.select(F.struct(F.col("doc_id").alias("i"), F.col("text_key").alias("t")).alias("k"))
    keyed = docs.select(F.struct("*").alias("row"), F.struct(
        F.col("doc_id").cast("long").alias("i"), text_hash(F.col("text")).alias("t")).alias("k"))
    # A struct equals another when its fields do, nulls included.
    return keyed.join(kept, "k", "left_semi").dropDuplicates(["k"]).select("row.*")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_components(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
