"""Near-duplicates by exact Jaccard similarity of word shingles: SimHash
fingerprints propose the first candidates, rare-first prefixes that meet in
buckets the others; all are verified on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamperscope.llm.common import shuffle_partitions, text_hash
from tamperscope.llm.components import components
from tamperscope.llm.simhash import fingerprint, fingerprint_links
from tamperscope.session import materialize

SHINGLE = 5
#: Least similarity of linked texts, as a fraction of whole numbers.
ALIKE, OF = 4, 5
#: Shingles that repeat so often inside the chunks of tasks stand last in the
#: order of prefixes. The order changes the work, never the pairs found.
FREQUENT = 32
#: The most frequent of them that are held by every task.
MOST_FREQUENT = 1 << 20
#: Shingles per chunk, and sets that a task remembers so as not to file copies twice.
CHUNK = 1 << 20
REMEMBERED = 1 << 17
#: Rows of small buckets handled at a time.
BLOCK = 1 << 16
#: Places in a bucket, sorted by size, compared in one round; the last has no end.
ROUNDS = ((1, 3), (3, 33), (33, None))

#: So many texts are looked up by a broadcast instead of a shuffle of all texts.
FEW = 100_000
#: Least bits of the map of a set's hashes; a map has two to four times as many
#: bits as its set has hashes, so that it tells long texts apart, too.
MAP_BITS = 1024
#: Links that a task joins at a time; no more than these need no rounds.
LINKS = 1 << 18

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LONGS = pa.list_(pa.int64())
_ODD = np.random.default_rng(1).integers(0, 1 << 63, 6, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted different hashes of a text's shingles: A-Z in lower case, words
    between white space; fewer words give one shingle of all, none an empty set."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), tokens), np.uint64, len(tokens))
    size = min(shingle, len(tokens))
    total = len(tokens) - size + 1
    mixed = np.zeros(total, np.uint64)
    for i in range(size):
        mixed = mixed * _PRIME + each[i:i + total]
    mixed = (mixed ^ (mixed >> np.uint64(30))) * _MIX
    return np.unique(mixed ^ (mixed >> np.uint64(31)))


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), seed=7) - (1 << 63)


def bit_map(shingles: np.ndarray) -> np.ndarray:
    """Bits as longs: a bit is set where a hash falls on it. A bit that one set
    has and another lacks proves a shingle the other lacks."""
    size = max(MAP_BITS, 1 << (2 * len(shingles) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(shingles % np.uint64(size)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def may_be_alike(x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> bool:
    """False where the bit maps of two sets prove that they share too few
    shingles. The longer map is folded to the length of the other."""
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(m.reshape(-1, size), axis=0) for m in (x, y))
    both = min(nx - int(np.bitwise_count((x & ~y).view(np.uint64)).sum()), ny - int(np.bitwise_count((y & ~x).view(np.uint64)).sum()))
    return OF * both >= ALIKE * (nx + ny - both)


def _texts(column: pa.Array) -> Iterator[bytes | None]:
    return (t.as_py() for t in column.cast(pa.large_binary()))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document, and rows of shingles (as sid, n) that several
    different sets of a chunk hold, marked by ``often``."""
    names = ["doc_id", "text_key", "sid", "n", "often", "bits", "mins", "fp"]
    held: list[np.ndarray] = []
    seen: set[int] = set()
    size = 0

    def repeated() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        some = counts > 1
        n = int(some.sum())
        return pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(values[some].view(np.int64)),
             pa.array(counts[some].astype(np.int64)), pa.array(np.ones(n, bool)),
             pa.nulls(n, _LONGS), pa.nulls(n, _LONGS), pa.nulls(n, pa.int64())], names)

    for batch in batches:
        ids, sizes, bits, mins, prints = [], [], [], [], []
        for text in _texts(batch.column(2)):
            shingles = shingle_set(text)
            ids.append(set_id(shingles))
            prints.append(fingerprint(text, SHINGLE))
            sizes.append(len(shingles))
            bits.append(bit_map(shingles))
            mins.append([int((shingles * k).min().view(np.int64)) for k in _ODD] if len(shingles) else [])
            if ids[-1] not in seen:
                seen.add(ids[-1])
                held.append(shingles)
                size += len(shingles)
            if size >= CHUNK:
                yield repeated()
                held, size = [], 0
                seen.clear()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
             pa.array(np.zeros(len(ids), bool)), pa.array(bits, _LONGS), pa.array(mins, _LONGS),
             pa.array(prints, pa.int64())], names)
    if held:
        yield repeated()


def prefix(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, so many that two sets as alike as ALIKE / OF
    share one. Others stand by hash, frequent ones behind them by count and hash."""
    wanted = len(shingles) - -(-ALIKE * len(shingles) // OF) + 1 if len(shingles) else 0
    if not len(frequent):
        return shingles[:wanted]
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    often = frequent[at] == shingles
    rare = shingles[~often]
    if len(rare) >= wanted:
        return rare[:wanted]
    rest, times = shingles[often], counts[at[often]]
    return np.concatenate([rare, rest[np.lexsort((rest, times))][:wanted - len(rare)]])


def _prefixes(order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = order.value
        seen: set[int] = set()
        for batch in batches:
            keys, ids, sizes = [np.zeros(0, np.uint64)], [], []
            for text in _texts(batch.column(0)):
                shingles = shingle_set(text)
                sid = set_id(shingles)
                if sid in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(sid)
                keys.append(prefix(shingles, frequent, counts))
                ids.append(sid)
                sizes.append(len(shingles))
            lengths = [len(k) for k in keys[1:]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), lengths)),
                 pa.array(np.repeat(np.array(sizes, np.int64), lengths))], ["h", "sid", "n"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t) for t in _texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([s.view(np.int64) for s in sets], _LONGS)], ["sid", "shingles"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first one, cut between its values."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        part = [c.to_numpy() for c in batch.columns]
        if held and held[-1][0][-1] != part[0][0] and rows >= BLOCK:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, rows = [], 0
        cut = int(np.searchsorted(part[0], part[0][-1]))
        if cut and rows + cut >= BLOCK:
            yield [np.concatenate(c) for c in zip(*held, [c[:cut] for c in part], strict=True)]
            held, rows = [], 0
            part = [c[cut:] for c in part]
        held.append(part)
        rows += len(part[0])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by h and sid, of the values of h that several sets hold; each once."""
    for h, sid, n in _whole(batches):
        new = np.append(True, (h[1:] != h[:-1]) | (sid[1:] != sid[:-1]))
        h, sid, n = h[new], sid[new], n[new]
        next_same = np.append(h[1:] == h[:-1], False)
        several = next_same | np.append(False, next_same[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(x[several]) for x in (h, sid, n)], ["h", "sid", "n"])


def _pairs(start: int, stop: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, n, sid, root in _whole(batches):
            edge = np.flatnonzero(np.append(h[1:] != h[:-1], True)) + 1
            end = np.repeat(edge, np.diff(edge, prepend=0))
            live = np.arange(len(h))
            offset = start
            while stop is None or offset < stop:
                live = live[live + offset < end[live]]
                live = live[OF * n[live] >= ALIKE * n[live + offset]]  # sizes grow with the offset
                if not len(live):
                    break
                at = live[root[live] != root[live + offset]]
                if len(at):
                    a, b = sid[at], sid[at + offset]
                    found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], ["a", "b"])
                offset += 1

    return run


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of rows (a, b, x, nx, y, ny) whose maps don't rule them out."""
    for batch in batches:
        maps = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column(2), batch.column(4))]
        (xo, x), (yo, y) = maps
        sizes = zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)
        keep = [may_be_alike(x[xo[i]:xo[i + 1]], y[yo[i]:yo[i + 1]], nx, ny) for i, (nx, ny) in enumerate(sizes)]
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in range(2)], ["a", "b"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b), so many at a time, as links (a, b) of each of their nodes
    to the smallest that it reaches through them, itself included."""
    held: list[np.ndarray] = []
    rows = 0

    def joined() -> pa.RecordBatch:
        nodes, ends = np.unique(np.concatenate(held), return_inverse=True)
        ends = ends.reshape(-1, 2)
        label = np.arange(len(nodes))
        while len(ends):
            at = label[ends]
            apart = at[:, 0] != at[:, 1]
            ends, at = ends[apart], at[apart]
            np.minimum.at(label, at.max(axis=1, initial=0), at.min(axis=1, initial=len(nodes)))
            while (label[label] != label).any():
                label = label[label]
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["a", "b"])

    for batch in batches:
        for lo in range(0, batch.num_rows, LINKS):
            part = batch.slice(lo, LINKS)
            if rows and rows + part.num_rows > LINKS:
                yield joined()
                held, rows = [], 0
            held.append(np.stack([c.to_numpy() for c in part.columns], axis=1))
            rows += part.num_rows
    if held:
        yield joined()


def _joined(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the written links (a, b), as of
    ``components``: tasks join the links they hold, rounds the rest."""
    parts = -(-links.count() // LINKS)
    forest = links.repartition(max(1, parts)).mapInArrow(_forest, "a long, b long")
    return forest.toDF("node", "root") if parts <= 1 else components(forest)


def _linked(filed: DataFrame, heads: DataFrame, keyed: DataFrame, roots: DataFrame, start: int, stop: int | None) -> DataFrame:
    """``roots`` joined further by the pairs of each bucket's places ``start``
    to ``stop`` that no chain of links joins yet and whose sets are alike."""
    spark = filed.sparkSession
    rooted = filed.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select(
        "h", "n", "sid", F.coalesce("root", "sid").alias("root"))
    dealt = rooted.repartition(shuffle_partitions(spark), "h").sortWithinPartitions("h", "n", "sid")
    return _verified(dealt.mapInArrow(_pairs(start, stop), "a long, b long").distinct(), heads, keyed, roots)


def _near_prints(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that connect those of equal fingerprints, and those
    whose fingerprints a chain of links of a few bits joins."""
    first = materialize(prints.groupBy("fp").agg(F.min("sid").alias("s")), "near-prints")
    ends = [first.select(F.col("fp").alias(c), F.col("s").alias(f"s{c}")) for c in "ab"]
    linked = fingerprint_links(prints).join(ends[0], "a").join(ends[1], "b").select(F.col("sa").alias("a"), F.col("sb").alias("b"))
    equal = prints.join(first, "fp").select(F.col("sid").alias("a"), F.col("s").alias("b"))
    return linked.unionByName(equal).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, heads: DataFrame, keyed: DataFrame, roots: DataFrame) -> DataFrame:
    """``roots`` joined further by those of ``pairs`` whose sets are alike. Only
    texts of pairs that their bit maps leave are read again."""
    left = heads.select(F.col("sid").alias("a"), F.col("bits").alias("x"), F.col("n").alias("nx"))
    right = heads.select(F.col("sid").alias("b"), F.col("bits").alias("y"), F.col("n").alias("ny"))
    mapped = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "nx", "y", "ny")
    pairs = materialize(mapped.mapInArrow(_plausible, "a long, b long"), "near-pairs")
    if pairs.isEmpty():
        return roots
    needed = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    needed = materialize(needed.join(heads.select("sid", "k"), "sid"), "near-needed")
    few = needed.count() <= FEW
    texts = keyed.join(F.broadcast(needed) if few else needed, "k").select("sid", "text").dropDuplicates(["sid"])
    sets = materialize(texts.mapInArrow(_sets, "sid long, shingles array<long>"), "near-sets")
    left = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    alike = pairs.join(left, "a").join(right, "b").where(OF * both >= ALIKE * (F.size("x") + F.size("y") - both))
    links = materialize(alike.select("a", "b").unionByName(
        roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), "near-links")
    return materialize(_joined(links), "near-roots")


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, root) per row of ``docs``: rows share a root when
    links join them, and texts link when the Jaccard similarity of their sets
    of five-word shingles is at least 0.8. No such pair is missed.

    SimHash fingerprints of the same shingles link most near copies, a chain
    for each group; every link is verified. Others, whose fingerprints differ
    in more bits, meet in buckets: two sets so alike share one of the first
    fifth (and one) of their shingles in any order that all sets follow, so
    each is filed under these. Copies are one set; groups of near copies are
    joined through smallest hashes first, so that their buckets hold few pairs
    yet to be compared. Null and blank texts have the empty set and are alike.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_key"), "text")
    measured = materialize(
        slim.mapInArrow(_measure, "doc_id long, text_key long, sid long, n long, often boolean, bits array<long>, mins array<long>, fp long"),
        "near-measured")
    rows = measured.where("not often").select("doc_id", "text_key", "sid")
    frequent = (measured.where("often").groupBy("sid").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
                .orderBy(F.desc("n"), "sid").limit(MOST_FREQUENT).toArrow())
    values, counts = frequent["sid"].to_numpy().view(np.uint64), frequent["n"].to_numpy()
    order = spark.sparkContext.broadcast((values[np.argsort(values)], counts[np.argsort(values)]))

    filed = docs.select("text").mapInArrow(_prefixes(order), "h long, sid long, n long")
    filed = filed.repartition(shuffle_partitions(spark), "h").sortWithinPartitions("h", "sid")
    shared = materialize(filed.mapInArrow(_shared, "h long, sid long, n long"), "near-shared")

    one = F.struct(F.col("doc_id").alias("i"), F.col("text_key").alias("t"))
    heads = materialize(
        measured.where("not often").join(shared.select("sid").distinct(), "sid").groupBy("sid")
        .agg(F.min(one).alias("k"), F.min("n").alias("n"), F.min("bits").alias("bits"), F.min("mins").alias("mins")), "near-heads")
    keyed = slim.select(one.alias("k"), "text")
    smallest = heads.select("sid", "n", F.posexplode("mins").alias("i", "m")).select(F.xxhash64("i", "m").alias("h"), "sid", "n")
    prints = materialize(measured.where("not often").select("fp", "sid").distinct(), "near-prints")
    roots = _verified(_near_prints(prints), heads, keyed, spark.createDataFrame([], "node long, root long"))
    roots = _linked(smallest, heads, keyed, roots, 1, 2)
    for start, stop in ROUNDS:
        roots = _linked(shared, heads, keyed, roots, start, stop)
    return rows.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select(
        "doc_id", "text_key", F.coalesce("root", "sid").alias("root"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, by doc_id
    (null last), then text; every column as it was. Of rows equal in doc_id and
    text, one stays."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("text_key").alias("t"))
    kept = near_groups(docs).groupBy("root").agg(F.min(order).alias("first"))
    kept = kept.select(F.struct(F.col("first.i").alias("i"), F.col("first.t").alias("t")).alias("k"))
    keyed = docs.select(F.struct("*").alias("row"), F.struct(
        F.col("doc_id").cast("long").alias("i"), text_hash(F.col("text")).alias("t")).alias("k"))
    # A struct equals another when its fields do, nulls included.
    return keyed.join(kept, "k", "left_semi").dropDuplicates(["k"]).select("row.*")
