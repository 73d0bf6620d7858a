"""Chunks of whole documents, and counts of a chunk's keys over all chunks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamperscope.llm.common import shuffle_partitions
from tamperscope.session import new_path

#: Tokens of a chunk; a longer document is a chunk of its own.
CHUNK = 1 << 20
#: Keys that meet in one range of keys, about.
RANGE = 1 << 21


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 as compressed byte planes, high zero bytes left out."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    """The numbers of ``pack`` as unsigned 64-bit ones."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :data[0]] = planes.T
    return out.view("<u8").ravel()


def chunk_number(index: int) -> int:
    """A number that no other chunk of the same job has."""
    return (TaskContext.get().partitionId() << 32) + index


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Rows that agree in the first ``keys`` columns, of rows sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple = ()
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:keys]]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        edge = [*np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(edge, edge[1:], strict=False):
            key = tuple(int(c[lo]) for c in cols)
            if held and key != last:
                yield last, held
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield last, held


def range_bits(entries: int, size: int = RANGE) -> int:
    """Leading bits of a key that name its range, for ranges of about ``size`` entries."""
    return (entries // size).bit_length()


def key_ranges(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(range, start, end) of sorted keys, by their leading bits."""
    if not bits:
        if len(keys):
            yield 0, 0, len(keys)
        return
    which = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edge = [*(np.flatnonzero(which[1:] != which[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
    lo = 0
    for hi in edge:
        yield int(which[lo]), lo, hi
        lo = hi


def bucketed(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """``df`` as a table in the shared folder with a bucket per chunk number,
    so that what is found about a chunk can be dealt to it and the chunks stay
    where they are."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    writer = df.write.format("parquet").option("path", path).bucketBy(min(shuffle_partitions(spark), 100_000), "chunk")
    (writer.partitionBy(*partitions) if partitions else writer).saveAsTable(table)
    return spark.table(table)


REQUESTS = "kind int, part long, chunk long, keys binary, counts binary"
ANSWERS = "chunk long, kind int, part long, counts binary, known long, total long"


def request_rows(chunk: int, kind: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """The sorted different keys of a chunk with their counts in it, a row per range."""
    rows = [(kind, part, chunk, pack(np.diff(keys[lo:hi], prepend=np.uint64(0))), pack(counts[lo:hi]))
            for part, lo, hi in key_ranges(keys, bits)]
    types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                      ["kind", "part", "chunk", "keys", "counts"])


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (kind, part), rows in groups(batches, 2):
        chunks = [c for b in rows for c in b.column(2).to_pylist()]
        keys = [np.cumsum(unpack(x.as_py()), dtype=np.uint64) for b in rows for x in b.column(3)]
        counts = np.concatenate([unpack(x.as_py()) for b in rows for x in b.column(4)])
        edge = np.cumsum([0, *map(len, keys)])
        different, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros(len(different), np.uint64)
        np.add.at(sums, at, counts)
        told = (sums << np.uint64(1)) | (np.bincount(at, minlength=len(different)) > 1)
        n = len(chunks)
        first = [True] + [False] * (n - 1)
        yield pa.RecordBatch.from_arrays([
            pa.array(chunks, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int64()),
            pa.array([pack(told[at[lo:hi]]) for lo, hi in zip(edge, edge[1:], strict=False)], pa.binary()),
            pa.array([int((sums > 0).sum()) if x else None for x in first], pa.int64()),
            pa.array([int(sums.sum()) if x else None for x in first], pa.int64()),
        ], ["chunk", "kind", "part", "counts", "known", "total"])


def counted(requests: DataFrame, bits: int) -> DataFrame:
    """For each row of REQUESTS the counts of its keys summed over all chunks,
    in the order of the keys, doubled, and 1 more where another chunk asks for
    the key too; one row of each range also says how many keys
    have a count and the sum of all counts. A key of every chunk is one number
    per chunk, so no key is hot."""
    spark = requests.sparkSession
    tasks = max(shuffle_partitions(spark), min(1 << bits, 1 << 20))
    dealt = requests.repartition(tasks, "kind", "part").sortWithinPartitions("kind", "part", "chunk")
    return dealt.mapInArrow(_answers, ANSWERS)


def sums(answers: DataFrame) -> Sequence[int]:
    """(keys with a count, sum of counts) over all ranges."""
    row = answers.agg(F.sum("known"), F.sum("total")).head()
    return int(row[0] or 0), int(row[1] or 0)
