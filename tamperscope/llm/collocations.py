"""Phrase collocations, counted in quotient filters of packed word numbers."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamperscope.llm import chunks
from tamperscope.llm import quotient_filter as qf
from tamperscope.llm.common import by_size, shuffle_partitions
from tamperscope.operators.ordered import ordinal
from tamperscope.session import materialize

#: Occurrences of a candidate, share of a longer candidate that drops it, and phrases per lang.
LEAST = 10
SHARE = 50
TOP = 2000
SCALE = 1_000_000
ENDS = ".,;:!?\n\x0b\x0c\r"

#: Ends of pieces become line feeds, tabs blanks.
_SPLIT = bytes(10 if chr(b) in ENDS else 32 if b == 9 else b for b in range(256))
_MADE = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("local", pa.int32()), ("n", pa.int64()),
                   ("tokens", pa.binary()), ("kind", pa.int32())])


def _chunks(limit: int):
    """A row of word numbers per chunk (kind 0; number 0 ends a piece), and a
    row per different word of it (kind 1) with its number and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: defaultdict[str, dict[bytes, int]] = defaultdict()
        tokens: list[np.ndarray] = []
        size = index = 0

        def restart() -> None:
            number = count(1)
            known.clear()
            known.default_factory = lambda: defaultdict(number.__next__, {b"\n": 0})
            tokens.clear()

        def rows() -> Iterator[pa.RecordBatch]:
            chunk, joined = chunks.chunk_number(index), np.concatenate(tokens)
            counts = np.bincount(joined)
            values = ([chunk], [None], [None], [None], [size], [chunks.pack(joined)], [0])
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _MADE, strict=True)], schema=_MADE)
            for lang, numbers in known.items():
                numbers.pop(b"\n")
                local = np.fromiter(numbers.values(), np.int32, len(numbers))
                m = len(local)
                spelled = pa.array(list(numbers), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(m, chunk)), pa.array([lang] * m, pa.string()), spelled, pa.array(local),
                    pa.array(counts[local]), pa.nulls(m, pa.binary()), pa.array(np.ones(m, np.int32))], schema=_MADE)

        restart()
        for batch in by_size(batches, 1):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                marked = (text.as_py() or b"").lower().translate(_SPLIT).replace(b"\n", b" \n ")
                parts = list(filter(None, marked.split(b" ")))
                found = np.fromiter(map(known[lang].__getitem__, parts), np.int64, len(parts))
                tokens.append(np.append(found, 0))
                size += len(parts) + 1
                if size >= limit:
                    yield from rows()
                    restart()
                    size, index = 0, index + 1
        if tokens:
            yield from rows()

    return run


def packed(words: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Two or three word numbers of ``width`` bits as the halves of one number,
    and the bits of a half. Up to 42 bits a word, three fit into two longs."""
    w = [x.astype(np.uint64) for x in words]
    if len(w) == 2:
        return w[0], w[1], width
    below = width // 2
    high = (w[0] << np.uint64(width - below)) | (w[1] >> np.uint64(below))
    low = ((w[1] & np.uint64((1 << below) - 1)) << np.uint64(width)) | w[2]
    return high, low, width + (width + 1) // 2


def unpacked(high: np.ndarray, low: np.ndarray, width: int, size: int) -> list[np.ndarray]:
    """The word numbers that ``packed`` was given."""
    if size == 2:
        return [high, low]
    below = width // 2
    second = ((high & np.uint64((1 << (width - below)) - 1)) << np.uint64(below)) | (low >> np.uint64(width))
    return [high >> np.uint64(width - below), second, low & np.uint64((1 << width) - 1)]


def phrase_filters(numbers: np.ndarray, width: int, bits: int) -> Iterator[tuple[int, int, qf.QuotientFilter]]:
    """(size, range, filter) of the phrases of a chunk. ``numbers`` are word
    numbers, negative where no phrase goes on; a range is ``bits`` leading
    bits of the permuted phrase."""
    word = numbers >= 0
    for size in (2, 3):
        at = np.flatnonzero(np.logical_and.reduce([word[i:len(word) - size + 1 + i] for i in range(size)]))
        high, low, half = packed([numbers[at + i] for i in range(size)], width)
        high, low, counts = qf.counted(*qf.permute(high, low, half), None, half)
        shared = min(bits, half)
        which = (high >> np.uint64(half - shared)).astype(np.int64) if shared else np.zeros(len(high), np.int64)
        edge = np.flatnonzero(np.append(True, which[1:] != which[:-1])[:len(which)])
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(which)], strict=False):
            yield size, int(which[lo]), qf.QuotientFilter.of(high[lo:hi], low[lo:hi], counts[lo:hi], half, shared)


_FILTERS = "size int, part long, filter binary"


def _shards(width: int, bits: int):
    def run(chunk: pa.Table, numbered: pa.Table) -> pa.Table:
        tokens = chunks.unpack(chunk["tokens"][0].as_py()).astype(np.int64)
        numbers = np.full(int(tokens.max()) + 1, -1, np.int64)
        numbers[numbered["local"].to_numpy()] = numbered["id"].to_numpy()
        rows = [(size, part, f.to_bytes()) for size, part, f in phrase_filters(numbers[tokens], width, bits)]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 3
        return pa.Table.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())],
                                    ["size", "part", "filter"])

    return run


def _merge(width: int, least: int, limit: int = chunks.RANGE):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (size, _), rows in chunks.groups(batches, 2):
            held: list[qf.QuotientFilter] = []
            for data in (x for b in rows for x in b.column(2)):
                held.append(qf.QuotientFilter.from_bytes(data.as_py()))
                if len(held) > 1 and sum(len(f.high) for f in held[1:]) > max(limit, len(held[0].high)):
                    held = [qf.merged(held)]
            whole = qf.merged(held)
            high, low, counts = whole.entries()
            often = counts >= least
            words = unpacked(*qf.restore(high[often], low[often], whole.half), width, size)
            n = int(often.sum())
            cols = [pa.array(w.astype(np.int64)) for w in words]
            if size == 2:
                cols.append(pa.nulls(n, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, size, np.int32)), *cols, pa.array(counts[often])],
                                             ["size", "w1", "w2", "w3", "a"])

    return run


def _score(a: str, left: str, right: str) -> Column:
    """floor(SCALE * a * a / (left * right)), exactly, in decimals of 38 digits."""
    d = "cast({} as decimal(19, 0))".format
    return F.expr(f"({d(a)} * {d(a)} * cast({SCALE} as decimal(7, 0))) div ({d(left)} * {d(right)})")


def phrase_counts(docs: DataFrame, least: int = LEAST, chunk: int = chunks.CHUNK, key_range: int = chunks.RANGE
                  ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, phrases, totals): words (id, lang, word, f) and phrases (size,
    w1, w2, w3, a) of two and three words that occur at least ``least`` times,
    and the words counted per lang (lang, n).

    A phrase is no more frequent than its words, so only frequent words have
    numbers. Each chunk of documents counts its phrases in filters, one per
    range of permuted phrases; the filters of a range are merged in one task.
    """
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    made = chunks.bucketed(slim.mapInArrow(_chunks(chunk), "chunk long, lang string, word string, local int, n long, tokens binary, kind int"),
                           "phrase-chunks", "kind")
    texts, each = made.where("kind = 0").select("chunk", "n", "tokens"), made.where("kind = 1")
    bits = chunks.range_bits(int(texts.agg(F.sum("n")).head()[0] or 0), key_range)
    totals = each.groupBy("lang").agg(F.sum("n").alias("n"))
    often = each.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    words = materialize(ordinal(often, [], ["lang", "word"], "id", "phrase-words"), "phrase-words")
    width = max(1, words.count().bit_length())
    numbered = each.join(words.select("lang", "word", "id"), ["lang", "word"]).select(F.col("chunk").alias("of"), "local", "id")
    filters = texts.groupBy("chunk").cogroup(numbered.groupBy("of")).applyInArrow(_shards(width, bits), _FILTERS)
    dealt = filters.repartition(max(shuffle_partitions(spark), min(1 << bits, 1 << 20)), "size", "part").sortWithinPartitions("size", "part")
    phrases = materialize(dealt.mapInArrow(_merge(width, least, key_range), "size int, w1 long, w2 long, w3 long, a long"), "phrase-counts")
    return words, phrases, totals


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, chunk: int = chunks.CHUNK,
                 key_range: int = chunks.RANGE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each lang.

    Texts are in lower case (A-Z), cut into pieces at punctuation and line
    ends and into words between blanks and tabs; a null lang is ``und``.
    Phrases of two or three words with a >= ``least`` occurrences inside
    pieces are scored by their weakest cut, floor(10^6 a^2 / (l r)) with l and
    r the occurrences of its parts (of equal cuts the first). A phrase that a
    longer one holds in ``share`` per cent of its places or more is dropped.
    Order: score, a, then the phrase by bytes. All counts are exact.

    Null, empty and blank texts have no words; repeated rows count as often as
    they stand; texts are read whole; a lang without candidates and an empty
    table give no rows; other columns are not read.
    """
    words, phrases, totals = phrase_counts(docs, least, chunk, key_range)

    def word(i: int, *more: str) -> DataFrame:
        return words.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"x{i}"), F.col("f").alias(f"f{i}"), *more)

    pairs = phrases.where("size = 2").select("w1", "w2", "a")
    triples = phrases.where("size = 3").drop("size")
    inside = triples.select("w1", "w2", "a").union(triples.select("w2", "w3", "a")).groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    two = (pairs.join(inside, ["w1", "w2"], "left").where(f"longer IS NULL OR 100 * longer < {share} * a")
           .join(word(1, "lang"), "w1").join(word(2), "w2")
           .select("lang", F.concat_ws(" ", "x1", "x2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"),
                   _score("a", "f1", "f2").alias("score")))
    cuts = (triples.join(word(1, "lang"), "w1").join(word(2), "w2").join(word(3), "w3")
            .join(pairs.select("w1", "w2", F.col("a").alias("front")), ["w1", "w2"])
            .join(pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("back")), ["w2", "w3"])
            .select("*", _score("a", "f1", "back").alias("s1"), _score("a", "front", "f3").alias("s2")))
    first = F.col("s1") <= F.col("s2")
    three = cuts.select("lang", F.concat_ws(" ", "x1", "x2", "x3").alias("phrase"), "a", F.when(first, F.col("f1")).otherwise(F.col("front")).alias("l"),
                        F.when(first, F.col("back")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = two.unionByName(three).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations_sql(table: str = "documents", least: int = LEAST, share: int = SHARE, top: int = TOP) -> str:
    """The same by SQL, on strings."""
    return f"""WITH d AS (SELECT row_number() OVER () doc, coalesce(lang, 'und') lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t FROM {table}),
p AS (SELECT row_number() OVER () piece, lang, list_filter(string_split_regex(x, '[\\x20\\x09]+'), lambda w: w <> '') ws
  FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) x FROM d)),
tok AS (SELECT lang, x, lead(x, 1) OVER o y, lead(x, 2) OVER o z FROM (SELECT piece, lang, unnest(ws) x, generate_subscripts(ws, 1) i FROM p)
  WINDOW o AS (PARTITION BY piece ORDER BY i)),
one AS (SELECT lang, x, count(*) f FROM tok GROUP BY ALL),
two AS (SELECT lang, x, y, count(*) f FROM tok WHERE y IS NOT NULL GROUP BY ALL),
three AS (SELECT lang, x, y, z, count(*) a FROM tok WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}),
inside AS (SELECT lang, x, y, max(a) longer FROM (SELECT lang, x, y, a FROM three UNION ALL SELECT lang, y, z, a FROM three) GROUP BY ALL),
c2 AS (SELECT t.lang, t.x || ' ' || t.y phrase, t.f a, u.f l, v.f r, CAST({SCALE}::HUGEINT * t.f * t.f // (u.f::HUGEINT * v.f) AS BIGINT) score
  FROM two t JOIN one u ON t.lang = u.lang AND t.x = u.x JOIN one v ON t.lang = v.lang AND t.y = v.x
  LEFT JOIN inside i ON t.lang = i.lang AND t.x = i.x AND t.y = i.y
  WHERE t.f >= {least} AND (longer IS NULL OR 100 * longer < {share} * t.f)),
cut AS (SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z phrase, a, u.f l1, q.f r1, p.f l2, v.f r2,
  CAST({SCALE}::HUGEINT * a * a // (u.f::HUGEINT * q.f) AS BIGINT) s1, CAST({SCALE}::HUGEINT * a * a // (p.f::HUGEINT * v.f) AS BIGINT) s2
  FROM three t JOIN one u ON t.lang = u.lang AND t.x = u.x JOIN one v ON t.lang = v.lang AND t.z = v.x
  JOIN two p ON t.lang = p.lang AND t.x = p.x AND t.y = p.y JOIN two q ON t.lang = q.lang AND t.y = q.x AND t.z = q.y),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) rank FROM (SELECT * FROM c2 UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cut))
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN (SELECT lang, CAST(sum(f) AS BIGINT) n FROM one GROUP BY lang) USING (lang)
WHERE rank <= {top}"""
