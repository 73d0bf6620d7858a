"""Periodic runs of words by string synchronising sets."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamperscope.llm.common import by_size, crc32_sql

#: A run is at least this long, and at least so many periods.
MIN_LENGTH = 24
MIN_PERIODS = 3
#: Smallest scale. Its synchronising positions propose periods from 1.5 times
#: the scale on; smaller ones come from the highly periodic regions.
FIRST_SCALE = 4
SMALL_PERIODS = range(1, 6)

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _C
    return x ^ (x >> np.uint64(29))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring stretches from theirs."""
    return _mixed(left * _A + (right ^ (right >> np.uint64(32))) * _B)


def _doubled(names: np.ndarray, width: int) -> np.ndarray:
    """Names of windows of twice the ``width``; those beyond the end are like no other."""
    out = _mixed(np.arange(len(names)).view(np.uint64) * _B + _A)
    if len(names) > width:
        out[:-width] = _joined(names[:-width], names[width:])
    return out


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by block-wise running minima."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // width) * width, _NONE)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def _stretches(words: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal stretches that keep a period and
    hold at least MIN_PERIODS of it."""
    same = np.concatenate(([False], words[period:] == words[:-period], [False])) if len(words) > period else np.zeros(1, bool)
    edge = np.flatnonzero(same[1:] != same[:-1])
    start, length = edge[::2], edge[1::2] - edge[::2] + period
    long = length >= MIN_PERIODS * period
    return start[long], length[long]


def _agreeing(words: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from ``i`` and ``j`` on, in direction ``step``, agree."""
    found, size = 0, 64
    room = min(i, j) + 1 if step < 0 else len(words) - max(i, j)
    while found < room:
        size = min(size, room - found)
        if step > 0:
            x, y = words[i + found:i + found + size], words[j + found:j + found + size]
        else:
            x = words[i - found - size + 1:i - found + 1][::-1]
            y = words[j - found - size + 1:j - found + 1][::-1]
        differ = x != y
        if differ.any():
            return found + int(differ.argmax())
        found += size
        size *= 4
    return found


def _synchronising(names: np.ndarray, scale: int, periodic: np.ndarray) -> np.ndarray:
    """Positions chosen by their next 2 * ``scale`` words alone: the smallest
    name of the scale's windows from here to ``scale`` words on stands at one
    of the two ends. Windows of highly periodic regions have no name."""
    named = np.where(periodic, _NONE, names)
    least = _window_min(named, scale + 1)
    return np.flatnonzero((least != _NONE) & ((least == named[:len(least)]) | (least == named[scale:scale + len(least)])))


def _proposals(at: np.ndarray, contexts: np.ndarray, least: int, most: int) -> list[tuple[int, int]]:
    """(position, period): neighbours among equal contexts, of which only the
    first of a chain with one period is kept."""
    order = np.argsort(contexts, kind="stable")
    place, context = at[order], contexts[order]
    period = np.diff(place)
    good = (context[1:] == context[:-1]) & (period >= least) & (period <= most)
    place, period = place[:-1][good], period[good]
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    # Places of one run stand at most a period apart, and contexts are longer.
    first = np.append(True, (period[1:] != period[:-1]) | (place[1:] - place[:-1] > period[1:]))[:len(place)]
    return list(zip(place[first].tolist(), period[first].tolist(), strict=True))


def find_runs(words: np.ndarray, lengths: np.ndarray) -> dict[tuple[int, int], int]:
    """{(start, end): smallest period} of the maximal stretches of at least
    MIN_LENGTH words and MIN_PERIODS periods. ``words`` holds the word numbers
    of several documents, ``lengths`` long; no stretch crosses their ends.

    Periods of a few words are read off directly. At each dyadic scale t,
    positions are chosen by their context alone, so that a run of period q
    repeats its choices q words on. For q from 1.5 t to 3 t, one is chosen in
    its first t words, and its context of 2 t or 3 t words, not shorter than
    q, is found again q words on and nowhere between. Such pairs propose
    periods; each is extended word by word, so hashes never decide a result.
    """
    ends = np.cumsum(lengths + 1)
    # An own number behind each document keeps stretches inside it.
    text = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False
    text[inside] = words
    text[ends - 1] = -1 - np.arange(len(ends))
    found: dict[tuple[int, int], int] = {}
    regions: list[np.ndarray] = []

    def keep(starts: np.ndarray, sizes: np.ndarray, periods: np.ndarray) -> None:
        """Regions of three periods mark later scales; long ones are runs."""
        regions.append(np.stack([starts, starts + sizes, periods]))
        for s, size, q in zip(*(x[sizes >= MIN_LENGTH].tolist() for x in (starts, sizes, periods)), strict=True):
            found[s, s + size] = min(q, found.get((s, s + size), q))

    for q in SMALL_PERIODS:
        starts, sizes = _stretches(text, q)
        keep(starts, sizes, np.full(len(starts), q))
    scale, longest = FIRST_SCALE, int(lengths.max(initial=0))
    doc, home = np.repeat(np.arange(len(lengths)), lengths + 1), np.arange(len(text))
    names = _mixed(text.view(np.uint64) * _A + _B)
    for width in (1, 2):  # names of windows of FIRST_SCALE words
        names = _doubled(names, width)
    while 2 * longest >= 9 * scale:  # three of the smallest period proposed here
        # Documents too short for this scale leave; words of others stay together.
        held = (2 * lengths >= 9 * scale)[doc[home]]
        home, names = home[held], names[held]
        begin, end, period = np.concatenate(regions, axis=1)
        marked = (MIN_PERIODS * period <= scale) & (end - begin >= scale)
        periodic = np.zeros(len(home) + 1, np.int64)
        np.add.at(periodic, np.searchsorted(home, begin[marked]), 1)
        np.add.at(periodic, np.searchsorted(home, end[marked] - scale + 1), -1)
        at = _synchronising(names, scale, np.cumsum(periodic[:-1]) > 0)
        wider = _doubled(names, scale)
        far = at[at + 2 * scale < len(names)]
        new = []
        for place, contexts, least, most in (
            (at, wider[at], -(-3 * scale // 2), 2 * scale),
            (far, _joined(wider[far], names[far + 2 * scale]), 2 * scale, 3 * scale),
        ):
            for i, q in _proposals(place, contexts, least, most):
                s = int(home[i])
                behind = _agreeing(text, s - 1, s - 1 + q, -1) if s else 0
                size = behind + _agreeing(text, s, s + q, 1) + q
                if size >= MIN_PERIODS * q:
                    new.append((s - behind, size, q))
        if new:
            keep(*np.array(sorted(set(new)), np.int64).T)
        names = wider
        scale *= 2
    return found


def _planted(words: np.ndarray, number: bytes) -> np.ndarray:
    """The words with a period written into every tenth document, by the
    CRC-32 of its number."""
    h, n = zlib.crc32(number), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], words[a:][np.arange(n - a) % p]])


def _digest_block(numbers: list[bytes], texts: list[bytes]) -> list[tuple]:
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    docs = [np.fromiter(map(known.__getitem__, parts), np.int64, len(parts)) for parts in (t.split() for t in texts)]
    docs = [_planted(w, k) for w, k in zip(docs, numbers, strict=True)]
    spelled = np.array(list(known), object)
    lengths = np.array([len(w) for w in docs], np.int64)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    begins = np.cumsum(lengths + 1) - lengths - 1
    for (s, e), q in find_runs(np.concatenate(docs) if docs else np.zeros(0, np.int64), lengths).items():
        d = int(np.searchsorted(begins, s, "right")) - 1
        runs[d].append((s - int(begins[d]), e - s, q))
    out = []
    for words, found in zip(docs, runs, strict=True):
        found.sort(key=lambda r: (r[0], r[2]))
        dropped = np.zeros(len(words) + 1, np.int64)
        best: tuple[int | None, int | None, int | None] = (None, None, None)
        for s, length, q in found:
            dropped[s + q] += 1
            dropped[s + length] -= 1
            if best[0] is None or length * best[2] > best[1] * q:
                best = (s, length, q)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        kept = b" ".join(spelled[words[np.cumsum(dropped[:-1]) == 0]].tolist())
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        out.append((len(found), *best, milli, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), found, kept))
    return out


_DIGESTS = pa.schema([
    ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
    ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FULL = pa.schema([*_DIGESTS, ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def _rows(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 1, 4 << 20):
            numbers = [b"" if x is None else str(x).encode() for x in batch.column(0).to_pylist()]
            texts = [t.as_py() or b"" for t in batch.column(1).cast(pa.large_binary())]
            cols = [batch.column(0), *map(list, zip(*_digest_block(numbers, texts), strict=True))]
            if "runs" in schema.names:
                cols[-2] = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in cols[-2]]
                cols[-1] = [x.decode() for x in cols[-1]]
            arrays = [pa.array(c, f.type) for c, f in zip(cols, schema, strict=False)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: its runs as (start, length, period) by start, then
    period, and its text without the words that a run repeats.

    Words stand between white space, and every tenth document by the CRC-32 of
    its number first has a period written into it. A run is a stretch of at
    least 24 words and three of its smallest period that no neighbouring word
    extends; words after its first period are dropped. Null, empty and blank
    texts have no words and no runs; a null doc_id counts as an empty text
    there (CRC 0, so a period is written). Texts are read whole, a very long
    one by itself; repeated rows give repeated rows; an empty table gives no
    rows; other columns are not read.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(_rows(_FULL), "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
                           "runs_sha256 string, collapsed_sha256 string, "
                           "runs array<struct<start: long, length: long, period: long>>, collapsed string")


def run_digests(docs: DataFrame) -> DataFrame:
    """The counts and digests of ``periodic_runs``; the run of the greatest
    exact length / period (ties: smallest start, then period) stands in its
    own columns, null where there is none."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(_rows(_DIGESTS), "doc_id long, n_runs long, start long, length long, period long, "
                           "exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def run_digests_sql(table: str = "documents") -> str:
    """The same by SQL: every pair of equal words at most a third of the text apart."""
    return f"""WITH d AS (SELECT row_number() OVER () rid, doc_id,
  list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') ws,
  CASE WHEN doc_id IS NULL THEN 0 ELSE {crc32_sql("CAST(doc_id AS VARCHAR)")} END h FROM {table}),
n AS (SELECT rid, len(ws) n, ws, h, (h // 10) % greatest(len(ws), 1) a, h // 10 g FROM d),
w AS (SELECT rid, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN ws[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] ELSE ws[i + 1] END x
  FROM (SELECT *, unnest(range(n)) i FROM n)),
e AS (SELECT u.rid, u.i, v.i - u.i q FROM w u JOIN w v ON u.rid = v.rid AND u.x = v.x AND v.i > u.i AND 3 * (v.i - u.i) <= u.n),
s AS (SELECT rid, q, min(i) s, count(*) + q l FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) k FROM e)
  GROUP BY rid, q, k HAVING count(*) + q >= greatest({MIN_LENGTH}, {MIN_PERIODS} * q)),
r AS (SELECT rid, s, l, min(q) q FROM s GROUP BY rid, s, l),
listed AS (SELECT rid, count(*) c, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) t FROM r GROUP BY rid),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY rid ORDER BY l / q DESC, s, q) = 1),
gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + l)) i FROM r),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY i) t FROM w WHERE (rid, i) NOT IN (SELECT (rid, i) FROM gone) GROUP BY rid)
SELECT doc_id, CAST(coalesce(c, 0) AS BIGINT) n_runs, b.s AS start, CAST(b.l AS BIGINT) length, b.q period,
  CAST(1000 * b.l // b.q AS BIGINT) exponent_milli, sha256(coalesce(listed.t, '')) runs_sha256, sha256(coalesce(kept.t, '')) collapsed_sha256
FROM d LEFT JOIN listed ON d.rid = listed.rid LEFT JOIN best b ON d.rid = b.rid LEFT JOIN kept ON d.rid = kept.rid"""
