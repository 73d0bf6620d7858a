"""Secret scan: keyword automaton, anchored expressions at its hits, checksums."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamperscope.llm.common import by_size

#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "checked")
BASE_KINDS = KINDS[:3]

_ASSIGN = re.compile(
    rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
# Prefixed tokens: 30 characters and a base-62 CRC-32 of them in 6 digits.
_CHECKED = re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
#: What a hit of each keyword may begin.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "checked", "gho_": "checked", "ghu_": "checked", "ghs_": "checked", "ghr_": "checked", "npm_": "checked",
}
_DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum(body: bytes) -> bytes:
    """CRC-32 in six base-62 digits."""
    value, out = zlib.crc32(body), b""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = _DIGITS[digit:digit + 1] + out
    return out


def _automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        made.add_word(word, (len(word), kind))
    made.make_automaton()
    return made


def find_spans(data: bytes, words: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, by start and then kind.

    The automaton reads lower-cased bytes as Latin-1 and names the places
    where an expression may begin; expressions are anchored there and tried
    left to right, so a match hides the hits inside it, as in a full scan.
    Runs of hexadecimal digits have no keyword and are found by their class.
    """
    found: list[tuple[int, int, str]] = []
    hits = sorted((end + 1 - size, kind) for end, (size, kind) in words.iter(data.lower().decode("latin-1")))
    done = dict.fromkeys(KINDS, 0)
    for at, kind in hits:
        if at < done[kind]:
            continue
        if kind == "assign":
            m = _ASSIGN.match(data, at)
            good = m is not None and len(m[1]) >= 6
        elif kind == "access":
            m = _ACCESS.match(data, at)
            good = m is not None and m.end() - at >= 20
        else:
            m = _CHECKED.match(data, at)
            good = m is not None and checksum(m[1]) == m[2]
        if m is not None:
            done[kind] = m.end()
            if good:
                found.append((at, m.end(), kind))
    found += [(*m.span(), "hex") for m in _HEX.finditer(data)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _code_points(data: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Byte offsets as code point offsets; the text is read once."""
    if len(data) == 0 or data.isascii():
        return spans
    places: dict[int, int] = {}
    last = count = 0
    for at in sorted({p for s in spans for p in s[:2]}):
        count += len(data[last:at].decode())
        places[at], last = count, at
    return [(places[a], places[b], kind) for a, b, kind in spans]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) per row of ``docs``: spans is an array of (kind, start,
    end) over the whole text in code points, end exclusive, by start and then
    kind. Null and empty texts have none; a null doc_id and repeated rows are
    kept; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _automaton()
        for batch in by_size(batches, 1):
            out = []
            for value in batch.column(1).cast(pa.large_binary()):
                data = value.as_py() or b""
                out.append([{"kind": k, "start": a, "end": b} for a, b, k in _code_points(data, find_spans(data, words))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(_SPAN))], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def span_digests(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds and the spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scan(docs).select(
        "doc_id", *[count(k) for k in BASE_KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))
