"""Byte-level BPE: encoding by backtracking over longest matches, and decoding."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamperscope.llm.common import by_size

#: Pieces and token pairs remembered by a worker; memory stays bounded.
REMEMBERED = 1 << 18
_FAR = 1 << 62


class Codec:
    """Exact byte-pair merges for one rank file.

    A token sequence is the one that the merges make exactly if each of its
    neighbouring pairs is: so the encoder takes the longest token that starts
    at a position and fits its neighbour, and steps back where none does. A
    position that was left once is never entered again, which makes it linear.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            # Bytes as Latin-1 characters, one for one.
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte. Found
        by merging its bytes as long as a lower rank is there."""
        if token not in self.halves:
            parts = [bytes([b]) for b in self.tokens[token]]
            while len(parts) > 2:
                found = [self.ranks.get(a + b, _FAR) for a, b in zip(parts, parts[1:], strict=False)]
                at = found.index(min(found))
                if found[at] >= token:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) > 2:
                raise ValueError(f"token {token} is not made by merges")
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def _edge(self, token: int, side: int) -> list[int]:
        """Tokens at one end of ``token`` as it grows, its outer byte first."""
        chain = [token]
        while (pair := self.split(chain[-1])) is not None:
            chain.append(pair[side])
        return chain[::-1]

    def fit(self, left: int, right: int) -> bool:
        """Whether the merges of left + right give these two tokens.

        Both grow towards their border. At each moment the pieces that touch
        there would merge if their joint rank came before the next merge of
        the left piece, or no later than the next one of the right piece (of
        equal ranks the leftmost merges first).
        """
        known = self.fits.get((left, right))
        if known is not None:
            return known
        xs, ys = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        result = True
        while True:
            x_next = xs[i + 1] if i + 1 < len(xs) else _FAR
            y_next = ys[j + 1] if j + 1 < len(ys) else _FAR
            joint = self.ranks.get(self.tokens[xs[i]] + self.tokens[ys[j]])
            if joint is not None and joint < x_next and joint <= y_next:
                result = False
                break
            if x_next == y_next == _FAR:
                break
            if x_next <= y_next:
                i += 1
            else:
                j += 1
        if len(self.fits) >= REMEMBERED:
            self.fits.clear()
        self.fits[left, right] = result
        return result

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        starts: list[list[int]] = [[] for _ in range(n + 1)]
        sizes = self.sizes
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            starts[end + 1 - sizes[token]].append(token)  # shorter ones first
        out: list[int] = []
        picks: list[int] = []
        left = bytearray(n + 1)
        at, pick = 0, len(starts[0]) - 1
        while at < n:
            options = starts[at]
            while pick >= 0:
                token = options[pick]
                if not left[at + sizes[token]] and (not out or self.fit(out[-1], token)):
                    break
                pick -= 1
            if pick >= 0:
                out.append(token)
                picks.append(pick)
                at += sizes[token]
                pick = len(starts[at]) - 1
            else:
                left[at] = 1
                at -= sizes[out.pop()]
                pick = picks.pop() - 1
        return out

    def encode(self, text: str, pattern: regex.Pattern) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        pieces = self.pieces
        out = []
        for piece in pattern.findall(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = np.array(self.encode_piece(piece.encode()), "<u4").tobytes()
                if len(piece) < 64:
                    if len(pieces) >= REMEMBERED:
                        pieces.clear()
                    pieces[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks by token, from lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


_CODECS: dict[int, Codec] = {}


def _codec(content: bytes) -> Codec:
    key = hash(content)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(parse_ranks(content))
    return _CODECS[key]


def _ranks_file(df: DataFrame, path: str):
    """The rank file, read on the driver and broadcast: its size is that of
    the vocabulary, whatever the input."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encoded(batches: Iterator[pa.RecordBatch], content: bytes, pattern: str) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) of batches of (doc_id, text), for a rank file's content."""
    codec, pieces = _codec(content), regex.compile(pattern)
    for batch in by_size(batches, 1):
        ids = [codec.encode(t.as_py() or "", pieces) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])


def decoded(batches: Iterator[pa.RecordBatch], content: bytes) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids, bytes) of batches of (doc_id, ids)."""
    codec = _codec(content)
    for batch in by_size(batches, 1):
        texts = [codec.decode(t.as_py() or b"") for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.binary())], ["doc_id", "ids", "bytes"])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) per row of ``docs``: ids is a binary of little-endian
    unsigned 32-bit token ids of the whole text, each match of ``pattern``
    merged by itself, without special tokens. A null text is an empty one; a
    null doc_id and repeated rows are kept; other columns are not read."""
    ranks = _ranks_file(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return encoded(batches, ranks.value, pattern)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, bytes): the bytes of each row's ids, without loss. Null
    ids give no bytes."""
    ranks = _ranks_file(ids, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return decoded(batches, ranks.value)

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, bytes binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token count, and digests of the ids and of the decoded bytes. One worker
    encodes and decodes, so that a task holds the vocabulary once."""
    ranks = _ranks_file(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return decoded(encoded(batches, ranks.value, pattern), ranks.value)

    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, bytes binary")
    return both.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
