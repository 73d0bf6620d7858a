"""Document quality by attention over passages (multiple-instance learning)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperscope.llm.common import by_size

#: Words of a passage.
PASSAGE = 128
THRESHOLD = 0.3
#: The model is fitted on at most so many labelled documents, of at most so
#: many bytes each; scores read whole texts.
TRAIN_DOCUMENTS = 4000
TRAIN_BYTES = 20_000
SEED = 11

_SINGLES, _PAIRS = 129, 255
WIDTH = _SINGLES + _PAIRS + 4
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of texts scored at a time, and bytes and texts of them encoded at a
#: time: a text has a passage at least.
_SLICE = 1 << 19
_PART = 1 << 17
_ROWS = 1000


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every text, and each text's first passage.

    A passage is PASSAGE consecutive words: roots of the shares of its bytes
    and of hashed byte pairs (white space before a word as one byte), the
    shares of different words and of words equal to the one before, word
    length, and size. A text without words has one passage of zeros. A
    passage depends on its own words alone.
    """
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    space = _SPACE[data]
    before = np.concatenate(([True], space[:-1]))
    begins = ~space & before
    starts = np.flatnonzero(begins)
    owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    per_text = np.bincount(owner, minlength=len(texts))
    rank = np.arange(len(starts)) - (np.cumsum(per_text) - per_text)[owner]
    passages = np.maximum(1, -(-per_text // PASSAGE))
    first = np.cumsum(passages) - passages
    total = int(passages.sum())
    of_word = first[owner] + rank // PASSAGE
    word = np.cumsum(begins) - 1
    solid = np.flatnonzero(~space)
    place = of_word[word[solid]] if len(solid) else np.zeros(0, np.int64)
    current = data[solid].astype(np.int64)
    previous = np.where(before[solid], 0x20, data[np.maximum(solid - 1, 0)]).astype(np.int64)
    out = np.zeros((total, WIDTH), np.float32)
    count = np.bincount(place, minlength=total).astype(np.float32)
    safe = np.maximum(count, 1)[:, None]
    single = np.bincount(place * _SINGLES + np.minimum(current, _SINGLES - 1), minlength=total * _SINGLES)
    out[:, :_SINGLES] = np.sqrt(single.reshape(total, _SINGLES) / safe)
    pair = np.bincount(place * _PAIRS + (previous * 263 + current * 71) % _PAIRS, minlength=total * _PAIRS)
    out[:, _SINGLES:_SINGLES + _PAIRS] = np.sqrt(pair.reshape(total, _PAIRS) / safe)
    words = np.bincount(of_word, minlength=total).astype(np.float32)
    if len(starts):
        # A word's hash mixes its bytes with their places in the word.
        offset = (solid - starts[word[solid]]).astype(np.uint64)
        mixed = (current.astype(np.uint64) + np.uint64(1)) * (offset * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD6E8FEB86659FD93))
        mixed ^= mixed >> np.uint64(29)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed * np.uint64(0xBF58476D1CE4E5B9), dtype=np.uint64)))
        edges = np.concatenate((np.searchsorted(solid, starts), [len(solid)]))
        hashes = sums[edges[1:]] - sums[edges[:-1]]
        order = np.lexsort((hashes, of_word))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
        out[:, -4] = np.bincount(of_word[order][fresh], minlength=total) / np.maximum(words, 1)
        again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])) + 1
        out[:, -3] = np.bincount(of_word[again], minlength=total) / np.maximum(words, 1)
    out[:, -2] = count / np.maximum(words, 1) / 10
    out[:, -1] = np.log1p(words) / np.log1p(PASSAGE)
    return out, first


def bounded(texts: Iterable[bytes], size: int, number: int) -> Iterator[list[bytes]]:
    """``texts``, in order, in lists that end once they hold so many bytes or texts."""
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text)
        if held >= size or len(part) >= number:
            yield part
            part, held = [], 0
    if part:
        yield part


def encode_in_parts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """As ``encode``, a bounded part of the texts at a time."""
    made = [encode(part) for part in bounded(texts, _PART, _ROWS)]
    begins = np.cumsum([0, *(len(x) for x, _ in made)])
    return np.concatenate([x for x, _ in made]), np.concatenate([first + at for (_, first), at in zip(made, begins, strict=False)])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Passage encoder, gated attention and classifier."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    prior: float

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * s) @ p["w"]
        bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        a = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a /= np.add.reduceat(a, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "bag": bag, "y": _sigmoid(z @ p["c"] + p["d"])}

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), self.prior)
        x, first = encode_in_parts(texts)
        return self.forward((x - self.mean) / self.scale, first)["y"]


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 25, hidden: int = 32, gate: int = 16,
        batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = SEED) -> Model:
    """Model of bags of passages; with one class only, its share."""
    prior = float(labels.mean()) if len(labels) else 0.5
    none = np.zeros(WIDTH, np.float32)
    if prior in (0.0, 1.0) or not len(labels):
        return Model(none, none + 1, {}, prior)
    random = np.random.default_rng(seed)
    rows = np.concatenate(bags)
    mean, scale = rows.mean(0), rows.std(0) + 0.02
    bags = [(b - mean) / scale for b in bags]
    p = {"W": random.normal(0, WIDTH**-0.5, (WIDTH, hidden)), "b": np.zeros(hidden),
         "V": random.normal(0, hidden**-0.5, (hidden, gate)), "U": random.normal(0, hidden**-0.5, (hidden, gate)),
         "w": random.normal(0, gate**-0.5, gate), "c": random.normal(0, hidden**-0.5, hidden), "d": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    model = Model(mean, scale, p, prior)
    first_moment = {k: np.zeros_like(v) for k, v in p.items()}
    second_moment = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for epoch in range(epochs):
        order = random.permutation(len(bags))
        for lo in range(0, len(order), batch):
            chosen = order[lo:lo + batch]
            x = np.concatenate([bags[i] for i in chosen])
            sizes = np.array([len(bags[i]) for i in chosen])
            starts = np.cumsum(sizes) - sizes
            f = model.forward(x, starts)
            h, t, s, a, bag = f["h"], f["t"], f["s"], f["a"], f["bag"]
            dy = ((f["y"] - labels[chosen]) / len(chosen)).astype(np.float32)
            dz = dy[bag, None] * p["c"]
            da = (dz * h).sum(1)
            de = a * (da - np.add.reduceat(a * da, starts)[bag])
            dg = de[:, None] * p["w"]
            dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
            dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
            slopes = {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de,
                      "c": f["z"].T @ dy, "d": dy.sum(keepdims=True)}
            step += 1
            pace = rate * (1 - 0.9 * epoch / epochs)
            for k, slope in slopes.items():
                slope = slope + decay * p[k]
                first_moment[k] = 0.9 * first_moment[k] + 0.1 * slope
                second_moment[k] = 0.999 * second_moment[k] + 0.001 * slope * slope
                p[k] -= pace * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second_moment[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: one fifth by checksum, and those
    without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, documents: int = TRAIN_DOCUMENTS, max_bytes: int = TRAIN_BYTES) -> Model:
    """Model of a bounded sample of labelled documents, the same at each run:
    the first by a hash of doc_id of those not held out. Of several labels of
    a document the lowest counts, null ones do not."""
    known = labels.where("quality IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("label"))
    known = known.select(F.col("doc_id").cast("long").alias("label_id"), F.col("label").cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("label_id", F.lit(SEED)), "label_id").limit(documents)
    texts = docs.select(F.col("doc_id").cast("long").alias("label_id"), "text").where(
        F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, 2, _PART):
            x, first = encode([t.as_py() or b"" for t in batch.column(2).cast(pa.large_binary())])
            ends = [*first[1:].tolist(), len(x)]
            bags = [x[a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.binary())], ["label_id", "label", "bag"])

    # The sample is a bounded number of ids and labels.
    chosen = texts.join(F.broadcast(sample), "label_id").select("label_id", "label", "text")
    rows = chosen.mapInArrow(run, "label_id long, label int, bag binary").collect()
    rows.sort(key=lambda r: (r["label_id"], bytes(r["bag"])))
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, WIDTH) for r in rows]
    return fit(bags, np.array([r["label"] for r in rows], np.float32))


def score(text: Column, model: Model, spark) -> Column:
    """Score of a whole text, 0 to 1; a null text is an empty one."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = (t.as_py() or b"" for t in batch.cast(pa.large_binary()))
            out = [np.zeros(0), *(shared.value.scores(part) for part in bounded(texts, _SLICE, len(batch)))]
            yield pa.array(np.concatenate(out).astype(float))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(text)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``; only texts
    are read to score. Null and empty texts get the score of a text without
    words; a null doc_id and repeated rows are kept; without labels of both
    classes the score is their mean, or 0.5."""
    model = train(docs, labels)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text"), model, docs.sparkSession).alias("score"))
    return slim.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                       (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    model = train(docs, labels)
    rows = docs.select(F.struct("*").alias("row"), score(F.col("text"), model, docs.sparkSession).alias("score"))
    return rows.where(F.col("score") >= THRESHOLD).select("row.*")
