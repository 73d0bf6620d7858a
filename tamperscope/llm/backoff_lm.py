"""Language-model scores by a weighted backoff automaton of word n-grams."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperscope.llm import chunks
from tamperscope.llm.common import by_size, crc32_sql
from tamperscope.session import materialize

ORDER = 3
#: Weight of the shorter context's distribution against the counts of a
#: longer one, by order of the longer n-gram.
PRIOR = {2: 200.0, 3: 20.0}
#: Unseen words and ends count half.
HALF = 0.5
#: Tokens of a lane; a lane starts with the state its last words lead to.
LANE = 256

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: A blank is no word, so its hash stands for the end.
_END = xxhash.xxh64_intdigest(b" ", seed=42)

_CHUNKS = pa.schema([
    ("chunk", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
    ("lens", pa.list_(pa.int64())), ("tokens", pa.binary()), ("words", pa.binary())])
_CHUNK_ROW = "chunk long, n long, doc_ids array<long>, held array<boolean>, lens array<long>, tokens binary, words binary"


def held_out(doc_id: Column) -> Column:
    """Documents that the model doesn't learn from; a null doc_id is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _chunks(limit: int):
    """Documents as numbers into their chunk's list of word hashes; number 0 is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: defaultdict[bytes, int] = defaultdict(lambda: len(known) + 1)
        ids: list[int | None] = []
        held: list[bool] = []
        tokens: list[np.ndarray] = []
        size = index = 0

        def row() -> pa.RecordBatch:
            words = np.fromiter((xxhash.xxh64_intdigest(w, seed=42) for w in known), np.uint64, len(known))
            values = ([chunks.chunk_number(index)], [size], [ids], [held], [[len(t) for t in tokens]],
                      [chunks.pack(np.concatenate(tokens))], [chunks.pack(np.append(np.uint64(_END), words))])
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _CHUNKS, strict=True)], schema=_CHUNKS)

        for batch in by_size(batches, 2):
            for doc, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                      batch.column(2).cast(pa.large_binary()), strict=True):
                parts = (text.as_py() or b"").lower().split()
                ids.append(doc)
                held.append(out)
                tokens.append(np.append(np.fromiter(map(known.__getitem__, parts), np.int64, len(parts)), 0))
                size += len(parts) + 1
                if size >= limit:
                    yield row()
                    size, index = 0, index + 1
                    for part in (known, ids, held, tokens):
                        part.clear()
        if tokens:
            yield row()

    return run


def ngram_keys(words: np.ndarray, starts: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order from 1, the places where an n-gram ends and its hash.
    ``starts`` is each token's place in its document."""
    key = words * _A
    key = (key ^ (key >> np.uint64(32))) * _B
    out = [(np.arange(len(words)), key)]
    for k in range(1, order):
        key = np.concatenate((key[:1], key[:-1] * _A + words[1:]))
        key = (key ^ (key >> np.uint64(29))) * _B
        key = key ^ (key >> np.uint64(32))
        at = np.flatnonzero(starts >= k)
        out.append((at, key[at]))
    return out


def _places(lens: np.ndarray) -> np.ndarray:
    """Place of each token in its document."""
    ends = np.cumsum(lens)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lens, lens)


class Chunk:
    """The different n-grams of a chunk, order by order, and their counts over
    the corpus as far as they are known.

    A k-gram is asked for only where other chunks hold both (k - 1)-grams in
    it; otherwise all its places are in this chunk.
    """

    def __init__(self, row: dict, order: int, answers: pa.Table | None = None):
        self.number, self.doc_ids, self.held = row["chunk"], row["doc_ids"], row["held"]
        self.lens = np.array(row["lens"], np.int64)
        self.tokens = chunks.unpack(row["tokens"]).astype(np.int64)
        hashes = chunks.unpack(row["words"])[self.tokens]
        learnt = ~np.repeat(np.array(self.held, bool), self.lens)
        told: dict[int, list[np.ndarray]] = {}
        if answers is not None:
            answers = answers.sort_by([("kind", "ascending"), ("part", "ascending")])
            for kind, data in zip(answers["kind"].to_pylist(), answers["counts"], strict=True):
                told.setdefault(kind, []).append(chunks.unpack(data.as_py()).astype(np.int64))
        #: gram[k - 1][i]: the k-gram that ends at token i, or -1.
        self.gram: list[np.ndarray] = []
        #: Of each k-gram: its key, the end of one of its places, its counts
        #: here and over the corpus, and whether the latter is asked for.
        self.keys, self.ends, self.here, self.counts, self.asked = [], [], [], [], []
        shared = np.zeros(0, bool)
        for k, (at, keys) in enumerate(ngram_keys(hashes, _places(self.lens), order), 1):
            different, one, which = np.unique(keys, return_index=True, return_inverse=True)
            gram = np.full(len(self.tokens), -1, np.int64)
            gram[at] = which
            here = np.bincount(which[learnt[at]], minlength=len(different))
            ends = at[one]
            asked = np.ones(len(different), bool) if k == 1 else shared[self.gram[-1][ends - 1]] & shared[self.gram[-1][ends]]
            counts, shared = here.copy(), np.zeros(len(different), bool)
            if k in told:
                answer = np.concatenate(told[k])
                counts[asked], shared[asked] = answer >> 1, answer & 1 > 0
            for held, new in zip((self.gram, self.keys, self.ends, self.here, self.counts, self.asked),
                                 (gram, different, ends, here, counts, asked), strict=True):
                held.append(new)

    def request(self, bits: int) -> pa.RecordBatch:
        """Rows that ask for the longest n-grams."""
        asked = self.asked[-1]
        return chunks.request_rows(self.number, len(self.keys), self.keys[-1][asked], self.here[-1][asked], bits)


def _first_requests(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield Chunk(row, 1).request(bits)

    return run


def _further_requests(order: int, bits: int):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        return pa.Table.from_batches([Chunk(chunk.to_pylist()[0], order, answers).request(bits)])

    return run


class Automaton:
    """The n-grams of a chunk as states, arcs and failure arcs.

    A state is a learnt k-gram below the full order; state 0 is the root. The
    arc of a learnt k-gram leads from its first k - 1 words over the last to
    the longest state it ends with; its weight is log10 of

        P(w | h) = (count(h w) + prior * P(w | h')) / (count(h) + prior)

    with h' one word shorter. A word without an arc takes the failure arc of
    its state to the one a word shorter, weighing prior / (count(h) + prior).
    At the root every word has an arc, unseen ones that of count 0.
    """

    def __init__(self, part: Chunk, known: int, total: int, prior: dict[int, float] = PRIOR):
        self.gram, self.order = part.gram, len(part.gram)
        self.learnt = [c > 0 for c in part.counts]
        chance: list[np.ndarray] = []
        offset = 1
        offsets: list[int] = []
        self.weight, self.target, fail, back, depth = [], [], [np.zeros(1, np.int64)], [np.zeros(1)], [np.zeros(1, np.int64)]
        for k, (count, ends) in enumerate(zip(part.counts, part.ends, strict=True), 1):
            if k == 1:
                chance.append((count + HALF) / (total + HALF * (known + 1)))
                shorter = np.zeros(len(count), np.int64)
            else:
                context, suffix = self.gram[k - 2][ends - 1], self.gram[k - 2][ends]
                p = prior[k]
                chance.append((count + p * chance[k - 2][suffix]) / (part.counts[k - 2][context] + p))
                shorter = offsets[k - 2] + suffix
            self.weight.append(np.log10(chance[-1]))
            if k == self.order:
                self.target.append(shorter)
                break
            self.target.append(np.where(count > 0, offset + np.arange(len(count)), 0))
            fail.append(shorter)
            back.append(np.log10(prior[k + 1] / (count + prior[k + 1])))
            depth.append(np.full(len(count), k))
            offsets.append(offset)
            offset += len(count)
        #: Of each state: where its failure arc leads, its weight, and its words.
        self.fail, self.back, self.depth = np.concatenate(fail), np.concatenate(back), np.concatenate(depth)

    def step(self, state: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after reading the tokens ``at``, and the weights of the way."""
        state, weight = state.copy(), np.zeros(len(at))
        after = np.zeros(len(at), np.int64)
        left = np.arange(len(at))
        while len(left):
            depth = self.depth[state[left]]
            stay = []
            for k in range(self.order, 0, -1):
                here = left[depth == k - 1]
                if not len(here):
                    continue
                gram = self.gram[k - 1][at[here]]
                arc = np.ones(len(here), bool) if k == 1 else self.learnt[k - 1][gram] & (gram >= 0)
                go, wait = here[arc], here[~arc]
                weight[go] += self.weight[k - 1][gram[arc]]
                after[go] = self.target[k - 1][gram[arc]]
                weight[wait] += self.back[state[wait]]
                state[wait] = self.fail[state[wait]]
                stay.append(wait)
            left = np.concatenate(stay)
        return after, weight

    def scores(self, lens: np.ndarray) -> np.ndarray:
        """log10 probability of each document. Documents are read from left to
        right in lanes of LANE tokens, all lanes at a time; as a state depends
        on the last words only, a lane is led into its state by reading the
        ``order`` - 1 tokens before it unweighed."""
        ends = np.cumsum(lens)
        pieces = -(-lens // LANE)
        doc = np.repeat(np.arange(len(lens)), pieces)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = (ends - lens)[doc] + nth * LANE
        stop = np.minimum(start + LANE, ends[doc])
        place = np.maximum(start - (self.order - 1), (ends - lens)[doc])
        lane = np.argsort(place - stop, kind="stable")  # longest first
        start, stop, place, doc = start[lane], stop[lane], place[lane], doc[lane]
        state, total = np.zeros(len(lane), np.int64), np.zeros(len(lane))
        length = stop - place
        for t in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length, -t, "left"))
            at = place[:live] + t
            state[:live], weight = self.step(state[:live], at)
            total[:live] += np.where(at >= start[:live], weight, 0.0)
        first = np.argsort(lane)
        return np.bincount(doc[first], weights=total[first], minlength=len(lens))


_SCORES = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _score(order: int, known: int, total: int, prior: dict[int, float]):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        part = Chunk(chunk.to_pylist()[0], order, answers)
        machine = Automaton(part, known, total, prior)
        n = len(part.lens)
        doc, single = np.repeat(np.arange(n), part.lens), part.gram[0]
        return pa.Table.from_arrays([
            pa.array(part.doc_ids, pa.int64()), pa.array(part.held, pa.bool_()), pa.array(part.lens),
            pa.array(np.bincount(doc, weights=machine.learnt[0][single], minlength=n).astype(np.int64)),
            pa.array(np.full(n, total)), pa.array(np.bincount(doc, weights=machine.weight[0][single], minlength=n)),
            pa.array(machine.scores(part.lens)),
        ], schema=_SCORES)

    return run


def model_scores(docs: DataFrame, order: int = ORDER, prior: dict[int, float] = PRIOR, chunk: int = chunks.CHUNK,
                 key_range: int = chunks.RANGE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)
    per row of ``docs``.

    The model holds every n-gram, up to ``order`` words, of all documents but
    the held-out fifth. It is never in one place: documents are cut into
    chunks, each chunk asks for the corpus counts of its own n-grams, by
    64-bit hashes of words, and builds the part of the automaton that its
    documents can walk. Longer n-grams are asked for only where other chunks
    hold the shorter ones in them, which loses no count. Words stand between white space, A-Z in lower case;
    each document ends with an end token, and n-grams stay in a document.

    Null, empty and blank texts are one end token; a null doc_id is learnt
    from; repeated rows count and are scored each; texts are read whole, a
    very long one as a chunk of its own. With nothing learnt every token has
    the weight of an unseen one. An empty table gives no rows; other columns
    are not read.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), "text")
    made = chunks.bucketed(slim.mapInArrow(_chunks(chunk), _CHUNK_ROW), "lm-chunks")
    size = int(made.agg(F.sum("n")).head()[0] or 0)
    bits = chunks.range_bits(size, key_range)
    answers = materialize(chunks.counted(made.mapInArrow(_first_requests(bits), chunks.REQUESTS), bits), "lm-counts")
    known, total = chunks.sums(answers)
    each = made.groupBy("chunk")
    for k in range(2, order + 1):
        asked = each.cogroup(answers.groupBy("chunk")).applyInArrow(_further_requests(k, bits), chunks.REQUESTS)
        more = chunks.counted(asked, bits)
        answers = answers.unionByName(more if k == order else materialize(more, "lm-counts"))
    return each.cogroup(answers.groupBy("chunk")).applyInArrow(
        _score(order, known, total, dict(prior)),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def model_scores_sql(table: str = "documents", order: int = ORDER, prior: dict[int, float] = PRIOR) -> str:
    """The same by SQL on strings: n-grams are counted and joined, and the
    smoothing is written out. Words carry a leading w, so that none is the end."""
    held = f"(doc_id IS NOT NULL AND {crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 1)"
    upper = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    words = f"list_filter(string_split_regex(translate(coalesce(text, ''), {upper}), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    key = [f"w{k}" for k in range(order)]  # w0 is the word, w1 the one before
    counts, joins, p = [], [], f"(coalesce(n1.c, 0) + {HALF}) / (big.n + {HALF} * (big.v + 1))"

    def grams(name: str, lo: int, hi: int) -> None:
        """Counts of the learnt words lo to hi back, and their join."""
        cols = ", ".join(key[lo:hi])
        counts.append(f"{name} AS (SELECT {cols}, count(*) c FROM t WHERE NOT held AND {key[hi - 1]} IS NOT NULL GROUP BY ALL)")
        joins.append(f"LEFT JOIN {name} ON " + " AND ".join(f"t.{x} = {name}.{x}" for x in key[lo:hi]))

    grams("n1", 0, 1)
    for k in range(2, order + 1):
        grams(f"n{k}", 0, k)
        grams(f"h{k}", 1, k)
        p = f"(CASE WHEN t.w{k - 1} IS NULL THEN {p} ELSE (coalesce(n{k}.c, 0) + {prior[k]} * {p}) / (coalesce(h{k}.c, 0) + {prior[k]}) END)"
    lags = ", ".join(f"lag(w0, {k}) OVER o w{k}" for k in range(1, order)) or "1"
    return f"""WITH d AS (SELECT row_number() OVER () rid, doc_id, {held} held, list_append(list_transform({words}, lambda w: 'w' || w), 'end') ws
  FROM {table}),
t AS (SELECT rid, held, w0, {lags} FROM (SELECT rid, held, unnest(ws) w0, generate_subscripts(ws, 1) i FROM d)
  WINDOW o AS (PARTITION BY rid ORDER BY i)),
{", ".join(counts)},
big AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) n, count(*) v FROM n1),
s AS (SELECT rid, count(*) n_tokens, CAST(count(n1.c) AS BIGINT) n_known,
  sum(log10((coalesce(n1.c, 0) + {HALF}) / (big.n + {HALF} * (big.v + 1)))) base_score, sum(log10({p})) score
  FROM t CROSS JOIN big {" ".join(joins)} GROUP BY rid)
SELECT doc_id, held held_out, n_tokens, n_known, big.n train_tokens, base_score, score FROM d JOIN s ON d.rid = s.rid CROSS JOIN big"""
