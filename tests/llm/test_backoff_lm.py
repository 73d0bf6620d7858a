import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tamperscope.llm import backoff_lm as lm
from tamperscope.llm import chunks

END = object()


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + [END]


class Plain:
    """Counters of all n-grams and the recursion of the smoothing."""

    def __init__(self, texts, order, prior):
        self.order, self.prior = order, prior
        self.counts = Counter()
        for t in texts:
            w = tokens(t)
            for k in range(1, order + 1):
                self.counts.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
        self.total = sum(n for g, n in self.counts.items() if len(g) == 1)
        self.known = sum(len(g) == 1 for g in self.counts)

    def p(self, word, history):
        if not history:
            return (self.counts[word,] + 0.5) / (self.total + 0.5 * (self.known + 1))
        k = self.prior[len(history) + 1]
        return (self.counts[*history, word] + k * self.p(word, history[1:])) / (self.counts[history] + k)

    def score(self, text):
        w = tokens(text)
        return sum(math.log10(self.p(x, tuple(w[max(0, i - self.order + 1):i]))) for i, x in enumerate(w))

    def base(self, text):
        return sum(math.log10(self.p(x, ())) for x in tokens(text))


def out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def corpus():
    rnd = random.Random(8)
    vocab = [f"wört{i}" for i in range(40)]
    rows = [(1, None), (2, ""), (3, " \n\x0b\t"), (4, "Solo"), (None, "a b a b c"), (None, None), (5, "never seen words " * 3)]
    for i in range(120):
        size = rnd.choice([1, 2, 3, 30, 200])
        rows.append((10 + i, " ".join(rnd.choice(vocab[:rnd.choice([3, 40])]).upper() for _ in range(size))))
    rows += [(500, "same same text")] * 3 + [(900 + i, " ".join(f"z{i}_{j}" for j in range(20))) for i in range(6)]
    return rows + [(700, " ".join(rnd.choice(vocab) for _ in range(5000)))]


@pytest.mark.parametrize(("order", "chunk", "key_range"), [(3, 300, 64), (3, chunks.CHUNK, chunks.RANGE), (2, 100, 1000), (1, 500, 100)])
def test_scores_against_counters(make_docs, order, chunk, key_range):
    rows = corpus()
    model = Plain([t for i, t in rows if not out(i)], order, lm.PRIOR)
    got = sorted(lm.model_scores(make_docs(rows), order, chunk=chunk, key_range=key_range).collect(), key=repr)
    want = sorted(((i, out(i), len(tokens(t)), sum(model.counts[w,] > 0 for w in tokens(t)), model.total, t) for i, t in rows),
                  key=lambda r: repr(r[:5]))
    assert any(r[1] for r in want) and any(r[3] < r[2] for r in want)
    key = lambda r: tuple(r[:5])
    assert sorted(map(repr, map(key, got))) == sorted(map(repr, map(key, want)))
    by_key = {}
    for r in want:
        by_key.setdefault(key(r), []).append((model.base(r[5]), model.score(r[5])))
    for k, v in by_key.items():
        found = sorted((r.base_score, r.score) for r in got if key(r) == k)
        assert np.allclose(found, sorted(v), rtol=1e-10, atol=1e-10)


def test_probabilities_sum_to_one():
    model = Plain([t for i, t in corpus() if not out(i)], 3, lm.PRIOR)
    words = [g[0] for g in model.counts if len(g) == 1] + ["no such word"]
    for history in [(), ("wört1",), ("wört1", "wört2"), ("no such word", "wört1"), ("never", "seen")]:
        assert abs(sum(model.p(w, history) for w in words) - 1) < 1e-9


def test_automaton_follows_failure_arcs():
    # Learnt: "a b c" and "b d"; read: "a b d", where d follows b but not "a b".
    words = np.array([1, 11, 12, 13, 14], np.uint64)
    tokens = np.array([1, 2, 3, 0, 2, 4, 0, 1, 2, 4, 0])
    part = lm.Chunk({"chunk": 0, "doc_ids": [0, 1, 2], "held": [False, False, True], "lens": [4, 3, 4],
                     "tokens": chunks.pack(tokens), "words": chunks.pack(words)}, 3)
    machine = lm.Automaton(part, 5, 7, {2: 2.0, 3: 1.0})
    state, depths, weights = np.zeros(1, np.int64), [], []
    for i in (7, 8, 9):
        state, w = machine.step(state, np.array([i]))
        depths.append(int(machine.depth[state[0]]))
        weights.append(w[0])
    p1 = (1 + 0.5) / (7 + 0.5 * 6)
    p2 = (1 + 2.0 * p1) / (2 + 2.0)
    assert depths == [1, 2, 2] and np.isclose(weights[2], math.log10(1.0 / (1 + 1.0)) + math.log10(p2))


def test_packing():
    rnd = np.random.default_rng(2)
    for x in ([], [0], [5, 0, 1 << 40], rnd.integers(0, 1 << 63, 1000)):
        assert (chunks.unpack(chunks.pack(np.array(x, np.uint64))) == np.array(x, np.uint64)).all()


def test_nothing_learnt_and_no_rows(make_docs):
    rows = [(i, "a b") for i in range(200) if out(i)][:5]
    got = lm.model_scores(make_docs(rows)).collect()
    assert len(got) == 5 and all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in got)
    assert lm.model_scores(make_docs(rows).limit(0)).count() == 0
