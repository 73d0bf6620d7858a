import random
from collections import Counter

import numpy as np
import pytest

from tamperscope.llm import mixing


def corpus():
    rnd = random.Random(1)
    rows = [(i, " ".join(f"w{rnd.randint(0, 99)}" for _ in range(rnd.randint(0, 300))), rnd.choice(["b", "b", "b", "a", "ç", None]))
            for i in range(150)]
    return rows + [(200, None, "a"), (201, " \n", "z"), (None, "no id " * 40, "b"), (5, rows[5][1], rows[5][2]), (300, "long " * 20_000, "b")]


def test_targets():
    assert mixing.target_sizes([], []) == []
    assert mixing.target_sizes([10, 10], [1, 1]) == [10.0, 10.0]
    assert mixing.target_sizes([10, 100, 100], [100, 1, 1]) == pytest.approx([30, 90, 90])
    assert mixing.target_sizes([0, 8], [3, 1]) == [0.0, 8.0]
    sizes, weights = [5, 50, 500, 20], [1, 2, 3, 1]
    got = mixing.target_sizes(sizes, weights)
    assert sum(got) == pytest.approx(sum(sizes)) and all(t <= 3 * s + 1e-9 for t, s in zip(got, sizes, strict=True))


def test_draws_meet_their_targets():
    slots = [0, 1000, 37, 5000]
    draws = mixing.shard_draws(slots, 256)
    assert [sum(n for s, _, _, n in draws if s == i) for i in range(4)] == slots
    shards = Counter()
    for s, shard, first, n in draws:
        shards[shard] += n
        assert first == sum(m for t, sh, _, m in draws if t == s and sh < shard)
    assert set(list(shards.values())[:-1]) == {256}
    assert mixing.shard_draws([], 9) == []


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_each_round_is_a_permutation(n):
    k = np.arange(3 * n)
    got = mixing.permuted(k, np.full(3 * n, n), np.full(3 * n, 4))
    for r in range(3):
        assert sorted(got[r * n:(r + 1) * n].tolist()) == list(range(n))
    if n > 60:
        assert got[:n].tolist() != got[n:2 * n].tolist() and (got[:n] != np.arange(n)).mean() > 0.8


def test_query(make_docs):
    rows = corpus()
    docs = make_docs(rows)
    got = [tuple(r) for r in mixing.mix_report(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, (tuple(r) for r in mixing.mix_report(make_docs(rows, 5)).collect())))
    words = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in {r[2] for r in rows}}
    names = sorted(words, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.target_sizes([words[s] for s in names], [1 + i % 3 for i in range(len(names))]), strict=True))
    source = {r[0]: r[2] for r in rows}
    assert sorted(str(g[0]) for g in got) == sorted(str(r[0]) for r in rows)
    taken = Counter()
    for doc_id, size, source_size, target, t in got:
        s = source[doc_id]
        assert size in {len((x[1] or "").split()) for x in rows if x[0] == doc_id}
        assert (source_size, target) == (words[s], pytest.approx(want[s])) and 0 <= t <= 3 * size
        taken[s] += t
    for s in names:
        assert abs(taken[s] - want[s]) <= 1.5 * mixing.BLOCK
    assert mixing.mix_report(docs.limit(0)).count() == 0


def test_stage_gives_the_words_that_are_taken(make_docs):
    rows = [r for r in corpus() if r != (5, *corpus()[5][1:])] + [corpus()[5]]
    docs = make_docs(rows)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    made = Counter()
    for r in out.collect():
        assert r.n_chars == len(r.text)
        made[r.doc_id] += len(r.text.split())
    assert made == Counter({r.doc_id: r.taken for r in mixing.mix_report(docs).collect() if r.taken})
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
