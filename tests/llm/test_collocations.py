import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from tamperscope.llm import collocations as co
from tamperscope.llm import quotient_filter as qf


def plain(rows, least=co.LEAST, top=co.TOP):
    f = Counter()
    for lang, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for k in (1, 2, 3):
                f.update((lang or "und", *w[i:i + k]) for i in range(len(w) - k + 1))
    cand = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    held = {}
    for g, a in cand.items():
        if len(g) == 4:
            for part in (g[:3], (g[0], *g[2:])):
                held[part] = max(held.get(part, 0), a)
    out = []
    for g, a in cand.items():
        if 100 * held.get(g, 0) >= co.SHARE * a:
            continue
        cuts = [(1_000_000 * a * a // (f[g[:k + 1]] * f[(g[0], *g[k + 1:])]), k) for k in range(1, len(g) - 1)]
        s, k = min(cuts)
        out.append((g[0], " ".join(g[1:]), a, f[g[:k + 1]], f[(g[0], *g[k + 1:])], s))
    total = Counter()
    for g, a in f.items():
        total[g[0]] += a if len(g) == 2 else 0
    done = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[5], -r[2], r[1].encode()))[:top]
        done += [(lang, i, p, a, left, r, total[lang], s) for i, (_, p, a, left, r, s) in enumerate(mine, 1)]
    return sorted(done)


def corpus():
    rnd = random.Random(21)
    vocab = [f"wört{i}" for i in range(25)] + ["NEW", "york", "city", "\x00", "a b"]
    rows = [("en", None), ("en", ""), (None, " \t\n .,;"), (None, "only here"), ("xx", "Ω " * 40)]
    for _ in range(400):
        words = [rnd.choice(vocab[:rnd.choice([6, 30])]) for _ in range(rnd.randint(1, 90))]
        for _ in range(rnd.randrange(3)):
            words[rnd.randrange(len(words)):0] = rnd.choice([["new", "York", "city"], ["la", "la", "la", "la"], ["wört1", "wört2"]])
        text = "".join(w + rnd.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\r\n", "\x0b"]) for w in words)
        rows.append((rnd.choice(["en", "en", "de", None, "und"]), text))
    return rows + [("en", "same phrase again")] * 30 + [("de", "lang " * 6000)]


@pytest.mark.parametrize(("chunk", "key_range"), [(400, 100), (co.chunks.CHUNK, co.chunks.RANGE)])
def test_phrases_against_counters_and_sql(spark, chunk, key_range):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, lang, "w", 1) for i, (lang, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, word string, n long").repartition(3)
    want = plain(rows)
    assert len(want) > 100 and any(r[2].count(" ") == 2 for r in want)
    assert sorted(map(tuple, co.collocations(docs, chunk=chunk, key_range=key_range).collect())) == want
    if chunk == 400:
        few = sorted(map(tuple, co.collocations(docs, top=7, chunk=chunk).collect()))
        assert few == plain(rows, top=7) and len(few) < len(want)
        frame = pd.DataFrame(rows, columns=["lang", "text"])  # noqa: F841  read by name
        assert sorted(duckdb.sql(co.collocations_sql("frame")).fetchall()) == want
        assert co.collocations(docs.limit(0)).count() == 0
        assert co.collocations(docs.where("doc_id < 4")).count() == 0


@pytest.mark.parametrize("half", [1, 3, 17, 32, 33, 45, 63])
def test_filters_keep_every_key_and_count(half):
    rnd = np.random.default_rng(half)
    n = min(3000, 1 << half)
    keys = [rnd.integers(0, 1 << half, n, np.uint64) for _ in range(2)]
    high, low = qf.permute(*keys, half)
    assert all((a == b).all() for a, b in zip(qf.restore(high, low, half), keys, strict=True))
    counts = rnd.choice([1, 1, 1, 2, 3, 200, 70_000, 1 << 45], n)
    plain_counts = Counter()
    for h, x, c in zip(high.tolist(), low.tolist(), counts.tolist(), strict=True):
        plain_counts[h, x] += c
    shared = min(2, half - 1)
    parts = []
    for prefix in range(1 << shared):
        inside = (high >> np.uint64(half - shared)) == prefix if shared else np.ones(n, bool)
        thirds = [np.flatnonzero(inside)[i::3] for i in range(3)]
        made = [qf.QuotientFilter.of(*qf.counted(high[t], low[t], counts[t], half), half, shared) for t in thirds if len(t)]
        if made:
            parts.append(qf.merged([qf.QuotientFilter.from_bytes(m.to_bytes()) for m in made]))
    got = {(h, x): c for p in parts for h, x, c in zip(*(v.tolist() for v in p.entries()), strict=True)}
    assert got == plain_counts
    some = list(plain_counts)[:50]
    assert all(sum(p.count(*k) for p in parts) == plain_counts[k] for k in some)
    assert all(sum(p.count(h ^ 1, x) for p in parts) == plain_counts[h ^ 1, x] for h, x in some)


def test_filters_are_compact():
    rnd = np.random.default_rng(1)
    high, low = qf.permute(*(rnd.integers(0, 1 << 20, 100_000, np.uint64) for _ in range(2)), 20)
    data = qf.QuotientFilter.of(*qf.counted(high, low, None, 20), 20).to_bytes()
    assert len(data) < 100_000 * (40 - 17 + 6) / 8


@pytest.mark.parametrize("width", [1, 2, 7, 21, 22, 42])
def test_phrases_pack_and_unpack(width):
    rnd = np.random.default_rng(width)
    for size in (2, 3):
        words = [rnd.integers(0, 1 << width, 100, np.uint64) for _ in range(size)]
        high, low, half = co.packed(words, width)
        assert half <= 63 and all(int(x.max()) < 1 << half for x in (high, low))
        assert all((a == b).all() for a, b in zip(co.unpacked(high, low, width, size), words, strict=True))
