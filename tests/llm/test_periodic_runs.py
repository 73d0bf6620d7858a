import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tamperscope.llm import periodic_runs as pr


def plain_runs(w):
    """Every period of every place, read off directly."""
    out = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(24, 3 * q):
                out.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain(doc_id, text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def periodic(rnd, n, letters):
    """Words with nested and neighbouring periods."""
    out = []
    while len(out) < n:
        root = [rnd.randrange(letters) for _ in range(rnd.choice([1, 2, 3, 5, 6, 7, 8, 9, 12, 13, 23, 24, 25, 31, 47, 48, 49, 96]))]
        if rnd.random() < 0.4:
            root = root * rnd.randint(2, 6) + root[:rnd.randrange(len(root) + 1)]
        body = root * rnd.randint(1, 7) + root[:rnd.randrange(len(root) + 1)]
        out += body + [rnd.randrange(letters) for _ in range(rnd.choice([0, 0, 1, 5, 30]))]
    return out[:n]


@pytest.mark.parametrize("letters", [1, 2, 3, 30])
def test_runs_of_many_words_sequences(letters):
    rnd = random.Random(letters)
    docs = [periodic(rnd, rnd.choice([0, 1, 20, 23, 24, 25, 60, 150, 400, 900]), letters) for _ in range(120)]
    docs += [[rnd.randrange(letters) for _ in range(rnd.randint(0, 300))] for _ in range(40)]
    lengths = np.array([len(d) for d in docs])
    begins = np.cumsum(lengths + 1) - lengths - 1
    got = [[] for _ in docs]
    for (s, e), q in pr.find_runs(np.array([x for d in docs for x in d], np.int64), lengths).items():
        d = int(np.searchsorted(begins, s, "right")) - 1
        got[d].append((s - int(begins[d]), e - s, q))
    want = [plain_runs(d) for d in docs]
    assert [sorted(g) for g in got] == want
    assert sum(map(len, want)) > 100


def test_every_period_at_the_least_length():
    rnd = random.Random(3)
    for q in range(1, 200):
        root = [rnd.randrange(1000) for _ in range(q)]
        before, body = [rnd.randrange(1000, 2000) for _ in range(rnd.randint(0, 50))], (root * 30)[:max(24, 3 * q)]
        doc = before + body + [5000]
        assert list(pr.find_runs(np.array(doc), np.array([len(doc)])).items()) == [((len(before), len(before) + len(body)), q)], q


def test_synchronising_positions_follow_their_context():
    rnd = np.random.default_rng(4)
    part = rnd.integers(0, 50, 3000).astype(np.uint64)
    names = pr._mixed(np.concatenate([part, part]) + np.uint64(1))
    for width in (1, 2, 4):
        names = pr._doubled(names, width)
    at = set(pr._synchronising(names, 8, np.zeros(len(names), bool)).tolist())
    assert {i for i in at if i < 2984} == {i - 3000 for i in at if 3000 <= i < 5984}
    assert all(any(j in at for j in range(i, i + 8)) for i in range(2900))


def test_query_against_brute_force(make_docs):
    rnd = random.Random(5)
    rows = [(1, None), (2, ""), (3, " \n\t\x0b"), (4, "solo"), (None, "a b c d " * 20), (None, None)]
    for i in range(150):
        words = [f"w{x}é" for x in periodic(rnd, rnd.randint(1, 500), rnd.choice([2, 40]))]
        rows.append((i * 7, "".join(w + rnd.choice([" ", "\n", "\t ", "\r\n"]) for w in words)))
    rows += [(500, "the same words again and again " * 12)] * 3
    docs = make_docs(rows)
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows)
    got = sorted((tuple(r) for r in pr.run_digests(docs).collect()), key=repr)
    assert got == sorted((plain(*r) for r in rows), key=repr)
    assert pr.run_digests(docs.limit(0)).count() == 0


def test_collapsed_text_and_a_very_long_one(make_docs):
    body = " ".join(f"v{i % 40_000}" for i in range(200_000))
    got = {r.doc_id: r for r in pr.periodic_runs(make_docs([(5, "x " + "ab cd " * 15 + "y"), (7, body)])).collect()}
    assert [tuple(r) for r in got[5].runs] == [(1, 30, 2)] and got[5].collapsed == "x ab cd y"
    assert [tuple(r) for r in got[7].runs] == [(0, 200_000, 40_000)]
    assert got[7].collapsed == " ".join(f"v{i}" for i in range(40_000))
