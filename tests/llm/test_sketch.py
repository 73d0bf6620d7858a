import hashlib
import random

import numpy as np

from tamperscope.llm import sketch as sk


def grams(text, n=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return set()
    return {" ".join(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {" ".join(words)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus():
    rnd = random.Random(6)
    vocab = [f"w{i}é" for i in range(400)]
    texts = [None, "", " \n", "one", "One two", "日本 語", "a b c d e f g"]
    for _ in range(80):
        texts.append(rnd.choice([" ", "  ", "\n"]).join(rnd.choice(vocab) for _ in range(rnd.randint(1, 500))))
    return texts + [texts[30]] * 5 + ["lorem ipsum " * 60_000]


def test_one_hash_per_distinct_shingle():
    seen = {}
    for text in corpus():
        text = text or ""
        hashes = set(sk.shingle_hashes(text.encode()).tolist())
        assert len(hashes) == len(grams(text))
        for h in hashes:
            assert seen.setdefault(h, None) is None
    a, b = sk.shingle_hashes(b"  One\ttwo three four FIVE six"), sk.shingle_hashes(b"one two three four five\n six ")
    assert a.tolist() == b.tolist()
    assert sk.sketch(b"x y z " * 9000).tolist() == sorted(set(sk.shingle_hashes(b"x y z " * 9000).tolist()))


def test_estimates():
    words = [f"v{i}" for i in range(4000)]
    a, b = " ".join(words[:3000]), " ".join(words[1000:])
    x, y = sk.sketch(a.encode()), sk.sketch(b.encode())
    assert abs(sk.resemblance(x, y) - jaccard(grams(a), grams(b))) < 0.13
    assert abs(sk.distinct_count(x) / len(grams(a)) - 1) < 0.3
    part = sk.sketch(" ".join(words[:1500]).encode())
    assert sk.containment(part, x) > 0.75 > sk.containment(x, part)
    assert sk.resemblance(sk.sketch(b""), sk.sketch(None)) == 1.0
    assert sk.resemblance(sk.sketch(b""), x) == 0.0
    assert sk.from_text(sk.to_text(x)).tolist() == x.tolist()


def test_merged_parts_are_the_sketch_of_the_whole(spark):
    words = [f"u{i}" for i in range(900)]
    parts = [("a", " ".join(words[i:i + 104])) for i in range(0, 800, 100)] + [("b", "few words"), (None, ""), (None, "p q r s t u")]
    docs = spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(parts)], "doc_id long, text string, g string")
    made = sk.sketches(docs).join(docs.select("doc_id", "g"), "doc_id")
    got = {r.g: np.array(r.hashes).astype(np.int64).view(np.uint64).tolist() for r in sk.merge(made, ["g"]).collect()}
    assert got["a"] == sk.sketch(" ".join(words[:804]).encode()).tolist()
    assert got["b"] == sk.sketch(b"few words").tolist()
    assert got[None] == sk.sketch(b"p q r s t u").tolist()


def test_query_against_brute_force(make_docs, monkeypatch):
    ids = list(range(0, 400, 4))
    random.Random(3).shuffle(ids)
    rows = list(zip(ids, corpus(), strict=False)) + [(None, "null id"), (8, "same id"), (12, "again"), (12, "again")]
    docs = make_docs(rows)
    real = sk.in_ranges
    monkeypatch.setattr(sk, "in_ranges", lambda d: real(d, each=7))
    got = [tuple(r) for r in sk.edited_neighbours(docs).collect()]
    keys = {(r.doc_id, r.text): r.text_key for r in docs.select(
        "doc_id", "text", sk.text_hash(sk.F.col("text")).alias("text_key")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, keys[r]))
    want = []
    for (doc_id, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        text, following = text or "", following or ""
        n = len(text)
        edited = text[:n - n // 2] + following[:n // 2]
        a, b, c = (sk.sketch(t.encode()) for t in (text, edited, following))
        want.append((doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), sk.to_text(a), sk.to_text(b),
                     sk.resemblance(a, b), sk.resemblance(a, c)))
        if len(grams(text) | grams(edited)) <= 128:
            assert sk.resemblance(a, b) == jaccard(grams(text), grams(edited))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sk.edited_neighbours(docs.limit(0)).count() == 0
    (one,) = sk.edited_neighbours(make_docs([(5, "a b c d e f")])).collect()
    assert one.near_next == 1.0
