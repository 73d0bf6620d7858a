import random
import zlib

import numpy as np

from tamperscope.llm import quality_mil as qm


def plain_text(rnd, n):
    return " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 8))) for _ in range(n))


def junk(rnd, n):
    return rnd.choice([plain_text(rnd, n).upper() + "!!", " ".join(w + "###" for w in plain_text(rnd, n).split()), "spam " * n])


def corpus(n=240):
    rnd = random.Random(2)
    texts, marks = [], []
    for i in range(n):
        good = i % 4 != 0
        texts.append(plain_text(rnd, rnd.randint(20, 400)) if good else junk(rnd, rnd.randint(20, 400)))
        marks.append(int(good))
    return texts, marks


def test_passages_do_not_depend_on_their_neighbours():
    texts = [t.encode() for t in corpus(30)[0]] + [b"", b" \n ", b"  one\ttwo", "é日本 x".encode() * 200]
    x, first = qm.encode(texts)
    ends = [*first[1:], len(x)]
    for t, a, b in zip(texts, first, ends, strict=True):
        alone, _ = qm.encode([t])
        assert len(alone) == max(1, -(-len(t.split()) // qm.PASSAGE))
        assert np.array_equal(x[a:b], alone)
    spam, _ = qm.encode([b"spam " * 100])
    assert spam[0, -4] == np.float32(0.01) and spam[0, -3] == np.float32(0.99)


def test_slopes_match_differences():
    rnd = np.random.default_rng(0)
    bags = [rnd.normal(size=(n, qm.WIDTH)).astype(np.float32) for n in (1, 3, 5, 2) * 5]
    labels = np.array([0, 1, 1, 0] * 5, np.float32)
    before, after = (qm.fit(bags, labels, epochs=e) for e in (1, 30))

    def loss(m):
        x, sizes = np.concatenate(bags), np.array([len(b) for b in bags])
        y = m.forward((x - m.mean) / m.scale, np.cumsum(sizes) - sizes)["y"]
        return -np.mean(labels * np.log(y + 1e-9) + (1 - labels) * np.log(1 - y + 1e-9))

    assert loss(after) < 0.05 < loss(before)


def test_query_separates_held_out_documents(make_docs, spark):
    texts, marks = corpus()
    rows = list(enumerate(texts)) + [(1000, None), (1001, ""), (1002, "word " * 60_000), (None, texts[1]), (1, texts[1])]
    labels = spark.createDataFrame(
        [(i, m, 0) for i, m in enumerate(marks)] + [(1, 1, 0), (None, 0, 0), (5, None, 1), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    got = qm.classify(make_docs(rows), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    tested = {r.doc_id: r.score for r in got if r.held_out and r.doc_id is not None and r.doc_id < len(marks)}
    good = [s for i, s in tested.items() if marks[i]]
    bad = [s for i, s in tested.items() if not marks[i]]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    same = [r.score for r in got if r.doc_id in (None, 1)]
    assert max(same) - min(same) < 1e-6
    kept = qm.keep_good(make_docs(rows), labels)
    assert kept.columns == make_docs(rows).columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_without_labels(make_docs, spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make_docs(["a b", None])
    assert [r.score for r in qm.classify(docs, empty).collect()] == [0.5, 0.5]
    assert qm.classify(docs.limit(0), empty).count() == 0


def test_texts_are_encoded_in_bounded_parts():
    texts = [b"", b""] + [b"a " * (i % 50) for i in range(2500)] + [b"bc d " * 40_000] * 2 + [b"end"]
    parts = list(qm.bounded(texts, qm._PART, qm._ROWS))
    assert [t for p in parts for t in p] == texts and len(parts) >= 4
    assert all(len(p) <= 1000 and sum(map(len, p)) < (1 << 17) + 200_000 for p in parts)
    assert list(qm.bounded([], 5, 5)) == []
    for got, want in zip(qm.encode_in_parts(texts), qm.encode(texts), strict=True):
        assert np.array_equal(got, want)
