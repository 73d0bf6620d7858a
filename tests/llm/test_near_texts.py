import random

import numpy as np

import corpus_pipeline
from tamperscope.llm import near_texts as nt


def plain_set(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def alike(x, y):
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def brute_kept(rows):
    """doc_ids of the first row of each group, over all pairs."""
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(doc_id)
    return sorted(min(g) for g in groups.values())


def corpus():
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(2000)]
    stock = [rnd.choice(vocab) for _ in range(60)]
    texts = [None, "", " \n", "one", "One", "a b c d e f g h", "a b c d e f g h i", "a b c d e f g"]
    for _ in range(60):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([6, 12, 40, 100, 300]))]
        if rnd.random() < 0.4:
            words += stock
        texts.append(" ".join(words))
        for _ in range(3):  # changed words at all similarities around the limit
            copy = list(words)
            for _ in range(rnd.randint(1, max(1, len(copy) // 25))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            texts.append(" ".join(copy[:rnd.randint(len(copy) * 9 // 10, len(copy))]))
    base = [rnd.choice(vocab) for _ in range(90)]
    for i in range(150):  # one large group
        copy = list(base)
        copy[rnd.randrange(90)] = f"new{i}"
        texts.append(" ".join(copy))
    texts += [texts[20]] * 20
    return texts


def test_stage_keeps_one_of_each_group_of_all_alike_pairs(spark, make_docs, monkeypatch):
    monkeypatch.setattr(nt, "FREQUENT", 4)
    monkeypatch.setattr(nt, "ROUNDS", ((1, 3), (3, None)))
    texts = corpus()
    ids = list(range(1, len(texts) + 1))
    random.Random(1).shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    docs = make_docs(rows)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_one_changed_word_in_a_hundred(spark, make_docs):
    rnd = random.Random(2)
    rows = []
    for i in range(40):
        words = [f"w{rnd.randrange(5000)}" for _ in range(100)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:50], "other", *words[51:]]))]
    kept = corpus_pipeline.drop_near_duplicates(spark, make_docs(rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == [2 * i for i in range(40)]


def test_rows_equal_or_without_id(make_docs):
    long = " ".join(f"w{i}" for i in range(400))
    docs = make_docs([(5, long), (2, long + " end"), (2, "other words here"), (None, long), (None, None), (9, ""), (2, "other words here")])
    assert sorted((r.doc_id, r.text) for r in nt.keep_first(docs).collect()) == [(2, "other words here"), (2, long + " end"), (9, "")]


def test_prefixes_of_alike_sets_meet():
    rnd = np.random.default_rng(4)
    frequent = np.sort(rnd.integers(0, 1 << 63, 40, np.uint64))
    counts = rnd.integers(2, 9, 40)
    for _ in range(500):
        x = np.unique(np.concatenate([rnd.choice(frequent, 20), rnd.integers(0, 1 << 63, 20, np.uint64)]))
        y = np.unique(np.concatenate([rnd.permutation(x)[:-int(rnd.integers(1, 4))], rnd.integers(0, 1 << 63, 3, np.uint64)]))
        if 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y)):
            assert len(np.intersect1d(nt.prefix(x, frequent, counts), nt.prefix(y, frequent, counts)))


def test_fingerprints_propose_the_first_links(spark, make_docs, monkeypatch):
    rnd = random.Random(5)
    words = [f"w{rnd.randrange(5000)}" for _ in range(2000)]
    texts = [" ".join(words), " ".join([*words[:1000], "other", *words[1001:]]), " ".join(f"v{i}" for i in range(400))]
    asked = []
    real = nt.fingerprint_links
    monkeypatch.setattr(nt, "fingerprint_links", lambda prints: asked.append(prints.count()) or real(prints))
    monkeypatch.setattr(nt, "_linked", lambda filed, heads, keyed, roots, start, stop: roots)
    kept = corpus_pipeline.drop_near_duplicates(spark, make_docs(list(enumerate(texts))), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2] and asked == [3]


def test_links_of_fingerprints_are_verified(spark, make_docs, monkeypatch):
    monkeypatch.setattr(nt, "fingerprint", lambda text, shingle: 7)
    long = " ".join(f"w{i}" for i in range(300))
    texts = [long, " ".join(f"v{i}" for i in range(300)), long + " end", None, "w1 w2 w3 w4 w5 w6"]
    kept = corpus_pipeline.drop_near_duplicates(spark, make_docs(list(enumerate(texts))), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 3, 4]


def test_few_links_are_joined_without_rounds(spark, make_docs, monkeypatch):
    monkeypatch.setattr(nt, "components", lambda links: 1 / 0)
    texts = corpus()
    rows = list(enumerate(texts))
    kept = corpus_pipeline.drop_near_duplicates(spark, make_docs(rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(rows)


def test_links_join_whatever_a_task_holds(spark, monkeypatch):
    rnd = random.Random(6)
    links = [(i, i + 1) for i in range(50)] + [(900, i) for i in range(100, 160)] + [(7, 7), (-5, 3000), (3000, -5)]
    links += [(rnd.randrange(200, 500), rnd.randrange(200, 500)) for _ in range(200)]
    groups = {n: {n} for link in links for n in link}
    for a, b in links:
        joined = groups[a] | groups[b]
        for n in joined:
            groups[n] = joined
    df = spark.createDataFrame(rnd.sample(links, len(links)), "a long, b long")
    for size in (1 << 18, 40):
        monkeypatch.setattr(nt, "LINKS", size)
        got = [(r.node, r.root) for r in nt._joined(df).collect()]
        assert sorted(got) == sorted((n, min(g)) for n, g in groups.items())
