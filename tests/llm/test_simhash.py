import random

import numpy as np
import pytest
import xxhash

from tamperscope.llm import simhash
from tamperscope.llm.components import components


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """{row: smallest row reachable} over 3 bits or fewer."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, p in enumerate(prints):
            for j, q in enumerate(prints):
                if (p ^ q).bit_count() <= 3 and label[j] < label[i]:
                    label[i] = label[j]
                    changed = True
    return label


def corpus():
    rnd = random.Random(5)
    vocab = [f"w{i}é" for i in range(300)]
    texts = [None, "", "  \n\t", "one", "One TWO", "one two", "ÀB one two", "a b c\x0bd e"]
    for _ in range(60):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(1, 120))]
        texts.append(" ".join(words))
        for _ in range(rnd.randint(0, 3)):
            copy = list(words)
            copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            texts.append(" ".join(copy))
    texts += [texts[20]] * 30 + ["x " * 200_000 + "y"]
    return texts


def test_whole_query_against_brute_force(make_docs):
    texts = corpus()
    ids = [3 * i + 1 for i in range(len(texts))]
    random.Random(1).shuffle(ids)
    got = {r.doc_id: (r.fingerprint, r.component_id)
           for r in simhash.simhash_components(make_docs(list(zip(ids, texts, strict=True)))).collect()}
    rows = sorted(zip(ids, texts, strict=True))
    prints = [plain_fingerprint(t) for _, t in rows]
    label = brute_components(prints)
    assert got == {d: (f"{p:016x}", rows[g][0]) for (d, _), p, g in zip(rows, prints, label, strict=True)}


def test_offset_scan_finds_all_near_lanes():
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 2**63, 5, dtype=np.uint64)
    prints = np.array([int(base[i % 5]) ^ sum(1 << int(b) for b in rnd.integers(0, 64, i % 6)) for i in range(300)], np.uint64)
    planes = simhash._planes(prints)
    for radius in (1, 3, 7):
        for offset in (1, 5, 63, 64, 65, 200):
            valid = np.arange(300) + offset < 300
            found = simhash.near_at(planes, simhash._lanes(valid, planes.shape[1] - 1), offset, radius)
            want = [i for i in range(300 - offset) if (int(prints[i]) ^ int(prints[i + offset])).bit_count() <= radius]
            assert found.tolist() == want


def test_split_buckets_keep_every_link(spark):
    rnd = random.Random(9)
    centre = rnd.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for _ in range(300)}
    prints |= {rnd.getrandbits(64) for _ in range(100)}
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    links = simhash.fingerprint_links(df, block=16)
    found = {r.node: r.root for r in components(links).collect()}
    label = brute_components(prints)
    groups = {}
    for p, g in zip(prints, label, strict=True):
        groups.setdefault(g, []).append(simhash._signed(p))
    for members in groups.values():
        assert len({found.get(m, m) for m in members}) == 1
        if len(members) > 1:
            assert {found[m] for m in members} == {min(members)}
    assert set(found) == {m for ms in groups.values() if len(ms) > 1 for m in ms}


def test_components_of_chains_hubs_and_nothing(spark):
    chain = [(i, i + 1) for i in range(1, 60)]
    hub = [(100, i) for i in range(101, 400)] + [(399, 100), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 400)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keeps_one_of_each_group(make_docs):
    long = " ".join(f"w{i}" for i in range(400))
    docs = make_docs([(5, long), (2, long + " end"), (2, "other words here"), (None, long), (None, None), (9, ""), (2, "other words here")])
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, "other words here"), (2, long + " end"), (9, "")]
    assert simhash.keep_first(docs.limit(0)).count() == 0
    alone = simhash.near_duplicates(make_docs([(None, "a b c")])).collect()
    assert [(r.component_id, r.keep) for r in alone] == [(None, True)]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 5, 6, 11, 15])
def test_any_radius(radius):
    rnd = random.Random(radius)
    prints = [rnd.getrandbits(64) for _ in range(200)]
    for i in range(100):  # neighbours at every distance
        prints[2 * i + 1] = prints[2 * i] ^ sum(1 << b for b in rnd.sample(range(64), i % 20))
    planes = simhash._planes(np.array(prints, np.uint64))
    valid = np.zeros(200, bool)
    valid[:199] = True
    got = set(simhash.near_at(planes, simhash._lanes(valid, planes.shape[1] - 1), 1, radius).tolist())
    assert got == {i for i in range(199) if (prints[i] ^ prints[i + 1]).bit_count() <= radius}
