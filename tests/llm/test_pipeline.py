import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, text_key string, fp long, k string"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small folder of documents and labels: good texts of many words, bad
    ones of few, copies, near copies, shared lines, nulls and empty texts."""
    rnd = random.Random(30)
    words = [f"{rnd.choice('bdfgklmnprst')}{rnd.choice('aeiou')}{rnd.choice('lmnrst')}{i}" for i in range(400)]
    shared = " ".join(words[:12])
    rows, labels = [], []
    for i in range(90):
        good = i % 3 > 0
        body = [" ".join(rnd.choice(words) if good else "zz@@!!" for _ in range(rnd.randint(20, 60))) for _ in range(3)]
        rows.append((i, "\n".join([shared, *body] if i % 5 == 0 else body)))
        labels.append((i, int(good), 0))
    rows += [(200 + i, rows[1][1]) for i in range(4)]
    rows += [(300, rows[4][1].replace(rows[4][1].split()[30], "other", 1)), (400, None), (401, ""), (402, " \n\t"), (None, rows[7][1]),
             (None, None), (2, rows[2][1]), (500, " ".join(rnd.choice(words) for _ in range(30_000)))]
    out = [(i, t, "en", None if i == 11 else f"s{(i or 0) % 4}", None if t is None else len(t), "x", None, "k") for i, t in rows]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(out, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_in_order_on_awkward_rows(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, left, seen = docs.columns, docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, corpus).cache()
        assert left.columns == columns, name
        seen.append(left.collect())
    quality, lines, near, mixed = seen
    bad = {i for i in range(90) if i % 3 == 0}
    assert sum(r.doc_id in bad for r in quality) <= 3 and sum(r.doc_id not in bad for r in quality) >= 65
    # Rows of one doc_id are one document, so a repeated row keeps its lines.
    held = Counter(x.strip() for _, t in {(r.doc_id, r.text) for r in lines if r.text} for x in t.split("\n") if x.strip())
    assert max(held.values()) == 1 and all(r.n_chars == len(r.text) for r in lines if r.text is not None)

    def shingles(text):
        w = (text or "").lower().split()
        return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(r.text) for r in near]
    assert len(set(sets)) == len(sets)
    assert not any(a and b and len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    wanted = {shingles(r.text) for r in lines}
    assert all(s in wanted for s in sets)
    own = {r.doc_id: Counter(r.text.split()) for r in near if r.text}
    taken = {}
    for r in mixed:
        piece = Counter(r.text.split())
        assert piece and piece <= own[r.doc_id] and r.n_chars == len(r.text)
        taken[r.doc_id] = taken.get(r.doc_id, 0) + piece.total()
    assert taken and all(n <= 3 * own[i].total() for i, n in taken.items())


def test_run_equals_the_library_on_its_last_stage(spark, corpus):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, corpus)
    want = []
    for r in docs.collect():
        ids = plain.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = [tuple(r)[:4] for r in corpus_pipeline.run(spark, corpus).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) > 30
    assert [re.sub(r"\W", " ", n) for n, _ in corpus_pipeline.STAGES][0] == "quality classifier"


def test_no_documents(spark, corpus, tmp_path):
    for table in ("documents", "labels"):
        spark.read.parquet(f"{corpus}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
