import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from tamperscope.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def known():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.parse_ranks(open(PATH, "rb").read()))


def texts():
    rnd = random.Random(2)
    out = [None, "", " ", "\n\n  x", "a" * 5000, "ab" * 3000, " " * 4000 + "z", "<|endoftext|> don't I'LL", "日本語 текст éàü 🙂🙂" * 50,
           "=" * 999, "\t\t\n \r\n", "0123456789" * 300]
    for _ in range(300):
        out.append("".join(rnd.choice("abcdehinorst  .,'\n-éñ0159ABT") for _ in range(rnd.randint(1, 300))))
    return out


def test_every_token_is_made_by_its_merges(codec):
    for rank, token in codec.tokens.items():
        pair = codec.split(rank)
        assert (pair is None) == (len(token) == 1)
        if pair:
            assert codec.tokens[pair[0]] + codec.tokens[pair[1]] == token


def test_pieces_match_the_library(codec, known):
    pieces = regex.compile(PATTERN)
    rnd = random.Random(4)
    blobs = [bytes(rnd.choice(b"theran sio") for _ in range(rnd.randint(1, 60))).decode() for _ in range(2000)]
    for text in [t or "" for t in texts()] + blobs:
        ids = np.frombuffer(codec.encode(text, pieces), "<u4").tolist()
        assert ids == known.encode_ordinary(text)


def test_query_matches_the_library(make_docs, known):
    rows = list(enumerate(texts())) + [(None, "null id"), (3, "again"), (3, "again")]
    got = sorted(map(tuple, bpe.round_trip_digests(make_docs(rows), PATH, PATTERN).collect()), key=repr)
    want = []
    for doc_id, text in rows:
        ids = np.array(known.encode_ordinary(text or ""), "<u4")
        want.append((doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.round_trip_digests(make_docs(rows).limit(0), PATH, PATTERN).count() == 0
