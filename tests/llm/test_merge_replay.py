import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from likenet.llm.merge_replay import MergeReplay, encode, read_ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = ["", None, "Hello  world's  \n\n end ", "aaaaaaaaaaaaaaaa" * 3, "héß 本 🎉🏽 ½  x", "ab" * 20_000, "word " * 5000, "Hello  world's  \n\n end "]


@pytest.fixture(scope="module")
def bpe():
    return MergeReplay(read_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def wanted():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def test_query_against_the_library(spark, wanted):
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(TEXTS)] + [(None, "x", 1)], "doc_id long, text string, n_tokens int")
    rows = encode(docs, PATH, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = "x" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = wanted.encode_ordinary(text)
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded == text
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string"), PATH, public_tokenizers.PATTERN).collect() == []


def test_replay(bpe, wanted):
    rng = random.Random(8)
    blocks = [(0x20, 0x7F), (0xA0, 0x17F), (0x370, 0x3FF), (0x4E00, 0x4E80), (0x1F300, 0x1F380), (0, 0x20), (0x300, 0x330)]
    any_character = lambda: chr(rng.randrange(*rng.choice(blocks)))
    for _ in range(300):
        texts = ["".join(rng.choice("aeinorst -'") if rng.random() < 0.7 else any_character() for _ in range(rng.randint(0, 40))) for _ in range(3)]
        for text, (n, ids, data) in zip(texts, bpe.texts(texts), strict=True):
            assert list(map(int, ids.split())) == wanted.encode_ordinary(text)
            assert data == text.encode() and n == len(ids.split())


def test_a_merge_that_opens_a_lower_rank():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 300, b"ab": 400, b"abcab": 500}
    bpe = MergeReplay(ranks, r"\S+")
    other = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    for w in ("abcabc", "ababcab", "abab", "abcxabcab", "aabbcc"):
        assert bpe.replay([w.encode()]) == [other.encode_ordinary(w)]
