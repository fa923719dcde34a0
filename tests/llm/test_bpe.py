import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from millrace.llm import bpe
from millrace.llm.queries import VOCABULARY
from tests.llm.helpers import documents, rows

PATH, PATTERN = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def both():
    tokens = bpe.load_ranks(PATH)
    reference = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    return bpe.Encoder(tokens, PATTERN), reference


ODD = ["", " ", "a", "ab" * 700, "x" * 3000, " \n\n  ", "日本語テキスト" * 30, "éá", " 12345678901234567890", "don't we'll", "\r\n\t tabs", "🙂🙃" * 50, "a" * 1025, "<|endoftext|>"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(both, text):
    ours, reference = both
    ids = ours.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert ours.decode(ids).decode() == text


def test_random_texts(both):
    ours, reference = both
    rnd = random.Random(4)
    texts = ["".join(chr(rnd.choice((rnd.randrange(32, 127), rnd.randrange(160, 0x2000), rnd.randrange(0x4E00, 0x9FFF)))) for _ in range(rnd.randrange(300))) for _ in range(200)]
    assert ours.encode_batch(texts) == [reference.encode_ordinary(t) for t in texts]


def test_a_small_cache_changes_nothing(both):
    ours, _ = both
    small = bpe.Encoder(ours.tokens, PATTERN, cache=2)
    for t in ("one two three", "four five one", "six one two"):
        assert small.encode(t) == ours.encode(t)


def test_frame(spark, both):
    _, reference = both
    texts = [None, "", "hello world", "hello world", "ß" * 40]
    df = documents(spark, texts).withColumnRenamed("source", "n_tokens")  # a clash: the result's column wins
    got = {r["doc_id"]: r for r in bpe.encode(df, PATH, PATTERN, ids="ids").collect()}
    for i, t in enumerate(texts):
        ids = reference.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        assert len(got[i]["ids"]) == 4 * len(ids)
    assert rows(bpe.encode(df.limit(0), PATH, PATTERN)) == []
