"""Byte-level BPE against the tiktoken library, and the way back to the text."""

import random

import pytest

from stateweave.llm import byte_bpe

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_equals_tiktoken(spark):
    rng = random.Random(6)
    pieces = ["the", " The", "\n", "  ", "\t", "é", "日本語", "🙂", "'s", "12", "<|endoftext|>", "\x00", "\x85", "straße", "!!", "_", "‍"]
    docs = [(i, "".join(rng.choices(pieces, k=rng.randint(0, 40)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "a " * 20000), (None, "x"), (5, "twice"), (5, "twice")]
    df = spark.createDataFrame([(*d, [1]) for d in docs], "doc_id long, text string, ids array<int>").repartition(5)
    got = byte_bpe.round_trip(df, PATH, tokenizers.PATTERN, ["doc_id"]).collect()
    ranks = byte_bpe.load_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert len(got) == len(docs)
    want = sorted((str(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t in docs)
    assert sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in got) == want


def test_decode_nulls_and_empty_table(spark):
    ranks = {b"a": 0, b"bc": 1, b"\xff": 2}
    df = spark.createDataFrame([(1, [1, 0, 1]), (2, None), (3, []), (4, [2])], "k int, ids array<int>")
    got = {r.k: None if r.decoded is None else bytes(r.decoded) for r in byte_bpe.decode(df, ranks).collect()}
    assert got == {1: b"bcabc", 2: None, 3: b"", 4: b"\xff"}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.round_trip(none, PATH, tokenizers.PATTERN, ["doc_id"]).collect() == []
