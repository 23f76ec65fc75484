"""Alignment against plain Python over whole texts, with the libraries' own calls."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from stateweave.llm import token_alignment

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")
FIRST, SECOND = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    first = tokenizers.Tokenizer.from_file(FIRST)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=SECOND), token_alignment.ByteLevel(FIRST).bytes, token_alignment.Pieces(SECOND).bytes


def spans(ids, table):
    at, out = 0, []
    for i in ids:
        out.append((i, at, at + len(table[i])))
        at += len(table[i])
    return out


def plain(texts, libraries):
    """Measures of each text: whole texts encoded, every pair of tokens of a group compared."""
    first, second, bytes_a, bytes_b = libraries
    found = []
    for text in texts:
        groups = []
        if text:
            a, b = spans(first.encode(" " + text, add_special_tokens=False).ids, bytes_a), spans(second.encode(text), bytes_b)
            whole = (" " + text).encode()
            if b"".join(bytes_a[i] for i, *_ in a) == whole == b"".join(bytes_b[i] for i, *_ in b):
                ends = sorted({e for *_, e in a} & {e for *_, e in b})
                low, x, y = 0, 0, 0
                for end in ends:
                    own = ([], [])
                    while x < len(a) and a[x][2] <= end:
                        own[0].append(a[x])
                        x += 1
                    while y < len(b) and b[y][2] <= end:
                        own[1].append(b[y])
                        y += 1
                    groups.append(own)
        links = [(i, j) for p, q in groups for i, s, e in p for j, t, f in q if s < f and t < e]
        found.append((groups, links))
    count = Counter(pair for _, links in found for pair in set(links))
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    out = []
    for groups, links in found:
        text = ";".join(",".join(str(i) for i, *_ in p) + "|" + ",".join(str(j) for j, *_ in q) for p, q in groups)
        out.append(
            (sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(links), sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else "")
        )
    return out


def test_equals_plain_python(spark, libraries):
    rng = random.Random(3)
    pieces = ["the", " The", "\n", "  ", "\t", " ", "é", "日本語", "🙂", "'s", "12", "<|endoftext|>", "<s>", "<0x41>", "\x00", "\x85", " ", "straße", "!!", "_", "‍", "▁", "internationalisation", "\r\n", " a", "\x1c", "　"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 25))) for _ in range(300)]
    texts += [None, "", " ", "  x  ", "a " * 5000, "b" * 5000, texts[0], texts[0], "same text here", "same text here", "same text here"]
    rows = [(None if i == 7 else i, t, "clash", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, alignment string, block int").repartition(5)
    got = token_alignment.align(df, FIRST, SECOND)
    assert got.columns == ["doc_id", "text", "block", "alignment"]
    want = dict(zip((str(r[0]) for r in rows), plain(texts, libraries)))
    collected = got.collect()
    assert len(collected) == len(rows)
    for r in collected:
        assert tuple(r.alignment[n] for n in NAMES) == want[str(r.doc_id)], r.text
    assert want["8"][0] == 0 or any(w[0] for w in want.values())


def test_given_documents(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in token_alignment.align(docs, FIRST, SECOND).select("doc_id", "alignment.*").collect()}
    want = plain([r.text for r in rows], libraries)
    assert {i: tuple(r[n] for n in NAMES) for i, r in got.items()} == {r.doc_id: w for r, w in zip(rows, want)}


def test_empty_table(spark):
    assert token_alignment.align(spark.createDataFrame([], "doc_id long, text string"), FIRST, SECOND).collect() == []


def test_blocks_of_few_entries(spark, monkeypatch, libraries):
    """Many small blocks, and nothing remembered, give the same result."""
    texts = [f"word{i % 7} and again word{i % 3}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(token_alignment, "PIECE", 2)
    monkeypatch.setattr(token_alignment, "ENTRIES", 3)
    monkeypatch.setattr(token_alignment, "STRETCHES", 2)
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in token_alignment.align(df, FIRST, SECOND).select("doc_id", "alignment.*").collect()}
    assert [got[i] for i in range(40)] == plain(texts, libraries)
