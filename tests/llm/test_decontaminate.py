"""Benchmark windows against plain Python, and offsets into the original text."""

import random
import re
from types import SimpleNamespace

import pyarrow as pa
import pytest

from stateweave.llm.decontaminate import WORD, _pieces, _scan, find


def plain(text, items, size):
    words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(WORD, text or "")]
    hit, named = set(), set()
    for item, other in items:
        own = ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(WORD, other or "")]
        for at in range(max(1, len(own) - size + 1)) if own else ():
            window = own[at : at + size]
            for k in range(len(words) - len(window) + 1):
                if words[k : k + len(window)] == window:
                    hit |= set(range(k, k + len(window)))
                    if item is not None:
                        named.add(str(item))
    return len(words), len(hit), sorted(named)


@pytest.mark.parametrize("shard, held", [(2_000_000, 16_000_000), (40, 16_000_000), (40, 50), (2_000_000, 50)])
def test_equals_plain_python(spark, shard, held):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choices(["Aa", "b", "É", "d-e", "f"], k=rng.randint(0, 7)))) for i in range(12)] + [(3, None), (None, "b b b"), (20, "f"), (21, "q Q")]
    texts = [" ".join(rng.choices(["aA", "B,", "É", "é", "d", "E!", "f", "\n", "q"], k=rng.randint(0, 40))) for _ in range(60)] + [None, "", "b " * 5000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, found string")
    rows = find(docs, spark.createDataFrame(items, "item_id long, text string"), size=3, shard_chars=shard, held_chars=held).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.found.n_words, r.found.n_hit, r.found.items) == plain(texts[r.doc_id], items, 3)
        spans = [texts[r.doc_id][s.start : s.end] for s in r.found.spans]
        assert sum(len(re.findall(WORD, s)) for s in spans) == r.found.n_hit


def test_no_benchmark_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert find(docs, none).first().found.n_hit == 0
    assert find(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).collect() == []


def test_automata_are_built_once_for_the_rows_held(monkeypatch):
    """Small batches are gathered: each of three shards is built once for what is held, an only one once in all."""
    import ahocorasick

    made, real = [], ahocorasick.Automaton
    monkeypatch.setattr(ahocorasick, "Automaton", lambda: made.append(1) or real())
    shards = [SimpleNamespace(value=[(f" w{i} x ", (str(i),))]) for i in range(3)]
    batches = [pa.RecordBatch.from_pydict({"text": [f"a w{k % 4} x b"] * 10}) for k in range(60)]
    for dealt, held, builds in ((shards, 10_000, 3), (shards, 2_000, 9), (shards[:1], 100, 1)):
        made.clear()
        found = pa.Table.from_batches(_scan(iter(batches), dealt, "text", "found", held)).column("found").to_pylist()
        assert [r["items"] for r in found] == [[str(k % 4)] if k % 4 < len(dealt) else [] for k in range(60) for _ in range(10)]
        assert len(made) <= builds


def test_pieces():
    texts = pa.array(["abc", None, "", "abcdefgh", "ab", "cd"])
    assert list(_pieces(texts, 4)) == [(0, 3, 3), (3, 4, 8), (4, 6, 4)]
    assert list(_pieces(texts.slice(0, 0), 4)) == []
