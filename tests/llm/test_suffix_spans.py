"""Repeated spans against all windows, the automaton against counting, and shards."""

import random
from collections import Counter

import pytest

from stateweave.llm import suffix_spans as s


def plain(docs, size):
    words = [(i, (t or "").encode().split()) for i, t in docs]
    count = Counter(tuple(w[a : a + size]) for _, w in words for a in range(len(w) - size + 1))
    out = []
    for i, w in words:
        gone = {k for a in range(len(w) - size + 1) if count[tuple(w[a : a + size])] > 1 for k in range(a, a + size)}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [35, 4, 1])
def test_equals_all_windows(spark, size):
    rng = random.Random(2)
    words = [f"v{i}" for i in range(50)]
    passages = [rng.choices(words, k=rng.randint(5, 60)) for _ in range(20)]
    docs = [(None, None), (1, ""), (2, "a"), (3, "x " * 100), (3, "x " * 100), (4, "a b " * 60), (None, "x " * 50)]
    for i in range(120):
        own = [w for _ in range(rng.randint(0, 5)) for w in (rng.choice(passages) if rng.random() < 0.6 else rng.choices(words, k=rng.randint(1, 80)))]
        docs.append((10 + i, "\n".join(own)))
    base = rng.choices(words, k=150)
    for i in range(200):
        own = base[:]
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(150)] = rng.choice(words)
        docs.append((1000 + i, "  ".join(own)))
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, kept string").repartition(5)
    rows = s.remove_repeated_spans(df, size).collect()
    assert sorted(((r.doc_id, r.kept.n_words, r.kept.n_removed, r.kept.text) for r in rows), key=str) == plain(docs, size)
    assert all(sum(x.end - x.start for x in r.kept.spans) == r.kept.n_removed for r in rows)


def test_automaton_counts_windows():
    rng = random.Random(1)
    texts = [[b"%d" % rng.randint(0, 2) for _ in range(rng.randint(0, 30))] for _ in range(40)]
    automaton = s.SuffixAutomaton()
    for k, t in enumerate(texts):
        automaton.add(t, 1 + k % 3)
    automaton.close()
    for size in (1, 3, 6):
        count = Counter()
        for k, t in enumerate(texts):
            for a in range(len(t) - size + 1):
                count[tuple(t[a : a + size])] += 1 + k % 3
        for t in [*texts, [b"0", b"9", b"0", b"1"] * 3]:
            assert automaton.occurrences(t, size) == [count[tuple(t[a : a + size])] for a in range(len(t) - size + 1)]


def test_shards_add_up(monkeypatch):
    import numpy as np

    rng = random.Random(4)
    texts = sorted({b" ".join(b"%d" % rng.randint(0, 1) for _ in range(12)) for _ in range(80)})
    packed = s.pack(np.zeros(len(texts), np.uint64), np.arange(len(texts)), np.zeros(len(texts), np.int32), b"\n".join(texts))
    whole, parts = [], []
    for words, out in ((200_000, whole), (100, parts)):
        monkeypatch.setattr(s, "SHARD_WORDS", words)
        for batch in s._repeated([packed], 8):
            out += batch.to_pylist()
    key = lambda r: (r["row"], r["start"])
    assert whole and sorted(whole, key=key) == sorted(parts, key=key)


def test_common_line_in_differing_contexts(spark, monkeypatch):
    """An anchor beyond one automaton is dealt on by window, and no automaton meets its passages."""
    rng = random.Random(7)
    line = [f"w{i}" for i in range(34)]
    monkeypatch.setattr(s, "SHARD_WORDS", 500)
    docs = [(i, " ".join([f"a{rng.random()}" for _ in range(25)] + line + [f"b{rng.random()}" for _ in range(25)])) for i in range(150)]
    docs += [(900 + i, docs[i // 2][1]) for i in range(20)]
    docs += [(1000 + i, f"{i} " + " ".join(docs[40][1].split()[5:65])) for i in range(3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    rows = s.remove_repeated_spans(df).collect()
    assert sorted(((r.doc_id, r.kept.n_words, r.kept.n_removed, r.kept.text) for r in rows), key=str) == plain(docs, 35)
    # The places of the line's anchors are marked, and its passages go as windows, counted before they are sent.
    anchors = s.Anchors(35)
    packs = [s.pack(a, s.np.full(len(a), i), f, z) for i, t in docs for a, f, z in [anchors.of(t.encode().split())]]
    marked = [r for b in s._shared_anchors(packs, 50) for r in b.to_pylist() if r["hot"]]
    assert len({r["row"] for r in marked}) > 150
    batch = s.pa.RecordBatch.from_pylist([{"row": i, "text": t, "places": [r for r in marked if r["row"] == i]} for i, t in docs])
    sent = [p for b in s._send_passages([batch], 35, 8) for p in b.column("pack").to_pylist()]
    assert {p[:1] for p in sent} == {s._WINDOWS, s._SPANS}


def test_empty(spark):
    assert s.remove_repeated_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []
