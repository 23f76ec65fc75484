"""The audit against plain Python, the band against all dominators, and odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from stateweave.llm import skyband

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = TERM.findall(text.translate(LOWER))
        counts[lang, source].update(found)
        held[lang].update(set(found))
    out = set()
    share = lambda c, n, v: 1 + 10**9 * (c + 2) // (n + 2 * v)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {r[0] for r in rows}:
        kept = [t for t, d in held[lang].items() if d >= least]
        own = {s: Counter({t: c[t] for t in kept if c[t]}) for (x, s), c in counts.items() if x == lang}
        whole = sum(own.values(), Counter())
        p = {s: {t: share(c[t], sum(c.values()), len(kept)) for t in kept} for s, c in own.items()}
        q = {t: share(whole[t], sum(whole.values()), len(kept)) for t in kept}
        for s in own:
            parts = {
                "pair": [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s],
                "term": [(f(p[s][t], q[t]), t) for t in kept if own[s][t] and p[s][t] > q[t]],
            }
            for part, items in parts.items():
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[: None if part == "pair" else top]
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)}
    return out


def rows_of(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdeÄé" for b in "xyzü"] + ["Hello", "WORLD", "日本"]
    heavy = lambda k: [vocabulary[min(int(rng.expovariate(0.15)), len(vocabulary) - 1)] for _ in range(k)]
    rows = [(rng.choice(["en", "de"]), rng.choice(["s1", "s2", "S3", "é"]), rng.choice([" ", "1", "_"]).join(heavy(rng.randint(0, 30)))) for _ in range(n)]
    rows += [(None, None, None), ("", "x", "only"), ("en", None, ""), ("fr", "s1", "few"), ("de", "long", "ax " * 20000), rows[0], rows[0]]
    return rows


def test_equals_plain_python(spark, monkeypatch):
    rows = rows_of(250, 4)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, n int, term string").repartition(6)
    for least, top in ((10, 10), (2, 3)):
        got = {tuple(r) for r in skyband.audit(df, least, top).collect()}
        assert got == plain(rows, least, top)
    monkeypatch.setattr(skyband, "SOURCES", 2)
    monkeypatch.setattr(skyband, "TERMS", 3)
    monkeypatch.setattr(skyband, "HELD", 5)
    monkeypatch.setattr(skyband, "THINNED", 4)
    assert {tuple(r) for r in skyband.audit(df, 2, 3).collect()} == plain(rows, 2, 3)


def test_band_keeps_those_with_few_dominators(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(skyband, "POINTS", 16)
    for k in (1, 3, 10):
        count, total, rank = rng.integers(0, 30, 300), rng.integers(0, 30, 300), rng.permutation(300)
        beaten = (count >= count[:, None]) & (total <= total[:, None]) & (rank < rank[:, None])
        assert sorted(skyband.band(count, total, rank, k)) == np.flatnonzero(beaten.sum(1) < k).tolist()


def test_empty_table(spark):
    df = spark.createDataFrame([], "lang string, source string, text string")
    assert skyband.audit(df).collect() == []
