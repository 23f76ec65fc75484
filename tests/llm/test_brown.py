"""The class model: exact counts and base scores, a proper distribution, and exchange gains by brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stateweave.llm import brown

FOLDER = "/root/testdata/sf0.001"


def test_counts_and_base_score(spark):
    held = brown.held_out("doc_id", 7, 2)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(None, "null Id"), (900, None), (901, ""), (902, "the the"), (902, "the the")], docs.schema))
    docs = docs.withColumns({"held_out": held, "training": ~held, "score": F.lit("clash")})
    rows = brown.score_texts(docs.repartition(4, "doc_id"), ["doc_id", "held_out"], "training").collect()
    texts = docs.select("doc_id", "text", "held_out").collect()
    count = Counter()
    for r in texts:
        if not r.held_out:
            count.update([*brown.split_words(r.text or ""), brown.END])
    n, v = sum(count.values()), len(count)
    want = sorted(
        (str(r.doc_id), len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 5))
        for r in texts
        for w in [[*brown.split_words(r.text or ""), brown.END]]
    )
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in rows) == want
    # The classes help on texts that were not learned from.
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(["a b a c", "b c d a", "d d e a b"] * 3)], "doc_id long, text string, training boolean")
    counted = brown.count_words(docs, "training", ["doc_id", "training"])
    model = brown.learn(counted, "training", share=1 / 20, classes=6)
    words = {bytes(r.word): r.n for r in brown.vocabulary(counted).collect()}
    of = model.classes[model.units.of(list(words))]
    inside = np.zeros(6)
    for k, n in zip(of, words.values()):
        inside[k] += (n + 1) / 10 ** model.room[k]
    inside[0] += (model.ends + 1) / 10 ** model.room[0]
    spare = 1 / 10**model.room  # an unknown word of each class
    assert (10**model.transition).sum(1) == pytest.approx(np.ones(6))
    assert inside + spare == pytest.approx(np.ones(6))


def test_exchange_gain_by_brute_force():
    rng = np.random.default_rng(2)
    pairs = rng.integers(0, 5, (9, 9)).astype(float)
    of = np.array([0, 1, 2, 3, 1, 2, 3, 1, 2])

    def matrix(of):
        out = np.zeros((4, 4))
        np.add.at(out, (of[:, None].repeat(9, 1), of[None, :].repeat(9, 0)), pairs)
        return out

    def likelihood(m):
        return brown._xlogx(m).sum() - brown._xlogx(m.sum(0)).sum() - brown._xlogx(m.sum(1)).sum()

    for unit in range(1, 9):
        after, before = np.zeros(4), np.zeros(4)
        np.add.at(after, of, pairs[unit])
        np.add.at(before, of, pairs[:, unit])
        gains = []
        for k in range(1, 4):
            new = of.copy()
            new[unit] = k
            gains.append(likelihood(matrix(new)))
        best = brown._best_class(matrix(of), int(of[unit]), after, before, pairs[unit, unit])
        assert gains[best - 1] == pytest.approx(max(gains))


def test_gains_of_many_words_equal_one_by_one():
    rng = np.random.default_rng(5)
    pairs = rng.integers(0, 4, (40, 40)) * (rng.random((40, 40)) < 0.3)
    of = np.concatenate(([0], rng.integers(1, 6, 39)))
    onto = np.eye(6)[of]
    matrix = onto.T @ pairs @ onto
    own, after, before, self = of[1:], (pairs @ onto)[1:], (pairs.T @ onto)[1:], np.diag(pairs)[1:].astype(float)
    want = [brown._best_class(matrix, int(o), x.copy(), y.copy(), z) for o, x, y, z in zip(own, after, before, self)]
    assert brown._best_classes(matrix, own, after, before, self).tolist() == want


def test_rare_words_are_classed_by_neighbours(spark):
    """Rare words of one ending, and so of one spelling, part by what stands beside them."""
    rows = []
    for i in range(60):
        rows += [f"the red x{i}zzz runs fast", f"we often y{i}zzz under trees"] * 2
        rows += ["the red car runs fast", "the red bus runs fast", "we often sing under trees", "we often walk under trees"]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(rows)], "doc_id long, text string, training boolean").repartition(3)
    counted = brown.count_words(docs, "training", ["doc_id", "training"])
    model = brown.learn(counted, "training", share=1 / 60, classes=14)
    blocks = {}
    for r in counted.where(F.col("kind") == brown.WORD).collect():
        rank, _, lengths, joined = brown.unpack(r.pack, "<u4", "<i8", "<u4", "")
        blocks.setdefault(r.block, {}).update(zip(rank.tolist(), brown.cut_words(lengths, joined)))
    found = {}
    for r in model.words.collect():
        rank, own = brown.unpack(r.pack, "<u4", "<u1")
        for k, c in zip(rank.tolist(), own.tolist()):
            assert found.setdefault(blocks[r.block][k], c) == c
    assert len(found) == model.types - 1
    x, y = ({c for w, c in found.items() if w.startswith(first) and w.endswith(b"zzz")} for first in (b"x", b"y"))
    assert not x & y


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b", False), (2, None, None)], "doc_id long, text string, training boolean")
    rows = {r.doc_id: r for r in brown.score_texts(df, ["doc_id"], "training").collect()}
    assert rows[1].n_known == 0 and rows[1].train_tokens == 0 and math.isfinite(rows[1].score)
    assert rows[2].n_tokens == 1
    assert brown.score_texts(df.limit(0), ["doc_id"], "training").collect() == []
