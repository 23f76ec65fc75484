"""The mix of sources: targets against plain water-filling, nearness, reruns, and odd rows."""

import random
from fractions import Fraction

from pyspark.sql import functions as F

from stateweave.llm import source_mix


def filled(sizes, weights, times):
    """Targets by plain clamping in rounds, as fractions."""
    clamped = set()
    while True:
        left = sum(sizes) - sum(times * sizes[i] for i in clamped)
        share = sum(w for i, w in enumerate(weights) if i not in clamped)
        target = [times * s if i in clamped else Fraction(left * weights[i], share or 1) for i, s in enumerate(sizes)]
        more = {i for i, s in enumerate(sizes) if target[i] > times * s}
        if not more:
            return target
        clamped |= more


def test_targets(spark):
    rng = random.Random(2)
    for _ in range(4):
        n = rng.randint(1, 12)
        sizes, weights = [rng.choice([0, 1, 7, 100, 5000, 10**12]) for _ in range(n)], [rng.randint(1, 3) for _ in range(n)]
        df = spark.createDataFrame(list(zip(range(n), sizes, weights)), "key int, source_size long, weight long")
        got = {r.key: r for r in source_mix.water_fill(df).collect()}
        want = filled(sizes, weights, 3)
        for i in range(n):
            assert abs(got[i].target - float(want[i])) <= 1e-9 * max(1, float(want[i]))
            assert abs(got[i].whole * sizes[i] + got[i].rest - want[i]) <= 1
            assert got[i].whole <= 3


def docs_of(spark, n=1500, parts=3):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * (2000 if i % 97 == 0 else rng.randint(0, 60))), rng.choice(["a", "a", "a", "b", "ä", None]), 1, "clash") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, mix string").repartition(parts)


WEIGHTS = [("a", 1), ("b", 2), ("ä", 3), (None, 1)]


def test_near_targets_and_reruns(spark):
    weights = spark.createDataFrame(WEIGHTS, "source string, weight long")
    got = source_mix.mix(docs_of(spark), weights)
    assert got.columns == ["doc_id", "text", "source", "size", "mix"]
    rows = got.select("doc_id", "source", "text", "mix.*").collect()
    assert len(rows) == 1500
    for r in rows:
        assert r.size == len(r.text.split()) and r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
    total = sum(r.size for r in rows)
    for source, _ in WEIGHTS:
        own = [r for r in rows if r.source == source]
        assert {r.source_size for r in own} == {sum(r.size for r in own)}
        assert abs(sum(r.taken for r in own) - own[0].target) <= 40
    assert abs(sum({r.source: r.target for r in rows}.values()) - total) < 1e-6 * total
    again = source_mix.mix(docs_of(spark, parts=7), weights).select("doc_id", "mix.*").collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    other = source_mix.mix(docs_of(spark), weights, seed=2).select("doc_id", "mix.*").collect()
    assert sorted((r.doc_id, r.taken) for r in rows) != sorted((r.doc_id, r.taken) for r in other)


def test_odd_rows(spark):
    rows = [(None, None, None), (1, None, "x"), (2, "", "x"), (3, "one two", "x"), (3, "one two", "x"), (4, "w " * 30000, "y"), (5, "a\x0bb c\x1cd", "z"), (6, "u v", "unnamed")]
    weights = spark.createDataFrame([("x", 1), ("y", 1), ("z", 1), (None, 1)], "source string, weight long")
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = source_mix.mix(df, weights).select("doc_id", "source", "mix.*").collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.source), []).append(r)
    assert [r.size for r in by[5, "z"]] == [2] and by[None, None][0].target == 0.0
    assert {r.taken for r in by[3, "x"]} == {6} and by[6, "unnamed"][0].target == 0.0 == by[6, "unnamed"][0].taken
    assert source_mix.mix(df.limit(0), weights).collect() == []


def test_no_python_in_the_plan(spark):
    weights = spark.createDataFrame(WEIGHTS, "source string, weight long")
    plan = source_mix.mix(docs_of(spark), weights).select(F.sum("mix.taken"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
