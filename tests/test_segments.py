"""Ordered work over range partitions against plain Python, with a key that lies in many of them."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stateweave.operators import history, quality, segments


def states_of(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = rng.choice(["hot", "hot", "a", "b", None])
        begin = rng.randint(0, 300)
        end = rng.choice([begin, begin + rng.randint(1, 5), begin + rng.randint(1, 5), begin + 100, begin - 1, None])
        rows.append((key, begin, end))
    return rows


def plain_problems(rows):
    found = {}
    for key in {r[0] for r in rows}:
        own = sorted({(b, e) for k, b, e in rows if k == key}, key=lambda s: (s[0], s[1] is None, s[1] or 0))
        for i, (b, e) in enumerate(own):
            earlier = [float("inf") if x is None else x for _, x in own[:i]]
            nxt = own[i + 1][0] if i + 1 < len(own) else None
            reached = max(earlier, default=None)
            if e is not None and e < b:
                found[key, b, e] = "reversed"
            elif rows.count((key, b, e)) > 1:
                found[key, b, e] = "doubled"
            elif (nxt is not None and (e is None or nxt < e)) or (reached is not None and b < reached):
                found[key, b, e] = "overlap"
            elif nxt is not None and e is not None and nxt > max(e, reached if reached is not None else e):
                found[key, b, e] = "gap"
    return found


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("kind", ["int", "string", "timestamp", "decimal(20,2)"])
def test_problems_equal_plain_python(spark, seed, kind):
    rows = states_of(seed)
    as_kind = {
        "int": lambda x: x,
        "string": lambda x: None if x is None else f"{x + 1000:08d}",
        "timestamp": lambda x: None if x is None else dt.datetime(2000, 1, 1) + dt.timedelta(days=x),
        "decimal(20,2)": lambda x: None if x is None else __import__("decimal").Decimal(x) * 1000003,
    }[kind]
    df = spark.createDataFrame([(k, as_kind(b), as_kind(e)) for k, b, e in rows], f"k string, b {kind}, e {kind}").repartition(5)
    got = {(r.k, r.b, r.e): r.problem for r in quality.interval_problems(df, ["k"], "b", "e").collect()}
    assert got == {(k, as_kind(b), as_kind(e)): p for (k, b, e), p in plain_problems(rows).items()}


def test_a_state_inside_an_early_one(frame):
    df = frame("k int, b int, e int", (1, 0, 100), (1, 10, 20), (1, 30, 40), (1, 120, 130), (1, 130, None))
    got = {r.b: r.problem for r in quality.interval_problems(df, ["k"], "b", "e").collect()}
    # Nothing is missing before 30, as the first state still runs; between its end and 120 something is.
    assert got == {0: "overlap", 10: "overlap", 30: "overlap"}
    later = frame("k int, b int, e int", (1, 0, 100), (1, 10, 20), (1, 120, 130))
    found = {r.b: (r.problem, r.next_begin) for r in quality.interval_problems(later, ["k"], "b", "e").collect()}
    assert found == {0: ("overlap", 10), 10: ("overlap", 120)}
    assert quality.interval_problems(later.limit(0), ["k"], "b", "e").collect() == []


@pytest.mark.parametrize("order", ["code", "sparse", "exact", "moment"])
def test_a_hot_key_is_numbered_over_many_partitions(spark, order):
    n = 3000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("k"),
        F.concat(F.lit("the-same-beginning-of-each-"), F.lpad((F.col("id") * 7919 % 1500).cast("string"), 6, "0")).alias("code"),
        ((F.col("id") * 7919 % 1500) * 10**9).alias("sparse"),
        ((F.col("id") * 7919 % 1500) / 7).cast("decimal(20,6)").alias("exact"),
        F.timestamp_seconds(F.col("id") * 7919 % 1500).alias("moment"),
        "id",
    )
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        placed = segments.pinned(df.select("k", order).distinct(), ["k", order])
        share = placed.where("k = 'hot'").groupBy(segments.PART).count().collect()
        assert len(share) >= 4 and max(r["count"] for r in share) < 0.5 * sum(r["count"] for r in share)
        got = {r.id: r.volgnummer for r in history.state_number(df, ["k"], [order]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = df.collect()
    by = {}
    for r in rows:
        by.setdefault(r.k, set()).add(r[order])
    rank = {(k, v): i for k, own in by.items() for i, v in enumerate(sorted(own), 1)}
    assert got == {r.id: rank[r.k, r[order]] for r in rows}


def test_only_keys_in_several_partitions_are_carried(spark, monkeypatch):
    """Keys that lie whole in a partition met what others carried in a sorted join."""
    monkeypatch.setattr(segments, "staged", lambda df, label: df)
    df = spark.createDataFrame([(k, b) for k in range(20) for b in range(3)], "key long, begin long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = segments.with_neighbours(df, ["key"], [F.col("begin").asc()], F.col("begin"), F.col("begin"), "next", "reached")
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
