"""Shapes that matter at scale: hot keys give right answers, and plans stay free of costly steps."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from checks import CHECKS
from stateweave.operators import changes, history, lists, quality, relations, segments
from stateweave.operators.relations import Side

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_no_python_workers_and_no_cross_joins(spark, name):
    # Queries that write files or pin an order run jobs while they are built; their plans are seen elsewhere.
    if name.startswith(("s4", "s5", "s6", "s8", "q2_wrong", "w3", "w4", "r3", "j13_relation", "j16_relation_by", "j17_relation", "a2_list_as_rows", "document_files", "restriction_files")):
        pytest.skip("runs a job when it is built")
    text = plan(CHECKS[name](spark, FOLDER))
    assert not re.search(r"Python|Pandas|CartesianProduct|CollectLimit", text)
    assert not re.search(r"BroadcastNestedLoopJoin", text)


def test_parsed_areas_are_never_broadcast(spark):
    # Their table looks small enough for a broadcast, the rings of its geometries need not be.
    for name in ("j16_spatial_relation", "j16_spatial_relation_of_polygons"):
        joins = re.findall(r"\w*Join \[.*__cx.*", plan(CHECKS[name](spark, FOLDER)))
        assert joins and all(j.startswith("SortMergeJoin") for j in joins)


@pytest.fixture
def hot(spark):
    """A third of the rows belong to one key, and most of those are copies of one state."""
    n = 6000
    base = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("k"),
        F.col("id"),
        F.when(F.col("id") % 6 == 0, F.lit(0)).otherwise(F.col("id") % 97).alias("d"),
    )
    begin = F.make_timestamp(F.lit(2000), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(F.col("d").cast("int"))
    return base.select("k", "id", begin.alias("b"), (begin + F.expr("INTERVAL 40 DAYS")).alias("e"))


def test_hot_key_numbering(hot):
    got = {r["id"]: r["volgnummer"] for r in history.state_number(hot, ["k"], ["b"]).collect()}
    states = {}
    rows = hot.collect()
    for r in rows:
        states.setdefault(r["k"], set()).add(r["b"])
    rank = {(k, b): i + 1 for k, bs in states.items() for i, b in enumerate(sorted(bs))}
    assert got == {r["id"]: rank[r["k"], r["b"]] for r in rows}


def test_hot_copies_are_combined_before_the_shuffle(hot):
    # The rows of a key that are dealt to partitions are its distinct states.
    placed = segments.pinned(hot.select("k", "b").distinct(), ["k", "b"])
    assert placed.where("k = 'hot'").count() == hot.where("k = 'hot'").select("b").distinct().count() < 100
    text = plan(history.distinct_states(hot, ["k"], "b", "e"))
    assert text.rindex("partial_count") > text.index("Exchange")
    problems = {r["problem"] for r in quality.interval_problems(hot.where("k = 'hot'"), ["k"], "b", "e").collect()}
    assert "doubled" in problems


def test_hot_relation_is_whole(hot):
    dst = hot.where("id % 2 = 0")
    side = Side("id", "k", None, "b", "e")
    plain = hot.alias("s").join(dst.alias("d"), (F.col("s.k") == F.col("d.k")) & (F.greatest("s.b", "d.b") < F.least("s.e", "d.e")))
    plain = plain.select(F.col("s.id").alias("s_id"), F.col("d.id").alias("d_id"), F.greatest("s.b", "d.b").alias("begin_geldigheid"), F.least("s.e", "d.e").alias("eind_geldigheid"))
    cut = relations.relate_temporal(hot, dst, side, side).where("d_id IS NOT NULL")
    assert plain.count() == cut.count() > 100_000
    assert plain.exceptAll(cut.select(*plain.columns)).count() == 0


def test_hot_list_is_whole(hot):
    listed = lists.ordered_rows(hot, ["k"], "b")
    long = listed.where("k = 'hot'")
    assert long.agg(F.sum("copies")).first()[0] == hot.where("k = 'hot'").count()
    assert long.count() == hot.where("k = 'hot'").select("b").distinct().count() == long.agg(F.max("position")).first()[0]
    assert "collect_list" not in plan(listed)


def test_diff_uses_one_exchange(hot):
    rows = hot.select("k", "b")
    text = plan(changes.snapshot_diff(rows, rows.where("b is not null"), ["k"]))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_scans_are_pruned_and_filtered(spark):
    text = plan(CHECKS["f1_equals_constant"](spark, FOLDER))
    assert "EqualTo(o_orderstatus,F)" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {"o_orderkey", "o_totalprice", "o_orderstatus"}
    files = plan(CHECKS["a1_max_per_group"](spark, FOLDER))
    assert set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<([^>]*)>", files).group(1))) == {"o_custkey", "o_orderdate"}


def test_small_tables_are_broadcast_by_measured_size(spark):
    text = plan(CHECKS["j2_code_lookups"](spark, FOLDER))
    assert text.count("BroadcastHashJoin") == 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Broadcast" not in plan(CHECKS["j2_code_lookups"](spark, FOLDER))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rank_stays_below_the_filter(spark):
    text = plan(CHECKS["j8_rank_before_filter"](spark, FOLDER))
    assert text.count("purchase") and "Window" in text


def test_dates_are_utc(spark):
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.sql("select timestamp'2020-01-01 00:00:00'").first()[0] == dt.datetime(2020, 1, 1)
