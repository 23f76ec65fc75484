"""Aggregations and sorting."""

from pyspark.sql import functions as F

from checks.registry import check
from stateweave.functions import text
from stateweave.operators import identity, lists


@check("a1_max_per_group", "SELECT o_custkey, max(o_orderdate) AS laatst FROM orders GROUP BY o_custkey")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("laatst"))


@check(
    "a2_ordered_list_with_max",
    """SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ';' ORDER BY l_partkey) AS onderdelen,
              max(l_shipdate) AS laatst FROM lineitem GROUP BY l_orderkey""",
)
def _(t):
    latest = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("laatst"))
    return lists.ordered_text(t.lineitem, ["l_orderkey"], "l_partkey", out="onderdelen").join(latest, "l_orderkey")


@check(
    "a2_list_as_rows",
    """SELECT o_custkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS positie, o_orderpriority AS soort, count(*) AS aantal
       FROM orders GROUP BY o_custkey, o_orderpriority""",
)
def _(t):
    return lists.ordered_rows(t.orders, ["o_custkey"], "o_orderpriority", out="soort", position="positie", copies="aantal")


@check(
    "a3_list_ordered_by_value",
    """SELECT user_id, date_trunc('day', ts) AS dag, string_agg(event_type, ';' ORDER BY event_type) AS soorten
       FROM events GROUP BY ALL""",
)
def _(t):
    days = t.events.select("user_id", F.date_trunc("day", "ts").alias("dag"), "event_type")
    return lists.ordered_text(days, ["user_id", "dag"], "event_type", out="soorten")


@check(
    "a4_group_by_expression",
    """SELECT regexp_extract(p_name, '^([^_ ]*)[_ ]', 1) AS dossier, count(*) AS aantal, max(p_retailprice) AS hoogste
       FROM part GROUP BY 1""",
)
def _(t):
    return t.part.groupBy(text.prefix_before(F.col("p_name")).alias("dossier")).agg(
        F.count(F.lit(1)).alias("aantal"), F.max("p_retailprice").alias("hoogste")
    )


@check(
    "a6_max_sequence",
    """SELECT coalesce(max(CAST(substr(c_name, 10) AS BIGINT)), 0) AS max_sequence FROM customer
       WHERE starts_with(c_name, 'Customer#') AND length(c_name) = 18""",
)
def _(t):
    return identity.max_sequence(t.customer, "c_name", "Customer#XXXXXXXXX")


@check("o1_global_sort", "SELECT n_regionkey, n_name FROM nation ORDER BY n_regionkey NULLS LAST, n_name DESC")
def _(t):
    return t.nation.select("n_regionkey", "n_name").orderBy(F.col("n_regionkey").asc_nulls_last(), F.desc("n_name"))
