"""Filters and predicates."""

from pyspark.sql import functions as F

from checks.registry import check
from stateweave.operators import lookups, predicates

AS_OF = "2000-01-05"


@check("f1_equals_constant", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    return t.orders.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


@check(
    "f2_range_split",
    """SELECT doc_id, CASE WHEN n_chars <= 500 THEN 'onder' ELSE 'boven' END AS deel
       FROM documents WHERE n_chars <= 500 OR n_chars > 500""",
)
def _(t):
    docs = t.documents.select("doc_id", "n_chars")
    below = docs.where(F.col("n_chars") <= 500).select("doc_id", F.lit("onder").alias("deel"))
    above = docs.where(F.col("n_chars") > 500).select("doc_id", F.lit("boven").alias("deel"))
    return below.unionByName(above)


@check(
    "f3_code_in_list",
    "SELECT p_partkey, p_type FROM part WHERE upper(substring(p_type, 2, 2)) IN ('CO', 'MA', 'TA', 'RO')",
)
def _(t):
    return t.part.where(predicates.code_in(F.col("p_type"), 2, 2, ["CO", "MA", "TA", "RO"])).select("p_partkey", "p_type")


@check(
    "f4_soft_delete",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       WHERE nullif(l_returnflag, 'N') IS NULL AND nullif(o_orderstatus, 'O') IS NULL""",
)
def _(t):
    lines = t.lineitem.withColumn("l_deleted", F.nullif("l_returnflag", F.lit("N")))
    heads = t.orders.withColumn("o_deleted", F.nullif("o_orderstatus", F.lit("O")))
    kept = lines.join(heads, F.col("l_orderkey") == F.col("o_orderkey"))
    return kept.where(predicates.alive(F.col("l_deleted"), F.col("o_deleted"))).select(
        "l_orderkey", "l_linenumber", "l_partkey"
    )


@check(
    "f5_key_present",
    """SELECT d.doc_id, CAST(quality AS BIGINT) AS quality FROM documents d
       LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL""",
)
def _(t):
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return joined.where(F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("bigint").alias("quality"))


@check(
    "f6_zero_length_states",
    """WITH s AS (SELECT event_id, ts AS b, CASE WHEN event_type = 'view' THEN ts
                         WHEN event_type <> 'click' THEN ts + INTERVAL 1 DAY END AS e FROM events)
       SELECT event_id FROM s WHERE b <> e OR e IS NULL""",
)
def _(t):
    end = F.when(F.col("event_type") == "view", F.col("ts")).when(
        F.col("event_type") != "click", F.col("ts") + F.expr("INTERVAL 1 DAY")
    )
    return t.events.where(predicates.not_empty_interval(F.col("ts"), end)).select("event_id")


@check("f7_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring%'")
def _(t):
    return t.part.where(F.col("p_name").contains("ring")).select("p_partkey", "p_name")


@check(
    "f8_not_equal_with_null",
    "SELECT event_id FROM events WHERE nullif(event_type, 'error') != 'view'",
)
def _(t):
    return t.events.where(F.nullif("event_type", F.lit("error")) != "view").select("event_id")


@check(
    "f9_and_or_groups",
    "SELECT p_partkey FROM part WHERE (p_size = 7 OR p_size = 8) AND p_type = 'SMALL'",
)
def _(t):
    return t.part.where(((F.col("p_size") == 7) | (F.col("p_size") == 8)) & (F.col("p_type") == "SMALL")).select("p_partkey")


@check(
    "f10_except_known_row",
    """SELECT s_suppkey, s_name FROM supplier
       WHERE NOT (s_name = 'Supplier#000000007' AND s_suppkey = 7)""",
)
def _(t):
    return t.supplier.where(predicates.except_row(s_name="Supplier#000000007", s_suppkey=7)).select("s_suppkey", "s_name")


@check(
    "f11_in_either_or",
    """SELECT p_partkey, p_name FROM part
       WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND l_quantity > 49)
          OR p_partkey IN (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_quantity < 2)
          OR p_size = 8""",
)
def _(t):
    sold = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    sets = [
        sold.where((F.col("o_orderstatus") == "P") & (F.col("l_quantity") > 49)).select("l_partkey"),
        sold.where((F.col("o_orderstatus") == "F") & (F.col("l_quantity") < 2)).select("l_partkey"),
    ]
    return lookups.in_any(t.part, "p_partkey", sets, F.col("p_size") == 8).select("p_partkey", "p_name")


@check(
    "f12_recent_window",
    """WITH d AS (SELECT o_custkey, max(o_orderdate) AS registratiedatum FROM orders GROUP BY o_custkey)
       SELECT o_custkey, registratiedatum FROM d
       WHERE registratiedatum >= TIMESTAMP '2000-01-05 00:00:00' - INTERVAL 10 DAY""",
)
def _(t):
    latest = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("registratiedatum"))
    return latest.where(predicates.recent(F.col("registratiedatum"), AS_OF))


@check(
    "f13_rotating_sample",
    "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_orderkey % 10 = day(DATE '2000-01-05') % 10",
)
def _(t):
    return t.lineitem.where(predicates.rotating_sample(F.col("l_orderkey").cast("string"), AS_OF)).select(
        "l_orderkey", "l_partkey", "l_linenumber"
    )


@check(
    "f14_existing_row_after_left_join",
    """SELECT o_orderkey, c_name FROM orders
       LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) c ON o_custkey = c_custkey
       WHERE c_custkey IS NOT NULL""",
)
def _(t):
    rich = t.customer.where(F.col("c_acctbal") > 5000)
    joined = t.orders.join(rich, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.where(F.col("c_custkey").isNotNull()).select("o_orderkey", "c_name")
