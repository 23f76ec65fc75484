"""State numbers and identifiers."""

from pyspark.sql import functions as F

from checks.registry import check
from checks.states import EVENT_STATES, event_states
from stateweave.operators import history, identity


@check(
    "w1_state_number",
    """SELECT o_orderkey, o_custkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS volgnummer
       FROM orders""",
)
def _(t):
    return history.state_number(t.orders, ["o_custkey"], ["o_orderdate"]).select("o_orderkey", "o_custkey", "volgnummer")


@check(
    "w2_state_number_two_keys",
    """SELECT l_orderkey, l_partkey, l_linenumber,
              dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_quantity) AS volgnummer FROM lineitem""",
)
def _(t):
    out = history.state_number(t.lineitem, ["l_suppkey"], ["l_shipdate", "l_quantity"])
    return out.select("l_orderkey", "l_partkey", "l_linenumber", "volgnummer")


@check(
    "w2b_state_number_null_last",
    f"""WITH s AS ({EVENT_STATES})
        SELECT event_id, user_id,
               dense_rank() OVER (PARTITION BY user_id ORDER BY eind_geldigheid NULLS LAST) AS volgnummer FROM s""",
)
def _(t):
    out = history.state_number(event_states(t), ["user_id"], ["eind_geldigheid"])
    return out.select("event_id", "user_id", "volgnummer")


@check(
    "w1_state_number_by_text",
    """SELECT l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_returnflag ORDER BY code) AS volgnummer
       FROM (SELECT *, 'register-van-objecten-' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS code FROM lineitem)""",
)
def _(t):
    """Three keys hold all rows, and the codes they are ordered by differ late."""
    code = F.concat(F.lit("register-van-objecten-"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"))
    out = history.state_number(t.lineitem.withColumn("code", code), ["l_returnflag"], ["code"])
    return out.select("l_orderkey", "l_linenumber", "volgnummer")


@check(
    "w1_state_number_by_sparse_integer",
    """SELECT l_orderkey, l_linenumber, dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_partkey * 1000003, -l_extendedprice) AS volgnummer FROM lineitem""",
)
def _(t):
    """Integers far apart, then decimals: one distinct state a row."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_partkey") * 1000003).alias("nr"), (-F.col("l_extendedprice")).alias("prijs"))
    return history.state_number(rows, ["l_returnflag"], ["nr", "prijs"]).select("l_orderkey", "l_linenumber", "volgnummer")


TEMPLATE = "1234XXXXXXXX"

# Some customers come with an identifier, some with one that does not fit the template.
_BATCH = """
    SELECT o_orderkey, 'K' || o_custkey AS code,
           CASE WHEN o_custkey % 10 = 3 AND o_orderstatus = 'F' THEN '1234' || lpad(CAST(o_custkey AS VARCHAR), 8, '0')
                WHEN o_custkey % 10 = 7 AND o_orderstatus = 'F' THEN 'ABC' || o_custkey
                WHEN o_custkey % 10 = 5 THEN '' END AS id
    FROM orders
"""


def _batch(t):
    key, final = F.col("o_custkey"), F.col("o_orderstatus") == "F"
    given = (
        F.when((key % 10 == 3) & final, F.concat(F.lit("1234"), F.lpad(key.cast("string"), 8, "0")))
        .when((key % 10 == 7) & final, F.concat(F.lit("ABC"), key.cast("string")))
        .when(key % 10 == 5, F.lit(""))
    )
    return t.orders.select("o_orderkey", F.concat(F.lit("K"), key.cast("string")).alias("code"), given.alias("id"))


@check(
    "w3_autoid",
    f"""WITH b AS ({_BATCH}),
             known AS (SELECT code, min(id) AS known FROM b WHERE id <> '' GROUP BY code),
             top AS (SELECT coalesce(max(CAST(substr(id, 5) AS BIGINT)), 0) AS m FROM b WHERE id LIKE '1234________'),
             fresh AS (SELECT code, m + row_number() OVER (ORDER BY code) AS n FROM
                         (SELECT DISTINCT code FROM b WHERE coalesce(id, '') = '' AND code NOT IN (SELECT code FROM known)), top)
        SELECT o_orderkey, b.code, coalesce(nullif(id, ''), known, '1234' || lpad(CAST(n AS VARCHAR), 8, '0')) AS id
        FROM b LEFT JOIN known k ON b.code = k.code LEFT JOIN fresh f ON b.code = f.code""",
)
def _(t):
    return identity.autoid(_batch(t), "code", "id", TEMPLATE)


@check(
    "w4_autoid_second_load",
    f"""WITH b AS ({_BATCH}),
             reg AS (SELECT 'K' || c_custkey AS code, '1234' || lpad(CAST(c_custkey + 5000000 AS VARCHAR), 8, '0') AS id
                     FROM customer WHERE c_acctbal > 2000),
             known AS (SELECT code, min(id) AS known FROM b WHERE id <> '' GROUP BY code),
             top AS (SELECT max(CAST(substr(id, 5) AS BIGINT)) AS m FROM
                       (SELECT id FROM b UNION ALL SELECT id FROM reg) WHERE id LIKE '1234________'),
             fresh AS (SELECT code, m + row_number() OVER (ORDER BY code) AS n FROM
                         (SELECT DISTINCT code FROM b WHERE coalesce(id, '') = '' AND code NOT IN (SELECT code FROM known)
                          AND code NOT IN (SELECT code FROM reg)), top)
        SELECT o_orderkey, b.code,
               coalesce(nullif(b.id, ''), reg.id, known, '1234' || lpad(CAST(n AS VARCHAR), 8, '0')) AS id
        FROM b LEFT JOIN known k ON b.code = k.code LEFT JOIN fresh f ON b.code = f.code LEFT JOIN reg ON b.code = reg.code""",
)
def _(t):
    number = F.lpad((F.col("c_custkey") + 5000000).cast("string"), 8, "0")
    registry = t.customer.where(F.col("c_acctbal") > 2000).select(
        F.concat(F.lit("K"), F.col("c_custkey").cast("string")).alias("code"), F.concat(F.lit("1234"), number).alias("id")
    )
    return identity.autoid(_batch(t), "code", "id", TEMPLATE, registry)
