"""Validation, load guards, protection and the definition registry."""

from pyspark.sql import functions as F

from checks.registry import check
from checks.states import EVENT_STATES, event_states
from stateweave.operators import protect, quality
from stateweave.plans import definition
from stateweave.session import shared_path
from stateweave.sources import files


def _dirty(t):
    """Lines as text, with a bad quantity, flag or date in some rows."""
    k = F.col("l_partkey")
    text = lambda c: F.col(c).cast("string")
    return t.lineitem.select(
        text("l_orderkey").alias("id"),
        F.when(k % 11 == 0, F.concat(text("l_linenumber"), F.lit("invalid"))).otherwise(text("l_linenumber")).alias("regel"),
        F.when(k % 13 == 0, F.lit("Jinvalid")).otherwise(F.lit("J")).alias("vlag"),
        F.when(k % 17 == 0, F.lit("01-01-2001invalid")).otherwise(F.date_format("l_shipdate", "MM-dd-yyyy")).alias("datum"),
        F.when(k % 19 == 0, F.lit("POINT (1 )")).otherwise(F.lit("POINT (1 2)")).alias("punt"),
    )


_TYPES = {
    "regel": ("integer", None),
    "vlag": ("boolean", "JN"),
    "datum": ("date", "%m-%d-%Y"),
    "punt": ("geometry", None),
}


@check(
    "q1_quarantine",
    """SELECT CAST(l_orderkey AS VARCHAR) AS id, 'regel' AS attribute, l_linenumber || 'invalid' AS value FROM lineitem WHERE l_partkey % 11 = 0
       UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'vlag', 'Jinvalid' FROM lineitem WHERE l_partkey % 13 = 0
       UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'datum', '01-01-2001invalid' FROM lineitem WHERE l_partkey % 17 = 0
       UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'punt', 'POINT (1 )' FROM lineitem WHERE l_partkey % 19 = 0""",
)
def _(t):
    return quality.split_valid(_dirty(t), _TYPES, ["id"])[1]


@check(
    "q1_valid_rows",
    """SELECT CAST(l_orderkey AS VARCHAR) AS id, CAST(l_linenumber AS VARCHAR) AS regel, 'J' AS vlag,
              strftime(l_shipdate, '%m-%d-%Y') AS datum, 'POINT (1 2)' AS punt FROM lineitem
       WHERE l_partkey % 11 <> 0 AND l_partkey % 13 <> 0 AND l_partkey % 17 <> 0 AND l_partkey % 19 <> 0""",
)
def _(t):
    return quality.split_valid(_dirty(t), _TYPES, ["id"])[0]


@check(
    "q2_field_count",
    """SELECT CAST(c_custkey AS VARCHAR) || ',' || c_name || CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 7 = 1
                THEN ',' || c_mktsegment || ',' ELSE ',' || c_mktsegment END AS line,
              CASE WHEN c_custkey % 7 = 0 THEN CAST(2 AS BIGINT) ELSE 4 END AS n_fields
       FROM customer WHERE c_custkey % 7 < 2""",
)
def _(t):
    k = F.col("c_custkey") % 7
    tail = F.when(k == 0, F.lit("")).when(k == 1, F.concat(F.lit(","), "c_mktsegment", F.lit(","))).otherwise(
        F.concat(F.lit(","), "c_mktsegment")
    )
    lines = t.customer.select(F.concat(F.col("c_custkey").cast("string"), F.lit(","), "c_name", tail).alias("line"))
    return quality.wrong_field_count(lines, "line", 3)


@check(
    "q2_wrong_width_rows_of_a_file",
    """SELECT CAST(c_custkey AS VARCHAR) AS key, CAST(c_custkey AS VARCHAR) || ',' || c_name AS line FROM customer WHERE c_custkey % 7 = 0""",
)
def _(t):
    path = shared_path(t.spark, "csv")
    short = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name")
    full = F.concat_ws(",", short, "c_mktsegment")
    t.customer.select(F.when(F.col("c_custkey") % 7 == 0, short).otherwise(full)).write.text(path)
    rows = files.scan_csv(t.spark, path, columns=["key", "name", "segment"], flag_wrong_width=True, header=False)
    return rows.where(F.col(files.CORRUPT).isNotNull()).select("key", F.col(files.CORRUPT).alias("line"))


@check(
    "q3_minimum_rows",
    """SELECT 'orders' AS dataset, count(*) AS rows, CAST(1 AS BIGINT) AS min_rows, count(*) >= 1 AS ok FROM orders
       UNION ALL SELECT 'oud', count(*), 1, count(*) >= 1 FROM orders WHERE o_orderdate < TIMESTAMP '1990-01-01 00:00:00'
       UNION ALL SELECT 'leeg', count(*), 0, count(*) >= 0 FROM orders WHERE o_orderdate < TIMESTAMP '1990-01-01 00:00:00'""",
)
def _(t):
    old = t.orders.where(F.col("o_orderdate") < "1990-01-01")
    return quality.row_guard({"orders": (t.orders, 1), "oud": (old, 1), "leeg": (old, 0)})


# Model, mapped and not-provided attributes read off the orders: a customer stands
# for a dataset, an order for an attribute.
_CONTRACT = """
    SELECT 'd' || o_custkey AS dataset, 'a' || o_orderkey AS attribute, o_orderstatus <> 'P' OR o_totalprice > 250000 AS m,
           o_orderstatus = 'P' AND o_totalprice > 100000 AS n, o_orderpriority <> '5-LOW' AS k FROM orders
"""


@check(
    "q4_attribute_completeness",
    f"""SELECT dataset, attribute, CASE WHEN NOT k THEN 'unknown' WHEN NOT m AND NOT n THEN 'missing' ELSE 'overlap' END AS problem
        FROM ({_CONTRACT}) WHERE (NOT k AND (m OR n)) OR (k AND m = n)""",
)
def _(t):
    price = F.col("o_totalprice")
    pending = F.col("o_orderstatus") == "P"
    named = lambda rows: rows.select(
        F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("dataset"),
        F.concat(F.lit("a"), F.col("o_orderkey").cast("string")).alias("attribute"),
    )
    return quality.completeness(
        mapped=named(t.orders.where(~pending | (price > 250000))),
        not_provided=named(t.orders.where(pending & (price > 100000))),
        model=named(t.orders.where(F.col("o_orderpriority") != "5-LOW")),
    )


@check(
    "q5_source_column_coverage",
    """SELECT DISTINCT 'd' || l_suppkey AS dataset, 'c' || l_partkey AS "column" FROM lineitem WHERE l_returnflag = 'A'
       EXCEPT SELECT 'd' || l_suppkey, 'c' || l_partkey FROM lineitem WHERE l_returnflag = 'N'""",
)
def _(t):
    named = lambda flag: t.lineitem.where(F.col("l_returnflag") == flag).select(
        F.concat(F.lit("d"), F.col("l_suppkey").cast("string")).alias("dataset"),
        F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("column"),
    )
    return quality.uncovered_columns(named("A"), named("N"))


# A customer's orders stand for the definitions of an entity; the priority is the application.
_DEFINITIONS = """
    SELECT 'c' || (o_custkey % 25) AS catalogue, 'e' || o_custkey AS entity, o_orderpriority AS application,
           o_orderstatus = 'F' AND o_totalprice > 250000 AS is_default, 'f' || o_orderkey AS file FROM orders
"""


def _definitions(t):
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    return t.orders.select(
        text("c", F.col("o_custkey") % 25).alias("catalogue"),
        text("e", F.col("o_custkey")).alias("entity"),
        F.col("o_orderpriority").alias("application"),
        ((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 250000)).alias("is_default"),
        text("f", F.col("o_orderkey")).alias("file"),
    )


@check(
    "q6_duplicate_definitions",
    f"""WITH d AS ({_DEFINITIONS}),
             a AS (SELECT catalogue, entity, application, count(*) AS n, count(*) FILTER (is_default) AS d FROM d GROUP BY ALL)
        SELECT catalogue, entity, CAST(count(*) FILTER (n > 1) AS BIGINT) AS doubled_applications, CAST(sum(d) AS BIGINT) AS defaults
        FROM a GROUP BY ALL HAVING count(*) FILTER (n > 1) > 0 OR sum(d) > 1""",
)
def _(t):
    return quality.duplicate_definitions(_definitions(t))


@check(
    "r1_find_definition",
    f"""WITH d AS ({_DEFINITIONS}),
             r AS (SELECT c_custkey AS request, 'c' || (c_custkey % 25) AS catalogue,
                          CASE WHEN c_custkey % 50 = 0 THEN 'onbekend' ELSE 'e' || c_custkey END AS entity,
                          CASE WHEN c_custkey % 3 = 0 THEN '1-URGENT' END AS application FROM customer),
             p AS (SELECT catalogue, entity, count(*) AS n, min(file) FILTER (is_default) AS deflt, min(file) AS one FROM d GROUP BY ALL),
             x AS (SELECT catalogue, entity, application, min(file) AS named FROM d GROUP BY ALL),
             f AS (SELECT r.*, n, CASE WHEN r.application IS NOT NULL THEN named ELSE coalesce(deflt, CASE WHEN n = 1 THEN one END) END AS file
                   FROM r LEFT JOIN p ON r.catalogue = p.catalogue AND r.entity = p.entity
                   LEFT JOIN x ON r.catalogue = x.catalogue AND r.entity = x.entity AND r.application = x.application)
        SELECT request, catalogue, entity, application, file,
               CASE WHEN file IS NULL THEN CASE WHEN application IS NULL AND n > 1
                 THEN 'several applications, none is the default' ELSE 'no definition' END END AS error FROM f""",
)
def _(t):
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    key = F.col("c_custkey")
    requests = t.customer.select(
        key.alias("request"),
        text("c", key % 25).alias("catalogue"),
        F.when(key % 50 == 0, F.lit("onbekend")).otherwise(text("e", key)).alias("entity"),
        F.when(key % 3 == 0, F.lit("1-URGENT")).alias("application"),
    )
    return definition.find_definitions(requests, _definitions(t))


@check(
    "q7_duplicate_keys",
    "SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1",
)
def _(t):
    return quality.duplicate_keys(t.orders, ["o_custkey", "o_orderdate"])


@check(
    "q8_interval_problems",
    f"""WITH s AS (SELECT user_id, begin_geldigheid, eind_geldigheid, count(*) AS copies FROM ({EVENT_STATES}) GROUP BY ALL),
             n AS (SELECT *, lead(begin_geldigheid) OVER w AS next_begin,
                          max(coalesce(eind_geldigheid, TIMESTAMP '9999-12-31')) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
                   FROM s WINDOW w AS (PARTITION BY user_id ORDER BY begin_geldigheid, eind_geldigheid NULLS LAST))
        SELECT user_id, begin_geldigheid, eind_geldigheid, copies, next_begin, problem FROM (
          SELECT *, CASE WHEN eind_geldigheid < begin_geldigheid THEN 'reversed' WHEN copies > 1 THEN 'doubled'
                         WHEN next_begin IS NOT NULL AND (eind_geldigheid IS NULL OR next_begin < eind_geldigheid) OR begin_geldigheid < reached THEN 'overlap'
                         WHEN next_begin > greatest(eind_geldigheid, coalesce(reached, eind_geldigheid)) THEN 'gap' END AS problem FROM n)
        WHERE problem IS NOT NULL""",
)
def _(t):
    return quality.interval_problems(event_states(t), ["user_id"], "begin_geldigheid", "eind_geldigheid")


@check(
    "q8_interval_problems_doubled",
    """WITH s AS (SELECT o_custkey, o_orderdate AS b, o_orderdate + INTERVAL 30 DAY * (CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END) AS e FROM orders),
            g AS (SELECT o_custkey, b, e, count(*) AS copies FROM s GROUP BY ALL),
            n AS (SELECT *, lead(b) OVER w AS next_begin, max(e) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
                  FROM g WINDOW w AS (PARTITION BY o_custkey ORDER BY b, e))
       SELECT o_custkey, b, e, copies, next_begin, problem FROM (
         SELECT *, CASE WHEN e < b THEN 'reversed' WHEN copies > 1 THEN 'doubled' WHEN next_begin < e OR b < reached THEN 'overlap'
                        WHEN next_begin > greatest(e, coalesce(reached, e)) THEN 'gap' END AS problem FROM n)
       WHERE problem IS NOT NULL""",
)
def _(t):
    month = F.expr("INTERVAL 30 DAYS")
    end = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") - month).otherwise(F.col("o_orderdate") + month)
    states = t.orders.select("o_custkey", F.col("o_orderdate").alias("b"), end.alias("e"))
    return quality.interval_problems(states, ["o_custkey"], "b", "e")


@check(
    "q8_nested_intervals",
    """WITH s AS (SELECT l_partkey, CAST(l_shipdate AS DATE)::VARCHAR AS b,
                         CASE WHEN l_returnflag = 'A' THEN NULL WHEN l_linenumber = 1 THEN '2100-01-01'
                              ELSE CAST(l_shipdate + INTERVAL 1 DAY * CAST(l_quantity AS INTEGER) AS DATE)::VARCHAR END AS e FROM lineitem WHERE l_linenumber < 4),
            g AS (SELECT l_partkey, b, e, count(*) AS copies FROM s GROUP BY ALL),
            n AS (SELECT *, lead(b) OVER w AS next_begin, max(coalesce(e, '9999')) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
                  FROM g WINDOW w AS (PARTITION BY l_partkey ORDER BY b, e NULLS LAST))
       SELECT l_partkey, b, e, copies, next_begin, problem FROM (
         SELECT *, CASE WHEN e < b THEN 'reversed' WHEN copies > 1 THEN 'doubled'
                        WHEN (e IS NULL AND next_begin IS NOT NULL) OR next_begin < e OR b < reached THEN 'overlap'
                        WHEN next_begin > greatest(e, coalesce(reached, e)) THEN 'gap' END AS problem FROM n)
       WHERE problem IS NOT NULL""",
)
def _(t):
    """Text dates, with parts that have states inside others and states that never end."""
    day = F.expr("date_add(to_date(l_shipdate), cast(l_quantity as int))").cast("string")
    end = F.when(F.col("l_returnflag") == "A", F.lit(None)).when(F.col("l_linenumber") == 1, F.lit("2100-01-01")).otherwise(day)
    lines = t.lineitem.where("l_linenumber < 4")
    states = lines.select("l_partkey", F.to_date("l_shipdate").cast("string").alias("b"), end.alias("e"))
    return quality.interval_problems(states, ["l_partkey"], "b", "e")


@check(
    "q9_empty_load",
    "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderdate AS moment FROM orders WHERE o_orderdate < TIMESTAMP '1990-01-01 00:00:00'",
)
def _(t):
    empty = t.orders.where(F.col("o_orderdate") < "1990-01-01")
    rows = empty.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").alias("moment"))
    return quality.split_valid(rows, {"id": ("string", None)}, ["id"])[0]


@check(
    "q9_empty_load_accepted",
    """SELECT 'leeg' AS dataset, count(*) AS rows, CAST(0 AS BIGINT) AS min_rows, true AS ok FROM orders
       WHERE o_orderdate < TIMESTAMP '1990-01-01 00:00:00'""",
)
def _(t):
    empty = t.orders.where(F.col("o_orderdate") < "1990-01-01").select(F.col("o_orderkey").cast("string").alias("id"))
    return quality.row_guard({"leeg": (quality.split_valid(empty, {"id": ("integer", None)}, ["id"])[0], 0)})


@check(
    "k1_protected_columns",
    """SELECT c_custkey, sha256('zout' || c_name) AS secure_naam, sha256('zout' || CAST(c_nationkey AS VARCHAR)) AS secure_ref,
              c_mktsegment, regexp_replace(regexp_replace(regexp_replace(c_name, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS masker,
              c_name AS terug FROM customer""",
)
def _(t):
    key = F.lit("0123456789abcdef")
    ref = F.struct(F.col("c_nationkey").cast("string").alias("bronwaarde"))
    rows = t.customer.select(
        "c_custkey",
        F.col("c_name").alias("secure_naam"),
        ref.alias("secure_ref"),
        "c_mktsegment",
        protect.masked(F.col("c_name")).alias("masker"),
        protect.decrypted(protect.encrypted(F.col("c_name"), key), key).alias("terug"),
    )
    out = protect.protect(rows, "zout")
    return out.withColumn("secure_ref", F.col("secure_ref.bronwaarde"))
