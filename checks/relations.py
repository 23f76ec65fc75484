"""Relations by key, attribute and time.

Orders are source states of their customer; the same orders, shifted, are the
destination states, so every customer has several on both sides.
"""

from pyspark.sql import functions as F

from checks.registry import check
from stateweave.operators import history, relations
from stateweave.plans import relate, runner
from stateweave.plans.definition import Definition
from stateweave.operators.relations import Side


@check(
    "j11_resolve_by_key",
    """SELECT l_orderkey AS src, l_linenumber AS regel, CAST(l_partkey AS BIGINT) AS bronwaarde, p_partkey AS dst_id
       FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey""",
)
def _(t):
    refs = t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_linenumber").alias("regel"), F.col("l_partkey").alias("bronwaarde"))
    return relations.resolve_references(refs, t.part.where(F.col("p_size") > 10), "p_partkey", "p_partkey")


@check(
    "j11_resolve_list_of_references",
    """WITH r AS (SELECT l_orderkey AS src, l_partkey AS regel, unnest([l_partkey, l_suppkey]) AS bronwaarde FROM lineitem)
       SELECT src, regel, CAST(bronwaarde AS VARCHAR) AS bronwaarde, CAST(p_partkey AS VARCHAR) AS dst_id FROM r
       LEFT JOIN part ON bronwaarde = p_partkey""",
)
def _(t):
    item = lambda c: F.struct(F.col(c).cast("string").alias("bronwaarde"))
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("regel"), F.array(item("l_partkey"), item("l_suppkey")).alias("refs")
    )
    refs = relations.explode_references(rows, "refs", ["src", "regel"])
    parts = t.part.select(F.col("p_partkey").cast("string").alias("id"))
    return relations.resolve_references(refs, parts, "id", "id")


@check(
    "j12_resolve_by_attribute_multiple",
    """SELECT c_custkey AS src, c_custkey AS bronwaarde, o_orderkey AS dst_id FROM customer LEFT JOIN orders ON c_custkey = o_custkey""",
)
def _(t):
    refs = t.customer.select(F.col("c_custkey").alias("src"), F.col("c_custkey").alias("bronwaarde"))
    return relations.resolve_references(refs, t.orders, "o_orderkey", "o_custkey", multiple=True)


@check(
    "j12_resolve_by_attribute_single",
    """SELECT c_custkey AS src, c_mktsegment AS bronwaarde, low AS dst_id FROM customer
       LEFT JOIN (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'MACHINERY' WHEN 1 THEN 'BUILDING' ELSE 'S' || s_suppkey END AS seg,
                         min(s_suppkey) AS low FROM supplier GROUP BY seg) ON c_mktsegment = seg""",
)
def _(t):
    refs = t.customer.select(F.col("c_custkey").alias("src"), F.col("c_mktsegment").alias("bronwaarde"))
    k = F.col("s_suppkey") % 4
    kind = F.when(k == 0, "MACHINERY").when(k == 1, "BUILDING").otherwise(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")))
    dst = t.supplier.select("s_suppkey", kind.alias("soort"))
    return relations.resolve_references(refs, dst, "s_suppkey", "soort")


_SRC = """SELECT o_orderkey AS s_id, o_orderkey % 5 AS s_number, o_custkey AS s_match, o_orderdate AS b,
                 CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 60 DAY WHEN o_orderstatus = 'O' THEN o_orderdate END AS e,
                 CASE WHEN o_orderpriority = '5-LOW' THEN o_orderdate + INTERVAL 30 DAY ELSE o_orderdate END AS rb
          FROM orders"""
_DST = """SELECT o_orderkey AS d_id, o_orderkey % 7 AS d_number, o_custkey AS d_match, o_orderdate + INTERVAL 100 DAY AS b,
                 CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate + INTERVAL 400 DAY END AS e FROM orders"""
_WHOLE = f"""
    SELECT s_id, s_number, s_match, d_id, d_number, greatest(s.rb, d.b) AS begin_geldigheid, least(s.e, d.e) AS eind_geldigheid
    FROM (SELECT * FROM ({_SRC}) WHERE b <> e OR e IS NULL) s
    JOIN ({_DST}) d ON s_match = d_match
     AND (least(s.e, d.e) IS NULL OR greatest(s.rb, d.b) < least(s.e, d.e))
"""
_POINTS = f"""
    SELECT s_id, s_number, s_match, d_id, d_number, b AS begin_geldigheid, e AS eind_geldigheid FROM (
      SELECT s.*, d_id, d_number, row_number() OVER (PARTITION BY s_id ORDER BY
               CASE WHEN d.b <= s.b AND (d.e IS NULL OR s.b < d.e) THEN 1 ELSE 0 END DESC, d_number DESC, d_id DESC) AS rn
      FROM ({_SRC}) s JOIN ({_DST}) d ON s_match = d_match
       AND ((d.b <= s.b AND (d.e IS NULL OR s.b < d.e)) OR d.e = s.b)
      WHERE s.b = s.e) WHERE rn = 1
"""


def _with_unmatched(matched, src):
    return f"""WITH m AS ({matched}) SELECT * FROM m UNION ALL
               SELECT s_id, s_number, s_match, NULL, NULL, NULL, NULL FROM ({src}) WHERE s_id NOT IN (SELECT s_id FROM m)"""


def _source(t):
    final, pending = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O"
    start = F.col("o_orderdate")
    end = F.when(final, start + F.expr("INTERVAL 60 DAYS")).when(pending, start)
    ref = F.when(F.col("o_orderpriority") == "5-LOW", start + F.expr("INTERVAL 30 DAYS"))
    return t.orders.select(
        "o_orderkey", (F.col("o_orderkey") % 5).alias("nr"), "o_custkey", start.alias("b"), end.alias("e"), ref.alias("rb")
    )


def _destination(t):
    start = F.col("o_orderdate")
    end = F.when(F.col("o_orderpriority") != "1-URGENT", start + F.expr("INTERVAL 400 DAYS"))
    return t.orders.select(
        "o_orderkey", (F.col("o_orderkey") % 7).alias("nr"), "o_custkey", (start + F.expr("INTERVAL 100 DAYS")).alias("b"), end.alias("e")
    )


STATES = Side("o_orderkey", "o_custkey", "nr", "b", "e")


@check("j13_temporal_relation", _with_unmatched(_WHOLE, f"SELECT * FROM ({_SRC}) WHERE b <> e OR e IS NULL"))
def _(t):
    return relations.relate_temporal(history.drop_empty_states(_source(t), "b", "e"), _destination(t), STATES, STATES, ref_begin="rb")


@check(
    "j14_stateless_destination",
    f"""SELECT s_id, s_number, s_match, c_custkey AS d_id, CAST(NULL AS BIGINT) AS d_number,
               CASE WHEN c_custkey IS NOT NULL THEN b END AS begin_geldigheid, CASE WHEN c_custkey IS NOT NULL THEN e END AS eind_geldigheid
        FROM ({_SRC}) LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON s_match = c_custkey WHERE b <> e OR e IS NULL""",
)
def _(t):
    rich = t.customer.where(F.col("c_acctbal") > 0)
    return relations.relate_temporal(history.drop_empty_states(_source(t), "b", "e"), rich, STATES, Side("c_custkey", "c_custkey"))


@check(
    "j14_stateless_source",
    f"""SELECT c_custkey AS s_id, CAST(NULL AS BIGINT) AS s_number, c_custkey AS s_match, d_id, d_number, b AS begin_geldigheid,
               e AS eind_geldigheid FROM customer LEFT JOIN ({_DST}) ON c_custkey = d_match""",
)
def _(t):
    return relations.relate_temporal(t.customer, _destination(t), Side("c_custkey", "c_custkey"), STATES)


@check("j15_collapsed_states", _with_unmatched(_POINTS, f"SELECT * FROM ({_SRC}) WHERE b = e"))
def _(t):
    return relations.relate_temporal(_source(t).where(F.col("b") == F.col("e")), _destination(t), STATES, STATES)


@check(
    "j13_gaps_filled",
    f"""WITH s AS (SELECT * FROM ({_SRC}) WHERE b <> e OR e IS NULL), d AS ({_DST}),
             f AS (SELECT s.*, d_id, d_number, greatest(s.b, d.b) AS fb, least(s.e, d.e) AS fe FROM s
                   JOIN (SELECT * FROM d) d ON s_match = d_match AND (least(s.e, d.e) IS NULL OR greatest(s.b, d.b) < least(s.e, d.e))),
             o AS (SELECT *, max(coalesce(fe, TIMESTAMP '9999-12-31')) OVER (PARTITION BY s_id ORDER BY fb ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM f),
             g AS (SELECT s_id, s_number, s_match, coalesce(reached, b) AS gb, fb AS ge FROM o WHERE coalesce(reached, b) < fb
                   UNION ALL
                   SELECT s_id, s_number, s_match, m, e FROM (SELECT s_id, s_number, s_match, e, max(coalesce(fe, TIMESTAMP '9999-12-31')) AS m FROM f GROUP BY ALL)
                   WHERE m < coalesce(e, TIMESTAMP '9999-12-31'))
       SELECT s_id, s_number, s_match, d_id, d_number, fb AS begin_geldigheid, fe AS eind_geldigheid FROM f
       UNION ALL SELECT s_id, s_number, s_match, NULL, NULL, gb, ge FROM g
       UNION ALL SELECT s_id, s_number, s_match, NULL, NULL, NULL, NULL FROM s WHERE s_id NOT IN (SELECT s_id FROM f)""",
)
def _(t):
    return relations.relate_temporal(history.drop_empty_states(_source(t), "b", "e"), _destination(t), STATES, STATES, fill_gaps=True)


def _defined(entity_id, **mapping):
    source = {"name": "S", "application": "F", "entity_id": entity_id}
    return Definition.from_dict({"catalogue": "c", "entity": "e", "source": source, "mapping": mapping})


def _related(definition, extract, name, target, types=None):
    entity = runner.run(definition, extract, types).entity
    return relate.relate(definition, entity, {name: target})[name]


@check(
    "j16_relation_by_definition",
    """SELECT CAST(s_suppkey AS VARCHAR) AS src_id, CAST(NULL AS BIGINT) AS src_volgnummer, CAST(NULL AS VARCHAR) AS bronwaarde,
              CAST(min(p_partkey) AS VARCHAR) AS dst_id, CAST(NULL AS BIGINT) AS dst_volgnummer,
              CAST(NULL AS TIMESTAMP) AS begin_geldigheid, CAST(NULL AS TIMESTAMP) AS eind_geldigheid
       FROM supplier LEFT JOIN part ON s_suppkey + 0.5 > p_partkey * 3 AND s_suppkey + 0.5 < p_partkey * 3 + 2 GROUP BY s_suppkey""",
)
def _(t):
    d = _defined("s_suppkey", geometrie={"source_mapping": "punt"}, ligt_in={"source_mapping": {"bronwaarde": "=geometrie"}})
    points = t.supplier.select("s_suppkey", F.format_string("POINT (%d.5 1)", F.col("s_suppkey")).alias("punt"))
    x = F.col("p_partkey") * 3
    areas = t.part.select("p_partkey", F.format_string("POLYGON ((%1$d 0, %2$d 0, %2$d 2, %1$d 2, %1$d 0))", x, x + 2).alias("vlak"))
    return _related(d, points, "ligt_in", relate.Destination(areas, "p_partkey", geometry="vlak"))


@check(
    "j17_relation_by_definition",
    """SELECT CAST(c_custkey AS VARCHAR) AS src_id, CAST(NULL AS BIGINT) AS src_volgnummer, CAST(c_custkey AS VARCHAR) AS bronwaarde,
              CAST(o_orderkey AS VARCHAR) AS dst_id, CAST(NULL AS BIGINT) AS dst_volgnummer,
              CAST(NULL AS TIMESTAMP) AS begin_geldigheid, CAST(NULL AS TIMESTAMP) AS eind_geldigheid
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey""",
)
def _(t):
    d = _defined("c_custkey", nummer={"source_mapping": "c_custkey"}, heeft={"source_mapping": {"bronwaarde": "=nummer"}})
    return _related(d, t.customer, "heeft", relate.Destination(t.orders, "o_orderkey", "o_custkey"))


@check(
    "j13_relation_by_definition",
    """SELECT CAST(o.o_orderkey AS VARCHAR) AS src_id, CAST(1 AS BIGINT) AS src_volgnummer, CAST(o.o_custkey AS VARCHAR) AS bronwaarde,
              CAST(k.c_custkey AS VARCHAR) AS dst_id, CAST(nr AS BIGINT) AS dst_volgnummer,
              CASE WHEN nr IS NOT NULL THEN greatest(date_trunc('day', o.o_orderdate), k.b) END AS begin_geldigheid,
              CASE WHEN nr IS NOT NULL THEN k.e END AS eind_geldigheid
       FROM orders o LEFT JOIN (SELECT c_custkey, 1 AS nr, TIMESTAMP '1990-01-01' AS b, TIMESTAMP '1996-01-01' AS e FROM customer
                                UNION ALL SELECT c_custkey, 2, TIMESTAMP '1996-01-01', NULL FROM customer) k
         ON o.o_custkey = k.c_custkey AND (k.e IS NULL OR greatest(date_trunc('day', o.o_orderdate), k.b) < k.e)""",
)
def _(t):
    d = _defined(
        "o_orderkey",
        volgnummer={"source_mapping": "nr"},
        begin_geldigheid={"source_mapping": "dag", "format": "%Y-%m-%d"},
        van={"source_mapping": {"bronwaarde": "o_custkey"}},
    )
    orders = t.orders.select("o_orderkey", F.lit(1).alias("nr"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("dag"), F.col("o_custkey").cast("string").alias("o_custkey"))
    at = lambda y: F.lit(f"{y}-01-01").cast("timestamp")
    first = t.customer.select("c_custkey", F.lit(1).alias("nr"), at(1990).alias("b"), at(1996).alias("e"))
    second = t.customer.select("c_custkey", F.lit(2).alias("nr"), at(1996).alias("b"), F.lit(None).cast("timestamp").alias("e"))
    target = relate.Destination(first.unionByName(second), "c_custkey", number="nr", begin="b", end="e")
    return _related(d, orders, "van", target)


@check(
    "j17_inverse_by_shared_key",
    """SELECT o_orderkey, l_linenumber, l_partkey FROM orders LEFT JOIN
         (SELECT * FROM lineitem WHERE l_quantity > 25) ON o_orderkey = l_orderkey""",
)
def _(t):
    big = t.lineitem.where(F.col("l_quantity") > 25)
    return relations.relate_inverse(t.orders.select("o_orderkey"), big, "o_orderkey", "l_orderkey", ["l_linenumber", "l_partkey"])


@check(
    "j18_dangling_references",
    "SELECT o_orderkey AS src, o_custkey AS bronwaarde FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 1000)",
)
def _(t):
    refs = t.orders.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("bronwaarde"))
    return relations.dangling(refs, t.customer.where(F.col("c_acctbal") > 1000), "c_custkey").select("src", "bronwaarde")
