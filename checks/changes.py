"""Snapshot comparison: two versions of the customers."""

from pyspark.sql import functions as F

from checks.registry import check
from checks.states import EVENT_STATES, event_states
from stateweave.operators import changes, history, relations

KEY = ["c_custkey"]

_OLD = "SELECT c_custkey, c_name, nullif(c_mktsegment, 'MACHINERY') AS segment, c_acctbal AS saldo FROM customer WHERE c_custkey % 13 <> 0"
_NEW = """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN upper(c_name) ELSE c_name END AS c_name,
                 CASE WHEN c_custkey % 7 = 0 THEN 'NIEUW' ELSE nullif(c_mktsegment, 'MACHINERY') END AS segment,
                 c_acctbal AS saldo FROM customer WHERE c_custkey % 11 <> 0"""


def _old(t):
    return t.customer.where(F.col("c_custkey") % 13 != 0).select(
        "c_custkey", "c_name", F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment"), F.col("c_acctbal").alias("saldo")
    )


def _new(t):
    k = F.col("c_custkey")
    return t.customer.where(k % 11 != 0).select(
        "c_custkey",
        F.when(k % 5 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("c_name"),
        F.when(k % 7 == 0, F.lit("NIEUW")).otherwise(F.nullif("c_mktsegment", F.lit("MACHINERY"))).alias("segment"),
        F.col("c_acctbal").alias("saldo"),
    )


_DIFF = f"""
    SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey,
           CASE WHEN o.c_custkey IS NULL THEN 'ADD' WHEN n.c_custkey IS NULL THEN 'DELETE'
                WHEN o.c_name IS DISTINCT FROM n.c_name OR o.segment IS DISTINCT FROM n.segment THEN 'MODIFY' ELSE 'CONFIRM' END AS action
    FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.c_custkey = n.c_custkey
"""


@check("c1_snapshot_diff", _DIFF)
def _(t):
    return changes.snapshot_diff(_old(t), _new(t), KEY).select("c_custkey", "action")


@check(
    "c2_changed_attributes",
    f"""SELECT o.c_custkey, concat_ws(',', CASE WHEN o.c_name IS DISTINCT FROM n.c_name THEN 'c_name' END,
               CASE WHEN o.segment IS DISTINCT FROM n.segment THEN 'segment' END) AS changed
        FROM ({_OLD}) o JOIN ({_NEW}) n ON o.c_custkey = n.c_custkey
        WHERE o.c_name IS DISTINCT FROM n.c_name OR o.segment IS DISTINCT FROM n.segment""",
)
def _(t):
    diff = changes.snapshot_diff(_old(t), _new(t), KEY).where(F.col("action") == changes.MODIFY)
    return diff.select("c_custkey", F.array_join("changed", ",").alias("changed"))


@check("c3_delete_everything", f"SELECT c_custkey, 'DELETE' AS action FROM ({_OLD})")
def _(t):
    return changes.snapshot_diff(_old(t), _new(t).where(F.lit(False)), KEY).select("c_custkey", "action")


@check("c4_partial_load", f"SELECT * FROM ({_DIFF}) WHERE action <> 'DELETE'")
def _(t):
    return changes.snapshot_diff(_old(t), _new(t), KEY, mode="partial").select("c_custkey", "action")


@check(
    "c5_several_sources",
    """SELECT coalesce(o.id, n.id) AS id, 'leverancier' AS _source,
              CASE WHEN o.id IS NULL THEN 'ADD' WHEN n.id IS NULL THEN 'DELETE' WHEN o.naam <> n.naam THEN 'MODIFY' ELSE 'CONFIRM' END AS action
       FROM (SELECT s_suppkey AS id, s_name AS naam FROM supplier) o
       FULL JOIN (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE s_name END AS naam
                  FROM supplier WHERE s_acctbal > 1000) n ON o.id = n.id""",
)
def _(t):
    suppliers = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("naam"))
    customers = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("naam"))
    current = changes.stack_sources({"leverancier": suppliers, "klant": customers})
    fresh = t.supplier.where(F.col("s_acctbal") > 1000).select(
        F.col("s_suppkey").alias("id"),
        F.when(F.col("s_suppkey") % 2 == 0, F.upper("s_name")).otherwise(F.col("s_name")).alias("naam"),
    )
    load = changes.stack_sources({"leverancier": fresh})
    return changes.snapshot_diff(current, load, ["id"], source="_source").select("id", "_source", "action")


@check("c6_apply_changes", _NEW)
def _(t):
    diff = changes.snapshot_diff(_old(t), _new(t), KEY)
    return changes.apply_changes(_old(t), diff, KEY)


@check(
    "c6_null_in_key",
    """SELECT c_mktsegment AS k, CAST(NULL AS INTEGER) AS nr, CAST(count(*) AS BIGINT) + 1 AS v FROM customer GROUP BY c_mktsegment""",
)
def _(t):
    # Every record lacks a state number; each is changed, and none may stay beside its new self.
    old = t.customer.groupBy(F.col("c_mktsegment").alias("k"), F.lit(None).cast("int").alias("nr")).agg(F.count(F.lit(1)).alias("v"))
    new = old.withColumn("v", F.col("v") + 1)
    return changes.apply_changes(old, changes.snapshot_diff(old, new, ["k", "nr"]), ["k", "nr"])


@check(
    "c7_relation_update",
    """WITH a AS (SELECT c_custkey AS src, o_orderkey AS dst, o_orderpriority AS p FROM customer LEFT JOIN orders
                    ON c_custkey = o_custkey AND o_orderstatus <> 'P'),
            b AS (SELECT c_custkey AS src, o_orderkey AS dst, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderpriority END AS p
                  FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus <> 'O')
       SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst, -1) AS dst,
              CASE WHEN a.src IS NULL THEN 'ADD' WHEN b.src IS NULL THEN 'DELETE' WHEN a.p IS DISTINCT FROM b.p THEN 'MODIFY' ELSE 'CONFIRM' END AS action
       FROM a FULL JOIN b ON a.src = b.src AND coalesce(a.dst, -1) = coalesce(b.dst, -1)""",
)
def _(t):
    refs = t.customer.select(F.col("c_custkey").alias("src"), F.col("c_custkey").alias("bronwaarde"))

    def related(dst):
        rows = relations.resolve_references(refs, dst, "dst", "o_custkey", multiple=True, out="dst")
        kinds = dst.select("dst", "p")
        return rows.join(kinds, "dst", "left").select("src", F.coalesce("dst", F.lit(-1)).alias("dst"), "p")

    pick = lambda status, p: t.orders.where(F.col("o_orderstatus") != status).select(
        F.col("o_orderkey").alias("dst"), "o_custkey", p.alias("p")
    )
    before = related(pick("P", F.col("o_orderpriority")))
    after = related(pick("O", F.when(F.col("o_orderkey") % 4 == 0, "X").otherwise(F.col("o_orderpriority"))))
    return changes.snapshot_diff(before, after, ["src", "dst"]).select("src", "dst", "action")


@check(
    "c8_current_rows",
    f"""SELECT event_id, user_id FROM ({EVENT_STATES})
        WHERE begin_geldigheid <= TIMESTAMP '2024-01-15 12:00:00'
          AND (eind_geldigheid IS NULL OR TIMESTAMP '2024-01-15 12:00:00' < eind_geldigheid)
          AND (verval IS NULL OR verval > TIMESTAMP '2024-01-15 12:00:00')""",
)
def _(t):
    out = history.current_at(event_states(t), "2024-01-15 12:00:00", "begin_geldigheid", "eind_geldigheid", "verval")
    return out.select("event_id", "user_id")
