"""Joins that look up, chain or pick rows."""

from pyspark.sql import functions as F

from checks.registry import check
from stateweave.operators import history, lists, lookups
from checks.states import EVENT_STATES, event_states


@check("j1_inner_equi_join", "SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


@check(
    "j2_code_lookups",
    """SELECT c_custkey, n_name AS land, r_name AS regio FROM customer
       LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 1) n ON c_nationkey = n_nationkey
       LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def _(t):
    nation = t.nation.where(F.col("n_nationkey") % 5 != 1)
    out = lookups.lookup(t.customer, nation, {"c_nationkey": "n_nationkey"}, {"land": "n_name", "regio_id": "n_regionkey"})
    out = lookups.lookup(out, t.region, {"regio_id": "r_regionkey"}, {"regio": "r_name"})
    return out.select("c_custkey", "land", "regio")


@check(
    "j3_successor_end",
    f"""WITH s AS ({EVENT_STATES})
        SELECT a.event_id, coalesce(a.einddatum, b.begin_geldigheid) AS einde
        FROM s a LEFT JOIN s b ON a.user_id = b.user_id AND a.verval = b.begin_geldigheid""",
)
def _(t):
    out = history.successor_end(event_states(t), "user_id", "begin_geldigheid", "verval", {"next_begin": "begin_geldigheid"})
    return out.select("event_id", F.coalesce("einddatum", "next_begin").alias("einde"))


@check(
    "j4_child_to_parent",
    """SELECT c.conv_id, c.turn, c.role, p.role AS vorige_rol, length(p.text) AS vorige_lengte
       FROM conversations c JOIN conversations p
         ON p.conv_id * 100000 + p.turn = c.conv_id * 100000 + c.turn - 1
       WHERE p.role = 'user'""",
)
def _(t):
    item = F.col("conv_id") * 100000 + F.col("turn")
    items = t.conversations.withColumns({"item_key": item, "it_parent_key": item - 1, "lengte": F.length("text").cast("bigint")})
    out = lookups.with_parent(
        items, "it_parent_key", "item_key", {"vorige_rol": "role", "vorige_lengte": "lengte"}, F.col("role") == "user"
    )
    return out.select("conv_id", "turn", "role", "vorige_rol", "vorige_lengte")


@check(
    "j5_previous_record",
    """SELECT a.l_orderkey, a.l_linenumber, a.l_partkey, b.l_partkey AS vorige FROM lineitem a
       LEFT JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber - 1""",
)
def _(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    out = lookups.with_previous(
        lines, {"l_orderkey": "l_orderkey", "l_linenumber": F.col("l_linenumber") - 1}, {"vorige": "l_partkey"}
    )
    return out


@check(
    "j6_latest_with_ties",
    """SELECT o_orderkey, o.o_custkey, o_orderdate FROM orders o
       JOIN (SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY o_custkey) m
         ON m.o_custkey = o.o_custkey AND m.d = o_orderdate""",
)
def _(t):
    return lookups.latest_by(t.orders, ["o_custkey"], "o_orderdate").select("o_orderkey", "o_custkey", "o_orderdate")


@check(
    "j7_asof_latest_twice",
    """WITH l AS (SELECT o.o_custkey, o_totalprice, o_orderdate FROM orders o
                  JOIN (SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY o_custkey) m
                    ON m.o_custkey = o.o_custkey AND m.d = o_orderdate)
       SELECT c_custkey, a.o_totalprice AS bedrag, strftime(b.o_orderdate, '%Y-%m-%d') AS datum
       FROM customer LEFT JOIN l a ON c_custkey = a.o_custkey LEFT JOIN l b ON c_custkey = b.o_custkey""",
)
def _(t):
    out = lookups.asof_latest(t.customer, t.orders, "c_custkey", "o_custkey", "o_orderdate", {"bedrag": "o_totalprice"})
    out = lookups.asof_latest(out, t.orders, "c_custkey", "o_custkey", "o_orderdate", {"dag": "o_orderdate"})
    return out.select("c_custkey", "bedrag", F.date_format("dag", "yyyy-MM-dd").alias("datum"))


@check(
    "j7_asof_latest_deduped",
    """SELECT c_custkey, o_totalprice AS bedrag FROM customer
       LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey
                    ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) o
         ON c_custkey = o_custkey AND rn = 1""",
)
def _(t):
    facts = t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    out = lookups.asof_latest(
        t.customer, facts, "c_custkey", "o_custkey", "o_orderdate", {"bedrag": "o_totalprice"}, dedupe=True
    )
    return out.select("c_custkey", "bedrag")


@check(
    "j8_rank_before_filter",
    """SELECT event_id, user_id, volgnummer FROM
         (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY ts) AS volgnummer FROM events)
       WHERE event_type = 'purchase'""",
)
def _(t):
    ranked = history.state_number(t.events, ["user_id"], ["ts"])
    return ranked.where(F.col("event_type") == "purchase").select("event_id", "user_id", "volgnummer")


@check(
    "j9_left_join_aggregated_list",
    """SELECT o_orderkey, onderdelen FROM orders LEFT JOIN
         (SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ';' ORDER BY CAST(l_partkey AS VARCHAR)) AS onderdelen
          FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey) ON o_orderkey = l_orderkey""",
)
def _(t):
    lines = t.lineitem.where(F.col("l_returnflag") != "N").select(
        "l_orderkey", F.col("l_partkey").cast("string").alias("part")
    )
    listed = lists.ordered_text(lines, ["l_orderkey"], "part", out="onderdelen")
    return lookups.lookup(t.orders, listed, {"o_orderkey": "l_orderkey"}, {"onderdelen": "onderdelen"}).select(
        "o_orderkey", "onderdelen"
    )


@check(
    "j10_merge_dataset",
    """WITH p AS (SELECT s_suppkey, CAST(substr(s_name, 10) AS BIGINT) AS code,
                         CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS naam FROM supplier),
            o AS (SELECT CAST(substr(c_name, 10) AS BIGINT) AS code, c_name AS naam, c_mktsegment AS segment FROM customer)
       SELECT s_suppkey, coalesce(p.naam, o.naam) AS naam, o.segment FROM p LEFT JOIN o ON p.code = o.code""",
)
def _(t):
    code = lambda c: F.substring(c, 10, 20).cast("bigint").alias("code")
    primary = t.supplier.select("s_suppkey", code("s_name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("naam"))
    other = t.customer.select(code("c_name"), F.col("c_name").alias("naam"), F.col("c_mktsegment").alias("segment"))
    return lookups.merge_dataset(primary, other, "code", ["naam", "segment"]).select("s_suppkey", "naam", "segment")


@check(
    "j19_semi_join",
    """SELECT p_partkey, p_name FROM part WHERE p_partkey IN
         (SELECT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT')""",
)
def _(t):
    sold = t.lineitem.join(t.orders.where(F.col("o_orderpriority") == "1-URGENT"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lookups.semi(t.part, sold, {"p_partkey": "l_partkey"}).select("p_partkey", "p_name")
