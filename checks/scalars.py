"""Scalar functions of the register queries."""

from pyspark.sql import functions as F

from checks.registry import check
from stateweave.functions import dates, text, values, wkt


@check(
    "x1_date_texts",
    """SELECT event_id, strftime(ts, '%Y-%m-%d') AS dag, strftime(ts, '%Y-%m-%d %H:%M:%S') AS moment FROM events""",
)
def _(t):
    return t.events.select("event_id", dates.day_text(F.col("ts")).alias("dag"), dates.moment_text(F.col("ts")).alias("moment"))


@check(
    "x2_fixed_date_comparison",
    """SELECT o_orderkey, CASE WHEN o_orderdate <= TIMESTAMP '1998-03-24 00:00:00' THEN 'oud' ELSE 'nieuw' END AS stelsel
       FROM orders""",
)
def _(t):
    old = F.col("o_orderdate") <= dates.moment("1998-03-24")
    return t.orders.select("o_orderkey", F.when(old, "oud").otherwise("nieuw").alias("stelsel"))


@check("x3_date_of_timestamp", "SELECT event_id, CAST(ts AS DATE) AS dag FROM events")
def _(t):
    return t.events.select("event_id", dates.day_of(F.col("ts")).alias("dag"))


@check(
    "x4_days_before",
    "SELECT o_orderkey, o_orderdate >= TIMESTAMP '2000-01-05 00:00:00' - INTERVAL 10 DAY AS recent FROM orders",
)
def _(t):
    return t.orders.select("o_orderkey", (F.col("o_orderdate") >= dates.days_before("2000-01-05", 10)).alias("recent"))


@check(
    "x5_day_and_modulo",
    "SELECT o_orderkey, CAST(day(o_orderdate) % 10 AS BIGINT) AS cijfer, o_custkey % 10 AS groep FROM orders",
)
def _(t):
    return t.orders.select(
        "o_orderkey", (F.dayofmonth("o_orderdate") % 10).cast("bigint").alias("cijfer"), (F.col("o_custkey") % 10).alias("groep")
    )


@check("x6_upper_slice", "SELECT p_partkey, upper(substring(p_name, 2, 3)) AS code FROM part")
def _(t):
    return t.part.select("p_partkey", text.upper_slice(F.col("p_name"), 2, 3).alias("code"))


@check("x7_strip_ends", "SELECT c_custkey, substring(c_name, 2, length(c_name) - 2) AS kern FROM customer")
def _(t):
    return t.customer.select("c_custkey", text.strip_ends(F.col("c_name")).alias("kern"))


@check(
    "x8_prefix_before_mark",
    """SELECT doc_id, CASE WHEN regexp_matches(text, '[_ ]') THEN regexp_extract(text, '^([^_ ]*)[_ ]', 1) ELSE '' END AS dossier
       FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", text.prefix_before(F.col("text")).alias("dossier"))


_KENMERK = "CASE WHEN c_custkey % 3 = 0 THEN replace(c_name, '#0000', '_') WHEN c_custkey % 3 = 1 THEN '_' || c_name ELSE c_name || '   lange staart' END"


def _kenmerk():
    k = F.col("c_custkey") % 3
    return (
        F.when(k == 0, F.replace("c_name", F.lit("#0000"), F.lit("_")))
        .when(k == 1, F.concat(F.lit("_"), "c_name"))
        .otherwise(F.concat("c_name", F.lit("   lange staart")))
    )


@check(
    "x9_file_code",
    f"""SELECT c_custkey, nullif(trim(coalesce(nullif(regexp_extract(k, '^(.*?)_', 1), ''), k)), '') AS dossier
        FROM (SELECT c_custkey, substring({_KENMERK}, 1, 21) AS k FROM customer)""",
)
def _(t):
    return t.customer.select("c_custkey", text.file_code(_kenmerk()).alias("dossier"))


# Descriptions with a bracket, a triple space, both, or neither.
_DESCRIBED = """
    SELECT p_partkey, CASE p_partkey % 5
        WHEN 0 THEN p_name || ' (' || p_brand || ')'
        WHEN 1 THEN p_name || '(' || p_brand || ')'
        WHEN 2 THEN p_name || '     ' || p_brand || ' (x)'
        WHEN 3 THEN '(' || p_name
        ELSE p_name END AS d FROM part
"""


def _described(t):
    k = F.col("p_partkey") % 5
    d = (
        F.when(k == 0, F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")))
        .when(k == 1, F.concat("p_name", F.lit("("), "p_brand", F.lit(")")))
        .when(k == 2, F.concat("p_name", F.lit("     "), "p_brand", F.lit(" (x)")))
        .when(k == 3, F.concat(F.lit("("), "p_name"))
        .otherwise(F.col("p_name"))
    )
    return t.part.select("p_partkey", d.alias("d"))


@check(
    "x10_address_part",
    f"""SELECT p_partkey, CASE WHEN p = 0 THEN d ELSE nullif(substring(d, 1, p - 1), '') END AS adres FROM
        (SELECT *, instr(replace(replace(d, '   ', chr(10)), '(', chr(10)), chr(10)) AS p FROM ({_DESCRIBED}))""",
)
def _(t):
    return _described(t).select("p_partkey", text.address_part(F.col("d")).alias("adres"))


@check(
    "x11_location_part",
    f"""SELECT p_partkey, CASE WHEN p > 0 THEN nullif(ltrim(substring(d, q + 1)), '') END AS locatie FROM
        (SELECT *, instr(replace(replace(d, '   ', chr(10)), '(', chr(10)), chr(10)) AS p,
                   instr(replace(replace(d, '(', '   '), '   ', chr(10)), chr(10)) AS q FROM ({_DESCRIBED}))""",
)
def _(t):
    return _described(t).select("p_partkey", text.location_part(F.col("d")).alias("locatie"))


@check(
    "x12_position_replace_length_trim",
    """SELECT c_custkey, instr(c_name, '#') AS plaats, replace(c_name, '#', chr(10)) AS vervangen,
              length(c_name) AS lengte, ltrim('  ' || c_name) AS links, trim(' ' || c_name || ' ') AS kort FROM customer""",
)
def _(t):
    return t.customer.select(
        "c_custkey",
        F.instr("c_name", "#").cast("bigint").alias("plaats"),
        F.replace("c_name", F.lit("#"), F.char(F.lit(10))).alias("vervangen"),
        F.length("c_name").cast("bigint").alias("lengte"),
        F.ltrim(F.concat(F.lit("  "), "c_name")).alias("links"),
        F.trim(F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("kort"),
    )


@check(
    "x13_code_concatenation",
    """SELECT n_nationkey, nullif(concat(CASE WHEN n_nationkey % 2 = 0 THEN n_name END,
              CASE WHEN n_nationkey % 3 = 0 THEN CAST(n_regionkey AS VARCHAR) END), '') AS code FROM nation""",
)
def _(t):
    a = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))
    b = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_regionkey").cast("string"))
    return t.nation.select("n_nationkey", text.join_codes(a, b).alias("code"))


@check(
    "x14_first_known",
    """SELECT d.doc_id, CAST(coalesce(quality, toxic, -1) AS BIGINT) AS oordeel FROM documents d
       LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(t):
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    first = values.first_known(F.col("quality"), F.col("toxic"), F.lit(-1))
    return joined.select("doc_id", first.cast("bigint").alias("oordeel"))


@check(
    "x15_searched_case",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS zonder_else,
              CASE WHEN o_totalprice > 200000 THEN 'hoog' WHEN o_totalprice > 100000 THEN 'midden' ELSE 'laag' END AS met_else
       FROM orders""",
)
def _(t):
    price = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("zonder_else"),
        F.when(price > 200000, "hoog").when(price > 100000, "midden").otherwise("laag").alias("met_else"),
    )


@check(
    "x16_code_table",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'spoed' WHEN '2-HIGH' THEN 'hoog'
                WHEN '3-MEDIUM' THEN 'midden' ELSE NULL END AS omschrijving FROM orders""",
)
def _(t):
    table = {"1-URGENT": "spoed", "2-HIGH": "hoog", "3-MEDIUM": "midden"}
    return t.orders.select("o_orderkey", values.code_label(F.col("o_orderpriority"), table).alias("omschrijving"))


@check(
    "x17_yes_no",
    """SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'J' ELSE 'N' END AS giftig,
              CASE WHEN quality IS NULL THEN 'J' ELSE 'N' END AS onbeoordeeld
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(t):
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return joined.select(
        "doc_id",
        values.yes_no(F.col("toxic") == 1).alias("giftig"),
        values.yes_no(F.col("quality").isNull()).alias("onbeoordeeld"),
    )


@check(
    "x18_cast_to_int",
    """SELECT p_partkey, CAST(CASE WHEN p_partkey % 4 > 0 THEN p_size END AS BIGINT) AS maat FROM part""",
)
def _(t):
    raw = F.when(F.col("p_partkey") % 4 == 0, F.lit("x")).otherwise(F.col("p_size").cast("string"))
    return t.part.select("p_partkey", values.to_int(raw).cast("bigint").alias("maat"))


@check(
    "x19_text_to_json",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
def _(t):
    return t.events.select("event_id", values.json_field(F.col("props"), "$.k", "bigint").alias("k"))


@check(
    "x20_empty_object_default",
    """SELECT event_id, coalesce(CASE WHEN event_type <> 'view' THEN props END, '{}') AS props,
              CAST(json_extract_string(coalesce(CASE WHEN event_type <> 'view' THEN props END, '{}'), '$.k') AS BIGINT) AS k
       FROM events""",
)
def _(t):
    filled = values.json_or_empty(F.when(F.col("event_type") != "view", F.col("props")))
    return t.events.select("event_id", filled.alias("props"), values.json_field(filled, "$.k", "bigint").alias("k"))


@check(
    "x21_geometry_text",
    """SELECT vec_id, 'POINT (' || CAST(CAST(floor(embedding[1] * 1000) AS BIGINT) AS VARCHAR) || ' '
              || CAST(CAST(floor(embedding[2] * 1000) AS BIGINT) AS VARCHAR) || ')' AS geometrie FROM embeddings""",
)
def _(t):
    at = lambda i: F.floor(F.element_at("embedding", i) * F.lit(1000).cast("float"))
    return t.embeddings.select("vec_id", wkt.point_wkt(at(1), at(2)).alias("geometrie"))


# Rings with a vertex on the lower side, off the chord by 0, 0.04 or 0.1 depending on the part.
_RING = """
    SELECT p_partkey, p_size AS w, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 0.04 ELSE 0.1 END AS dent FROM part
"""


@check(
    "x22_simplify_within_tolerance",
    f"""SELECT p_partkey, 'POLYGON ((0 0, ' || CASE WHEN dent = 0.1 THEN w || ' -0.1, ' ELSE '' END
               || 2 * w || ' 0, ' || 2 * w || ' ' || w || ', 0 ' || w || ', 0 0))' AS geometrie FROM ({_RING})""",
)
def _(t):
    k = F.col("p_partkey") % 3
    dent = F.when(k == 0, F.lit("0")).when(k == 1, F.lit("-0.04")).otherwise(F.lit("-0.1"))
    ring = F.format_string(
        "POLYGON ((0 0, %d %s, %d 0, %d %d, 0 %d, 0 0))",
        "p_size", dent, F.col("p_size") * 2, F.col("p_size") * 2, "p_size", "p_size",
    )
    return t.part.select("p_partkey", wkt.polygon_wkt(wkt.simplify(wkt.rings(ring), 0.05)).alias("geometrie"))
