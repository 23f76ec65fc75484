"""Projections and attribute mapping."""

from pyspark.sql import functions as F, types as T

from checks.registry import check
from stateweave.operators import mapping, projection
from stateweave.sources import databases


def joined(column, field="bronwaarde"):
    """List of objects as one text, for comparison."""
    return F.array_join(F.transform(column, lambda e: e[field]), "|")


@check("p1_projection_alias", "SELECT c_custkey AS id, c_name AS naam, c_acctbal AS saldo FROM customer")
def _(t):
    return projection.select_as(t.customer, {"id": "c_custkey", "naam": "c_name", "saldo": "c_acctbal"})


@check(
    "p2_constants_and_nulls",
    "SELECT o_orderkey, CAST(1 AS BIGINT) AS soort, CAST(NULL AS VARCHAR) AS reden FROM orders",
)
def _(t):
    return projection.with_constants(
        t.orders.select("o_orderkey"), {"soort": (1, "bigint"), "reden": (None, "string")}
    )


@check(
    "p3_select_star_over_cte",
    """WITH q AS (SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45)
       SELECT * FROM q""",
)
def _(t):
    sql = """WITH q AS (SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45)
             SELECT * FROM q"""
    return databases.scan_sql(t.spark, sql, {"lineitem": t.lineitem})


@check(
    "p4_scalar_mapping",
    "SELECT s_suppkey AS identificatie, s_name AS naam, CAST(s_nationkey AS BIGINT) AS land FROM supplier",
)
def _(t):
    spec = {
        "identificatie": {"source_mapping": "s_suppkey"},
        "naam": {"source_mapping": "s_name"},
        "land": {"source_mapping": "s_nationkey"},
    }
    return mapping.map_entity(t.supplier, spec, {"land": "biginteger"})


@check(
    "p5_literal_mapping",
    """SELECT o_orderkey AS id, TIMESTAMP '2010-01-01 00:00:00' AS begin_geldigheid, 'vast' AS soort
       FROM orders""",
)
def _(t):
    spec = {
        "id": {"source_mapping": "o_orderkey"},
        "begin_geldigheid": {"source_mapping": "=2010-01-01T00:00:00.000000"},
        "soort": {"source_mapping": "=vast"},
    }
    return mapping.map_entity(t.orders, spec, {"begin_geldigheid": "datetime", "soort": "string"})


@check(
    "p6_code_description_struct",
    """SELECT c_custkey AS id,
              CASE WHEN c_nationkey % 3 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS code,
              CASE WHEN c_nationkey % 3 <> 0 THEN n_name END AS omschrijving,
              c_nationkey % 3 = 0 AS is_leeg
       FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def _(t):
    named = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    kept = F.col("c_nationkey") % 3 != 0
    rows = named.select(
        "c_custkey",
        F.when(kept, F.col("c_nationkey").cast("string")).alias("land_code"),
        F.when(kept, F.col("n_name")).alias("land_naam"),
    )
    spec = {
        "id": {"source_mapping": "c_custkey"},
        "land": {"source_mapping": {"code": "land_code", "omschrijving": "land_naam"}},
    }
    return mapping.map_entity(rows, spec).select("id", "land.code", "land.omschrijving", F.col("land").isNull().alias("is_leeg"))


@check(
    "p7_wide_struct",
    """SELECT c_custkey AS id, c_name AS naam, c_mktsegment AS segment, CAST(c_nationkey AS BIGINT) AS land,
              c_acctbal AS saldo, 'NL' AS taal FROM customer""",
)
def _(t):
    spec = {
        "id": {"source_mapping": "c_custkey"},
        "adres": {
            "source_mapping": {
                "naam": "c_name",
                "segment": "c_mktsegment",
                "land": "c_nationkey",
                "saldo": "c_acctbal",
                "taal": "=NL",
            }
        },
    }
    wide = mapping.map_entity(t.customer, spec).select("id", "adres.*")
    return wide.withColumn("land", F.col("land").cast("bigint"))


@check(
    "p8_json_object",
    """SELECT event_id AS id,
              '{"str":"' || event_type || '","obj":' || props || ',"bool":true,"null":null}' AS json
       FROM events""",
)
def _(t):
    rows = t.events.select("event_id", "event_type", "props", F.lit("true").alias("b"), F.lit(None).cast("string").alias("n"))
    spec = {
        "id": {"source_mapping": "event_id"},
        "json": {"source_mapping": {"str": "event_type", "obj": "props", "bool": "b", "null": "n"}},
    }
    return mapping.map_entity(rows, spec, {"json": "json"})


@check(
    "p9_dotted_path",
    """SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
)
def _(t):
    spec = {"id": {"source_mapping": "event_id"}, "k": {"source_mapping": "props.k"}}
    return mapping.map_entity(t.events, spec, {"k": "biginteger"})


@check(
    "p10_dotted_path_over_array",
    """SELECT p_partkey AS id, array_to_string(string_split(p_name, ' '), '|') AS woorden FROM part""",
)
def _(t):
    objects = F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("woord"), F.length(w).alias("lengte")))
    rows = t.part.select("p_partkey", F.to_json(objects).alias("delen"))
    spec = {"id": {"source_mapping": "p_partkey"}, "woorden": {"source_mapping": {"bronwaarde": "delen.woord"}}}
    typed = rows.withColumn("delen", F.from_json("delen", "array<struct<woord:string,lengte:int>>"))
    return mapping.map_entity(typed, spec).select("id", joined(F.col("woorden")).alias("woorden"))


@check("p11_single_reference", "SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS klant FROM orders")
def _(t):
    spec = {"id": {"source_mapping": "o_orderkey"}, "klant": {"source_mapping": {"bronwaarde": "o_custkey"}}}
    return mapping.map_entity(t.orders, spec).select("id", F.col("klant.bronwaarde").alias("klant"))


@check(
    "p12_many_reference_from_separator",
    """SELECT p_partkey AS id, replace(p_name, ' ', '|') AS verwijzingen,
              CAST(len(string_split(p_name, ' ')) AS BIGINT) AS aantal FROM part""",
)
def _(t):
    rows = t.part.select("p_partkey", F.concat(F.replace("p_name", F.lit(" "), F.lit(";")), F.lit(";")).alias("lijst"))
    spec = {
        "id": {"source_mapping": "p_partkey"},
        "refs": {"source_mapping": {"bronwaarde": "lijst", "format": {"split": ";"}}},
    }
    return mapping.map_entity(rows, spec).select(
        "id", joined(F.col("refs")).alias("verwijzingen"), F.size("refs").cast("bigint").alias("aantal")
    )


@check(
    "p13_many_reference_list_or_single",
    """SELECT p_partkey AS id,
              CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '|') ELSE p_brand END AS verwijzingen
       FROM part""",
)
def _(t):
    listed = F.to_json(F.split("p_name", " "))
    rows = t.part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, listed).otherwise(F.col("p_brand")).alias("v"))
    spec = {"id": {"source_mapping": "p_partkey"}, "refs": {"source_mapping": "v"}}
    return mapping.map_entity(rows, spec, {"refs": "manyreference"}).select(
        "id", joined(F.col("refs")).alias("verwijzingen")
    )


@check(
    "p14_references_with_gaps",
    """SELECT l_orderkey AS id, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR)
                ELSE CAST(l_partkey AS VARCHAR) || '|x|' || CAST(l_suppkey AS VARCHAR) END AS veel,
              CASE WHEN l_linenumber % 2 = 0 THEN 'd1|d3' ELSE 'd1|-|d3' END AS veel_begin
       FROM lineitem""",
)
def _(t):
    # A gap among the references, or among their dates: what stays keeps its own date.
    part, supplier, even = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_linenumber") % 2 == 0
    rows = t.lineitem.select(
        "l_orderkey",
        F.concat_ws(";", part, F.when(even, "").otherwise("x"), supplier).alias("lijst"),
        F.when(even, "d1;d2;d3").otherwise("d1;;d3").alias("dagen"),
    )
    split = {"bronwaarde": "lijst", "begin_geldigheid": "dagen", "format": {"split": ";"}}
    out = mapping.map_entity(rows, {"id": {"source_mapping": "l_orderkey"}, "veel": {"source_mapping": split}})
    joined = lambda name: F.array_join(F.transform("veel", lambda e: e[name]), "|", "-").alias(name)
    return out.select("id", joined("bronwaarde").alias("veel"), joined("begin_geldigheid").alias("veel_begin"))


@check(
    "p14_references_with_begin",
    """SELECT l_orderkey AS id, CAST(l_partkey AS VARCHAR) AS een, strftime(l_shipdate, '%Y-%m-%d') AS een_begin,
              CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR) AS veel,
              strftime(l_shipdate, '%Y-%m-%d') || '|-' AS veel_begin
       FROM lineitem""",
)
def _(t):
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    rows = t.lineitem.select(
        "l_orderkey",
        "l_partkey",
        day.alias("dag"),
        F.concat_ws(";", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("lijst"),
        F.concat(day, F.lit(";")).alias("dagen"),
    )
    spec = {
        "id": {"source_mapping": "l_orderkey"},
        "een": {"source_mapping": {"bronwaarde": "l_partkey", "begin_geldigheid": "dag"}},
        "veel": {"source_mapping": {"bronwaarde": "lijst", "begin_geldigheid": "dagen"}},
    }
    out = mapping.map_entity(rows, spec, {"veel": "manyreference"})
    begins = F.array_join(F.transform("veel", lambda e: e["begin_geldigheid"]), "|", "-")
    return out.select(
        "id",
        F.col("een.bronwaarde").alias("een"),
        F.col("een.begin_geldigheid").alias("een_begin"),
        joined(F.col("veel")).alias("veel"),
        begins.alias("veel_begin"),
    )


@check(
    "p15_reference_with_payload",
    """SELECT s_suppkey AS id, CAST(s_nationkey AS VARCHAR) AS bronwaarde, s_name AS extra FROM supplier""",
)
def _(t):
    spec = {
        "id": {"source_mapping": "s_suppkey"},
        "ref": {"source_mapping": {"bronwaarde": "s_nationkey", "extra": "s_name"}},
    }
    return mapping.map_entity(t.supplier, spec).select("id", "ref.bronwaarde", "ref.extra")


@check(
    "p16_force_list_objects",
    """SELECT p_partkey AS id, replace(p_name, ' ', '|') AS woorden,
              array_to_string(list_transform(string_split(p_name, ' '), lambda w: CAST(length(w) AS VARCHAR)), '|') AS lengtes,
              p_brand AS merk FROM part""",
)
def _(t):
    words = F.split("p_name", " ")
    rows = t.part.select(
        "p_partkey", "p_brand", words.alias("woord"), F.transform(words, lambda w: F.length(w).cast("string")).alias("lengte")
    )
    spec = {
        "id": {"source_mapping": "p_partkey"},
        "delen": {"source_mapping": {"woord": "woord", "lengte": "lengte"}, "force_list": True},
        "merken": {"source_mapping": {"omschrijving": "p_brand"}, "force_list": True},
    }
    return mapping.map_entity(rows, spec).select(
        "id",
        joined(F.col("delen"), "woord").alias("woorden"),
        joined(F.col("delen"), "lengte").alias("lengtes"),
        joined(F.col("merken"), "omschrijving").alias("merk"),
    )


@check(
    "p17_force_list_scalars",
    "SELECT p_partkey AS id, replace(p_name, ' ', '|') AS woorden, p_brand AS merk FROM part",
)
def _(t):
    rows = t.part.select("p_partkey", "p_brand", F.split("p_name", " ").alias("woorden"))
    spec = {
        "id": {"source_mapping": "p_partkey"},
        "woorden": {"source_mapping": "woorden", "force_list": True},
        "merk": {"source_mapping": "p_brand", "force_list": True},
    }
    out = mapping.map_entity(rows, spec)
    assert isinstance(out.schema["merk"].dataType, T.ArrayType)
    return out.select("id", F.array_join("woorden", "|").alias("woorden"), F.array_join("merk", "|").alias("merk"))


@check(
    "p18_not_provided_attributes",
    "SELECT n_nationkey, n_name, CAST(NULL AS DOUBLE) AS zakking, CAST(NULL AS VARCHAR) AS cbs_code FROM nation",
)
def _(t):
    return projection.add_not_provided(t.nation.select("n_nationkey", "n_name"), {"zakking": "double", "cbs_code": "string"})


HOST = [["re.sub", "^[a-z]+://([^/?#]*).*$", "\\1"], ["upper"]]


@check(
    "p19_value_filters",
    r"SELECT page_id AS id, upper(regexp_replace(url, '^[a-z]+://([^/?#]*).*$', '\1')) AS identificatie FROM pages",
)
def _(t):
    spec = {"id": {"source_mapping": "page_id"}, "identificatie": {"source_mapping": "url", "filters": HOST}}
    return mapping.map_entity(t.pages, spec)


@check(
    "p20_reference_filters",
    r"""SELECT page_id AS id, nullif(upper(regexp_replace(url, '^[a-z]+://([^/?#]*).*$', '\1')), '') AS bronwaarde
        FROM pages""",
)
def _(t):
    spec = {
        "id": {"source_mapping": "page_id"},
        "blok": {"source_mapping": {"bronwaarde": "url"}, "filters": {"bronwaarde": HOST}},
    }
    return mapping.map_entity(t.pages, spec).select("id", "blok.bronwaarde")


@check(
    "p21_system_columns",
    """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS _id, 'TPCH' AS _source, 'Orders' AS _application,
              CAST(o_custkey AS VARCHAR) AS _source_id, o_orderdate AS _expiration_date,
              o_orderdate AS datum_actueel_tot FROM orders""",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    out = mapping.with_system_columns(rows, "o_orderkey", "TPCH", "Orders", "o_custkey", "o_orderdate")
    return out.drop("o_custkey", "o_orderdate")
