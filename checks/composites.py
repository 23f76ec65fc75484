"""The register queries end to end, over source tables derived from the given ones."""

from dataclasses import replace

from pyspark.sql import functions as F

from checks.registry import check
from checks.states import EVENT_STATES, event_states
from stateweave.operators import mapping, projection
from stateweave.plans import extracts, registers, runner
from stateweave.plans.definition import Definition

# --- areas: event states as topography, event attributes as the attribute table ---------

_AREA_KINDS = ("click", "view", "purchase")
_TOPO = f"""
    SELECT event_id AS id, '{{' || user_id || '}}' AS guid,
           CASE WHEN event_type IN ('click', 'view', 'purchase') THEN %d ELSE 1 END AS objectcode,
           begin_geldigheid - INTERVAL 665 DAY AS inwin,
           CASE WHEN event_id %% 41 = 0 THEN begin_geldigheid ELSE verval END - INTERVAL 665 DAY AS verval,
           CAST(event_id %% 3 AS BIGINT) - 1 AS nivo,
           'POLYGON ((0 0, 5 ' || CASE WHEN event_id %% 2 = 0 THEN '-0.04' ELSE '-0.1' END || ', 10 0, 10 5, 0 5, 0 0))' AS geometrie
    FROM ({EVENT_STATES})
"""
_ATTR = f"""
    SELECT event_id AS dgdtw_primary_key, event_type AS naam, 'S' || (user_id %% 10) AS sdlcode,
           CASE WHEN event_id %% 3 > 0 THEN 'W' || (user_id %% 7) END AS wijkcode, 'B' || (event_id %% 4) AS brtcode, 'C' || (user_id %% 50) AS code,
           begin_geldigheid - INTERVAL 665 DAY AS docdatum, 'D' || event_id AS docnr,
           begin_geldigheid - INTERVAL 665 DAY AS ingsdatum, einddatum - INTERVAL 665 DAY AS einddatum
    FROM ({EVENT_STATES})
"""
def _shifted(c):
    return c - F.expr("INTERVAL 665 DAYS")


def _text(prefix, c):
    return F.concat(F.lit(prefix), c.cast("string"))


def _topography(t, code):
    s = event_states(t)
    begin = F.col("begin_geldigheid")
    dent = F.when(F.col("event_id") % 2 == 0, F.lit("-0.04")).otherwise(F.lit("-0.1"))
    return s.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("{"), F.col("user_id").cast("string"), F.lit("}")).alias("guid"),
        F.when(F.col("event_type").isin(*_AREA_KINDS), code).otherwise(1).alias("objectcode"),
        _shifted(begin).alias("inwin"),
        _shifted(F.when(F.col("event_id") % 41 == 0, begin).otherwise(F.col("verval"))).alias("verval"),
        (F.col("event_id") % 3 - 1).alias("nivo"),
        F.format_string("POLYGON ((0 0, 5 %s, 10 0, 10 5, 0 5, 0 0))", dent).alias("geometrie"),
    )


def _attributes(t):
    s = event_states(t)
    begin = _shifted(F.col("begin_geldigheid"))
    return s.select(
        F.col("event_id").alias("dgdtw_primary_key"),
        F.col("event_type").alias("naam"),
        _text("S", F.col("user_id") % 10).alias("sdlcode"),
        F.when(F.col("event_id") % 3 > 0, _text("W", F.col("user_id") % 7)).alias("wijkcode"),
        _text("B", F.col("event_id") % 4).alias("brtcode"),
        _text("C", F.col("user_id") % 50).alias("code"),
        begin.alias("docdatum"),
        _text("D", F.col("event_id")).alias("docnr"),
        begin.alias("ingsdatum"),
        _shifted(F.col("einddatum")).alias("einddatum"),
    )


def _simplified(keep_dent):
    return f"CASE WHEN {keep_dent} THEN 'POLYGON ((0 0, 5 -0.1, 10 0, 10 5, 0 5, 0 0))' ELSE 'POLYGON ((0 0, 10 0, 10 5, 0 5, 0 0))' END"


_DAY, _MOMENT = "'%Y-%m-%d'", "'%Y-%m-%d %H:%M:%S'"


def _plain(sql):
    return sql.replace("%%", "%")


@check(
    "city_blocks",
    f"""WITH t AS ({_plain(_TOPO.replace('%d', '6023'))}), s AS ({_plain(_ATTR)})
        SELECT s.code, CAST(NULL AS VARCHAR) AS identificatie, dense_rank() OVER (PARTITION BY s.code ORDER BY t.inwin) AS volgnummer,
               strftime(t.inwin, {_DAY}) AS begin_geldigheid, strftime(t.verval, {_DAY}) AS eind_geldigheid,
               strftime(t.inwin, {_MOMENT}) AS registratiedatum, t.guid AS source_id, strftime(t.verval, {_MOMENT}) AS expirationdate,
               {_simplified('t.id % 2 = 1')} AS geometrie, CAST(NULL AS VARCHAR) AS ligt_in_buurt
        FROM t JOIN s ON t.id = s.dgdtw_primary_key WHERE t.objectcode = 6023 AND (t.inwin <> t.verval OR t.verval IS NULL)
        ORDER BY s.code, volgnummer""",
)
def _(t):
    return registers.city_blocks(_topography(t, 6023), _attributes(t))


def _area_sql(code, columns):
    return f"""
        WITH t AS ({_plain(_TOPO.replace('%d', str(code)))}), s AS ({_plain(_ATTR)}),
             j AS (SELECT * FROM t JOIN s ON t.id = s.dgdtw_primary_key),
             e AS (SELECT a.*, coalesce(a.einddatum, b.ingsdatum) AS einde, b.inwin AS next_inwin
                   FROM j a LEFT JOIN j b ON a.guid = b.guid AND a.verval = b.inwin WHERE a.objectcode = {code}),
             f AS (SELECT *, dense_rank() OVER (PARTITION BY guid ORDER BY next_inwin NULLS LAST) AS volgnummer
                   FROM e WHERE ingsdatum <> einde OR einde IS NULL)
        SELECT {columns}, volgnummer, strftime(ingsdatum, {_DAY}) AS begin_geldigheid, strftime(einde, {_DAY}) AS eind_geldigheid,
               strftime(docdatum, {_DAY}) AS documentdatum, docnr AS documentnummer, strftime(inwin, {_MOMENT}) AS registratiedatum,
               guid AS source_id, strftime(einde, {_MOMENT}) AS expirationdate, geometrie FROM f ORDER BY code, volgnummer
    """


_OLD_CODES = "einde <= TIMESTAMP '2022-03-24 00:00:00'"


@check("boroughs", _area_sql(6027, "naam, sdlcode AS code"))
def _(t):
    return registers.boroughs(_topography(t, 6027), _attributes(t))


@check(
    "districts",
    _area_sql(
        6025,
        f"naam, CASE WHEN {_OLD_CODES} THEN concat(sdlcode, wijkcode) ELSE wijkcode END AS code, sdlcode AS ligt_in_stadsdeel",
    ),
)
def _(t):
    return registers.districts(_topography(t, 6025), _attributes(t))


@check(
    "neighbourhoods",
    _area_sql(
        6021,
        f"""naam, CASE WHEN {_OLD_CODES} THEN concat(sdlcode, wijkcode, brtcode) ELSE concat(wijkcode, brtcode) END AS code,
            CAST(NULL AS VARCHAR) AS identificatie, CASE WHEN {_OLD_CODES} THEN concat(sdlcode, wijkcode) ELSE wijkcode END AS ligt_in_wijk""",
    ),
)
def _(t):
    return registers.neighbourhoods(_topography(t, 6021), _attributes(t))


def _construction_sql(level):
    return f"""
        WITH t AS ({_plain(_TOPO.replace('%d', '612'))}),
             q AS (SELECT id, dense_rank() OVER (PARTITION BY guid ORDER BY inwin, verval NULLS LAST) AS volgnummer FROM t)
        SELECT substr(guid, 2, length(guid) - 2) AS identificatie, volgnummer, strftime(inwin, {_DAY}) AS begin_geldigheid,
               strftime(verval, {_DAY}) AS eind_geldigheid, strftime(inwin, {_MOMENT}) AS registratiedatum, t.id AS source_id,
               strftime(verval, {_MOMENT}) AS expirationdate, nivo AS relatieve_hoogteligging, {_simplified('t.id % 2 = 1')} AS geometrie
        FROM t JOIN q ON t.id = q.id WHERE objectcode = 612 AND nivo {level}
    """


@check("constructions_below", _construction_sql("<= 0"))
def _(t):
    return registers.constructions(_topography(t, 612), below=True)


@check("constructions_above", _construction_sql("> 0"))
def _(t):
    return registers.constructions(_topography(t, 612), below=False)


# --- documents: orders are parent items, their lines child items ----------------------

_ITEMS = """
    SELECT 10 * o_orderkey AS item_key, NULL AS it_parent_key, CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS item_deleted,
           o_orderdate AS item_created, NULL AS subject1, NULL AS subject2, CASE WHEN o_orderpriority > '2' THEN 'WK' ELSE 'BG' END AS text4
    FROM orders
    UNION ALL
    SELECT 10 * l_orderkey + l_linenumber, 10 * l_orderkey, CASE WHEN l_returnflag = 'R' THEN l_shipdate END, l_shipdate,
           CASE l_suppkey % 5 WHEN 0 THEN '\\IMPDOCSE\\' WHEN 1 THEN '\\impdocgv\\' WHEN 2 THEN '\\IMPDOCZA\\' ELSE '\\IDOCWKPB\\' || l_suppkey END,
           CASE WHEN l_partkey % 19 > 0 THEN
             CASE l_partkey % 3 WHEN 0 THEN 'se' WHEN 1 THEN 'GV' ELSE 'QQ' END || lpad(CAST(l_orderkey AS VARCHAR), 8, '0')
             || CASE l_partkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN '-' ELSE '_' END
             || CASE l_linenumber % 2 WHEN 0 THEN 'OV' ELSE 'xx' END || '00' || CASE l_linenumber % 3 WHEN 0 THEN 'ML' ELSE 'WK' END || '.pdf' END, NULL
    FROM lineitem
"""


def _items(t):
    none = F.lit(None).cast("string")
    parents = t.orders.select(
        (10 * F.col("o_orderkey")).alias("item_key"),
        F.lit(None).cast("bigint").alias("it_parent_key"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("item_deleted"),
        F.col("o_orderdate").alias("item_created"),
        none.alias("subject1"),
        none.alias("subject2"),
        F.when(F.col("o_orderpriority") > "2", "WK").otherwise("BG").alias("text4"),
    )
    p, s, n = F.col("l_partkey"), F.col("l_suppkey") % 5, F.col("l_linenumber")
    box = (
        F.when(s == 0, F.lit("\\IMPDOCSE\\"))
        .when(s == 1, F.lit("\\impdocgv\\"))
        .when(s == 2, F.lit("\\IMPDOCZA\\"))
        .otherwise(_text("\\IDOCWKPB\\", F.col("l_suppkey")))
    )
    number = F.concat(
        F.when(p % 3 == 0, "se").when(p % 3 == 1, "GV").otherwise("QQ"),
        F.lpad(F.col("l_orderkey").cast("string"), 8, "0"),
        F.when(p % 4 == 0, " ").when(p % 4 == 1, "-").otherwise("_"),
        F.when(n % 2 == 0, "OV").otherwise("xx"),
        F.lit("00"),
        F.when(n % 3 == 0, "ML").otherwise("WK"),
        F.lit(".pdf"),
    )
    children = t.lineitem.select(
        (10 * F.col("l_orderkey") + n).alias("item_key"),
        (10 * F.col("l_orderkey")).alias("it_parent_key"),
        F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("item_deleted"),
        F.col("l_shipdate").alias("item_created"),
        box.alias("subject1"),
        F.when(p % 19 > 0, number).alias("subject2"),
        none.alias("text4"),
    )
    return parents.unionByName(children)


_PAIR = "FROM i b JOIN i d ON d.item_key = b.it_parent_key WHERE d.item_deleted IS NULL AND b.item_deleted IS NULL"
# Codes of the suppliers of imported documents.
_SUPPLIERS = """('GV','MB','PC','RO','SB','TM','SA','SC','SD','SE','SF','SG','SH','SJ','SK','SM','SN','SP','SQ','SR','ST','SU','SV','SW','WP')"""
_IMPORTED = f"{_PAIR} AND b.subject2 IS NOT NULL AND upper(substring(b.subject1, 8, 2)) IN {_SUPPLIERS}"


@check(
    "source_documents",
    f"""WITH i AS MATERIALIZED ({_ITEMS}),
             d AS MATERIALIZED (SELECT item_key FROM i WHERE item_deleted IS NULL),
             b AS MATERIALIZED (
               SELECT item_key, it_parent_key, item_created, subject1, subject2 FROM i
               WHERE item_deleted IS NULL AND it_parent_key IS NOT NULL AND subject2 IS NOT NULL AND upper(substring(subject1, 8, 2)) IN {_SUPPLIERS}
                 AND NOT (subject1 = '\\IMPDOCSA\\' AND subject2 = 'SE06894773_OV00ML.pdf'))
        SELECT b.subject1, b.subject2 AS documentnummer, upper(substring(b.subject2, 1, 2)) AS bronleverancier_code,
               CASE upper(substring(b.subject2, 1, 2)) WHEN 'SE' THEN 'Stadsdeel West' WHEN 'GV' THEN 'Gegevensbeheer (Basisinformatie)' END AS bronleverancier_omschrijving,
               upper(substring(b.subject2, 12, 2)) AS typedossier_code,
               CASE upper(substring(b.subject2, 12, 2)) WHEN 'OV' THEN 'Omgevingsvergunning' END AS typedossier_omschrijving,
               upper(substring(b.subject2, 16, 2)) AS typebrondocument_code,
               CASE upper(substring(b.subject2, 16, 2)) WHEN 'ML' THEN 'Statusmelding' END AS typebrondocument_omschrijving,
               b.item_created AS registratiedatum, b.item_key AS source_id
        FROM b JOIN d ON d.item_key = b.it_parent_key""",
)
def _(t):
    return registers.source_documents(_items(t))


@check(
    "document_files",
    f"""WITH i AS ({_ITEMS}),
             c AS (SELECT regexp_extract(b.subject2, '^([^_ ]*)[_ ]', 1) AS dossier, b.item_created, b.subject2 {_IMPORTED}),
             m AS (SELECT dossier, max(item_created) AS registratiedatum FROM c GROUP BY dossier)
        SELECT c.dossier, registratiedatum, dense_rank() OVER (PARTITION BY c.dossier ORDER BY subject2) AS positie,
               subject2 AS heeft_bag_brondocument, count(*) AS aantal
        FROM c JOIN m ON c.dossier = m.dossier WHERE subject2 IS NOT NULL GROUP BY c.dossier, registratiedatum, subject2""",
)
def _(t):
    # Texts without a mark share the file ''.
    return registers.document_files(_items(t))


_RESTRICTED = f"{_PAIR} AND b.subject1 LIKE '%IDOCWKPB%' AND d.text4 = 'WK' AND upper(substring(b.subject2, 16, 2)) = 'WK'"


@check(
    "restriction_documents",
    f"""WITH i AS ({_ITEMS}), q AS (SELECT subject2, max(item_created) AS item_created FROM i GROUP BY subject2)
        SELECT b.subject2 AS documentnummer, strftime(b.item_created, {_MOMENT}) AS registratiedatum, b.item_key AS source_id
        {_RESTRICTED} AND EXISTS (SELECT 1 FROM q WHERE q.subject2 = b.subject2 AND q.item_created = b.item_created)""",
)
def _(t):
    return registers.restriction_documents(_items(t))


@check(
    "restriction_files",
    f"""WITH i AS ({_ITEMS})
        SELECT dossier, dense_rank() OVER (PARTITION BY dossier ORDER BY document) AS positie, document AS heeft_wkpb_brondocument, count(*) AS aantal
        FROM (SELECT trim(coalesce(nullif(regexp_extract(substr(b.subject2, 1, 21), '^(.*?)_', 1), ''), substr(b.subject2, 1, 21))) AS dossier,
                     substr(b.subject2, 1, 21) AS document {_RESTRICTED}) GROUP BY dossier, document""",
)
def _(t):
    return registers.restriction_files(_items(t))


# --- survey points: parts are points, lines are measurements --------------------------

_POINTS = """
    SELECT p_partkey AS id, 'N' || p_partkey AS nummer,
           CASE p_partkey % 3 WHEN 0 THEN p_name || ' (' || p_brand || ')' WHEN 1 THEN p_name || '    ' || p_brand ELSE p_name END AS omschrijving,
           CAST(p_size % 5 AS BIGINT) AS sta_id, CAST(p_size % 30 AS BIGINT) AS mer_id, CAST(6 + p_size % 4 AS BIGINT) AS typ_nummer,
           CAST(CASE WHEN p_size % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS orde,
           CASE WHEN p_size > 40 THEN TIMESTAMP '2001-02-03 04:05:06' END AS vervaldatum,
           p_retailprice AS xmuur, p_retailprice / 2 AS ymuur, p_brand AS windr, 'POINT (' || p_partkey || ' ' || p_size || ')' AS geom FROM part
"""
_MEASURED = """
    SELECT 10 * l_orderkey + l_linenumber AS id, l_partkey AS hoo_id, l_quantity AS hoogte, l_shipdate AS inwindatum,
           CAST(l_linenumber AS BIGINT) AS wijze_inwinning, l_suppkey AS bro_id FROM lineitem
"""
_LINKS = "SELECT 10 * l_orderkey + l_linenumber AS met_id, l_partkey + 1 AS hoo_id FROM lineitem WHERE l_returnflag = 'A'"


def _survey(t):
    p, size = F.col("p_partkey"), F.col("p_size")
    described = (
        F.when(p % 3 == 0, F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")))
        .when(p % 3 == 1, F.concat("p_name", F.lit("    "), "p_brand"))
        .otherwise(F.col("p_name"))
    )
    points = t.part.select(
        p.alias("id"),
        _text("N", p).alias("nummer"),
        described.alias("omschrijving"),
        (size % 5).cast("bigint").alias("sta_id"),
        (size % 30).cast("bigint").alias("mer_id"),
        (6 + size % 4).cast("bigint").alias("typ_nummer"),
        F.when(size % 3 == 0, 0).otherwise(1).cast("bigint").alias("orde"),
        F.when(size > 40, F.lit("2001-02-03 04:05:06").cast("timestamp")).alias("vervaldatum"),
        F.col("p_retailprice").alias("xmuur"),
        (F.col("p_retailprice") / 2).alias("ymuur"),
        F.col("p_brand").alias("windr"),
        F.format_string("POINT (%d %d)", p, size).alias("geom"),
    )
    number = 10 * F.col("l_orderkey") + F.col("l_linenumber")
    measured = t.lineitem.select(
        number.alias("id"),
        F.col("l_partkey").alias("hoo_id"),
        F.col("l_quantity").alias("hoogte"),
        F.col("l_shipdate").alias("inwindatum"),
        F.col("l_linenumber").cast("bigint").alias("wijze_inwinning"),
        F.col("l_suppkey").alias("bro_id"),
    )
    links = t.lineitem.where(F.col("l_returnflag") == "A").select(number.alias("met_id"), (F.col("l_partkey") + 1).alias("hoo_id"))
    rings = t.supplier.select(F.col("s_suppkey").alias("hoo_id"), F.col("s_name").alias("bou_nummer"))
    marks = t.nation.select(
        F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("omschrijving"), F.lower("n_name").alias("omschr_verkort")
    )
    statuses = t.region.select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("omschrijving"))
    firms = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("omschrijving"))
    return points, measured, links, rings, marks, statuses, firms


_PLACE = """CASE WHEN p = 0 THEN omschrijving ELSE nullif(substring(omschrijving, 1, p - 1), '') END AS adres,
    CASE WHEN p > 0 THEN nullif(ltrim(substring(omschrijving, q + 1)), '') END AS locatie"""
_SURVEY = f"""
    h AS (SELECT *, instr(replace(replace(omschrijving, '   ', chr(10)), '(', chr(10)), chr(10)) AS p,
                 instr(replace(replace(omschrijving, '(', '   '), '   ', chr(10)), chr(10)) AS q FROM ({_POINTS})),
    m AS ({_MEASURED}), r AS ({_LINKS})
"""
_POINT_COLUMNS = f"""h.nummer AS identificatie, {_PLACE}, h.sta_id AS status_id, r_name AS status_omschrijving,
    strftime(h.vervaldatum, {_DAY}) AS vervaldatum, h.mer_id AS merk_id, h.xmuur AS xmuurvlak, h.ymuur AS ymuurvlak, h.windr AS windrichting,
    s_name AS ligt_in_bouwblok, h.geom AS geometrie, h.id AS source_id, strftime(h.vervaldatum, {_MOMENT}) AS expirationdate"""
_POINT_JOINS = """h LEFT JOIN supplier k ON h.id = s_suppkey LEFT JOIN nation ON h.mer_id = n_nationkey LEFT JOIN region ON h.sta_id = r_regionkey"""


@check(
    "bolts",
    f"""WITH {_SURVEY} SELECT {_POINT_COLUMNS}, lower(n_name) AS merk_omschrijving, h.orde AS publiceerbaar
        FROM {_POINT_JOINS} WHERE (h.typ_nummer = 7 OR h.typ_nummer = 8) AND h.orde = 1""",
)
def _(t):
    points, _, _, rings, marks, statuses, _ = _survey(t)
    return registers.bolts(points, rings, marks, statuses)


@check(
    "measurements",
    f"""WITH {_SURVEY},
             a AS (SELECT r.met_id, string_agg(h.nummer, ';' ORDER BY h.nummer) AS nummer FROM r JOIN h ON r.hoo_id = h.id
                   WHERE h.typ_nummer != 7 GROUP BY r.met_id)
        SELECT m.id AS identificatie, h.nummer AS hoort_bij_meetbout, strftime(m.inwindatum, {_DAY}) AS datum,
               m.wijze_inwinning AS wijze_van_inwinnen_id, r_name AS wijze_van_inwinnen, m.hoogte AS hoogte_tov_nap,
               a.nummer AS refereert_aan_refpunt,
               s_name AS is_gemeten_door_onderneming, h.orde AS publiceerbaar, m.id AS source_id, strftime(h.vervaldatum, {_MOMENT}) AS expirationdate
        FROM h JOIN m ON h.id = m.hoo_id LEFT JOIN a ON m.id = a.met_id LEFT JOIN region ON m.wijze_inwinning = r_regionkey
        LEFT JOIN supplier ON m.bro_id = s_suppkey WHERE (h.typ_nummer = 7 OR h.typ_nummer = 8) AND h.orde = 1""",
)
def _(t):
    points, measured, links, _, _, statuses, firms = _survey(t)
    return registers.measurements(points, measured, links, statuses, firms)


@check(
    "reference_points",
    f"""WITH {_SURVEY},
             x AS (SELECT m.hoo_id, m.hoogte, m.inwindatum FROM m JOIN (SELECT hoo_id, max(inwindatum) AS d FROM m GROUP BY hoo_id) g
                   ON m.hoo_id = g.hoo_id AND m.inwindatum = g.d)
        SELECT {_POINT_COLUMNS}, n_name AS merk_omschrijving, x1.hoogte AS hoogte_tov_nap, strftime(x2.inwindatum, {_DAY}) AS datum,
               CASE WHEN h.typ_nummer = 6 THEN h.nummer END AS is_peilmerk, CASE WHEN h.vervaldatum IS NOT NULL THEN 'N' ELSE 'J' END AS publiceerbaar
        FROM {_POINT_JOINS} LEFT JOIN x x1 ON h.id = x1.hoo_id LEFT JOIN x x2 ON h.id = x2.hoo_id
        WHERE (h.nummer IN (SELECT h.nummer FROM h JOIN r ON h.id = r.hoo_id WHERE h.typ_nummer = 6)
            OR h.nummer IN (SELECT h.nummer FROM h JOIN r ON h.id = r.hoo_id WHERE h.typ_nummer = 9) OR h.typ_nummer = 8)
          AND h.vervaldatum IS NULL""",
)
def _(t):
    points, measured, links, rings, marks, statuses, _ = _survey(t)
    return registers.reference_points(points, rings, marks, statuses, measured, links)


# --- restrictions: orders of a customer are the states of one restriction -------------

_RESTRICTIONS = """
    SELECT o_custkey AS id, CASE WHEN o_orderstatus <> 'P' THEN 'R' || o_orderkey END AS registernummer, o_orderkey % 5 AS volgnummer,
           o_custkey % 30 AS id_beperkingtype, o_custkey % 7 AS id_status, o_orderkey % 6 AS id_aard, o_custkey % 200 AS id_orgaan,
           o_custkey - 1 AS id_voorgaande_beperking, o_orderdate AS datum_bekendmaking, o_orderdate AS datum_inwerking,
           CASE WHEN o_orderpriority > '3' THEN o_orderdate END AS datum_einde,
           CASE WHEN o_orderkey % 2 = 0 THEN 'WK' || o_orderkey || '_' || o_custkey ELSE 'WK ' || o_orderkey || ' zonder streep erin' END AS kenmerk,
           o_orderpriority AS afschermenpersoonsgegevens, o_orderdate AS creation, 'POINT (' || o_custkey || ' 1)' AS geometrie FROM orders
"""


def _restrictions(t):
    c, k, d = F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderdate")
    mark = F.when(k % 2 == 0, F.concat(_text("WK", k), _text("_", c))).otherwise(
        F.concat(_text("WK ", k), F.lit(" zonder streep erin"))
    )
    return t.orders.select(
        c.alias("id"),
        F.when(F.col("o_orderstatus") != "P", _text("R", k)).alias("registernummer"),
        (k % 5).alias("volgnummer"),
        (c % 30).alias("id_beperkingtype"),
        (c % 7).alias("id_status"),
        (k % 6).alias("id_aard"),
        (c % 200).alias("id_orgaan"),
        (c - 1).alias("id_voorgaande_beperking"),
        d.alias("datum_bekendmaking"),
        d.alias("datum_inwerking"),
        F.when(F.col("o_orderpriority") > "3", d).alias("datum_einde"),
        mark.alias("kenmerk"),
        F.col("o_orderpriority").alias("afschermenpersoonsgegevens"),
        d.alias("creation"),
        F.format_string("POINT (%d 1)", c).alias("geometrie"),
    )


@check(
    "restrictions",
    f"""WITH b AS ({_RESTRICTIONS}), m AS (SELECT id, max(volgnummer) AS volgnummer FROM b GROUP BY id)
        SELECT b.registernummer AS identificatie, b.volgnummer, n_nationkey::BIGINT AS beperking_code, n_name AS beperking_omschrijving,
               strftime(b.datum_bekendmaking, {_DAY}) AS datum_bekendmaking, strftime(b.datum_inwerking, {_MOMENT}) AS begingeldigheid,
               strftime(b.datum_einde, {_MOMENT}) AS eindgeldigheid, s.r_regionkey::BIGINT AS status_code, s.r_name AS status_omschrijving,
               a.r_regionkey::BIGINT AS aard_code, a.r_name AS aard_omschrijving, x.registernummer AS heeft_voorgaande_beperking,
               b.kenmerk AS documentnummer,
               trim(coalesce(nullif(regexp_extract(substr(b.kenmerk, 1, 21), '^(.*?)_', 1), ''), substr(b.kenmerk, 1, 21))) AS heeft_dossier,
               s_suppkey AS orgaan_code, s_name AS orgaan_omschrijving, b.afschermenpersoonsgegevens AS persoonsgegevens_afschermen,
               strftime(b.creation, {_MOMENT}) AS registratiedatum, strftime(b.datum_einde, {_MOMENT}) AS expirationdate, b.id AS source_id, b.geometrie
        FROM b LEFT JOIN nation ON b.id_beperkingtype = n_nationkey LEFT JOIN region s ON b.id_status = s.r_regionkey
        LEFT JOIN region a ON b.id_aard = a.r_regionkey LEFT JOIN supplier ON b.id_orgaan = s_suppkey
        LEFT JOIN b x ON b.id_voorgaande_beperking = x.id AND b.volgnummer = x.volgnummer
        LEFT JOIN m ON m.id = b.id AND m.volgnummer = b.volgnummer WHERE b.registernummer IS NOT NULL AND m.id IS NOT NULL""",
)
def _(t):
    kinds = t.nation.select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_nationkey").cast("bigint").alias("code"), F.col("n_name").alias("naam"))
    codes = t.region.select(F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("naam"))
    bodies = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("naam"))
    return registers.restrictions(_restrictions(t), kinds, codes, codes, bodies)


# --- plain extracts ---------------------------------------------------------------------


@check(
    "address_extract",
    """SELECT event_id AS identificatie, CAST(user_id AS BIGINT) AS volgnummer, ts AS registratiedatum,
              CASE WHEN event_type = 'error' THEN 'J' ELSE 'N' END AS geconstateerd, props AS status,
              coalesce(CASE WHEN event_type <> 'view' THEN props END, '{}') AS gebruiksdoel, CAST(NULL AS VARCHAR) AS bagproces FROM events""",
)
def _(t):
    source = t.events.withColumns(
        {
            "nummer": F.col("user_id").cast("string"),
            "fout": F.col("event_type") == "error",
            "doel": F.when(F.col("event_type") != "view", F.col("props")),
        }
    )
    extract = projection.Extract(
        columns=[("identificatie", "event_id"), ("volgnummer", "nummer"), ("registratiedatum", "ts"),
                 ("geconstateerd", "fout"), ("status", "props"), ("gebruiksdoel", "doel")],
        integers=frozenset({"volgnummer"}),
        flags=frozenset({"geconstateerd"}),
        json=frozenset({"status"}),
        json_or_empty=frozenset({"gebruiksdoel"}),
        constants={"bagproces": (None, "string")},
    )
    out = extract.apply(source)
    return out.withColumn("volgnummer", F.col("volgnummer").cast("bigint"))


@check(
    "cadastre_extract",
    """SELECT o_orderkey AS neuron_id, o_orderpriority AS aard_code, CAST(o_orderdate AS DATE) AS toestandsdatum, o_totalprice AS koopsom FROM orders""",
)
def _(t):
    extract = projection.Extract(
        columns=[("neuron_id", "o_orderkey"), ("aard_code", "o_orderpriority"), ("toestandsdatum", "o_orderdate"), ("koopsom", "o_totalprice")],
        dates=frozenset({"toestandsdatum"}),
    )
    return extract.apply(t.orders)


_PARTS = Definition.from_dict(
    {
        "catalogue": "trade",
        "entity": "parts",
        "source": {"name": "TPCH", "application": "Prepared", "entity_id": "part_key"},
        "mapping": {
            "identificatie": {"source_mapping": "part_key"},
            "volgnummer": {"source_mapping": "volgnummer"},
            "naam": {"source_mapping": "part_name"},
            "soort": {"source_mapping": {"code": "part_type", "omschrijving": "part_type"}},
            "maat": {"source_mapping": "kenmerken.maat"},
            "eind_geldigheid": {"source_mapping": "eind_geldigheid"},
        },
    }
)


@check(
    "extract_drawn_up_from_definition",
    """SELECT p_partkey AS identificatie, CAST(1 AS BIGINT) AS volgnummer, p_name AS naam, p_type AS soort,
              CAST(p_size AS VARCHAR) AS maat, CAST(NULL AS TIMESTAMP) AS eind_geldigheid FROM part""",
)
def _(t):
    prepared = t.part.select(
        F.col("p_partkey").alias("partKey"), F.col("p_name").alias("partName"), F.col("p_type").alias("partType"),
        F.format_string('{"maat": %d}', "p_size").alias("kenmerken"), "p_brand",
    )
    extract = extracts.draw_up(
        _PARTS, prepared, constants={"volgnummer": (1, "bigint"), "eind_geldigheid": (None, "timestamp")}, json=["kenmerken"]
    )
    mapped = mapping.map_entity(extract.apply(prepared), _PARTS.mapping)
    return mapped.withColumn("soort", F.col("soort.code"))


# --- a whole definition -------------------------------------------------------------------

CUSTOMER_DEFINITION = Definition.from_dict(
    {
        "version": "0.1",
        "catalogue": "trade",
        "entity": "customers",
        "source": {
            "name": "TPCH",
            "application": "Orders",
            "entity_id": "c_custkey",
            "merge": {"dataset": "suppliers", "id": "fill", "on": "c_custkey", "copy": ["telefoon"]},
            "enrich": {"identificatie": {"type": "autoid", "on": "code", "template": "77XXXXXXXXX"}},
        },
        "not_provided_attributes": ["registratiedatum"],
        "mapping": {
            "code": {"source_mapping": "c_name", "filters": [["re.sub", "(.*)#0*(.+)", "\\2"], ["upper"]]},
            "saldo": {"source_mapping": "saldo"},
            "segment": {"source_mapping": {"code": "c_mktsegment", "omschrijving": "c_mktsegment"}},
            "land": {"source_mapping": {"bronwaarde": "c_nationkey"}},
            "telefoon": {"source_mapping": "telefoon"},
            "begin_geldigheid": {"source_mapping": "=2010-01-01", "format": "%Y-%m-%d"},
        },
    }
)
_CUSTOMER_TYPES = {"code": "string", "saldo": "decimal", "telefoon": "string", "begin_geldigheid": "date", "registratiedatum": "datetime"}


def _customers(t):
    """Extract and second dataset of the customers; some balances are no number."""
    key = F.col("c_custkey")
    extract = t.customer.select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment",
        F.when(key % 17 == 0, F.lit("onbekend")).otherwise(F.col("c_acctbal").cast("string")).alias("saldo"),
    )
    phones = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), _text("tel ", F.col("s_suppkey")).alias("telefoon"))
    return extract, phones


def _snapshot(extract, phones):
    """An earlier snapshot: a third of the customers missing, some balances different."""
    first = runner.run(CUSTOMER_DEFINITION, extract, _CUSTOMER_TYPES, merge_with=phones)
    return first.entity.where(F.col("_id").cast("bigint") % 3 != 0).withColumn(
        "saldo", F.when(F.col("_id").cast("bigint") % 5 == 0, F.col("saldo") + 1).otherwise(F.col("saldo"))
    )


@check(
    "r3_run_definition",
    """WITH v AS (SELECT c_custkey, c_name, c_mktsegment, c_nationkey, c_acctbal, CAST(c_custkey AS VARCHAR) AS code,
                         s_suppkey FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey WHERE c_custkey % 17 <> 0)
       SELECT CAST(c_custkey AS VARCHAR) AS _id, code, '77' || lpad(CAST(row_number() OVER (ORDER BY code) AS VARCHAR), 9, '0') AS identificatie,
              c_acctbal AS saldo, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS land,
              CASE WHEN s_suppkey IS NOT NULL THEN 'tel ' || s_suppkey END AS telefoon, DATE '2010-01-01' AS begin_geldigheid,
              'TPCH' AS _source, 'Orders' AS _application FROM v""",
)
def _(t):
    extract, phones = _customers(t)
    load = runner.run(CUSTOMER_DEFINITION, extract, _CUSTOMER_TYPES, merge_with=phones)
    # The driver's checks compare flat columns.
    return load.entity.select(
        "_id", "code", "identificatie", F.col("saldo").cast("double").alias("saldo"), F.col("segment.code").alias("segment"),
        F.col("land.bronwaarde").alias("land"), "telefoon", "begin_geldigheid", "_source", "_application",
    )


@check(
    "r3_changes_of_a_run",
    """SELECT CAST(c_custkey AS VARCHAR) AS _id, CASE WHEN c_custkey % 3 = 0 THEN 'ADD' WHEN c_custkey % 5 = 0 THEN 'MODIFY' ELSE 'CONFIRM' END AS action,
              CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 = 0 THEN 'saldo' ELSE '' END AS changed
       FROM customer WHERE c_custkey % 17 <> 0""",
)
def _(t):
    extract, phones = _customers(t)
    current = _snapshot(extract, phones)
    load = runner.run(CUSTOMER_DEFINITION, extract, _CUSTOMER_TYPES, merge_with=phones, registry=current, current=current)
    return load.changes.select("_id", "action", F.array_join("changed", ",").alias("changed"))


_BALANCE = {"saldo": "decimal"}


@check(
    "r3_quarantine_is_no_delete",
    """SELECT CAST(c_custkey AS VARCHAR) AS _id, CASE WHEN c_custkey % 7 = 0 THEN 'DELETE' WHEN c_custkey % 5 = 0 THEN 'MODIFY' ELSE 'CONFIRM' END AS action
       FROM customer WHERE c_custkey % 7 = 0 OR (c_custkey % 17 <> 0 AND c_custkey % 19 <> 0)""",
)
def _(t):
    # All customers are known; the load lacks some, spoils some and brings some twice.
    extract, phones = _customers(t)
    known = runner.run(CUSTOMER_DEFINITION, extract.withColumn("saldo", F.lit("1")), _BALANCE, merge_with=phones)
    key = F.col("c_custkey")
    balance = F.when(key % 17 == 0, "onbekend").when(key % 5 == 0, "2").otherwise("1")
    load = extract.withColumn("saldo", balance).where(key % 7 != 0)
    load = load.unionByName(load.where(key % 19 == 0))
    again = runner.run(CUSTOMER_DEFINITION, load, _BALANCE, merge_with=phones, registry=known.entity, current=known.entity)
    return again.changes.select("_id", "action")


@check(
    "r3_doubled_keys_in_quarantine",
    """SELECT CAST(c_custkey AS VARCHAR) AS _id, '_key' AS attribute, CAST(c_custkey AS VARCHAR) AS value
       FROM customer, (SELECT 1 UNION ALL SELECT 2) WHERE c_custkey % 19 = 0""",
)
def _(t):
    extract, phones = _customers(t)
    load = extract.withColumn("saldo", F.lit("1"))
    load = load.unionByName(load.where(F.col("c_custkey") % 19 == 0))
    return runner.run(CUSTOMER_DEFINITION, load, _BALANCE, merge_with=phones).quarantine


def _states_definition(**more):
    spec = {
        "id": {"source_mapping": "id"},
        "volgnummer": {"source_mapping": "nr"},
        "prijs": {"source_mapping": "prijs"},
        **more,
    }
    return Definition.from_dict({"catalogue": "c", "entity": "e", "source": {"name": "S", "application": "F", "entity_id": "id"}, "mapping": spec})


def _order_lines(t):
    return t.lineitem.where("l_linenumber < 5").groupBy("l_orderkey", "l_linenumber").agg(F.lit("1").alias("prijs")).select(
        F.col("l_orderkey").cast("string").alias("id"), F.col("l_linenumber").cast("string").alias("nr"), "prijs", "l_orderkey", "l_linenumber"
    )


@check(
    "r3_refused_state_spares_itself",
    """WITH lines AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber < 5),
            unknown AS (SELECT l_orderkey FROM lines WHERE l_linenumber = 1 AND l_orderkey % 7 = 0)
       SELECT l_orderkey::VARCHAR AS _id, l_linenumber::INTEGER AS volgnummer, CASE WHEN l_linenumber = 3 THEN 'DELETE' ELSE 'CONFIRM' END AS action
       FROM lines
       WHERE NOT (l_linenumber = 2 AND l_orderkey % 5 = 0) AND NOT (l_linenumber = 4 AND l_orderkey % 11 = 0)
         AND NOT (l_linenumber = 3 AND l_orderkey IN (SELECT l_orderkey FROM unknown))""",
)
def _(t):
    """Third states go; refused second and doubled fourth ones do not, nor any state of an order with a line of unknown number."""
    lines = _order_lines(t)
    types = {"prijs": "integer", "volgnummer": "integer"}
    known = runner.run(_states_definition(), lines, types).entity
    key, nr = F.col("l_orderkey"), F.col("l_linenumber")
    load = lines.where(nr != 3).withColumn("prijs", F.when((nr == 2) & (key % 5 == 0), "duur").otherwise(F.col("prijs")))
    load = load.unionByName(load.where((nr == 4) & (key % 11 == 0)))
    load = load.unionByName(load.where((nr == 1) & (key % 7 == 0)).withColumn("nr", F.lit("onbekend")))
    return runner.run(_states_definition(), load, types, current=known).changes.select("_id", "volgnummer", "action")


@check(
    "r3_doubled_before_refused",
    """SELECT c_custkey::VARCHAR AS _id, attribute, value FROM customer,
         (SELECT '_key' AS attribute, NULL AS value UNION ALL SELECT '_key', NULL UNION ALL SELECT 'saldo', 'veel') e WHERE c_custkey % 19 = 0""".replace(
        "attribute, value FROM", "attribute, coalesce(value, c_custkey::VARCHAR) AS value FROM"
    ),
)
def _(t):
    """One of two rows of a key is bad: the other one is not loaded either."""
    extract, phones = _customers(t)
    load = extract.withColumn("saldo", F.lit("1"))
    load = load.unionByName(load.where(F.col("c_custkey") % 19 == 0).withColumn("saldo", F.lit("veel")))
    return runner.run(CUSTOMER_DEFINITION, load, _BALANCE, merge_with=phones).quarantine


@check(
    "r3_bad_values_inside_references",
    """SELECT _id, volgnummer, attribute, value FROM (
         SELECT l_orderkey::VARCHAR AS _id, l_linenumber::INTEGER AS volgnummer, 'ref.begin_geldigheid' AS attribute, 'geen dag' AS value, l_linenumber % 2 = 0 AS there FROM lines
         UNION ALL SELECT l_orderkey::VARCHAR, l_linenumber::INTEGER, 'refs[1].begin_geldigheid', '2001-13-01', l_orderkey % 3 = 0 FROM lines
         UNION ALL SELECT l_orderkey::VARCHAR, l_linenumber::INTEGER, 'deel.dag', '31.02.2001', l_orderkey % 5 = 0 FROM lines
         UNION ALL SELECT l_orderkey::VARCHAR, l_linenumber::INTEGER, 'nummers[0].nr', 'ZESX', l_orderkey % 7 = 0 FROM lines)
       WHERE there""".replace("FROM lines", "FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber < 5)"),
)
def _(t):
    """Every part is checked with its own type and format, in lists too, as its filters leave it."""
    more = {
        "ref": {"source_mapping": {"bronwaarde": "id", "begin_geldigheid": "sinds"}},
        "refs": {"source_mapping": {"bronwaarde": "doelen", "begin_geldigheid": "momenten", "format": {"split": ";"}}},
        "deel": {"source_mapping": {"dag": "dag", "code": "id"}, "format": {"dag": "%d.%m.%Y"}},
        "nummers": {"source_mapping": {"nr": "lijst", "format": {"split": ","}}, "filters": {"nr": [["upper"]]}},
    }
    types = {"prijs": "integer", "volgnummer": "integer", "nummers.nr": "integer"}
    key, nr = F.col("l_orderkey"), F.col("l_linenumber")
    lines = _order_lines(t).withColumns({
        "sinds": F.when(nr % 2 == 0, "geen dag").otherwise("2001-01-01"),
        "doelen": F.lit("a;b;c"),
        "momenten": F.when(key % 3 == 0, "2001-01-01;2001-13-01;").otherwise(";2002-02-02 10:00:00;"),
        "dag": F.when(key % 5 == 0, "31.02.2001").otherwise("28.02.2001"),
        "lijst": F.when(key % 7 == 0, "zesx,7").otherwise("6, 7"),
    })
    return runner.run(_states_definition(**more), lines, types).quarantine


@check(
    "r3_refused_load",
    "SELECT 'trade.customers' AS dataset, count(*) AS rows, count(*) + 1 AS min_rows, FALSE AS ok, CAST(0 AS BIGINT) AS changes FROM customer",
)
def _(t):
    # One row fewer than the definition asks for: everything would be deleted or changed, and nothing is.
    extract, phones = _customers(t)
    known = _snapshot(extract, phones)
    strict = replace(CUSTOMER_DEFINITION, min_rows=t.customer.count() + 1)
    load = runner.run(strict, extract, _CUSTOMER_TYPES, merge_with=phones, registry=known, current=known)
    n = load.changes.agg(F.count(F.lit(1)).alias("changes"))
    return load.guard.crossJoin(n)  # one row each


@check(
    "r3_format_implies_type",
    """SELECT CAST(event_id AS VARCHAR) AS _id, 'dag' AS attribute, 'notadate' AS value FROM events WHERE event_id % 10 = 0""",
)
def _(t):
    day = F.when(F.col("event_id") % 10 == 0, "notadate").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    rows = t.events.select("event_id", day.alias("dag"))
    spec = {"dag": {"source_mapping": "dag", "format": "%Y-%m-%d"}}
    source = {"name": "S", "application": "F", "entity_id": "event_id"}
    return runner.run(Definition.from_dict({"catalogue": "c", "entity": "e", "source": source, "mapping": spec}), rows).quarantine


@check(
    "r3_protected_run",
    """SELECT CAST(c_custkey AS VARCHAR) AS _id, sha256('zout' || c_name) AS naam, sha256('zout' || CAST(c_nationkey AS VARCHAR)) AS land,
              c_mktsegment AS segment FROM customer""",
)
def _(t):
    spec = {
        "naam": {"source_mapping": "c_name"},
        "land": {"source_mapping": {"bronwaarde": "c_nationkey"}},
        "segment": {"source_mapping": "c_mktsegment"},
    }
    source = {"name": "S", "application": "F", "entity_id": "c_custkey"}
    d = Definition.from_dict({"catalogue": "c", "entity": "e", "source": source, "mapping": spec})
    load = runner.run(d, t.customer, {"naam": "secure_string", "land": "secure_number"}, salt="zout")
    return load.entity.select("_id", "naam", F.col("land.bronwaarde").alias("land"), "segment")
