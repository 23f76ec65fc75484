"""The composite register queries, each over frames with the source tables' columns.

Output names are the attribute names the import definitions map from.
Geometries come as WKT text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stateweave.functions import code_tables, dates, text, values, wkt
from stateweave.operators import history, lists, lookups
from stateweave.operators.predicates import alive, code_in, except_row

# Object codes, day of the change of area codes, simplification tolerance in metres.
BLOCK, NEIGHBOURHOOD, DISTRICT, BOROUGH, CONSTRUCTION = 6023, 6021, 6025, 6027, 612
CODES_CHANGED = "2022-03-24"
TOLERANCE = 0.05
# Kinds of survey points.
LEVEL_MARK, BOLT, REFERENCE_BOLT, UNDERGROUND_MARK = 6, 7, 8, 9
# Markers of restriction documents.
RESTRICTION_BOX, RESTRICTION_KIND = "IDOCWKPB", "WK"

_day = lambda c: dates.day_text(F.col(c))
_moment = lambda c: dates.moment_text(F.col(c))


def _simplified(c: Column) -> Column:
    """Polygons simplified, each ring of every one; other geometries as they are."""
    return wkt.simplify_text(c, TOLERANCE)


def city_blocks(topography: DataFrame, blocks: DataFrame, ordered: bool = True) -> DataFrame:
    """Block states, numbered per block code."""
    t = topography.where(F.col("objectcode") == BLOCK)
    t = history.drop_empty_states(t, "inwin", "verval")
    joined = t.join(blocks.select("dgdtw_primary_key", "code"), F.col("id") == F.col("dgdtw_primary_key"))
    out = history.state_number(joined, ["code"], ["inwin"]).select(
        "code",
        F.lit(None).cast("string").alias("identificatie"),
        "volgnummer",
        _day("inwin").alias("begin_geldigheid"),
        _day("verval").alias("eind_geldigheid"),
        _moment("inwin").alias("registratiedatum"),
        F.col("guid").alias("source_id"),
        _moment("verval").alias("expirationdate"),
        "geometrie",
        F.lit(None).cast("string").alias("ligt_in_buurt"),
    )
    # A sort runs its input twice (to sample, then to move), so the costly part comes after it.
    out = out.orderBy("code", "volgnummer") if ordered else out
    return out.withColumn("geometrie", _simplified(F.col("geometrie")))


def _area_states(topography: DataFrame, areas: DataFrame, object_code: int) -> DataFrame:
    """Area states with the successor's start as a missing end, numbered per guid."""
    states = topography.join(areas, F.col("id") == F.col("dgdtw_primary_key"))
    followed = history.successor_end(
        states, "guid", "inwin", "verval", {"next_inwin": "inwin", "next_start": "ingsdatum"}
    )
    ended = followed.where(F.col("objectcode") == object_code).withColumn(
        "einde", F.coalesce("einddatum", "next_start")
    )
    return history.state_number(history.drop_empty_states(ended, "ingsdatum", "einde"), ["guid"], ["next_inwin"])


def _area_columns() -> list[Column]:
    return [
        F.col("volgnummer"),
        _day("ingsdatum").alias("begin_geldigheid"),
        _day("einde").alias("eind_geldigheid"),
        _day("docdatum").alias("documentdatum"),
        F.col("docnr").alias("documentnummer"),
        _moment("inwin").alias("registratiedatum"),
        F.col("guid").alias("source_id"),
        _moment("einde").alias("expirationdate"),
        F.col("geometrie"),
    ]


def _coded(*parts: str) -> Column:
    """Area code: with the borough in front for states that ended before the change of codes."""
    tail = [F.col(p) for p in parts]
    old = F.col("einde") <= dates.moment(CODES_CHANGED)
    return F.when(old, text.join_codes(F.col("sdlcode"), *tail)).otherwise(text.join_codes(*tail))


def boroughs(topography: DataFrame, areas: DataFrame, ordered: bool = True) -> DataFrame:
    out = _area_states(topography, areas, BOROUGH).select(
        F.col("naam"), F.col("sdlcode").alias("code"), *_area_columns()
    )
    return out.orderBy("code", "volgnummer") if ordered else out


def districts(topography: DataFrame, areas: DataFrame, ordered: bool = True) -> DataFrame:
    out = _area_states(topography, areas, DISTRICT).select(
        F.col("naam"), _coded("wijkcode").alias("code"), F.col("sdlcode").alias("ligt_in_stadsdeel"), *_area_columns()
    )
    return out.orderBy("code", "volgnummer") if ordered else out


def neighbourhoods(topography: DataFrame, areas: DataFrame, ordered: bool = True) -> DataFrame:
    out = _area_states(topography, areas, NEIGHBOURHOOD).select(
        F.col("naam"),
        _coded("wijkcode", "brtcode").alias("code"),
        F.lit(None).cast("string").alias("identificatie"),
        _coded("wijkcode").alias("ligt_in_wijk"),
        *_area_columns(),
    )
    return out.orderBy("code", "volgnummer") if ordered else out


def constructions(topography: DataFrame, below: bool) -> DataFrame:
    """Under- or overpass constructions; states are numbered over all object codes, then filtered."""
    numbered = history.state_number(topography, ["guid"], ["inwin", "verval"])
    level = F.col("nivo") <= 0 if below else F.col("nivo") > 0
    return numbered.where((F.col("objectcode") == CONSTRUCTION) & level).select(
        text.strip_ends(F.col("guid")).alias("identificatie"),
        "volgnummer",
        _day("inwin").alias("begin_geldigheid"),
        _day("verval").alias("eind_geldigheid"),
        _moment("inwin").alias("registratiedatum"),
        F.col("id").alias("source_id"),
        _moment("verval").alias("expirationdate"),
        F.col("nivo").alias("relatieve_hoogteligging"),
        _simplified(F.col("geometrie")).alias("geometrie"),
    )


def _imported_items(items: DataFrame) -> DataFrame:
    """Items of the imported suppliers whose own and whose parent's deletion mark is unset."""
    kept = items.where(
        alive(F.col("item_deleted"))
        & F.col("subject2").isNotNull()
        & code_in(F.col("subject1"), 8, 2, code_tables.IMPORTED_SUPPLIERS)
    )
    parents = items.where(alive(F.col("item_deleted"))).select(F.col("item_key").alias("__parent"))
    return kept.join(parents, F.col("it_parent_key") == F.col("__parent")).drop("__parent")


def source_documents(items: DataFrame) -> DataFrame:
    code = lambda at: text.upper_slice(F.col("subject2"), at, 2)
    subject1, subject2 = code_tables.KNOWN_DUPLICATE
    return (
        _imported_items(items)
        .where(except_row(subject1=subject1, subject2=subject2))
        .select(
            "subject1",
            F.col("subject2").alias("documentnummer"),
            code(1).alias("bronleverancier_code"),
            values.code_label(code(1), code_tables.SUPPLIERS).alias("bronleverancier_omschrijving"),
            code(12).alias("typedossier_code"),
            values.code_label(code(12), code_tables.FILE_TYPES).alias("typedossier_omschrijving"),
            code(16).alias("typebrondocument_code"),
            values.code_label(code(16), code_tables.DOCUMENT_TYPES).alias("typebrondocument_omschrijving"),
            F.col("item_created").alias("registratiedatum"),
            F.col("item_key").alias("source_id"),
        )
    )


def document_files(items: DataFrame) -> DataFrame:
    """Files with their documents in order, a row each: a file's list may grow without bound."""
    coded = _imported_items(items).select(
        text.prefix_before(F.col("subject2")).alias("dossier"), "item_created", "subject2"
    )
    latest = coded.groupBy("dossier").agg(F.max("item_created").alias("registratiedatum"))
    listed = lists.ordered_rows(coded, ["dossier"], "subject2", out="heeft_bag_brondocument", position="positie", copies="aantal")
    return listed.join(latest, "dossier").select("dossier", "registratiedatum", "positie", "heeft_bag_brondocument", "aantal")


def _described(points: DataFrame, ring_points: DataFrame, marks: DataFrame, statuses: DataFrame, mark_text: str) -> DataFrame:
    out = lookups.lookup(points, ring_points, {"id": "hoo_id"}, {"ligt_in_bouwblok": "bou_nummer"})
    out = lookups.lookup(out, marks, {"mer_id": "id"}, {"merk_omschrijving": mark_text})
    return lookups.lookup(out, statuses, {"sta_id": "id"}, {"status_omschrijving": "omschrijving"})


def _point_columns() -> list[Column]:
    return [
        F.col("nummer").alias("identificatie"),
        text.address_part(F.col("omschrijving")).alias("adres"),
        text.location_part(F.col("omschrijving")).alias("locatie"),
        F.col("sta_id").alias("status_id"),
        F.col("status_omschrijving"),
        _day("vervaldatum").alias("vervaldatum"),
        F.col("mer_id").alias("merk_id"),
        F.col("merk_omschrijving"),
        F.col("xmuur").alias("xmuurvlak"),
        F.col("ymuur").alias("ymuurvlak"),
        F.col("windr").alias("windrichting"),
        F.col("ligt_in_bouwblok"),
        F.col("geom").alias("geometrie"),
        F.col("id").alias("source_id"),
        _moment("vervaldatum").alias("expirationdate"),
    ]


def bolts(points: DataFrame, ring_points: DataFrame, marks: DataFrame, statuses: DataFrame) -> DataFrame:
    wanted = points.where(F.col("typ_nummer").isin(BOLT, REFERENCE_BOLT) & (F.col("orde") == 1))
    out = _described(wanted, ring_points, marks, statuses, "omschr_verkort")
    return out.select(*_point_columns(), F.col("orde").alias("publiceerbaar"))


def measurements(
    points: DataFrame, measured: DataFrame, reference_links: DataFrame, methods: DataFrame, firms: DataFrame
) -> DataFrame:
    """Measurements of publishable bolts with the reference points they rest on."""
    wanted = points.where(F.col("typ_nummer").isin(BOLT, REFERENCE_BOLT) & (F.col("orde") == 1)).select(
        F.col("id").alias("__point"), F.col("nummer").alias("hoort_bij_meetbout"), "vervaldatum", "orde"
    )
    anchors = points.where(F.col("typ_nummer") != BOLT).select(F.col("id").alias("__anchor"), "nummer")
    linked = reference_links.join(anchors, F.col("hoo_id") == F.col("__anchor")).select("met_id", "nummer")
    listed = lists.ordered_text(linked, ["met_id"], "nummer", out="refereert_aan_refpunt")
    out = measured.join(wanted, F.col("hoo_id") == F.col("__point"))
    out = lookups.lookup(out, listed, {"id": "met_id"}, {"refereert_aan_refpunt": "refereert_aan_refpunt"})
    out = lookups.lookup(out, methods, {"wijze_inwinning": "id"}, {"wijze_van_inwinnen": "omschrijving"})
    out = lookups.lookup(out, firms, {"bro_id": "id"}, {"is_gemeten_door_onderneming": "omschrijving"})
    return out.select(
        F.col("id").alias("identificatie"),
        "hoort_bij_meetbout",
        _day("inwindatum").alias("datum"),
        F.col("wijze_inwinning").alias("wijze_van_inwinnen_id"),
        "wijze_van_inwinnen",
        F.col("hoogte").alias("hoogte_tov_nap"),
        "refereert_aan_refpunt",
        "is_gemeten_door_onderneming",
        F.col("orde").alias("publiceerbaar"),
        F.col("id").alias("source_id"),
        _moment("vervaldatum").alias("expirationdate"),
    )


def reference_points(
    points: DataFrame,
    ring_points: DataFrame,
    marks: DataFrame,
    statuses: DataFrame,
    measured: DataFrame,
    reference_links: DataFrame,
    dedupe: bool = False,
) -> DataFrame:
    """Points in use as a reference, with the latest measurement.

    Height and date are looked up independently, so k measurements on the last
    day give k * k rows as the source query does; ``dedupe`` keeps one of each.
    """
    linked = lookups.semi(points, reference_links, {"id": "hoo_id"})
    in_use = [linked.where(F.col("typ_nummer") == kind).select("nummer") for kind in (LEVEL_MARK, UNDERGROUND_MARK)]
    wanted = lookups.in_any(
        points.where(F.col("vervaldatum").isNull()), "nummer", in_use, F.coalesce(F.col("typ_nummer") == REFERENCE_BOLT, F.lit(False))
    )
    out = _described(wanted, ring_points, marks, statuses, "omschrijving")
    facts = measured.select("hoo_id", "hoogte", "inwindatum")
    out = lookups.asof_latest(out, facts, "id", "hoo_id", "inwindatum", {"hoogte_tov_nap": "hoogte"}, dedupe)
    out = lookups.asof_latest(out, facts, "id", "hoo_id", "inwindatum", {"laatst": "inwindatum"}, dedupe)
    return out.select(
        *_point_columns(),
        "hoogte_tov_nap",
        _day("laatst").alias("datum"),
        F.when(F.col("typ_nummer") == LEVEL_MARK, F.col("nummer")).alias("is_peilmerk"),
        values.yes_no(F.col("vervaldatum").isNull()).alias("publiceerbaar"),
    )


def restrictions(
    restricted: DataFrame, kinds: DataFrame, statuses: DataFrame, natures: DataFrame, bodies: DataFrame
) -> DataFrame:
    """Latest state of every registered restriction with its codes and its predecessor."""
    latest = lookups.latest_by(restricted, ["id"], "volgnummer").where(F.col("registernummer").isNotNull())
    out = lookups.lookup(latest, kinds, {"id_beperkingtype": "id"}, {"beperking_code": "code", "beperking_omschrijving": "naam"})
    out = lookups.lookup(out, statuses, {"id_status": "id"}, {"status_code": "id", "status_omschrijving": "naam"})
    out = lookups.lookup(out, natures, {"id_aard": "id"}, {"aard_code": "id", "aard_omschrijving": "naam"})
    out = lookups.lookup(out, bodies, {"id_orgaan": "id"}, {"orgaan_code": "id", "orgaan_omschrijving": "naam"})
    out = lookups.lookup(
        out,
        restricted,
        {"id_voorgaande_beperking": "id", "volgnummer": "volgnummer"},
        {"heeft_voorgaande_beperking": "registernummer"},
    )
    return out.select(
        F.col("registernummer").alias("identificatie"),
        "volgnummer",
        "beperking_code",
        "beperking_omschrijving",
        _day("datum_bekendmaking").alias("datum_bekendmaking"),
        _moment("datum_inwerking").alias("begingeldigheid"),
        _moment("datum_einde").alias("eindgeldigheid"),
        "status_code",
        "status_omschrijving",
        "aard_code",
        "aard_omschrijving",
        "heeft_voorgaande_beperking",
        F.col("kenmerk").alias("documentnummer"),
        text.file_code(F.col("kenmerk")).alias("heeft_dossier"),
        "orgaan_code",
        "orgaan_omschrijving",
        F.col("afschermenpersoonsgegevens").alias("persoonsgegevens_afschermen"),
        _moment("creation").alias("registratiedatum"),
        _moment("datum_einde").alias("expirationdate"),
        F.col("id").alias("source_id"),
        "geometrie",
    )


def _restriction_items(items: DataFrame) -> DataFrame:
    kept = items.where(
        alive(F.col("item_deleted"))
        & F.col("subject1").contains(RESTRICTION_BOX)
        & code_in(F.col("subject2"), 16, 2, [RESTRICTION_KIND])
    )
    parents = items.where(alive(F.col("item_deleted")) & (F.col("text4") == RESTRICTION_KIND))
    return kept.join(
        parents.select(F.col("item_key").alias("__parent")), F.col("it_parent_key") == F.col("__parent")
    ).drop("__parent")


def restriction_documents(items: DataFrame) -> DataFrame:
    """Restriction documents that are the newest of *all* items with their number."""
    newest = lookups.latest_by(_restriction_items(items), ["subject2"], "item_created", pool=items)
    return newest.select(
        F.col("subject2").alias("documentnummer"),
        _moment("item_created").alias("registratiedatum"),
        F.col("item_key").alias("source_id"),
    )


def restriction_files(items: DataFrame) -> DataFrame:
    coded = _restriction_items(items).select(
        text.file_code(F.col("subject2")).alias("dossier"), F.substring("subject2", 1, 21).alias("document")
    )
    return lists.ordered_rows(coded, ["dossier"], "document", out="heeft_wkpb_brondocument", position="positie", copies="aantal")


__all__ = [
    "bolts",
    "boroughs",
    "city_blocks",
    "constructions",
    "districts",
    "document_files",
    "measurements",
    "neighbourhoods",
    "reference_points",
    "restriction_documents",
    "restriction_files",
    "restrictions",
    "source_documents",
]
