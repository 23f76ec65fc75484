import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from stateweave.operators import changes, quality
from stateweave.plans import definition, extracts, registers, runner
from stateweave.plans.definition import AMBIGUOUS, NOT_FOUND, Definition, DefinitionError

BASE = {
    "version": "0.1",
    "catalogue": "area",
    "entity": "zone",
    "min_rows": 2,
    "source": {
        "name": "SRC", "application": "App", "entity_id": "id",
        "query": ["SELECT *", "FROM t"], "recent": ["WHERE d > 1"],
    },
    "not_provided_attributes": ["later"],
    "attr_mapping": {"naam": {"source_mapping": "naam"}},
}


def test_definition_parts():
    d = Definition.from_dict(BASE)
    assert d.sql() == "SELECT *\nFROM t" and d.sql(recent=True).endswith("WHERE d > 1")
    assert d.table == "area.zone" and d.min_rows == 2 and d.not_provided == ("later",)
    with pytest.raises(DefinitionError):
        Definition.from_dict({k: v for k, v in BASE.items() if k != "catalogue"})
    with pytest.raises(DefinitionError):
        Definition.from_dict({k: v for k, v in BASE.items() if k != "attr_mapping"})
    # A missing query file is an error, not an empty query.
    with pytest.raises(DefinitionError):
        Definition.from_dict(BASE | {"source": BASE["source"] | {"query": "none.sql"}}, "/tmp")


def test_finding_definitions(spark, tmp_path):
    def put(name, entity, application, default=False):
        d = BASE | {"entity": entity, "default": default, "source": BASE["source"] | {"application": application, "query": "q.sql"}}
        (tmp_path / name).write_text(json.dumps(d))

    (tmp_path / "q.sql").write_text("SELECT 1")
    put("a.json", "one", "App")
    put("b.json", "two", "App")
    put("c.json", "two", "Other")
    put("d.json", "three", "App")
    put("e.json", "three", "Other", default=True)
    get = lambda *names: definition.get_definition(spark, str(tmp_path), "area", *names)
    assert get("one").application == "App" and get("one").sql() == "SELECT 1"
    assert get("two", "Other").application == "Other" and get("three").application == "Other"
    for names, message in [(("two",), AMBIGUOUS), (("none",), NOT_FOUND), (("one", "Nope"), NOT_FOUND)]:
        with pytest.raises(DefinitionError, match=message):
            get(*names)
    assert quality.duplicate_definitions(definition.read_definitions(spark, str(tmp_path))).count() == 0


ZONE = Definition.from_dict(
    {
        "catalogue": "area",
        "entity": "zone",
        "min_rows": 3,
        "source": {
            "name": "SRC",
            "application": "Files",
            "entity_id": "code",
            "merge": {"dataset": "x", "id": "x", "on": "code", "copy": ["identificatie"]},
            "enrich": {
                "identificatie": {"type": "autoid", "on": "code", "template": "03XXX"},
                "geometrie": {"type": "geounion", "on": "buurten.bronwaarde", "from": "area:part.code", "geometrie": "geo"},
            },
        },
        "not_provided_attributes": ["registratiedatum"],
        "mapping": {
            "identificatie": {"source_mapping": "identificatie"},
            "code": {"source_mapping": "code"},
            "aantal": {"source_mapping": "aantal"},
            "begin": {"source_mapping": "begin", "format": "%Y-%m-%d"},
            "buurten": {"source_mapping": {"bronwaarde": "leden", "format": {"split": ";"}}},
        },
    }
)
TYPES = {"aantal": "integer", "begin": "date", "registratiedatum": "datetime"}
ROWS = "identificatie string, code string, aantal string, begin string, leden string"


def test_run_definition_end_to_end(frame):
    extract = frame(
        ROWS, (None, "B", "2", "2001-02-03", "n1;n2"), (None, "A", "1", "2001-02-03", "n1"), (None, "C", "x", "2001-02-30", ""),
    )
    other = frame("code string, identificatie string", ("B", "03007"))
    box = lambda x: f"POLYGON (({x} 0, {x + 1} 0, {x + 1} 1, {x} 0))"
    parts = frame("code string, volgnummer int, geo string", ("n1", 1, box(1)), ("n1", 2, box(2)), ("n2", 1, box(5)))
    load = runner.run(ZONE, extract, TYPES, merge_with=other, members={"area:part": parts})
    rows = {r["code"]: r for r in load.entity.collect()}
    assert set(rows) == {"A", "B"} and rows["B"]["identificatie"] == "03007" and rows["A"]["identificatie"] == "03008"
    assert rows["A"]["aantal"] == 1 and str(rows["A"]["begin"]) == "2001-02-03" and rows["A"]["registratiedatum"] is None
    # The latest state of a member counts.
    assert rows["B"]["geometrie"] == "MULTIPOLYGON (((2 0, 3 0, 3 1, 2 0)), ((5 0, 6 0, 6 1, 5 0)))"
    assert rows["A"]["geometrie"] == "MULTIPOLYGON (((2 0, 3 0, 3 1, 2 0)))"
    bad = sorted((r["_id"], r["attribute"], r["value"]) for r in load.quarantine.collect())
    assert bad == [("C", "aantal", "x"), ("C", "begin", "2001-02-30")]
    guard = load.guard.first()
    assert guard["dataset"] == "area.zone" and guard["rows"] == 3 and guard["ok"]

    again = frame(ROWS, (None, "B", "2", "2001-02-03", "n1;n2"), (None, "D", "4", "2001-02-03", None))
    refused = runner.run(ZONE, again, TYPES, registry=load.entity, members={"area:part": parts}, current=load.entity)
    assert not refused.guard.first()["ok"] and refused.changes.count() == 0
    second = runner.run(replace(ZONE, min_rows=2), again, TYPES, registry=load.entity, members={"area:part": parts}, current=load.entity)
    got = {r["_id"]: (r["action"], r["changed"]) for r in second.changes.collect()}
    assert got == {"A": ("DELETE", []), "B": ("CONFIRM", []), "D": ("ADD", [])}
    assert {r["code"]: r["identificatie"] for r in second.entity.collect()} == {"B": "03007", "D": "03009"}
    snapshot = changes.apply_changes(load.entity, second.changes, ["_id"], source="_source")
    assert sorted(r["code"] for r in snapshot.collect()) == ["B", "D"]


def test_write_entity(frame, spark, tmp_path):
    path = runner.write_entity(frame("a int", (1,)), str(tmp_path), ZONE)
    assert path.endswith("area.zone") and spark.read.parquet(path).count() == 1


def test_scan_dispatch(spark, frame, tmp_path):
    d = Definition.from_dict(BASE)
    assert runner.scan(spark, d, views={"t": frame("d int", (1,), (2,))}, recent=True).count() == 1
    (tmp_path / "x.jpg").write_text("x")
    files_def = Definition.from_dict(BASE | {"source": BASE["source"] | {"read_config": {"file_filter": r".+\.jpg$"}}})
    assert runner.scan(spark, files_def, path=str(tmp_path)).first()["name"] == "x.jpg"
    with pytest.raises(ValueError):
        runner.scan(spark, d)


def test_reference_points_by_number_and_kind(frame):
    points = frame(
        "id int, nummer string, omschrijving string, sta_id int, mer_id int, typ_nummer int, orde int, vervaldatum timestamp,"
        " xmuur double, ymuur double, windr string, geom string",
        *[(i, n, "x", 1, 1, kind, 1, None, 0.0, 0.0, "N", "POINT (0 0)") for i, n, kind in
          [(1, "p", 6), (2, "q", 9), (3, "r", 8), (4, "s", 7), (5, "t", 6), (6, "p", 7)]],
    )
    links = frame("met_id int, hoo_id int", (10, 1), (11, 2), (12, 4))
    measured = frame("hoo_id int, hoogte double, inwindatum timestamp", (1, 1.5, None))
    none = lambda schema: frame(schema, tuple([None] * len(schema.split(",")))).limit(0)
    out = registers.reference_points(
        points, none("hoo_id int, bou_nummer string"), none("id int, omschrijving string"), none("id int, omschrijving string"), measured, links
    )
    # p twice: the number is in use, whichever point carries it.
    assert sorted((r["identificatie"], r["source_id"]) for r in out.collect()) == [("p", 1), ("p", 6), ("q", 2), ("r", 3)]
    assert {r["is_peilmerk"] for r in out.where(F.col("source_id") == 1).collect()} == {"p"}


def test_known_duplicate_document_is_left_out(frame):
    items = frame(
        "item_key int, it_parent_key int, item_deleted timestamp, item_created timestamp, subject1 string, subject2 string, text4 string",
        (1, None, None, None, None, None, None),
        (2, 1, None, None, "\\IMPDOCSA\\", "SE06894773_OV00ML.pdf", None),
        (3, 1, None, None, "\\IMPDOCSE\\", "SE06894773_OV00ML.pdf", None),
        (4, 1, None, None, "\\IMPDOCBD\\", "BD06894773_OV00ML.pdf", None),
    )
    (row,) = registers.source_documents(items).collect()
    assert row["source_id"] == 3 and row["typedossier_omschrijving"] == "Omgevingsvergunning"
    assert row["typebrondocument_omschrijving"] == "Statusmelding" and row["bronleverancier_omschrijving"] == "Stadsdeel West"


def test_extract_from_mapping(frame):
    d = Definition.from_dict(
        {
            "catalogue": "a",
            "entity": "b",
            "source": {"name": "n", "application": "x", "entity_id": "id"},
            "not_provided_attributes": ["leeg"],
            "mapping": {
                "id": {"source_mapping": "id"},
                "datum": {"source_mapping": "datum_aanwijzing", "format": "%Y-%m-%d"},
                "ref": {"source_mapping": {"bronwaarde": "ligt_in.bronwaarde", "format": {"split": ";"}}},
                "vast": {"source_mapping": "=x"},
                "leeg": {"source_mapping": "nergens"},
            },
        }
    )
    assert extracts.needed_columns(d) == ["id", "datum_aanwijzing", "ligt_in"]
    table = frame("ID int, `datumAanwijzing` string, `ligtIn` string, rest string", (1, "2001-01-01", '{"bronwaarde": "q"}', "z"))
    out = extracts.draw_up(d, table, json=["ligt_in"]).apply(table)
    assert out.columns == ["id", "datum_aanwijzing", "ligt_in"] and out.first()["datum_aanwijzing"] == "2001-01-01"
    with pytest.raises(DefinitionError, match="ligt_in"):
        extracts.draw_up(d, table.drop("ligtIn"))


def test_states_have_their_own_union_and_missing_columns_may_be_null(frame):
    d = Definition.from_dict(
        {
            "catalogue": "area",
            "entity": "zone",
            "source": {
                "name": "S",
                "application": "F",
                "entity_id": "code",
                "enrich": {"geo": {"type": "geounion", "on": "leden.bronwaarde", "from": "area:part.code", "geometrie": "g"}},
            },
            "mapping": {
                "volgnummer": {"source_mapping": "nr"},
                "leden": {"source_mapping": {"bronwaarde": "leden", "format": {"split": ";"}}},
                "tot": {"source_mapping": "vervallen", "format": "%Y-%m-%d"},
            },
        }
    )
    extract = frame("code string, nr int, leden string", ("A", 1, "n1"), ("A", 2, "n2"))
    parts = frame("code string, g string", ("n1", "POLYGON ((0 0, 1 0, 1 1, 0 0))"), ("n2", "POLYGON ((5 0, 6 0, 6 1, 5 0))"))
    with pytest.raises(KeyError, match="vervallen"):
        runner.run(d, extract, members={"area:part": parts}, stage=False)
    load = runner.run(d, extract, members={"area:part": parts}, stage=False, lenient=True)
    rows = {r["volgnummer"]: r for r in load.entity.collect()}
    assert rows[1]["geo"] == "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))" and rows[2]["geo"] == "MULTIPOLYGON (((5 0, 6 0, 6 1, 5 0)))"
    assert rows[1]["tot"] is None


def _simple(**mapping):
    return Definition.from_dict(
        {"catalogue": "a", "entity": "b", "min_rows": 1, "source": {"name": "S", "application": "F", "entity_id": "k"}, "mapping": mapping}
    )


def test_quarantined_rows_are_no_deletes(frame):
    d = _simple(k={"source_mapping": "k"}, n={"source_mapping": "n"}, dag={"source_mapping": "dag", "format": "%Y-%m-%d"})
    first = runner.run(d, frame("k string, n string, dag string", *[(k, "1", "2001-01-01") for k in "abcde"]), {"n": "integer"})
    extract = frame(
        "k string, n string, dag string",
        ("a", "x", "2001-01-01"), ("b", "1", "notadate"), ("c", "1", "2001-01-01"), ("c", "2", "2001-01-01"), ("d", "2", "2001-01-01"),
    )
    second = runner.run(d, extract, {"n": "integer"}, current=first.entity)
    assert {r["_id"]: r["action"] for r in second.changes.collect()} == {"d": "MODIFY", "e": "DELETE"}
    bad = sorted((r["_id"], r["attribute"], r["value"]) for r in second.quarantine.collect())
    assert bad == [("a", "n", "x"), ("b", "dag", "notadate"), ("c", "_key", "c"), ("c", "_key", "c")]
    empty = runner.run(d, extract.limit(0), {"n": "integer"}, current=first.entity)
    assert not empty.guard.first()["ok"] and empty.changes.count() == 0


def test_protected_attributes_of_a_run(frame):
    d = _simple(k={"source_mapping": "k"}, geheim={"source_mapping": "g"}, ref={"source_mapping": {"bronwaarde": "r"}}, moment={"source_mapping": "m"})
    types = {"geheim": "secure_string", "moment": "secure_datetime", "ref": "secure_string"}
    extract = frame("k string, g string, r string, m string", ("1", "x", "y", "2001-01-01"), ("2", "x", None, "bad1"))
    with pytest.raises(ValueError, match="salt"):
        runner.run(d, extract, types)
    load = runner.run(d, extract, types, salt="s")
    (row,) = load.entity.collect()
    assert len(row["geheim"]) == len(row["ref"]["bronwaarde"]) == len(row["moment"]) == 64
    (bad,) = load.quarantine.collect()
    assert (bad["_id"], bad["attribute"], bad["value"]) == ("2", "moment", "xxxn")


def test_refused_states_and_doubled_keys(frame):
    d = _simple(k={"source_mapping": "k"}, volgnummer={"source_mapping": "nr"}, n={"source_mapping": "n"})
    types = {"n": "integer", "volgnummer": "integer"}
    rows = frame("k string, nr string, n string", *[("a", str(i), "1") for i in (1, 2, 3)], *[("b", str(i), "1") for i in (1, 2)], ("c", "1", "1"))
    first = runner.run(d, rows, types)
    # a/2 is bad and a/3 gone; b/1 comes twice, once bad; c has a state of unknown number and c/1 is gone.
    load = frame("k string, nr string, n string", ("a", "1", "1"), ("a", "2", "x"), ("b", "1", "1"), ("b", "1", "y"), ("b", "2", "1"), ("c", "z", "1"), ("c", "q", "1"))
    second = runner.run(d, load, types, current=first.entity)
    actions = {(r["_id"], r["volgnummer"]): r["action"] for r in second.changes.collect()}
    assert actions == {("a", 1): "CONFIRM", ("a", 3): "DELETE", ("b", 2): "CONFIRM"}
    bad = sorted((r["_id"], r["volgnummer"] or 0, r["attribute"], r["value"]) for r in second.quarantine.collect())
    assert bad == [("a", 2, "n", "x"), ("b", 1, "_key", "b/1"), ("b", 1, "_key", "b/1"), ("b", 1, "n", "y"), ("c", 0, "volgnummer", "q"), ("c", 0, "volgnummer", "z")]
    assert sorted((r["_id"], r["volgnummer"]) for r in second.entity.collect()) == [("a", 1), ("b", 2)]


def test_nested_values_are_checked_and_read(frame):
    d = _simple(
        k={"source_mapping": "k"},
        ref={"source_mapping": {"bronwaarde": "r", "begin_geldigheid": "rb"}},
        refs={"source_mapping": {"bronwaarde": "m", "begin_geldigheid": "mb", "format": {"split": ";", "begin_geldigheid": "%d-%m-%Y"}}},
        deel={"source_mapping": {"dag": "d", "x": "k"}, "format": {"dag": "%Y%m%d"}},
        los={"source_mapping": "u", "filters": [["upper"]], "format": "JN"},
    )
    rows = frame(
        "k string, r string, rb string, m string, mb string, d string, u string",
        ("1", "x", "2001-01-01", "a;b", "01-02-2003;", "20010203", "j"),
        ("2", "x", "nodate", "a;b;c", ";31-02-2003;x", "2001", "k"),
        ("3", None, None, None, None, None, None),
    )
    load = runner.run(d, rows)
    bad = sorted((r["_id"], r["attribute"], r["value"]) for r in load.quarantine.collect())
    assert bad == [
        ("2", "deel.dag", "2001"), ("2", "los", "K"), ("2", "ref.begin_geldigheid", "nodate"),
        ("2", "refs[1].begin_geldigheid", "31-02-2003"), ("2", "refs[2].begin_geldigheid", "x"),
    ]
    got = {r["_id"]: r for r in load.entity.collect()}
    assert sorted(got) == ["1", "3"] and got["1"]["los"] is True and str(got["1"]["deel"]["dag"]) == "2001-02-03"
    assert [(e["bronwaarde"], e["begin_geldigheid"]) for e in got["1"]["refs"]] == [("a", "2003-02-01"), ("b", None)]
