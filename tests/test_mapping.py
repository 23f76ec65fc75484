import json

import pytest
from pyspark.sql import functions as F

from stateweave.operators import mapping, projection


def mapped(df, spec, types=None):
    return mapping.map_entity(df, spec, types).first().asDict(recursive=True)


def test_scalars_literals_and_formats(frame):
    df = frame("naam string, dag string, vlag string, cijfer int", ("a", "03-04-2010", "J", 1))
    out = mapped(
        df,
        {
            "naam": {"source_mapping": "naam"},
            "bron": {"source_mapping": "=vast"},
            "dag": {"source_mapping": "dag", "format": "%m-%d-%Y"},
            "vlag": {"source_mapping": "vlag", "format": "JN"},
            "cijfer": {"source_mapping": "cijfer", "format": "10"},
        },
    )
    assert out["naam"] == "a" and out["bron"] == "vast" and str(out["dag"]) == "2010-03-04"
    assert out["vlag"] is True and out["cijfer"] is True


def test_struct_is_null_when_all_parts_are(frame):
    df = frame("c string, o string", (None, None), ("1", None))
    spec = {"soort": {"source_mapping": {"code": "c", "omschrijving": "o"}}}
    rows = [r["soort"] for r in mapping.map_entity(df, spec).collect()]
    assert rows[0] is None and rows[1].code == "1" and rows[1].omschrijving is None


def test_single_reference_with_payload(frame):
    df = frame("r string, e string", ("x", "extra"), ("", "extra"), (None, None))
    spec = {"ref": {"source_mapping": {"bronwaarde": "r", "extra": "e"}}}
    rows = [r["ref"] for r in mapping.map_entity(df, spec).collect()]
    assert rows[0].asDict() == {"bronwaarde": "x", "extra": "extra"}
    assert rows[1] is None and rows[2] is None


def test_many_references(frame):
    df = frame("lijst string, json string, dagen string", ("a; b;", '["p","q"]', "2001;"), ("", "enkel", None))
    spec = {
        "gesplitst": {"source_mapping": {"bronwaarde": "lijst", "format": {"split": ";"}}},
        "los": {"source_mapping": "json"},
        "met_begin": {"source_mapping": {"bronwaarde": "lijst", "begin_geldigheid": "dagen"}},
    }
    first, second = [
        r.asDict(recursive=True)
        for r in mapping.map_entity(df, spec, {"los": "manyreference", "met_begin": "manyreference"}).collect()
    ]
    assert [v["bronwaarde"] for v in first["gesplitst"]] == ["a", "b"]
    assert [v["bronwaarde"] for v in first["los"]] == ["p", "q"]
    assert first["met_begin"] == [
        {"bronwaarde": "a", "begin_geldigheid": "2001"},
        {"bronwaarde": "b", "begin_geldigheid": None},
    ]
    assert second["gesplitst"] == [] and [v["bronwaarde"] for v in second["los"]] == ["enkel"]


def test_dotted_paths(frame):
    df = frame("obj string, lijst string", ('{"a": {"b": 5}}', '[{"nr": "1", "t": "x"}, {"nr": "2"}]'), ("geen json", '{"nr": "3"}'))
    spec = {
        "b": {"source_mapping": "obj.a.b"},
        "refs": {"source_mapping": {"bronwaarde": "lijst.nr"}},
        "delen": {"source_mapping": {"nr": "lijst.nr", "t": "lijst.t"}, "force_list": True},
    }
    first, second = [
        r.asDict(recursive=True) for r in mapping.map_entity(df, spec, {"refs": "manyreference"}).collect()
    ]
    assert first["b"] == "5" and second["b"] is None
    assert [v["bronwaarde"] for v in first["refs"]] == ["1", "2"]
    assert first["delen"] == [{"nr": "1", "t": "x"}, {"nr": "2", "t": None}]
    assert [v["bronwaarde"] for v in second["refs"]] == ["3"]


def test_force_list_of_list_and_single(frame):
    df = frame("doel array<string>, enkel string", (["wonen", "kantoor"], "wonen"), (None, None))
    spec = {
        "lijst": {"source_mapping": {"omschrijving": "doel"}, "force_list": True},
        "een": {"source_mapping": {"omschrijving": "enkel"}, "force_list": True},
        "plat": {"source_mapping": "enkel", "force_list": True},
    }
    first, second = [r.asDict(recursive=True) for r in mapping.map_entity(df, spec).collect()]
    assert first["lijst"] == [{"omschrijving": "wonen"}, {"omschrijving": "kantoor"}]
    assert first["een"] == [{"omschrijving": "wonen"}] and first["plat"] == ["wonen"]
    assert second["lijst"] is None and second["een"] is None and second["plat"] is None


def test_json_object(frame):
    df = frame("s string, a string, b string, n string", ('tekst "q"', "[1, 2]", "true", None))
    spec = {"json": {"source_mapping": {"str": "s", "array": "a", "bool": "b", "null": "n"}}}
    assert json.loads(mapped(df, spec, {"json": "json"})["json"]) == {
        "str": 'tekst "q"', "array": [1, 2], "bool": True, "null": None,
    }


def test_filters(frame):
    df = frame("name string", ("map/sub/ab12.jpg",))
    chain = [["re.sub", "(.+/)([^.]*)(.*)", "\\2"], ["upper"]]
    spec = {
        "id": {"source_mapping": "name", "filters": chain},
        "ref": {"source_mapping": {"bronwaarde": "name"}, "filters": {"bronwaarde": chain}},
    }
    out = mapped(df, spec)
    assert out["id"] == "AB12" and out["ref"] == {"bronwaarde": "AB12"}
    with pytest.raises(ValueError):
        mapping.apply_filters(F.col("name"), [["lower"]])


def test_unknown_column_is_an_error(frame):
    with pytest.raises(KeyError):
        mapping.map_entity(frame("a string", ("x",)), {"b": {"source_mapping": "nope"}})


def test_projection_helpers(frame):
    df = frame("`A b` int, C string", (1, "x"))
    assert projection.rename(df, {"A b": "a_b"}).columns == ["a_b", "C"]
    with pytest.raises(ValueError):
        projection.rename(df, {"zz": "q"})
    assert projection.lowercase_keys(df).columns == ["a b", "c"]
    with pytest.raises(ValueError):
        projection.lowercase_keys(frame("a int, b int", (1, 2)).toDF("x", "X"))
    out = projection.add_not_provided(df, {"leeg": "bigint"})
    assert out.schema["leeg"].dataType.simpleString() == "bigint" and out.first()["leeg"] is None


def test_mapping_does_not_shuffle(frame):
    df = frame("a string, b string", ("1;2", "x"))
    spec = {"refs": {"source_mapping": {"bronwaarde": "a", "format": {"split": ";"}}}, "b": {"source_mapping": "b"}}
    plan = mapping.map_entity(df, spec)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
