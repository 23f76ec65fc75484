import pytest
from pyspark.sql import functions as F

from stateweave.functions import dates, text, values


@pytest.mark.parametrize(
    "value, address, location",
    [
        ("Kade 12", "Kade 12", None),
        ("Kade 12   achterzijde", "Kade 12", "achterzijde"),
        ("Kade 12      achterzijde (laag)", "Kade 12", "achterzijde (laag)"),
        ("Kade (oost)", "Kade ", "(oost)"),
        ("Kade(oost)", "Kade", "oost)"),
        ("(oost)", None, "oost)"),
        ("Kade\nboven", "Kade", "boven"),
        (None, None, None),
        ("Kade(", "Kade", None),
    ],
)
def test_description_splits_at_first_gap_or_bracket(one, value, address, location):
    c = F.col("d")
    assert one(text.address_part(c), d=value) == address
    assert one(text.location_part(c), d=value) == location


@pytest.mark.parametrize(
    "value, code",
    [
        ("WK123_rest", "WK123"),
        ("_starts", "_starts"),
        (" spaced _x", "spaced"),
        ("nothing to split but much longer", "nothing to split but"),
        ("aaaaaaaaaaaaaaaaaaaaaaaa_b", "aaaaaaaaaaaaaaaaaaaaa"),
        ("   ", None),
        (None, None),
    ],
)
def test_file_code(one, value, code):
    assert one(text.file_code(F.col("d")), d=value) == code


@pytest.mark.parametrize(
    "value, prefix", [("SE1_OV", "SE1"), ("SE1 OV_x", "SE1"), ("SE1OV", ""), ("_x", ""), ("", ""), (None, None)]
)
def test_prefix_is_empty_without_a_mark(one, value, prefix):
    assert one(text.prefix_before(F.col("d")), d=value) == prefix


def test_null_is_nothing_in_codes(one):
    a, b = F.col("a"), F.col("b")
    assert one(text.join_codes(a, b), a="S", b=None) == "S"
    assert one(text.join_codes(a, b), a=None, b=None) is None
    assert one(text.strip_ends(a), a="{x}") == "x"
    assert one(text.strip_ends(a), a="x") is None


def test_strptime_patterns():
    assert dates.spark_pattern("%Y-%m-%d %H:%M:%S") == "yyyy-MM-dd HH:mm:ss"
    assert dates.spark_pattern("%d.%m.%Y") == "dd.MM.yyyy"
    assert dates.spark_pattern("%Y-%m-%dT%H") == "yyyy-MM-dd'T'HH"
    with pytest.raises(ValueError):
        dates.spark_pattern("%j")


def test_code_table_and_flags(one):
    c = F.col("c")
    assert one(values.code_label(c, {"A": "eerste"}), c="A") == "eerste"
    assert one(values.code_label(c, {"A": "eerste"}), c="Z") is None
    assert one(values.code_label(c, {"A": "eerste"}), c=None) is None
    assert one(values.yes_no(c == "A"), c=None) == "N"
    assert one(values.to_int(c), c="12x") is None
    assert one(values.json_or_empty(c), c=None) == "{}"
