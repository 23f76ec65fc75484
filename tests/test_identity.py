import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from stateweave.operators import identity

T = "77XXX"


def ids(df):
    return {(r["code"], r["n"]): r["id"] for r in df.collect()}


def test_first_load(frame):
    df = frame(
        "n int, code string, id string",
        (1, "s0", "77000"), (2, "s0", "77000"), (3, "nieuw b", None), (4, "nieuw a", ""), (5, "nieuw b", ""),
        (6, "eigen", "ABC"), (7, "eigen", None), (8, "hoog", "77012"), (9, None, None),
    )
    got = ids(identity.autoid(df, "code", "id", T))
    assert got[("s0", 1)] == "77000" and got[("eigen", 6)] == "ABC" and got[("eigen", 7)] == "ABC"
    assert got[("nieuw a", 4)] == "77013" and got[("nieuw b", 3)] == got[("nieuw b", 5)] == "77014"
    assert got[(None, 9)] is None


def test_second_load_reuses_and_counts_on(frame):
    registry = frame("code string, id string", ("a", "77005"), ("b", "77007"), ("weg", "77020"))
    df = frame("n int, code string, id string", (1, "a", None), (2, "c", None), (3, "b", "EIGEN"), (4, "b", None))
    got = ids(identity.autoid(df, "code", "id", T, registry))
    assert got == {("a", 1): "77005", ("c", 2): "77021", ("b", 3): "EIGEN", ("b", 4): "77007"}


def test_used_up_template_is_an_error(frame):
    df = frame("n int, code string, id string", (1, "a", "77999"), (2, "b", None))
    with pytest.raises(Exception, match="used up"):
        identity.autoid(df, "code", "id", T).collect()


def test_template_needs_prefix_and_digits():
    assert identity.template_parts("1234XXXXX") == ("1234", 5)
    for bad in ("1234", "XXX"):
        with pytest.raises(ValueError):
            identity.template_parts(bad)


def test_global_number_over_many_partitions(spark):
    values = spark.range(5000).selectExpr("concat('v', lpad(cast(id * 7 % 5000 as string), 5, '0')) as v")
    rows = identity.global_number(values, "v", "n", partitions=7).collect()
    assert [r["n"] for r in sorted(rows, key=lambda r: r["v"])] == list(range(1, 5001))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.text("abc", min_size=1, max_size=4), min_size=1, max_size=12), st.sets(st.text("abc", min_size=1, max_size=4), max_size=12))
def test_numbers_are_unique_and_stable(frame, first, second):
    build = lambda codes: frame("n int, code string, id string", *[(i, c, None) for i, c in enumerate(sorted(codes))])
    one = identity.autoid(build(first), "code", "id", T)
    before = {r["code"]: r["id"] for r in one.collect()}
    assert len(set(before.values())) == len(first)
    after = {r["code"]: r["id"] for r in identity.autoid(build(first | second), "code", "id", T, one.select("code", "id")).collect()}
    assert {c: after[c] for c in first} == before
    assert len(set(after.values())) == len(first | second)
