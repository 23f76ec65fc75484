import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from stateweave.operators import changes, protect

SCHEMA = "k string, a string, b int"


def actions(diff, *extra):
    return {tuple(r[c] for c in ("k", *extra)): (r["action"], tuple(r["changed"])) for r in diff.collect()}


def test_diff_actions_and_changed_attributes(frame):
    old = frame(SCHEMA, ("same", "x", None), ("other", "x", 1), ("nulled", "x", 2), ("gone", "x", 3))
    new = frame(SCHEMA, ("same", "x", None), ("other", "y", 2), ("nulled", None, 2), ("new", "x", 4))
    diff = changes.snapshot_diff(old, new, ["k"])
    assert actions(diff) == {
        ("same",): ("CONFIRM", ()), ("other",): ("MODIFY", ("a", "b")), ("nulled",): ("MODIFY", ("a",)),
        ("gone",): ("DELETE", ()), ("new",): ("ADD", ()),
    }
    assert not any(r["doubled"] for r in diff.collect())
    only_a = changes.snapshot_diff(old, new, ["k"], compare=["a"])
    assert actions(only_a)[("other",)] == ("MODIFY", ("a",))


def test_empty_load_deletes_and_partial_load_does_not(frame):
    old, empty = frame(SCHEMA, ("p", "x", 1), ("q", "x", 1)), frame(SCHEMA, ("p", "x", 1)).limit(0)
    assert actions(changes.snapshot_diff(old, empty, ["k"])) == {("p",): ("DELETE", ()), ("q",): ("DELETE", ())}
    load = frame(SCHEMA, ("q", "y", 1), ("r", "x", 1))
    assert actions(changes.snapshot_diff(old, load, ["k"], mode="partial")) == {("q",): ("MODIFY", ("a",)), ("r",): ("ADD", ())}
    with pytest.raises(ValueError):
        changes.snapshot_diff(old, load, ["k"], mode="some")


def test_sources_touch_their_own_rows(frame):
    one, two = frame(SCHEMA, ("p", "x", 1), ("q", "x", 1)), frame(SCHEMA, ("p", "z", 9))
    current = changes.stack_sources({"A": one, "B": two})
    load = changes.stack_sources({"A": frame(SCHEMA, ("p", "y", 1))})
    got = actions(changes.snapshot_diff(current, load, ["k"], source="_source"), "_source")
    assert got == {("p", "A"): ("MODIFY", ("a",)), ("q", "A"): ("DELETE", ())}
    gone = changes.snapshot_diff(current, load.limit(0), ["k"], source="_source", loaded_sources=["B"])
    assert actions(gone, "_source") == {("p", "B"): ("DELETE", ())}
    applied = changes.apply_changes(current, gone, ["k"], source="_source")
    assert sorted((r["k"], r["_source"]) for r in applied.collect()) == [("p", "A"), ("q", "A")]


def test_doubled_key_is_marked_and_not_multiplied(frame):
    old = frame(SCHEMA, *[("p", "x", i) for i in range(50)])
    new = frame(SCHEMA, *[("p", "x", i) for i in range(50)])
    (row,) = changes.snapshot_diff(old, new, ["k"]).collect()
    assert row["doubled"] and row["action"] == "CONFIRM"


rows = st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.one_of(st.none(), st.sampled_from("xy")), st.integers(0, 2)))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows, rows)
def test_applying_the_diff_gives_the_load(spark, old, new):
    build = lambda d: spark.createDataFrame([(k, a, b) for k, (a, b) in d.items()], SCHEMA)
    result = changes.apply_changes(build(old), changes.snapshot_diff(build(old), build(new), ["k"]), ["k"])
    assert {r["k"]: (r["a"], r["b"]) for r in result.collect()} == new


def test_protection(frame):
    df = frame("secure_a string, b string, secure_r struct<bronwaarde:string>", ("x", "y", ("z",)), ("x", "y", None))
    first, second = protect.protect(df, "salt").collect()
    assert first["secure_a"] == second["secure_a"] != "x" and first["b"] == "y"
    assert len(first["secure_r"]["bronwaarde"]) == 64 and second["secure_r"] is None
