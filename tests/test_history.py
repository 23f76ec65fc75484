import datetime as dt

from pyspark.sql import functions as F

from stateweave.operators import history, lists, lookups, quality

D = lambda y, m=1, d=1: dt.datetime(y, m, d)


def test_state_number_ties_and_null_last(frame):
    df = frame(
        "k string, b timestamp, i int",
        ("a", D(2001), 1), ("a", D(2003), 2), ("a", D(2003), 3), ("a", None, 4), ("a", D(2003, 6), 5),
        ("b", None, 6), (None, D(2001), 7), (None, D(2000), 8),
    )
    got = {r["i"]: r["volgnummer"] for r in history.state_number(df, ["k"], ["b"]).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 4, 5: 3, 6: 1, 7: 2, 8: 1}


def test_state_number_by_text_and_number(frame):
    df = frame("k int, b string, n int", (1, "2001-05-01", 9), (1, "2001-05-01", 3), (1, "2000-12-31", 5))
    got = {(r["b"], r["n"]): r["volgnummer"] for r in history.state_number(df, ["k"], ["b", "n"]).collect()}
    assert got == {("2000-12-31", 5): 1, ("2001-05-01", 3): 2, ("2001-05-01", 9): 3}
    got = {r["n"]: r["volgnummer"] for r in history.state_number(df, ["k"], ["n"]).collect()}
    assert got == {3: 1, 5: 2, 9: 3}


def test_empty_states_leave_before_numbering(frame):
    df = frame("k int, b timestamp, e timestamp", (1, D(2000), D(2000)), (1, D(2001), D(2002)), (1, D(2002), None))
    kept = history.drop_empty_states(df, "b", "e")
    assert sorted(r["volgnummer"] for r in history.state_number(kept, ["k"], ["b"]).collect()) == [1, 2]


def test_successor_needs_an_adjoining_state(frame):
    df = frame(
        "g string, b timestamp, e timestamp, i timestamp",
        ("g", D(2000), D(2001), D(1999)), ("g", D(2001), D(2002), D(2011)), ("g", D(2003), None, D(2013)),
    )
    out = history.successor_end(df, "g", "b", "e", {"next": "i"})
    assert {r["b"]: r["next"] for r in out.collect()} == {D(2000): D(2011), D(2001): None, D(2003): None}


def test_next_begin_crosses_slices(frame):
    df = frame("k int, b timestamp, e timestamp", (1, D(2000, 1, 5), None), (1, D(2000, 1, 9), None), (1, D(2004, 7, 1), None))
    got = {r["b"]: r["next_begin"] for r in history.with_next_begin(df, ["k"], "b", "e").collect()}
    assert got == {D(2000, 1, 5): D(2000, 1, 9), D(2000, 1, 9): D(2004, 7, 1), D(2004, 7, 1): None}


def test_interval_problems(frame):
    df = frame(
        "k int, b timestamp, e timestamp",
        (1, D(2000), D(2001)), (1, D(2002), D(2004)), (1, D(2003), D(2005)), (1, D(2005), D(2004)),
        (2, D(2000), None), (2, D(2001), None), (3, D(2000), D(2001)), (3, D(2000), D(2001)), (4, D(2000), D(2001)), (4, D(2001), None),
    )
    got = {(r["k"], r["b"].year): r["problem"] for r in quality.interval_problems(df, ["k"], "b", "e").collect()}
    assert got == {
        (1, 2000): "gap", (1, 2002): "overlap", (1, 2003): "overlap", (1, 2005): "reversed",
        (2, 2000): "overlap", (2, 2001): "overlap", (3, 2000): "doubled",
    }


def test_latest_keeps_ties_and_multiplies(frame):
    facts = frame("p int, d timestamp, h int", (1, D(2000), 1), (1, D(2001), 2), (1, D(2001), 3), (2, None, 9))
    assert sorted(r["h"] for r in lookups.latest_by(facts, ["p"], "d").collect()) == [2, 3]
    points = frame("id int", (1,), (2,), (3,))
    out = lookups.asof_latest(points, facts, "id", "p", "d", {"hoogte": "h"})
    out = lookups.asof_latest(out, facts, "id", "p", "d", {"dag": "d"})
    assert sorted((r["id"], r["hoogte"]) for r in out.collect() if r["id"] == 1) == [(1, 2), (1, 2), (1, 3), (1, 3)]
    assert out.where("id > 1").count() == 2
    assert lookups.asof_latest(points, facts, "id", "p", "d", {"hoogte": "h"}, dedupe=True).count() == 3


def test_latest_of_an_unfiltered_pool(frame):
    items = frame("nr string, d timestamp, soort string", ("a", D(2000), "goed"), ("a", D(2001), "fout"), ("b", D(2000), "goed"))
    good = items.where(F.col("soort") == "goed")
    assert [r["nr"] for r in lookups.latest_by(good, ["nr"], "d", pool=items).collect()] == ["b"]


def test_current_rows(frame):
    df = frame(
        "i int, b timestamp, e timestamp, x timestamp",
        (1, D(2000), D(2010), None), (2, D(2010), None, None), (3, D(2000), None, D(2005)), (4, D(2000), None, D(2015)),
    )
    assert [r["i"] for r in history.current_at(df, "2010-01-01", "b", "e", "x").collect()] == [2, 4]


def test_merge_fills_nulls_from_the_fullest_row(frame):
    left = frame("code string, id string", ("a", None), ("b", "eigen"), ("c", None), (None, None))
    right = frame("code string, id string, x string", ("a", None, "q"), ("a", "z1", None), ("b", "z2", "w"), (None, "z3", None))
    out = {r["code"]: (r["id"], r["x"]) for r in lookups.merge_dataset(left, right, "code", ["id", "x"]).collect()}
    assert out == {"a": ("z1", None), "b": ("eigen", "w"), "c": (None, None), None: (None, None)}


def test_ordered_lists_as_text_and_as_rows(frame):
    df = frame("k string, v string", *[("a", x) for x in "cabbd"], ("b", None), (None, "x"), ("c", "z"))
    # The same data many times over keeps schema and rows per key.
    for times in (1, 50):
        grown = df.withColumn("__i", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("__i")
        text = {r["k"]: r["listing"] for r in lists.ordered_text(grown, ["k"], "v").collect()}
        assert text == {"a": ";".join(sorted("cabbd" * times)), None: ";".join("x" * times), "c": ";".join("z" * times)}
        rows = sorted((r["k"] or "", r["position"], r["value"], r["copies"]) for r in lists.ordered_rows(grown, ["k"], "v").collect())
        counted = [("", 1, "x", 1), ("a", 1, "a", 1), ("a", 2, "b", 2), ("a", 3, "c", 1), ("a", 4, "d", 1), ("c", 1, "z", 1)]
        assert rows == [(k, p, v, n * times) for k, p, v, n in counted]
