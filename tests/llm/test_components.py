"""Connected components against plain union-find, contracted in tasks of any size."""

import random

import pyarrow as pa
import pytest

from stateweave.llm import components


def plain(pairs):
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("seed", range(20))
def test_a_task_contracts_to_stars(seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randint(1, 60))]
    batch = pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs]) for k in (0, 1)], names=["a", "b"])
    got = dict(zip(*(c.to_pylist() for c in components._stars([batch]).columns)))
    assert got == {x: r for x, r in plain(pairs).items() if x != r}


def test_long_chain_star_and_odd_links(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 400)]
    odd = [(5, None), (None, None), (7, 7), (7, 7), (900, 901), (901, 900)]
    links = chain + star + odd
    random.Random(2).shuffle(links)
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    got = {r.node: r.component for r in components.components(df).collect()}
    assert got == plain([p for p in links if None not in p and p[0] != p[1]])
    assert components.components(df.limit(0)).collect() == []


def test_a_step_is_one_exchange_without_a_join(spark):
    edges = spark.createDataFrame([(2, 1), (3, 1), (3, 2), (9, 4)], "a long, b long")
    for large in (True, False):
        text = components._star(edges, large)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in text and text.count("Exchange") == 1


def recorded(monkeypatch):
    """What every written step holds, in order."""
    steps = []

    def staged(df, label, write=components.staged):
        steps.append((label, (out := write(df, label)).count()))
        return out

    monkeypatch.setattr(components, "staged", staged)
    return steps


def test_a_dense_group_costs_a_row_or_two_a_node_on_any_partitions(spark, monkeypatch):
    """Tasks contracted what they held before anything met: each of many gave a row for every node of the group."""
    steps = recorded(monkeypatch)
    rng = random.Random(3)
    buckets = [sorted(rng.sample(range(400), 250)) for _ in range(60)]
    links = [(bucket[0], node) for bucket in buckets for node in bucket]
    df = spark.createDataFrame(links, "a long, b long").repartition(40, "a", "b")
    assert {r.node: r.component for r in components.components(df).collect()} == plain(links)
    assert max(rows for _, rows in steps) <= 2 * 400


def test_the_search_ends_when_nodes_lead_to_roots(spark, monkeypatch):
    """A round used to be run for nothing before the search ended."""
    steps = recorded(monkeypatch)
    forest = [(root, 10 * root + i) for root in (1, 2, 3) for i in range(5, 9)] * 2
    got = components.components(spark.createDataFrame(forest, "a long, b long").repartition(5)).collect()
    assert sorted((r.node, r.component) for r in got) == sorted(plain(forest).items())
    assert [label for label, _ in steps] == ["links"]


@pytest.mark.parametrize("seed", range(4))
def test_any_links_on_any_partitions(spark, seed):
    rng = random.Random(seed)
    nodes = [rng.getrandbits(63) - (1 << 62) for _ in range(120)]
    links = [(rng.choice(nodes[: 40 + 20 * seed]), rng.choice(nodes)) for _ in range(30 + 40 * seed)] + list(zip(nodes, nodes[1:30]))
    links = [(a, b) for a, b in links if a != b] * 2
    df = spark.createDataFrame(links, "a long, b long").repartition(1 + 6 * seed)
    got = components.components(df).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == plain(links)
