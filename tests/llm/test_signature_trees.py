"""The Jaccard join against all pairs: dense groups, chains, odd rows and other thresholds."""

import random

import pytest

from stateweave.llm import signature_trees as s


def plain(docs, size, above, below):
    sets = {}
    for i, text in docs:
        w = (text or "").encode().lower().split()
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    flat = [(i, x) for i, own in sets.items() if i is not None for x in own if x]
    parent = {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(flat):
        for j, b in flat[:k]:
            if len(a) * below >= len(b) * above and len(b) * below >= len(a) * above and below * len(a & b) >= above * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(x), None if i is None else root(i)) for i, own in sets.items() for x in own), key=str)


@pytest.mark.parametrize("size, above", [(3, 90), (5, 80)])
def test_equals_all_pairs(spark, size, above):
    rng = random.Random(size)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for group, length, edits in [(25, 60, 4), (25, 8, 2), (330, 90, 4), (10, 400, 20), (20, 1, 1)]:
        base = rng.choices(words, k=length)
        for _ in range(group):
            own = base[:]
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(length)] = rng.choice(words)
            docs.append((len(docs), " ".join(own)))
    docs += [(None, docs[3][1]), (None, None), (900, None), (901, ""), (902, docs[3][1].upper()), (7, docs[40][1]), (7, docs[40][1]), (903, "z " * 20000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, node int").repartition(5)
    got = sorted((tuple(r) for r in s.link_documents(df, size, above, 100).collect()), key=str)
    assert got == plain(docs, size, above, 100)


def test_linked_sets_share_an_own_key():
    """The promise the blocks rest on, at sizes where classes meet."""
    rng = random.Random(9)
    import numpy as np

    for above in (70, 80, 90):
        sizes = s.Sizes(above, 100)
        for n in [*range(2, 60), 123, 400]:
            a = {rng.getrandbits(63) for _ in range(n)}
            for _ in range(6):
                b = set(rng.sample(sorted(a), n - rng.randint(0, n * (100 - above) // 100)))
                b |= {rng.getrandbits(63) for _ in range(rng.randint(0, max(1, n // 10)))}
                if a == b or 100 * len(a & b) < above * len(a | b):
                    continue
                (ka, oa), (kb, ob) = (sizes.keys(np.array(sorted(x), np.uint64)) for x in (a, b))
                own = {k: o for k, o in zip(ka.tolist(), oa.tolist())}
                assert any(k in own and (o or own[k]) for k, o in zip(kb.tolist(), ob.tolist()))


def test_empty(spark):
    assert s.link_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_copies_and_small_buckets_send_each_row_once(spark, monkeypatch):
    members = spark.createDataFrame([(5, i, 1 + i % 2, 10, i % 2 == 1) for i in range(9)], "bucket long, node long, component long, n long, outside boolean")
    assert sorted(r.node for r in s._dealt(members, ["component"]).collect()) == list(range(9))

    links = []
    monkeypatch.setattr(s, "components", lambda df, found=s.components: links.append(df.count()) or found(df))
    docs = [(i, "the same five words here") for i in range(40)] + [(99, "the same five words here"), (99, "another text of five words"), (98, "another text of five words")]
    got = {r.doc_id: r.component_id for r in s.link_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {**{i: 0 for i in range(40)}, 98: 0, 99: 0}
    assert links == [0, 0, 1]


def test_bucket_join_is_a_plan_of_one_step(spark):
    """Read several times, the steps before it stood in the plan again and again."""
    import numpy as np

    shingles = np.arange(10, dtype=np.uint64)
    rows = [(i, 0, 2, 10, bytearray(shingles.tobytes()), bytearray(s._bitmap(shingles, s._width(10)).tobytes())) for i in range(4)]
    whole = spark.createDataFrame(rows, "node long, block long, parts int, n long, shingles binary, bits binary")
    buckets = spark.createDataFrame([(5, i) for i in range(4)], "bucket long, node long")
    parted = spark.createDataFrame([(0, 0), (1, 0)], "node long, component long")
    found = s._join_buckets(whole, buckets, parted, 90, 100)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 8
    assert len(found.collect()) == 2


def test_rows_of_one_doc_id_in_buckets_of_several_parts(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(s, "PART", 5)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for length in (40, 30):
        base = rng.choices(words, k=length)
        for k in range(40):
            own = base[:]
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(length)] = rng.choice(words)
            docs.append((k % 25 + (0 if length == 40 else 20), " ".join(own)))
    got = sorted((tuple(r) for r in s.link_documents(spark.createDataFrame(docs, "doc_id long, text string"), 3, 80, 100).collect()), key=str)
    assert got == plain(docs, 3, 80, 100)
