"""Source divergence audit: term shares of each source against its language and against the other sources.

Counts are whole numbers throughout.  The leading terms of a source come from a
dominance skyband: f grows with the count in the group and falls with the count
in the language, so a term that ``top`` others beat in both, and in UTF-8 order,
is not among the ``top`` first whatever the totals are.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from stateweave.llm.common import staged

#: Counted terms a task holds before it gives them on, and rows it holds before it thins them to a band.
HELD, THINNED = 1 << 19, 1 << 20
#: Sources that are compared in one block, terms at a time, and band rows compared at a time.
SOURCES, TERMS, POINTS = 256, 4096, 512
EXACT = "decimal(38,0)"
_SPACE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, d): occurrences of a term in a group and documents of the group that hold it.

    Null texts and names count as empty.  Terms are runs of A-Z (lower-cased),
    a-z and all beyond ASCII.  Each group also has a row of a null term, n = d = 0,
    so that one without terms is there.
    """
    taken = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(o) for c, o in ((lang, "lang"), (source, "source"), (text, "text"))))
    names = ["lang", "source", "term", "n", "d"]

    def rows(held):
        for (own_lang, own_source), (n, d) in held.items():
            terms = [None, *n]
            arrays = [
                pa.array([own_lang] * len(terms), pa.string()),
                pa.array([own_source] * len(terms), pa.string()),
                pa.array(terms, pa.binary()).cast(pa.string()),
                pa.array([0, *n.values()], pa.int64()),
                pa.array([0, *map(d.__getitem__, n)], pa.int64()),
            ]
            for at in range(0, len(terms), 1 << 16):
                yield pa.RecordBatch.from_arrays([a.slice(at, 1 << 16) for a in arrays], names=names)

    def run(batches):
        held, size = defaultdict(lambda: (Counter(), Counter())), 0
        for batch in batches:
            for own_lang, own_source, own_text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                n, d = held[own_lang, own_source]
                found = Counter(own_text.encode().translate(_SPACE).split())
                size -= len(n)
                n.update(found)
                d.update(found.keys())
                size += len(n)
                if size >= HELD:
                    yield from rows(held)
                    held.clear()
                    size = 0
        yield from rows(held)

    counted = taken.mapInArrow(run, "lang string, source string, term string, n long, d long")
    # Tasks have added up their own; by term, what follows needs no other exchange.
    return counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def smoothed(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exact; 0 where there are no terms."""
    share = F.call_function("div", (count.cast(EXACT) + 2) * F.lit(10**9).cast(EXACT), F.greatest(total.cast(EXACT) + 2 * terms.cast(EXACT), F.lit(1).cast(EXACT)))
    return F.when(terms > 0, share + 1).otherwise(F.lit(0)).cast("long")


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares of at most 10^9 + 1."""
    return F.when(p + q > 0, F.call_function("div", (p - q) * (p - q), p + q)).otherwise(F.lit(0)).cast("long")


def band(count: np.ndarray, total: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Indices of points that fewer than ``k`` others dominate: count no lower, total no higher, rank lower.

    Points are taken in an order in which those that dominate come first, so
    each is compared with the band so far and with its own block only; a point
    with ``k`` dominators has ``k`` of them in the band.
    """
    order = np.lexsort((rank, total, -count))
    kept = np.zeros(0, np.int64)
    for at in range(0, len(order), POINTS):
        some = order[at : at + POINTS]
        above = _beaten(kept, some, total, rank).sum(1)
        some, above = some[above < k], above[above < k]
        above += np.tril(_beaten(some, some, total, rank), -1).sum(1)
        kept = np.concatenate([kept, some[above < k]])
    return kept


def _beaten(by: np.ndarray, points: np.ndarray, total: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return (total[by] <= total[points][:, None]) & (rank[by] < rank[points][:, None])


def _thin(table: pa.Table, k: int) -> pa.Table:
    """The band of each group of a table (lang, source, term, n, lang_n)."""
    terms = table.column("term").combine_chunks().dictionary_encode()
    order = np.empty(len(terms.dictionary), np.int64)
    order[pc.sort_indices(terms.dictionary).to_numpy()] = np.arange(len(order))
    rank = order[terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
    lang, source = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "source"))
    group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy(zero_copy_only=False)
    n, total = table.column("n").to_numpy(), table.column("lang_n").to_numpy()
    by = np.argsort(group, kind="stable")
    parts = np.split(by, np.flatnonzero(np.diff(group[by])) + 1)
    return table.take(np.concatenate([own[band(n[own], total[own], rank[own], k)] for own in parts]))


def skybands(kept: DataFrame, top: int) -> DataFrame:
    """Rows of ``kept`` (lang, source, term, n, lang_n) that can be among the ``top`` of their group.

    Each partition thins its share of every group, the shares of a group are
    merged by term hash, then whole; a group is never in one task before it has
    been thinned twice.
    """
    schema = kept.schema
    columns = kept.columns

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= THINNED:
                thin = _thin(pa.Table.from_batches(held), top).combine_chunks()
                held = thin.to_batches()
                # What is thinned already counts as little: it is a band.
                rows = 0
        if held:
            yield from _thin(pa.Table.from_batches(held), top).to_batches()

    bands = kept.mapInArrow(run, schema).withColumn("part", F.pmod(F.xxhash64("term"), F.lit(16)))
    merged = bands.groupBy("lang", "source", "part").applyInArrow(lambda t: _thin(t.select(columns), top), schema)
    return merged.groupBy("lang", "source").applyInArrow(lambda t: _thin(t.select(columns), top), schema)


def _block_sums(table: pa.Table, width: int) -> pa.Table:
    """Sums of f over the terms of a shard, for the pairs of two blocks of ``width`` sources.

    Rows of a null term give each source's share of a term it lacks.
    """
    lang, i, j = (table.column(c)[0].as_py() for c in ("lang", "i", "j"))
    place, p = table.column("place").to_numpy(), table.column("p").to_numpy()
    blank = table.column("term").is_null().to_numpy()
    places = np.unique(place[blank])
    zero = np.zeros(len(places), np.int64)
    zero[np.searchsorted(places, place[blank])] = p[blank]
    terms = table.column("term").filter(pa.array(~blank)).combine_chunks().dictionary_encode()
    codes = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at, own, present = np.searchsorted(places, place[~blank]), p[~blank], len(terms.dictionary)
    order = np.argsort(codes, kind="stable")
    codes, at, own = codes[order], at[order], own[order]
    left = np.flatnonzero(places // width == i)
    sums = np.zeros((len(places), len(places)), np.int64)
    for low in range(0, present, TERMS):
        a, b = np.searchsorted(codes, [low, low + TERMS])
        shares = np.tile(zero[:, None], min(TERMS, present - low))
        shares[at[a:b], codes[a:b] - low] = own[a:b]
        for x in left:
            other = shares[x + 1 :]
            gap = other - shares[x]
            sums[x, x + 1 :] += (gap * gap // (other + shares[x])).sum(1)
    first, second = (x.ravel() for x in np.meshgrid(np.arange(len(places)), np.arange(len(places)), indexing="ij"))
    take = (first < second) & (places[first] // width == i) & (places[second] // width == j)
    n = int(take.sum())
    arrays = [pa.array([lang] * n, pa.string()), pa.array(places[first[take]]), pa.array(places[second[take]]), pa.array(sums[first[take], second[take]]), pa.array(np.full(n, present))]
    return pa.Table.from_arrays(arrays, names=["lang", "a", "b", "value", "present"])


def source_pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): f summed over the language's terms, for each two sources of a language.

    The result has a row for each pair, and so has the work: sources are dealt
    in blocks and terms in shards, and a shard gives one partial sum for each
    pair of its two blocks.  A term that neither block has counts through the
    shares of terms that are not there.
    """
    width = SOURCES
    shards = max(1, int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2)
    place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    placed = staged(groups.withColumn("place", place).withColumn("blocks", F.expr(f"(count(*) OVER (PARTITION BY lang) - 1) div {width} + 1")), "places")
    none = smoothed(F.lit(0), F.col("total"), F.col("terms"))
    own = smoothed(F.col("n"), F.col("total"), F.col("terms"))
    filled = kept.join(placed, ["lang", "source"]).select("lang", "place", "blocks", F.pmod(F.xxhash64("term"), F.lit(shards)).alias("shard"), "term", own.alias("p"))
    blank = placed.select("lang", "place", "blocks", F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"), F.lit(None).cast("string").alias("term"), none.alias("p"))
    rows = filled.union(blank).withColumn("block", F.expr(f"place div {width}")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    dealt = rows.select("lang", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "shard", "place", "term", "p")
    parts = dealt.groupBy("lang", "i", "j", "shard").applyInArrow(lambda t: _block_sums(t, width), "lang string, a long, b long, value long, present long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("present").alias("present"))
    side = lambda c, name, share: placed.select("lang", F.col("place").alias(c), F.col("source").alias(name), none.alias(share), "terms")
    named = sums.join(side("a", "first", "p"), ["lang", "a"]).join(side("b", "second", "q").drop("terms"), ["lang", "b"])
    value = F.col("value") + (F.col("terms") - F.col("present")) * divergence(F.col("p"), F.col("q"))
    both = F.array(F.struct(F.col("first").alias("source"), F.col("second").alias("item")), F.struct(F.col("second").alias("source"), F.col("first").alias("item")))
    return named.select("lang", F.explode(both).alias("pair"), value.alias("value")).select("lang", "pair.source", "pair.item", "value")


def audit(docs: DataFrame, least: int = 10, top: int = 10, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source's terms are from other sources' and its language's.

    A language keeps the terms that at least ``least`` of its documents hold.  A
    share is ``smoothed``.  Part ``pair`` has every other source of the language
    with ``divergence`` summed over the kept terms, part ``term`` the ``top``
    terms of the group by divergence from the language, among those that it
    holds and that are more frequent there.  Ranks go by value, then by UTF-8.

    Null texts and names count as empty, rows are counted as they come (equal
    ones too), a group without terms has pairs only, an empty table gives none.
    Other columns take no part.
    """
    # A term has a row for each source of the language, at most.
    of_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs, lang, source, text).select(
        "lang", "source", "term", "n", F.sum("n").over(of_term).alias("lang_n"), F.sum("d").over(of_term).alias("lang_d"), (F.min("source").over(of_term) == F.col("source")).alias("once")
    )
    counts = staged(counts.where((F.col("lang_d") >= least) | F.col("term").isNull()).drop("lang_d"), "terms")
    there = F.col("term").isNotNull()
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum((there & F.col("once")).cast("long")).alias("terms"))
    langs = groups.groupBy("lang").agg(F.sum("terms").alias("terms"), F.sum("total").alias("lang_total"))
    groups = staged(groups.drop("terms").join(langs, "lang"), "groups")
    kept = counts.where(there).drop("once")
    pairs = source_pairs(kept, groups.select("lang", "source", "total", "terms")).withColumn("part", F.lit("pair"))
    bands = skybands(kept, top).join(groups, ["lang", "source"])
    p, q = smoothed(F.col("n"), F.col("total"), F.col("terms")), smoothed(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    more = bands.where(F.col("n") > 0).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    terms = more.select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"), F.lit("term").alias("part"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
    ranked = [x.withColumn("rank", F.row_number().over(order)) for x in (pairs, terms)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
