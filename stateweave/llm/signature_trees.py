"""N-gram Jaccard join: exact blocks of documents, each joined by trees of signatures."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stateweave.llm.block_dictionary import pack, slots_of, unpack
from stateweave.llm.common import staged
from stateweave.llm.components import components

#: Documents and shingles that one task joins; larger groups are dealt into parts of that size.
PART, SHINGLES = 256, 400_000
#: Children of a tree node.
FAN = 8
#: Documents whose keys are sent together.
TOGETHER = 4096
_DOC, _BUCKET, _KEYS = 0, 1, 2
_RIGHT, _LEFT, _BOTH = 0, 1, 2
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that leaves no pattern."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """The set of a text: hashes of its word n-grams, sorted."""

    def __init__(self, size: int):
        self.size, self.known = size, {}

    def of(self, text: str) -> np.ndarray:
        import xxhash

        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        known, hashed = self.known, xxhash.xxh3_64_intdigest
        if len(known) > 1 << 18:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = hashed(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.size, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = mix(out * _A + h[i : len(h) - n + 1 + i])
        return np.unique(out)


@dataclass(frozen=True)
class Sizes:
    """Classes of set sizes: sets that can link lie in one class or in neighbouring ones.

    Sets of a class and of the one below differ in ``apart`` elements at most if
    they link, so when hashes deal elements to ``parts`` segments, so many more,
    some segments are equal: ``spare`` + 1 at least.  A set with no more empty
    segments than that shares one that is not empty.
    """

    above: int
    below: int

    @functools.lru_cache(maxsize=None)
    def bounds(self, upto: int) -> list[int]:
        lows = [1]
        while lows[-1] <= upto:
            lows.append(max(lows[-1] + 1, (lows[-1] - 1) * self.below // self.above + 1))
        return lows

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.bounds(1 << n.bit_length()), n, side="right")) - 1

    @functools.lru_cache(maxsize=None)
    def segments(self, size_class: int) -> tuple[int, int]:
        """(parts, spare) of a class; no parts where only equal sets link."""
        upto = 16
        while len(self.bounds(upto)) < size_class + 2:
            upto *= 2
        low, high = self.bounds(upto)[size_class : size_class + 2]
        apart = 2 * (high - 1) * (self.below - self.above) // (self.below + self.above)
        if not apart:
            return 0, 0
        empty = (apart + 1) * math.exp(-low / (apart + 1))
        spare = max(1, math.ceil(empty + 4 * math.sqrt(empty)))
        return apart + 1 + spare, spare

    def keys(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A set's keys and whether its own class gives them: linked unequal sets share one that is the own of one of them."""
        out, own = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
        at = self.of(len(shingles))
        spread = mix(shingles + _A)
        for k in (at, at + 1):
            parts, spare = self.segments(k)
            if not parts:
                continue
            segment = (spread >> np.uint64(32)) % np.uint64(parts)
            order = np.argsort(segment, kind="stable")
            there, first = np.unique(segment[order], return_index=True)
            content = np.add.reduceat(spread[order], first)
            if parts - len(there) > spare:
                gone = np.setdiff1d(np.arange(parts, dtype=np.uint64), there)
                there, content = np.concatenate([there, gone]), np.concatenate([content, np.zeros(len(gone), np.uint64)])
            out.append(mix(content + mix(there * _A + np.uint64(k))))
            own.append(np.full(len(there), k == at, np.uint8))
        return np.concatenate(out), np.concatenate(own)


def link_documents(docs: DataFrame, size: int = 3, above: int = 90, below: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Words part at ASCII white space, A-Z lower-cased.  Two documents link when
    ``below`` * |intersection| >= ``above`` * |union| of their sets of word
    n-grams (64-bit hashes); a text of fewer words has its whole sequence, a null
    text or one without words has none and links with nothing.

    Equal sets are one node.  Unequal ones that can link share a key (``Sizes``),
    and a bucket is what one key gathers.  Buckets that hang together make a
    block; blocks are joined part by part with trees (``_join``), each part with
    the block's first document.  Where a bucket still holds several components,
    the members outside its largest one are joined with all of them.  Joins give
    spanning links only, so a group of n copies costs n rows and no link between
    components is lost.  A block of one part is done when that part is.

    Each row gives a row.  Rows that share a doc_id are one node with several
    sets; a null doc_id has no component.  Other columns take no part.
    """
    spark = docs.sparkSession
    sizes = Sizes(above, below)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    slots = slots_of(spark)
    schema = "kind int, slot int, bucket long, doc_id long, n long, digest binary, pack binary"
    keyed = rows.mapInArrow(lambda b: _keys(b, size, sizes, slots), schema)
    found = staged(keyed.repartition("slot").sortWithinPartitions("slot").mapInArrow(_buckets, schema).drop("slot", "pack"), "buckets")
    sets = found.where(F.col("kind") == _DOC).select("doc_id", "n", "digest")
    first = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"))
    copies = staged(sets.join(first, "digest").select("doc_id", "node").distinct(), "copies")
    buckets = staged(
        found.where(F.col("kind") == _BUCKET).select("bucket", "doc_id").distinct().join(copies, "doc_id").select("bucket", "node").distinct(), "members"
    )
    leaders = buckets.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").drop("b")
    blocks = components(buckets.join(leaders, "bucket").select("a", F.col("node").alias("b"))).withColumnsRenamed({"component": "block"})
    # Sizes are known before the sets are made, so these carry their part along.
    members = blocks.join(sets.select(F.col("doc_id").alias("node"), "n"), "node")
    parts = members.groupBy("block").agg(F.count("*").alias("rows"), F.sum("n").alias("all")).select("block", _parts("rows", "all").alias("parts"))
    members = staged(blocks.join(parts, "block"), "blocks")
    # They grow with the corpus: they meet the texts in a shuffle at every size and are never broadcast.
    taken = rows.join(members.hint("merge"), rows["doc_id"] == members["node"]).select("node", "block", "parts", "text")
    whole = staged(taken.mapInArrow(lambda b: _sets(b, size), "node long, block long, parts int, n long, shingles binary, bits binary"), "sets")
    inside = staged(_join_blocks(whole, above, below), "links")
    parted = staged(components(inside), "parted")
    left_over = _join_buckets(whole, buckets.join(leaders.select("bucket"), "bucket"), parted, above, below)
    # The components found stand for the links inside; what is new are the links between them.
    stars = parted.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    # Copies follow their node; a document of several sets is a link between the nodes of these.
    named = copies.groupBy("doc_id").agg(F.min("node").alias("own"))
    together = copies.join(named, "doc_id").where("node <> own").select(F.col("own").alias("a"), F.col("node").alias("b"))
    roots = components(stars.union(left_over).union(together))
    found = named.join(roots, named["own"] == roots["node"], "left").select("doc_id", F.coalesce("component", "own").alias("root"))
    return sets.join(found, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def _batch(kind: int, slot, bucket, doc_id, n, digest, packs) -> pa.RecordBatch:
    columns = (slot, bucket, doc_id, n, digest, packs)
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    rows = next(len(c) for c in columns if c is not None)
    arrays = [pa.nulls(rows, k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays([pa.array([kind] * rows, pa.int32()), *arrays], names=["kind", "slot", "bucket", "doc_id", "n", "digest", "pack"])


def _keys(batches, size: int, sizes: Sizes, slots: int):
    """Each document's size and digest, and the keys of those not seen before in this piece, by slot."""
    import xxhash

    shingles = Shingles(size)
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            piece = batch.slice(at, TOGETHER)
            ids, n, digests, first = piece.column("doc_id").to_pylist(), [], [], {}
            keys, owns, whose = [], [], []
            for i, text in zip(ids, piece.column("text").to_pylist()):
                own = shingles.of(text or "")
                digest = xxhash.xxh3_128_digest(own.tobytes())
                n.append(len(own))
                digests.append(digest)
                if i is not None and len(own) and digest not in first:
                    first[digest] = len(first)
                    k, o = sizes.keys(own)
                    keys.append(k)
                    owns.append(o)
                    whose.append(i)
            # Where they go says nothing of them: any slot will do.
            yield _batch(_DOC, [k % slots for k in range(len(ids))], None, ids, n, digests, None)
            if not keys or not sum(map(len, keys)):
                continue
            doc = np.repeat(np.array(whose, np.int64), [len(k) for k in keys])
            key, own = np.concatenate(keys), np.concatenate(owns)
            slot = (key % np.uint64(slots)).astype(np.int64)
            order = np.lexsort((doc, slot))
            cuts = np.flatnonzero(np.diff(slot[order])) + 1
            parts = np.split(order, cuts)
            packs = [pack(key[p], doc[p], own[p]) for p in parts]
            yield _batch(_KEYS, [int(slot[p[0]]) for p in parts], None, None, None, None, packs)


def _buckets(batches):
    """Rows (bucket, doc_id) for each key that documents share; a bucket's number follows from its members."""
    slot, held = None, []
    for batch in batches:
        kinds = batch.column("kind").to_numpy(zero_copy_only=False)
        docs = np.flatnonzero(kinds == _DOC)
        if len(docs):
            yield batch.take(pa.array(docs))
        for s, p, k in zip(batch.column("slot").to_pylist(), batch.column("pack").to_pylist(), kinds):
            if k != _KEYS:
                continue
            if s != slot and held:
                yield from _gather(held)
                held = []
            slot = s
            held.append(p)
    if held:
        yield from _gather(held)


def _gather(packs: list[bytes]):
    parts = [unpack(p, "<u8", "<i8", "<u1") for p in packs]
    key, doc, own = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((doc, key))
    key, doc, own = key[order], doc[order], own[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    counts = np.diff(np.append(starts, len(key)))
    # A key that one document has, or none of whose documents gives it as its own, links nothing.
    shared = (counts > 1) & (np.maximum.reduceat(own, starts) > 0)
    starts, counts = starts[shared], counts[shared]
    if not len(starts):
        return
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    doc = doc[at]
    edges = np.concatenate(([0], np.cumsum(counts)[:-1]))
    number = mix(np.add.reduceat(mix(doc.astype(np.uint64) + _A), edges) + counts.astype(np.uint64))
    _, one = np.unique(number, return_index=True)
    keep = np.zeros(len(number), bool)
    keep[one] = True
    rows = np.repeat(keep, counts)
    yield _batch(_BUCKET, None, np.repeat(number, counts)[rows].view(np.int64), doc[rows], None, None, None)


def _sets(batches, size: int):
    shingles = Shingles(size)
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            piece = batch.slice(at, 500)
            own = [shingles.of(t or "") for t in piece.column("text").to_pylist()]
            # Only blocks of several parts are compared by these once more.
            bits = [_bitmap(s, _width(len(s))).tobytes() if p > 1 else b"" for s, p in zip(own, piece.column("parts").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [piece.column("node"), piece.column("block"), piece.column("parts"), pa.array([len(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary()), pa.array(bits, pa.binary())],
                names=["node", "block", "parts", "n", "shingles", "bits"],
            )


def _width(n: int) -> int:
    """Bits of a stored bitmap: eight to sixteen for each element, so that few pairs short of a link pass."""
    return max(64, 8 << max(1, n).bit_length())


def _bitmap(shingles: np.ndarray, width: int) -> np.ndarray:
    bits = np.zeros(width, np.uint8)
    bits[(shingles % np.uint64(width)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """A bitmap of fewer bits: those that fall on one are joined."""
    return np.bitwise_or.reduce(bitmap.reshape(-1, words), axis=0)


def _parts(n: str, shingles: str):
    return F.greatest(F.ceil(F.col(n) / PART), F.ceil(F.col(shingles) / SHINGLES)).cast("int")


def _join_blocks(whole: DataFrame, above: int, below: int) -> DataFrame:
    """Spanning links within each part of a block, its first document added to every part."""
    held = whole.drop("n", "bits")
    own = held.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    first = held.where("node = block AND parts > 1").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = own.union(first).select("block", "part", "node", "shingles")
    return both.groupBy("block", "part").applyInArrow(lambda t: _links(t, above, below), "a long, b long")


def _join_buckets(whole: DataFrame, buckets: DataFrame, parted: DataFrame, above: int, below: int) -> DataFrame:
    """Spanning links between the components that a bucket of a block of several parts holds."""
    whole = whole.where("parts > 1")
    # A node of several sets has a row in a bucket all the same.
    buckets = buckets.join(whole.groupBy("node").agg(F.count("*").alias("sets"), F.sum("n").alias("n")), "node")
    # Each step is a table of its own: read several times, a plan of all of them would double with every step.
    named = staged(buckets.join(parted, "node", "left").select("bucket", "node", "sets", "n", F.coalesce("component", "node").alias("component")), "named")
    counts = named.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    open_ = counts.groupBy("bucket").agg(F.max(F.struct("k", "component")).alias("most"), F.count("*").alias("several")).where("several > 1")
    members = named.join(open_, "bucket").withColumn("outside", F.col("component") != F.col("most.component"))
    members = staged(members.select("bucket", "node", "sets", "n", "component", "outside"), "open")
    # By bitmaps alone, which of them can have a partner at all; only their sets are sent.
    drawn = _dealt(members, ["component"], "sets").join(whole.select("node", "n", "bits"), "node")
    able = drawn.groupBy("bucket", "i", "j").applyInArrow(lambda t: _able(t, above, below), "bucket long, node long").distinct()
    rest = staged(members.join(able, ["bucket", "node"]), "able")
    sent = _dealt(rest, ["component"], "sets").join(whole.select("node", "shingles"), "node")
    return sent.groupBy("bucket", "i", "j").applyInArrow(lambda t: _links(t, above, below), "a long, b long")


def _dealt(members: DataFrame, columns: list[str], sets: str | None = None) -> DataFrame:
    """A bucket's members against those outside its largest component, in parts: each pair meets in one.

    Rows are of the right side, the left or both: a bucket of one part has each member once.
    ``sets``: a member's column of how many sets it has, one without.
    """
    rows, outside = F.col(sets) if sets else F.lit(1), lambda n: F.sum(F.when(F.col("outside"), n).otherwise(0))
    parts = members.groupBy("bucket").agg(F.sum(rows).alias("r"), F.sum("n").alias("rn"), outside(rows).alias("l"), outside(F.col("n")).alias("ln"))
    parts = parts.where("l > 0").select("bucket", _parts("r", "rn").alias("i_parts"), _parts("l", "ln").alias("j_parts"))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n, each: F.transform(F.sequence(F.lit(0), F.col(n) - 1), each)
    place = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.alias("side"))
    single = (F.col("i_parts") == 1) & (F.col("j_parts") == 1)
    side = F.when(single & F.col("outside"), _BOTH).otherwise(_RIGHT)
    right = every("j_parts", lambda j: place(part("i_parts"), j, side))
    left = every("i_parts", lambda i: place(i, part("j_parts"), F.lit(_LEFT)))
    places = F.when(F.col("outside") & ~single, F.concat(right, left)).otherwise(right)
    return members.join(parts, "bucket").select("bucket", "node", *columns, F.explode(places).alias("__at")).select("bucket", "__at.i", "__at.j", "node", *columns, "__at.side")


def _able(table: pa.Table, above: int, below: int) -> pa.Table:
    """Members with a partner in another component whose bitmap does not rule the pair out."""
    nodes, groups, side = (table.column(c).to_numpy() for c in ("node", "component", "side"))
    sizes = table.column("n").to_numpy()
    maps = [np.frombuffer(b, np.uint64) for b in table.column("bits").to_pylist()]
    words = min(map(len, maps))
    packed = np.stack([_folded(m, words) for m in maps])
    i, j, _ = _survivors(np.flatnonzero(side != _RIGHT), np.flatnonzero(side != _LEFT), sizes, packed, packed[:, 0], above, below)
    apart = groups[i] != groups[j]
    found = np.unique(nodes[np.concatenate([i[apart], j[apart]])])
    return pa.table({"bucket": pa.array(np.full(len(found), table.column("bucket")[0].as_py()), pa.int64()), "node": pa.array(found, pa.int64())})


def _links(table: pa.Table, above: int, below: int) -> pa.Table:
    nodes = table.column("node").to_pylist()
    sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
    names = table.schema.names
    groups = table.column("component").to_pylist() if "component" in names else nodes
    if "side" in names:
        side = table.column("side").to_numpy()
        links = _join(np.flatnonzero(side != _RIGHT), np.flatnonzero(side != _LEFT), sets, groups, above, below)
    else:
        every = np.arange(len(sets))
        links = _join(every, every, sets, groups, above, below)
    return pa.table({"a": pa.array([nodes[i] for i, _ in links], pa.int64()), "b": pa.array([nodes[j] for _, j in links], pa.int64())})


class _Tree:
    """Levels from the leaves (one set each) up: OR of bitmaps, range of sizes, most elements that share a bit with others."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, bits: np.ndarray, extra: np.ndarray):
        self.rows = rows
        self.levels = [(bits[rows], sizes[rows], sizes[rows], extra[rows])]
        while len(self.levels[-1][1]) > 1:
            b, low, high, e = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(e, at)))


def _join(left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], groups: list, above: int, below: int) -> list[tuple[int, int]]:
    """Spanning links between sets, given the groups that are known to hang together.

    Both sides stand as trees, near sets beside each other.  From the roots
    down, a pair of nodes is dropped when the most that any two sets below can
    share falls short of what the smallest of them need, or their sizes lie too
    far apart; pairs of leaves that stay are compared in full, likeliest first,
    unless links found so far connect them already.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    if not len(left) or not len(right) or not sizes.max():
        return []
    width = 1 << int(np.clip(4 * sizes.max(), 256, 1 << 15)).bit_length()
    packed = np.stack([_bitmap(s, width) for s in sets])
    low = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
    i, j, bound = _survivors(left, right, sizes, packed, low, above, below)
    parent = {g: g for g in groups}

    def root(g):
        while parent[g] != g:
            parent[g] = g = parent[parent[g]]
        return g

    links = []
    for k in np.argsort(-(bound / np.maximum(1, sizes[i] + sizes[j])), kind="stable"):
        a, b = int(i[k]), int(j[k])
        ra, rb = root(groups[a]), root(groups[b])
        if ra != rb and sizes[a] and sizes[b]:
            shared = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if below * shared >= above * (sizes[a] + sizes[b] - shared):
                parent[ra] = rb
                links.append((a, b))
    return links


def _survivors(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, packed: np.ndarray, low: np.ndarray, above: int, below: int):
    """(i, j, most) of the pairs that the trees' dual traversal leaves: at most ``most`` elements are shared."""
    if not len(left) or not len(right):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    extra = sizes - np.bitwise_count(packed).sum(1)
    trees = [_Tree(side[np.lexsort((low[side], sizes[side]))], sizes, packed, extra) for side in (left, right)]
    x = y = np.zeros(1, np.int64)
    deep = [len(t.levels) - 1 for t in trees]
    bound = None
    while True:
        (bx, lx, hx, ex), (by, ly, hy, ey) = (t.levels[d] for t, d in zip(trees, deep))
        most = np.concatenate(
            [np.bitwise_count(bx[x[i : i + 4096]] & by[y[i : i + 4096]]).sum(1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)]
        ) + np.minimum(ex[x], ey[y])
        most = np.minimum(most, np.minimum(hx[x], hy[y]))
        # below * shared >= above * (a + b - shared)
        keep = (below + above) * most >= above * (lx[x] + ly[y])
        keep &= (below * hx[x] >= above * ly[y]) & (below * hy[y] >= above * lx[x])
        x, y, bound = x[keep], y[keep], most[keep]
        if deep == [0, 0] or not len(x):
            break
        grow = [d > 0 for d in deep]
        deep = [max(0, d - 1) for d in deep]
        sides = []
        for at, g, t, d in zip((x, y), grow, trees, deep):
            n = len(t.levels[d][1])
            sides.append([np.minimum(at * FAN + k, n) for k in range(FAN)] if g else [at])
        limits = [len(t.levels[d][1]) if g else None for t, d, g in zip(trees, deep, grow)]
        xs = np.concatenate([a for a in sides[0] for _ in sides[1]])
        ys = np.concatenate([b for _ in sides[0] for b in sides[1]])
        fits = np.ones(len(xs), bool)
        for at, n in zip((xs, ys), limits):
            if n is not None:
                fits &= at < n
        x, y = xs[fits], ys[fits]
    return trees[0].rows[x], trees[1].rows[y], bound
