"""LM scoring with a Brown class-based bigram model, learned and applied over whole corpora."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StructField, StructType

from stateweave.llm.block_dictionary import SLOT, WORD, assemble, blocks, by_rank, by_slot, cut_words, join_words, pack, slots_of, unpack
from stateweave.llm.common import arrow_schema, shared_path, staged
from stateweave.session import discard, written

#: The start: words with at least this share of the training tokens are clustered one by one, 1 / SHARE of them at most,
SHARE = 1 / 5000
#: and the others by their last letters, hashed to so many spellings. Then every word moves by itself.
SPELLINGS = 256
#: Classes, sweeps over the units of the start, and the rise (nats a token, in a sweep over all words) below which the likelihood stands still.
CLASSES, SWEEPS, RISE = 64, 4, 1e-3
#: Words whose counts are laid out at a time.
TOGETHER = 1 << 13
#: The weight of a class's own share in its transitions.
BACKOFF = 8.0
#: The end of a text: unit 0 and the only one of class 0. No word holds white space.
END = b"\n"


def split_words(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


@dataclass
class Units:
    """Which unit a word starts from: the frequent words each, the rest by spelling."""

    frequent: dict[bytes, int]

    @property
    def size(self) -> int:
        return 1 + len(self.frequent) + SPELLINGS

    def of(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known, first = self.frequent.get, 1 + len(self.frequent)
        spelled = xxhash.xxh32_intdigest
        return np.fromiter((known(w) or first + spelled(w[-3:]) % SPELLINGS for w in words), np.int32, len(words))


@dataclass
class Model:
    """What scoring needs besides the words' counts: nothing here grows with the corpus but ``tokens`` and ``types`` as numbers, and ``words`` as a table."""

    units: Units
    classes: np.ndarray  # of each frequent word; of a spelling, where most of its words are, for words never seen
    transition: np.ndarray  # log10, from the row's class to the column's
    room: np.ndarray  # log10 of each class's tokens + types + 1
    tokens: int
    types: int
    ends: int
    words: DataFrame | None = None  # (block, pack): the class of each word seen in training, by block


def count_words(docs: DataFrame, training: str, keep: list[str], text: str = "text") -> DataFrame:
    """Block and slot rows, with the training count of each word beside it and whether it is its first place, in the shared folder."""

    def total(packs: list[bytes]) -> tuple[list[bytes], bytes]:
        counts: dict[bytes, int] = {}
        held = []
        for packed in packs:
            rank, n, lengths, joined = unpack(packed, "<u4", "<i8", "<u4", "")
            words = cut_words(lengths, joined)
            first = np.fromiter((w not in counts for w in words), np.uint8, len(words))
            for w, k in zip(words, n.tolist()):
                counts[w] = counts.get(w, 0) + k
            held.append((rank, words, lengths, joined, first))
        new = [pack(rank, np.fromiter(map(counts.__getitem__, words), np.int64, len(words)), lengths, joined, first) for rank, words, lengths, joined, first in held]
        seen = {w: n for w, n in counts.items() if n}
        return new, pack(np.fromiter(seen.values(), np.int64, len(seen)), *join_words(list(seen)))

    rows = blocks(docs, lambda: split_words, keep, slots_of(docs.sparkSession), text, training)
    return staged(by_slot(rows, lambda: total), "words")


def vocabulary(counted: DataFrame) -> DataFrame:
    """(word, n): every distinct word of the training texts."""

    def run(batches):
        for batch in batches:
            for packed in batch.column("pack").to_pylist():
                n, lengths, joined = unpack(packed, "<i8", "<u4", "")
                yield pa.RecordBatch.from_arrays([pa.array(cut_words(lengths, joined), pa.binary()), pa.array(n)], names=["word", "n"])

    return counted.where(F.col("kind") == SLOT).select("pack").mapInArrow(run, "word binary, n long")


def learn(counted: DataFrame, training: str, share: float = SHARE, classes: int = CLASSES, sweeps: int = SWEEPS) -> Model:
    """Exchange clustering of all words of the training texts.

    A start is found among units, the frequent words each and the others by
    spelling.  Then every word stands for itself: each sweep counts what classes
    stand before and after it in all training texts, and it weighs, against the
    classes as they stand, the gain in likelihood of every class.  Half of the
    words move in a sweep, so that neighbours don't chase each other.  Sweeps go
    on until the likelihood stops rising; the best classes met are kept.  Counts
    and classes of words meet by hash and by block, and no task holds them all;
    a sweep's tables are deleted when the next ones stand.
    """
    words = vocabulary(counted)
    spark = counted.sparkSession
    ends = counted.where(F.col(training)).count()
    total = words.agg(F.sum("n"), F.count("*")).first()
    tokens, types = (total[0] or 0) + ends, total[1] + (ends > 0)
    frequent = words.where(F.col("n") >= F.lit(max(1.0, share * tokens))).orderBy(F.desc("n"), "word").collect()
    units = Units({bytes(r["word"]): i + 1 for i, r in enumerate(frequent)})
    shared = spark.sparkContext.broadcast(units)
    # Tokens and types of each unit, and the bigrams of units.
    sizes = np.zeros((units.size, 2), np.int64)
    for r in words.mapInArrow(lambda bs: _unit_sizes(bs, shared.value), "unit int, tokens long, types long").groupBy("unit").agg(F.sum("tokens"), F.sum("types")).collect():
        sizes[r[0]] = r[1], r[2]
    sizes[0] = ends, int(ends > 0)
    bigrams = shared_path(spark, "bigrams")
    held = written(assemble(counted, lambda: _Blocks(shared.value, training), _BLOCK), bigrams)
    pairs = staged(held.mapInArrow(lambda bs: _unit_pairs(bs, shared.value.size), "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "units")
    of = _first_classes(sizes[:, 0], classes)
    matrix = None
    for sweep in range(sweeps + 1):
        table = spark.createDataFrame(list(enumerate(of.tolist())), "unit int, class int")
        ahead = pairs.join(F.broadcast(table.withColumnsRenamed({"unit": "b", "class": "cb"})), "b")
        both = ahead.join(F.broadcast(table.withColumnsRenamed({"unit": "a", "class": "ca"})), "a")
        matrix = np.zeros((classes, classes))
        for r in both.groupBy("ca", "cb").agg(F.sum("n")).collect():
            matrix[r[0], r[1]] = r[2]
        if sweep < sweeps:
            of = _sweep(both, of, matrix, sweep)
    first = spark.sparkContext.broadcast(of)
    states, path = held.select("block", "words").mapInArrow(lambda bs: _first_states(bs, first.value), "block long, pack binary"), None
    best, seen = None, []
    while True:
        # Half of the words move in the sweep that follows, and only they need their counts.
        half, counts_path = (len(seen) + 1) % 2, shared_path(spark, "counts")
        counts = written(_word_counts(states, held, classes, slots_of(spark), half), counts_path)
        matrix, own = np.zeros((classes, classes)), np.zeros((units.size, classes), np.int64)
        for kind, a, b, n in counts.where(F.col("slot").isin(_BIGRAMS, _TYPES)).groupBy("slot", "a", "b").agg(F.sum("n")).collect():
            (matrix if kind == _BIGRAMS else own)[a, b] = n
        seen.append(_likelihood(matrix))
        last, passed = path, None
        if best is None or seen[-1] > best[0]:
            passed = best[-1] if best else None
            best = seen[-1], matrix, own, states, path
            last = None
        # Either half has had its turn and little came of it.
        done = not tokens or len(seen) > 2 and seen[-1] - seen[-3] < 2 * RISE * tokens
        if not done:
            path = shared_path(spark, "classes")
            stay = counts.where(F.col("slot") == _STAY).select("block", "pack")
            states = written(stay.union(_move_words(counts, matrix)), path)
        for old in (counts_path, last, passed):
            if old:
                discard(spark, old)
        if done:
            break
    _, matrix, own, states, path = best
    if path is None:
        states = staged(states, "classes")
    discard(spark, bigrams)
    # Types of each unit by class: a frequent word is one type, in its class.
    own[0] = 0
    own[0, 0] = int(ends > 0)
    of = np.where(own.any(1), own.argmax(1), of)
    of[0] = 0
    return _model(units, of, matrix, own.sum(0), tokens, types, ends, states)


def _unit_sizes(batches, units: Units):
    for batch in batches:
        own = units.of(batch.column("word").to_pylist())
        n = batch.column("n").to_numpy()
        found = np.flatnonzero(types := np.bincount(own, minlength=units.size))
        tokens = np.zeros(units.size, np.int64)
        np.add.at(tokens, own, n)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(tokens[found]), pa.array(types[found].astype(np.int64))], names=["unit", "tokens", "types"])


_BLOCK = StructType([StructField("block", LongType()), StructField("words", BinaryType()), StructField("pairs", BinaryType())])


class _Blocks:
    """A block's words that training texts hold (rank, key, unit, whether first here), and its bigrams (a, b, n) by rank + 1; 0 is the end."""

    def __init__(self, units: Units, training: str):
        self.units, self.training = units, training

    def words(self, packs: list[bytes]) -> None:
        import xxhash

        self.counts, held = [], []
        for packed in packs:
            rank, n, lengths, joined, first = unpack(packed, "<u4", "<i8", "<u4", "", "<u1")
            words = cut_words(lengths, joined)
            key = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            held.append([x[n > 0] for x in (rank, key, self.units.of(words), first)])
        listed, key, unit, marks = map(np.concatenate, zip(*held)) if held else (np.zeros(0, k) for k in (np.uint32, np.uint64, np.int32, np.uint8))
        rank, at, where = np.unique(listed, return_index=True, return_inverse=True)  # a block that came twice lists its words twice
        first = np.zeros(len(rank), np.uint8)
        np.maximum.at(first, where, marks)
        self.own = pack(rank, key[at], unit[at], first)

    def documents(self, batch: pa.RecordBatch, sequences: list[np.ndarray]):
        self.block = batch.column("block")[0].as_py()
        own = [s for s, m in zip(sequences, batch.column(self.training).to_pylist()) if m]
        if own:
            end = np.zeros(1, np.int64)
            line = np.concatenate([end, *(x for s in own for x in (s.astype(np.int64) + 1, end))])
            self.counts.append(np.unique((line[:-1] << 32) | line[1:], return_counts=True))
        return ()

    def end(self):
        codes, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.counts:
            codes, where = np.unique(np.concatenate([c for c, _ in self.counts]), return_inverse=True)
            n = np.bincount(where, np.concatenate([n for _, n in self.counts]))
        self.counts = []
        pairs = pack((codes >> 32).astype(np.uint32), (codes & 0xFFFFFFFF).astype(np.uint32), n.astype(np.uint32))
        yield pa.RecordBatch.from_arrays([pa.array([self.block], pa.int64()), pa.array([self.own], pa.binary()), pa.array([pairs], pa.binary())], names=_BLOCK.names)


def _by_place(size: int, rank: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values at rank + 1, the end's 0 first."""
    out = np.zeros(size, np.int64)
    out[rank.astype(np.int64) + 1] = values
    return out


def _places(rank: np.ndarray, *sides: np.ndarray) -> int:
    return max([1, *(int(x.max()) + 1 for x in sides if len(x)), *([int(rank.max()) + 2] if len(rank) else [])])


def _unit_pairs(batches, units: int):
    """Bigrams of units from a block's bigrams."""
    for batch in batches:
        for words, pairs in zip(batch.column("words").to_pylist(), batch.column("pairs").to_pylist()):
            rank, _, unit = unpack(words, "<u4", "<u8", "<i4")
            a, b, n = unpack(pairs, "<u4", "<u4", "<u4")
            of = _by_place(_places(rank, a, b), rank, unit)
            codes, where = np.unique(of[a] * units + of[b], return_inverse=True)
            n = np.bincount(where, n, minlength=len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((codes // units).astype(np.int32)), pa.array((codes % units).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])


def _first_states(batches, of: np.ndarray):
    """A block's words with the class of their unit: rank, class."""
    for batch in batches:
        packs = []
        for words in batch.column("words").to_pylist():
            rank, _, unit = unpack(words, "<u4", "<u8", "<i4")
            packs.append(pack(rank, of[unit].astype(np.uint8)))
        yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(packs, pa.binary())], names=["block", "pack"])


#: Rows of the counts: bigrams of classes (a, b), types by unit (a) and class (b), words whose turn it is not; slots from 0 on.
_BIGRAMS, _TYPES, _STAY = -1, -2, -3
_COUNTS = pa.schema([("slot", pa.int32()), ("block", pa.int64()), ("pack", pa.binary()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])


def _count_rows(slot: int, codes: np.ndarray, n: np.ndarray, classes: int) -> pa.RecordBatch:
    size = len(codes)
    numbers = [pa.array((codes // classes).astype(np.int32)), pa.array((codes % classes).astype(np.int32)), pa.array(n.astype(np.int64))]
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, slot, np.int32)), pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary()), *numbers], schema=_COUNTS)


def _pack_row(slot: int, block: int, packed: bytes) -> pa.RecordBatch:
    own = [pa.array([slot], pa.int32()), pa.array([block], pa.int64()), pa.array([packed], pa.binary())]
    return pa.RecordBatch.from_arrays([*own, *(pa.nulls(1, f.type) for f in list(_COUNTS)[3:])], schema=_COUNTS)


def _word_counts(states: DataFrame, held: DataFrame, classes: int, slots: int, half: int) -> DataFrame:
    """What classes stand after and before each word of one half, by block, packed for the slot of the word.

    Beside them the bigrams of classes, the types of units by class, and the
    classes of the other half, which stay.
    """
    rows = states.select("block", F.lit(0).alias("kind"), "pack", F.lit(None).cast("binary").alias("words"))
    rows = rows.union(held.select("block", F.lit(1), "pairs", "words"))

    def run(batches):
        block, packs = None, []
        for batch in batches:
            for b, kind, packed, words in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "pack", "words"))):
                if b != block:
                    block, packs = b, []
                if kind:
                    yield from _count_block(block, packs, words, packed, classes, slots, half)
                else:
                    packs.append(packed)

    return rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(run, "slot int, block long, pack binary, a int, b int, n long")


def _turn(key: np.ndarray) -> np.ndarray:
    """In which of two halves a word moves."""
    return ((key >> np.uint64(40)) % np.uint64(2)).astype(np.int64)


def _count_block(block: int, packs: list[bytes], words: bytes, pairs: bytes, classes: int, slots: int, half: int):
    rank, key, unit, first = unpack(words, "<u4", "<u8", "<i4", "<u1")
    parts = [unpack(p, "<u4", "<u1") for p in packs] or [[np.zeros(0, np.uint32), np.zeros(0, np.uint8)]]
    known, own = map(np.concatenate, zip(*parts))
    a, b, n = (x.astype(np.int64) for x in unpack(pairs, "<u4", "<u4", "<u4"))
    size, width = _places(rank, a, b), 2 * classes + 1
    of = _by_place(size, known, own)
    matrix = np.bincount(of[a] * classes + of[b], n, minlength=classes**2).astype(np.int64)
    at = np.flatnonzero(matrix)
    yield _count_rows(_BIGRAMS, at, matrix[at], classes)
    own = of[rank.astype(np.int64) + 1].astype(np.uint8)
    yield _count_rows(_TYPES, *np.unique(unit[first > 0].astype(np.int64) * classes + own[first > 0], return_counts=True), classes)
    turn = _turn(key) == half
    yield _pack_row(_STAY, block, pack(rank[~turn], own[~turn]))
    rank, key, own = rank[turn], key[turn], own[turn]
    moving = np.zeros(size, bool)
    moving[rank.astype(np.int64) + 1] = True
    # Entries (place of the word, code, n) in the order of places; bigrams come in the order of ``a``.
    by_b = np.argsort(b, kind="stable")
    by_b = by_b[moving[b[by_b]]]
    before = b[by_b], classes + of[a[by_b]], n[by_b]
    ahead, twice = moving[a], (a == b) & moving[a]
    after = a[ahead], of[b[ahead]], n[ahead]
    self = a[twice], np.full(int(twice.sum()), 2 * classes), n[twice]
    place, code, number = [], [], []
    for low in range(0, size, TOGETHER):
        some = [[x[slice(*np.searchsorted(side[0], (low, low + TOGETHER)))] for x in side] for side in (after, before, self)]
        w, c, k = (np.concatenate(x) for x in zip(*some))
        dense = np.bincount((w - low) * width + c, k)
        found = np.flatnonzero(dense)
        place.append(low + found // width)
        code.append((found % width).astype(np.uint16))
        number.append(dense[found].astype(np.uint32))
    place, code, number = map(np.concatenate, (place, code, number))
    many = np.bincount(place, minlength=size)
    start = np.cumsum(many) - many
    slot = (key % np.uint64(slots)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    for p in np.split(order, np.flatnonzero(np.diff(slot[order])) + 1) if len(order) else []:
        at = rank[p].astype(np.int64) + 1
        k = many[at]
        e = np.repeat(start[at] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        yield _pack_row(int(slot[p[0]]), block, pack(rank[p], key[p], own[p], k.astype(np.uint16), code[e], number[e]))


def _move_words(counts: DataFrame, matrix: np.ndarray) -> DataFrame:
    """New classes of the words that were counted, back to their blocks."""
    shared = counts.sparkSession.sparkContext.broadcast(matrix)

    def run(batches):
        slot, held = None, []
        for batch in batches:
            for s, b, p in zip(*(batch.column(c).to_pylist() for c in ("slot", "block", "pack"))):
                if s != slot and held:
                    yield _move_slot(held, shared.value)
                    held = []
                slot = s
                held.append((b, p))
        if held:
            yield _move_slot(held, shared.value)

    rows = counts.where("slot >= 0").select("slot", "block", "pack")
    return rows.repartition("slot").sortWithinPartitions("slot", "block").mapInArrow(run, "block long, pack binary")


def _move_slot(held: list[tuple[int, bytes]], matrix: np.ndarray) -> pa.RecordBatch:
    classes, width = len(matrix), 2 * len(matrix) + 1
    parts = [unpack(p, "<u4", "<u8", "<u1", "<u2", "<u2", "<u4") for _, p in held]
    key, own, many, code, n = (np.concatenate([x[i] for x in parts]) for i in range(1, 6))
    keys, first, where = np.unique(key, return_index=True, return_inverse=True)
    new = own[first].astype(np.int64)
    word = np.repeat(where, many)
    order = np.argsort(word, kind="stable")
    word, code, n = word[order], code[order].astype(np.int64), n[order]
    for low in range(0, len(keys), TOGETHER):
        high = min(len(keys), low + TOGETHER)
        i, j = np.searchsorted(word, (low, high))
        sides = np.bincount((word[i:j] - low) * width + code[i:j], n[i:j], minlength=(high - low) * width).reshape(-1, width)
        new[low:high] = _best_classes(matrix, new[low:high], sides[:, :classes], sides[:, classes:-1], sides[:, -1])
    of, at, packs = new[where].astype(np.uint8), 0, []
    for p in parts:
        packs.append(pack(p[0], of[at : at + len(p[0])]))
        at += len(p[0])
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in held], pa.int64()), pa.array(packs, pa.binary())], names=["block", "pack"])


def _units_by_rank(units: Units, packs: list[bytes]) -> np.ndarray:
    """The unit of each word of a block."""
    ranks, own = [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)]
    for packed in packs:
        rank, _, lengths, joined = unpack(packed, "<u4", "<i8", "<u4", "")
        ranks.append(rank)
        own.append(units.of(cut_words(lengths, joined)))
    return by_rank(np.concatenate(ranks), np.concatenate(own))


def _first_classes(tokens: np.ndarray, classes: int) -> np.ndarray:
    """The end alone; the most frequent units a class each, the others in turn."""
    of = np.zeros(len(tokens), np.int64)
    order = 1 + np.argsort(-tokens[1:], kind="stable")
    of[order] = 1 + np.arange(len(order)) % (classes - 1)
    return of


def _sweep(both: DataFrame, of: np.ndarray, matrix: np.ndarray, sweep: int) -> np.ndarray:
    # What stands after and before each unit, by class: at most two entries a class, whatever the corpus.
    after = both.groupBy(F.col("a").alias("unit"), F.lit(0).alias("side"), F.col("cb").alias("class")).agg(F.sum("n").alias("n"))
    before = both.groupBy(F.col("b").alias("unit"), F.lit(1).alias("side"), F.col("ca").alias("class")).agg(F.sum("n").alias("n"))
    self = both.where("a = b").select(F.col("a").alias("unit"), F.lit(2).alias("side"), F.lit(0).alias("class"), "n")
    seen = after.union(before).union(self).where("unit > 0").groupBy("unit").agg(F.collect_list(F.struct("side", "class", "n")).alias("seen"))
    shared = both.sparkSession.sparkContext.broadcast((of, matrix))

    def run(batches):
        of, matrix = shared.value
        for batch in batches:
            units, best = batch.column("unit").to_pylist(), []
            for unit, seen in zip(units, batch.column("seen").to_pylist()):
                sides = np.zeros((3, len(matrix)))
                for x in seen:
                    sides[x["side"], x["class"]] = x["n"]
                best.append(_best_class(matrix, int(of[unit]), sides[0], sides[1], sides[2, 0]))
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.int32()), pa.array(best, pa.int32())], names=["unit", "class"])

    new = of.copy()
    for r in seen.where((F.pmod(F.hash("unit"), F.lit(2)) == sweep % 2)).mapInArrow(run, "unit int, class int").collect():
        new[r[0]] = r[1]
    return new


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _best_class(matrix: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, self: float) -> int:
    """The class with the greatest likelihood of the class bigrams, were the unit in it; its own on a tie."""
    n, after, before = matrix.copy(), after.copy(), before.copy()
    n[own, :] -= after
    n[:, own] -= before
    n[own, own] += self
    after[own] -= self
    before[own] -= self
    # What precedes and follows the unit counts with the other classes again, wherever it goes.
    rows, columns = n.sum(1) + before, n.sum(0) + after
    gain = (_xlogx(n + after[None, :]) - _xlogx(n)).sum(1) + (_xlogx(n + before[:, None]) - _xlogx(n)).sum(0)
    at = np.diag(n)
    gain += _xlogx(at + after + before + self) + _xlogx(at) - _xlogx(at + after) - _xlogx(at + before)
    gain -= _xlogx(rows + after.sum() + self) - _xlogx(rows) + _xlogx(columns + before.sum() + self) - _xlogx(columns)
    gain[0] = -np.inf
    best = int(gain.argmax())
    return best if gain[best] > gain[own] + 1e-9 else own


def _best_classes(matrix: np.ndarray, own: np.ndarray, after: np.ndarray, before: np.ndarray, self: np.ndarray) -> np.ndarray:
    """``_best_class`` of many words; of a word only the classes that stand beside it are looked at."""
    if not len(own):
        return own
    words, every = np.arange(len(own)), np.arange(len(matrix))
    after, before = after.copy(), before.copy()
    after[words, own] -= self
    before[words, own] -= self
    gain = np.zeros(after.shape)
    for side, other, n in ((after, before, matrix.T), (before, after, matrix)):
        w, c = np.nonzero(side)
        if not len(w):
            continue
        k = side[w, c]
        left = n[c]  # of the class beside the word with every class, the word itself taken out
        left[np.arange(len(w)), own[w]] -= k
        same = c == own[w]
        left[same] -= other[w[same]]
        left[same, c[same]] -= self[w[same]]
        starts = np.flatnonzero(np.diff(w, prepend=-1))
        gain[w[starts]] += np.add.reduceat(_xlogx(left + k[:, None]) - _xlogx(left), starts)
    is_own = own[:, None] == every[None, :]
    at = np.diag(matrix)[None, :] - is_own * (after + before + self[:, None])
    gain += _xlogx(at + after + before + self[:, None]) + _xlogx(at) - _xlogx(at + after) - _xlogx(at + before)
    for side, total in ((after, matrix.sum(1)), (before, matrix.sum(0))):
        n = (side.sum(1) + self)[:, None]
        rest = total[None, :] - is_own * n
        gain -= _xlogx(rest + n) - _xlogx(rest)
    gain[:, 0] = -np.inf
    best = gain.argmax(1)
    return np.where(gain[words, best] > gain[words, own] + 1e-9, best, own)


def _likelihood(matrix: np.ndarray) -> float:
    """What the classes' bigrams add to the log likelihood of the training texts, in nats."""
    return float(_xlogx(matrix).sum() - _xlogx(matrix.sum(0)).sum() - _xlogx(matrix.sum(1)).sum())


def _model(units, of, matrix, v, tokens, types, ends, words) -> Model:
    n, classes = matrix.sum(0), len(matrix)  # each token follows one
    share = (n + 1) / (n.sum() + classes)
    transition = (matrix + BACKOFF * share[None, :]) / (matrix.sum(1, keepdims=True) + BACKOFF)
    return Model(units, of, np.log10(transition), np.log10(n + v + 1), tokens, types, ends, words)


def score(counted: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` and n_tokens, n_known, train_tokens, base_score, score, perplexity of every text.

    A token's probability is that of its class after the one before, times
    (c + 1) / (tokens + types + 1) within the class: the class's one spare part
    is for words never seen, so the model sums to one over what its classes hold
    and an unknown word per class.  The end of the text is a token.
    """
    held = [c for c in keep]
    names = [("n_tokens", LongType()), ("n_known", LongType()), ("train_tokens", LongType()), ("base_score", DoubleType()), ("score", DoubleType()), ("perplexity", DoubleType())]
    schema = StructType([*(f for f in counted.schema.fields if f.name in held), *(StructField(n, k) for n, k in names)])
    arrow = arrow_schema(schema)
    shared = counted.sparkSession.sparkContext.broadcast(replace(model, words=None))
    # The classes go to their block as words without spelling do, and counts below 0 tell them.
    own = model.words.mapInArrow(_class_packs, "block long, pack binary").select(F.lit(WORD).alias("kind"), F.lit(-1).alias("slot"), "block", "pack")
    return assemble(counted.unionByName(own, allowMissingColumns=True), lambda: _Scores(shared.value, arrow), schema)


def _class_packs(batches):
    for batch in batches:
        packs = []
        for packed in batch.column("pack").to_pylist():
            rank, own = unpack(packed, "<u4", "<u1")
            packs.append(pack(rank, -1 - own.astype(np.int64), *join_words([])))
        yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(packs, pa.binary())], names=["block", "pack"])


class _Scores:
    def __init__(self, model: Model, arrow: pa.Schema):
        self.model, self.arrow = model, arrow

    def words(self, packs: list[bytes]) -> None:
        parts = [unpack(p, "<u4", "<i8", "<u4", "")[:2] for p in packs] or [(np.zeros(0, np.uint32), np.zeros(0, np.int64))]
        classed = [len(n) > 0 and n[0] < 0 for _, n in parts]
        named = [p for p, c in zip(packs, classed) if not c]
        self.count = by_rank(*map(np.concatenate, zip(*(p for p, c in zip(parts, classed) if not c))))
        self.log = np.log10(self.count + 1.0)
        self.of = self.model.classes[_units_by_rank(self.model.units, named)].astype(np.int32)
        for rank, n in (p for p, c in zip(parts, classed) if c):
            self.of[rank] = -1 - n

    def documents(self, batch: pa.RecordBatch, sequences: list[np.ndarray]):
        m, rows = self.model, []
        end = math.log10(m.ends + 1.0)
        for s in sequences:
            of = np.concatenate(([0], self.of[s], [0]))
            n = len(s) + 1
            seen = float(self.log[s].sum()) + end
            base = seen - n * math.log10(m.tokens + m.types + 1.0)
            own = seen + float(m.transition[of[:-1], of[1:]].sum()) - float(m.room[of[1:]].sum())
            rows.append((n, int((self.count[s] > 0).sum()) + (m.ends > 0), m.tokens, base, own, 10 ** min(300.0, -own / n)))
        kept = [batch.column(c) for c in self.arrow.names[:-6]]
        made = [pa.array(x, self.arrow.field(len(kept) + i).type) for i, x in enumerate(zip(*rows))]
        yield pa.RecordBatch.from_arrays([*kept, *made], schema=self.arrow)

    def end(self):
        return ()


def held_out(doc_id: str, parts: int, part: int):
    """Whether crc32 of an id's text leaves ``part`` modulo ``parts``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False)).cast(BooleanType())


def score_texts(docs: DataFrame, keep: list[str], training: str, text: str = "text", **options) -> DataFrame:
    """Learn from the rows whose column ``training`` is true, then score every row.

    A null text is empty and has its end only; repeated rows count and are
    scored each; without training texts every token is unknown; an empty table
    gives an empty result.  Columns other than ``keep`` take no part.
    """
    counted = count_words(docs, training, [*keep, training] if training not in keep else keep, text)
    model = learn(counted, training, **options)
    return score(counted, model, keep)
