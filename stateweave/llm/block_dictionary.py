"""Work done once per distinct word of a corpus, and given back to every position that holds it.

A task cuts its documents into blocks.  A block lists its distinct words, and
each document becomes the positions' numbers into that list.  The words are
dealt by hash to slots, so that all blocks' copies of a word meet in one place;
what is found for them goes back to the block, where the positions read it.
So one row stands for many words, a word costs a row entry per block and not
per occurrence (a very frequent one is no hot key), and nothing is gathered
beyond one block or one slot.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from stateweave.llm.common import arrow_schema

#: A block ends with the piece of a batch in which it reaches so many distinct words or positions.
WORDS, POSITIONS, PIECE = 1 << 18, 1 << 22, 500
#: Kinds of rows: words of a block, a document of it, and what a slot says of itself.
WORD, DOCUMENT, SLOT = 0, 1, 2


def pack(*parts: np.ndarray | bytes) -> bytes:
    """Arrays, byte planes apart, and byte strings as one compressed string."""
    raw = []
    for part in parts:
        if isinstance(part, np.ndarray):
            part = part.view(np.uint8).reshape(len(part), part.itemsize).T.tobytes() if len(part) else b""
        raw += [struct.pack("<q", len(part)), part]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def unpack(packed: bytes, *types: str) -> list:
    """The parts again; ``types`` are numpy types, or an empty string for bytes."""
    raw, at, out = zstandard.ZstdDecompressor().decompress(packed), 0, []
    for kind in types:
        (n,) = struct.unpack_from("<q", raw, at)
        part = raw[at + 8 : at + 8 + n]
        at += 8 + n
        if kind:
            size = np.dtype(kind).itemsize
            part = np.frombuffer(part, np.uint8).reshape(size, n // size).T.copy().view(kind).ravel()
        out.append(part)
    return out


def join_words(words: list[bytes]) -> tuple[np.ndarray, bytes]:
    return np.fromiter(map(len, words), np.uint32, len(words)), b"".join(words)


def cut_words(lengths: np.ndarray, joined: bytes) -> list[bytes]:
    ends = np.cumsum(lengths, dtype=np.int64).tolist()
    return [joined[a:b] for a, b in zip([0, *ends], ends)]


def by_rank(rank: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values in the order of the block's list; words that came twice agree."""
    out = np.zeros(int(rank.max()) + 1 if len(rank) else 0, values.dtype)
    out[rank] = values
    return out


def slots_of(spark) -> int:
    """Four for each shuffle partition: a slot's words are a quarter of a partition's."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(docs: DataFrame, split: Callable[[], Callable[[str], list]], keep: list[str], slots: int, text: str = "text", counted: str | None = None, kinds: tuple[int, ...] = (WORD, DOCUMENT)) -> DataFrame:
    """Rows of words and of documents, or of one of these ``kinds``.

    ``split`` makes, once a task, the function from a text to its words (str or
    bytes).  Document rows carry the columns ``keep``.  Words carry the number
    of their occurrences in documents whose column ``counted`` is true, or in
    all.  A block's number comes from its list of words.  So blocks with equal
    lists are one, words and documents may come from two runs over a scan or a
    written table, and if such runs ever differ, a document misses its words
    and the job fails.
    """
    kept = docs.select(F.col(text).alias("__text"), *([F.coalesce(F.col(counted), F.lit(False)).alias("__counted")] if counted else []), *keep)
    schema = StructType(
        [StructField("kind", IntegerType()), StructField("slot", IntegerType()), StructField("block", LongType()), StructField("pack", BinaryType()), *(StructField(c, kept.schema[c].dataType) for c in keep)]
    )
    arrow = arrow_schema(schema)

    def run(batches):
        block = _Block(split(), arrow, keep, slots, kinds)
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                block.add(batch.slice(at, PIECE))
                if block.full():
                    yield from block.flush()
        yield from block.flush()

    return kept.mapInArrow(run, schema)


class _Block:
    def __init__(self, split, arrow: pa.Schema, keep: list[str], slots: int, kinds: tuple[int, ...]):
        self.split, self.arrow, self.keep, self.slots, self.kinds = split, arrow, keep, slots, kinds
        self.start()

    def start(self) -> None:
        self.numbers = defaultdict(itertools.count().__next__)
        self.pieces: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []
        self.positions = 0

    def add(self, piece: pa.RecordBatch) -> None:
        number, sequences = self.numbers.__getitem__, []
        for text in piece.column("__text").to_pylist():
            words = self.split(text) if text else []
            sequences.append(np.fromiter(map(number, words), np.uint32, len(words)))
            self.positions += len(words)
        rest = [c for c in piece.schema.names if c != "__text"]
        self.pieces.append((piece.select(rest), sequences))

    def full(self) -> bool:
        return len(self.numbers) >= WORDS or self.positions >= POSITIONS

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.pieces:
            return
        n = len(self.numbers)
        every, counted = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for piece, sequences in self.pieces:
            marks = piece.column("__counted").to_pylist() if "__counted" in piece.schema.names else [True] * len(sequences)
            for mark in (False, True):
                own = [s for s, m in zip(sequences, marks) if m == mark]
                if own and n:
                    found = np.bincount(np.concatenate(own), minlength=n)
                    every += found
                    counted += found * mark
        # Frequent words get small numbers, which pack well.
        rank = np.empty(n, np.uint32)
        rank[np.argsort(-every, kind="stable")] = np.arange(n, dtype=np.uint32)
        words = [w if isinstance(w, bytes) else w.encode("utf-8", "surrogatepass") for w in self.numbers]
        self.number = xxhash.xxh3_64_intdigest(b"\n".join([rank.tobytes(), *words])) >> 1
        if WORD in self.kinds:
            yield from self._words(words, rank, counted)
        for i, (piece, sequences) in enumerate(self.pieces if DOCUMENT in self.kinds else ()):
            packs = [pack(rank[s]) for s in sequences]
            yield self._batch(DOCUMENT, [(i * PIECE + k) % self.slots for k in range(len(packs))], packs, piece)
        self.start()

    def _words(self, words: list[bytes], rank: np.ndarray, counted: np.ndarray) -> Iterator[pa.RecordBatch]:
        slot = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % self.slots
        order = np.argsort(slot, kind="stable")
        rows = []
        for own in np.split(order, np.flatnonzero(np.diff(slot[order])) + 1) if len(order) else []:
            rows.append((int(slot[own[0]]), pack(rank[own], counted[own], *join_words([words[i] for i in own.tolist()]))))
        for at in range(0, len(rows), 200):
            some = rows[at : at + 200]
            yield self._batch(WORD, [s for s, _ in some], [p for _, p in some], None)

    def _batch(self, kind: int, slots: list[int], packs: list[bytes], piece: pa.RecordBatch | None) -> pa.RecordBatch:
        n = len(packs)
        own = [pa.array([kind] * n, pa.int32()), pa.array(slots, pa.int32()), pa.array([self.number] * n, pa.int64()), pa.array(packs, pa.binary())]
        rest = [piece.column(c).cast(self.arrow.field(c).type) if piece is not None else pa.nulls(n, self.arrow.field(c).type) for c in self.keep]
        return pa.RecordBatch.from_arrays([*own, *rest], schema=self.arrow)


def by_slot(rows: DataFrame, make: Callable[[], Callable[[list[bytes]], tuple[list[bytes], bytes | None]]]) -> DataFrame:
    """Replace the packs of words, slot by slot.

    ``make`` gives, once a task, the function from the packs of a slot (one for
    each block) to the new ones, and one that speaks of the slot or None.
    Documents pass by.
    """
    arrow = arrow_schema(rows.schema)
    blank = [pa.nulls(0, f.type) for f in arrow][4:]

    def emit(slot: int, held: list[tuple[int, bytes]], each) -> pa.RecordBatch:
        packs, about = each([p for _, p in held])
        kinds, numbers = [WORD] * len(packs), [b for b, _ in held]
        if about is not None:
            packs, kinds, numbers = [*packs, about], [*kinds, SLOT], [*numbers, -1]
        n = len(packs)
        own = [pa.array(kinds, pa.int32()), pa.array([slot] * n, pa.int32()), pa.array(numbers, pa.int64()), pa.array(packs, pa.binary())]
        return pa.RecordBatch.from_arrays([*own, *(pa.nulls(n, b.type) for b in blank)], schema=arrow)

    def run(batches):
        each, slot, held = make(), -1, []
        for batch in batches:
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            docs = batch.take(pa.array(np.flatnonzero(kinds == DOCUMENT)))
            if docs.num_rows:
                yield docs
            words = batch.select(["slot", "block", "pack"]).take(pa.array(np.flatnonzero(kinds == WORD)))
            for s, b, p in zip(*(words.column(c).to_pylist() for c in ("slot", "block", "pack"))):
                if s != slot and held:
                    yield emit(slot, held, each)
                    held = []
                slot = s
                held.append((b, p))
        if held:
            yield emit(slot, held, each)

    return rows.repartition("slot").sortWithinPartitions("slot", "kind", "block").mapInArrow(run, rows.schema)


def assemble(rows: DataFrame, make: Callable, schema: StructType) -> DataFrame:
    """Bring a block's words back to its documents.

    ``make`` gives, once a task, an object with ``words(packs)`` for the packs
    of a new block, ``documents(batch, sequences)`` for some of its documents
    and ``end()`` after its last one; the two latter give record batches.
    """

    def run(batches):
        reader, block, packs, ready = make(), None, [], False
        for batch in batches:
            numbers = batch.column("block").to_numpy(zero_copy_only=False)
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if numbers[a] != block:
                    if ready:
                        yield from reader.end()
                    block, packs, ready = numbers[a], [], False
                if kinds[a] == WORD:
                    packs += batch.column("pack").slice(a, b - a).to_pylist()
                    continue
                if not ready:
                    reader.words(packs)
                    packs, ready = [], True
                for at in range(a, b, PIECE):
                    piece = batch.slice(at, min(PIECE, b - at))
                    yield from reader.documents(piece, [unpack(p, "<u4")[0] for p in piece.column("pack").to_pylist()])
        if ready:
            yield from reader.end()

    held = rows.where(F.col("kind") != SLOT)
    return held.repartition("block").sortWithinPartitions("block", "kind", "slot").mapInArrow(run, schema)
