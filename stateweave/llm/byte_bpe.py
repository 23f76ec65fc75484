"""Byte-level BPE: each distinct word of the corpus is encoded once, and its ids go back to where it stands."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from stateweave.llm.block_dictionary import DOCUMENT, WORD, assemble, blocks, by_rank, by_slot, cut_words, pack, slots_of, unpack
from stateweave.llm.common import arrow_schema

#: Encoded words a task remembers before it starts anew.
REMEMBERED = 1 << 18


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, read by the driver: as many as the vocabulary has, whatever the corpus."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: list[str], text: str = "text", result: str = "ids") -> DataFrame:
    """The columns ``keep`` and the token ids of every whole text, special tokens read as plain text.

    Texts are cut by ``pattern`` and become positions of words in block lists;
    the distinct words of all blocks meet by hash and each is encoded once;
    their ids join the blocks and the positions are put together in order.  A
    null or empty text has no ids; repeated rows stay rows; an empty table
    gives one.  A column in ``keep`` called ``result`` is replaced.
    """
    keep = [c for c in keep if c != result]
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def split():
        import regex

        return regex.compile(pattern).findall

    # Words and positions are cut in a run each: positions then are shuffled once, to their words.
    slots = slots_of(docs.sparkSession)
    rows, positions = (blocks(docs, split, keep, slots, text, kinds=(kind,)) for kind in (WORD, DOCUMENT))
    kept = [f for f in rows.schema.fields if f.name in keep]
    schema = StructType([*kept, StructField(result, ArrayType(IntegerType()))])
    arrow = arrow_schema(schema)
    return assemble(by_slot(rows, lambda: _Words(shared.value)).union(positions), lambda: _Ids(arrow), schema)


class _Words:
    """Turns the words of a slot into ids, each one once."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        # A word is one piece here: it was cut before.
        self.encoding = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[bytes, list[int]] = {}

    def __call__(self, packs: list[bytes]) -> tuple[list[bytes], None]:
        out = []
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, encode_word = self.known, self.encoding.encode_ordinary
        for packed in packs:
            rank, _, lengths, joined = unpack(packed, "<u4", "<i8", "<u4", "")
            ids = []
            for word in cut_words(lengths, joined):
                own = known.get(word)
                if own is None:
                    own = known[word] = encode_word(word.decode("utf-8", "surrogatepass"))
                ids.append(own)
            sizes = np.fromiter(map(len, ids), np.uint32, len(ids))
            out.append(pack(rank, sizes, np.fromiter((i for own in ids for i in own), np.uint32, int(sizes.sum()))))
        return out, None


class _Ids:
    """Reads the ids of a block's documents."""

    def __init__(self, arrow: pa.Schema):
        self.arrow = arrow

    def words(self, packs: list[bytes]) -> None:
        parts = [unpack(p, "<u4", "<u4", "<u4") for p in packs] or [[np.zeros(0, np.uint32)] * 3]
        rank, sizes, self.flat = (np.concatenate(x) for x in zip(*parts))
        self.size = by_rank(rank, sizes.astype(np.int64))
        self.start = by_rank(rank, np.cumsum(sizes, dtype=np.int64) - sizes)

    def documents(self, batch: pa.RecordBatch, sequences: list[np.ndarray]):
        at = np.concatenate(sequences)
        size = self.size[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[at] - (ends - size), size) + np.arange(total)].astype(np.int32)
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        offsets = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(lengths)))]
        made = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)).cast(self.arrow[-1].type)
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in self.arrow.names[:-1]), made], schema=self.arrow)

    def end(self):
        return ()


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", result: str = "decoded") -> DataFrame:
    """Add ``result``: the bytes of the tokens, joined by id from the broadcast table of token bytes and put in order.

    Null ids give null, an empty list gives no bytes, and an id outside the
    table is an error.  An input column called ``result`` is replaced.
    """
    base = encoded.drop(result)
    schema = StructType([*base.schema.fields, StructField(result, BinaryType())])
    arrow = arrow_schema(schema)
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        held = [b""] * (max(shared.value.values(), default=-1) + 1)
        for token, rank in shared.value.items():
            held[rank] = token
        table = pa.array(held, pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                lists = piece.column(ids)
                tokens = table.take(lists.flatten())
                joined = pa.chunked_array([tokens]).combine_chunks() if tokens.offset else tokens
                # The bytes of consecutive tokens lie side by side: a text is one stretch of them.
                ends = np.frombuffer(joined.buffers()[1], np.int32)[: len(joined) + 1] if len(joined) else np.zeros(1, np.int32)
                data = joined.buffers()[2]
                data = memoryview(data) if data is not None else memoryview(b"")
                counts = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
                cuts = ends[np.concatenate(([0], np.cumsum(counts)))]
                made = [bytes(data[a:b]) if x.is_valid else None for a, b, x in zip(cuts[:-1], cuts[1:], lists)]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(made, pa.binary())], schema=arrow)

    return base.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, the ids and the bytes decoded from them."""
    ranks = load_ranks(path)
    return decode(encode(docs, ranks, pattern, keep, text), ranks).select(*keep, F.col("ids"), F.col("decoded"))
