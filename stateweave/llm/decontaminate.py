"""Benchmark decontamination: one Aho-Corasick automaton over all windows of the test items."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from stateweave.llm.common import append_column, texts

#: ASCII letters and digits and everything beyond ASCII belong to words; all else parts them.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(
    b if b >= 128 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
#: Characters of patterns in one automaton: about 100 bytes each, so 200 MB in a worker.
SHARD_CHARS = 2_000_000
#: Characters of documents that a task holds while the automata are built in turn.
HELD_CHARS = 16_000_000

SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
FOUND = StructType(
    [
        StructField("n_words", LongType()),
        StructField("n_hit", LongType()),
        StructField("items", ArrayType(StringType())),
        StructField("spans", ArrayType(SPAN)),
    ]
)


def words_of(text: str) -> list[str]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).decode("utf-8", "surrogatepass").split(" ")


def _normal(text: str) -> tuple[str, int]:
    """The words between single spaces, with one at either end, and their number."""
    words = [w for w in words_of(text) if w]
    return " " + " ".join(words) + " ", len(words)


def windows(benchmark: DataFrame, size: int, text: str = "text", item: str = "item_id") -> DataFrame:
    """(pattern, items): each distinct window of the items, and the items that hold it.

    An item of fewer words is one window; one without words, or null, has none.
    """

    def rows(values: list[str]) -> list[list[str]]:
        out = []
        for value in values:
            words = _normal(value)[0].split()
            out.append(
                sorted({" " + " ".join(words[i : i + size]) + " " for i in range(max(1, len(words) - size + 1))})
                if words
                else []
            )
        return out

    kept = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    found = append_column(kept, "text", "patterns", ArrayType(StringType()), rows)
    return (
        found.select(F.explode("patterns").alias("pattern"), "item")
        .groupBy("pattern")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def find(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", result: str = "found", shard_chars: int = SHARD_CHARS, held_chars: int = HELD_CHARS) -> DataFrame:
    """Add ``result``: words, words hit, items found and the hit spans as offsets into the original text.

    The benchmark's windows are counted first.  One automaton holds them up to
    ``shard_chars`` characters; a larger benchmark is dealt by hash over several,
    each shipped on its own.  A task gathers rows up to ``held_chars`` characters,
    or one longer text, and runs them through one automaton after another, so each
    is built once for so many and nothing is left out.  A null text has no words;
    rows are judged one by one, so repeated rows, ties and an empty table need
    nothing; an input column named ``result`` is replaced, all others pass through.
    """
    spark = docs.sparkSession
    patterns = windows(benchmark, size)
    shards = patterns.agg(F.sum(F.length("pattern"))).first()[0] or 0
    shards = max(1, -(-shards // shard_chars))
    dealt = [
        spark.sparkContext.broadcast(
            [(r["pattern"], tuple(r["items"])) for r in patterns.where(F.pmod(F.hash("pattern"), F.lit(shards)) == i).collect()]
        )
        for i in range(shards)
    ]
    kept = docs.drop(result)
    schema = StructType([*kept.schema.fields, StructField(result, FOUND)])
    return kept.mapInArrow(lambda batches: _scan(batches, dealt, text, result, held_chars), schema)


def _automata(dealt: list, built: list):
    """Those of all shards in turn; the last one is kept, so an only one is built once."""
    import ahocorasick

    for i, patterns in enumerate(dealt):
        if not built or built[0] != i:
            automaton = ahocorasick.Automaton()
            for pattern, items in patterns.value:
                automaton.add_word(pattern, (pattern.count(" ") - 1, items))
            if len(automaton):
                automaton.make_automaton()
            built[:] = i, automaton
        if len(built[1]):
            yield built[1]


def _scan(batches, dealt: list, text: str, result: str, held_chars: int):
    """Batches with ``result``, judged by as many rows at a time as ``held_chars`` allows."""
    built: list = []
    held, chars = [], 0
    for batch in batches:
        for low, high, size in _pieces(batch.column(text), held_chars):
            if held and chars + size > held_chars:
                yield from _judged(held, dealt, built, text, result)
                held, chars = [], 0
            held.append(batch.slice(low, high - low))
            chars += size
    if held:
        yield from _judged(held, dealt, built, text, result)


def _judged(held: list, dealt: list, built: list, text: str, result: str):
    values = [texts(b, text) for b in held]
    normal = [[_normal(v) for v in own] for own in values]
    hits: list[list] = [[[] for _ in own] for own in values]
    for automaton in _automata(dealt, built):
        for lines, lists in zip(normal, hits):
            for (line, _), own in zip(lines, lists):
                own.extend(automaton.iter(line))
    for batch, own, lines, lists in zip(held, values, normal, hits):
        found = [_result(v, *n, h) for v, n, h in zip(own, lines, lists)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, to_arrow_type(FOUND))], names=[*batch.schema.names, result])


def _pieces(column: pa.Array, limit: int):
    """Runs of rows (from, to, characters), each within ``limit`` or one row."""
    sizes = [n or 0 for n in pc.utf8_length(column).to_pylist()]
    low = total = 0
    for i, n in enumerate(sizes):
        if i > low and total + n > limit:
            yield low, i, total
            low, total = i, 0
        total += n
    if len(sizes) > low:
        yield low, len(sizes), total


def _result(text: str, line: str, n_words: int, hits: list) -> dict:
    if not hits:
        return {"n_words": n_words, "n_hit": 0, "items": [], "spans": []}
    # The k-th space of the line (from 0) ends word k - 1: the match that ends there covers the words before it.
    spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
    last = np.searchsorted(spaces, np.fromiter((end for end, _ in hits), np.int64, len(hits)))
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, last - np.fromiter((k for _, (k, _) in hits), np.int64, len(hits)), 1)
    np.add.at(change, last, -1)
    covered = np.cumsum(change)[:-1] > 0
    starts, ends = np.array([m.span() for m in re.finditer(WORD, text)]).T
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
    spans = [{"start": int(starts[a]), "end": int(ends[b - 1])} for a, b in zip(edges[::2], edges[1::2])]
    items = sorted({item for _, (_, own) in hits for item in own})
    return {"n_words": n_words, "n_hit": int(covered.sum()), "items": items, "spans": spans}
