"""Substring deduplication: suffix automata over the passages that recur give each document's repeated spans."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from stateweave.llm.block_dictionary import pack, slots_of, unpack
from stateweave.llm.common import arrow_schema, staged
from stateweave.llm.signature_trees import mix

#: Documents, or passages, whose rows are sent together.
TOGETHER, PASSAGES = 4096, 20_000
#: Words of one reference shard: its automaton has twice as many states at most.
SHARD_WORDS = 200_000
_A = np.uint64(0x9E3779B97F4A7C15)


class SuffixAutomaton:
    """All substrings of some word sequences, and how often each occurs."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, following: dict, count: int = 0) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.count.append(count)
        return len(self.length) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def add(self, words: list[bytes], times: int) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)
            self.count[last] += times

    def close(self) -> None:
        """Let each state count what its extensions count."""
        for state in np.argsort(-np.array(self.length), kind="stable").tolist():
            if state:
                self.count[self.link[state]] += self.count[state]

    def occurrences(self, words: list[bytes], size: int) -> list[int]:
        """How often each window of ``size`` words occurs, by matching statistics in one pass."""
        out, state, n = [], 0, 0
        following, link, length = self.next, self.link, self.length
        for i, word in enumerate(words):
            while state and word not in following[state]:
                state = link[state]
                n = length[state]
            if word in following[state]:
                state, n = following[state][word], n + 1
            if n >= size:
                # The state of the last ``size`` words: what was longer is no longer needed.
                while length[link[state]] >= size:
                    state = link[state]
                n = min(n, length[state])
            if i >= size - 1:
                out.append(self.count[state] if n >= size else 0)
        return out


class Anchors:
    """Word windows and the half-windows that stand for them: the least hash of those inside, the last on a tie.

    Equal windows have equal anchors at equal places, so windows need to be
    compared only where their anchors are equal.
    """

    def __init__(self, size: int):
        self.size, self.part, self.known = size, (size + 1) // 2, {}

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor hash, first window, last window) for each run of windows with one anchor."""
        import xxhash

        n = len(words) - self.size + 1
        if n < 1:
            return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        known = self.known
        if len(known) > 1 << 18:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        gram = mix(self._grams(np.fromiter(map(known.__getitem__, words), np.uint64, len(words))))
        # Least of each ``size - part + 1`` neighbours, by doubling.
        least, place, wide = gram, np.arange(len(gram)), 1
        span = self.size - self.part + 1
        while wide < span:
            step = min(wide, span - wide)
            right = least[step:] <= least[:-step]
            least, place = np.where(right, least[step:], least[:-step]), np.where(right, place[step:], place[:-step])
            wide += step
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.append(first[1:], n) - 1
        return gram[place[first]], first.astype(np.int32), last.astype(np.int32)

    def _grams(self, h: np.ndarray) -> np.ndarray:
        """A hash of each ``part`` words in a row, by doubling."""
        power, wide, out, done, factor = h, 1, None, 0, _A
        rest = self.part
        while rest:
            if rest & 1:
                if out is None:
                    out = power
                else:
                    m = min(len(out), len(power) - done)
                    out = out[:m] * factor + power[done : done + m]
                done += wide
            rest >>= 1
            if rest:
                power = power[:-wide] * factor + power[wide:] if len(power) > wide else power[:0]
                factor, wide = factor * factor, wide * 2
        return out[: len(h) - self.part + 1]


SPANS = StructType(
    [
        StructField("n_words", LongType()),
        StructField("n_removed", LongType()),
        StructField("text", StringType()),
        StructField("spans", ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))),
    ]
)


def remove_repeated_spans(docs: DataFrame, size: int = 35, text: str = "text", keep: tuple[str, ...] = ("doc_id",), result: str = "kept") -> DataFrame:
    """``keep`` and ``result``: words, words removed, the words left joined by spaces, and the removed spans.

    Words part at ASCII white space.  A word goes if it lies in a window of
    ``size`` words that starts at any second place, in the same text or another;
    windows are judged on the input.  Null texts have no words; each row gives a
    row, and a repeated row is a second place.

    Anchors (``Anchors``) that occur once are dropped first.  The passages round
    the others are the reference: they meet by anchor, equal ones as one with
    its number, in shards of bounded size, and the documents' passages stream
    through each shard's automaton.  The reference grows with the corpus, so its
    shards go to where the passages that can match them are, and not to all
    tasks.  An anchor with more places than one automaton takes is dealt on by
    the md5 of each whole window, equal ones counted before they are sent, so a
    common line in differing contexts spreads over the slots.
    """
    spark = docs.sparkSession
    slots = slots_of(spark)
    hot = max(2, SHARD_WORDS // (2 * size - (size + 1) // 2))  # passages of one automaton
    base = docs.select(*keep, F.col(text).alias("__text")).withColumn("__row", F.xxhash64(*(F.col(c).cast("string") for c in keep), "__text"))
    plain = base.select(F.col("__row").alias("row"), F.col("__text").alias("text")).where("text IS NOT NULL")
    anchors = plain.mapInArrow(lambda b: _send_anchors(b, size, slots), "slot int, pack binary")
    places = staged(anchors.repartition("slot").sortWithinPartitions("slot").mapInArrow(lambda b: _by_slot(b, lambda p: _shared_anchors(p, hot)), "row long, anchor long, first int, last int, hot boolean"), "anchors")
    # A row's own places: no more than its text has words.
    own = places.distinct().groupBy("row").agg(F.collect_list(F.struct("anchor", "first", "last", "hot")).alias("places"))
    passages = plain.join(own, "row").mapInArrow(lambda b: _send_passages(b, size, slots), "slot int, pack binary")
    spans = staged(passages.repartition("slot").sortWithinPartitions("slot").mapInArrow(lambda b: _by_slot(b, lambda p: _spans_of_slot(p, size)), "row long, start int, end int"), "spans")
    gone = spans.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("__gone"))
    held = base.join(gone, base["__row"] == gone["row"], "left").select(*keep, "__text", "__gone")
    schema = StructType([*(held.schema[c] for c in keep if c != result), StructField(result, SPANS)])
    return held.mapInArrow(lambda b: _remove(b, arrow_schema(schema)), schema)


def _split(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _send_anchors(batches, size: int, slots: int):
    anchors = Anchors(size)
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            piece = batch.slice(at, TOGETHER)
            rows, found = piece.column("row").to_numpy(), [anchors.of(_split(t)) for t in piece.column("text").to_pylist()]
            row = np.repeat(rows, [len(a) for a, _, _ in found])
            anchor, first, last = (np.concatenate(x) for x in zip(*found))
            yield _dealt(anchor, slots, lambda p: pack(anchor[p], row[p], first[p], last[p]))


def _dealt(anchor: np.ndarray, slots: int, packed) -> pa.RecordBatch:
    slot = (anchor % np.uint64(slots)).astype(np.int64)
    order = np.argsort(slot, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(slot[order])) + 1) if len(order) else []
    return pa.RecordBatch.from_arrays(
        [pa.array([int(slot[p[0]]) for p in parts], pa.int32()), pa.array([packed(p) for p in parts], pa.binary())], names=["slot", "pack"]
    )


def _by_slot(batches, each):
    """Hand over the packs of one slot after another."""
    slot, held = None, []
    for batch in batches:
        for s, p in zip(batch.column("slot").to_pylist(), batch.column("pack").to_pylist()):
            if s != slot and held:
                yield from each(held)
                held = []
            slot = s
            held.append(p)
    if held:
        yield from each(held)


def _shared_anchors(packs: list[bytes], hot: int):
    anchor, row, first, last = (np.concatenate(x) for x in zip(*(unpack(p, "<u8", "<i8", "<i4", "<i4") for p in packs)))
    order = np.argsort(anchor, kind="stable")
    same = anchor[order][1:] == anchor[order][:-1]
    starts = np.flatnonzero(np.concatenate(([True], ~same)))[: len(order)]
    many = np.diff(np.append(starts, len(order)))
    many = np.repeat(many, many)  # places of the anchor, in the order of ``order``
    several, many = order[many > 1], many[many > 1]
    for at in range(0, len(several), 1 << 16):
        p = several[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(row[p]), pa.array(anchor[p].view(np.int64)), pa.array(first[p]), pa.array(last[p]), pa.array(many[at : at + (1 << 16)] > hot)], names=["row", "anchor", "first", "last", "hot"]
        )


#: Kinds of packs, by their first byte: passages, windows of hot anchors, and spans already known to recur.
_PASSAGES, _WINDOWS, _SPANS = b"P", b"W", b"S"


def _send_passages(batches, size: int, slots: int):
    for batch in batches:
        held: list[tuple] = []
        windows: dict[bytes, list[tuple[int, int]]] = {}
        n = 0
        for row, text, places in zip(*(batch.column(c).to_pylist() for c in ("row", "text", "places"))):
            words = _split(text)
            for p in places:
                n += 1
                if p["hot"]:
                    for first in range(p["first"], p["last"] + 1):
                        windows.setdefault(hashlib.md5(b" ".join(words[first : first + size])).digest(), []).append((row, first))
                else:
                    held.append((p["anchor"], row, p["first"], b" ".join(words[p["first"] : p["last"] + size])))
            if n >= PASSAGES:
                yield from _flush(held, windows, size, slots)
                held, windows, n = [], {}, 0
        yield from _flush(held, windows, size, slots)


def _flush(held: list[tuple], windows: dict[bytes, list[tuple[int, int]]], size: int, slots: int):
    if held:
        yield _passages(held, slots)
    if windows:
        yield from _windows(windows, size, slots)


def _windows(windows: dict[bytes, list[tuple[int, int]]], size: int, slots: int):
    """One entry for each window; where it came several times its places are known to recur, and go as spans."""
    low, high = np.frombuffer(b"".join(windows), "<u8").reshape(-1, 2).T
    many = np.fromiter(map(len, windows.values()), np.int64, len(windows))
    row, first = np.array([at[0] for at in windows.values()], np.int64).reshape(-1, 2).T
    yield _dealt(low, slots, lambda p: _WINDOWS + pack(low[p], high[p], row[p], first[p].astype(np.int32), many[p]))
    known = [x for at in windows.values() if len(at) > 1 for x in at]
    if known:
        row, first = np.array(known, np.int64).T
        spread = mix(row.view(np.uint64) if row.flags.c_contiguous else row.copy().view(np.uint64))
        yield _dealt(spread, slots, lambda p: _SPANS + pack(row[p], first[p].astype(np.int32), (first[p] + size).astype(np.int32)))


def _passages(held: list[tuple], slots: int) -> pa.RecordBatch:
    anchor = np.array([a for a, _, _, _ in held], np.int64).view(np.uint64)
    row, first = (np.array([h[i] for h in held], np.int64) for i in (1, 2))

    def packed(p: np.ndarray) -> bytes:
        texts = [held[i][3] for i in p.tolist()]
        return _PASSAGES + pack(anchor[p], row[p], first[p].astype(np.int32), b"\n".join(texts))

    return _dealt(anchor, slots, packed)


def _spans_of_slot(packs: list[bytes], size: int):
    own: dict[bytes, list[bytes]] = {}
    for p in packs:
        own.setdefault(p[:1], []).append(p[1:])
    for p in own.get(_SPANS, ()):
        yield _spans(*unpack(p, "<i8", "<i4", "<i4"))
    if _WINDOWS in own:
        low, high, row, first, many = (np.concatenate(x) for x in zip(*(unpack(p, "<u8", "<u8", "<i8", "<i4", "<i8") for p in own[_WINDOWS])))
        order = np.lexsort((high, low))
        low, high, row, first, many = (x[order] for x in (low, high, row, first, many))
        starts = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1]))))
        total = np.repeat(np.add.reduceat(many, starts), np.diff(np.append(starts, len(low))))
        again = (total > 1) & (many == 1)  # the places of the others were sent as spans
        yield _spans(row[again], first[again], first[again] + np.int32(size))
    if _PASSAGES in own:
        yield from _repeated(own[_PASSAGES], size)


def _spans(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["row", "start", "end"])


def _repeated(packs: list[bytes], size: int):
    """Spans (row, start, end) of words that repeated windows cover, in the passages of one slot."""
    passages: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
    for p in packs:
        anchor, row, first, texts = unpack(p, "<u8", "<i8", "<i4", "")
        for a, r, f, text in zip(anchor.tolist(), row.tolist(), first.tolist(), texts.split(b"\n")):
            passages.setdefault(a, {}).setdefault(text, []).append((r, f))
    rows: list[tuple[int, int, int]] = []
    single: list[tuple[bytes, int, int]] = []
    shard: list[tuple[list[bytes], int]] = []
    shards, words_in_shard = [], 0
    for own in passages.values():
        lonely = [t for t, at in own.items() if len(at) == 1]
        for text, at in own.items():
            if len(at) > 1:  # seen twice as a whole, and so is each of its windows
                n = text.count(b" ") + 1
                rows += [(r, f, f + n) for r, f in at]
        if lonely and len(own) > 1:
            single += [(t, *own[t][0]) for t in lonely]
            for text, at in own.items():
                words = text.split(b" ")
                shard.append((words, len(at)))
                words_in_shard += len(words)
                if words_in_shard >= SHARD_WORDS:
                    shards.append(shard)
                    shard, words_in_shard = [], 0
            # Anchors of one shard are whole unless a single one outgrows it.
            if words_in_shard >= SHARD_WORDS // 2 or shards:
                shards.append(shard)
                rows += _stream(single, shards, size)
                single, shard, shards, words_in_shard = [], [], [], 0
    if single:
        rows += _stream(single, [*shards, shard], size)
    if rows:
        row, start, end = zip(*rows)
        yield _spans(row, start, end)


def _stream(single: list[tuple[bytes, int, int]], shards: list[list], size: int) -> list[tuple[int, int, int]]:
    """Stream passages seen once through the automaton of each shard in turn, and add up."""
    total = [np.zeros(text.count(b" ") + 2 - size, np.int64) for text, _, _ in single]
    for shard in shards:
        if not shard:
            continue
        automaton = SuffixAutomaton()
        for words, times in shard:
            automaton.add(words, times)
        automaton.close()
        for n, (text, _, _) in zip(total, single):
            n += automaton.occurrences(text.split(b" "), size)
    rows = []
    for (_, row, first), n in zip(single, total):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (n > 1).astype(np.int8), [0]))))
        rows += [(row, first + int(a), first + int(b) - 1 + size) for a, b in zip(edges[::2], edges[1::2])]
    return rows


def _remove(batches, schema: pa.Schema):
    for batch in batches:
        made = []
        for text, gone in zip(batch.column("__text").to_pylist(), batch.column("__gone").to_pylist()):
            words = _split(text)
            if not gone:
                made.append({"n_words": len(words), "n_removed": 0, "text": b" ".join(words).decode("utf-8", "surrogatepass"), "spans": []})
                continue
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, [g["start"] for g in gone], 1)
            np.add.at(change, [g["end"] for g in gone], -1)
            covered = np.cumsum(change)[:-1] > 0
            edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
            left = b" ".join(words[i] for i in np.flatnonzero(~covered).tolist()).decode("utf-8", "surrogatepass")
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]
            made.append({"n_words": len(words), "n_removed": int(covered.sum()), "text": left, "spans": spans})
        kept = [batch.column(c) for c in schema.names[:-1]]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(made, schema[-1].type)], schema=schema)
