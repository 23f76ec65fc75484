"""Cross-tokenizer alignment: each distinct text is tokenised twice and aligned once, and its copies count by weight.

Texts are shuffled whole, so equal ones meet exactly.  What two tokenizers give
for a text is kept in blocks: a block lists the id pairs its texts hold, with
the number of documents behind each, and a text the numbers of its pairs in that
list.  Pairs are then counted by id over the blocks, and the counts go back to
the blocks, where the texts read them.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stateweave.llm.block_dictionary import pack, unpack
from stateweave.llm.common import arrow_schema, staged

#: Texts taken at a time, pair entries after which a block ends, and aligned stretches and characters a task remembers.
PIECE, ENTRIES, STRETCHES, CHARACTERS = 200, 1 << 21, 1 << 19, 1 << 25
#: Pairs in a row of a block's list.
LISTED = 1 << 15
_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others for the code points
    from 256 on, in order.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + n): b for n, b in enumerate(rest)}}


class ByteLevel:
    """A byte-level vocabulary of the tokenizers library; special tokens in texts are plain text."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        of = byte_characters()
        entries = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(entries.values(), default=-1) + 1)
        for entry, number in entries.items():
            self.bytes[number] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A sentencepiece model with byte fallback; it puts the space before a text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        entries = [self.model.id_to_piece(n) for n in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(e[3:-1], 16)]) if self.model.is_byte(n) else e.replace("▁", " ").encode() for n, e in enumerate(entries)]
        #: No entry reaches over the start of a word, so words are encoded each by itself.
        self.by_word = not any("▁" in e.lstrip("▁") for e in entries)

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class _Aligner:
    """Aligns stretches of text, each one once as long as it is remembered.

    A stretch is what lies between single spaces that stand between other
    characters.  Neither tokenizer has a token across such a place, so both
    end there, and a text's tokens, groups and links are those of its stretches.
    """

    def __init__(self, first: str, second: str):
        self.a, self.b = ByteLevel(first), Pieces(second)
        self.size = [np.array([len(x) for x in v.bytes], np.int64) for v in (self.a, self.b)]
        self.ends = [self._strings(len(v.bytes), marks) for v, marks in ((self.a, (b",", b"|")), (self.b, (b",", b";")))]
        self.reset()

    @staticmethod
    def _strings(n: int, marks: tuple[bytes, bytes]) -> np.ndarray:
        """At 2 * id and 2 * id + 1 the id with what follows inside its list, and at its end."""
        out = np.empty(2 * n, object)
        out[:] = [str(i).encode() + m for i in range(n) for m in marks]
        return out

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.characters = 0
        self.ok: list[bool] = []
        self.groups: list[bytes] = []
        self.n_a = self.n_b = self.n_groups = self.n_links = self.start = self.codes = np.zeros(0, np.int64)

    def stretches(self, text: str) -> list[str]:
        return _CUT.split(text) if self.b.by_word else [text]

    def learn(self, stretches: list[str]) -> None:
        """Take in what is not known yet."""
        new = list(dict.fromkeys(s for s in stretches if s not in self.number))
        if not new:
            return
        self.number.update(zip(new, itertools.count(len(self.number))))
        self.characters += sum(map(len, new))
        ids = [v(new) for v in (self.a, self.b)]
        for own_a, own_b, s in zip(*ids, new):
            whole = b" " + s.encode()
            same = b"".join(map(self.a.bytes.__getitem__, own_a)) == whole == b"".join(map(self.b.bytes.__getitem__, own_b))
            self.ok.append(same)
            if not same:
                own_a.clear()
                own_b.clear()
        count = [np.fromiter(map(len, x), np.int64, len(new)) for x in ids]
        flat = [np.fromiter(itertools.chain.from_iterable(x), np.int64, int(c.sum())) for x, c in zip(ids, count)]
        end_a, end_b = (np.cumsum(size[x]) for size, x in zip(self.size, flat))
        start_a, start_b = (e - size[x] for e, size, x in zip((end_a, end_b), self.size, flat))
        shared = np.intersect1d(end_a, end_b, assume_unique=True)
        # Groups end where both end; a token's group is the first such end at or after its own.
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        low, high = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
        links = high - low
        total = np.cumsum(links)
        other = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - links, links) + np.repeat(low, links)
        codes = np.repeat(flat[0], links) * len(self.b.bytes) + flat[1][other]
        cuts = np.concatenate(([0], np.cumsum(count[0])))
        per = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[cuts])
        own_links, last_a = per(links), np.append(group_a[1:] != group_a[:-1], True) if len(group_a) else np.zeros(0, bool)
        last_b = np.append(group_b[1:] != group_b[:-1], True) if len(group_b) else np.zeros(0, bool)
        self.n_a, self.n_b = np.append(self.n_a, count[0]), np.append(self.n_b, count[1])
        self.n_groups, self.n_links = np.append(self.n_groups, per(last_a)), np.append(self.n_links, own_links)
        self.start = np.append(self.start, len(self.codes) + np.cumsum(own_links) - own_links)
        self.codes = np.append(self.codes, codes)
        # The tokens of a group stand together, A's before B's; a stretch's text is one run of them.
        before_b, upto_a = np.searchsorted(group_b, group_a), np.searchsorted(group_a, group_b, "right")
        marks = np.empty(len(flat[0]) + len(flat[1]), object)
        marks[np.arange(len(flat[0])) + before_b] = self.ends[0][2 * flat[0] + last_a]
        marks[np.arange(len(flat[1])) + upto_a] = self.ends[1][2 * flat[1] + last_b]
        marks, bounds = marks.tolist(), np.concatenate(([0], np.cumsum(count[0] + count[1]))).tolist()
        self.groups += [b"".join(marks[i:k]) for i, k in zip(bounds, bounds[1:])]

    def forget(self) -> None:
        if len(self.number) > STRETCHES or self.characters > CHARACTERS:
            self.reset()

    def texts(self, texts: list[str]) -> tuple[list[np.ndarray], list[bytes]]:
        """Numbers of each text's stretches, and its groups as text; a text that either vocabulary changes has no tokens."""
        cut = [self.stretches(t) for t in texts]
        self.learn(list(itertools.chain.from_iterable(cut)))
        number, ok = self.number.__getitem__, self.ok.__getitem__
        numbers = [list(map(number, s)) for s in cut]
        odd = [i for i, own in enumerate(numbers) if not all(map(ok, own))]
        # Only the whole text can tell whether its bytes differ.
        self.learn([texts[i] for i in odd])
        for i in odd:
            numbers[i] = [self.number[texts[i]]]
        groups = [b"".join(map(self.groups.__getitem__, own))[:-1] for own in numbers]
        return [np.array(own, np.int64) for own in numbers], groups

    def links(self, numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The code of each link of all these texts, and the place of its text."""
        flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        whose = np.repeat(np.arange(len(numbers)), [len(x) for x in numbers])
        n = self.n_links[flat]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(self.start[flat], n)
        return self.codes[at], np.repeat(whose, n)


_ALIGNED = "block long, digest binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, codes array<long>, documents array<long>"


class _Block:
    """Texts and the pairs they hold, until there are enough of them."""

    def __init__(self, schema: pa.Schema, task: int):
        self.schema, self.task, self.blocks = schema, task, 0
        self.start()

    def start(self) -> None:
        self.rows: list[tuple] = []
        self.codes: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []
        self.entries = 0

    def flush(self):
        if not self.rows:
            return
        number = (self.task << 32) + self.blocks
        listed, rank = np.unique(np.concatenate(self.codes), return_inverse=True)
        documents = np.zeros(len(listed), np.int64)
        np.add.at(documents, rank, np.concatenate(self.weights))
        times, at, out = np.concatenate(self.times), 0, []
        for *measures, n in self.rows:
            out.append((number, *measures, pack(rank[at : at + n].astype(np.uint32), times[at : at + n].astype(np.uint32)), None, None))
            at += n
        for low in range(0, len(listed), LISTED):
            out.append((number, *[None] * 7, listed[low : low + LISTED], documents[low : low + LISTED]))
        for low in range(0, len(out), 1000):
            columns = list(zip(*out[low : low + 1000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.blocks += 1
        self.start()


def _aligned(texts: DataFrame, first: str, second: str) -> DataFrame:
    """Rows of texts and of listed pairs, by block, of a table (text, copies)."""
    schema = arrow_schema(texts.sparkSession.createDataFrame([], _ALIGNED).schema)

    def run(batches):
        from pyspark import TaskContext

        aligner, block = _Aligner(first, second), _Block(schema, TaskContext.get().partitionId())
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE):
                piece = batch.slice(at, PIECE)
                own, copies = piece.column("text").to_pylist(), piece.column("copies").to_numpy()
                numbers, groups = aligner.texts(own)
                codes, whose = aligner.links(numbers)
                span = len(aligner.a.bytes) * len(aligner.b.bytes)
                pairs, times = np.unique(whose * span + codes, return_counts=True)
                whose, codes = np.divmod(pairs, span)
                block.codes.append(codes)
                block.times.append(times)
                block.weights.append(copies[whose])
                block.entries += len(codes)
                held = np.bincount(whose, minlength=len(own))
                for i, text in enumerate(own):
                    n = [int(x[numbers[i]].sum()) for x in (aligner.n_a, aligner.n_b, aligner.n_groups, aligner.n_links)]
                    digest = hashlib.sha256(groups[i]).hexdigest() if n[0] else ""
                    block.rows.append((hashlib.sha256(text.encode()).digest(), *n, digest, int(held[i])))
                if block.entries >= ENTRIES:
                    yield from block.flush()
                aligner.forget()
        yield from block.flush()

    return texts.mapInArrow(run, _ALIGNED)


def _read(texts: pa.Table, pairs: pa.Table) -> pa.Table:
    """Counts of a block's pairs, read by its texts."""
    order = np.argsort(pairs.column("code").to_numpy())
    count = pairs.column("count").to_numpy()[order]
    best = pairs.column("best").to_numpy(zero_copy_only=False)[order].astype(bool)
    sums, bests = [], []
    for packed in texts.column("links").to_pylist():
        rank, times = (x.astype(np.int64) for x in unpack(packed, "<u4", "<u4"))
        sums.append(int((count[rank] * times).sum()))
        bests.append(int(times[best[rank]].sum()))
    return texts.drop_columns(["block", "links"]).append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))


def align(docs: DataFrame, first: str, second: str, text: str = "text", result: str = "alignment") -> DataFrame:
    """Add ``result`` (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): how two vocabularies cut a text.

    A, of the byte-level vocabulary at ``first``, encodes a space and the text;
    B, of the piece model at ``second``, adds that space itself.  Places where
    tokens of both end cut them into groups, and an A and a B token are linked
    where their bytes overlap.  The count of an id pair is the number of
    documents, copies included, that hold it linked; ``n_best`` links have the
    highest count that their A id has anywhere, ties included, and ``count_sum``
    adds the counts of all links.  ``groups_sha256`` is of the ids, group by
    group: ``a1,a2|b1;a3|b2,b3``.

    A text that is null, empty or not given back byte for byte by both has no
    tokens: zeros and an empty text.  Rows with equal texts get equal results; a
    document's copies cost a count each.  Texts meet as they are; results go back
    to the rows by their SHA-256.  An empty table gives one.  An input column
    called ``result`` is replaced.
    """
    base = docs.drop(result)
    distinct = base.where(F.length(text) > 0).groupBy(F.col(text).alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    aligned = staged(_aligned(distinct, first, second), "aligned")
    listed = aligned.where("codes IS NOT NULL").select("block", F.inline(F.arrays_zip("codes", "documents"))).withColumnRenamed("codes", "code")
    counts = listed.groupBy("code").agg(F.sum("documents").alias("count"))
    # Both vocabularies are fixed, so the ids' best are as many rows as A has ids, whatever the corpus.
    one = F.expr(f"code div {_pieces(second)}")
    counts = staged(counts.withColumn("a", one), "pair-counts")
    best = counts.groupBy("a").agg(F.max("count").alias("most"))
    marked = counts.join(best, "a").select("code", "count", (F.col("count") == F.col("most")).alias("best"))
    pairs = listed.select(F.col("block").alias("of"), "code").join(marked, "code")
    texts = aligned.where("digest IS NOT NULL").drop("codes", "documents")
    schema = StructType([*(f for f in texts.schema.fields if f.name not in ("block", "links")), StructField("n_best", LongType()), StructField("count_sum", LongType())])
    read = texts.groupBy("block").cogroup(pairs.groupBy("of")).applyInArrow(_read, schema)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    measures = read.select(F.col("digest").alias("__digest"), F.struct(*names).alias("__measures"))
    # Rows without text look for a digest of their own: they are no hot key.
    none = F.monotonically_increasing_id().cast("string").cast("binary")
    keyed = base.withColumn("__own", F.when(F.length(text) > 0, F.unhex(F.sha2(F.col(text).cast("binary"), 256))).otherwise(none))
    joined = keyed.join(measures, F.col("__own") == F.col("__digest"), "left")
    zero = F.struct(*(F.lit(0).cast("long").alias(n) for n in names[:-1]), F.lit("").alias(names[-1]))
    return joined.withColumn(result, F.coalesce("__measures", zero)).drop("__own", "__digest", "__measures")


def _pieces(path: str) -> int:
    """Size of the piece model's vocabulary."""
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path).get_piece_size()
