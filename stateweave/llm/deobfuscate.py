"""Toxicity behind disguises: a noisy channel restores the words, and the restored text is scored."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from stateweave.llm.common import append_column

# Letters that signs are written for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "(": "c", "<": "c", "£": "l", "¡": "i",
}
#: Log10 costs of the channel: a sign for a letter, a sign put in, a sign meant as such, a letter drawn out, and a drawn-out letter kept.
AS_LETTER, PUT_IN, AS_SIGN, DRAWN, KEPT = -0.7, -0.7, -1.0, -0.3, -4.0
#: Symbols of the language model: edge of a word, a to z, other letters, all else.
SYMBOLS, OTHER_LETTER, OTHER = 29, 27, 28
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SPACED = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D](?:\x20{1,3}[^\x20\x09-\x0D]){2,}(?![^\x20\x09-\x0D])")
#: What is no letter and lies beyond Latin-1.
_SIGNS = re.compile(r"[^\x00-\xFF\w]|(?![\x00-\xFF])\d")
_RUN = re.compile(r"(.)\1*", re.S)
_EDGES = re.compile(r"^[\W_]{2,}|^[\"'(\[{¡¿«]|[\W_]{2,}$|[.,;:!?\"')\]}…»]$")
_PLAIN = re.compile(r"(?!.*(.)\1)[^\W\d_]+", re.S)
#: Words a task remembers before it starts anew, labelled rows that a classifier is fitted on, and its features.
REMEMBERED, LABELLED, FEATURES = 1 << 18, 12_000, 4096
HASHED = 1 << 20


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER_LETTER if c.isalpha() else OTHER


@dataclass
class CharacterModel:
    """Log10 probabilities of a symbol after two others, as a flat list."""

    log: list[float]

    def word(self, word: str) -> float:
        a = b = total = 0
        for c in (*map(symbol, word), 0):
            total += self.log[(a * SYMBOLS + b) * SYMBOLS + c]
            a, b = b, c
        return total


def fit_characters(docs: DataFrame, text: str = "text") -> CharacterModel:
    """Trigrams of symbols over all whole texts; the table has SYMBOLS cubed entries, whatever the corpus."""
    table = np.full(256, OTHER, np.int32)
    for b in range(256):
        c = chr(b)
        table[b] = 0 if c in " \t\n\r\v\f" else symbol(c.lower()) if c.isalpha() else OTHER
    # Other signs stand for question marks and those beyond Latin-1, so that letters alone are replaced by one.
    table[ord("?")] = OTHER_LETTER

    def count(batches):
        counts = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                joined = "  ".join(t for t in batch.column("text").slice(at, 500).to_pylist() if t).replace("?", "!")
                joined = joined if joined.isascii() else _SIGNS.sub("!", joined)
                s = table[np.frombuffer(f"  {joined}  ".encode("latin-1", "replace"), np.uint8)]
                # Words part at any run of white space: two edges before each word, one behind.
                keep = np.ones(len(s), bool)
                keep[2:] = (s[2:] != 0) | (s[1:-1] != 0) | (s[:-2] != 0)
                s = s[keep]
                spaced = np.repeat(s, np.where((s == 0) & (np.roll(s, 1) != 0) & (np.roll(s, -1) != 0), 2, 1))
                counts += np.bincount((spaced[:-2] * SYMBOLS + spaced[1:-1]) * SYMBOLS + spaced[2:], minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["trigram", "n"])

    counts = np.zeros((SYMBOLS, SYMBOLS, SYMBOLS))
    for r in docs.select(F.col(text).alias("text")).mapInArrow(count, "trigram int, n long").groupBy("trigram").agg(F.sum("n")).collect():
        counts.ravel()[r[0]] = r[1]
    # Each order is smoothed with the one below it.
    one = counts.sum((0, 1)) + 1
    two = counts.sum(0) + 5 * one / one.sum()
    two /= two.sum(1, keepdims=True)
    three = counts + 5 * two[None, :, :]
    return CharacterModel(np.log10(three / three.sum(2, keepdims=True)).ravel().tolist())


def _choices(c: str, n: int) -> list[tuple[str, float]]:
    """What a run of one character may have been, and what the channel asks for it."""
    if c.isalpha():
        if n == 1:
            return [(c, 0.0)]
        return [(c * 2, 0.0), (c, -1.5)] if n == 2 else [(c, DRAWN), (c * 2, DRAWN), (c * n, KEPT)]
    out = [("", PUT_IN), (c * min(n, 2), AS_SIGN)]
    for letter in LEET.get(c, ""):
        out.append((letter, AS_LETTER))
        if n > 1:
            out.append((letter * 2, AS_LETTER))
    return out


def restore_word(token: str, model: CharacterModel) -> str:
    """The likeliest word behind a token: Viterbi over the lattice of its runs' choices.

    A word of plain letters, none of them doubled, has one path and stays
    itself, as does a token without letters.
    """
    word = _EDGES.sub("", token)
    if _PLAIN.fullmatch(word) or not any(map(str.isalpha, word)):
        return word
    return _likeliest([_choices(run[1], len(run[0])) for run in _RUN.finditer(word)], model)


def _likeliest(lattice: list[list[tuple[str, float]]], model: CharacterModel) -> str:
    """The best path through choices (text, cost) under the model: Viterbi over the last two symbols. A space ends a word."""
    log = model.log
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for step in lattice:
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        choices = [(t, [0 if c == " " else symbol(c) for c in t], cost) for t, cost in step]
        for (a, b), (total, path) in best.items():
            for text, symbols, cost in choices:
                x, y, own = a, b, total + cost
                for c in symbols:
                    own += log[(x * SYMBOLS + y) * SYMBOLS + c]
                    x, y = (y, c) if c else (0, 0)
                held = new.get((x, y))
                if held is None or own > held[0]:
                    new[x, y] = own, (path, text)
        best = new
    (a, b), (_, path) = max(best.items(), key=lambda x: x[1][0] + log[(x[0][0] * SYMBOLS + x[0][1]) * SYMBOLS])
    parts = []
    while path:
        path, text = path
        parts.append(text)
    return "".join(reversed(parts))


def _unspace(text: str, model: CharacterModel) -> str:
    """Words of characters set apart: after each one the lattice has a space or none, and the path says where words end.

    Characters without a letter among them stay as they are.
    """

    def decoded(m: re.Match) -> str:
        if not any(map(str.isalpha, m[0])):
            return m[0]
        lattice = []
        for c in m[0].split():
            lattice += [_choices(c, 1), [("", 0.0), (" ", 0.0)]]
        return _likeliest(lattice[:-1], model)

    return _SPACED.sub(decoded, text)


def restore_text(text: str, model: CharacterModel) -> str:
    return " ".join(restore_word(t, model) for t in WORDS.findall(_unspace(text.lower(), model)))


def restore(docs: DataFrame, model: CharacterModel, text: str = "text", result: str = "restored") -> DataFrame:
    """Add ``result``: the lower-cased words behind each text. Null gives the empty text; an input column so called is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return append_column(docs, text, result, StringType(), lambda values: [restore_text(v, shared.value) for v in values])


def word_features(word: str) -> list[int]:
    """A word, and its beginnings for those it is a form of, hashed."""
    import xxhash

    return [xxhash.xxh32_intdigest(p) % HASHED for p in {word, *(f"{word[:k]}*" for k in (4, 5, 6) if len(word) >= k)}]


class _Features:
    """The features of texts among ``wanted``, or all; words seen before are remembered."""

    def __init__(self, model: CharacterModel, wanted: dict[int, float] | None):
        self.model, self.wanted, self.known = model, wanted, {}

    def of(self, text: str) -> set[int]:
        out: set[int] = set()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, wanted = self.known, self.wanted
        for token in set(WORDS.findall(_unspace(text.lower(), self.model))):
            own = known.get(token)
            if own is None:
                word = restore_word(token, self.model)
                own = word_features(word) if word else ()
                own = known[token] = tuple(own if wanted is None else filter(wanted.__contains__, own))
            if own:
                out.update(own)
        return out


@dataclass
class Toxicity:
    characters: CharacterModel
    weights: dict[int, float]
    bias: float


def fit(docs: DataFrame, labels: DataFrame, limit: int = LABELLED, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Toxicity:
    """Fit the character model on all texts, and the classifier on ``limit`` labelled rows at most.

    ``labels`` (doc_id, label 0 or 1; others are left out) are taken in the
    order of a hash of doc_id, which also breaks ties; only those texts are
    read for the classifier and one task fits it, as the bound allows.  Copies
    of a text count once.  Without rows of both labels every score is the
    share of toxic rows, one half without any.
    """
    spark = docs.sparkSession
    characters = fit_characters(docs, text)
    taken = (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
        .select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
        .distinct()
        .orderBy(F.xxhash64("id"), "id", "label")
        .limit(limit)
    )
    own = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(taken), "id")  # ``limit`` rows
    shared = spark.sparkContext.broadcast(characters)

    def features(batches):
        reader = _Features(shared.value, None)
        for batch in batches:
            rows = batch.column("text").to_pylist()
            found = [sorted(reader.of(t or "")) for t in rows]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.int32()))], names=["label", "features"])

    # Copies agree in label and features.
    sample = own.mapInArrow(features, "label int, features array<int>").distinct()
    row = sample.repartition(1).mapInArrow(_fit_batches, "weights map<int,double>, bias double").first()
    return Toxicity(characters, dict(row["weights"]), row["bias"]) if row else Toxicity(characters, {}, 0.0)


def _fit_batches(batches):
    labels, ids, sizes = [], [], []
    for batch in batches:
        labels.append(batch.column("label").to_numpy())
        found = batch.column("features")
        sizes.append(found.value_lengths().to_numpy(zero_copy_only=False))
        ids.append(found.flatten().to_numpy())
    y = np.concatenate([np.zeros(0), *labels]).astype(float)
    weights, bias = _logistic(y, np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes]))
    kind = pa.map_(pa.int32(), pa.float64())
    yield pa.RecordBatch.from_arrays([pa.array([list(weights.items())], kind), pa.array([bias])], names=["weights", "bias"])


def _logistic(y: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[dict[int, float], float]:
    """Penalised logistic regression over the features that tell the labels apart best."""
    toxic, n = y.sum(), len(y)
    if toxic in (0, n):
        return {}, float(np.log((toxic + 0.5) / (n - toxic + 0.5)))
    rows = np.repeat(np.arange(n), sizes)
    there = np.bincount(ids, minlength=HASHED)
    hits = np.bincount(ids, y[rows], minlength=HASHED)
    expected = there * toxic / n
    chi = (hits - expected) ** 2 / np.maximum(expected * (1 - toxic / n), 1e-9)
    chi[there < 5] = 0
    chosen = np.argsort(-chi, kind="stable")[:FEATURES]
    chosen = chosen[chi[chosen] > 15]
    column = np.full(HASHED, -1)
    column[chosen] = np.arange(len(chosen))
    at = column[ids]
    rows, at = rows[at >= 0], at[at >= 0]
    w, bias = np.zeros(len(chosen)), float(np.log(toxic / (n - toxic)))
    # Adam on the whole sample; the penalty spreads over 1 / n of a row each.
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, 401):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(rows, w[at], minlength=n), -30, 30)))
        error = (p - y) / n
        grad = np.append(np.bincount(at, error[rows], minlength=len(w)) + 0.2 * w / n, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], float(bias - move[-1])
    return {int(c): float(x) for c, x in zip(chosen, w)}, bias


RESULT = StructType([StructField("score", DoubleType()), StructField("predicted", IntegerType())])


def score(docs: DataFrame, model: Toxicity, text: str = "text", result: str = "toxicity") -> DataFrame:
    """Add ``result`` (score from 0 to 1, predicted): how likely the restored whole text is toxic.

    Only the text is read.  Null and empty texts get the score of no features;
    rows are scored one by one, so repeated rows, ties and empty tables need
    nothing; an input column called ``result`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    readers: list[_Features] = []

    def each(values: list[str]) -> list[dict]:
        model = shared.value
        if not readers:
            readers.append(_Features(model.characters, model.weights))
        out = []
        for text in values:
            z = model.bias + sum(map(model.weights.__getitem__, sorted(readers[0].of(text))))
            p = float(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            out.append({"score": p, "predicted": int(p >= 0.5)})
        return out

    return append_column(docs, text, result, RESULT, each)
