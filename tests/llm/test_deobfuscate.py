"""The noisy channel: disguises undone, Viterbi against all paths, and held-out accuracy."""

import itertools

import pytest
from pyspark.sql import functions as F

from stateweave.llm import deobfuscate as d

TEXTS = ["you are an idiot and a loser", "what a stupid moron", "the clown is pathetic trash", "good day to you and the forest", "see the still moon over the trees"] * 20


@pytest.fixture(scope="module")
def model(spark):
    return d.fit_characters(spark.createDataFrame([(t,) for t in TEXTS], "text string"))


@pytest.mark.parametrize(
    "seen, meant",
    [("1d10t", "idiot"), ("l0ser!!", "loser"), ("st*u*p*i*d", "stupid"), ("moooooron", "moron"), ("p@thetic", "pathetic"), ("i d i o t", "idiot"), ("forest,", "forest"), ("still", "still"), ("2024", "2024"), ("", ""),
     ("you are a s t u p i d man", "you are a stupid man"), ("y o u i d i o t", "you idiot"), ("s  t  u  p  i  d", "stupid"), ("stuupid", "stupid"),
     ("y 0 u 1 d 1 0 t", "you idiot"), ("1 2 3 4", "1 2 3 4"), ("good tree", "good tree")],
)
def test_disguises(model, seen, meant):
    assert d.restore_text(seen, model) == meant


def test_viterbi_equals_all_paths(model):
    for word in ("1d10t", "st0oop!d", "cl0wn$$", "tr4sh3"):
        runs = [d._choices(r[1], len(r[0])) for r in d._RUN.finditer(word)]
        paths = (("".join(t for t, _ in p), sum(c for _, c in p)) for p in itertools.product(*runs))
        best = max(cost + model.word(text) for text, cost in paths)
        found = d.restore_word(word, model)
        again = (("".join(t for t, _ in p), sum(c for _, c in p)) for p in itertools.product(*runs))
        assert max(cost + model.word(text) for text, cost in again if text == found) == pytest.approx(best)


def test_spaced_words_equal_all_paths(model):
    """Every way to part the characters, each way to read them: none is likelier than the one found."""
    for letters in ("atrash", "s33you", "l0sera"):
        found = d._unspace(" ".join(letters), model)
        best = {}
        for signs in itertools.product(*(d._choices(c, 1) for c in letters)):
            for gaps in itertools.product(("", " "), repeat=len(letters) - 1):
                text = "".join(t + g for (t, _), g in zip(signs, (*gaps, "")))
                if "  " not in text and text == text.strip():
                    total = sum(c for _, c in signs) + sum(map(model.word, text.split(" ")))
                    best[text] = max(total, best.get(text, total))
        assert best[found] == pytest.approx(max(best.values()))


def test_counted_symbols_are_those_decoded(spark):
    """A character counts as what ``symbol`` makes of it, question marks and signs beyond Latin-1 too."""
    for c in "aÉ?ж€…1٣中!":
        log = d.fit_characters(spark.createDataFrame([(f"{c * 5000}",)], "text string")).log
        after = log[: d.SYMBOLS]
        assert after.index(max(after)) == d.symbol(c.lower()), c


def test_scores_disguised_texts_and_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    labels = spark.createDataFrame([(i, int(i % 5 < 3)) for i, _ in rows] + [(None, 1), (7, None)], "doc_id long, toxic int")
    # Copies count once for the classifier, so each text gets a mark of its own.
    docs = spark.createDataFrame([(i, f"{t} n{i}") for i, t in rows], "doc_id long, text string")
    model = d.fit(docs, labels)
    odd = spark.createDataFrame([(1, "what a $tup1d moron"), (2, "good day over the forest"), (3, None), (4, ""), (5, "moon " * 30000)], "doc_id long, text string").withColumn("toxicity", F.lit("clash"))
    got = {r.doc_id: r.toxicity for r in d.score(odd, model).collect()}
    assert got[1].predicted == 1 and got[2].predicted == 0 and got[3] == got[4]
    assert all(0 <= s.score <= 1 and s.predicted == (s.score >= 0.5) for s in got.values())
    assert d.score(odd.limit(0), model).collect() == []
    one = d.fit(docs, labels.where("toxic = 1"))
    assert d.score(odd, one).first().toxicity.predicted == 1
    assert d.fit(docs.limit(0), labels.limit(0)).weights == {}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    from stateweave.llm.queries import QUERIES

    rows = QUERIES["op5_noisy_channel"](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    toxic, clean = ([r.predicted for r in rows if r.toxic == k] for k in (1, 0))
    assert sum(toxic) / len(toxic) > 0.85 and sum(clean) / len(clean) < 0.01
