"""Line windows against plain Python, with nulls, short texts, ties and a clashing column."""

import random

from pyspark.sql import functions as F

from stateweave.llm.line_windows import remove_repeated_windows


def plain(docs):
    """Texts by row; equal rows are one document, taken in order of id and text digest."""
    import hashlib

    texts = sorted({(i is not None, i or 0, hashlib.md5((t or "").encode()).hexdigest(), t) for i, t in docs if t is not None})
    seen, out = set(), {}
    for there, i, _, text in texts:
        lines, gone = text.split("\n"), set()
        for at in range(len(lines) - 2):
            window = tuple(lines[at : at + 3])
            if window in seen:
                gone |= {at, at + 1, at + 2}
            seen.add(window)
        out[i if there else None, text] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_equals_plain_python(spark):
    rng = random.Random(3)
    docs = [(i, "\n".join(rng.choices("ab", k=rng.randint(1, 9)))) for i in range(60)]
    docs += [(None, "a\nb\na"), (7, None), (8, ""), (9, "\n\n\n"), (60, docs[0][1]), (60, docs[0][1]), (61, "x\n" * 3000 + "y")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("line", F.lit(0))
    want, rows = plain(docs), remove_repeated_windows(df).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r.kept) == (want[r.doc_id, r.text] if r.text is not None else (0, 0, None))


def test_empty_table(spark):
    assert remove_repeated_windows(spark.createDataFrame([], "doc_id long, text string")).collect() == []
