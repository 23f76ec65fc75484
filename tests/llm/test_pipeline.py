"""The pipeline's stages: planted cases go, clean documents stay, and odd rows get through."""

import random

import corpus_pipeline as p

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts]
    return spark.createDataFrame(rows, COLUMNS)


def kept(spark, stage, texts, folder=FOLDER):
    docs = docs_of(spark, texts)
    out = dict(p.STAGES)[stage](spark, docs, folder)
    assert out.columns == docs.columns
    return sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)


def test_stages_in_order():
    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "byte_bpe"]


def test_lines(spark):
    passage = "one a b\ntwo c d\nthree e f"
    texts = [(1, f"{passage}\nown line"), (2, f"first\n{passage}"), (3, passage), (4, ""), (5, None), (6, "x")]
    assert kept(spark, "line_dedup", texts) == [(1, texts[0][1], len(texts[0][1])), (2, "first", 5), (4, "", 0), (5, None, None), (6, "x", 1)]


def test_near_duplicates(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    near = [*base]
    near[100] = "changed"
    far = [w if i % 9 else "other" for i, w in enumerate(base)]
    texts = [(3, " ".join(base)), (4, " ".join(near)), (9, " ".join(base)), (9, " ".join(base)), (5, " ".join(far)), (6, None), (None, " ".join(base)), (7, "short")]
    assert [k[0] for k in kept(spark, "jaccard_join", texts)] == [3, 5, 6, 7, None]
    repeated = [(1, "same text here"), (1, "same text here"), (2, "another")]
    assert [k[0] for k in kept(spark, "jaccard_join", repeated)] == [1, 2]


def test_benchmark_passages(spark):
    item = next(r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").collect() if len(r.text.split()) >= 12)
    texts = [(1, f"before {item.upper()} after"), (2, " ".join(item.split()[:8])), (3, ""), (4, None)]
    assert [k[0] for k in kept(spark, "decontamination", texts)] == [2, 3, 4]


def test_empty_tables(spark):
    for name, stage in p.STAGES:
        assert stage(spark, docs_of(spark, [(1, "x")]).limit(0), FOLDER).collect() == [], name


def test_whole_run(spark):
    out = {r.doc_id: r for r in p.run(spark, FOLDER).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert 0 < len(out) < len(docs) and set(out) <= set(docs)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    clean = [i for i in docs if labels.get(i) == 0]
    # A clean document is missing only where it repeats others or holds a benchmark passage.
    assert sum(i in out for i in clean) > 0.8 * len(clean)
    for r in out.values():
        assert r.n_tokens >= 0 and len(r.decoded_sha256) == 64
