"""The registered queries of these operators, each over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from stateweave.llm import brown, byte_bpe, chat_format, decontaminate, deobfuscate, html_tree, line_windows, range_join, signature_trees, skyband, source_mix, suffix_spans, token_alignment
from stateweave.operators.identity import global_number

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_chat_parts(spark: SparkSession, folder: str) -> DataFrame:
    schema = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()), StructField("text", StringType())])
    odd = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], schema)
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").union(odd)
    formatted = chat_format.format_turns(turns.withColumn("parts", chat_format.text_part(F.col("text"))))
    return chat_format.read_back(formatted)


def op2_brown_class_lm(spark: SparkSession, folder: str) -> DataFrame:
    held = brown.held_out("doc_id", 7, 2)
    docs = table(spark, folder, "documents").select("doc_id", "text", held.alias("held_out"), (~held).alias("training"))
    return brown.score_texts(docs, ["doc_id", "held_out"], "training")


def op3_line_windows(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_windows.remove_repeated_windows(docs).select("doc_id", "kept.n_lines", "kept.n_removed", sha256(F.coalesce("kept.text", F.lit(""))).alias("kept_sha256"))


# Rows equal in doc_id and text are one document here too.
OP3_SQL = """
WITH docs AS (
  SELECT doc_id, text, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) AS d, string_split(text, chr(10)) AS lines
  FROM (SELECT DISTINCT doc_id, text FROM documents)
),
starts AS (
  SELECT d, i, list_slice(lines, i, i + 2) AS w
  FROM (SELECT d, lines, unnest(range(1, len(lines) - 1)) AS i FROM docs WHERE text IS NOT NULL)
),
later AS (SELECT d, i FROM (SELECT d, i, row_number() OVER (PARTITION BY w ORDER BY d, i) AS k FROM starts) WHERE k > 1),
gone AS (SELECT DISTINCT d, i + o AS i FROM later, (SELECT unnest([0, 1, 2]) AS o)),
rows AS (SELECT d, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM docs WHERE text IS NOT NULL),
kept AS (
  SELECT r.d, count(g.i) AS n_removed, string_agg(r.line, chr(10) ORDER BY r.i) FILTER (WHERE g.i IS NULL) AS text
  FROM rows r LEFT JOIN gone g ON g.d = r.d AND g.i = r.i GROUP BY r.d
)
SELECT o.doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents o JOIN docs ON docs.doc_id IS NOT DISTINCT FROM o.doc_id AND docs.text IS NOT DISTINCT FROM o.text LEFT JOIN kept k USING (d)
"""


def op4_suffix_automata(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return suffix_spans.remove_repeated_spans(docs).select("doc_id", "kept.n_words", "kept.n_removed", sha256(F.col("kept.text")).alias("kept_sha256"))


OP4_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (
  SELECT d, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS win FROM (SELECT d, w, unnest(range(1, len(w) - 33)) AS i FROM docs WHERE len(w) >= 35)
),
several AS (SELECT win FROM starts GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT d, unnest(range(i, i + 35)) AS p FROM starts JOIN several USING (win)),
words AS (SELECT d, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (
  SELECT x.d, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE g.p IS NULL) AS t
  FROM words x LEFT JOIN gone g ON g.d = x.d AND g.p = x.p GROUP BY x.d
)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (d)
"""


def op5_noisy_channel(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held = brown.held_out("doc_id", 5, 0)
    model = deobfuscate.fit(docs, table(spark, folder, "labels").where(~held))
    return deobfuscate.score(docs, model).select("doc_id", held.alias("held_out"), "toxicity.score", "toxicity.predicted")


def op6_aho_corasick(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        sha256(F.array_join("found.items", ",")).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM items WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT len(win) AS k FROM item_windows),
doc_windows AS (
  SELECT d, i, k, list_slice(w, i, i + k - 1) AS win
  FROM (SELECT d, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes WHERE len(w) >= k)
),
hits AS (SELECT d, i, k, item_id FROM doc_windows JOIN item_windows USING (win)),
covered AS (SELECT d, count(DISTINCT p) AS n_hit FROM (SELECT d, unnest(range(i, i + k)) AS p FROM hits) GROUP BY d),
named AS (
  SELECT d, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT d, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY d
)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (d) LEFT JOIN named USING (d)
"""


def op7_signature_trees(spark: SparkSession, folder: str) -> DataFrame:
    return signature_trees.link_documents(table(spark, folder, "documents"))


OP7_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
),
sets AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                          ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM docs)
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 90 * (p.n + q.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.least_id AS component_id
FROM documents d JOIN (SELECT a, min(b) AS least_id FROM reach GROUP BY a) c ON c.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""


def byte_bpe_digests(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = byte_bpe.round_trip(docs, path, public_tokenizers.PATTERN, ["doc_id"])
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256(ids).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe_digests(table(spark, folder, "documents"))


def op9_html_tree_model(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    found = html_tree.extract(pages, html_tree.fit(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_pivot_range_join(spark: SparkSession, folder: str) -> DataFrame:
    return range_join.near_vectors(table(spark, folder, "embeddings"))


OP10_SQL = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93
),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least_id AS component_id, vec_id = least_id AS kept
FROM embeddings
JOIN (SELECT a AS vec_id, min(b) AS least_id FROM reach GROUP BY a) USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
"""


def op11_dominance_skyband(spark: SparkSession, folder: str) -> DataFrame:
    return skyband.audit(table(spark, folder, "documents"))


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
occurrences AS (
  SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
),
kept AS (SELECT lang, term, count(*) AS n FROM occurrences GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM occurrences SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT) // (coalesce(t.total, 0) + 2 * v) AS p,
         1 + (1000000000 * (k.n + 2)::HUGEINT) // (l.total + 2 * v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
sums AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
  FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source
),
pairs AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN sums s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def op12_capped_water_filling(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    named = global_number(docs.select("source").distinct(), [F.col("source").asc_nulls_last()], "place")
    weights = named.select("source", ((F.col("place") - 1) % 3 + 1).alias("weight"))
    return source_mix.mix(docs, weights).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, doc_id, dense_rank() OVER (ORDER BY source NULLS LAST) AS s,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS draw
  FROM documents
),
sources AS (SELECT s, ((s - 1) % 3 + 1)::HUGEINT AS w, sum(size)::HUGEINT AS size, count(*) AS n FROM docs GROUP BY s),
filling AS (
  SELECT *, (SELECT sum(size) FROM sources) - 3 * (sum(size) OVER o - size) AS left_over, sum(w) OVER () - (sum(w) OVER o - w) AS share, row_number() OVER o AS k
  FROM sources WINDOW o AS (ORDER BY size * (6 // w), s ROWS UNBOUNDED PRECEDING)
),
until_ AS (SELECT coalesce(min(k), (SELECT count(*) + 1 FROM sources)) AS k FROM filling WHERE left_over * w <= 3 * size * share),
level AS (SELECT left_over, share FROM filling JOIN until_ USING (k)),
targets AS (
  SELECT s, size, n, w, k < (SELECT k FROM until_) AS clamped,
         CASE WHEN k < (SELECT k FROM until_) THEN (3 * size)::DOUBLE ELSE ((SELECT left_over FROM level) * w)::DOUBLE / (SELECT share FROM level)::DOUBLE END AS target
  FROM filling
),
plan AS (
  SELECT *, CASE WHEN clamped OR size = 0 THEN 0 ELSE greatest(0, round(target)::HUGEINT - whole * size) END AS rest
  FROM (SELECT *, CASE WHEN clamped THEN 3 WHEN size = 0 THEN 0 ELSE ((SELECT left_over FROM level) * w) // (size * (SELECT share FROM level)) END AS whole FROM targets)
),
marked AS (
  SELECT d, doc_id, docs.size, draw, s, docs.size::HUGEINT * n > p.size AS long, rest, p.size AS source_size,
         sum(docs.size) OVER (PARTITION BY s, docs.size::HUGEINT * n > p.size ORDER BY draw RANGE UNBOUNDED PRECEDING) AS upto,
         sum(docs.size) OVER (PARTITION BY s, docs.size::HUGEINT * n > p.size, draw) AS unit
  FROM docs JOIN plan p USING (s)
),
long_quota AS (SELECT s, any_value(rest) * sum(CASE WHEN long THEN size ELSE 0 END) // greatest(any_value(source_size), 1) AS quota FROM marked GROUP BY s),
long_drawn AS (
  SELECT s, quota, coalesce(sum(size) FILTER (WHERE long AND 2 * upto - unit <= 2 * quota), 0) AS drawn FROM marked JOIN long_quota USING (s) GROUP BY s, quota
),
drawn AS (
  SELECT d, 2 * upto - unit <= 2 * CASE WHEN long THEN quota ELSE rest - drawn END AS extra FROM marked JOIN long_drawn USING (s)
)
SELECT doc_id, docs.size, p.size::BIGINT AS source_size, target, (docs.size * (whole + extra::INTEGER))::BIGINT AS taken
FROM docs JOIN plan p USING (s) JOIN drawn USING (d)
"""


def op13_distinct_text_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = token_alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "alignment.*")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_chat_parts,
        op2_brown_class_lm,
        op3_line_windows,
        op4_suffix_automata,
        op5_noisy_channel,
        op6_aho_corasick,
        op7_signature_trees,
        op8_byte_bpe,
        op9_html_tree_model,
        op10_pivot_range_join,
        op11_dominance_skyband,
        op12_capped_water_filling,
        op13_distinct_text_alignment,
    )
}

SQL = {
    "op3_line_windows": OP3_SQL,
    "op4_suffix_automata": OP4_SQL,
    "op6_aho_corasick": OP6_SQL,
    "op7_signature_trees": OP7_SQL,
    "op10_pivot_range_join": OP10_SQL,
    "op11_dominance_skyband": OP11_SQL,
    "op12_capped_water_filling": OP12_SQL,
}
