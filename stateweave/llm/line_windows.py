"""Line deduplication: windows of three consecutive lines that occurred before are removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stateweave.llm.common import text_key


def remove_repeated_windows(docs: DataFrame, size: int = 3, doc_id: str = "doc_id", text: str = "text", result: str = "kept") -> DataFrame:
    """Add ``result`` (n_lines, n_removed, text): the lines that no later occurrence of a window covers.

    Windows overlap: each line starts one, and those that run past the end are
    left out, so a text of fewer lines than ``size`` is kept as it is.  Windows
    are compared by the 128-bit digest of their lines, unchanged.  The first
    occurrence, by doc_id (null first), text digest and line, stays; the lines
    of all later ones go, each once however many windows cover it.  A null text
    has no lines and stays null.  Rows equal in doc_id and text are one document
    and each gets its result.  An input column named ``result`` is replaced.

    A hot window costs one row a map task in the aggregate; the join that marks
    its occurrences is one that adaptive execution can split.
    """
    base = docs.drop(result).withColumn("__text", text_key(F.col(text))).withColumn("__id", F.col(doc_id))
    lines = F.split(F.col(text), "\n", -1)
    starts = (
        base.where(F.col(text).isNotNull())
        .select("__id", "__text", lines.alias("lines"))
        .where(F.size("lines") >= size)
        .select(
            "__id",
            "__text",
            F.posexplode(
                F.transform(
                    F.sequence(F.lit(1), F.size("lines") - size + 1),
                    lambda i: F.unhex(F.md5(F.concat_ws("\n", F.slice("lines", i, size)))),
                )
            ).alias("line", "window"),
        )
    )
    place = F.struct("__id", "__text", "line")
    first = starts.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    covered = (
        starts.join(first.select("window", "first"), "window")
        .where(~place.eqNullSafe(F.col("first")))
        .select("__id", "__text", F.explode(F.sequence(F.col("line"), F.col("line") + size - 1)).alias("line"))
        # A document's own line numbers: never more than its text has lines.
        .groupBy("__id", "__text")
        .agg(F.collect_set("line").alias("__gone"))
        .withColumnsRenamed({"__id": "__key", "__text": "__key_text"})
    )
    joined = base.join(covered, F.col("__id").eqNullSafe(F.col("__key")) & (F.col("__text") == F.col("__key_text")), "left")
    gone = F.coalesce("__gone", F.array().cast("array<int>"))
    held = joined.withColumn("__lines", F.coalesce(lines, F.array().cast("array<string>"))).withColumn("__gone", gone)
    # The positions that stay, found with a hash set, and then their lines: linear in the text.
    every = F.sequence(F.lit(0), F.size("__lines") - 1)
    kept = F.transform(F.array_except(every, F.col("__gone")), lambda i: F.get("__lines", i))
    value = F.struct(
        F.size("__lines").cast("long").alias("n_lines"),
        F.size("__gone").cast("long").alias("n_removed"),
        F.when(F.size("__gone") == 0, F.col(text)).otherwise(F.array_join(kept, "\n")).alias("text"),
    )
    return held.withColumn(result, value).drop("__id", "__text", "__key", "__key_text", "__gone", "__lines")
