"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

DataFrame functions only.  What the driver holds is a few sums a round.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from stateweave.llm.common import staged, text_key

#: Bits of a document's draw, and of the stretch of draws that is added up as one.
DRAW_BITS, STRETCH_BITS = 60, 12
EXACT = "decimal(38,0)"


def words(text: Column) -> Column:
    """Words of a text, parted at ASCII white space; none where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(seed: int, doc_id: Column, text: Column) -> Column:
    """A document's place in its source's random order: 60 bits of a digest of the seed, its id and its text."""
    whole = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), text_key(text))
    return F.conv(F.substring(F.md5(whole), 1, DRAW_BITS // 4), 16, 10).cast("long")


def water_fill(sources: DataFrame, times: int = 3) -> DataFrame:
    """Add what each source gives to a mix of as many words as all have: target (double), whole (long), rest (long).

    ``sources`` has key, source_size and weight (a whole number, none below 0).
    Words are shared by weight.  A source whose share is above ``times`` its size
    is clamped there and the others share what it leaves, until none is above;
    each round clamps one more source at least, and compares exact whole
    numbers.  Where only sources of weight 0 are left, words stay unshared.
    ``whole`` counts the repetitions of every document and ``rest`` the words to
    sample besides.  An empty table gives one.
    """
    size, weight = F.col("source_size").cast(EXACT), F.coalesce("weight", F.lit(0)).cast(EXACT)
    total, weights = (int(x or 0) for x in sources.agg(F.sum(size), F.sum(weight)).first())
    left, share = total, weights
    while True:
        above = F.lit(Decimal(left)) * weight > size * F.lit(Decimal(times * share))
        clamped, heavy = (int(x or 0) for x in sources.where(above).agg(F.sum(size * times), F.sum(weight)).first())
        if (left, share) == (total - clamped, weights - heavy) or weights == heavy:
            break
        left, share = total - clamped, weights - heavy
    # Sources without words have a target of 0 either way.
    share = max(share, 1)
    given = F.lit(Decimal(left)) * weight
    target = F.when(above, (size * times).cast("double")).otherwise(given.cast("double") / F.lit(float(share)))
    per_source = size * F.lit(Decimal(share))
    repeats = F.when(above, F.lit(times)).when(size == 0, F.lit(0)).otherwise(F.call_function("div", given, F.greatest(per_source, F.lit(1).cast(EXACT)))).cast("long")
    rest = F.when(above, F.lit(0)).otherwise(F.round(target).cast("long") - F.col("whole") * F.col("source_size"))
    return sources.withColumn("target", target).withColumn("whole", repeats).withColumn("rest", F.greatest(rest, F.lit(0)).cast("long"))


def _cuts(sized: DataFrame, quotas: DataFrame) -> DataFrame:
    """(key, cut, drawn): the documents drawn at or below ``cut`` hold ``drawn`` words, as near to ``quota`` as whole ones come.

    Draws are added up by stretches, of which a source has 4,096; only the one
    in which the quota is reached is looked at document by document.
    """
    high = DRAW_BITS - STRETCH_BITS
    placed = sized.withColumn("stretch", F.shiftright("draw", high))
    sums = placed.groupBy("key", "stretch").agg(F.sum("size").alias("own"))
    before = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    summed = sums.withColumn("before", F.coalesce(F.sum("own").over(before), F.lit(0))).join(quotas.select("key", "quota"), "key")
    edge = summed.where("before <= quota AND quota < before + own").select("key", "stretch", "before", "quota")
    units = placed.join(edge, ["key", "stretch"]).groupBy("key", "stretch", "before", "quota", "draw").agg(F.sum("size").alias("size"))
    earlier = Window.partitionBy("key").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    near = units.withColumn("in", 2 * F.col("at") + F.col("size") <= 2 * F.col("quota"))
    found = near.groupBy("key").agg(
        F.coalesce(F.max(F.when(F.col("in"), F.col("draw"))), F.min(F.shiftleft("stretch", high)) - 1).alias("cut"),
        (F.min("before") + F.sum(F.when(F.col("in"), F.col("size")).otherwise(0))).alias("drawn"),
    )
    whole = sums.groupBy("key").agg(F.sum("own").alias("all"))
    every = F.coalesce("quota", F.lit(-1)) >= F.coalesce("all", F.lit(0))
    joined = quotas.join(whole, "key", "left").join(found, "key", "left")
    return joined.select(
        "key",
        F.when(every, F.lit(1 << DRAW_BITS)).otherwise(F.coalesce("cut", F.lit(-1))).alias("cut"),
        F.when(every, F.coalesce("all", F.lit(0))).otherwise(F.coalesce("drawn", F.lit(0))).alias("drawn"),
    )


def mix(docs: DataFrame, weights: DataFrame, times: int = 3, seed: int = 1, doc_id: str = "doc_id", text: str = "text", source: str = "source", result: str = "mix") -> DataFrame:
    """Add ``result`` (size, source_size, target, taken): the words of each document that a mix of the sources takes.

    ``weights`` has the column ``source`` and ``weight``; a source that it lacks
    has weight 0.  Targets come from ``water_fill``.  Each source takes all its
    documents ``floor(target / size)`` times and samples the rest: documents are
    put in an order that follows from the seed, those longer than the source's
    mean up to their share of the rest, then the others up to what is still
    missing, and the last one is taken if that comes nearer.  So a source misses
    its target by some half of a short document, or of a long one where the short
    ones do not suffice, and reruns agree at every partitioning.

    A null source is one source, a null or empty text has no words and gives 0.
    Rows equal in id, text and source are drawn alike.  An empty table gives
    one.  An input column called ``result`` is replaced.
    """
    key = F.struct(F.col(source).cast("string").alias("source"))
    base = docs.drop(result)
    own = base.select(key.alias("key"), words(F.col(text)).alias("size"), draw(seed, F.col(doc_id), F.col(text)).alias("draw"))
    sized = staged(own, "sized")
    sums = sized.groupBy("key").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    named = weights.select(key.alias("key"), F.col("weight"))
    filled = staged(water_fill(staged(sums.join(named, "key", "left"), "sources"), times), "targets")
    marked = staged(sized.join(filled.select("key", "source_size", "n"), "key").select("key", "size", "draw", (F.col("size").cast(EXACT) * F.col("n") > F.col("source_size")).alias("long")), "marked")
    long_sums = marked.where("long").groupBy("key").agg(F.sum("size").alias("long_size"))
    share = F.call_function("div", F.col("rest").cast(EXACT) * F.coalesce("long_size", F.lit(0)), F.greatest("source_size", F.lit(1)).cast(EXACT)).cast("long")
    first = staged(_cuts(marked.where("long"), filled.join(long_sums, "key", "left").select("key", share.alias("quota"))), "long-cuts")
    missing = filled.join(first, "key").select("key", (F.col("rest") - F.col("drawn")).alias("quota"))
    second = _cuts(marked.where("NOT long"), missing)
    plan = filled.join(first.select("key", F.col("cut").alias("long_cut")), "key").join(second.select("key", F.col("cut").alias("short_cut")), "key")
    plan = staged(plan.select(F.col("key").alias("__key"), "source_size", "n", "target", "whole", "long_cut", "short_cut"), "plan")
    plan = plan.select("__key", F.struct("source_size", "n", "target", "whole", "long_cut", "short_cut").alias("__plan"))
    held = base.withColumn("__size", words(F.col(text))).withColumn("__draw", draw(seed, F.col(doc_id), F.col(text)))
    joined = held.join(plan, key == F.col("__key"))
    long = F.col("__size").cast(EXACT) * F.col("__plan.n") > F.col("__plan.source_size")
    extra = (F.col("__draw") <= F.when(long, F.col("__plan.long_cut")).otherwise(F.col("__plan.short_cut"))).cast("long")
    value = F.struct(
        F.col("__size").alias("size"),
        F.col("__plan.source_size").alias("source_size"),
        F.col("__plan.target").alias("target"),
        (F.col("__size") * (F.col("__plan.whole") + extra)).alias("taken"),
    )
    return joined.withColumn(result, value).drop("__key", "__plan", "__size", "__draw")
