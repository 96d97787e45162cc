"""Mixing sources to target weights by capped water-filling.

All sources share one level of words per unit of weight; a source whose share would pass its cap (a number of epochs
over it) is clamped there, and the excess raises the level of the others until none is above its cap.  A source's target
is met by whole repetitions of all its documents and a fraction of one more: the documents that come first in a seeded
order, the last of them in part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: The seeded order is a 48-bit number; its first 12 bits part a source into runs that are summed on their own.
_RUN_BITS = 36


def cycle_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """``(source, weight)``: sources by code point, null last, weigh 1 to ``cycle``, repeating.

    One row for each source goes to one task, never a document."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return sources.select("source").distinct().select("source", ((F.row_number().over(order) - 1) % cycle + 1).cast("long").alias("weight"))


def water_level(sources: DataFrame, cap: int) -> float | None:
    """Words per unit of weight, over ``(source_size, weight)``; None if every source is at its cap.

    Clamping goes in rounds; each is one aggregate of the sources, of which the driver gets two sums."""
    capped, free = F.lit(cap) * F.col("source_size"), F.col("weight")
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total or not weight:
        return None
    level = total / weight
    while True:
        over = capped <= F.lit(level) * free
        used, rest = sources.agg(F.sum(F.when(over, capped).otherwise(0)), F.sum(F.when(over, 0).otherwise(free))).first()
        if not rest:
            return None
        after = (total - used) / rest
        if after <= level:
            return level
        level = after


def mix_sources(
    docs: DataFrame,
    weights: DataFrame | None = None,
    cap: int = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How often, and how much of, each document the mix takes.

    ``weights(source, weight)`` holds positive integers, each source once (one given twice would give its documents twice); without it sources weigh 1, 2, 3 in turn (``cycle_weights``).
    The mix is as large as the input.  Returns a row for each row of ``docs``: ``doc_id``; ``source``; ``size`` (words
    ``[^\\x20\\x09-\\x0D]+``); ``source_size``; ``target`` (words of its source, rounded to six places); ``epochs``
    (whole repetitions); ``part`` (words of one more repetition); ``taken`` = epochs * size + part.

    A source's ``taken`` sum to its target rounded to a whole word.  Null texts have size 0; a null source is a source of
    its own; a source without words, or without a weight, has target 0; null ids sort by themselves; repeated rows are
    taken each on its own.  An empty table gives an empty result.  Other columns are not read."""
    scratch = Scratch(docs.sparkSession, "mix")
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
    ).select(
        "*",
        key.alias("key"),
        F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("long").alias("draw"),
    )
    sized = scratch.table(sized.withColumn("run", F.shiftright("draw", _RUN_BITS).cast("int")), "sized")
    runs = scratch.table(sized.groupBy("key", "source", "run").agg(F.sum("size").alias("words")), "runs")
    sources = runs.groupBy("key", "source").agg(F.sum("words").alias("source_size"))
    weights = cycle_weights(sources) if weights is None else weights
    weights = weights.select(key.alias("key"), "weight")
    sources = scratch.table(sources.join(weights, "key", "left").withColumn("weight", F.coalesce("weight", F.lit(0))), "sources")
    level = water_level(sources, cap)
    capped = (F.lit(cap) * F.col("source_size")).cast("double")
    target = capped if level is None else F.least(capped, F.lit(level) * F.col("weight"))
    shares = sources.select("key", "source_size", F.when(F.col("weight") > 0, target).otherwise(F.lit(0.0)).alias("target"))
    shares = shares.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    shares = shares.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    before = F.sum("words").over(Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("key", "run", F.coalesce(before, F.lit(0)).alias("runs_before")).join(shares, "key")
    inside = Window.partitionBy("key", "run").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(runs, ["key", "run"])
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("runs_before") - F.col("before")))
    return placed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        F.round("target", 6).alias("target"),
        "epochs",
        part.alias("part"),
        (F.col("epochs") * F.col("size") + part).alias("taken"),
    )


def mixed_documents(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of a mix: a row for each repetition; a part holds the first words of the text, by single spaces.

    ``mix`` is what ``mix_sources`` gave for ``docs``, whose ids must not repeat and not be null.  Keeps all columns."""
    take = mix.where("epochs > 0 or part > 0").select(*[F.col(c).alias(f"__mix_{c}") for c in ("doc_id", "epochs", "part", "size")])
    rows = docs.join(take, F.col(id_col) == F.col("__mix_doc_id"))
    epochs, part, size = (F.col(f"__mix_{c}") for c in ("epochs", "part", "size"))
    none = F.array().cast("array<bigint>")
    copies = F.concat(F.when(epochs > 0, F.array_repeat(size, epochs.cast("int"))).otherwise(none), F.when(part > 0, F.array(part)).otherwise(none))
    rows = rows.withColumn("__mix_words", F.explode(copies))
    words = F.col("__mix_words")
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), 1, words.cast("int")), " ")
    return rows.withColumn(text_col, F.when(words < size, cut).otherwise(F.col(text_col))).select(*[F.col(c) for c in docs.columns])
