"""Chat formatting by perspective rotation.

A dialogue is rendered once for each participant: that speaker's turns are the assistant's, every other speaker is a named
user, and the mask marks the contents of the assistant's turns.  Turns are gathered in runs of bounded length, so that a
dialogue of any length is never held by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns in a rendered run; turn numbers that one task ranks, a power of two.
RUN_TURNS, RANK_TURNS = 256, 64
SYSTEM = "system"


def _head(role: Column, speaker: Column) -> Column:
    return (
        F.when(role == SYSTEM, F.lit("<|system|>\n"))
        .when(role == speaker, F.lit("<|assistant|>\n"))
        .otherwise(F.concat(F.lit("<|user name="), F.coalesce(role, F.lit("unknown")), F.lit("|>\n")))
    )


def rotate_perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Render every dialogue from the view of each of its participants.

    Returns a row for each ``conv_id``, ``speaker`` and ``run`` (0 for the first 256 turns, 1 for the next, ...): ``n_turns``;
    ``n_own`` (turns of the speaker); ``text`` (for each turn a line ``<|assistant|>``, ``<|user name=...|>`` or
    ``<|system|>``, the text and a line feed); ``mask``, ``from-to`` of each assistant content in ``text`` in code points, by
    commas; and ``start``, the code points of the runs before, so that joined runs are the whole dialogue.

    Turns go by number, ties by role and text, nulls first; repeated turns are all rendered.  Participants are the roles
    that are neither null nor ``system``; a null role is the user ``unknown``, and a dialogue without participants gives
    nothing.  Null texts are empty.  A null ``conv_id`` is a dialogue of its own.  Texts are rendered as they are, so only
    ``mask`` tells contents from markers.  An empty table gives an empty result; other columns are not read."""
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).cast("string").alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    rows = rows.withColumn("part", F.coalesce(F.shiftright("turn", RANK_TURNS.bit_length() - 1), F.lit(-(1 << 63))))  # nulls first
    earlier = F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = rows.groupBy("key", "part").agg(F.count("*").alias("n")).select("key", "part", F.coalesce(earlier, F.lit(0)).alias("earlier"))
    nth = F.row_number().over(Window.partitionBy("key", "part").orderBy("turn", "role", "text"))
    ranked = rows.withColumn("nth", nth - 1).join(parts, ["key", "part"]).withColumn("rank", F.col("earlier") + F.col("nth"))
    runs = (
        ranked.withColumn("run", F.expr("rank div %d" % RUN_TURNS).cast("int"))
        .groupBy("key", "conv_id", "run")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "role", "text"))).alias("turns"))
    )
    speakers = rows.where(F.col("role").isNotNull() & (F.col("role") != SYSTEM)).select("key", F.col("role").alias("speaker")).distinct()
    views = runs.join(speakers, "key")
    speaker = F.col("speaker")
    own = F.filter("turns", lambda t: t["role"] == speaker)
    text = F.array_join(F.transform("turns", lambda t: F.concat(_head(t["role"], speaker), t["text"], F.lit("\n"))), "")
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(_head(t["role"], speaker)) + F.length(t["text"]) + 1).alias("at"),
            F.when(
                t["role"] == speaker,
                F.concat(
                    a["spans"],
                    F.array(F.concat_ws("-", (a["at"] + F.length(_head(t["role"], speaker))).cast("string"), (a["at"] + F.length(_head(t["role"], speaker)) + F.length(t["text"])).cast("string"))),
                ),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
        lambda a: a["spans"],
    )
    views = views.select(
        "key", "conv_id", "speaker", "run", F.size("turns").cast("long").alias("n_turns"), F.size(own).cast("long").alias("n_own"), text.alias("text"), F.array_join(spans, ",").alias("mask")
    )
    start = F.sum(F.length("text")).over(Window.partitionBy("key", "speaker").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    return views.withColumn("start", F.coalesce(start, F.lit(0)).cast("long")).drop("key")
