"""Preference data from pairs of conversations, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from debatelens.llm.common import stored

TRAINED = "assistant"
#: A turn without a role.
NO_ROLE = "unknown"


def turn_list(turn: str = "turn", role: str = "role", text: str = "text") -> Column:
    """Aggregate: the turns of a conversation by number, then by role and text."""
    return F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))))


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), _safe(F.coalesce(turn["role"], F.lit(NO_ROLE))), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(_safe(F.coalesce(turn["text"], F.lit(""))), F.lit("<|im_end|>"))


def _safe(text: Column) -> Column:
    """Markers inside a text must not act as markers."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rendered(turns: Column) -> Column:
    """The turns in ChatML."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def trained_spans(turns: Column) -> Column:
    """Where the rendered turns are trained on: (start, end) in characters of each
    assistant's text with its end marker. All else is masked."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def add(a: Column, t: Column) -> Column:
        start = a["at"] + F.length(_head(t))
        end = start + F.length(_body(t))
        span = F.struct(start.alias("start"), end.alias("end"))
        spans = F.when(t["role"] == TRAINED, F.concat(a["spans"], F.array(span))).otherwise(a["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda a: a["spans"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Prompt and completions for a frame with ``pair_id``, ``chosen`` and ``rejected``,
    the two being arrays of (turn, role, text).

    The prompt is the longest prefix of turns with equal role and text on both sides (two
    nulls are equal), rendered once. What follows is rendered for each side, with the
    spans that are trained on. Pairs that don't differ have two empty completions and are
    marked ``identical``; a side without turns makes an empty prompt.
    """

    def unlike(i: Column) -> Column:
        a, b = F.get("chosen", i), F.get("rejected", i)
        return ~(a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))

    both = F.least(F.size("chosen"), F.size("rejected"))
    at = F.when(both > 0, F.sequence(F.lit(0), both - 1)).otherwise(F.array().cast("array<int>"))
    out = pairs.withColumn("n_common", F.coalesce(F.get(F.filter(at, unlike), F.lit(0)), both))

    def rest(side: str) -> Column:
        return F.slice(side, F.col("n_common") + 1, F.greatest(F.size(side) - F.col("n_common"), F.lit(0)))

    out = out.select(
        "pair_id",
        F.col("n_common").cast("long").alias("n_common"),
        F.slice("chosen", F.lit(1), F.col("n_common")).alias("shared"),
        rest("chosen").alias("chosen"),
        rest("rejected").alias("rejected"),
    )
    return out.select(
        "pair_id",
        "n_common",
        rendered(F.col("shared")).alias("prompt"),
        rendered(F.col("chosen")).alias("chosen"),
        trained_spans(F.col("chosen")).alias("chosen_spans"),
        rendered(F.col("rejected")).alias("rejected"),
        trained_spans(F.col("rejected")).alias("rejected_spans"),
        ((F.size("chosen") == 0) & (F.size("rejected") == 0)).alias("identical"),
    )


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair_col: str = "pair_id") -> DataFrame:
    """One row per pair from two tables of turns (pair, turn, role, text); see ``format_pairs``.

    A pair that only one table has gets no turns on the other side. Turns with one number
    are ordered by role and text, repeated turns are repeated, turns without a pair belong
    to no conversation and are left out. Other columns are ignored; empty tables give no rows.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.where(F.col(pair_col).isNotNull())
        return rows.select(F.col(pair_col).alias("pair_id"), F.lit(name).alias("side"), "turn", "role", "text")

    rows = side(chosen, "chosen").unionByName(side(rejected, "rejected"))
    turn = F.struct("turn", "role", "text")
    lists = [F.sort_array(F.collect_list(F.when(F.col("side") == s, turn))).alias(s) for s in ("chosen", "rejected")]
    return format_pairs(rows.groupBy("pair_id").agg(*lists))


def with_other_reply(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Pairs from one table of conversations: the conversation as it is, and the same with
    its last assistant's turn answered as in its neighbour (the id that differs in the
    lowest bit). Without such a neighbour the turn is left out of the rejected side."""
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("pair_id"), "turn", "role", "text")
    # grouped once, for the conversations and for their replies
    convs = stored(rows.groupBy("pair_id").agg(turn_list().alias("chosen")), "conversations")
    at = F.filter(F.transform("chosen", lambda t, i: F.when(t["role"] == TRAINED, i)), lambda i: i.isNotNull())
    convs = convs.withColumn("last", F.array_max(at))
    replies = convs.where("last is not null").select(
        F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"),
        F.get("chosen", F.col("last"))["text"].alias("reply"),
        F.lit(True).alias("answered"),
    )
    swap = F.transform(
        "chosen",
        lambda t, i: F.when(
            i == F.col("last"), F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.col("reply").alias("text"))
        ).otherwise(t),
    )
    without = F.filter("chosen", lambda t, i: ~i.eqNullSafe(F.col("last")))
    joined = convs.join(replies, "pair_id", "left")
    return joined.select("pair_id", "chosen", F.when(F.col("answered"), swap).otherwise(without).alias("rejected"))
