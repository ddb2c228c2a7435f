"""Prompts, claims, questions and host reactions drawn from lookup tables.

A draw is a number from the seeded hash of a key, modulo the number of candidates,
so it is repeatable and spreads evenly. Candidates are numbered once in their own
table; a draw then is an equi-join on the group and the number, and never pairs a
row with all of its candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import values as V
from ..functions.normal import lower_name
from ..scale import MAX_BROADCAST_BYTES, fits_bytes, join_lookup, positions, ranked_chunks


def draw_number(key: Column | str, seed: str) -> Column:
    """Number from the first 32 bits of the seeded hash of a key."""
    text = F.col(key).cast("string") if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(f"{seed}|"), text))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _numbered(listed: DataFrame, group: list[str]) -> DataFrame:
    """A large table numbered from 0 by text inside each group, or as a whole."""
    if group:
        keyed = listed.withColumn("_group", F.to_json(F.struct(*group), {"ignoreNullFields": "false"}))
        return positions(keyed, "_group", [F.col("_text")], "_number").drop("_group")
    chunked = ranked_chunks(listed, ["_text"], listed.count())
    # one row per chunk
    sizes = sorted(tuple(r) for r in chunked.groupBy("_chunk").count().collect())
    starts, before = [], 0
    for chunk, n in sizes:
        starts.append((chunk, before))
        before += n
    starts = listed.sparkSession.createDataFrame(starts, "_chunk int, _start long")
    place = F.row_number().over(W.partitionBy("_chunk").orderBy("_text")).cast("long") - 1
    placed = chunked.withColumn("_place", place).join(F.broadcast(starts), "_chunk")
    return placed.select("_text", (F.col("_place") + F.col("_start")).alias("_number"))


def _drawn(
    df: DataFrame, candidates: DataFrame, group: list[str], text: str, number: Column, out: str
) -> DataFrame:
    """One candidate of the row's group by ``number`` modulo the group's size, else null;
    one of all candidates with no group.

    Candidates are numbered from 0 by text inside their group. A small table is
    numbered by one window and broadcast; a large one is numbered in chunks and joined
    by group and number. The groups' sizes are small on their own account.
    """
    listed = candidates.select(*group, F.col(text).alias("_text"))
    small = fits_bytes(listed, MAX_BROADCAST_BYTES)
    if small:
        place = F.row_number().over(W.partitionBy(*group).orderBy("_text")).cast("long") - 1
        numbered = F.broadcast(listed.withColumn("_number", place))
    else:
        numbered = _numbered(listed, group)
    if group:
        sizes = listed.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
        sized = join_lookup(df, sizes, group, "left")
    else:
        sized = df.withColumn("_size", F.lit(listed.count()).cast("long"))
    sized = sized.withColumn("_number", F.when(F.col("_size") > 0, number % F.col("_size")))
    picked = sized.join(numbered, [*group, "_number"], "left")
    return picked.withColumnRenamed("_text", out).drop("_size", "_number")


def assign_prompt(
    conversations: DataFrame,
    prompts: DataFrame,
    defaults: DataFrame,
    seed: str,
    key: str = "conversation_id",
) -> DataFrame:
    """Opening prompt by (category, host_mode), else one of the mode's defaults.

    ``prompts`` has category, host_mode, prompt; ``defaults`` has host_mode, prompt.
    """
    number = draw_number(key, seed)
    own = _drawn(conversations, prompts, ["category", "host_mode"], "prompt", number, "_own")
    either = _drawn(own, defaults, ["host_mode"], "prompt", number, "_default")
    return either.withColumn("prompt", F.coalesce("_own", "_default")).drop("_own", "_default")


# --- Fixed value: claim of a topic without claims ---
NO_CLAIM = "This topic has no relevant data."


def assign_claim(
    conversations: DataFrame, claims: DataFrame, seed: str, key: str = "conversation_id"
) -> DataFrame:
    """Claim by lower-cased topic, else the fixed sentence; ``claims`` has topic, claim."""
    keyed = conversations.withColumn("topic", F.lower("category"))
    drawn = _drawn(keyed, claims, ["topic"], "claim", draw_number(key, seed), "claim")
    return drawn.withColumn("claim", F.coalesce("claim", F.lit(NO_CLAIM))).drop("topic")


def assign_topic(
    conversations: DataFrame, questions: DataFrame, seed: str, key: str = "conversation_id"
) -> DataFrame:
    """Question of the category; of all questions when the category is unknown or missing.

    ``questions`` has category, question.
    """
    number = draw_number(key, seed)
    own = _drawn(conversations, questions, ["category"], "question", number, "_own")
    either = _drawn(own, questions, [], "question", number, "_all")
    return either.withColumn("question", F.coalesce("_own", "_all")).drop("_own", "_all")


def render_host_reaction(
    host_rows: DataFrame,
    templates: DataFrame,
    seed: str,
    key: str = "id",
    default_category: str = "the broader topic",
) -> DataFrame:
    """Reaction text of host rows from a template for their strategy and mode.

    ``templates`` has strategy, host_mode (null = any other mode) and template, where
    ``{statement}`` and ``{category}`` are put in. ``host_rows`` has strategy,
    host_mode, category and statement.
    """
    number = draw_number(key, seed)
    moded = host_rows.withColumn("_mode", lower_name("host_mode"))
    by_mode = templates.where(F.col("host_mode").isNotNull()).select(
        "strategy", F.col("host_mode").alias("_mode"), "template"
    )
    any_mode = templates.where(F.col("host_mode").isNull()).select("strategy", "template")
    own = _drawn(moded, by_mode, ["strategy", "_mode"], "template", number, "_own")
    either = _drawn(own, any_mode, ["strategy"], "template", number, "_other")
    text = F.coalesce("_own", "_other")
    filled = F.replace(
        F.replace(text, F.lit("{statement}"), F.coalesce("statement", F.lit(""))),
        F.lit("{category}"),
        F.coalesce("category", F.lit(default_category)),
    )
    return either.withColumn("reaction", filled).drop("_own", "_other", "_mode")
