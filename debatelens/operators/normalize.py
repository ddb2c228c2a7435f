"""Row filters and name normalisation, and the filter sets of the report families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import values as V
from ..functions.normal import is_procon, lower_name, title_name
from ..scale import join_lookup


def resolve_speaker(df: DataFrame) -> DataFrame:
    """Accept tables that call the speaker column ``bot``."""
    if "speaker" not in df.columns and "bot" in df.columns:
        return df.withColumnRenamed("bot", "speaker")
    return df


def normalise_names(df: DataFrame) -> DataFrame:
    """Title-case topics, lower-case modes, and a lower-case ``escalation_level``."""
    return df.withColumns(
        {
            "category": title_name("category"),
            "host_mode": lower_name("host_mode"),
            "escalation_level": lower_name("escalation"),
        }
    )


def drop_null_keys(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Drop rows without a mode or a level.

    Plain null checks on stored columns, which reach the scan; a normalised name is
    null exactly where the stored one is.
    """
    for key in keys or ["host_mode", "escalation"]:
        df = df.where(F.col(key).isNotNull())
    return df


def only_api(df: DataFrame, api: str = "openai") -> DataFrame:
    return df.where(F.col("api") == api)


def in_catalogue(df: DataFrame, topics: list[str] | DataFrame = V.TOPICS) -> DataFrame:
    """Messages on a known topic; the catalogue is a list or a one-column table."""
    if isinstance(topics, DataFrame):
        names = topics.select(title_name(topics.columns[0]).alias("category")).distinct()
        return join_lookup(df, names, "category", "left_semi")
    return df.where(F.col("category").isin([t.title() for t in topics]))


def only_procon(df: DataFrame) -> DataFrame:
    return df.where(is_procon())


def without_procon(df: DataFrame) -> DataFrame:
    return df.where(~is_procon())


def without_host(df: DataFrame, anywhere: bool = False) -> DataFrame:
    """Drop host rows: name equal to ``host``, or holding it ``anywhere``, in any case."""
    name = F.lower("speaker")
    return df.where(~name.contains("host") if anywhere else name != "host")


def only_speakers(df: DataFrame, speakers: list[str]) -> DataFrame:
    return df.where(F.col("speaker").isin(speakers))


def speaker_matches(pattern: str = "Pro|Con") -> Column:
    """Whether the speaker's name matches, in any case; no name matches nothing."""
    return F.coalesce(F.col("speaker").rlike(f"(?i){pattern}"), F.lit(False))


# --- Fixed value: message stored when the chat service failed ---
SERVICE_ERROR = "Error: Unable to get a response from OpenAI."


def without_service_errors(df: DataFrame, text: str = SERVICE_ERROR) -> DataFrame:
    """Drop messages that hold the error text of a failed service call."""
    return df.where(~F.col("message").eqNullSafe(F.lit(text)))


def only_modes(df: DataFrame, modes: list[str] = V.MODES) -> DataFrame:
    return df.where(lower_name("host_mode").isin(modes))


def coerce_turn(df: DataFrame, column: str = "turn") -> DataFrame:
    """Numeric turn, null where the stored value is no number."""
    return df.withColumn(column, F.col(column).try_cast("double"))


def main_bots(msgs: DataFrame, topics: list[str] = V.TOPICS) -> DataFrame:
    """Rows of the main report family: debates of the two plain bots on known topics."""
    named = normalise_names(resolve_speaker(msgs))
    kept = without_host(without_procon(in_catalogue(only_api(named), topics)))
    return only_speakers(kept, V.BOTS)


def procon_bots(msgs: DataFrame) -> DataFrame:
    """Rows of the pro/con report family; neither service nor topic is restricted."""
    return only_speakers(only_procon(normalise_names(resolve_speaker(msgs))), V.PROCON_BOTS)


def host_mode_bots(msgs: DataFrame) -> DataFrame:
    """Rows of the host-mode report family: mode and level must be known."""
    bots = only_speakers(without_host(resolve_speaker(msgs), anywhere=True), V.BOTS)
    return normalise_names(drop_null_keys(bots))
