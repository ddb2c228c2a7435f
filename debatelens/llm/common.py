"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from debatelens.scale import scratch_path

#: Between words stand blanks and the control characters 9 to 13, nothing else.
BLANKS = r"[\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder of the session and read it back.

    It cuts the lineage: a lost executor costs the tasks it ran, not the whole chain.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_names(df: DataFrame, names: list[str]) -> list[str]:
    """Names for helper columns that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        found.append(name)
    return found


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), BLANKS)
    return F.filter(parts, lambda w: w != "")


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column of a batch as UTF-8; null becomes no bytes."""
    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [v or b"" for v in column.cast(kind).to_pylist()]


def key_runs(batches: Iterator, key: str) -> Iterator:
    """Pandas frames of one key each, from batches that are sorted by the key.

    Rows of a key that reaches over batches are put together; the caller bounds them.
    """
    import pandas as pd

    held: list = []
    for frame in batches:
        if frame.empty:
            continue
        cut = frame[key].ne(frame[key].shift()).to_numpy().nonzero()[0].tolist()
        if held and held[-1][key].iloc[-1] == frame[key].iloc[0]:
            cut = cut[1:]
            held.append(frame.iloc[: cut[0]] if cut else frame)
            if not cut:
                continue
        if held:
            yield pd.concat(held) if len(held) > 1 else held[0]
        for start, end in zip(cut, cut[1:], strict=False):
            yield frame.iloc[start:end]
        held = [frame.iloc[cut[-1] :]]
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]

