"""Best-fit packing of documents into training sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from debatelens.llm.common import as_bytes

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Words and pieces that are packed together; what a task holds is bounded by them.
BLOCK_WORDS = 4_000_000
BLOCK_PIECES = 100_000


def sequence_cost(capacity: int) -> float:
    """Cost of a sequence: its words, attention between them, and a fixed part."""
    return capacity + capacity * capacity / 8192 + 128


def _fill(lengths: Sequence[int], order: Sequence[int], choose: dict[int, int]) -> list[list[int]]:
    """Best fit: each piece goes where the least room is left over, whatever the bin's
    size; if it fits nowhere, the chosen size for its length is opened."""
    sizes = sorted(choose)
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i in order:
        need = lengths[i]
        at = bisect_left(rooms, (need, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = choose[sizes[bisect_left(sizes, need)]], len(bins)
            bins.append([])
        bins[b].append(i)
        insort(rooms, (room - need, b))
    return bins


def pack(
    lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, cost=sequence_cost
) -> list[tuple[int, list[int]]]:
    """(capacity, piece numbers) of each bin, longest pieces first.

    A bin that must be opened gets, of the permitted sizes that hold the piece, the one
    of least cost per word. That is tried with every size as the least that is opened,
    and the cheapest packing stays. In each, bins end as the cheapest size that holds
    what they got.
    """
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    sizes = sorted(capacities)
    best: tuple[float, list] | None = None
    for least in sizes:
        choose = {c: min((d for d in sizes if d >= max(c, least)), key=lambda d: (cost(d) / d, -d)) for c in sizes}
        bins = []
        for pieces in _fill(lengths, order, choose):
            used = sum(lengths[i] for i in pieces)
            bins.append((min((c for c in sizes if c >= used), key=lambda c: (cost(c), c)), pieces))
        price = sum(cost(c) for c, _ in bins)
        if best is None or price < best[0]:
            best = price, bins
    return best[1] if best else []


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacities: Sequence[int] = CAPACITIES,
    cost=sequence_cost,
    texts: bool = True,
    block_words: int = BLOCK_WORDS,
    block_pieces: int = BLOCK_PIECES,
) -> DataFrame:
    """One row per sequence: sequence_id, capacity, n_words, and per piece in ``doc_ids``,
    ``starts`` (first word), ``lengths`` (words) and ``texts`` (null unless asked for).

    Lengths are words. A text longer than the largest capacity is cut into pieces of that
    size and a rest, their words joined by one space; other texts stay as they are. A text
    without words (or null) is a piece of length 0 and takes no room. Each task packs its
    rows in blocks of bounded size, so there is no shuffle and no bin depends on another
    task. Repeated rows are packed as often as they come, a null id stays null, other
    columns are ignored, an empty table gives no rows.
    """
    largest = max(capacities)

    def bins(block: list[tuple], first: int) -> pa.RecordBatch:
        packed = pack([n for _, _, n, _ in block], capacities, cost)
        rows = [
            (first + k, c, sum(block[i][2] for i in pieces), *map(list, zip(*(block[i] for i in pieces), strict=True)))
            for k, (c, pieces) in enumerate(packed)
        ]
        ids, sizes, words, docs_, starts, lengths, text = zip(*rows, strict=True)
        columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(words, pa.int64())]
        columns += [pa.array(docs_, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64())), pa.array(lengths, pa.list_(pa.int64()))]
        columns.append(pa.array(text if texts else [None] * len(rows), pa.list_(pa.string())))
        return pa.RecordBatch.from_arrays(columns, ["sequence_id", "capacity", "n_words", "doc_ids", "starts", "lengths", "texts"])

    def pieces(doc_id: int | None, text: bytes) -> Iterator[tuple]:
        words = text.split()
        if len(words) <= largest:
            yield doc_id, 0, len(words), text.decode() if texts else None
            return
        for at in range(0, len(words), largest):
            part = words[at : at + largest]
            yield doc_id, at, len(part), b" ".join(part).decode() if texts else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        block: list[tuple] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch, "text"), strict=True):
                for piece in pieces(doc_id, text):
                    if block and (held + piece[2] > block_words or len(block) >= block_pieces):
                        yield (done := bins(block, number))
                        number += len(done)
                        block, held = [], 0
                    block.append(piece)
                    held += piece[2]
        if block:
            yield bins(block, number)

    schema = "sequence_id long, capacity int, n_words long, doc_ids array<long>, starts array<long>, lengths array<long>, texts array<string>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
