"""Benchmark decontamination: test suffixes looked up in suffix arrays of the corpus.

A task cuts its documents into shards of bounded words and sorts each shard's suffixes.
Every suffix of the benchmark is then found by binary search; the suffixes of the shard
that begin with the same window of words form one range of the array, and windows that
follow each other in both texts join to the longest verbatim matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from debatelens.llm.common import as_bytes, own_names, stored

WINDOW = 10
#: Words of the documents that share one suffix array; a longer document has its own.
SHARD = 1 << 19
#: Bytes of benchmark texts that go to the tasks at once; a larger benchmark takes several passes.
BLOCK = 2 << 20
#: Blocks that one stage applies.
_PASSES = 4
#: Letters, digits and all that is not ASCII, in UTF-8 with A-Z lower-cased.
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return _WORDS.findall(text.lower())


class SuffixArray:
    """Suffixes of a sequence of word numbers, in the order of their first words.

    ``ranks[i]`` orders the suffixes by their first 2**i words (prefix doubling), up to at
    least ``depth`` words. ``keys[i]`` are the sorted different pairs of lower ranks, so a
    rank is a place in them and a binary search in them finds the ranks of any other text.
    """

    def __init__(self, numbers: np.ndarray, depth: int, largest: int) -> None:
        """``numbers`` end with a 0, which no window holds; none is above ``largest``."""
        rank = numbers
        self.keys: list[np.ndarray] = []
        self.bases = [largest + 2]
        width = 1
        while width < depth:
            later = np.zeros_like(rank)
            later[: max(len(rank) - width, 0)] = rank[width:]
            key = rank * self.bases[-1] + later
            unique, rank = np.unique(key, return_inverse=True)
            self.keys.append(unique)
            self.bases.append(len(unique) + 1)
            width *= 2
        self.order = np.argsort(rank, kind="stable")
        self.sorted = rank[self.order]

    def ranges(self, numbers: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window (a start and a length in ``numbers``) the range of the suffixes
        that begin with it; both ends are equal where there is none."""
        low, high = self._bounds(numbers, starts, lengths, len(self.keys))
        return np.searchsorted(self.sorted, low), np.searchsorted(self.sorted, high)

    def _bounds(self, numbers: np.ndarray, starts: np.ndarray, lengths: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Lowest rank, and lowest rank beyond, of the suffixes at ``level`` that begin with each window."""
        if level == 0:
            word = numbers[np.minimum(starts, len(numbers) - 1)]
            open_end = lengths == 0
            return np.where(open_end, 0, word), np.where(open_end, self.bases[0] - 1, word + 1)
        half = 1 << (level - 1)
        first, beyond = self._bounds(numbers, starts, np.minimum(lengths, half), level - 1)
        rest, rest_beyond = self._bounds(numbers, starts + half, np.maximum(lengths - half, 0), level - 1)
        base, keys = self.bases[level - 1], self.keys[level - 1]
        long = lengths > half
        low = np.searchsorted(keys, first * base + np.where(long, rest, 0))
        # a whole first half has one rank or none; then the second half decides
        top = np.where(long & (beyond > first), first * base + rest_beyond, beyond * base)
        return low, np.maximum(low, np.searchsorted(keys, top))


class _Tests(NamedTuple):
    """A block of the benchmark: its words as numbers, its different windows and who has them."""

    vocabulary: dict[bytes, int]
    numbers: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    places: list[list[tuple[int, int]]]
    names: list


def _prepared(items: list[tuple], window: int) -> _Tests:
    vocabulary: dict[bytes, int] = {}
    numbers: list[int] = []
    found: dict[tuple, int] = {}
    starts, lengths, places, names = [], [], [], []
    for name, text in items:
        own = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
        length = min(window, len(own))
        for at in range(len(own) - length + 1 if own else 0):
            key = tuple(own[at : at + length])
            if key not in found:
                found[key] = len(places)
                starts.append(len(numbers) + at)
                lengths.append(length)
                places.append([])
            places[found[key]].append((len(names), at))
        numbers += own
        names.append(name)
    return _Tests(vocabulary, np.array([*numbers, 0]), np.array(starts, np.int64), np.array(lengths, np.int64), places, names)


def _found(texts: list[list[bytes]], tests: _Tests, window: int) -> Iterator[tuple[int, int, int]]:
    """(document, word, window number) of every occurrence of a window in a shard of texts."""
    ends = np.cumsum([len(words) + 1 for words in texts])
    flat: list[bytes] = []
    for words in texts:
        flat += words
        flat.append(b"")
    # words that no test has, and the ends of documents, are 0
    numbers = np.fromiter(map(tests.vocabulary.get, flat, repeat(0)), np.int64, len(flat))
    array = SuffixArray(numbers, window, len(tests.vocabulary))
    low, high = array.ranges(tests.numbers, tests.starts, tests.lengths)
    which = np.repeat(np.arange(len(low)), high - low)
    place = np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[which]
    at = array.order[place]
    document = np.searchsorted(ends, at, side="right")
    word = at - np.concatenate(([0], ends))[document]
    return document, word, which


def _merged(hits: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(item, word of the document, word of the item, words) of the longest matches, from
    the windows (item, word of the item, word of the document, words) of one document."""
    out: list[list[int]] = []
    for item, shift, at, length in sorted((item, at - own, at, length) for item, own, at, length in hits):
        if out and out[-1][:2] == [item, shift] and at <= out[-1][2] + out[-1][3]:
            out[-1][3] = max(out[-1][3], at + length - out[-1][2])
        else:
            out.append([item, shift, at, length])
    return [(item, at, at - shift, length) for item, shift, at, length in out]


_FOUND = ["n_words", "spans", "matches"]
_MATCH = pa.struct([("item", pa.string()), ("at", pa.int64()), ("item_at", pa.int64()), ("n_words", pa.int64())])
_KINDS = [pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(_MATCH)]


def _scanned(rows: DataFrame, tests: _Tests, window: int, shard: int, out: list[str]) -> DataFrame:
    """``rows`` with the number of words, the hit stretches and the longest matches with a block
    of items in place of the last column, the text."""
    shipped = rows.sparkSession.sparkContext.broadcast(tuple(tests))

    def judged(texts: list[list[bytes]]) -> Iterator[tuple]:
        block = _Tests(*shipped.value)
        hits: dict[int, list] = {}
        if len(block.starts):
            document, word, which = _found(texts, block, window)
            for d, at, w in zip(document.tolist(), word.tolist(), which.tolist(), strict=True):
                hits.setdefault(d, []).append((at, w))
        for d, words in enumerate(texts):
            own = hits.get(d, ())
            spans: list[list[int]] = []
            for at, w in sorted(own):
                end = at + int(block.lengths[w])
                if spans and at <= spans[-1][1]:
                    spans[-1][1] = max(end, spans[-1][1])
                else:
                    spans.append([at, end])
            found = _merged([(i, j, at, int(block.lengths[w])) for at, w in own for i, j in block.places[w]])
            matches = [{"item": block.names[i], "at": at, "item_at": j, "n_words": n} for i, at, j, n in found]
            yield len(words), spans, matches

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch, batch.schema.names[-1])
            found: list[tuple] = []
            held: list[list[bytes]] = []
            size = 0
            for text in texts:
                words = words_of(text)
                if held and size + len(words) > shard:
                    found += judged(held)
                    held, size = [], 0
                held.append(words)
                size += len(words)
            found += judged(held) if held else []
            columns = list(zip(*found, strict=True)) or [()] * len(_KINDS)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *map(pa.array, columns, _KINDS)], [*batch.schema.names[:-1], *out]
            )

    types = ["bigint", "array<array<bigint>>", "array<struct<item:string,at:bigint,item_at:bigint,n_words:bigint>>"]
    added = [StructField(n, StructType.fromDDL(f"x {t}")[0].dataType) for n, t in zip(out, types, strict=True)]
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], *added]))


def _blocks(items: DataFrame, id_col: str, text_col: str, block: int) -> Iterator[list[tuple]]:
    """The items in blocks of bounded bytes, read one partition at a time."""
    held, size = [], 0
    rows = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    for row in rows.distinct().toLocalIterator():
        text = row.t.encode()
        if held and size + len(text) > block:
            yield held
            held, size = [], 0
        held.append((row.i, text))
        size += len(text)
    yield held


def _rows_found(
    docs: DataFrame, items: DataFrame, text_col: str, item_id_col: str, item_text_col: str, window: int, shard: int, block: int
) -> tuple[DataFrame, bool]:
    """``docs`` with n_words, spans and matches as its last columns, and whether one pass was
    enough; else only (key, text_hash) with them, equal rows of these as one with ``copies``."""
    rest = _blocks(items, item_id_col, item_text_col, block)
    first, more = next(rest), next(rest, None)
    if more is None:
        return _scanned(docs, _prepared(first, window), window, shard, _FOUND), True
    parts, number = _scanned(docs, _prepared(first, window), window, shard, _FOUND).withColumn("block", F.lit(0)), 0
    while more is not None:
        number += 1
        tests, more = _prepared(more, window), next(rest, None)
        parts = parts.unionByName(_scanned(docs, tests, window, shard, _FOUND).withColumn("block", F.lit(number)))
    once = parts.groupBy("key", "text_hash", "block").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in _FOUND])
    whole = once.groupBy("key", "text_hash").agg(
        F.first("copies").alias("copies"),
        F.first("n_words").alias("n_words"),
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.flatten(F.collect_list("matches")).alias("matches"),
    )
    return whole, False


def benchmark_matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shard: int = SHARD,
    block: int = BLOCK,
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, matches), one row for each row of ``docs``.

    Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. A window
    is ``window`` words of an item, or all words of a shorter one; ``n_hit`` counts the words
    of the document inside any occurrence of a window, ``items`` lists the item ids (as text,
    in order, each once) that have one, ``matches`` the longest verbatim matches: item, first
    word in the document and in the item, number of words. A null text or one without words
    has nothing; a null id is carried along; repeated rows get the same result each. Items
    with a null id count in ``n_hit`` and ``matches`` but have no place in ``items``. Other
    columns are not carried along. Neither table needs rows.

    The items go to the tasks in blocks of at most ``block`` bytes of text (or one item). Each
    further block reads the documents again; what the blocks found meets by id and text hash.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("key"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    found, whole = _rows_found(rows, items, "text", item_id_col, item_text_col, window, shard, block)
    if not whole:
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    # stretches of several blocks may overlap: each counts from where the earlier ones end
    none = F.lit(0).cast("long")
    hit = F.aggregate(
        "spans",
        F.struct(none.alias("n"), none.alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(none, s[1] - F.greatest(a["end"], s[0]))).alias("n"),
            F.greatest(a["end"], s[1]).alias("end"),
        ),
        lambda a: a["n"],
    )
    names = F.sort_array(F.array_distinct(F.array_compact(F.transform("matches", lambda m: m["item"]))))
    return found.select(F.col("key").alias("doc_id"), "n_words", hit.alias("n_hit"), names.alias("items"), F.sort_array("matches").alias("matches"))


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shard: int = SHARD,
    block: int = BLOCK,
) -> DataFrame:
    """``docs`` without the rows whose text holds a window of a benchmark item.

    Ids play no part: a row with a null id or a repeated row stays or goes by its text. The
    columns are those of ``docs``. It is a filter without a shuffle; each further block of items
    is another filter in the same stage, and after several the rows are written and read again.
    """
    columns = docs.columns
    copy, *out = own_names(docs, ["text_copy", *_FOUND])
    for number, part in enumerate(_blocks(items, item_id_col, item_text_col, block)):
        if number and number % _PASSES == 0:
            docs = stored(docs, "clean")
        rows = docs.withColumn(copy, F.col(text_col).cast("string"))
        docs = _scanned(rows, _prepared(part, window), window, shard, out).where(F.size(out[1]) == 0).select(*columns)
    return docs
