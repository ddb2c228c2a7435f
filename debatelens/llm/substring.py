"""Removal of long passages that an earlier document holds, by suffix automata.

The reference is the corpus itself, so its automata cannot all go past every document:
that work would grow with the square of the corpus. Instead every window of
``least`` words names its smallest gram as its anchor, equal windows name equal
anchors, and the reference is cut into shards by anchor. A document's passages are
streamed through the automata of the shards that its shared anchors name, and of no
others. Anchors that stand in very many passages are cut further, by whole window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import compress, groupby
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from debatelens.llm.common import as_bytes, own_names, stored

LEAST = 50
GRAM = 10
#: Passages with one anchor that one automaton holds; anchors with more are cut by window.
SHARD = 4096


class SuffixAutomaton:
    """Suffix automaton over the words of several passages."""

    def __init__(self) -> None:
        self.step: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]

    def _state(self, size: int, step: dict, link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state that ``p`` reaches by ``word`` when ``q`` also holds longer strings."""
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._state(self.size[p] + 1, dict(self.step[q]), self.link[q])
        while p != -1 and self.step[p].get(word) == q:
            self.step[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: Iterable[bytes]) -> None:
        last = 0
        for word in words:
            if word in self.step[last]:
                last = self._split(last, word, self.step[last][word])
                continue
            new = self._state(self.size[last] + 1, {}, 0)
            p = last
            while p != -1 and word not in self.step[p]:
                self.step[p][word] = new
                p = self.link[p]
            if p != -1:
                self.link[new] = self._split(p, word, self.step[p][word])
            last = new

    def spans(self, words: list[bytes], least: int) -> list[tuple[int, int]]:
        """Maximal spans covered by matches of at least ``least`` words, from the
        matching statistics: at each word the longest match that ends there."""
        state, length, found = 0, 0, []
        for end, word in enumerate(words, 1):
            while state and word not in self.step[state]:
                state = self.link[state]
                length = self.size[state]
            if word in self.step[state]:
                state = self.step[state][word]
                length += 1
            if length >= least:
                start = end - length
                while found and found[-1][1] >= start:
                    start = min(start, found.pop()[0])
                found.append((start, end))
        return found


def window_anchors(words: list[bytes], least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) of the runs of windows with one anchor.

    The anchor of a window is the smallest hash among its grams, so it depends on the
    words of the window only.
    """
    if len(words) < least:
        return (np.zeros(0, np.int64),) * 3
    each = np.fromiter(map(crc32, words), np.uint64, len(words)) * np.uint64(0x9E3779B97F4A7C15)
    each ^= each >> np.uint64(29)
    n = len(words) - gram + 1
    value = np.zeros(n, np.uint64)
    for i in range(gram):
        value = value * np.uint64(0xD1342543DE82EF95) + each[i : i + n]
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(31)
    wide, width = value, 1
    while width < least - gram + 1:
        more = min(width, least - gram + 1 - width)
        wide = np.minimum(wide[:-more], wide[more:])
        width += more
    first = np.concatenate(([0], (wide[1:] != wide[:-1]).nonzero()[0] + 1))
    last = np.concatenate((first[1:] - 1, [len(wide) - 1]))
    return wide[first].view(np.int64), first, last


def _anchors(rows: DataFrame, least: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [window_anchors(t.split(), least, gram) for t in as_bytes(batch, "text")]
            each = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            keys = batch.select(["doc_id", "text_hash"]).take(pa.array(each))
            if len(each):
                anchor, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*keys.columns, pa.array(anchor), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                    ["doc_id", "text_hash", "anchor", "first", "last"],
                )

    return rows.mapInArrow(run, "doc_id long, text_hash long, anchor long, first int, last int")


def _passages(marked: DataFrame, least: int) -> DataFrame:
    """Passages of shared anchors: with their words, or of crowded anchors as 128 bits of
    the whole and of each window."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("at", pa.int32()),
        ("key", pa.int64()), ("key2", pa.int64()), ("passage", pa.binary()), ("windows", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            out: list[tuple] = []
            ids, hashes = (batch.column(i).to_pylist() for i in (0, 1))
            texts = as_bytes(batch, "text")
            for i, marks in enumerate(batch.column(3)):
                words = texts[i].split()
                for mark in marks.as_py():
                    first, last = mark["first"], mark["last"]
                    passage = b" ".join(words[first : last + least])
                    if not mark["crowded"]:
                        out.append((ids[i], hashes[i], first, mark["anchor"], None, passage, None))
                        continue
                    windows = b"".join(xxh3_128_digest(b" ".join(words[at : at + least])) for at in range(first, last + 1))
                    out.append((ids[i], hashes[i], first, *_halves(xxh3_128_digest(passage)), None, windows))
                if len(out) >= 1 << 16:
                    yield _batch(out, schema)
                    out = []
            yield _batch(out, schema)

    kind = "doc_id long, text_hash long, at int, key long, key2 long, passage binary, windows binary"
    return marked.select("doc_id", "text_hash", "text", "marks").mapInArrow(run, kind)


def _halves(digest: bytes) -> list[int]:
    return np.frombuffer(digest, "<i8").tolist()


def _cut(passages: DataFrame, every: int) -> DataFrame:
    """Passages cut into stretches of ``every`` windows on average, or single windows.

    A stretch begins at a window whose content says so, so that equal runs of windows are
    cut alike wherever they stand.
    """
    names = ["doc_id", "text_hash", "at", "key", "key2", "windows"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            out = []
            for doc_id, text_hash, at, windows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = np.frombuffer(windows, "<u8")[::2]
                cuts = [0, *((first[1:] % every == 0).nonzero()[0] + 1).tolist(), len(first)]
                for i, j in zip(cuts, cuts[1:], strict=False):
                    part = windows[16 * i : 16 * j]
                    key = part if j == i + 1 else xxh3_128_digest(part)
                    out.append((doc_id, text_hash, at + i, *_halves(key), part))
                if len(out) >= 1 << 16:
                    yield _batch(out, schema)
                    out = []
            yield _batch(out, schema)

    kind = "doc_id long, text_hash long, at int, key long, key2 long, windows binary"
    return passages.select("doc_id", "text_hash", "at", "windows").mapInArrow(run, kind)


def _crowded_spans(passages: DataFrame, least: int) -> DataFrame:
    """Spans of crowded passages, by content instead of an automaton.

    A passage whose whole content a smaller doc_id has goes as a whole. Of each content
    the smallest doc_id stays to be compared in short stretches, and then window by
    window, so copies cost one row and their small changes few.
    """
    spans = None
    for every in (4, 1, 0):
        low = passages.groupBy("key", "key2").agg(F.min("doc_id").alias("low"))
        known = passages.join(low, ["key", "key2"])
        end = F.col("at") + F.octet_length("windows") / 16 + (least - 1)
        gone = known.where("low < doc_id")
        gone = gone.select("doc_id", "text_hash", F.col("at").alias("start"), end.cast("int").alias("end"))
        spans = gone if spans is None else spans.unionByName(gone)
        if every:
            passages = _cut(known.where("low = doc_id"), every)
    return spans


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _shard_spans(rows: Iterable[tuple], least: int) -> Iterator[tuple[int, int, int, int]]:
    """Spans of one shard's passages that a passage with a smaller doc_id holds.

    ``rows`` are (doc_id, text_hash, at, passage), by doc_id. The automaton holds the
    passages of smaller ids; it is built when the first passage unlike them comes.
    """
    automaton, waiting, seen = SuffixAutomaton(), [], set()
    for doc_id, own in groupby(rows, itemgetter(0)):
        fresh = []
        for _, text_hash, at, passage in own:
            if passage in seen:
                yield doc_id, text_hash, at, at + passage.count(b" ") + 1
                continue
            fresh.append(passage)
            if not seen:
                continue
            for before in waiting:
                automaton.add(before.split(b" "))
            waiting = []
            for start, end in automaton.spans(passage.split(b" "), least):
                yield doc_id, text_hash, at + start, at + end
        for passage in fresh:
            if passage not in seen:
                seen.add(passage)
                waiting.append(passage)


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM, shard: int = SHARD
) -> DataFrame:
    """(doc_id, text_hash, spans): for documents with words to remove, the spans of word
    positions covered by windows of ``least`` words that start in a smaller doc_id."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    rows = rows.where("doc_id is not null")
    anchors = stored(_anchors(rows, least, gram), "anchors")
    shared = (
        anchors.groupBy("anchor")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .where("low < high")
        .select("anchor", (F.col("n") > shard).alias("crowded"))
    )
    marks = anchors.join(shared, "anchor").groupBy("doc_id", "text_hash")
    marks = marks.agg(F.collect_set(F.struct("anchor", "first", "last", "crowded")).alias("marks"))
    passages = stored(_passages(rows.join(marks, ["doc_id", "text_hash"]), least), "passages")

    names = ["doc_id", "text_hash", "start", "end"]
    spans_schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple] = []
        for _, group in groupby(rows, itemgetter(0)):
            out += _shard_spans((row[1:] for row in group), least)
            if len(out) >= 1 << 16:
                yield _batch(out, spans_schema)
                out = []
        yield _batch(out, spans_schema)

    kind = "doc_id long, text_hash long, start int, end int"
    few = passages.where("passage is not null").select("key", "doc_id", "text_hash", "at", "passage")
    near = few.repartition("key").sortWithinPartitions("key", "doc_id", "at").mapInArrow(run, kind)
    many = passages.where("windows is not null").select("key", "key2", "doc_id", "text_hash", "at", "windows")
    wide = _crowded_spans(many, least)
    spans = near.unionByName(wide).groupBy("doc_id", "text_hash")
    return spans.agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", joined: bool = False, least: int = LEAST, **options
) -> DataFrame:
    """``docs`` with repeated passages cut out of the text, plus ``n_words`` and ``n_removed``.

    A word goes when a window of ``least`` words that covers it also starts in a document
    with a smaller id; windows are judged on the texts as given. A text that loses words
    becomes its kept words joined by one space; others stay as they are, or are joined
    the same way with ``joined``. A null text has no words (and becomes empty only with
    ``joined``). A null id neither loses words nor takes any. Rows with one id never take
    words from each other; repeated rows get the same result. Other columns are carried
    along; if they clash with the two new names, the new ones get an underscore. An
    empty table gives no rows.
    """
    found = repeated_spans(docs, id_col, text_col, least, **options)
    h, spans, n_words, n_removed = own_names(docs, ["text_hash", "spans", "n_words", "n_removed"])
    span_id, span_hash = own_names(docs, ["span_id", "span_hash"])
    found = found.select(F.col("doc_id").alias(span_id), F.col("text_hash").alias(span_hash), F.col("spans").alias(spans))
    rows = docs.withColumn(h, F.xxhash64(F.col(text_col)))
    same = (F.col(id_col).cast("long") == F.col(span_id)) & (F.col(h) == F.col(span_hash))
    rows = rows.join(found, same, "left").select(*docs.columns, spans)
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    keep = docs.columns

    def cut(text: bytes | None, spans: list | None) -> tuple[bytes | None, int, int]:
        words = (text or b"").split()
        if spans:
            stay = np.ones(len(words), bool)
            for x in spans:
                stay[x["start"] : x["end"]] = False
            left = list(compress(words, stay.tolist()))
            return b" ".join(left), len(words), len(words) - len(left)
        return b" ".join(words) if joined else text, len(words), 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            binary = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
            rows = [cut(t, x) for t, x in zip(column.cast(binary).to_pylist(), batch.column(len(keep)).to_pylist(), strict=True)]
            text, n, removed = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [*batch.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(removed, pa.int64())]
            columns[at] = pa.array(text, binary).cast(column.type)
            yield pa.RecordBatch.from_arrays(columns, [*keep, n_words, n_removed])

    counts = [StructField(n_words, LongType()), StructField(n_removed, LongType())]
    return rows.mapInArrow(run, StructType([*docs.schema.fields, *counts]))
