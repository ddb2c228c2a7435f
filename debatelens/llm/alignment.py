"""Alignment of two tokenizers over a corpus, with a fast path for equal tokens.

A text's tokens under both are cut where both end, into groups; every token of the one is
linked with every token of the other in its group. Most groups hold one token each way with
the same bytes. A token's counterpart with the same bytes is computed once for the whole
vocabulary, so these groups need no pair: they are counted in a vector as long as the
vocabulary. Only pairs of the other groups are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from debatelens.llm.common import as_bytes, own_names, stored

#: Pairs, the most frequent ones, whose counts every task looks up; the rest is joined.
FREQUENT = 1 << 20
#: Words whose tokens a task keeps.
_WORDS_KEPT = 1 << 18
#: Characters of the texts that are encoded at once.
_AT_ONCE = 1 << 18
# --- Fixed values: how a byte-level BPE cuts texts into words, and the characters that are cut here ---
_BPE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN = r"[\t\n\r\x20-\x7e\xa1-\xff]*"
#: Different pairs that a task counts before it hands them on.
_COUNTED = 1 << 19


@dataclass(frozen=True)
class Tokenizer:
    """A tokenizer file that travels with the tasks.

    ``load`` makes (encode, token bytes) from the file's bytes: encode takes a list of texts
    and gives for each its token ids, and whether they spell a space and the text; the token
    bytes are a list by id.
    """

    content: bytes
    load: Callable[[bytes], tuple[Callable[[list[str]], list[tuple[np.ndarray, bool]]], list[bytes]]]


def _checked(ids: list[int], tokens: list[bytes], text: str) -> tuple[np.ndarray, bool]:
    return np.array(ids, np.int64), b"".join(map(tokens.__getitem__, ids)) == b" " + text.encode()


class _Known:
    """Ids of words that were met, as bytes; a word that its tokens do not spell has none."""

    def __init__(self, learn: Callable[[list[str]], list[list[int]]], tokens: list[bytes]) -> None:
        self.learn, self.tokens = learn, tokens
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.held: dict[str, bytes | None] = {}

    def ids(self, texts: list[list[str]]) -> list[np.ndarray | None]:
        """For each list of words their ids one after another; None if some word has none."""
        held = self.held
        every = set().union(*texts)
        if len(held) + len(every) > _WORDS_KEPT:
            held.clear()
        new = list(every.difference(held))
        if new:
            self._keep(new)
        return [self._joined(words) for words in texts]

    def _keep(self, new: list[str]) -> None:
        found = self.learn(new)
        flat = np.fromiter(chain.from_iterable(found), np.intc)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        starts = np.concatenate(([0], ends[:-1]))
        # bytes behind each word, by its tokens and by itself
        spelt = np.concatenate(([0], np.cumsum(self.lengths[flat])))[ends]
        own = np.cumsum(np.fromiter((len(w.encode()) for w in new), np.int64, len(new)))
        alike = (spelt == own).all() and b"".join(map(self.tokens.__getitem__, flat.tolist())) == "".join(new).encode()
        data, width = flat.tobytes(), flat.itemsize
        for word, ids, i, j in zip(new, found, (starts * width).tolist(), (ends * width).tolist(), strict=True):
            known = alike or b"".join(map(self.tokens.__getitem__, ids)) == word.encode()
            self.held[word] = data[i:j] if known else None

    def _joined(self, words: list[str]) -> np.ndarray | None:
        try:
            return np.frombuffer(b"".join(map(self.held.__getitem__, words)), np.intc).astype(np.int64)
        except TypeError:
            return None


def _encoder(known: _Known, words: Callable[[str], list[str]], whole: Callable[[str], list[int]]) -> Callable:
    """Encodes texts of plain characters by their words, the others whole."""
    import regex

    plain = regex.compile(_PLAIN).fullmatch

    def encode(texts: list[str]) -> list[tuple[np.ndarray, bool]]:
        cut = [words(" " + t) if plain(t) else None for t in texts]
        found = iter(known.ids([w for w in cut if w is not None]))
        out = []
        for text, own in zip(texts, cut, strict=True):
            ids = None if own is None else next(found)
            out.append(_checked(whole(text), known.tokens, text) if ids is None else (ids, True))
        return out

    return encode


def _load_byte_bpe(content: bytes) -> tuple:
    """A word of a text has the same tokens wherever it stands, so a task keeps those of the
    words it has met. Texts with characters whose class might differ between libraries are
    left to the tokenizer as a whole.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from tokenizers import Tokenizer as Loaded

    loaded = Loaded.from_buffer(content)
    loaded.encode_special_tokens = True
    # the byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from U+0100
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}
    vocabulary = loaded.get_vocab()
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for token, number in vocabulary.items():
        known = all(c in byte for c in token)
        tokens[number] = bytes(byte[c] for c in token) if known else token.encode()

    shown = {b: c for c, b in byte.items()}
    model = loaded.model

    def learn(new: list[str]) -> list[list[int]]:
        return [[t.id for t in model.tokenize("".join(map(shown.__getitem__, w.encode())))] for w in new]

    words = regex.compile(_BPE_WORDS).findall
    whole = lambda text: loaded.encode(" " + text, add_special_tokens=False).ids
    return _encoder(_Known(learn, tokens), words, whole), tokens


def _load_pieces(content: bytes) -> tuple:
    from sentencepiece import SentencePieceProcessor

    loaded = SentencePieceProcessor(model_proto=content)
    tokens = []
    for number in range(loaded.get_piece_size()):
        piece = loaded.id_to_piece(number)
        if loaded.is_byte(number):
            tokens.append(bytes([int(piece[3:-1], 16)]))
        else:
            tokens.append(piece.replace("▁", " ").encode())

    def encode(texts: list[str]) -> list[tuple[np.ndarray, bool]]:
        found = loaded.encode(texts, num_threads=1)
        return [_checked(ids, tokens, t) for ids, t in zip(found, texts, strict=True)]

    return encode, tokens


def _content(spark: SparkSession, path: str) -> bytes:
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as file:
        return file.read()


def byte_bpe(spark: SparkSession, path: str) -> Tokenizer:
    """A byte-level BPE of the tokenizers library; texts are encoded behind one space."""
    return Tokenizer(_content(spark, path), _load_byte_bpe)


def pieces(spark: SparkSession, path: str) -> Tokenizer:
    """A sentencepiece model with byte fallback that puts a space before the text itself."""
    return Tokenizer(_content(spark, path), _load_pieces)


def identity_map(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """For each id of ``a`` the largest id of ``b`` with the same bytes, or -1.

    Single bytes have two ids in models with byte fallback, the byte comes before the piece.
    """
    by_bytes = {token: number for number, token in enumerate(b) if token}
    return np.array([by_bytes.get(token, -1) for token in a], np.int64)


class _Pair:
    """Both tokenizers, loaded once in each Python worker."""

    def __init__(self, a: Tokenizer, b: Tokenizer) -> None:
        (self.encode_a, self.bytes_a), (self.encode_b, self.bytes_b) = a.load(a.content), b.load(b.content)
        self.length_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.length_b = np.array([len(t) for t in self.bytes_b], np.int64)
        self.same = identity_map(self.bytes_a, self.bytes_b)
        numbers_a, numbers_b = range(len(self.bytes_a)), range(len(self.bytes_b))
        # a token's digits with what follows it inside a group, and at the end of its side
        self.text_a = np.array([[f"{i}," for i in numbers_a], [f"{i}|" for i in numbers_a]], object)
        self.text_b = np.array([[f"{i}," for i in numbers_b], [f"{i};" for i in numbers_b]], object)


@dataclass(frozen=True)
class _Shipped:
    """Both files as a broadcast; a Python worker loads them once and keeps them with it."""

    files: Broadcast
    load_a: Callable
    load_b: Callable

    def pair(self) -> _Pair:
        held = self.files.value
        if "pair" not in held:
            held["pair"] = _Pair(Tokenizer(held["a"], self.load_a), Tokenizer(held["b"], self.load_b))
        return held["pair"]


def _shipped(spark: SparkSession, a: Tokenizer, b: Tokenizer) -> _Shipped:
    return _Shipped(spark.sparkContext.broadcast({"a": a.content, "b": b.content}), a.load, b.load)


@dataclass(frozen=True)
class Groups:
    """The groups of one text: its tokens, and for each token the number of its group."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    n: int

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The two ids of all links."""
        size_a = np.bincount(self.group_a, minlength=self.n)
        size_b = np.bincount(self.group_b, minlength=self.n)
        # every token of A meets the tokens of B in its group, which are consecutive
        each = size_b[self.group_a]
        start_b = np.cumsum(size_b) - size_b
        total = int(each.sum())
        inner = np.arange(total) - np.repeat(np.cumsum(each) - each, each)
        return np.repeat(self.a, each), self.b[np.repeat(start_b[self.group_a], each) + inner]


def aligned(pair: _Pair, a: tuple[np.ndarray, bool], b: tuple[np.ndarray, bool]) -> Groups | None:
    """The groups of a text's tokens; None if either kind does not spell a space and the text."""
    if not (a[1] and b[1]):
        return None
    end_a, end_b = np.cumsum(pair.length_a[a[0]]), np.cumsum(pair.length_b[b[0]])
    both = np.intersect1d(end_a, end_b, assume_unique=True)
    return Groups(a[0], b[0], np.searchsorted(both, end_a), np.searchsorted(both, end_b), len(both))


def _written(pair: _Pair, g: Groups) -> str:
    """a1,a2|b1;a3|b2,b3 with the ids of each group."""
    last_a = np.append(g.group_a[1:] != g.group_a[:-1], True).astype(np.int64)
    last_b = np.append(g.group_b[1:] != g.group_b[:-1], True).astype(np.int64)
    words = np.concatenate((pair.text_a[last_a, g.a], pair.text_b[last_b, g.b]))
    order = np.argsort(np.concatenate((2 * g.group_a, 2 * g.group_b + 1)), kind="stable")
    return "".join(words[order].tolist())[:-1]


_RESULT = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
_JUDGED = ["n_best", "count_sum", "pairs", "times"]
_COLUMNS = {
    "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(),
    "same": pa.binary(), "same_times": pa.binary(), "pairs": pa.binary(), "times": pa.binary(),
}


class _Packed:
    """Pairs of ids as single numbers, kept in as few bytes as hold them all."""

    def __init__(self, pair: _Pair) -> None:
        self.width = len(pair.bytes_b)
        small = len(pair.bytes_a) * self.width < 1 << 32
        self.kind = np.dtype("<u4") if small else np.dtype("<u8")

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * self.width + b


def _encoded(pair: _Pair, texts: list[bytes]) -> Iterator[tuple[bytes, tuple, tuple]]:
    """Each text with its tokens, some texts at a time."""
    start, size = 0, 0
    for i, text in enumerate(texts, 1):
        size += len(text)
        if size >= _AT_ONCE or i == len(texts):
            strings = [t.decode() for t in texts[start:i]]
            yield from zip(texts[start:i], pair.encode_a(strings), pair.encode_b(strings), strict=True)
            start, size = i, 0


def _tokenised(rows: DataFrame, shipped: _Shipped) -> DataFrame:
    """For each row its counts, and its different links with how often it has them: those of
    equal tokens by their id of A alone (``same``), all others as packed pairs (``pairs``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = shipped.pair()
        packed = _Packed(pair)
        for batch in batches:
            texts = as_bytes(batch, batch.schema.names[-1])
            out = []
            for text, a, b in _encoded(pair, texts):
                groups = aligned(pair, a, b) if text else None
                if groups is None:
                    out.append((0, 0, 0, 0, "", b"", b"", b"", b""))
                    continue
                link_a, link_b = groups.links()
                equal = pair.same[link_a] == link_b
                same, same_times = np.unique(link_a[equal], return_counts=True)
                others, times = np.unique(packed.of(link_a[~equal], link_b[~equal]), return_counts=True)
                digest = sha256(_written(pair, groups).encode()).hexdigest()
                data = (x.astype(k).tobytes() for x, k in ((same, "<u4"), (same_times, "<u4"), (others, packed.kind), (times, "<u4")))
                out.append((len(groups.a), len(groups.b), groups.n, len(link_a), digest, *data))
            columns = list(zip(*out, strict=True)) or [()] * len(_COLUMNS)
            arrays = [pa.array(c, t) for c, (_, t) in zip(columns, _COLUMNS.items(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], [*batch.schema.names[:-1], *_COLUMNS])

    kinds = ["long"] * 4 + ["string"] + ["binary"] * 4
    added = StructType.fromDDL(", ".join(map("{} {}".format, _COLUMNS, kinds)))
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], *added.fields]))


def _pair_counts(tokens: DataFrame, shipped: _Shipped) -> tuple[np.ndarray, DataFrame]:
    """How many rows have each link: of equal tokens by A id in a vector, of others (pair, n).

    Each task adds up a vector as long as the vocabulary, and its other pairs.
    """

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shipped.pair().bytes_a), np.int64)
        for batch in batches:
            held = b"".join(batch.column(0).to_pylist())
            total += np.bincount(np.frombuffer(held, "<u4"), minlength=len(total))
        a = total.nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(total[a])], ["a", "n"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _Packed(shipped.pair()).kind
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            held = np.frombuffer(b"".join(batch.column(0).to_pylist()), kind).astype(np.int64)
            fresh, n = np.unique(held, return_counts=True)
            keys, where = np.unique(np.concatenate((keys, fresh)), return_inverse=True)
            counts = np.bincount(where, np.concatenate((counts, n)), len(keys)).astype(np.int64)
            if len(keys) > _COUNTED:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])
                keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])

    # no more rows than the vocabulary has
    vector = np.zeros(len(shipped.pair().bytes_a), np.int64)
    for a, n in tokens.select("same").mapInArrow(same, "a long, n long").groupBy("a").agg(F.sum("n")).collect():
        vector[a] = n
    counted = tokens.select("pairs").mapInArrow(others, "pair long, n long")
    return vector, counted.groupBy("pair").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> int:
    """The smallest power of two that at most ``most`` pairs reach in their count."""
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).count().collect()
    held = 0
    for e, n in sorted(((r[0], r[1]) for r in sizes), reverse=True):
        if held + n > most:
            return 1 << (e + 1)
        held += n
    return 1


def token_pairs(docs: DataFrame, a: Tokenizer, b: Tokenizer, text_col: str = "text") -> DataFrame:
    """(a, b, n): for every pair of token ids that are linked, how many rows of ``docs`` link them."""
    spark = docs.sparkSession
    shipped = _shipped(spark, a, b)
    pair = shipped.pair()
    tokens = stored(_tokenised(docs.select(F.col(text_col).cast("string").alias("text")), shipped), "tokens")
    vector, others = _pair_counts(tokens, shipped)
    rows = [(int(x), int(pair.same[x]), int(vector[x])) for x in vector.nonzero()[0]]
    width = len(pair.bytes_b)
    rest = others.select(F.expr(f"pair div {width}").alias("a"), (F.col("pair") % width).alias("b"), "n")
    return spark.createDataFrame(rows, "a long, b long, n long").unionByName(rest)


def align_tokens(
    docs: DataFrame, a: Tokenizer, b: Tokenizer, text_col: str = "text", frequent: int = FREQUENT
) -> DataFrame:
    """``docs`` without the text, with how its tokens under ``a`` and ``b`` meet.

    Adds n_a and n_b (tokens), n_groups, n_links (pairs of occurrences inside a group), n_best
    (links whose pair has the highest count of all pairs of its A id, ties included), count_sum
    (the counts of its links added up) and groups_sha256 (of ``a1,a2|b1;a3|b2,b3``). The count
    of a pair is the number of rows that link it; repeated rows count each. A text that is null
    or empty, or whose tokens of either kind do not spell a space and the text, has zeros and ''.
    New columns take an underscore where ``docs`` has the name. An empty table gives no rows.

    The counts of the ``frequent`` most frequent pairs (fewer, if there are ties) go to every
    task; a pair below them has few rows, and only those rows are shuffled to meet its count.
    """
    spark = docs.sparkSession
    shipped = _shipped(spark, a, b)
    pair = shipped.pair()
    kept = [c for c in docs.columns if c.lower() != text_col.lower()]
    named = own_names(docs, _RESULT)
    carried = [F.col(c).alias(f"c{i}") for i, c in enumerate(kept)]
    numbered = docs.select(*carried, F.col(text_col).cast("string").alias("text"))
    tokens = stored(_tokenised(numbered, shipped), "tokens")
    vector, others = _pair_counts(tokens, shipped)
    others = stored(others, "pair-counts")

    width = len(pair.bytes_b)
    best = vector.copy()
    # one row for each A id at most
    for x, n in others.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("n")).collect():
        best[x] = max(best[x], n)
    least = _frequent(others, frequent)
    rows = others.where(F.col("n") >= least).toPandas().sort_values("pair")
    looked = spark.sparkContext.broadcast((vector, best, rows["pair"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _Packed(shipped.pair()).kind
        vector, best, keys, counts = looked.value
        for batch in batches:
            same, same_times, pairs, times = (batch.column(i).to_pylist() for i in range(len(kept) + 5, len(kept) + 9))
            out = []
            for s, st, p, t in zip(same, same_times, pairs, times, strict=True):
                s, st, t = (np.frombuffer(x, "<u4").astype(np.int64) for x in (s, st, t))
                p = np.frombuffer(p, kind).astype(np.int64)
                at = np.minimum(np.searchsorted(keys, p), max(len(keys) - 1, 0))
                known = keys[at] == p if len(keys) else np.zeros(len(p), bool)
                n = counts[at[known]]
                n_best = st[vector[s] == best[s]].sum() + t[known][n == best[p[known] // width]].sum()
                total = (st * vector[s]).sum() + (t[known] * n).sum()
                out.append((int(n_best), int(total), p[~known].tolist(), t[~known].tolist()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept) + 5], *map(pa.array, columns, kinds)], [*batch.schema.names[: len(kept) + 5], *_JUDGED]
            )

    added = StructType.fromDDL("n_best long, count_sum long, pairs array<long>, times array<long>")
    first = tokens.mapInArrow(judged, StructType([*tokens.schema.fields[: len(kept) + 5], *added.fields]))
    result = [F.col(f"c{i}").alias(c) for i, c in enumerate(kept)] + [F.col(c).alias(n) for c, n in zip(_RESULT, named, strict=True)]
    if least == 1:
        return first.select(*result)
    first = stored(first.withColumn("row", F.monotonically_increasing_id()), "judged")
    rare = first.where(F.size("pairs") > 0)
    rare = rare.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
    tops = spark.createDataFrame([(int(x), int(n)) for x, n in enumerate(best) if n], "a long, top long")
    found = others.where(F.col("n") < least).withColumn("a", F.expr(f"pair div {width}")).join(F.broadcast(tops), "a")
    met = rare.join(found, rare["pairs"] == found["pair"]).groupBy("row").agg(
        F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("n") * F.col("times")).alias("more_sum"),
    )
    whole = first.join(met, "row", "left")
    for name, more in (("n_best", "more_best"), ("count_sum", "more_sum")):
        whole = whole.withColumn(name, F.col(name) + F.coalesce(F.col(more), F.lit(0).cast("long")))
    return whole.select(*result)
