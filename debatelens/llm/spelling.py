"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

Level 0 of the trie is a word's length, each further level the count of one letter group.
An edit of one code point changes the counts by a surplus of one, a deficit of one, or one
of each, so a word that looks for its neighbours descends with that budget: along its own
count, or one beside it. The upper part of the trie is descended by joins, every word that
looks going to all subtries that its budget reaches, until a subtrie fits a task; the task
walks the rest depth first and compares the words in the leaves.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from debatelens.llm.common import as_bytes, key_runs, stored
from debatelens.scale import join_lookup

#: Letter groups; a letter's group is its code point modulo this.
GROUPS = 26
#: Words of a subtrie that one task walks; larger ones are descended further.
HOMES = 8192
#: Words that look into such a subtrie, for each word that it may hold.
LOOKS = 8
#: Levels that are descended before subtries are counted again.
STEPS = 2
#: Words below which a branch of the trie is a leaf.
LEAF = 16
#: Cells of a comparison in a leaf that are held at once.
_CELLS = 1 << 24
#: Distinct words that a task counts before it hands them on.
_COUNTED = 1 << 19
_RUNS = re.compile(rb"[a-z\xc0-\xff]+")

# What a row does in a subtrie: its word lives there, or looks for words of its own length
# (nothing spent, surplus spent, both spent) or one shorter (nothing spent, surplus spent).
_HOME, _EQUAL, _MORE, _BOTH, _LONGER, _SPENT = range(-1, 5)


def counted_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_every: int | None = None, least: int = 1
) -> DataFrame:
    """(word, n): the maximal runs of letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased.

    With ``drop_every`` a run loses the code point at h % length where h, the CRC-32 of
    "<id>:<run>", is a multiple of it: misspellings that depend on the document only. Runs
    of fewer than ``least`` code points are left out afterwards. A null text has no runs, a
    null id counts as an empty one. Each task adds up its words before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def taken() -> pa.RecordBatch:
            kept = [(w.decode("latin-1"), n) for w, n in total.items() if n > 0 and len(w) >= least]
            total.clear()
            words, counts = zip(*kept, strict=True) if kept else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

        for batch in batches:
            for key, text in zip(as_bytes(batch, "key"), as_bytes(batch, "text"), strict=True):
                # one byte for each code point; those beyond U+00FF are no letters here
                words = _RUNS.findall(text.decode().encode("latin-1", "replace").lower())
                total.update(words)
                start = crc32(key + b":")
                for word in set(words) if drop_every else ():
                    h = crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                    if h % drop_every == 0:
                        n, at = words.count(word), h % len(word)
                        total[word] -= n
                        total[word[:at] + word[at + 1 :]] += n
                if len(total) > _COUNTED:
                    yield taken()
        yield taken()

    rows = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def group_counts(codes: np.ndarray, order: list[int]) -> np.ndarray:
    """How many letters of each group every row holds, groups in the given order."""
    place = np.empty(GROUPS, np.int64)
    place[order] = np.arange(GROUPS)
    groups = place[codes % GROUPS]
    rows = np.arange(len(codes))
    counts = np.zeros((len(codes), GROUPS), np.int32)
    for j in range(codes.shape[1]):
        counts[rows, groups[:, j]] += 1
    return counts


def _replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` differ from which rows of ``b`` in exactly one place."""
    return (a[:, None] != b[None]).sum(-1) == 1


def _inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` are which rows of ``b`` with one more code point."""
    head = np.logical_and.accumulate(a[:, None, :-1] == b[None], axis=-1).sum(-1)
    tail = np.logical_and.accumulate((a[:, None, 1:] == b[None])[..., ::-1], axis=-1).sum(-1)
    return head + tail >= b.shape[1]


def subtrie_links(
    homes: list[str], looks: list[str], states: np.ndarray, level: int, order: list[int], leaf: int = LEAF
) -> Iterator[tuple[int, int]]:
    """(home, look) of the words one edit apart, each pair once.

    All ``homes`` have one length and equal counts above ``level``. The walk goes depth
    first; with it go the words that look and still have the budget for the branch.
    """
    codes = _codes(homes)
    counts = group_counts(codes, order)
    sort = np.lexsort(counts[:, ::-1].T)
    codes, counts = codes[sort], counts[sort]
    long = states >= _LONGER
    look_codes, look_counts = [np.zeros((len(looks), 0))] * 2, np.zeros((len(looks), GROUPS), np.int32)
    row = np.zeros(len(looks), np.int64)
    for kind in (0, 1):
        which = (long == kind).nonzero()[0]
        if len(which):
            look_codes[kind] = _codes([looks[i] for i in which])
            look_counts[which] = group_counts(look_codes[kind], order)
            row[which] = np.arange(len(which))

    def compared(first: int, last: int, which: np.ndarray, state: np.ndarray, depth: int) -> Iterator[tuple[int, int]]:
        step = max(1, _CELLS // ((last - first) * codes.shape[1]))
        for kind, near in ((0, _replaced), (1, _inserted)):
            own = (state >= _LONGER) == kind
            mine, spent = which[own], state[own]
            for at in range(0, len(mine), step):
                part = mine[at : at + step]
                for i, j in zip(*near(look_codes[kind][row[part]], codes[first:last]).nonzero(), strict=True):
                    look, home = int(part[i]), first + int(j)
                    if spent[at + i] == _EQUAL:  # the other word looks too: the greater one finds the pair
                        mine_first = (look_counts[look, depth:].tolist(), looks[look])
                        if mine_first < (counts[home, depth:].tolist(), homes[sort[home]]):
                            continue
                    yield int(sort[home]), look

    stack = [(0, len(homes), level, np.arange(len(looks)), states)]
    while stack:
        first, last, depth, which, state = stack.pop()
        if not len(which):
            continue
        if depth == GROUPS or last - first <= leaf:
            yield from compared(first, last, which, state, depth)
            continue
        column = counts[first:last, depth]
        cuts = [0, *((column[1:] != column[:-1]).nonzero()[0] + 1).tolist(), last - first]
        own = look_counts[which, depth]
        for i, j in zip(cuts, cuts[1:], strict=False):
            over = own - column[i]
            surplus = (over == 1) & ((state == _EQUAL) | (state == _LONGER))
            deficit = (over == -1) & (state == _MORE)
            alive = (over == 0) | surplus | deficit
            after = np.where(over == 0, state, state + 1)
            stack.append((first + i, first + j, depth + 1, which[alive], after[alive]))


def _descended(rows: DataFrame, level: int) -> DataFrame:
    """Rows one level deeper, in every branch that their budget reaches."""
    count, state = F.get("counts", F.lit(level)), F.col("state")

    def branch(shift: int, after: Column) -> Column:
        return F.struct((count + shift).alias("count"), after.cast("int").alias("state"))

    fewer = F.when(state.isin(_EQUAL, _LONGER) & (count > 0), branch(-1, state + 1))
    more = F.when(state == _MORE, branch(1, state + 1))
    ways = F.explode(F.array_compact(F.array(branch(0, state), fewer, more)))
    spread = rows.withColumn("way", ways)
    path = F.concat_ws(".", "path", F.col("way.count").cast("string"))
    return spread.select(path.alias("path"), F.col("way.state").alias("state"), "word", "n", "counts")


def _with_counts(words: DataFrame, order: list[int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            counts = np.zeros((len(texts), GROUPS), np.int32)
            for length in np.unique(lengths):
                which = (lengths == length).nonzero()[0]
                if length:
                    counts[which] = group_counts(_codes([texts[i] for i in which]), order)
            lists = pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * GROUPS, pa.array(counts.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["word", "n", "counts"])

    return words.mapInArrow(run, "word string, n long, counts array<int>")


def _crowded_links(rows: DataFrame) -> DataFrame:
    """Links within leaves too large for a task, by the words with one place left out.

    A place with what surrounds it is shared by no more words than there are letters.
    """
    at = F.sequence(F.lit(1), F.char_length("word"))
    rest = lambda i: F.concat(F.col("word").substr(F.lit(1), i - 1), F.col("word").substr(i + 1, F.char_length("word")))
    placed = F.transform(at, lambda i: F.struct(i.alias("at"), rest(i).alias("rest")))
    shorter = F.transform(F.array_distinct(F.transform(at, rest)), lambda w: F.struct(F.lit(0).alias("at"), w.alias("rest")))
    itself = F.array(F.struct(F.lit(0).alias("at"), F.col("word").alias("rest")))
    is_home, is_long = F.col("state") == _HOME, F.col("state") >= _LONGER
    keyed = rows.withColumn("key", F.explode(F.when(is_home, F.concat(itself, placed)).when(is_long, shorter).otherwise(placed)))
    keyed = keyed.select("path", "state", "word", "n", "key.at", "key.rest")
    homes = keyed.where(is_home).select("path", "at", "rest", F.col("word").alias("a"), F.col("n").alias("na"))
    looks = keyed.where(~is_home).select("path", "at", "rest", "state", F.col("word").alias("b"), F.col("n").alias("nb"))
    both = homes.join(looks, ["path", "at", "rest"]).where((F.col("state") != _EQUAL) | F.expr("b > a"))
    return both.select("a", "na", "b", "nb")


def near_words(words: DataFrame, homes: int = HOMES, steps: int = STEPS) -> DataFrame:
    """(a, na, b, nb): all pairs of different words one inserted, deleted or replaced code
    point apart, each once in either order, with their counts.

    ``words`` has the columns word and n, no word twice. Null and empty words have no near ones.
    """
    plain = words.select("word", F.col("n").cast("long").alias("n")).where("word <> ''")
    plain = stored(_with_counts(plain, list(range(GROUPS))), "words")
    sums = [F.avg(F.get("counts", F.lit(g)).cast("double") ** k) for g in range(GROUPS) for k in (1, 2)]
    means = plain.agg(*sums).first()
    spread = [-((means[2 * g + 1] or 0) - (means[2 * g] or 0) ** 2) for g in range(GROUPS)]
    # the counts that tell words apart best come first
    order = sorted(range(GROUPS), key=lambda g: (spread[g], g))
    sorted_counts = F.array(*[F.get("counts", F.lit(g)) for g in order])
    length = F.char_length("word")
    starts = [F.struct(length.alias("at"), F.lit(s).alias("state")) for s in (_HOME, _EQUAL)]
    starts.append(F.struct((length - 1).alias("at"), F.lit(_LONGER).alias("state")))
    rows = plain.select("word", "n", sorted_counts.alias("counts"), F.explode(F.array(*starts)).alias("s"))
    rows = rows.select(F.col("s.at").cast("string").alias("path"), "s.state", "word", "n", "counts")

    here, links, level, small = F.col("state") == _HOME, None, 0, []
    while True:
        nodes = rows.groupBy("path").agg(
            F.count_if(here).alias("homes"),
            F.count_if(~here).alias("looks"),
        )
        large = (F.col("homes") > homes) | (F.col("looks") > LOOKS * homes)
        nodes = stored(nodes.where("homes > 0 and looks > 0").select("path", large.alias("large")), "subtries")
        known = join_lookup(rows, nodes, "path")
        small.append(known.where("not large").select("path", F.lit(level).alias("level"), "state", "word", "n"))
        if not nodes.where("large").head(1):
            break
        rows = known.where("large").drop("large")
        if level >= GROUPS:
            links = _crowded_links(rows)
            break
        for _ in range(min(steps, GROUPS - level)):
            rows = _descended(rows, level)
            level += 1
        rows = stored(rows, "descended")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in key_runs(frames, "path"):
            state = frame["state"].to_numpy()
            is_home = state == _HOME
            own, other = frame[is_home], frame[~is_home]
            pairs = list(
                subtrie_links(own["word"].tolist(), other["word"].tolist(), state[~is_home], int(frame["level"].iat[0]), order)
            )
            if pairs:
                i, j = map(list, zip(*pairs, strict=True))
                a, b = own.iloc[i], other.iloc[j]
                yield pd.DataFrame({"a": a["word"].array, "na": a["n"].array, "b": b["word"].array, "nb": b["n"].array})

    fitting = small[0]
    for more in small[1:]:
        fitting = fitting.unionByName(more)
    walked = fitting.repartition("path").sortWithinPartitions("path").mapInPandas(run, "a string, na long, b string, nb long")
    return walked if links is None else walked.unionByName(links)


def variant_groups(words: DataFrame, factor: int = 2, **options) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every row of ``words`` (word, n).

    A word's form is its near word of largest n, the smallest of those in code-point order,
    if that n is at least ``factor`` times its own; its root is reached by following forms.
    Null words are left out, a repeated word counts with the sum of its n, further columns
    of ``words`` are not carried along. No words give no rows.
    """
    if factor < 2:
        raise ValueError("with a factor below 2 forms need not end")
    plain = words.where("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    plain = stored(plain, "counted-words")
    pairs = stored(near_words(plain, **options), "near-words")
    back = pairs.select(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb"))
    best = pairs.unionByName(back).groupBy("a").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("nb")).alias("m"), F.col("b").alias("w"))).alias("best"),
    )
    best = best.select(F.col("a").alias("word"), "n_near", F.col("best.w").alias("near"), (-F.col("best.m")).alias("near_n"))
    has_form = F.col("near_n") >= factor * F.col("n")
    formed = plain.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(has_form, F.col("near")).alias("form"),
        F.when(has_form, F.col("near_n")).alias("form_n"),
    )
    formed = stored(formed, "forms")
    # every round doubles the steps that a root lies ahead; n doubles with each step, so few are needed
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        roots = moved.drop("next")
        if not moved.where("next is not null").head(1):
            break
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
