"""Lexicon scores of whole message texts.

The words of the different texts are exploded once and joined with the lexicon, which is
broadcast when its measured size allows it. Words that the lexicon or the rules know come
back as one short list per text, and the rules run over that list only. Every size of
lexicon takes this way; on a stream it runs batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .. import values as V
from ..scale import MAX_BROADCAST_BYTES
from .terms import words
from .texts import join_words, per_text

#: Lexicon means are added up in whole numbers of this size.
_UNIT = 1e10


@dataclass(frozen=True)
class ValenceRules:
    """Constants of the published valence method and its word lists."""

    negators: list[str] = field(default_factory=lambda: V.NEGATORS)
    boosters_up: list[str] = field(default_factory=lambda: V.BOOSTERS_UP)
    boosters_down: list[str] = field(default_factory=lambda: V.BOOSTERS_DOWN)
    idioms: dict[str, float] = field(default_factory=lambda: V.IDIOMS)
    booster: float = 0.293
    capitals: float = 0.733
    negation: float = -0.74
    distance_damping: tuple[float, float, float] = (1.0, 0.95, 0.9)
    before_but: float = 0.5
    after_but: float = 1.5
    contrast: str = "but"
    exclamation: float = 0.292
    most_exclamations: int = 4
    question: float = 0.18
    many_questions: float = 0.96
    alpha: float = 15.0


DEFAULT_VALENCE_RULES = ValenceRules()

_BLANKS = r"[\s\p{Z}]+"
#: Found in texts with a word of two characters or more.
_ANY_WORD = r"[^\s\p{Z}]{2}"
# --- Fixed values: punctuation cut from the start or the end of a plain word ---
_EDGES = """.!?,;:'"-"""
_PUNCTUATION = r"""(?:[.,;:'"-]|!{1,3}|\?{1,3}|\?!\?!?|!\?!\??)"""
_PLAIN = r"([^!-/:-@\[-`{-~]{2,}+)"
_EDGED = f"^(?:{_PLAIN}{_PUNCTUATION}|{_PUNCTUATION}{_PLAIN})$"
#: Found in every text with a token of capitals only, and in few others.
_SHOUT = r"\p{Lu}(?:[^\p{Ll}\s\p{Z}]|(?<=[^\p{Ll}\s\p{Z}]\p{Lu}))"


def _tokens(text: Column | str) -> Column:
    return F.filter(F.split(text, _BLANKS), lambda t: F.length(t) > 1)


def _bare(token: Column) -> Column:
    """A token without the punctuation at one of its edges."""
    # looked at before the pattern is, which most words don't need
    edged = F.lit(_EDGES).contains(F.substring(token, 1, 1)) | F.lit(_EDGES).contains(F.substring(token, -1, 1))
    return F.when(edged, F.regexp_replace(token, _EDGED, "$1$2")).otherwise(token)


def valence_words(text: Column | str = "message") -> Column:
    """Tokens between blanks, longer than one character, without edge punctuation."""
    return F.transform(_tokens(text), _bare)


def _entries(lexicon: DataFrame, fields: list[str]) -> DataFrame:
    """One row per word; of a repeated word the largest values count, null words are left out."""
    known = lexicon.where(F.col("word").isNotNull()).groupBy("word")
    return known.agg(*[F.max(F.col(f).cast("double")).alias(f) for f in fields])


# words that the rules ask for by name
_SO, _LEAST, _AT, _KIND, _OF = range(1, 6)
_NAMED = {"so": _SO, "this": _SO, "least": _LEAST, "at": _AT, "very": _AT, "kind": _KIND, "of": _OF}
_FIELDS = ["valence", "strength", "negates", "never", "named", "turns", "idiom", "weakens"]


def _marks(rules: ValenceRules) -> dict[str, dict[str, float]]:
    """What the rules know of single words and of phrases, next to the lexicon."""
    marks: dict[str, dict[str, float]] = {}

    def mark(word: str, **values: float) -> None:
        marks[word] = marks.get(word, {}) | values

    for word in rules.negators:
        mark(word, negates=1.0)
    for listed, strength in [(rules.boosters_up, rules.booster), (rules.boosters_down, -rules.booster)]:
        for word in listed:
            mark(word, **({"weakens": 1.0} if " " in word else {"strength": strength}))
    for phrase, value in rules.idioms.items():
        mark(phrase, idiom=value)
    for word, number in _NAMED.items():
        mark(word, named=number)
    mark("never", never=1.0)
    mark(rules.contrast, turns=1.0)
    return marks


def _valence_entries(lexicon: DataFrame, rules: ValenceRules) -> DataFrame:
    """Lexicon words, marked words and phrases as keys of one table."""
    fields = _FIELDS[1:]
    schema = "word string, " + ", ".join(f"{f} double" for f in fields)
    marked = [(w, *[None if (x := m.get(f)) is None else float(x) for f in fields]) for w, m in _marks(rules).items()]
    marks = lexicon.sparkSession.createDataFrame(marked, schema)
    # a phrase is matched as a run of words, never as one lexicon word
    return _entries(lexicon.where(~F.col("word").contains(" ")), ["valence"]).join(marks, "word", "full")


def _phrase_runs(lowered: Column, rules: ValenceRules) -> Column:
    """(at, n, word, raw) of the runs of n words that begin like a phrase of the rules."""
    phrases = [p.split() for p in _marks(rules) if " " in p]
    starts = sorted({p[0] for p in phrases})
    sizes = sorted({len(p) for p in phrases})
    places = F.filter(F.sequence(F.lit(0), F.size(lowered)), lambda i: F.get(lowered, i).isin(starts))

    def runs(i: Column) -> Column:
        return F.array(
            *[
                F.struct(
                    i.alias("at"),
                    F.lit(n).alias("n"),
                    F.concat_ws(" ", *[F.get(lowered, i + step) for step in range(n)]).alias("word"),
                    F.lit("").alias("raw"),
                )
                for n in sizes
            ]
        )

    return F.filter(F.flatten(F.transform(places, runs)), lambda r: r["at"] + r["n"] <= F.size(lowered))


def _known_words(
    lexicon: DataFrame, rules: ValenceRules, max_bytes: int
) -> Callable[[DataFrame], DataFrame]:
    """Per text with known words: these (``_known``, in order), and how many words it has."""

    def find(texts: DataFrame) -> DataFrame:
        read = texts.select("_text", "_said", _tokens("_said").alias("_tokens"))
        # capitals count only where other words are not in capitals
        quiet = F.exists("_tokens", lambda t: (F.upper(t) != t) | (F.lower(t) == t))
        # below the explode, so that they are found once per text
        read = read.select(
            "_text",
            "_tokens",
            F.transform("_tokens", lambda t: F.lower(_bare(t))).alias("_lowered"),
            F.size("_tokens").alias("_n"),
            (F.col("_said").rlike(_SHOUT) & quiet).alias("_mixed"),
        )
        single = F.transform(
            "_lowered",
            lambda w, i: F.struct(i.alias("at"), F.lit(1).alias("n"), w.alias("word"), F.get("_tokens", i).alias("raw")),
        )
        if any(" " in p for p in _marks(rules)):
            single = F.concat(single, _phrase_runs(F.col("_lowered"), rules))
        # outer, as Spark puts a filter below an inner one that reads all words of a text anew for each of them;
        # the row of a text without words finds no entry
        single = read.select("_text", "_n", "_mixed", F.explode_outer(single).alias("w"))
        single = single.select("_text", "_n", "_mixed", "w.at", "w.n", "w.word", "w.raw")
        entries = _valence_entries(lexicon, rules).withColumn("listed", F.lit(True))
        met = join_words(single, entries, "left", max_bytes)
        not_form = (F.col("n") == 1) & F.col("word").contains("n't")
        met = met.where(F.col("listed").isNotNull() | not_form)
        unknown = F.coalesce(*[F.col(f) for f in ("valence", "strength", "negates", "never")]).isNull()
        shout = F.col("_mixed") & (F.upper("raw") == F.col("raw")) & (F.lower("raw") != F.col("raw"))
        met = met.withColumn("negates", F.when(unknown & not_form, 1.0).otherwise(F.col("negates")))
        met = met.withColumn("loud", shout)
        item = F.struct("at", "n", *_FIELDS, "loud")
        return met.groupBy("_text").agg(
            F.sort_array(F.collect_list(item)).alias("_known"), F.max("_n").alias("_n")
        )

    return find


def _occurrences(text: Column, mark: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))


def _punctuation_emphasis(text: Column, rules: ValenceRules) -> Column:
    marks = F.least(_occurrences(text, "!"), F.lit(rules.most_exclamations))
    questions = _occurrences(text, "?")
    asked = (
        F.when(questions > 3, rules.many_questions)
        .when(questions > 1, questions * rules.question)
        .otherwise(0.0)
    )
    return marks * rules.exclamation + asked


def _before(place: Column, distance: int) -> Column:
    """The known word ``distance`` words before the one at ``place`` of the list, if any."""
    at = F.get("_single", place)["at"] - distance
    earlier = [F.get("_single", place - step) for step in range(1, distance + 1)]
    return F.coalesce(*[F.when(k["at"] == at, k) for k in earlier])


def _given(value: Column, then: Callable[[Column], Column]) -> Column:
    """What follows from a value that is found once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _shifted(value: Column, place: Column, distance: int, rules: ValenceRules) -> Column:
    """Value of a lexicon word after the booster or negation ``distance`` words before it.

    A word of the lexicon at that place changes nothing, nor does an unmarked one.
    """

    def after(hit: Column) -> Column:
        shout = F.when(hit["loud"], F.when(value > 0, rules.capitals).otherwise(-rules.capitals)).otherwise(0.0)
        strength = F.when(value < 0, -hit["strength"]).otherwise(hit["strength"])
        moved = value + F.coalesce((strength + shout) * rules.distance_damping[distance - 1], F.lit(0.0))
        turned = F.when(hit["negates"].isNotNull(), rules.negation).otherwise(1.0)
        # "never so good" strengthens instead of turning the meaning
        if distance > 1:
            so = F.lit(False)
            for d in range(1, distance):
                so = so | F.coalesce(_before(place, d)["named"] == _SO, F.lit(False))
            turned = F.when(hit["never"].isNotNull() & so, {2: 1.5, 3: 1.25}[distance]).otherwise(turned)
        result = F.when(hit.isNull(), value).when(hit["valence"].isNull(), moved * turned).otherwise(value)
        if distance < 3:
            return result
        phrased = F.col("_phrases").isNotNull() & (F.get("_single", place)["at"] >= 3) & hit["valence"].isNull()
        return F.when(phrased & value.isNotNull(), _with_phrases(result, place, rules)).otherwise(result)

    return _given(_before(place, distance), after)


def _with_phrases(value: Column, place: Column, rules: ValenceRules) -> Column:
    """Value after idioms around the word, which replace it, and two-word boosters."""
    at = F.get("_single", place)["at"]
    # only what can lie within three words, so that a text of many phrases takes no longer per word
    most = len({len(p.split()) for p in _marks(rules) if " " in p})
    earlier = F.get("_placed", place) - place
    close = (F.get("_phrases", earlier - 1)["at"] >= at - 3) | (F.get("_phrases", earlier)["at"] == at)
    # not by slice(), which copies the whole list first
    listed = F.transform(F.sequence(earlier - 3 * most, earlier + most - 1), lambda i: F.get("_phrases", i))
    near = F.filter(listed, lambda p: p["at"].between(at - 3, at))

    def found(phrases: Column) -> Column:
        places = [(0, 3), (0, 2), (-1, 2), (-2, 3), (-2, 2), (-3, 3), (-3, 2)]

        def ranked(p: Column) -> Column:
            rank = F.coalesce(*[F.when((p["at"] == at + shift) & (p["n"] == n), i) for i, (shift, n) in enumerate(places)])
            return F.struct(rank.alias("rank"), p["idiom"].alias("idiom"))

        idioms = F.filter(F.transform(phrases, ranked), lambda i: i["rank"].isNotNull() & i["idiom"].isNotNull())
        weak = F.exists(phrases, lambda p: p["at"].isin(at - 3, at - 2) & (p["n"] == 2) & p["weakens"].isNotNull())
        return F.coalesce(F.array_min(idioms)["idiom"], value) - F.when(weak, rules.booster).otherwise(0.0)

    return F.when(close, _given(near, found)).otherwise(value)


def _valence_columns(read: DataFrame, text: str, rules: ValenceRules, prefix: str) -> tuple[DataFrame, dict[str, Column]]:
    """Rows with ``_known`` and ``_n``, with helper columns, and the four scores from them."""
    nothing = F.lit(None).cast("double")
    phrases = F.filter("_known", lambda k: k["n"] > 1)
    split = read.withColumn("_single", F.filter("_known", lambda k: k["n"] == 1))
    split = split.withColumn("_phrases", F.when(F.size(phrases) > 0, phrases))
    # where the single words stand in the list of texts with phrases
    placed = F.array_compact(F.transform("_known", lambda k, i: F.when(k["n"] == 1, i)))
    split = split.withColumn("_placed", F.when(F.size(phrases) > 0, placed))
    # the rules visit the places of lexicon words that are no boosters
    places = F.transform("_single", lambda k, j: F.when(k["valence"].isNotNull() & k["strength"].isNull(), j))
    turns = F.transform(F.filter("_single", lambda k: k["turns"].isNotNull()), lambda k: k["at"])
    found = split.withColumns({"_at": F.array_compact(places), "_contrast": F.get(turns, F.lit(0))})

    def own_value(j: Column) -> Column:
        k, after = F.get("_single", j), F.get("_single", j + 1)
        emphasis = F.when(k["loud"], F.signum(k["valence"]) * rules.capitals)
        of_kind = (k["named"] == _KIND) & (after["named"] == _OF) & (after["at"] == k["at"] + 1)
        return F.when(of_kind, nothing).otherwise(k["valence"] + F.coalesce(emphasis, F.lit(0.0)))

    def settled(v: Column, j: Column) -> Column:
        at, before = F.get("_single", j)["at"], _before(j, 1)
        least = (before["named"] == _LEAST) & before["valence"].isNull()
        least = least & ~F.coalesce(_before(j, 2)["named"] == _AT, F.lit(False))
        turned = v * F.when(least, rules.negation).otherwise(1.0)
        here = F.col("_contrast")
        side = F.when(here.isNull() | (at == here), 1.0).when(at < here, rules.before_but).otherwise(rules.after_but)
        return F.coalesce(turned * side, F.lit(0.0))

    def neighbours(distance: int) -> Callable[[Column, Column], Column]:
        return lambda v, j: _shifted(v, j, distance, rules)

    scored = found.withColumn("_values", F.transform("_at", own_value))
    for distance in (1, 2, 3):
        scored = scored.withColumn("_values", F.zip_with("_values", "_at", neighbours(distance)))
    none = F.array().cast("array<double>")
    scored = scored.withColumn("_values", F.coalesce(F.zip_with("_values", "_at", settled), none))

    zero = F.lit(0.0)
    n = F.coalesce("_n", F.when(F.col(text).rlike(_ANY_WORD), 1).otherwise(0))
    totals = scored.withColumns(
        {
            "_sum": F.aggregate("_values", zero, lambda a, x: a + x),
            "_pos": F.aggregate("_values", zero, lambda a, x: a + F.when(x > 0, x + 1).otherwise(0.0)),
            "_neg": F.aggregate("_values", zero, lambda a, x: a + F.when(x < 0, 1 - x).otherwise(0.0)),
            "_neu": (n - F.size(F.filter("_values", lambda x: x != 0))).cast("double"),
            "_marks": _punctuation_emphasis(F.col(text), rules),
        }
    )
    pushed = totals.withColumns(
        {
            "_sum": F.col("_sum") + F.signum("_sum") * F.col("_marks"),
            "_pos": F.col("_pos") + F.when(F.col("_pos") > F.col("_neg"), F.col("_marks")).otherwise(0.0),
            "_neg": F.col("_neg") + F.when(F.col("_pos") < F.col("_neg"), F.col("_marks")).otherwise(0.0),
        }
    )
    whole = F.nullif(F.col("_pos") + F.col("_neg") + F.col("_neu"), F.lit(0.0))
    raw_compound = F.col("_sum") / F.sqrt(F.col("_sum") * F.col("_sum") + rules.alpha)
    present = F.col(text).isNotNull()
    scores = {f"{prefix}compound": F.when(present, F.round(raw_compound, 4))}
    for name in ("neg", "neu", "pos"):
        scores[f"{prefix}{name}"] = F.when(present, F.round(F.coalesce(F.col(f"_{name}") / whole, zero), 3))
    return pushed, scores


_MOODS = ["polarity", "subjectivity"]


def _mood_sums(lexicon: DataFrame, max_bytes: int) -> Callable[[DataFrame], DataFrame]:
    """Per text with words of the lexicon: their number, and the sums of their values in
    whole units, which come out the same in any order."""

    def find(texts: DataFrame) -> DataFrame:
        entries = _entries(lexicon, _MOODS)
        entries = entries.select("word", *[F.round(F.col(m) * _UNIT).cast("long").alias(m) for m in _MOODS])
        listed = texts.select("_text", F.explode(words("_said")).alias("word"))
        met = join_words(listed, entries, "inner", max_bytes).groupBy("_text")
        return met.agg(F.count("*").alias("_hits"), *[F.sum(m).alias(f"_{m}") for m in _MOODS])

    return find


def _mood_columns(text: str, prefix: str) -> dict[str, Column]:
    def mean(name: str) -> Column:
        share = F.coalesce(F.col(f"_{name}").cast("double") / (F.col("_hits") * _UNIT), F.lit(0.0))
        return F.when(F.col(text).isNotNull(), share)

    return {f"{prefix}{m}": mean(m) for m in _MOODS}


def _scored(df: DataFrame, read: DataFrame, scores: dict[str, Column]) -> DataFrame:
    return read.select(*[c for c in df.columns if c not in scores], *[c.alias(n) for n, c in scores.items()])


def with_valence(
    df: DataFrame,
    lexicon: DataFrame,
    text: str = "message",
    rules: ValenceRules = DEFAULT_VALENCE_RULES,
    prefix: str = "vader_",
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Add compound, neg, neu and pos of each text by a (word, valence) lexicon.

    Of a repeated lexicon word the largest valence counts; a null text has null scores.
    ``df`` is a table, not a stream; see ``streaming.ingest`` for those.
    """
    found = per_text(df, text, [_known_words(lexicon, rules, max_bytes)])
    return _scored(df, *_valence_columns(found, text, rules, prefix))


def with_polarity(
    df: DataFrame,
    lexicon: DataFrame,
    text: str = "message",
    prefix: str = "textblob_",
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Add the mean polarity and subjectivity of the words found in the lexicon, else 0.

    Lexicon values count to ten places.
    """
    return _scored(df, per_text(df, text, [_mood_sums(lexicon, max_bytes)]), _mood_columns(text, prefix))


def with_lexicons(
    df: DataFrame,
    valence: DataFrame,
    polarity: DataFrame,
    text: str = "message",
    rules: ValenceRules = DEFAULT_VALENCE_RULES,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Add the scores of ``with_valence`` and ``with_polarity``; the rows move once for both."""
    found = per_text(df, text, [_known_words(valence, rules, max_bytes), _mood_sums(polarity, max_bytes)])
    read, scores = _valence_columns(found, text, rules, "vader_")
    return _scored(df, read, scores | _mood_columns(text, "textblob_"))
