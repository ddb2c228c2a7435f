"""Quality rules by distribution divergence, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from debatelens.llm.common import BLANKS, own_names, stored, words_of

#: Documents with fewer words fail.
LEAST_WORDS = 10
#: Most percent of words that may stand in repeated windows.
MOST_REPEATED = 20
WINDOW = 5
#: Documents with fewer words are not compared with a language: their shares say little.
GUARD_WORDS = 50
#: A language with fewer words in all gives no reference.
GUARD_REFERENCE = 1000
#: Largest Jensen-Shannon distance (0 to 1) of character classes from the language.
MOST_CLASS_DISTANCE = 0.3
#: Words of a language that are compared: the most frequent ones of all its documents.
COMMON = 30
#: Part of the distance that a text without any of them has, from which on a text is foreign.
FOREIGN = 0.5

#: Character classes, taken from a text one after the other; what is left is the last class.
CLASSES = [r"[a-z]+", BLANKS, r"[A-Z]+", r"[0-9]+", r"[#*$%&|<>]+", r"[\x00-\x7F]+"]

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _language(lang_col: str) -> Column:
    """Codes in lower case; null stays a group of its own."""
    return F.lower(F.col(lang_col).cast("string"))


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = COMMON) -> DataFrame:
    """(lang, own, longest): the ``most`` most frequent words of each language, in lower case,
    from all texts, and the bytes of the longest; ties go by the word. Each task adds up its words before the shuffle, and hands on
    no more than ``most`` of a language afterwards."""
    rows = docs.select(_language(lang_col).alias("lang"), F.explode(words_of(F.lower(F.col(text_col)))).alias("word"))
    counts = rows.groupBy("lang", "word").agg(F.count("*").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "word")
    first = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    listed = first.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("own"))
    own = F.transform("own", lambda x: x["word"])
    return listed.select("lang", own.alias("own"), F.array_max(F.transform(own, F.octet_length)).alias("longest"))


def _histograms(df: DataFrame, text_col: str, c: dict[str, str]) -> DataFrame:
    """Adds the words, the class counts and the counts of the words in ``own``, with all other
    words at the end; texts without such a list have none."""
    out = df.withColumn(c["words"], words_of(F.col(text_col)))
    rest = [F.coalesce(F.col(text_col), F.lit(""))]
    for i, cut in enumerate(CLASSES):
        out = out.withColumn(c[f"rest{i}"], F.regexp_replace(rest[-1], cut, ""))
        rest.append(F.col(c[f"rest{i}"]))
    counts = [F.length(a) - F.length(b) for a, b in zip(rest, rest[1:], strict=False)] + [F.length(rest[-1])]
    out = out.withColumn(c["classes"], F.transform(F.array(*counts), lambda x: x.cast("long")))
    out = out.drop(*[c[f"rest{i}"] for i in range(len(CLASSES))])
    # every word between blanks of its own, so that its copies are found by what they take away;
    # words longer than any of the list are left out, if lower case does not change their length
    blank = F.lit(" ")
    short = F.filter(
        c["words"], lambda w: (F.octet_length(w) <= F.col(c["longest"])) | (F.octet_length(w) != F.char_length(w))
    )
    out = out.withColumn(c["spaced"], F.concat(blank, F.lower(F.array_join(short, "  ")), blank))
    size = F.octet_length(c["spaced"])

    def copies(word: Column) -> Column:
        left = F.octet_length(F.replace(F.col(c["spaced"]), F.concat(blank, word, blank), F.lit("")))
        return ((size - left) / (F.octet_length(word) + 2)).cast("long")

    out = out.withColumn(c["hits"], F.transform(c["own"], copies))
    common = F.concat(c["hits"], F.array(F.size(c["words"]).cast("long") - _sum(F.col(c["hits"]))))
    return out.withColumn(c["common"], common).drop(c["spaced"], c["hits"], c["own"], c["longest"])


def _base(df: DataFrame, text_col: str, c: dict[str, str]) -> DataFrame:
    """Adds the five base counts to a frame that has the words."""
    words = F.col(c["words"])
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    window = F.transform(starts, lambda i: F.xxhash64(*[words[i + k] for k in range(WINDOW)]))
    none = F.array().cast("array<bigint>")
    out = df.withColumns({
        c["lines"]: lines,
        c["windows"]: F.when(F.size(words) >= WINDOW, window).otherwise(none),
    })
    # few texts repeat a window; the others end at the count of distinct windows
    again = F.size(F.array_distinct(c["windows"])) < F.size(c["windows"])
    pairs = F.sort_array(F.transform(c["windows"], lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn(c["pairs"], F.when(again, pairs))
    pairs = F.col(c["pairs"])

    def twin(x: Column, i: Column) -> Column:
        return F.when((F.get(pairs, i - 1)["h"] == x["h"]) | (F.get(pairs, i + 1)["h"] == x["h"]), x["i"])

    at = F.sort_array(F.filter(F.transform(pairs, twin), lambda x: x.isNotNull()))
    out = out.withColumn(c["at"], at)
    at = F.col(c["at"])
    # a window adds what its next repeated window does not cover
    added = F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW))).cast("long"))
    symbols = F.col(c["classes"])[4]
    out = out.withColumns({
        c["n_words"]: F.size(words).cast("long"),
        c["word_chars"]: F.length(F.array_join(words, "")).cast("long"),
        c["n_symbols"]: symbols,
        c["n_dup_lines"]: (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("long"),
        c["n_repeat_words"]: F.coalesce(_sum(added), F.lit(0).cast("long")),
    })
    return out.drop(*[c[x] for x in ("lines", "windows", "pairs", "at", "words")])


def _divergence(counts: Column, total: Column, reference: Column, base: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms given as counts with their sums.

    The sums are columns, so that they are not added up anew for every pair of counts.
    """

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    def term(x: Column, y: Column) -> Column:
        p, q = x / total, y / base
        return (part(p, q) + part(q, p)) / 2

    both = F.aggregate(F.zip_with(counts, reference, term), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(both, F.lit(0.0)))


def _names(df: DataFrame) -> dict[str, str]:
    wanted = ["words", "classes", "spaced", "own", "hits", "longest", "common", "lines", "windows", "pairs", "at", "lang_key"]
    wanted += [f"rest{i}" for i in range(len(CLASSES))] + BASE
    return dict(zip(wanted, own_names(df, wanted), strict=True))


def _measured(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """``rows`` (with ``text`` and ``lang``) with the base counts and both histograms instead of
    the text: one narrow row each, made in one pass over the texts."""
    names = _names(rows)
    key = names["lang_key"]
    lists = lists.select(F.col("lang").alias(key), *[F.col(x).alias(names[x]) for x in ("own", "longest")])
    # a row per language: Spark broadcasts it by the size of the stored table, if that is small
    out = rows.join(lists, F.col("lang").eqNullSafe(F.col(key)), "left").drop(key)
    out = _base(_histograms(out, "text", names), "text", names)
    kept = [F.col(c) for c in rows.columns if c != "text"]
    return out.select(*kept, *[F.col(names[b]).alias(b) for b in BASE], F.col(names["classes"]).alias("classes"), F.col(names["common"]).alias("common"))


def references_of(measured: DataFrame) -> DataFrame:
    """(lang, ref_words, ref_classes, ref_common, their sums, farthest): one row per language from all its
    measured documents that pass the length guard; ``farthest`` is the distance of a text
    without any of the language's common words."""
    rows = measured.where(F.col("n_words") >= GUARD_WORDS)
    sums = [F.sum(F.col("classes")[i]).alias(f"k{i}") for i in range(len(CLASSES) + 1)]
    # a small language has fewer words in its list
    sums += [F.sum(F.coalesce(F.get("common", F.lit(i)), F.lit(0))).alias(f"w{i}") for i in range(COMMON + 1)]
    totals = rows.groupBy("lang").agg(F.sum("n_words").alias("ref_words"), F.max(F.size("common")).alias("bins"), *sums)
    common = F.slice(F.array(*[f"w{i}" for i in range(COMMON + 1)]), 1, F.col("bins"))
    refs = totals.select(
        "lang",
        "ref_words",
        F.array(*[f"k{i}" for i in range(len(CLASSES) + 1)]).alias("ref_classes"),
        common.alias("ref_common"),
    )
    refs = refs.withColumns({"ref_letters": _sum(F.col("ref_classes")), "ref_all": _sum(F.col("ref_common"))})
    nothing = F.transform("ref_common", lambda x, i: F.when(i == F.size("ref_common") - 1, 1).otherwise(0).cast("long"))
    return refs.withColumn("farthest", _divergence(nothing, F.lit(1), F.col("ref_common"), F.col("ref_all")))


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``references_of`` the documents, in lower case and with null as a language of its own."""
    rows = docs.select(_language(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return references_of(_measured(rows, stored(common_words(rows), "common-words")))


def _judged(measured: DataFrame) -> DataFrame:
    """The measured rows with distances, the word limit and the verdict."""
    references = stored(references_of(measured), "references").where(F.col("ref_words") >= GUARD_REFERENCE)
    references = references.withColumnRenamed("lang", "ref_lang")
    out = measured.join(references, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    fit = (F.col("n_words") >= GUARD_WORDS) & F.col("ref_words").isNotNull()
    # what drawing so few words from the language itself would give in the mean
    drawn = (F.size("ref_common") - 1) / (8 * F.log(F.lit(2.0)) * F.col("n_words"))
    limit = F.sqrt(F.pow(FOREIGN * F.col("farthest"), F.lit(2.0)) + drawn)
    out = out.withColumns({"letters": _sum(F.col("classes")), "counted": _sum(F.col("common"))})
    out = out.withColumns({
        "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
        "class_distance": F.when(fit, F.round(_divergence(*map(F.col, ("classes", "letters", "ref_classes", "ref_letters"))), 6)),
        "word_distance": F.when(fit, F.round(_divergence(*map(F.col, ("common", "counted", "ref_common", "ref_all"))), 6)),
        "word_limit": F.when(fit, F.round(limit, 6)),
    })
    far = (F.col("class_distance") > MOST_CLASS_DISTANCE) | (F.col("word_distance") > F.col("word_limit"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, two distances, the limit of the
    second one, the verdict.

    A document fails with few words or many repeated ones. Otherwise its histograms of
    character classes and of the language's common words are compared with those of its
    language, both taken from all documents, and it fails when a Jensen-Shannon distance is
    too large: of classes by a constant, of words by half the distance of a text that has no
    common word, and what few words may differ by chance. Languages are told apart in lower
    case, a null language is one of its own; short documents and languages with little text
    have null distances and are not compared. A null text counts as empty and fails. Repeated
    rows and null ids get a row each; other columns, whatever their names, are ignored. An
    empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _language(lang_col).alias("lang"))
    measured = stored(_measured(rows, stored(common_words(rows), "common-words")), "measured")
    return _judged(measured).select("doc_id", *BASE, "base_failed", "class_distance", "word_distance", "word_limit", "kept")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, unchanged; repeated rows pass or fail alike."""
    key = [F.col(id_col).cast("string").alias("key"), F.xxhash64(F.col(text_col)).alias("text_hash")]
    rows = docs.select(*key, F.col(text_col).alias("text"), _language(lang_col).alias("lang"))
    measured = stored(_measured(rows, stored(common_words(rows), "common-words")), "measured")
    good = _judged(measured).where("kept").select("key", "text_hash", "lang").distinct()
    hashed, *own = own_names(docs, ["text_hash", "good_key", "good_hash", "good_lang"])
    good = good.toDF(*own)
    same = F.col(id_col).cast("string").eqNullSafe(F.col(own[0])) & (F.col(hashed) == F.col(own[1]))
    same = same & _language(lang_col).eqNullSafe(F.col(own[2]))
    return docs.withColumn(hashed, F.xxhash64(F.col(text_col))).join(good, same, "left_semi").drop(hashed)
