"""Removed passages against a dictionary of all windows."""

import hashlib
import random

import __spark_entry__ as entry
from conftest import DATA
from debatelens.llm import substring
from debatelens.llm.substring import SuffixAutomaton

BLANK = str.maketrans("\t\n\x0b\x0c\r", "     ")


def words_of(text):
    return [w for w in (text or "").translate(BLANK).split(" ") if w]


def brute(rows, least):
    """id -> (words, removed, digest of what stays) for (id, text) with distinct ids."""
    low = {}
    for i, text in rows:
        words = words_of(text)
        for at in range(len(words) - least + 1):
            window = tuple(words[at : at + least])
            low[window] = min(low.get(window, i), i)
    out = {}
    for i, text in rows:
        words = words_of(text)
        gone = set()
        for at in range(len(words) - least + 1):
            if low[tuple(words[at : at + least])] < i:
                gone |= set(range(at, at + least))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[i] = len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()
    return out


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = entry.queries()["op2_substring_dedup"](spark, DATA).collect()
    assert got[0].__fields__[:4] == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute([tuple(r) for r in rows], 50)
    assert sum(r.n_removed for r in got) > 0 and len(got) == len(rows)


def made_up(rng):
    """Texts with shared passages at random places, some words repeated many times."""
    shared = [[f"s{k}_{rng.randrange(4)}" for k in range(rng.randrange(6, 30))] for _ in range(6)] + [["x"] * 25]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randrange(5)):
            words += [f"u{rng.randrange(400)}" for _ in range(rng.randrange(8))]
            part = rng.choice(shared)
            words += part[rng.randrange(4) :]
        rows.append((i, " ".join(words)))
    return rows


def test_made_up_texts_in_every_shard_size(spark):
    rows = made_up(random.Random(5))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 8)
    for shard in (200, 0, 3):
        left = substring.remove_repeats(docs, joined=True, least=8, gram=3, shard=shard)
        got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.text.encode()).hexdigest()) for r in left.collect()}
        assert got == want


def test_automaton_against_all_substrings():
    rng = random.Random(2)
    for _ in range(200):
        passages = [[rng.choice(b"ab") for _ in range(rng.randrange(12))] for _ in range(3)]
        query = [rng.choice(b"abc") for _ in range(15)]
        automaton = SuffixAutomaton()
        for p in passages:
            automaton.add(p)
        known = {tuple(p[i : i + 3]) for p in passages for i in range(len(p) - 2)}
        want = {k for i in range(13) if tuple(query[i : i + 3]) in known for k in range(i, i + 3)}
        spans = automaton.spans(query, 3)
        assert {k for a, b in spans for k in range(a, b)} == want
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_nulls_repeats_ties_and_clashing_names(spark):
    long = " ".join(f"w{i % 9000}" for i in range(30000))
    rows = [(1, long, 7, "a"), (2, None, 7, None), (3, "", 7, "b"), (4, long + "  tail", 7, "c"), (4, long + "  tail", 7, "c")]
    rows += [(None, long, 7, "d"), (5, " a\tb\nc ", 7, "e"), (1, long[:700], None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, span_id string")
    left = substring.remove_repeats(docs)
    assert left.columns == ["doc_id", "text", "n_words", "span_id", "n_words_", "n_removed"]
    got = sorted(((r.doc_id, r.span_id, r.text, r.n_removed) for r in left.collect()), key=repr)
    want = [(1, "a", long, 0), (2, None, None, 0), (3, "b", "", 0), (4, "c", "tail", 30000), (4, "c", "tail", 30000)]
    want += [(None, "d", long, 0), (5, "e", " a\tb\nc ", 0), (1, "f", long[:700], 0)]
    assert got == sorted(want, key=repr)
    joined = {(r.doc_id, r.span_id): r.text for r in substring.remove_repeats(docs, joined=True).collect()}
    assert joined[2, None] == "" and joined[5, "e"] == "a b c"


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert substring.remove_repeats(none).count() == 0
