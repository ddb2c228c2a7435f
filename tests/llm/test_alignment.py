"""Token groups and link counts against loops over bytes."""

import hashlib
from collections import Counter, defaultdict

import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import __spark_entry__ as entry
from conftest import DATA
from debatelens.llm import alignment
from debatelens.llm.queries import TOKENIZERS

A, B = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"


def decoded():
    """Bytes of every id of both tokenizers, and their encoders."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(x): x for x in keep}
    for i, x in enumerate(x for x in range(256) if x not in keep):
        byte[chr(256 + i)] = x
    bytes_a = {i: bytes(byte[c] for c in t) for t, i in a.get_vocab().items() if all(c in byte for c in t)}
    bytes_b = {}
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        bytes_b[i] = bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()
    return a, b, bytes_a, bytes_b


def brute(texts):
    a, b, bytes_a, bytes_b = decoded()
    rows, count = [], Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        spelt = [b"".join(d[i] for i in ids) for ids, d in ((ids_a, bytes_a), (ids_b, bytes_b))]
        groups = []
        if text and spelt == [(" " + text).encode()] * 2:
            ends = [{}, {}]
            for k, (ids, d) in enumerate(((ids_a, bytes_a), (ids_b, bytes_b))):
                at = 0
                for i in ids:
                    at += len(d[i])
                    ends[k][at] = i
            own = [[], []]
            for at in range(1, len(spelt[0]) + 1):
                for k in (0, 1):
                    if at in ends[k]:
                        own[k].append(ends[k][at])
                if at in ends[0] and at in ends[1]:
                    groups.append(own)
                    own = [[], []]
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        count.update(links.keys())
        rows.append((groups, links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for groups, links in rows:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((
            sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()),
            sum(n for p, n in links.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return out, count


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def result(df, key="doc_id"):
    return {r[key]: tuple(r[n] for n in NAMES) for r in df.collect()}


@pytest.fixture(scope="module")
def both(spark):
    return alignment.byte_bpe(spark, A), alignment.pieces(spark, B)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want, _ = brute([r.text for r in docs])
    assert result(entry.queries()["op13_token_alignment"](spark, DATA)) == dict(zip([r.doc_id for r in docs], want, strict=True))


TEXTS = [
    "Hello world, this is text.", "hello  two   spaces\n\n\tand\ttabs", " leading", "trailing ", None, "", "x", "▁",
    "naïve café 日本語 🙂 ½", "<|endoftext|> <s> </s> <unk> <0x41>", "unaffordable unaffordable", "a b　c", "fi ﬁ Å",
    "abc " * 2000, "same text", "same text", "\r\n", "\x01\x7f", "<unk>", "1234567890 3.14159",
]


@pytest.mark.parametrize("frequent", [1 << 20, 40, 0])
def test_any_number_of_frequent_pairs_gives_the_same(spark, both, frequent):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    want, _ = brute(TEXTS)
    assert result(alignment.align_tokens(docs, *both, frequent=frequent)) == dict(enumerate(want))


def test_pair_counts(spark, both):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = alignment.token_pairs(docs, *both).collect()
    assert len(rows) == len({(r.a, r.b) for r in rows})
    assert {(r.a, r.b): r.n for r in rows} == dict(brute(TEXTS)[1])


def test_clashing_columns_repeated_rows_and_empty_tables(spark, both):
    rows = [(None, "some text", 5, 6), (1, "some text", 5, 6), (1, "some text", 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_A int, pairs int")
    got = alignment.align_tokens(docs, *both)
    assert got.columns == ["doc_id", "N_A", "pairs", "n_a_", *[n for n in alignment._RESULT[1:]]]
    counts = [(r.doc_id, r.N_A, r.pairs, r.n_a_, r.count_sum) for r in got.collect()]
    assert sorted(counts, key=repr) == [(i, 5, 6, 2, 6) for i in (1, 1, None)]
    assert alignment.align_tokens(docs.where("false"), *both).count() == 0
    assert alignment.token_pairs(docs.where("false"), *both).count() == 0


def test_identity_map_takes_the_piece_before_the_byte():
    assert alignment.identity_map([b"a", b"zz", b""], [b"a", b"b", b"a", b""]).tolist() == [2, -1, -1]
