"""The operators made of column expressions: licences, quality rules, preferences."""

import math
import random

import pytest

from debatelens.llm import licenses, preferences, quality

DOCS = "doc_id long, text string, lang string, words string, kept boolean"


def scan(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "x", True) for i, t in rows], DOCS)
    return {r.doc_id: (r.sentences, r.licenses, r.n_unknown, r.rest) for r in licenses.scan_licenses(docs).collect()}


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def test_licences_notices_texts_and_order(spark):
    long = "word " * 30000
    apache = "Licensed under the Apache License, Version 2.0."
    got = scan(spark, [
        (1, MIT), (2, f"No full stop here\n{apache}\n{long}"), (3, None), (4, ""), (5, "This license is odd. Nothing else"),
        (6, f"Licensed under CC BY-NC 4.0. {apache}\nReleased under the MIT License."), (7, "Permission is hereby granted"),
        (8, "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ])
    full = ["mit-title", "unknown", "mit-grant", "mit-notice", "mit-warranty", "mit-liability"]
    assert got[1] == (full, ["MIT"], 1, 0)
    assert got[2] == (["apache2-note"], ["Apache-2.0"], 0, 0)
    assert got[3] == got[4] == got[7] == ([], [], 0, 0)
    assert got[5] == (["unknown"], [], 1, 0)
    assert got[6] == (["cc-by-nc4-note", "apache2-note", "mit-note"], ["MIT", "Apache-2.0", "CC-BY-NC-4.0"], 0, 0)
    assert got[8] == (["mit-notice"], [], 0, 1)


GPL = """Copyright (C) 2020 Someone

This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{1} either version {2} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""

BSD = """Copyright (c) 2020, Someone

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""

BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""

APACHE = """Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""


def test_verbatim_notices_with_wrapped_lines(spark):
    marks = [(a, b, v) for a in ":;" for b in ",;" for v in "23"]
    got = scan(spark, [(i, GPL.format(*m)) for i, m in enumerate(marks)] + [(10, BSD), (11, BSD + BSD_NAMES), (12, APACHE)]
        + [(13, "".join(f"# {x}\n" for x in GPL.format(":", ",", 3).splitlines()))])
    for i, (_, _, version) in enumerate(marks):
        assert got[i][1:] == ([f"GPL-{version}.0-or-later"], 1, 5)  # the copyright line; the sentences behind the grant
    assert [got[i][1:3] for i in (10, 11, 12)] == [(["BSD-2-Clause"], 1), (["BSD-3-Clause"], 1), (["Apache-2.0"], 1)]
    assert got[13][1] == ["GPL-3.0-or-later"]


LGPL = GPL.replace("program is free", "library is free").replace("GNU General", "GNU Lesser General").replace("version {2}", "version 2.1")
AGPL = GPL.replace("GNU General", "GNU Affero General")
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
CC0 = """To the extent possible under law, the author(s) have dedicated all copyright
and related and neighboring rights to this software to the public domain worldwide.
"""
EPL = """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/
"""
NOTICES = {
    "MIT": MIT, "Apache-2.0": APACHE, "BSD-2-Clause": BSD, "BSD-3-Clause": BSD + BSD_NAMES, "GPL-3.0-or-later": GPL.format(":", ",", 3),
    "LGPL-2.1-or-later": LGPL.format(";", ";", 0), "AGPL-3.0-or-later": AGPL.format(":", ",", 3), "MPL-2.0": MPL, "ISC": ISC,
    "Zlib": ZLIB, "Unlicense": UNLICENSE, "CC0-1.0": CC0, "EPL-2.0": EPL,
}


def test_notices_bare_and_in_comments(spark):
    def commented(mark, text):
        return "".join(f"{mark} {line}\n" if line else f"{mark}\n" for line in text.splitlines())

    rows, want = [], {}
    for name, text in NOTICES.items():
        forms = [text, "code();\n" + text, "/*\n" + commented(" *", text) + " */\nint x;"]
        forms += [commented(mark, text) + "\ncode" for mark in ("#", "//", "--", ";;", "%")]
        for form in forms:
            want[len(rows)] = name
            rows.append((len(rows), form))
    got = scan(spark, rows)
    assert {i: g[1] for i, g in got.items()} == {i: [name] for i, name in want.items()}
    plain, hashed = got[0], got[3]
    assert plain == hashed


def test_spdx_lines(spark):
    got = scan(spark, [
        (1, "// SPDX-License-Identifier: MIT\nint x;"), (2, "# SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR MIT\n"),
        (3, "/* SPDX-License-Identifier: Apache-2.0 AND LicenseRef-own */"), (4, "SPDX-License-Identifier: NOASSERTION"),
        (5, "SPDX-License-Identifier: MIT\n" + MIT), (6, "SPDX-License-Identifier:\nMIT"), (7, "The SPDX-License-Identifier is missing."),
    ])
    assert [got[i][1] for i in range(1, 8)] == [
        ["MIT"], ["GPL-2.0-only", "MIT"], ["Apache-2.0", "LicenseRef-own"], [], ["MIT"], [], [],
    ]
    assert [got[i][2] for i in range(1, 8)] == [0, 0, 0, 0, 1, 0, 1]


def test_longer_rules_use_their_sentences_up(spark):
    docs = spark.createDataFrame([(1, "A. B. A. C. B"), (1, "A. B"), (None, "B. A")], "doc_id long, text string")
    known, rules = {"a": "license-a", "b": "b", "c": "c"}, [("AB", ["license-a", "b"]), ("A", ["license-a"])]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(licenses, "HINTS", "A")
        got = sorted((str(r.doc_id), r.licenses, r.rest) for r in licenses.scan_licenses(docs, sentences=known, rules=rules).collect())
    assert got == [("1", ["AB"], 0), ("1", ["AB", "A"], 2), ("None", ["A"], 1)]


def test_own_sentences_need_no_hint(spark):
    docs = spark.createDataFrame([(1, "All rights reserved."), (2, "Odd. This work is in the public domain"), (3, None)], "doc_id long, text string")
    known = {"all rights reserved": "reserved", "this work is in the public domain": "public"}
    got = licenses.scan_licenses(docs, sentences=known, rules=[("PD", ["public"])]).collect()
    assert sorted((r.doc_id, r.sentences, r.licenses) for r in got) == [(1, ["reserved"], []), (2, ["public"], ["PD"]), (3, [], [])]


def test_every_sentence_is_normal_and_hinted():
    import re

    for s in licenses.SENTENCES:
        assert s == re.sub("[^a-z0-9]+", " ", s.lower()).strip() and re.search(licenses.HINTS, s)
    assert {i for _, ids in licenses.RULES for i in ids} <= set(licenses.SENTENCES.values())


def repeated(words, size=5):
    at = {}
    for i in range(len(words) - size + 1):
        at.setdefault(tuple(words[i : i + size]), []).append(i)
    return len({i + k for places in at.values() if len(places) > 1 for i in places for k in range(size)})


def base(text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeated(words)


def test_base_counts_against_plain_ones(spark):
    rng = random.Random(7)
    rows = [(1, None, None), (2, "", "en"), (3, " \t\n", "en"), (4, "a b c d e a b c d e", "en"), (5, "x " * 30000, "en")]
    rows += [(6, "été   a#b 😀 *\n\n\tz\r\nq\r\nq\r\n q", "fr"), (7, "a b c d e f", "xx"), (7, "a b c d e f", "xx")]
    for i in range(100):
        rows.append((10 + i, "".join(rng.choice(["a", "b", "é", "#", " ", " ", "\n"]) for _ in range(rng.randrange(300))), "en"))
    docs = spark.createDataFrame([(*r, "x", None) for r in rows], DOCS)
    got = quality.quality_scores(docs).collect()
    assert sorted((r.doc_id, *(r[c] for c in quality.BASE)) for r in got) == sorted((i, *base(t)) for i, t, _ in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality.keep_good(docs).columns == docs.columns


def entropy_distance(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = [sum(a * math.log2(a / c) for a, c in zip(d, m, strict=True) if a) for d in (p, q)]
    return math.sqrt(max(0, sum(kl) / 2))


def test_divergence_keeps_prose_and_rejects_noise(spark):
    rng = random.Random(1)
    common = ["the", "of", "and", "to", "a", "in"]

    def prose(n):
        return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices("aeioustrnl", k=6)) for _ in range(n))

    rows = [(i, prose(200), "en") for i in range(60)]
    noise = [(100, " ".join("#%$&" + c * 3 for c in rng.choices("abcdefgh", k=40)) + prose(60).upper(), "en"), (101, prose(30).upper(), "en")]
    docs = spark.createDataFrame([(*r, "x", None) for r in rows + noise], DOCS)
    got = {r.doc_id: r for r in quality.quality_scores(docs).collect()}
    assert all(got[i].kept for i in range(60))
    assert not got[100].kept and not got[100].base_failed
    assert got[101].kept and got[101].class_distance is None
    assert sorted(r.doc_id for r in quality.keep_good(docs).collect()) == [*range(60), 101]
    refs = quality.language_references(docs).collect()
    assert len(refs) == 1
    lower = [sum(c.islower() for c in t) for _, t, _ in rows[:1]][0]
    blank = rows[0][1].count(" ")
    want = entropy_distance([lower, blank, 0, 0, 0, 0, 0], refs[0].ref_classes)
    assert got[0].class_distance == pytest.approx(want, abs=1e-6)


def test_every_language_value_has_references(spark):
    rng = random.Random(3)

    def prose(n):
        return " ".join("".join(rng.choices("aeioustrnl", k=6)) for _ in range(n))

    langs = {0: "en", 1: "EN", 2: None, 3: "it", 4: "en-US", 5: "En-us"}
    rows = [(100 * k + i, prose(60), lang) for k, lang in langs.items() for i in range(20)]
    rows += [(1000 + k, " ".join("#%$&" + c * 3 for c in rng.choices("abcdefgh", k=20)) + prose(60).upper(), lang) for k, lang in langs.items()]
    rows += [(2000, prose(60), "ru")]
    docs = spark.createDataFrame([(*r, "x", None) for r in rows], DOCS)
    got = {r.doc_id: r for r in quality.quality_scores(docs).collect()}
    assert len(got) == len(rows) and not any(r.base_failed for r in got.values())
    for k, lang in langs.items():
        assert all(got[100 * k + i].kept and got[100 * k + i].class_distance < 0.3 for i in range(20))
        assert not got[1000 + k].kept and got[1000 + k].class_distance > 0.3
        assert got[100 * k].word_distance is not None
    assert got[2000].kept and got[2000].class_distance is None and got[2000].word_distance is None
    refs = {r.lang: r for r in quality.language_references(docs).collect()}
    assert set(refs) == {"en", None, "it", "en-us", "ru"} and all(len(r.ref_common) == quality.COMMON + 1 for r in refs.values())
    assert sorted(r.doc_id for r in quality.keep_good(docs).collect()) == sorted(i for i, r in got.items() if r.kept)


VOCABULARY = {
    "en": "the of and to a in is that for with was on as by at from this be it an",
    "fr": "de la le et les des en un une que est pour qui dans a par plus pas au sur",
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch",
}


def natural(rng, lang, n):
    """Text with the share of frequent words that languages have."""
    often = VOCABULARY[lang].split()
    weights = [1 / (k + 2) for k in range(len(often))]
    return " ".join(
        rng.choices(often, weights)[0] if rng.random() < 0.4 else "".join(rng.choices("aeioustrnldm", k=rng.randint(3, 9)))
        for _ in range(n)
    )


def test_texts_in_another_language_go_and_others_stay(spark):
    rng = random.Random(8)
    rows, foreign = [], set()
    for lang in VOCABULARY:
        rows += [(len(rows) + k, natural(rng, lang, rng.choice([60, 150, 400])), lang) for k in range(300)]
    for lang in ("fr", "de"):
        for _ in range(50):
            foreign.add(len(rows))
            rows.append((len(rows), natural(rng, lang, rng.choice([60, 150, 400])), "en"))
    wordless = len(rows)
    rows.append((wordless, " ".join("".join(rng.choices("aeioustrnldm", k=6)) for _ in range(300)), "en"))
    docs = spark.createDataFrame([(*r, "x", None) for r in rows], DOCS)
    got = {r.doc_id: r for r in quality.quality_scores(docs).collect()}
    gone = {i for i, r in got.items() if not r.kept}
    assert len(gone & foreign) >= 90 and wordless in gone
    assert len(gone - foreign - {wordless}) <= 9
    assert all(got[i].word_distance > got[i].word_limit for i in gone & foreign)
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == set(got) - gone


def test_common_words_of_every_language(spark):
    rows = [(1, "The the THE cat", "EN"), (2, "cat dog", "en"), (3, "x " * 40 + "y", None), (4, None, "fr"), (5, "b a", "de")]
    docs = spark.createDataFrame([(*r, "x", None) for r in rows], DOCS)
    got = {r.lang: r.own for r in quality.common_words(docs, most=2).collect()}
    assert got == {"en": ["the", "cat"], None: ["x", "y"], "de": ["a", "b"]}


def test_native_operators_on_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert quality.quality_scores(none).count() == quality.keep_good(none).count() == licenses.scan_licenses(none).count() == 0
    turns = spark.createDataFrame([], TURNS)
    assert preferences.format_preferences(turns, turns).count() == 0
    assert preferences.format_pairs(preferences.with_other_reply(turns, "pair_id")).count() == 0


TURNS = "pair_id long, turn long, role string, text string, chosen string"


def test_preferences_prefix_masks_nulls_and_ties(spark):
    def table(rows):
        return spark.createDataFrame([(*r, "x") for r in rows], TURNS)

    chosen = table([
        (1, 2, "assistant", "yes"), (1, 1, "user", "q <|im_end|>"), (1, 0, "system", None), (1, 3, "user", "more"),
        (2, 0, "user", "same"), (3, 0, None, "a"), (3, 0, "user", "b"), (None, 0, "user", "lost"), (4, 0, "assistant", "é" * 9000),
    ])
    rejected = table([
        (1, 0, "system", None), (1, 1, "user", "q <|im_end|>"), (1, 2, "assistant", "no"), (2, 0, "user", "same"),
        (3, 0, "user", "b"), (3, 0, None, "a"), (3, 1, "assistant", "c"),
    ])
    got = {r.pair_id: r for r in preferences.format_preferences(chosen, rejected).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    one = got[1]
    assert one.n_common == 2
    assert one.prompt == "<|im_start|>system\n<|im_end|>\n<|im_start|>user\nq < |im_end|><|im_end|>\n"
    assert one.chosen == "<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert [one.chosen[s.start : s.end] for s in one.chosen_spans] == ["yes<|im_end|>"]
    assert [one.rejected[s.start : s.end] for s in one.rejected_spans] == ["no<|im_end|>"]
    assert got[2].identical and got[2].chosen == got[2].rejected == "" and not one.identical
    assert got[3].n_common == 2 and got[3].chosen == "" and got[3].prompt.startswith("<|im_start|>unknown\na")
    four = got[4]
    assert four.prompt == four.rejected == "" and [four.chosen[s.start : s.end] for s in four.chosen_spans] == ["é" * 9000 + "<|im_end|>"]


def test_pairs_from_neighbours(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (1, 0, "assistant", "a1"), (1, 1, "user", "z"), (2, 0, "user", "q"), (2, 1, "assistant", "a2")]
    rows += [(5, 0, "user", "only")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], TURNS)
    got = {r.pair_id: r for r in preferences.with_other_reply(turns, "pair_id").collect()}
    assert [t.text for t in got[0].rejected] == ["q", "a1"]
    assert [t.text for t in got[1].rejected] == ["a0", "z"]
    assert [t.text for t in got[2].rejected] == ["q"]
    assert [t.text for t in got[5].rejected] == ["only"]
