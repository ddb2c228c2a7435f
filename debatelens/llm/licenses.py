"""Licence scans by sentence rules, in column expressions only.

Sentences are normalised and mapped to identifiers of known licence sentences; the
identifiers of a text, in order, are matched against ordered rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UNKNOWN = "unknown"

# Sentences of public licence texts and notices, normalised, by identifier.
SENTENCES = {
    "released under the mit license": "mit-note",
    "licensed under the mit license": "mit-note",
    "this project is licensed under the mit license": "mit-note",
    "this software is released under the mit license": "mit-note",
    "the mit license": "mit-title",
    "mit license": "mit-title",
    "the mit license mit": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "licensed under the apache license version 2 0": "apache2-note",
    "released under the apache license version 2 0": "apache2-note",
    "licensed under the apache license version 2 0 the license": "apache2-head",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache2-head-comply",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "http www apache org licenses license 2 0": "apache2-url",
    "https www apache org licenses license 2 0": "apache2-url",
    "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-url-basis",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "this work is licensed under the gnu general public license version 3": "gpl3-note",
    "licensed under the gnu general public license version 3": "gpl3-note",
    "licensed under the gnu general public license version 2": "gpl2-note",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "this program is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-terms-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-terms-later",
    "either version 3 of the license or at your option any later version": "gpl3-or-later",
    "either version 2 of the license or at your option any later version": "gpl2-or-later",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-implied",
    "see the gnu general public license for more details": "gpl-details",
    "you should have received a copy of the gnu general public license along with this program": "gpl-received",
    "if not see http www gnu org licenses": "gpl-see",
    "if not see https www gnu org licenses": "gpl-see",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "this library is free software": "lgpl-free",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-terms",
    "either version 2 1 of the license or at your option any later version": "gpl21-or-later",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-terms-later",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-terms-later",
    "this library is distributed in the hope that it will be useful but without any warranty": "lgpl-hope",
    "see the gnu lesser general public license for more details": "lgpl-details",
    "you should have received a copy of the gnu lesser general public license along with this library": "lgpl-received",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-terms-later",
    "see the gnu affero general public license for more details": "agpl-details",
    "you should have received a copy of the gnu affero general public license along with this program": "agpl-received",
    "this source code form is subject to the terms of the mozilla public license v2 0": "mpl2-subject",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-copy",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2-terms",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 which accompanies this distribution and is available at https www eclipse org legal epl 2 0": "epl2-terms",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-domain",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-free",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-dedicated",
    "licensed under cc by 4 0": "cc-by4-note",
    "licensed under cc by sa 4 0": "cc-by-sa4-note",
    "licensed under cc by nc 4 0": "cc-by-nc4-note",
    "licensed under cc by nd 4 0": "cc-by-nd4-note",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by4-note",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa4-note",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc4-note",
}

# Licences by the identifiers that must follow each other, first match first.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("Apache-2.0", ["apache2-head", "apache2-comply", "apache2-copy", "apache2-url", "apache2-basis", "apache2-see"]),
    ("Apache-2.0", ["apache2-head-comply", "apache2-copy", "apache2-url-basis", "apache2-see"]),
    ("Apache-2.0", ["apache2-head-comply", "apache2-copy", "apache2-url", "apache2-basis", "apache2-see"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-terms", "gpl3-or-later"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-terms", "gpl2-or-later"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-terms-later"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-terms-later"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("LGPL-2.1-or-later", ["lgpl-free", "lgpl-terms", "gpl21-or-later"]),
    ("LGPL-3.0-or-later", ["lgpl-free", "lgpl-terms", "gpl3-or-later"]),
    ("LGPL-2.1-or-later", ["lgpl-free", "lgpl21-terms-later"]),
    ("LGPL-3.0-or-later", ["lgpl-free", "lgpl3-terms-later"]),
    ("LGPL-3.0-or-later", ["gpl-free", "lgpl3-terms-later"]),
    ("AGPL-3.0-or-later", ["gpl-free", "agpl-terms", "gpl3-or-later"]),
    ("AGPL-3.0-or-later", ["gpl-free", "agpl3-terms-later"]),
    ("MPL-2.0", ["mpl2-subject", "mpl2-copy"]),
    ("EPL-2.0", ["epl2-terms"]),
    ("ISC", ["isc-grant"]),
    ("Zlib", ["zlib-warranty", "zlib-liability", "zlib-grant"]),
    ("Unlicense", ["unlicense-domain", "unlicense-free"]),
    ("CC0-1.0", ["cc0-dedicated"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-note"]),
    ("MIT", ["mit-title"]),
    ("Apache-2.0", ["apache2-note"]),
    ("GPL-3.0-only", ["gpl3-note"]),
    ("GPL-2.0-only", ["gpl2-note"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4-note"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4-note"]),
    ("CC-BY-ND-4.0", ["cc-by-nd4-note"]),
    ("CC-BY-4.0", ["cc-by4-note"]),
]
#: A text without any of these has no sentence of ``SENTENCES`` and none that looks like a licence.
HINTS = "(?i)licen[sc]e|public domain|domain worldwide|damages|source code form|this library|copyright|permission|warrant|redistribut|gnu|program|compliance|obtain|version|neither|liable"
#: An unknown sentence with one of these is reported as unknown.
SUSPECT = "licen[sc]e|copyright"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A sentence ends at its mark with a blank behind it, or at an empty line.
ENDS = r"([.!?:;])[\x20\x09-\x0D]+|\n[\x20\x09\x0D]*\n"
MARK = "\x01"
#: Marks of comments at the start of a line; a line of nothing else is an empty one.
COMMENT = r"(^|\n)[\x20\x09]*(?:/\*+|\*+/?|//+|#+|--+|;+|%+|<!--+)[\x20\x09]*"
#: A version behind "v." is no end of a sentence.
VERSION = r"([Vv])\.[\x20\x09-\x0D]+([0-9])"
#: A line that names licences by identifiers; what stands between these, and an exception's name.
SPDX, SPDX_BETWEEN, SPDX_EXCEPTION = r"SPDX-License-Identifier:([^\n\r]*)", r"[\x20\x09()]+", r" WITH [\x20\x09]*[^\x20\x09()]+"
SPDX_NAME, SPDX_WORDS = r"^[A-Za-z0-9][A-Za-z0-9.+-]*$", ["AND", "OR", "NONE", "NOASSERTION"]


def normalised(sentence: Column) -> Column:
    """Lower case; whatever is no ASCII letter or digit becomes one blank."""
    plain = F.regexp_replace(F.translate(sentence, UPPER, LOWER), "[^a-z0-9]+", " ")
    return F.trim(plain)


def spdx_names(text: Column) -> Column:
    """Identifiers in the SPDX lines of a text, in order, each once; exceptions are left out."""
    lines = F.regexp_extract_all(text, F.lit(SPDX), F.lit(1))
    names = F.flatten(F.transform(lines, lambda x: F.split(F.regexp_replace(x, SPDX_EXCEPTION, " "), SPDX_BETWEEN)))
    named = F.filter(names, lambda x: x.rlike(SPDX_NAME) & ~x.isin(SPDX_WORDS))
    return F.array_distinct(named)


def uncommented(text: Column) -> Column:
    """A text without the marks of comments and without SPDX lines, which are read for themselves."""
    plain = F.regexp_replace(F.regexp_replace(text, SPDX, ""), COMMENT, "$1")
    return F.regexp_replace(plain, VERSION, "$1$2")


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order, ``unknown`` among them.

    A sentence may reach over lines. If it is not known as a whole, its lines are looked
    up one by one (a notice often stands on a line of its own, without a full stop
    before it). If none of them is known and it speaks of a licence, it is unknown.
    """
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])

    def one(sentence: Column) -> Column:
        lines = F.transform(F.split(sentence, "\n"), normalised)
        whole = F.try_element_at(known, normalised(sentence))
        each = F.filter(F.transform(lines, lambda x: F.try_element_at(known, x)), lambda x: x.isNotNull())
        suspect = F.translate(sentence, UPPER, LOWER).rlike(SUSPECT)
        none = F.array().cast("array<string>")
        return (
            F.when(whole.isNotNull(), F.array(whole))
            .when(F.size(each) > 0, each)
            .when(suspect, F.array(F.lit(UNKNOWN)))
            .otherwise(none)
        )

    parts = F.split(F.regexp_replace(uncommented(text), ENDS, "$1" + MARK), MARK)
    found = F.flatten(F.transform(parts, one))
    # a caller's sentences need not hold a hint
    looked = text.rlike(HINTS) if sentences == SENTENCES else text.isNotNull()
    return F.when(looked, found).otherwise(F.array().cast("array<string>"))


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentences: dict[str, str] = SENTENCES,
    rules: list[tuple[str, list[str]]] = RULES,
) -> DataFrame:
    """(doc_id, sentences, licenses, n_unknown, rest), one row per row of ``docs``.

    Marks of line and block comments are cut before the text is cut into sentences. An SPDX
    line adds the licences that it names, behind those of the rules.

    ``sentences`` are the identifiers in the text's order, ``licenses`` the licences of
    the rules that match, in the rules' order and each once. A rule matches where its
    identifiers follow each other; what it matches is used up, so that a later rule with
    fewer sentences does not match it again. ``n_unknown`` counts sentences that speak of
    a licence but are not known, ``rest`` counts known ones that no rule used. A null or
    empty text has none. Repeated rows and null ids get a row each, other columns are
    ignored, an empty table gives no rows.
    """
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spdx = F.when(F.contains("text", F.lit("SPDX-License-Identifier:")), spdx_names(F.col("text")))
    out = out.select("doc_id", sentence_ids(F.col("text"), sentences).alias("sentences"), spdx.alias("spdx"))
    tokens = F.array_join(F.transform("sentences", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    out = out.withColumn("left0", tokens)
    hits = []
    for i, (name, ids) in enumerate(rules):
        wanted = "".join(f"<{x}>" for x in ids)
        after = F.replace(F.col(f"left{i}"), F.lit(wanted), F.lit("<>"))
        out = out.withColumn(f"left{i + 1}", after)
        hits.append(F.when(F.contains(F.col(f"left{i}"), F.lit(wanted)), F.lit(name)))
    named = F.coalesce("spdx", F.array().cast("array<string>"))
    last = F.col(f"left{len(rules)}")
    unknown = F.size(F.filter("sentences", lambda x: x == UNKNOWN)).cast("long")
    remaining = F.size(F.filter(F.split(last, "<"), lambda x: (F.length(x) > 1) & (x != f"{UNKNOWN}>")))
    return out.select(
        "doc_id",
        "sentences",
        F.array_distinct(F.concat(F.filter(F.array(*hits), lambda x: x.isNotNull()), named)).alias("licenses"),
        unknown.alias("n_unknown"),
        remaining.cast("long").alias("rest"),
    )
