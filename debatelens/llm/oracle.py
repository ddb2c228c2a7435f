"""DuckDB SQL for those queries of this package that SQL can express."""

from __future__ import annotations

from debatelens.llm import decontamination, licenses, mixing, quality, warc

BLANKS = r"[\x20\x09-\x0D]+"
WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{BLANKS}'), lambda x: x <> '')"

SUBSTRING = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM w, unnest(range(1, len(ws) - 48)) t(i)),
low AS (SELECT k, min(doc_id) AS low FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM win JOIN low USING (k), unnest(range(0, 50)) t(j) WHERE low < doc_id),
each AS (SELECT doc_id, i, ws[i] AS word FROM w, unnest(range(1, len(ws) + 1)) t(i)),
kept AS (
  SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.i) AS text
  FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

MIXING = f"""
WITH RECURSIVE sizes AS (
  SELECT source, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS size FROM documents GROUP BY source
), weighed AS (SELECT source, size, pow(size::DOUBLE, {mixing.TEMPERATURE}) AS weight FROM sizes),
whole AS (SELECT source, weight / size * (1.0::DOUBLE * sum(size) OVER () / sum(weight) OVER ()) AS rate FROM weighed),
rates AS (SELECT source, parts, rate / parts AS rate FROM (SELECT *, greatest(ceil(rate / {mixing.MOST_RATE}), 1)::BIGINT AS parts FROM whole)),
steps(source, parts, rate, k, p, f) AS (
  SELECT source, parts, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT source, parts, rate, k + 1, p * rate / (k + 1), f + p * rate / (k + 1) FROM steps
  WHERE k < ceil(rate + 10 * sqrt(rate) + 20)
), tables AS (SELECT source, parts, list(f ORDER BY k) AS fs FROM steps GROUP BY source, parts),
keyed AS (SELECT *, '{mixing.SEED}:' || coalesce(doc_id::VARCHAR, md5(text), '') AS key FROM documents),
drawn AS (SELECT *, ('0x' || substr(md5(key), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM keyed),
counted AS (
  SELECT d.*, (len(list_filter(fs, lambda x: x <= u)) + coalesce(list_sum(list_transform(range(1, parts), lambda part:
    len(list_filter(fs, lambda x: x <= ('0x' || substr(md5('part:' || part || ':' || key), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)))), 0))::BIGINT AS n_copies
  FROM drawn d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT counted.* EXCLUDE (key, u), copy, md5(key || ':' || copy) AS shuffle_key
FROM counted, unnest(range(1, n_copies + 1)) t(copy)
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON vec_id = least.a LEFT JOIN counts ON vec_id = counts.a
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licenses() -> str:
    known = ", ".join(f"{_quoted(k)}: {_quoted(v)}" for k, v in licenses.SENTENCES.items())

    def plain(x: str) -> str:
        return f"trim(regexp_replace(translate({x}, '{licenses.UPPER}', '{licenses.LOWER}'), '[^a-z0-9]+', ' ', 'g'))"

    steps, hits = "found0 AS (SELECT doc_id, ids, spdx, tokens AS left0 FROM tokens)", []
    for i, (name, ids) in enumerate(licenses.RULES):
        wanted = _quoted("".join(f"<{x}>" for x in ids))
        steps += f",\nfound{i + 1} AS (SELECT *, replace(left{i}, {wanted}, '<>') AS left{i + 1} FROM found{i})"
        hits.append(f"CASE WHEN contains(left{i}, {wanted}) THEN {i} END")
    names = ", ".join(_quoted(name) for name, _ in licenses.RULES)
    bare = f"regexp_replace(text, {_quoted(licenses.SPDX)}, '', 'g')"
    bare = f"regexp_replace(regexp_replace({bare}, {_quoted(licenses.COMMENT)}, '\\1', 'g'), {_quoted(licenses.VERSION)}, '\\1\\2', 'g')"
    spdx = f"regexp_replace(x, {_quoted(licenses.SPDX_EXCEPTION)}, ' ', 'g')"
    spdx = f"flatten(list_transform(regexp_extract_all(text, {_quoted(licenses.SPDX)}, 1), lambda x: string_split_regex({spdx}, {_quoted(licenses.SPDX_BETWEEN)})))"
    words = ", ".join(map(_quoted, licenses.SPDX_WORDS))
    spdx = f"list_filter({spdx}, lambda x: regexp_matches(x, {_quoted(licenses.SPDX_NAME)}) AND x NOT IN ({words}))"
    last = f"left{len(licenses.RULES)}"
    return f"""
WITH names AS (SELECT [{names}] AS names),
parts AS (
  SELECT doc_id, i, part, MAP {{{known}}} AS known
  FROM (SELECT doc_id, string_split(regexp_replace({bare}, '([.!?:;])[\\x20\\x09-\\x0D]+|\\n[\\x20\\x09\\x0D]*\\n', '\\1' || chr(1), 'g'), chr(1)) AS ps
        FROM documents WHERE text IS NOT NULL),
  unnest(range(1, len(ps) + 1)) t(i), unnest([ps[i]]) u(part)
), looked AS (
  SELECT doc_id, i, known[{plain('part')}] AS whole,
    list_filter(list_transform(string_split(part, chr(10)), lambda l: known[{plain('l')}]), lambda x: x IS NOT NULL) AS each,
    regexp_matches(translate(part, '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.SUSPECT}') AS suspect
  FROM parts
), ids AS (
  SELECT doc_id, i, CASE WHEN whole IS NOT NULL THEN [whole] WHEN len(each) > 0 THEN each WHEN suspect THEN ['unknown'] END AS ids FROM looked
), tokens AS (
  SELECT d.doc_id, coalesce(any_value({spdx}), []) AS spdx, coalesce(flatten(list(ids ORDER BY i) FILTER (ids IS NOT NULL)), []) AS ids,
    coalesce(array_to_string(list_transform(flatten(list(ids ORDER BY i) FILTER (ids IS NOT NULL)), lambda x: '<' || x || '>'), ''), '') AS tokens
  FROM documents d LEFT JOIN ids USING (doc_id) GROUP BY d.doc_id
), {steps},
hit AS (SELECT *, list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL) AS hits FROM found{len(licenses.RULES)}),
named AS (SELECT hit.*, list_concat(list_transform(hits, lambda h: names[h + 1]), spdx) AS found FROM hit, names)
SELECT doc_id, array_to_string(ids, ',') AS sentences,
  array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ',') AS licenses,
  len(list_filter(ids, lambda x: x = 'unknown'))::BIGINT AS n_unknown,
  len(list_filter(string_split({last}, '<'), lambda x: len(x) > 1 AND x <> 'unknown>'))::BIGINT AS rest
FROM named
"""


def _quality() -> str:
    rests, counts = "r0 AS (SELECT *, coalesce(text, '') AS x0 FROM w)", []
    for i, cut in enumerate(quality.CLASSES):
        rests += f",\nr{i + 1} AS (SELECT *, regexp_replace(x{i}, '{cut}', '', 'g') AS x{i + 1} FROM r{i})"
        counts.append(f"length(x{i}) - length(x{i + 1})")
    last = len(quality.CLASSES)
    counts.append(f"length(x{last})")
    sums = ", ".join(f"sum(classes[{i + 1}])" for i in range(last + 1))
    common = ", ".join(f"sum(common[{i + 1}])" for i in range(quality.COMMON + 1))

    def part(a: str, b: str) -> str:
        return f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"

    def distance(x: str, ref: str) -> str:
        p, q = f"({x}[i]::DOUBLE / list_sum({x}))", f"({ref}[i]::DOUBLE / list_sum({ref}))"
        each = f"({part(p, q)} + {part(q, p)}) / 2"
        return f"round(sqrt(greatest(list_sum(list_transform(range(1, len({x}) + 1), lambda i: {each})), 0)), 6)"

    return f"""
WITH said AS (SELECT doc_id, text, lower(lang) AS lang, {WORDS} AS ws FROM documents),
often AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS place
  FROM (SELECT lang, unnest(list_transform(ws, lambda x: lower(x))) AS word FROM said) GROUP BY lang, word),
lists AS (SELECT lang, list(word ORDER BY place) AS own FROM often WHERE place <= {quality.COMMON} GROUP BY lang),
w AS (SELECT s.*, own FROM said s LEFT JOIN lists l ON s.lang IS NOT DISTINCT FROM l.lang),
{rests},
hist AS (
  SELECT doc_id, text, lang, ws, [{', '.join(counts)}] AS classes,
    list_transform(own, lambda o: len(list_filter(ws, lambda x: lower(x) = o))) AS hits
  FROM r{last}
), full_hist AS (SELECT *, list_concat(hits, [len(ws) - list_sum(hits)]) AS common FROM hist),
refs AS (
  SELECT lang, sum(len(ws)) AS ref_words, [{sums}] AS ref_classes, ([{common}])[1:max(len(common))] AS ref_common
  FROM full_hist WHERE len(ws) >= {quality.GUARD_WORDS} GROUP BY lang
), far AS (SELECT *, list_transform(ref_common, lambda x, i: CASE WHEN i = len(ref_common) THEN 1 ELSE 0 END) AS nothing FROM refs),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM w, unnest(range(1, len(ws) - 3)) t(i)),
twice AS (SELECT doc_id, k FROM win GROUP BY doc_id, k HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM win JOIN twice USING (doc_id, k), unnest(range(0, 5)) t(j) GROUP BY doc_id),
base AS (
  SELECT f.doc_id, f.lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    classes[5]::BIGINT AS n_symbols,
    len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')))::BIGINT
      - len(list_distinct(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]'))))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, classes, common
  FROM full_hist f LEFT JOIN covered c USING (doc_id)
), scored AS (
  SELECT b.*, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed,
    CASE WHEN n_words >= {quality.GUARD_WORDS} AND ref_words >= {quality.GUARD_REFERENCE} THEN {distance('classes', 'ref_classes')} END AS class_distance,
    CASE WHEN n_words >= {quality.GUARD_WORDS} AND ref_words >= {quality.GUARD_REFERENCE} THEN {distance('common', 'ref_common')} END AS word_distance,
    CASE WHEN n_words >= {quality.GUARD_WORDS} AND ref_words >= {quality.GUARD_REFERENCE} THEN round(sqrt(
      pow({quality.FOREIGN} * {distance('nothing', 'ref_common').removeprefix('round').removesuffix(', 6)') + ')'}, 2)
      + (len(ref_common) - 1) / (8 * ln(2) * n_words)), 6) END AS word_limit
  FROM base b LEFT JOIN far r ON b.lang IS NOT DISTINCT FROM r.lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, word_limit,
  NOT base_failed AND NOT coalesce(class_distance > {quality.MOST_CLASS_DISTANCE} OR word_distance > word_limit, false) AS kept
FROM scored
"""


WARC = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
top AS (SELECT payload_digest, max(page_id) AS owner FROM p WHERE payload_bytes >= {warc.LEAST_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM p LEFT JOIN top USING (payload_digest)
"""


def _preferences() -> str:
    def head(t: str) -> str:
        return f"'<|im_start|>' || replace(coalesce({t}.role, 'unknown'), '<|', '< |') || chr(10)"

    def body(t: str) -> str:
        return f"replace(coalesce({t}.text, ''), '<|', '< |') || '<|im_end|>'"

    def text(turns: str) -> str:
        return f"coalesce(array_to_string(list_transform({turns}, lambda t: {head('t')} || {body('t')} || chr(10)), ''), '')"

    def spans(turns: str) -> str:
        before = f"coalesce(list_sum(list_transform({turns}[1:i - 1], lambda t: length({head('t')} || {body('t')}) + 1)), 0)::BIGINT"
        start = f"({before} + length({head(f'{turns}[i]')}))"
        picked = f"list_filter(range(1, len({turns}) + 1), lambda i: coalesce({turns}[i].role = 'assistant', false))"
        span = f"{start} || '-' || ({start} + length({body(f'{turns}[i]')}))"
        return f"coalesce(array_to_string(list_transform({picked}, lambda i: {span}), ','), '')"

    return f"""
WITH c AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS chosen
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), l AS (
  SELECT *, list_max(list_filter(range(1, len(chosen) + 1), lambda i: coalesce(chosen[i].role = 'assistant', false))) AS last FROM c
), p AS (
  SELECT l.*, o.last IS NOT NULL AS answered, o.chosen[o.last].text AS reply
  FROM l LEFT JOIN l o ON o.conv_id = xor(l.conv_id, 1)
), r AS (
  SELECT conv_id, chosen, CASE WHEN answered
    THEN list_transform(chosen, lambda t, i: CASE WHEN i = last THEN {{'role': t.role, 'text': reply}} ELSE t END)
    ELSE list_filter(chosen, lambda t, i: i IS DISTINCT FROM last) END AS rejected
  FROM p
), n AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(chosen), len(rejected)) + 1), lambda i:
    chosen[i].role IS DISTINCT FROM rejected[i].role OR chosen[i].text IS DISTINCT FROM rejected[i].text)) - 1,
    least(len(chosen), len(rejected)))::BIGINT AS n_common
  FROM r
), s AS (SELECT conv_id, n_common, chosen[1:n_common] AS a, chosen[n_common + 1:] AS b, rejected[n_common + 1:] AS c FROM n)
SELECT conv_id AS pair_id, n_common, {text('a')} AS prompt, {text('b')} AS chosen, {spans('b')} AS chosen_spans,
  {text('c')} AS rejected, {spans('c')} AS rejected_spans, len(b) = 0 AND len(c) = 0 AS identical
FROM s
"""


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# CRC-32 bit by bit, lowest bit first, over the bytes of '<doc_id>:<run>'
SPELLING = rf"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS prefix,
    unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), counted AS (SELECT prefix, run, count(*) AS n, hex(encode(prefix || run)) AS code FROM runs GROUP BY ALL),
bytes AS (SELECT * EXCLUDE code, list_transform(range(length(code) // 2),
  lambda i: ('0x' || substr(code, 2 * i + 1, 2))::BIGINT) AS bs FROM counted),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(bs,
  lambda b: list_transform(range(8), lambda k: (b >> k::BIGINT) & 1)))),
  lambda c, bit: xor(c >> 1, (xor(c, bit) & 1) * 3988292384))) AS h FROM bytes),
vocabulary AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 97 <> 0 THEN run
    ELSE substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), edited AS (SELECT word, n, i, substr(word, 1, i - 1) || chr(1) || substr(word, i + 1) AS replaced,
  substr(word, 1, i - 1) || substr(word, i + 1) AS shorter FROM vocabulary, unnest(range(1, length(word) + 1)) t(i)),
links AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM edited a JOIN edited b ON a.replaced = b.replaced AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM edited a JOIN vocabulary v ON a.shorter = v.word
  UNION SELECT v.word, a.word, a.n FROM edited a JOIN vocabulary v ON a.shorter = v.word
), best AS (SELECT word, count(*) AS n_near, list({{'near': near, 'n': near_n}} ORDER BY near_n DESC, near)[1] AS b FROM links GROUP BY word),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 2 * v.n THEN b.near END AS form,
  CASE WHEN b.n >= 2 * v.n THEN b.n END AS form_n FROM vocabulary v LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.at AS root
FROM forms f JOIN chain c ON c.word = f.word JOIN forms e ON e.word = c.at AND e.form IS NULL
"""

ITEM_WORDS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, coalesce({ITEM_WORDS}, []) AS ws FROM documents),
b AS (SELECT item_id, {ITEM_WORDS} AS ws FROM benchmark),
windows AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS k
  FROM (SELECT *, least({decontamination.WINDOW}, len(ws)) AS m FROM b WHERE len(ws) > 0), unnest(range(1, len(ws) - m + 2)) t(i)),
places AS (SELECT doc_id, i, m, array_to_string(ws[i:i + m - 1], ' ') AS k
  FROM d, (SELECT DISTINCT m FROM windows), unnest(range(1, len(ws) - m + 2)) t(i)),
hits AS (SELECT doc_id, i, m, item_id FROM places JOIN windows USING (m, k)),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(0, m)) t(j) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
  string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""


ORACLE: dict[str, str] = {
    "op2_substring_dedup": SUBSTRING,
    "op3_poisson_mix": MIXING,
    "op4_embedding_dedup": EMBEDDINGS,
    "op6_license_rules": _licenses(),
    "op7_quality_divergence": _quality(),
    "op8_warc_source": WARC,
    "op10_preference_format": _preferences(),
    "op11_spelling_variants": SPELLING,
    "op12_decontamination": CONTAMINATION,
}
