"""SQL that computes each registered query on its own, over the same tables.

Written from the definition of the results and not from the DataFrame plans: cross
tables come from joins with a grid, ranks from windows, lexicon rules from lagged
words.
"""

from __future__ import annotations

from math import exp, factorial

from debatelens import values as V

# --- Fixed values: names and labels of the data model, for the second computation ---
TOPICS = ["Politics", "Social Issues", "Religion", "Economy", "Technology", "Climate Change", "Human Rights", "Education"]
LEVELS = ["none", "light", "strong"]
MODES = ["neutral", "provocative", "extreme"]
PROCON = ["pro-con-neutral", "pro-con-provocative", "pro-con-extreme"]
LABELS = ["POSITIVE", "NEGATIVE", "UNKNOWN"]
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
STOP = ["the", "of", "and", "in", "to", "der", "die", "und", "la", "le", "de", "el", "que"]
SIGNED = ["textblob_polarity", "vader_compound", "transformer_sentiment", "distilbert_sentiment"]
SIGNALS = (
    "sentiment_score escalation textblob_polarity textblob_subjectivity vader_compound vader_neg vader_neu "
    "vader_pos transformer_label transformer_score toxicity_is_toxic toxicity_score escalation_reason "
    "distilbert_label distilbert_score"
).split()


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def table(values: list[str], column: str) -> str:
    return f"(SELECT unnest([{quoted(values)}]) AS {column})"


def draw(factor: int, bits: int) -> str:
    return f"(((h * {factor}) >> 9) & {2**bits - 1})"


def title(c: str) -> str:
    return (
        f"array_to_string(list_transform(string_split(lower(trim({c}, '{BLANKS}')), ' '), "
        "lambda w: upper(w[1]) || w[2:]), ' ')"
    )


# --- the escalation rule over columns of the usual names ---
SCORE = """(
  CASE WHEN vader_compound < -0.8 THEN 2 WHEN vader_compound < -0.5 THEN 1 ELSE 0 END
  + CASE WHEN textblob_polarity < -0.5 THEN 3 WHEN textblob_polarity < -0.2 THEN 1 ELSE 0 END
  + CASE WHEN transformer_label <> 'NEGATIVE' THEN 0 WHEN transformer_score > 0.95 THEN 5
         WHEN transformer_score > 0.85 THEN 2 ELSE 0 END
  + CASE WHEN distilbert_label = 'NEGATIVE' AND distilbert_score > 0.85 THEN 1 ELSE 0 END
  + CASE WHEN toxicity_is_toxic THEN 3 ELSE 0 END)"""
REASONS = """list_filter([
  CASE WHEN vader_compound < -0.8 THEN 'vader_strong_negative' WHEN vader_compound < -0.5 THEN 'vader_negative' END,
  CASE WHEN textblob_polarity < -0.2 THEN 'textblob_negative' END,
  CASE WHEN textblob_polarity < -0.5 THEN 'textblob_strong_negative' END,
  CASE WHEN transformer_label = 'NEGATIVE' AND transformer_score > 0.85 THEN 'transformer_negative' END,
  CASE WHEN transformer_label = 'NEGATIVE' AND transformer_score > 0.95 THEN 'transformer_strong_negative' END,
  CASE WHEN distilbert_label <> 'NEGATIVE' THEN NULL WHEN distilbert_score > 0.99 THEN 'distilbert_strong_negative'
       WHEN distilbert_score > 0.95 THEN NULL WHEN distilbert_score > 0.85 THEN 'distilbert_negative' END,
  CASE WHEN toxicity_is_toxic THEN 'toxicity' END], lambda r: r IS NOT NULL)"""
LEVEL = f"(CASE WHEN {SCORE} >= 5 THEN 'strong' WHEN {SCORE} >= 2 THEN 'light' ELSE 'none' END)"
REASON_TEXT = f"'[' || array_to_string(list_transform({REASONS}, lambda r: '''' || r || ''''), ', ') || ']'"

# --- the message table ---
MSGS = f"""
m0 AS (SELECT *, (conv_id & 65535) * 40503 + turn * 25717 AS h FROM conversations),
m1 AS (SELECT *,
    conv_id % 7 >= 4 AS procon,
    turn % 3 <> 0 AND {draw(331, 4)} <> 0 AS scored,
    strftime(make_timestamp((1704067200 + conv_id % 2000 * 3600 + turn * 37) * 1000000), '%Y-%m-%dT%H:%M:%S') AS whole
  FROM m0),
m2 AS (SELECT
    conv_id * 1000 + turn AS id,
    conv_id::VARCHAR AS conversation_id,
    CASE WHEN {draw(3947, 8)} <> 0 THEN CASE turn % 3 WHEN 0 THEN 'Host' WHEN 1 THEN CASE WHEN procon THEN 'Pro-Bot' ELSE 'Bot 1' END
      ELSE CASE WHEN procon THEN 'Con-Bot' ELSE 'Bot 2' END END END AS speaker,
    CASE WHEN {draw(2129, 7)} = 0 THEN ' \n\t ' ELSE text END AS message,
    CASE WHEN {draw(911, 6)} = 0 THEN NULL WHEN {draw(877, 2)} = 0 THEN whole
      ELSE whole || '.' || lpad(({draw(7919, 16)} * 13)::VARCHAR, 6, '0') END AS timestamp,
    ['Politics', '\tsocial issues\n', 'Religion', 'ECONOMY', 'Technology', 'climate change', 'Human Rights',
     'Education', 'Gender Equality', 'Immigration'][conv_id % 10 + 1] AS category,
    CASE WHEN conv_id % 41 = 40 THEN NULL
      WHEN procon THEN ['pro-con-neutral', 'Pro-Con-Provocative', 'pro-con-extreme'][conv_id % 3 + 1]
      ELSE ['neutral', 'Provocative\t', 'extreme'][conv_id % 3 + 1] END AS host_mode,
    CASE WHEN conv_id % 11 = 10 THEN 'deepseek' WHEN conv_id % 13 = 12 THEN 'ollama' ELSE 'openai' END AS api,
    scored,
    CASE WHEN scored THEN ({draw(1613, 11)} - 1024) / 1025e0 END AS textblob_polarity,
    CASE WHEN scored THEN {draw(677, 10)} / 1023e0 END AS textblob_subjectivity,
    CASE WHEN scored THEN ({draw(2711, 14)} - 8192) / 8193e0 END AS vader_compound,
    CASE WHEN scored THEN {draw(73, 7)} / 509e0 END AS vader_neg,
    CASE WHEN scored THEN {draw(79, 7)} / 509e0 END AS vader_pos,
    CASE WHEN scored THEN (509 - {draw(73, 7)} - {draw(79, 7)}) / 509e0 END AS vader_neu,
    CASE WHEN NOT scored THEN NULL WHEN {draw(4799, 3)} = 7 THEN 'UNKNOWN' WHEN {draw(4799, 3)} = 3 THEN 'NEUTRAL'
      WHEN {draw(4799, 1)} = 0 THEN 'NEGATIVE' ELSE 'POSITIVE' END AS transformer_label,
    CASE WHEN scored THEN ({draw(8311, 13)} + 8192) / 16387e0 END AS transformer_score,
    CASE WHEN NOT scored THEN NULL WHEN {draw(5903, 2)} = 1 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS distilbert_label,
    CASE WHEN scored THEN ({draw(8999, 11)} + 8192) / 10243e0 END AS distilbert_score,
    CASE WHEN NOT scored THEN NULL WHEN {draw(5987, 2)} = 1 THEN 'TOXIC' ELSE 'CLEAN' END AS toxicity_label,
    CASE WHEN scored THEN {draw(9749, 10)} / 1023e0 END AS toxicity_score
  FROM m1),
m3 AS (SELECT *, CASE WHEN scored THEN toxicity_label = 'TOXIC' AND toxicity_score > 0.8 END AS toxicity_is_toxic,
    vader_compound AS sentiment_score FROM m2),
msgs AS (SELECT *, CASE WHEN scored THEN {LEVEL} END AS escalation,
    CASE WHEN speaker = 'Host' THEN 'None' WHEN scored THEN {REASON_TEXT} END AS escalation_reason FROM m3),
named AS (SELECT * REPLACE ({title('category')} AS category, lower(trim(host_mode, '{BLANKS}')) AS host_mode),
    lower(trim(escalation, '{BLANKS}')) AS escalation_level FROM msgs),
main_bots AS (SELECT * FROM named WHERE api = 'openai' AND category IN ({quoted(TOPICS)})
    AND NOT starts_with(host_mode, 'pro-con') AND speaker IN ('Bot 1', 'Bot 2')),
procon_bots AS (SELECT * FROM named WHERE starts_with(host_mode, 'pro-con') AND speaker IN ('Pro-Bot', 'Con-Bot')),
mode_bots AS (SELECT * FROM named WHERE host_mode IS NOT NULL AND escalation_level IS NOT NULL
    AND speaker IN ('Bot 1', 'Bot 2'))"""
SIGN = """signed AS (SELECT *,
    CASE WHEN transformer_score IS NULL THEN NULL WHEN transformer_label = 'POSITIVE' THEN transformer_score
      WHEN transformer_label = 'NEGATIVE' THEN -transformer_score ELSE 0e0 END AS transformer_sentiment,
    CASE WHEN distilbert_score IS NULL THEN NULL WHEN distilbert_label = 'POSITIVE' THEN distilbert_score
      WHEN distilbert_label = 'NEGATIVE' THEN -distilbert_score ELSE 0e0 END AS distilbert_sentiment
  FROM {source})"""


def q(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([MSGS, *ctes]) + "\n" + body


def turns(source: str) -> str:
    return (
        f"turns AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY timestamp NULLS LAST, id) - 1 "
        f"AS turn FROM {source})"
    )


def level_counts(prefix: str = "", level: str = "escalation") -> str:
    return ", ".join(f"count(*) FILTER ({level} = '{v}') AS {prefix}{v}" for v in LEVELS)


def rates(source: str, axes: dict[str, list[str]]) -> str:
    """Rows of a grid with the rate of each level per 1000 messages."""
    grid = " CROSS JOIN ".join(table(values, axis) for axis, values in axes.items())
    keys = ", ".join(axes)
    return f"""rates AS (SELECT {keys}, {", ".join(
        f"coalesce(c_{v} * 1e3 / nullif(n, 0), 0) AS {v}" for v in LEVELS)}
      FROM (SELECT * FROM {grid}) LEFT JOIN (
        SELECT {keys}, count(*) AS n, {level_counts("c_")} FROM {source} GROUP BY {keys}) USING ({keys}))"""


def rounded(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f'round("{c}", {digits}) AS "{c}"' for c in columns)


def level_shares(source: str, keys: str, scale: str, level: str = "escalation") -> str:
    whole = " + ".join(f"c_{v}" for v in LEVELS)
    return f"""SELECT {keys}, {", ".join(f"round(c_{v} * {scale} / ({whole}), 6) AS {v}" for v in LEVELS)}
      FROM (SELECT {keys}, {level_counts("c_", level)} FROM {source} WHERE {level} IS NOT NULL GROUP BY {keys})"""


def heatmap(modes: list[str], values: list[str]) -> str:
    cells = [
        f"""round(max({v}) FILTER (host_mode = '{m}'), 6) AS "{m if len(values) == 1 else m + "_" + v}" """
        for m in modes
        for v in values
    ]
    return f"SELECT category, {', '.join(cells)} FROM rates GROUP BY category"


def label_table(label: str) -> str:
    return f"""SELECT escalation, label, sum(n)::BIGINT AS n FROM (
        SELECT escalation, label, 0 AS n FROM {table(LEVELS, "escalation")} CROSS JOIN {table(LABELS, "label")}
        UNION ALL SELECT escalation, {label} AS label, 1 AS n FROM main_bots
          WHERE escalation IN ({quoted(LEVELS)}) AND {label} IS NOT NULL)
      GROUP BY escalation, label"""


def long_share(source: str, keys: str, label: str) -> str:
    return f"""SELECT {keys}, {label}, round(count(*) / sum(count(*)) OVER (PARTITION BY {keys}), 6) AS share
      FROM {source} WHERE {label} IS NOT NULL GROUP BY {keys}, {label}"""


def melt(source: str, metrics: list[str], keep: str = "") -> str:
    lead = keep + ", " if keep else ""
    parts = [f"SELECT {lead}'{m}' AS metric, {m}::DOUBLE AS value FROM {source} WHERE {m} IS NOT NULL" for m in metrics]
    return "long AS (" + " UNION ALL ".join(parts) + ")"


def box(source: str, keys: str, value: str, where: str = "true") -> str:
    joined = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    listed = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""SELECT {listed}, "count", round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
        round(any_value(q3), 6) AS q3,
        round(min({value}::DOUBLE) FILTER ({value} >= q1 - 1.5e0 * (q3 - q1) AND {value} <= q3 + 1.5e0 * (q3 - q1)), 6) AS whisker_low,
        round(max({value}::DOUBLE) FILTER ({value} >= q1 - 1.5e0 * (q3 - q1) AND {value} <= q3 + 1.5e0 * (q3 - q1)), 6) AS whisker_high,
        count(*) FILTER ({value} < q1 - 1.5e0 * (q3 - q1) OR {value} > q3 + 1.5e0 * (q3 - q1)) AS outliers
      FROM {source} a JOIN (SELECT {keys}, count(*) AS "count", quantile_cont({value}::DOUBLE, 0.25) AS q1,
        quantile_cont({value}::DOUBLE, 0.5) AS median, quantile_cont({value}::DOUBLE, 0.75) AS q3
        FROM {source} WHERE {where} AND {value} IS NOT NULL GROUP BY {keys}) b ON {joined}
      WHERE {where} AND {value} IS NOT NULL GROUP BY {listed}, "count" """


def trend(extra: str) -> str:
    return f"""SELECT turn, speaker, count(o) AS n, round(avg(o), 6) AS mean_level, {extra}
      FROM (SELECT turn, speaker, CASE escalation WHEN 'none' THEN 0 WHEN 'light' THEN 1 WHEN 'strong' THEN 2 END AS o
        FROM turns) GROUP BY turn, speaker HAVING count(o) > 0"""


# chances of at most 0, 1, 2 ... copies under a Poisson distribution of mean one
POISSON = [sum(exp(-1) / factorial(i) for i in range(k + 1)) for k in range(13)]

# --- words and lexicons ---
WORDS = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"
CLOUD = (
    r"list_filter(list_transform(regexp_extract_all(lower(message), '[\p{L}\p{N}_][\p{L}\p{N}_'']+'), "
    r"lambda w: regexp_replace(w, '''s$', '')), lambda w: NOT regexp_matches(w, '^\p{N}+$'))"
)


def hex4(text: str, start: int) -> str:
    return f"('0x' || substr(md5({text}), {start}, 4))::BIGINT"


BENCH_WORDS = f"bench_words AS (SELECT DISTINCT unnest({WORDS.format(c='text')}) AS word FROM benchmark)"
VALENCE = f"""valence AS (SELECT word, ({hex4('word', 5)} % 79 - 39) / 1e1 AS valence FROM bench_words
    WHERE {hex4('word', 1)} % 3 <> 0)"""
POLARITY = f"""polarity AS (SELECT word, ({hex4('word', 13)} % 201 - 100) / 1e2 AS polarity,
    {hex4('word', 17)} % 101 / 1e2 AS subjectivity FROM bench_words WHERE {hex4('word', 9)} % 2 = 0)"""

_PUNCT = r"""(?:[.!?,;:''"-]|!!|!!!|\?\?|\?\?\?|\?!\?|!\?!|\?!\?!|!\?!\?)"""
_PLAIN = r"""([^!-/:-@\[-`{-~\s]{2,})"""


def _step(d: int, damping: str) -> str:
    praise = {
        1: "",
        2: "WHEN w2 = 'never' AND w1 IN ('so', 'this') THEN 1.5e0",
        3: "WHEN w3 = 'never' AND (w1 IN ('so', 'this') OR w2 IN ('so', 'this')) THEN 1.25e0",
    }[d]
    v = f"v{d - 1}"
    return f"""CASE WHEN w{d} IS NOT NULL AND l{d} IS NULL THEN ({v} + CASE WHEN s{d} <> 0 THEN (
        s{d} * CASE WHEN {v} < 0 THEN -1 ELSE 1 END + CASE WHEN mixed AND u{d} THEN
        CASE WHEN {v} > 0 THEN 0.733e0 ELSE -0.733e0 END ELSE 0 END) * {damping} ELSE 0 END)
        * CASE {praise} WHEN n{d} THEN -0.74e0 ELSE 1e0 END ELSE {v} END AS v{d}"""


def _lags() -> str:
    return ", ".join(
        f"lag({c}, {d}) OVER (PARTITION BY id ORDER BY pos) AS {a}{d}"
        for d in (1, 2, 3)
        for c, a in [("word", "w"), ("lex", "l"), ("capitals", "u"), ("strength", "s"), ("negates", "n")]
    )


FIXTURE_RULES = {
    "up": ["and", "der", "le", "los"], "down": ["in", "die", "de", "en"], "negators": ["of", "nicht", "qui", "no", "not"],
    "idioms": {}, "contrast": "with",
}
# --- Fixed values: word lists of the published valence method (Hutto & Gilbert 2014) ---
DEFAULT_RULES = {
    "up": V.BOOSTERS_UP, "down": V.BOOSTERS_DOWN, "negators": V.NEGATORS, "idioms": V.IDIOMS, "contrast": "but",
}
PUT_IN = ["the bomb", "bad ass", "yeah right", "kiss of death", "kind of", "sort of", "just enough", "never so",
          "isn't", "very", "at least", "least", "but", "hardly", "REALLY"]


def valence_ctes(source: str, rules: dict | None = None) -> list[str]:
    """Lexicon scores of (id, message) rows, as relation ``vader``."""
    rules = rules or FIXTURE_RULES
    idiom = "CASE {} " + " ".join(f"WHEN {quoted([p])} THEN {v}::DOUBLE" for p, v in rules["idioms"].items()) + " END"
    places = ["word next_word second_word", "word next_word", "w1 word", "w2 w1 word", "w2 w1", "w3 w2 w1", "w3 w2"]
    runs = [p.replace(" ", " || ' ' || ") for p in places]
    pairs = [b for b in rules["down"] + rules["up"] if " " in b]
    weak = f"CASE WHEN w3 || ' ' || w2 IN ({quoted(pairs)}) OR w2 || ' ' || w1 IN ({quoted(pairs)}) THEN 0.293e0 ELSE 0 END"
    said = f"coalesce({', '.join(idiom.format(r) for r in runs)}, v3) - {weak}" if rules["idioms"] else "v3"
    return [
        BENCH_WORDS,
        VALENCE,
        rf"""t0 AS (SELECT id, message, list_filter(regexp_split_to_array(message, '[\s\p{{Z}}]+'),
            lambda t: length(t) > 1) AS l FROM {source}),
        t1 AS (SELECT id, unnest(l) AS raw0, generate_subscripts(l, 1) AS pos FROM t0),
        t2 AS (SELECT id, pos, regexp_replace(regexp_replace(raw0, '^{_PUNCT}{_PLAIN}$', '\1'),
            '^{_PLAIN}{_PUNCT}$', '\1') AS raw FROM t1),
        t3 AS (SELECT id, pos, lower(raw) AS word, upper(raw) = raw AND lower(raw) <> raw AS capitals,
            CASE WHEN lower(raw) IN ({quoted(rules["up"])}) THEN 0.293e0
                 WHEN lower(raw) IN ({quoted(rules["down"])}) THEN -0.293e0 ELSE 0e0 END AS strength,
            lower(raw) IN ({quoted(rules["negators"])}) OR contains(lower(raw), 'n''t') AS negates FROM t2),
        t4 AS (SELECT t3.*, valence.valence AS lex FROM t3 LEFT JOIN valence USING (word)),
        t5 AS (SELECT *, {_lags()}, lead(word) OVER (PARTITION BY id ORDER BY pos) AS next_word,
            lead(word, 2) OVER (PARTITION BY id ORDER BY pos) AS second_word,
            count(*) FILTER (capitals) OVER (PARTITION BY id) BETWEEN 1 AND count(*) OVER (PARTITION BY id) - 1 AS mixed,
            min(pos) FILTER (word = '{rules["contrast"]}') OVER (PARTITION BY id) AS turn_at FROM t4),
        t6 AS (SELECT *, lex + CASE WHEN mixed AND capitals THEN sign(lex) * 0.733e0 ELSE 0 END AS v0 FROM t5),
        t7 AS (SELECT *, {_step(1, "1e0")} FROM t6),
        t8 AS (SELECT *, {_step(2, "0.95e0")} FROM t7),
        t9 AS (SELECT * REPLACE (CASE WHEN w3 IS NOT NULL AND l3 IS NULL AND v3 IS NOT NULL THEN {said} ELSE v3 END AS v3)
            FROM (SELECT *, {_step(3, "0.9e0")} FROM t8)),
        ta AS (SELECT id, pos, CASE WHEN lex IS NULL OR strength <> 0 OR (word = 'kind' AND next_word = 'of') THEN 0e0
            ELSE v3 * CASE WHEN w1 = 'least' AND l1 IS NULL AND coalesce(w2 NOT IN ('at', 'very'), true) THEN -0.74e0 ELSE 1e0 END
              * CASE WHEN turn_at IS NULL OR pos = turn_at THEN 1e0 WHEN pos < turn_at THEN 0.5e0 ELSE 1.5e0 END
            END AS v FROM t9),
        tb AS (SELECT id, sum(v ORDER BY pos) AS s, coalesce(sum(v + 1 ORDER BY pos) FILTER (v > 0), 0) AS p,
            coalesce(sum(1 - v ORDER BY pos) FILTER (v < 0), 0) AS n, count(*) FILTER (v = 0) AS z FROM ta GROUP BY id),
        tc AS (SELECT t0.id, message, coalesce(s, 0e0) AS s, coalesce(p, 0e0) AS p, coalesce(n, 0e0) AS n, coalesce(z, 0) AS z,
            least(length(message) - length(replace(message, '!', '')), 4) * 0.292e0
            + CASE WHEN length(message) - length(replace(message, '?', '')) > 3 THEN 0.96e0
                   WHEN length(message) - length(replace(message, '?', '')) > 1
                   THEN (length(message) - length(replace(message, '?', ''))) * 0.18e0 ELSE 0 END AS e
            FROM t0 LEFT JOIN tb USING (id)),
        td AS (SELECT id, s + sign(s) * e AS s, p + CASE WHEN p > n THEN e ELSE 0 END AS p,
            n + CASE WHEN p < n THEN e ELSE 0 END AS n, z FROM tc),
        vader AS (SELECT id, round(s / sqrt(s * s + 15), 4) AS vader_compound,
            round(coalesce(n / nullif(p + n + z, 0), 0), 3) AS vader_neg,
            round(coalesce(z / nullif(p + n + z, 0), 0), 3) AS vader_neu,
            round(coalesce(p / nullif(p + n + z, 0), 0), 3) AS vader_pos FROM td)""",
    ]


def polarity_ctes(source: str, bench: bool = True) -> list[str]:
    """Mean lexicon values of (id, message) rows, as relation ``blob``."""
    return [
        *([BENCH_WORDS] if bench else []),
        POLARITY,
        f"""b0 AS (SELECT id, unnest({WORDS.format(c='message')}) AS word FROM {source}),
        b1 AS (SELECT id, sum(round(polarity * 1e10)::BIGINT)::DOUBLE / (count(*) * 1e10) AS polarity,
            sum(round(subjectivity * 1e10)::BIGINT)::DOUBLE / (count(*) * 1e10) AS subjectivity
            FROM b0 JOIN polarity USING (word) GROUP BY id),
        blob AS (SELECT s.id, coalesce(polarity, 0e0) AS textblob_polarity, coalesce(subjectivity, 0e0) AS textblob_subjectivity
            FROM {source} s LEFT JOIN b1 USING (id))""",
    ]


INPUT = "substr(message, 1, 512)"
MODEL = {
    "transformer_label": f"CASE WHEN {hex4(INPUT, 1)} % 2 = 0 THEN 'NEGATIVE' ELSE 'POSITIVE' END",
    "transformer_score": f"(5000 + {hex4(INPUT, 5)} % 5001) / 1e4",
    "distilbert_label": f"CASE WHEN {hex4(INPUT, 9)} % 2 = 0 THEN 'NEGATIVE' ELSE 'POSITIVE' END",
    "distilbert_score": f"(8000 + {hex4(INPUT, 13)} % 2001) / 1e4",
    "toxicity_score": f"({hex4(INPUT, 21)} % 10001) / 1e4",
    "toxicity_is_toxic": f"{hex4(INPUT, 17)} % 4 = 0 AND ({hex4(INPUT, 21)} % 10001) / 1e4 > 0.8",
}
MODEL_COLUMNS = ", ".join(f"{expr} AS {name}" for name, expr in MODEL.items())


def enriched(source: str) -> list[str]:
    """Fully scored (id, message) rows, as relation ``rich``."""
    return [
        *valence_ctes(source),
        *polarity_ctes(source, bench=False),
        f"""r0 AS (SELECT id, message, {MODEL_COLUMNS} FROM {source}),
        r1 AS (SELECT * FROM r0 JOIN vader USING (id) JOIN blob USING (id)),
        rich AS (SELECT *, vader_compound AS sentiment_score, {SCORE} AS escalation_score, {LEVEL} AS escalation,
            {REASONS} AS reasons FROM r1)""",
    ]


def top(source: str, by: str, key: str, n: int) -> str:
    return f"""SELECT * FROM (SELECT {by}, {key}, n, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, {key})::INTEGER AS rank
      FROM (SELECT {by}, {key}, count(*) AS n FROM {source} GROUP BY {by}, {key})) WHERE rank <= {n}"""


def pick(options: str, key: str, seed: str) -> str:
    """Element of a sorted list by the seeded hash of a key."""
    return f"{options}[('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT % len({options}) + 1]"


CONVERSATIONS = "convs AS (SELECT DISTINCT conversation_id, category, host_mode FROM named)"
UUID = "md5('run-1|' || conversation_id)"
UUID = f"concat_ws('-', {', '.join(f'substr({UUID}, {s}, {n})' for s, n in [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)])})"
# --- Fixed values: escalation phrases ---
PHRASES = [
    "idiot", "stupid", "nonsense", "shut up", "you don't understand", "propaganda", "hate", "ignorant", "fool",
    "trash", "insult", "disgrace", "moron", "dumb", "worthless", "clueless", "pathetic", "loser", "garbage",
    "nobody cares", "get lost", "useless", "annoying", "ridiculous", "absurd", "what's wrong with you",
    "are you serious", "how dare you", "shame on you",
]


def phrase(listed: list[str]) -> str:
    choice = "|".join(p.replace("'", "''") for p in listed)
    return rf"regexp_matches(lower(message), '(^|[^\p{{L}}\p{{N}}_])({choice})([^\p{{L}}\p{{N}}_]|$)')"


def context(closing: str) -> str:
    return f"""SELECT id, md5(context{closing}) AS {{name}}, length(context{closing})::INTEGER AS chars FROM (
      SELECT id, speaker, lag(message) OVER w AS last,
        concat_ws(chr(10), lag(line, 5) OVER w, lag(line, 4) OVER w, lag(line, 3) OVER w, lag(line, 2) OVER w,
          lag(line, 1) OVER w) AS context
      FROM (SELECT *, speaker || ': ' || message AS line FROM msgs)
      WINDOW w AS (PARTITION BY conversation_id ORDER BY timestamp NULLS LAST, id)) WHERE speaker <> 'Host'"""


ASKED = """ || chr(10) || 'Host: ''' || coalesce(last, 'None') || '''' || chr(10) || CASE speaker
  WHEN 'Pro-Bot' THEN 'Pro-Bot, how do you respond positively?' WHEN 'Con-Bot' THEN 'Con-Bot, how do you respond critically?'
  ELSE speaker || ', how do you respond?' END"""
REASON_LIST = "CASE WHEN escalation_reason <> 'None' THEN regexp_extract_all(escalation_reason, '''([^'']*)''', 1) END"
EXPLODED = f"exploded AS (SELECT id, escalation, unnest({REASON_LIST}) AS reason FROM {{source}})"
PAIRED = turns("mode_bots") + """,
counted AS (SELECT conversation_id, turn // 2 AS turn, escalation_level, count(*) AS n FROM turns GROUP BY ALL),
modal AS (SELECT conversation_id, turn, escalation_level FROM counted
    QUALIFY row_number() OVER (PARTITION BY conversation_id, turn ORDER BY n DESC, escalation_level) = 1)"""
TOPIC_AXES = {"category": TOPICS}
MODE_AXES = {"host_mode": MODES}
COLUMNS = (
    "id conversation_id speaker message timestamp sentiment_score escalation textblob_polarity textblob_subjectivity "
    "vader_compound vader_neg vader_neu vader_pos transformer_label transformer_score toxicity_is_toxic toxicity_score "
    "category host_mode escalation_reason distilbert_label distilbert_score api"
).split()
DOUBLES = [c for c in COLUMNS if c.startswith(("textblob", "vader")) or c.endswith("_score")]
BACKFILLED = "textblob_polarity textblob_subjectivity vader_compound vader_neg vader_neu vader_pos transformer_label transformer_score escalation".split()
UNSCORED = "(textblob_polarity IS NULL OR vader_compound IS NULL OR transformer_label IS NULL)"
SIGNED_BOTS = SIGN.format(source="main_bots")
RANKS = """ranked AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY value) +
    (count(*) OVER (PARTITION BY metric, value) - 1) / 2e0 AS r, count(*) OVER (PARTITION BY metric, value) AS t
    FROM long WHERE escalation IN ('none', 'strong')),
  sums AS (SELECT metric, count(*) FILTER (escalation = 'none') AS n1, count(*) FILTER (escalation = 'strong') AS n2,
    sum(r) FILTER (escalation = 'none') AS r1, sum(t * t - 1.0e0) AS ties FROM ranked GROUP BY metric),
  us AS (SELECT *, r1 - n1 * (n1 + 1) / 2e0 AS u, n1 * n2 / 2e0 AS mean,
    sqrt(n1 * n2 / 12e0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1e0)))) AS sigma FROM sums)"""



def rank_p(keys: str) -> str:
    """Two-sided p of ``us``: by counting rank sums for few values without ties (``exact``),
    else the tail of the normal curve by Simpson's rule up to 12 (``smooth``)."""
    return f"""few AS (SELECT *, least(n1, n2) AS m, greatest(u, n1 * n2 - u) AS larger FROM us WHERE n1 > 0 AND n2 > 0),
        counted AS (SELECT * FROM few WHERE m <= 8 AND ties = 0),
        ways(k, j, s, c) AS (SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, 1::DOUBLE UNION ALL
          SELECT k + 1, j + d, s + d * (k + 1), sum(c) FROM ways, (VALUES (0), (1)) t(d)
          WHERE k < (SELECT max(n1 + n2) FROM counted) AND j + d <= 8 GROUP BY 1, 2, 3),
        exact AS (SELECT {keys}, least(1, 2 * sum(c) FILTER (s - m * (m + 1) / 2 >= larger) / sum(c)) AS p
          FROM counted JOIN ways ON k = n1 + n2 AND j = m GROUP BY {keys}),
        smooth AS (SELECT {keys}, least(1, 2 * any_value(12 - z) / 4000 / 3 / sqrt(2 * pi()) * sum(
            CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
            * exp(-(z + (12 - z) * i / 4000e0) * (z + (12 - z) * i / 4000e0) / 2))) AS p
          FROM (SELECT *, (larger - mean - 0.5e0) / nullif(sigma, 0) AS z FROM few WHERE m > 8 OR ties > 0)
            CROSS JOIN (SELECT unnest(range(4001)) AS i) WHERE z IS NOT NULL GROUP BY {keys})"""


COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in SIGNED)


def _component(k: int, source: str) -> list[str]:
    """Leading eigenvector x0..x3 of a 4 by 4 table by power iteration, as relation ``p<k>``
    with its value l and the sign s that makes the largest loading positive."""
    moved = [" + ".join(f"c{i}{j} * x{j}" for j in range(4)) for i in range(4)]
    xs = ", ".join(f"x{i}" for i in range(4))
    norm = "sqrt(" + " + ".join(f"y{i} * y{i}" for i in range(4)) + ")"
    largest = "greatest(" + ", ".join(f"abs(x{i})" for i in range(4)) + ")"
    return [
        f"""i{k}(n, {xs}) AS (SELECT 0, 0.51e0, 0.49e0, 0.5e0, 0.48e0 UNION ALL
          SELECT n + 1, {", ".join(f"y{i} / {norm}" for i in range(4))}
          FROM (SELECT n, {", ".join(f"{m} AS y{i}" for i, m in enumerate(moved))} FROM i{k}, {source} WHERE n < 1500))""",
        f"""p{k} AS (SELECT {xs}, sqrt({" + ".join(f"({m}) * ({m})" for m in moved)}) AS l,
          CASE WHEN {" OR ".join(f"x{i} = {largest}" for i in range(4))} THEN 1 ELSE -1 END AS s
          FROM i{k}, {source} WHERE n = 1500)""",
    ]


ORACLE: dict[str, str] = {
    "scan_messages": q(f"SELECT {', '.join(COLUMNS)} FROM msgs"),
    "scan_scored_text": q("SELECT escalation, message FROM msgs WHERE message IS NOT NULL"),
    "append_messages": q(f"SELECT {', '.join(f'round({c}, 6) AS {c}' if c in DOUBLES else c for c in COLUMNS)} FROM msgs"),
    "append_numbered": q(
        """SELECT row_number() OVER (ORDER BY speaker IS DISTINCT FROM 'Host', timestamp NULLS FIRST, id) AS id,
          id AS source_id, conversation_id, speaker, timestamp FROM msgs"""
    ),
    "ingest_conversations": q(
        f"""SELECT m.id, {UUID} AS conversation_id, speaker, timestamp, {title('category')} AS category, host_mode, api,
          {", ".join(f"round(CASE WHEN speaker IS DISTINCT FROM 'Host' THEN rich.{c} END, 6) AS {c}" if 'score' in c or 'blob' in c or 'vader' in c
           else f"CASE WHEN speaker IS DISTINCT FROM 'Host' THEN rich.{c} END AS {c}" for c in SIGNALS if c != 'escalation_reason')},
          CASE WHEN speaker IS DISTINCT FROM 'Host' THEN
            '[' || array_to_string(list_transform(rich.reasons, lambda r: '''' || r || ''''), ', ') || ']' END AS escalation_reason
        FROM msgs m JOIN rich USING (id)""",
        *enriched("msgs"),
    ),
    "ensure_columns": q(
        "SELECT id, speaker, timestamp, NULL::DOUBLE AS vader_compound, NULL::VARCHAR AS api, "
        "NULL::BOOLEAN AS toxicity_is_toxic FROM msgs"
    ),
    "backfill_unscored": q(
        "SELECT id, round(m.sentiment_score, 6) AS sentiment_score, m.distilbert_label, "
        + ", ".join(
            (f"round(CASE WHEN {{u}} THEN rich.{c} ELSE m.{c} END, 6) AS {c}" if "label" not in c and c != "escalation"
             else f"CASE WHEN {{u}} THEN rich.{c} ELSE m.{c} END AS {c}").replace(
                "{u}", "(m.textblob_polarity IS NULL OR m.vader_compound IS NULL OR m.transformer_label IS NULL)")
            for c in BACKFILLED
        )
        + " FROM msgs m JOIN rich USING (id)",
        *enriched("msgs"),
    ),
    "backfill_table": q(
        "SELECT id, m.host_mode, round(m.sentiment_score, 6) AS sentiment_score, m.distilbert_label, "
        + ", ".join(
            (f"round(CASE WHEN {{u}} THEN rich.{c} ELSE m.{c} END, 6) AS {c}" if "label" not in c and c != "escalation"
             else f"CASE WHEN {{u}} THEN rich.{c} ELSE m.{c} END AS {c}").replace(
                "{u}", "(m.textblob_polarity IS NULL OR m.vader_compound IS NULL OR m.transformer_label IS NULL)")
            for c in BACKFILLED
        )
        + " FROM msgs m JOIN rich USING (id)",
        *enriched("msgs"),
    ),
    "write_report_csv": q(
        f"SELECT host_mode, category, {rounded(LEVELS)} FROM rates", rates("main_bots", MODE_AXES | TOPIC_AXES)
    ),
    "rounded_mode_table": q(
        f"SELECT host_mode, category, {', '.join(f'round_even({v}, 0)::INTEGER AS {v}' for v in LEVELS)} FROM rates",
        rates("main_bots", MODE_AXES | TOPIC_AXES),
    ),
    "latest_messages": q(
        "SELECT id, speaker, timestamp, escalation FROM msgs ORDER BY timestamp DESC NULLS LAST, id DESC LIMIT 5"
    ),
    "norm_category": q("SELECT id, category FROM named"),
    "norm_mode_level": q("SELECT id, host_mode, escalation_level FROM named"),
    "drop_null_keys": q(
        "SELECT id, host_mode, escalation_level FROM named WHERE host_mode IS NOT NULL AND escalation_level IS NOT NULL"
    ),
    "filter_api": q("SELECT id, api FROM msgs WHERE api = 'openai'"),
    "topic_semi_join": q(f"SELECT id, category FROM named WHERE category IN ({quoted(TOPICS)})"),
    "filter_procon": q("SELECT id, host_mode FROM msgs WHERE lower(host_mode) LIKE 'pro-con%'"),
    "filter_normal": q("SELECT id, host_mode FROM msgs WHERE lower(host_mode) NOT LIKE 'pro-con%'"),
    "exclude_host": q("SELECT id, speaker FROM msgs WHERE speaker NOT ILIKE '%host%'"),
    "filter_speakers": q("SELECT id, speaker FROM msgs WHERE speaker IN ('Bot 1', 'Bot 2')"),
    "speaker_regex": q("SELECT id, speaker FROM msgs WHERE speaker ILIKE '%pro%' OR speaker ILIKE '%con%'"),
    "filter_modes": q(f"SELECT id, host_mode FROM msgs WHERE lower(trim(host_mode, '{BLANKS}')) IN ({quoted(MODES)})"),
    "parse_timestamp": q(
        "SELECT id, try_cast(timestamp AS TIMESTAMP) AS event_time, try_cast(timestamp AS TIMESTAMP)::DATE AS day, "
        "try_strptime(timestamp, '%Y-%m-%dT%H:%M:%S')::DATE AS strict_day FROM msgs"
    ),
    "message_length": q("SELECT id, length(message)::INTEGER AS length FROM msgs"),
    "signed_sentiment": q(
        f"SELECT id, {rounded(SIGNED[2:])} FROM signed", SIGN.format(source="msgs")
    ),
    "escalation_ordinal": q(
        "SELECT id, CASE escalation WHEN 'none' THEN 0 WHEN 'light' THEN 1 WHEN 'strong' THEN 2 END AS ordinal FROM msgs"
    ),
    "label_agreement": q(
        "SELECT id, coalesce(lower(transformer_label) = lower(distilbert_label), false) AS agree FROM msgs"
    ),
    "coerce_turn": q("SELECT id, CASE WHEN id % 7 = 3 THEN NULL ELSE (id % 1000)::DOUBLE END AS turn FROM msgs"),
    "turn_from_id": q("SELECT id, dense_rank() OVER (PARTITION BY conversation_id ORDER BY id // 2) AS turn FROM msgs"),
    "resolve_speaker": q("SELECT id, speaker FROM msgs WHERE speaker IN ('Bot 1', 'Bot 2')"),
    "model_input_text": q("SELECT id, message[1:512] AS text FROM msgs"),
    "message_preview": q("SELECT id, message[1:60] AS preview FROM msgs"),
    "nonblank_messages": q(f"SELECT id FROM msgs WHERE trim(message, '{BLANKS}') <> ''"),
    "lexicon_compound": q("SELECT * FROM vader", *valence_ctes("msgs")),
    "lexicon_default_rules": q(
        "SELECT * FROM vader",
        f"""put AS (SELECT id, array_to_string(list_transform(string_split(message, ' '), lambda w: CASE WHEN {hex4('w', 1)} % 5 = 0
          THEN w || ' ' || [{quoted(PUT_IN)}][{hex4('w', 1)} % {len(PUT_IN)} + 1] ELSE w END), ' ') AS message FROM msgs)""",
        *valence_ctes("put", DEFAULT_RULES),
    ),
    "lexicon_polarity": q(
        f"SELECT id, {rounded(['textblob_polarity', 'textblob_subjectivity'])} FROM blob", *polarity_ctes("msgs")
    ),
    "model_scores": q(
        "SELECT id, " + ", ".join(f"{MODEL[c]} AS {c}" for c in
        ["transformer_label", "transformer_score", "distilbert_label", "distilbert_score"]) + " FROM msgs"
    ),
    "model_fallback": q(
        f"""SELECT id, CASE WHEN {hex4(INPUT, 25)} % 5 = 0 THEN 'UNKNOWN' ELSE {MODEL['transformer_label']} END AS transformer_label,
          CASE WHEN {hex4(INPUT, 25)} % 5 = 0 THEN 0e0 ELSE {MODEL['transformer_score']} END AS transformer_score FROM msgs"""
    ),
    "toxicity_flag": q("SELECT id, coalesce(toxicity_label = 'TOXIC' AND toxicity_score > 0.8, false) AS toxic FROM msgs"),
    "escalation_score": q(f"SELECT id, ({SCORE})::INTEGER AS score FROM m3"),
    "escalation_level": q(f"SELECT id, {LEVEL} AS level FROM m3"),
    "escalation_reasons": q(f"SELECT id, array_to_string({REASONS}, '|') AS reasons FROM m3"),
    "escalation_keywords": q(
        f"SELECT id, {phrase(PHRASES)} AS flagged, {phrase(['the thing', 'thing', 'of the', 'die', 'in the', 'la'])} AS listed FROM msgs"
    ),
    "phrase_table": q(
        r"""SELECT m.id, CASE WHEN message IS NOT NULL THEN count(phrase) > 0 END AS flagged,
          CASE WHEN message IS NOT NULL THEN count(phrase)::INTEGER END AS n,
          CASE WHEN message IS NOT NULL THEN coalesce(string_agg(phrase, '|' ORDER BY phrase), '') END AS phrases
        FROM msgs m LEFT JOIN found USING (id) GROUP BY m.id, message""",
        r"""listed AS (SELECT string_split(lower(text), ' ') AS l FROM benchmark),
        runs AS (SELECT DISTINCT array_to_string(l[i:i + n - 1], ' ') AS phrase
          FROM listed, unnest(range(1, len(l) + 1)) t(i), unnest([1, 2, 3]) u(n)),
        """ + f"phrases AS (SELECT phrase FROM runs WHERE {hex4('phrase', 1)} % 3 = 0" + r""" AND regexp_matches(phrase, '[\p{L}\p{N}_]')),
        told AS (SELECT *, regexp_replace(phrase, '([\p{L}\p{N}_]+)', chr(1) || '\1' || chr(2), 'g') AS marked,
          regexp_matches(phrase, '^[\p{L}\p{N}_].*[\p{L}\p{N}_]$|^[\p{L}\p{N}_]$') AS plain FROM phrases),
        heard AS MATERIALIZED (SELECT id, lower(message) AS said,
          regexp_replace(lower(message), '([\p{L}\p{N}_]+)', chr(1) || '\1' || chr(2), 'g') AS marked FROM msgs),
        near AS MATERIALIZED (SELECT id, said, phrase, plain FROM heard h JOIN told t ON contains(h.marked, t.marked)),
        found AS (SELECT id, phrase FROM near WHERE plain OR CASE WHEN NOT plain THEN regexp_matches(said,
          '(^|[^\p{L}\p{N}_])' || regexp_escape(phrase) || '([^\p{L}\p{N}_]|$)') END)""",
    ),
    "keyword_or_toxic": q(
        f"SELECT id, {phrase([*PHRASES, 'thing'])} OR coalesce(toxicity_label = 'TOXIC' AND toxicity_score > 0.9, false) "
        "AS flagged FROM msgs"
    ),
    "enrich_messages": q(
        "SELECT id, " + rounded(["sentiment_score", "textblob_polarity", "textblob_subjectivity", "vader_compound",
        "vader_neg", "vader_neu", "vader_pos", "transformer_score", "distilbert_score", "toxicity_score"])
        + ", transformer_label, distilbert_label, toxicity_is_toxic, escalation_score::INTEGER AS escalation_score, escalation, "
        "array_to_string(reasons, '|') AS reasons FROM rich",
        *enriched("msgs"),
    ),
    "analyze_texts": f"WITH typed AS (SELECT page_id AS id, html AS message FROM pages WHERE trim(html, '{BLANKS}') <> ''),\n"
    + ",\n".join(enriched("typed"))
    + "\nSELECT id, " + rounded(["vader_compound", "textblob_polarity"])
    + ", transformer_label, distilbert_label, toxicity_is_toxic, escalation, array_to_string(reasons, ', ') "
    "AS escalation_reason FROM rich",
    "conversation_summary": q(
        "SELECT conversation_id, count(*) AS message_count, round(avg(sentiment_score), 6) AS avg_sentiment FROM msgs GROUP BY 1"
    ),
    "escalation_counts": q("SELECT escalation, count(*) AS n FROM msgs WHERE escalation IS NOT NULL GROUP BY 1"),
    "escalation_by_day": q(
        f"SELECT substr(timestamp, 1, 10)::DATE AS day, {level_counts()} FROM msgs "
        "WHERE timestamp IS NOT NULL AND escalation IS NOT NULL GROUP BY 1"
    ),
    "box_scores": q(
        box("long", "metric", "value"), melt("msgs", ["textblob_polarity", "vader_compound", "transformer_score"])
    ),
    "count_by_mode_level": q('SELECT host_mode, escalation_level, count(*) AS "count" FROM mode_bots GROUP BY 1, 2'),
    "modal_level": q("SELECT * FROM modal", PAIRED),
    "level_series": q(
        "SELECT *, CASE escalation_level WHEN 'none' THEN 0 WHEN 'light' THEN 1 WHEN 'strong' THEN 2 END "
        "AS escalation_numeric FROM modal",
        PAIRED,
    ),
    "avg_length_by_level": q(
        "SELECT escalation_level, round(avg(length(message)), 6) AS message_length FROM mode_bots GROUP BY 1"
    ),
    "box_length_by_level": q(
        box("lengths", "escalation_level", "length"),
        "lengths AS (SELECT escalation_level, length(message) AS length FROM mode_bots)",
    ),
    "pct_by_mode": q(level_shares("mode_bots", "host_mode", "1e2", "escalation_level")),
    "pct_by_mode_long": q(
        """SELECT host_mode, l.escalation_level, round(count(*) FILTER (b.escalation_level = l.escalation_level) * 1e2 / count(*), 6)
           AS percentage FROM mode_bots b CROSS JOIN """ + table(LEVELS, "escalation_level")
        + " l GROUP BY host_mode, l.escalation_level"
    ),
    "pct_by_mode_table": q(
        f"""SELECT place::INTEGER AS place, host_mode, {", ".join(
          f"round(count(*) FILTER (escalation_level = '{v}') * 1e2 / nullif(count(escalation_level), 0), 2) AS {v}" for v in LEVELS)}
        FROM (SELECT unnest([{quoted(MODES)}]) AS host_mode, unnest([1, 2, 3]) AS place) LEFT JOIN mode_bots USING (host_mode)
        GROUP BY place, host_mode"""
    ),
    "messages_per_topic": q(
        f"SELECT category, count(id) AS messages FROM {table(TOPICS, 'category')} LEFT JOIN main_bots USING (category) GROUP BY 1"
    ),
    "rate1000_by_topic": q(f"SELECT category, {rounded(LEVELS)} FROM rates", rates("main_bots", TOPIC_AXES)),
    "rate1000_by_mode": q(f"SELECT host_mode, {rounded(LEVELS)} FROM rates", rates("main_bots", MODE_AXES)),
    "rate1000_by_mode_topic": q(
        f"SELECT host_mode, category, {rounded(LEVELS)} FROM rates", rates("main_bots", MODE_AXES | TOPIC_AXES)
    ),
    "strong_heatmap": q(heatmap(MODES, ["strong"]), rates("main_bots", MODE_AXES | TOPIC_AXES)),
    "rate1000_topic_mode_level": q(heatmap(MODES, LEVELS), rates("main_bots", MODE_AXES | TOPIC_AXES)),
    "dense_grid": q(
        f"""SELECT category, host_mode, count(id) AS messages, {level_counts()} FROM {table(TOPICS, "category")}
          CROSS JOIN {table(MODES, "host_mode")} LEFT JOIN main_bots USING (category, host_mode) GROUP BY 1, 2"""
    ),
    "transformer_label_by_level": q(label_table("transformer_label")),
    "distilbert_label_by_level": q(label_table("distilbert_label")),
    "agreement_by_level": q(
        f"""SELECT escalation, count(*) FILTER (transformer_label = distilbert_label) AS "Equal",
          count(id) - count(*) FILTER (transformer_label = distilbert_label) AS "Different"
        FROM {table(LEVELS, "escalation")} LEFT JOIN main_bots USING (escalation) GROUP BY 1"""
    ),
    "level_by_bot": q(f"SELECT speaker, {level_counts()} FROM main_bots WHERE escalation IS NOT NULL GROUP BY 1"),
    "box_sentiment_by_level": q(
        box("known", "metric, escalation", "value"),
        melt("main_bots", ["textblob_polarity", "vader_compound"], "escalation"),
        "known AS (SELECT * FROM long WHERE escalation IS NOT NULL)",
    ),
    "sentiment_trend": q(
        "SELECT turn, speaker, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in
        ["textblob_polarity", "vader_compound", "transformer_score", "distilbert_score"]) + " FROM turns GROUP BY 1, 2",
        turns("main_bots"),
    ),
    "label_share_transformer": q(long_share("turns", "turn, speaker", "transformer_label"), turns("main_bots")),
    "label_share_distilbert": q(long_share("turns", "turn, speaker", "distilbert_label"), turns("main_bots")),
    "level_share_by_turn": q(level_shares("turns", "turn", "1e0"), turns("main_bots")),
    "level_trend_ci": q(
        trend("round(avg(o) - 1.96e0 * stddev_samp(o) / sqrt(count(o)), 6) AS ci_low, "
              "round(avg(o) + 1.96e0 * stddev_samp(o) / sqrt(count(o)), 6) AS ci_high"),
        turns("main_bots"),
    ),
    "level_trend_bootstrap": q(
        """SELECT turn, speaker, count(DISTINCT id) AS n, round(avg(o) FILTER (first), 6) AS mean_level,
          round(any_value(low), 6) AS ci_low, round(any_value(high), 6) AS ci_high
        FROM drawn LEFT JOIN ends USING (turn, speaker) GROUP BY turn, speaker""",
        turns("main_bots"),
        f"""drawn AS (SELECT turn, speaker, id, o, b = 0 AND i = 0 AS first, b * 4 + i AS replicate,
            {" + ".join(f"(u >= {step!r}::DOUBLE)::INTEGER" for step in POISSON)} AS w
          FROM (SELECT *, ('0x' || substr(md5('band|' || id || '|' || b), 8 * i + 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
            FROM (SELECT turn, speaker, id, CASE escalation WHEN 'none' THEN 0 WHEN 'light' THEN 1 WHEN 'strong' THEN 2 END AS o
              FROM turns), unnest(range(50)) t(b), unnest(range(4)) s(i)) WHERE o IS NOT NULL),
        means AS (SELECT turn, speaker, replicate, sum(w * o) / sum(w)::DOUBLE AS mean FROM drawn WHERE w > 0 GROUP BY ALL),
        ends AS (SELECT turn, speaker, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM means GROUP BY ALL)""",
    ),
    "sentiment_histogram": q(
        """SELECT metric, bin::INTEGER AS bin, round(lo + bin * (hi - lo) / 30, 6) AS bin_low,
          round(lo + (bin + 1) * (hi - lo) / 30, 6) AS bin_high, count(value) AS n
        FROM (SELECT *, unnest(range(30)) AS bin FROM ends) LEFT JOIN placed USING (metric, bin) GROUP BY metric, bin, lo, hi""",
        SIGNED_BOTS,
        melt("signed", SIGNED),
        """ends AS (SELECT metric, min(value) AS lo, max(value) AS hi FROM long GROUP BY 1),
        placed AS (SELECT metric, value, least(floor(30 * (value - lo) / (hi - lo)), 29)::BIGINT AS bin FROM long JOIN ends USING (metric))""",
    ),
    "sentiment_density": q(
        """SELECT metric, point::INTEGER AS point, round(x, 6) AS x,
          round(sum(exp(-((x - value) / bw) * ((x - value) / bw) / 2)) / (any_value(n) * any_value(bw) * sqrt(2 * pi())), 6) AS density
        FROM (SELECT *, lo - 3 * bw + point * ((hi + 3 * bw) - (lo - 3 * bw)) / 199 AS x FROM (
          SELECT *, unnest(range(200)) AS point FROM ends)) JOIN long USING (metric) GROUP BY metric, point, x""",
        SIGNED_BOTS,
        melt("signed", SIGNED),
        """ends AS (SELECT metric, min(value) AS lo, max(value) AS hi, count(*) AS n,
          pow(count(*), -0.2e0) * stddev_samp(value) AS bw FROM long GROUP BY 1)""",
    ),
    "parse_reasons": q(
        f"SELECT id, array_to_string({REASON_LIST}, '|') AS reasons, len({REASON_LIST})::INTEGER AS n FROM msgs"
    ),
    "reason_rows": q("SELECT * FROM exploded", EXPLODED.format(source="msgs")),
    "reason_frequency": q(
        "SELECT reason, count(*) AS n FROM exploded GROUP BY 1", EXPLODED.format(source="main_bots")
    ),
    "reason_family_frequency": q(
        f"""SELECT family, count(reason) AS n FROM {table(["VADER", "DistilBERT", "Transformer", "TextBlob", "Other"], "family")}
        LEFT JOIN (SELECT reason, CASE WHEN reason LIKE 'vader%' THEN 'VADER' WHEN reason LIKE 'distilbert%' THEN 'DistilBERT'
          WHEN reason LIKE 'transformer%' THEN 'Transformer' WHEN reason LIKE 'textblob%' THEN 'TextBlob' ELSE 'Other' END AS family
          FROM exploded) USING (family) GROUP BY 1""",
        EXPLODED.format(source="main_bots"),
    ),
    "reason_by_level": q(
        f"SELECT reason, count(*) AS n, {level_counts()} FROM exploded GROUP BY 1", EXPLODED.format(source="main_bots")
    ),
    "reason_share_by_level": q(
        """SELECT escalation, reason, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY escalation), 6) AS share
        FROM exploded WHERE escalation IS NOT NULL GROUP BY 1, 2""",
        EXPLODED.format(source="main_bots"),
    ),
    "procon_level_by_bot": q(f"SELECT speaker, {level_counts()} FROM procon_bots WHERE escalation IS NOT NULL GROUP BY 1"),
    "procon_rate1000": q(
        f"SELECT host_mode, category, {rounded(LEVELS)} FROM rates", rates("procon_bots", {"host_mode": PROCON} | TOPIC_AXES)
    ),
    "procon_strong_heatmap": q(heatmap(PROCON, ["strong"]), rates("procon_bots", {"host_mode": PROCON} | TOPIC_AXES)),
    "procon_sentiment_trend": q(
        "SELECT turn, speaker, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in
        ["vader_compound", "textblob_polarity", "transformer_score"]) + " FROM turns GROUP BY 1, 2",
        turns("procon_bots"),
    ),
    "procon_label_share": q(
        " UNION ALL ".join(
            f"SELECT '{m}' AS model, * RENAME ({m} AS label) FROM ({long_share('turns', 'turn, speaker', m)})"
            for m in ["transformer_label", "distilbert_label"]
        ),
        turns("procon_bots"),
    ),
    "procon_level_share": q(level_shares("turns", "turn", "1e0"), turns("procon_bots")),
    "procon_level_band": q(
        trend("round(stddev_samp(o), 6) AS std_level, round(avg(o) - stddev_samp(o), 6) AS band_low, "
              "round(avg(o) + stddev_samp(o), 6) AS band_high"),
        turns("procon_bots"),
    ),
    "role_level_pct": q(
        level_shares("roles", "speaker", "1e2"),
        f"""roles AS (SELECT speaker, escalation FROM named WHERE api = 'openai' AND category IN ({quoted(TOPICS)})
          UNION ALL SELECT speaker, escalation FROM procon_bots)""",
    ),
    "box_procon": q(
        box("long", "metric, speaker", "value"), melt("procon_bots", ["vader_compound", "textblob_polarity"], "speaker")
    ),
    "tokens": q(
        f"SELECT id, len({WORDS.format(c='message')})::INTEGER AS n, md5(array_to_string({WORDS.format(c='message')}, ' ')) "
        "AS words_md5 FROM msgs"
    ),
    "top_words_by_level": q(
        top("w", "escalation", "word", 20),
        f"""w AS (SELECT * FROM (SELECT escalation, unnest({WORDS.format(c='message')}) AS word FROM msgs)
          WHERE word NOT IN ({quoted(STOP)}))""",
    ),
    "negative_words": q(
        "SELECT word, count(*) AS n FROM w JOIN valence USING (word) WHERE valence < 0 GROUP BY 1 ORDER BY n DESC, word LIMIT 20",
        BENCH_WORDS, VALENCE, f"w AS (SELECT unnest({WORDS.format(c='message')}) AS word FROM msgs)",
    ),
    "negative_words_by_level": q(
        top("w", "escalation", "word", 20),
        BENCH_WORDS,
        VALENCE,
        f"""w AS (SELECT * FROM (SELECT escalation, unnest({WORDS.format(c='message')}) AS word FROM msgs)
          WHERE word IN (SELECT word FROM valence WHERE valence < 0))""",
    ),
    "term_freq_by_bot": q(
        top("w", "speaker", "word", 200),
        f"w AS (SELECT * FROM (SELECT speaker, unnest({CLOUD}) AS word FROM procon_bots) WHERE word NOT IN ({quoted(STOP)}))",
    ),
    "bigram_freq_by_bot": q(
        top("pairs", "speaker", "bigram", 200),
        f"""lists AS (SELECT id, speaker, {CLOUD} AS l FROM procon_bots),
        spread AS (SELECT id, speaker, unnest(l) AS a, generate_subscripts(l, 1) AS pos FROM lists),
        next AS (SELECT speaker, a, lead(a) OVER (PARTITION BY id ORDER BY pos) AS b FROM spread),
        pairs AS (SELECT speaker, a || ' ' || b AS bigram FROM next WHERE b IS NOT NULL
          AND a NOT IN ({quoted(STOP)}) AND b NOT IN ({quoted(STOP)}))""",
    ),
    "collocations_by_bot": q(
        """SELECT speaker, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY n DESC, term)::INTEGER AS rank
          FROM terms) WHERE rank <= 200""",
        f"""lists AS (SELECT id, speaker, {CLOUD} AS l FROM procon_bots),
        spread AS (SELECT id, speaker, unnest(l) AS a, generate_subscripts(l, 1) AS pos FROM lists),
        next AS (SELECT speaker, a, lead(a) OVER (PARTITION BY id ORDER BY pos) AS b FROM spread),
        known AS (SELECT speaker, a AS word, count(*) AS n FROM next WHERE a NOT IN ({quoted(STOP)}) GROUP BY ALL),
        bigrams AS (SELECT speaker, a || ' ' || b AS word, count(*) AS n FROM next WHERE b IS NOT NULL
          AND a NOT IN ({quoted(STOP)}) AND b NOT IN ({quoted(STOP)}) GROUP BY ALL)""",
        *[
            f"""{source}_forms AS (SELECT a.*, coalesce(b.word, a.word) AS form FROM {source} a LEFT JOIN {source} b
              ON a.speaker = b.speaker AND a.word LIKE '%s' AND a.word NOT LIKE '%ss' AND b.word = left(a.word, length(a.word) - 1)),
            {source}_counts AS (SELECT speaker, form, sum(n)::BIGINT AS n FROM {source}_forms GROUP BY ALL)"""
            for source in ("known", "bigrams")
        ],
        """totals AS (SELECT speaker, sum(n)::DOUBLE AS total FROM known_counts GROUP BY ALL),
        met AS (SELECT p.speaker, p.form AS bigram, p.n, f1.form AS one, f2.form AS two, p.n::DOUBLE AS c12, s1.n::DOUBLE AS c1, s2.n::DOUBLE AS c2, total AS t
          FROM bigrams_counts p JOIN known_forms f1 ON f1.speaker = p.speaker AND f1.word = split_part(p.form, ' ', 1)
          JOIN known_forms f2 ON f2.speaker = p.speaker AND f2.word = split_part(p.form, ' ', 2)
          JOIN known_counts s1 ON s1.speaker = p.speaker AND s1.form = f1.form
          JOIN known_counts s2 ON s2.speaker = p.speaker AND s2.form = f2.form JOIN totals ON totals.speaker = p.speaker),
        chances AS (SELECT *, c2 / t AS p, c12 / c1 AS p1, (c2 - c12) / (t - c1) AS p2 FROM met WHERE t > c1 AND t > c2),
        kept AS (SELECT * FROM chances WHERE -2 * (
          ln(greatest(p, 1e-10)) * c12 + ln(greatest(1 - p, 1e-10)) * (c1 - c12)
          + ln(greatest(p, 1e-10)) * (c2 - c12) + ln(greatest(1 - p, 1e-10)) * (t - c1 - (c2 - c12))
          - ln(greatest(p1, 1e-10)) * c12 - ln(greatest(1 - p1, 1e-10)) * (c1 - c12)
          - ln(greatest(p2, 1e-10)) * (c2 - c12) - ln(greatest(1 - p2, 1e-10)) * (t - c1 - (c2 - c12))) > 30),
        terms AS (SELECT speaker, term, sum(n)::BIGINT AS n FROM (
            SELECT speaker, form AS term, n FROM known_counts UNION ALL SELECT speaker, one, -n FROM kept UNION ALL SELECT speaker, two, -n FROM kept)
          GROUP BY ALL HAVING sum(n) > 0 UNION ALL SELECT speaker, bigram, n FROM kept)""",
    ),
    "mann_whitney": q(
        """SELECT metric, n1, n2, round(u, 6) AS u, round((greatest(u, n1 * n2 - u) - mean - 0.5e0) / sigma, 6) AS z,
          'tested' AS note FROM us""",
        SIGNED_BOTS,
        melt("signed", SIGNED, "escalation"),
        RANKS,
    ),
    "mann_whitney_small": q(
        """SELECT conversation_id, metric, n1, n2, round(u, 6) AS u, round(coalesce(e.p, s.p), 6) AS p
        FROM us LEFT JOIN exact e USING (conversation_id, metric) LEFT JOIN smooth s USING (conversation_id, metric)""",
        SIGN.format(source="main_bots"),
        melt("signed", SIGNED, "conversation_id, escalation"),
        RANKS.replace("PARTITION BY metric", "PARTITION BY conversation_id, metric").replace("SELECT metric, count", "SELECT conversation_id, metric, count")
        .replace("GROUP BY metric", "GROUP BY conversation_id, metric").replace("r1 - n1 * (n1 + 1) / 2e0 AS u", "CASE WHEN n1 > 0 AND n2 > 0 THEN r1 - n1 * (n1 + 1) / 2e0 END AS u"),
        rank_p("conversation_id, metric"),
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "mann_whitney_p": q(
        "SELECT metric, round(coalesce(e.p, s.p), 6) AS p FROM us LEFT JOIN exact e USING (metric) LEFT JOIN smooth s USING (metric)",
        SIGNED_BOTS,
        melt("signed", SIGNED, "escalation"),
        RANKS,
        rank_p("metric"),
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "seeded_sample": q(
        f"""SELECT id, {rounded(SIGNED)} FROM signed WHERE {" AND ".join(f"{c} IS NOT NULL" for c in SIGNED)}
        ORDER BY md5('42|' || id::VARCHAR), id LIMIT 100""",
        SIGNED_BOTS,
    ),
    "turn_index": q("SELECT id, conversation_id, turn FROM turns", turns("main_bots")),
    "reply_context": q(context("").format(name="context_md5")),
    "reply_prompt": q(context(ASKED).format(name="prompt_md5")),
    "host_strategy": q(
        """SELECT id, n AS host_turns, CASE WHEN n > 0 THEN
          ['fact_check', 'false_claim', 'bot_comparison', 'follow_up', 'redirect'][n % 5 + 1] END AS strategy
        FROM (SELECT *, coalesce(sum((speaker = 'Host')::INTEGER) OVER (PARTITION BY conversation_id
          ORDER BY timestamp NULLS LAST, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n FROM msgs)
        WHERE speaker = 'Host'"""
    ),
    "ordered_messages": q(
        "SELECT conversation_id, id, timestamp, speaker FROM msgs ORDER BY conversation_id, timestamp NULLS LAST, id"
    ),
    "assign_prompt": q(
        f"SELECT conversation_id, coalesce({pick('p.l', 'conversation_id', 'prompt')}, {pick('d.l', 'conversation_id', 'prompt')}) "
        "AS prompt FROM convs LEFT JOIN p USING (category, host_mode) LEFT JOIN d USING (host_mode)",
        CONVERSATIONS,
        f"""p AS (SELECT [{quoted(TOPICS[:6])}][item_id % 6 + 1] AS category, [{quoted(MODES)}][item_id // 2 % 3 + 1] AS host_mode,
          list(item_id::VARCHAR || ' ' || text ORDER BY item_id::VARCHAR || ' ' || text) AS l
          FROM benchmark GROUP BY 1, 2),
        d AS (SELECT [{quoted(MODES)}][item_id // 4 % 3 + 1] AS host_mode, list('any ' || item_id || ' ' || text ORDER BY 'any ' || item_id || ' ' || text) AS l
          FROM benchmark GROUP BY 1)""",
    ),
    "assign_claim": q(
        f"SELECT conversation_id, coalesce({pick('c.l', 'conversation_id', 'claim')}, 'This topic has no relevant data.') AS claim "
        "FROM convs LEFT JOIN c ON lower(convs.category) = c.topic",
        CONVERSATIONS,
        f"""c AS (SELECT lower([{quoted(TOPICS[3:])}][item_id % 5 + 1]) AS topic, list('claim ' || item_id || ': ' || text ORDER BY 'claim ' || item_id || ': ' || text) AS l
          FROM benchmark GROUP BY 1)""",
    ),
    "assign_topic": q(
        f"SELECT conversation_id, coalesce({pick('t.l', 'conversation_id', 'topic')}, {pick('a.l', 'conversation_id', 'topic')}) "
        "AS question FROM convs LEFT JOIN t USING (category) CROSS JOIN a",
        CONVERSATIONS,
        f"""t AS (SELECT [{quoted(TOPICS[:7])}][item_id % 7 + 1] AS category, list('question ' || item_id || ': ' || text ORDER BY 'question ' || item_id || ': ' || text) AS l
          FROM benchmark GROUP BY 1),
        a AS (SELECT list('question ' || item_id || ': ' || text ORDER BY 'question ' || item_id || ': ' || text) AS l FROM benchmark)""",
    ),
    "render_host_reaction": q(
        f"""SELECT id, drawn.strategy, md5(replace(replace(coalesce({pick('o.l', 'id', 'reaction')}, {pick('e.l', 'id', 'reaction')}),
          '{{statement}}', coalesce(statement, '')), '{{category}}', coalesce(category, 'the broader topic'))) AS reaction_md5
        FROM drawn LEFT JOIN o ON drawn.strategy = o.strategy AND lower(trim(drawn.host_mode, '{BLANKS}')) = o.host_mode
          LEFT JOIN e ON drawn.strategy = e.strategy""",
        """seen AS (SELECT *, lag(message) OVER (PARTITION BY conversation_id ORDER BY timestamp NULLS LAST, id) AS statement FROM msgs),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY timestamp NULLS LAST, id) - 1 AS n
          FROM seen WHERE speaker = 'Host'),
        drawn AS (SELECT *, ['fact_check', 'false_claim', 'bot_comparison', 'follow_up', 'redirect'][n % 5 + 1] AS strategy
          FROM placed WHERE n > 0),
        tpl AS (SELECT ['fact_check', 'false_claim', 'bot_comparison', 'follow_up', 'redirect'][item_id % 5 + 1] AS strategy,
          CASE WHEN item_id % 3 <> 0 THEN ['neutral', 'provocative', 'extreme'][item_id % 3 + 1] END AS host_mode,
          item_id::VARCHAR || ' on {category}: ''{statement}'', says ' ||
            ['fact_check', 'false_claim', 'bot_comparison', 'follow_up', 'redirect'][item_id % 5 + 1] || ', ' || text AS t FROM benchmark),
        o AS (SELECT strategy, host_mode, list(t ORDER BY t) AS l FROM tpl WHERE host_mode IS NOT NULL GROUP BY 1, 2),
        e AS (SELECT strategy, list(t ORDER BY t) AS l FROM tpl WHERE host_mode IS NULL GROUP BY 1)""",
    ),
    "kmeans_sentiment": q(f"SELECT id, true AS nearest FROM signed WHERE {COMPLETE}", SIGNED_BOTS),
    "kmeans_assign": q(
        f"SELECT id, true AS same FROM signed WHERE {COMPLETE} ORDER BY md5('42|' || id::VARCHAR), id LIMIT 1000", SIGNED_BOTS
    ),
    "feature_importance": f"SELECT unnest([{quoted(SIGNED)}]) AS feature, true AS in_range, 1e0 AS total",
    "pca_sentiment": q(
        f"""SELECT id, {", ".join(f"round(({' + '.join(f'({c} - m{i}) * p.x{i}' for i, c in enumerate(SIGNED))}) * p.s, 6) AS pc{k}"
            .replace("p.", f"p{k}.") for k in (1, 2))}
        FROM signed, cov, p1, p2 WHERE {COMPLETE}""",
        SIGNED_BOTS,
        f"""cov AS (SELECT {", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(SIGNED))},
          {", ".join(f"covar_samp({a}, {b}) AS c{i}{j}" for i, a in enumerate(SIGNED) for j, b in enumerate(SIGNED))}
          FROM signed WHERE {COMPLETE})""",
        *_component(1, "cov"),
        f"cov2 AS (SELECT {', '.join(f'c{i}{j} - l * x{i} * x{j} AS c{i}{j}' for i in range(4) for j in range(4))} FROM cov, p1)",
        *_component(2, "cov2"),
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "scored_rate1000": q(
        f"SELECT host_mode, category, {rounded(LEVELS)} FROM rates",
        *enriched("msgs"),
        "rescored AS (SELECT main_bots.* REPLACE (rich.escalation AS escalation) FROM main_bots JOIN rich USING (id))",
        rates("rescored", MODE_AXES | TOPIC_AXES),
    ),
}
