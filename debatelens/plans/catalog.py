"""The registered queries: every operator of the library on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from .. import values as V
from ..functions import escalation as E, normal as N
from ..functions.reasons import parse_reasons
from ..operators import cluster, distributions, enrich, lexicon, lookups, models, normalize, phrases
from ..operators import reasons, stats, terms, turns
from ..operators.crosstab import counts
from ..scale import scratch_path
from ..sources import fixtures, messages as M, store
from ..sources.fixtures import hash_predictor
from ..sources.transcripts import read_transcripts
from . import reports

Query = Callable[[SparkSession, str], DataFrame]

_loaded: dict[tuple[str, str], DataFrame] = {}


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message table of a data folder; the plan is built once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _loaded:
        _loaded[key] = read_transcripts(spark, sf_dir)
    return _loaded[key]


def six_places(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.round(f.name, 6).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema
        ]
    )


def on_messages(report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: six_places(report(load(spark, sf_dir)))


# --- sources and sinks ---


def scan_messages(msgs: DataFrame) -> DataFrame:
    return msgs.select([f.name for f in M.MESSAGE_SCHEMA])


def append_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "messages")
    rows = load(spark, sf_dir).select([f.name for f in M.MESSAGE_SCHEMA])
    host = F.col("speaker").eqNullSafe(F.lit(V.HOST))
    M.append_messages(rows.where(host), path)
    M.append_messages(rows.where(~host), path)
    return six_places(scan_messages(M.read_messages(spark, path)))


def append_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends, each numbered in the order of its messages."""
    path = scratch_path(spark, "numbered-messages")
    rows = load(spark, sf_dir).select([f.name for f in M.MESSAGE_SCHEMA])
    host = F.col("speaker").eqNullSafe(F.lit(V.HOST))
    by_time = rows.withColumnRenamed("id", "source_id")
    for part in (by_time.where(host), by_time.where(~host)):
        store.append_numbered(part, path, ["timestamp", "source_id"])
    return M.read_messages(spark, path).select("id", "source_id", "conversation_id", "speaker", "timestamp")


def ingest_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    msgs = load(spark, sf_dir)
    rows = enrich.ingest_conversations(
        msgs.select("id", "conversation_id", "speaker", "message", "timestamp", "category", "host_mode", "api"),
        fixtures.scorer(spark, sf_dir),
        N.title_name("category"),
        "host_mode",
        "api",
        enrich.conversation_uuid("conversation_id", "run-1"),
    )
    return six_places(rows.drop("message"))


def ensure_columns(msgs: DataFrame) -> DataFrame:
    old = msgs.select("id", "speaker", "timestamp")
    return M.ensure_columns(old).select("id", "speaker", "timestamp", "vader_compound", "api", "toxicity_is_toxic")


def backfill_unscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = scan_messages(load(spark, sf_dir))
    done = enrich.backfill_unscored(stored, fixtures.scorer(spark, sf_dir))
    return six_places(done.select("id", "sentiment_score", "distilbert_label", *enrich.BACKFILLED))


def backfill_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table, scored in place and read back."""
    path = scratch_path(spark, "backfilled")
    M.append_messages(scan_messages(load(spark, sf_dir)), path)
    store.backfill_table(spark, path, fixtures.scorer(spark, sf_dir))
    done = M.read_messages(spark, path)
    return six_places(done.select("id", "host_mode", "sentiment_score", "distilbert_label", *enrich.BACKFILLED))


def write_report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = reports.rate1000_by_mode_topic(load(spark, sf_dir))
    path = scratch_path(spark, "report")
    M.write_report_csv(report, path, one_file=True)
    return six_places(M.read_report_csv(spark, path, report.schema))


def rounded_mode_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = reports.rate1000_by_mode_topic(load(spark, sf_dir))
    path = scratch_path(spark, "mode-table")
    M.write_report_csv(report, path, one_file=True)
    return M.rounded(M.read_report_csv(spark, path, report.schema))


def latest_messages(msgs: DataFrame) -> DataFrame:
    return M.latest(msgs).select("id", "speaker", "timestamp", "escalation")


# --- projections and filters ---


def parse_timestamp(msgs: DataFrame) -> DataFrame:
    return msgs.select(
        "id",
        N.event_time().alias("event_time"),
        F.to_date(N.event_time()).alias("day"),
        F.to_date(N.event_time(strict=True)).alias("strict_day"),
    )


def topic_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = spark.createDataFrame([(t,) for t in V.TOPICS], "topic string")
    named = normalize.normalise_names(load(spark, sf_dir))
    return normalize.in_catalogue(named, topics).select("id", "category")


def coerce_turn(msgs: DataFrame) -> DataFrame:
    stored = F.when(F.col("id") % 7 == 3, "n/a").otherwise((F.col("id") % 1000).cast("string"))
    return normalize.coerce_turn(msgs.select("id", stored.alias("turn")))


def turn_from_id(msgs: DataFrame) -> DataFrame:
    numbered = msgs.select("id", "conversation_id", F.floor(F.col("id") / 2).alias("message_id"))
    return turns.turn_from_id(numbered).select("id", "turn")


def resolve_speaker(msgs: DataFrame) -> DataFrame:
    variant = msgs.select("id", F.col("speaker").alias("bot"))
    return normalize.only_speakers(normalize.resolve_speaker(variant), V.BOTS).select("id", "speaker")


def label_agreement(msgs: DataFrame) -> DataFrame:
    other_case = F.initcap("distilbert_label")
    return msgs.select("id", N.labels_agree("transformer_label", other_case).alias("agree"))


def signed_sentiment(msgs: DataFrame) -> DataFrame:
    return cluster.with_signed_scores(msgs).select("id", "transformer_sentiment", "distilbert_sentiment")


# --- scoring ---


def lexicon_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lexicon.with_valence(
        load(spark, sf_dir).select("id", "message"), fixtures.valence_lexicon(spark, sf_dir), rules=fixtures.RULES
    )
    return scored.drop("message")


def lexicon_default_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published rules with all their word lists, on texts into which idioms, boosters
    and negations were put at places that depend on the message."""
    msgs = load(spark, sf_dir)
    put = fixtures.with_phrases_put_in(msgs.select("id", "message"))
    return lexicon.with_valence(put, fixtures.valence_lexicon(spark, sf_dir)).drop("message")


def lexicon_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    msgs = load(spark, sf_dir).select("id", "message")
    return six_places(lexicon.with_polarity(msgs, fixtures.polarity_lexicon(spark, sf_dir)).drop("message"))


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = load(spark, sf_dir).select("id", "message")
    for kind in ["transformer", "distilbert"]:
        scored = models.score_with_model(scored, kind, lambda k=kind: hash_predictor(k))
    return scored.drop("message")


def model_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    def load_failing():
        return hash_predictor("transformer", fail_every=5)

    msgs = load(spark, sf_dir).select("id", "message")
    return models.score_with_model(msgs, "transformer", load_failing).drop("message")


def escalation_reasons(msgs: DataFrame) -> DataFrame:
    return msgs.select("id", F.array_join(E.escalation_reasons(), "|").alias("reasons"))


def escalation_keywords(msgs: DataFrame) -> DataFrame:
    """The fixed phrases, and phrases that do occur in the texts."""
    return msgs.select(
        "id", E.has_phrase().alias("flagged"), E.has_phrase(phrases=fixtures.PHRASES).alias("listed")
    )


def phrase_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of a table, found in every message."""
    msgs = load(spark, sf_dir).select("id", "message")
    found = phrases.with_phrases(msgs, fixtures.phrase_table(spark, sf_dir))
    return found.select(
        "id",
        (F.size("phrases") > 0).alias("flagged"),
        F.size("phrases").alias("n"),
        F.array_join("phrases", "|").alias("phrases"),
    )


def keyword_or_toxic(msgs: DataFrame) -> DataFrame:
    flag = E.phrase_or_toxic(phrases=[*V.ESCALATION_PHRASES, "thing"])
    return msgs.select("id", flag.alias("flagged"))


def enrich_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    msgs = load(spark, sf_dir).select("id", "message")
    rows = enrich.enrich(msgs, fixtures.scorer(spark, sf_dir))
    return six_places(
        rows.select(
            "id", "sentiment_score", "textblob_polarity", "textblob_subjectivity", "vader_compound",
            "vader_neg", "vader_neu", "vader_pos", "transformer_label", "transformer_score",
            "distilbert_label", "distilbert_score", "toxicity_is_toxic", "toxicity_score",
            F.col("escalation_score").cast("int").alias("escalation_score"), "escalation",
            F.array_join("escalation_reason", "|").alias("reasons"),
        )
    )


def analyze_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw web pages as typed texts."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        F.col("page_id").alias("id"), F.col("html").alias("message")
    )
    rows = enrich.analyze_texts(pages, fixtures.scorer(spark, sf_dir))
    return six_places(
        rows.select("id", "vader_compound", "textblob_polarity", "transformer_label", "distilbert_label",
                    "toxicity_is_toxic", "escalation", "escalation_reason")
    )


# --- turns ---


def modal_level(msgs: DataFrame) -> DataFrame:
    return turns.modal_level(paired_turns(msgs))


def level_series(msgs: DataFrame) -> DataFrame:
    return turns.level_series(paired_turns(msgs))


def paired_turns(msgs: DataFrame) -> DataFrame:
    """Turns of two bot messages each, so that a turn can hold several levels."""
    numbered = turns.turn_index(normalize.host_mode_bots(msgs))
    return numbered.withColumn("turn", F.floor(F.col("turn") / 2))


def reply_context(msgs: DataFrame) -> DataFrame:
    plain = turns.reply_context(msgs)
    return plain.select("id", F.md5("context").alias("context_md5"), F.length("context").alias("chars"))


def reply_prompt(msgs: DataFrame) -> DataFrame:
    asked = turns.reply_context(msgs, ask=True)
    return asked.select("id", F.md5("context").alias("prompt_md5"), F.length("context").alias("chars"))


def ordered_messages(msgs: DataFrame) -> DataFrame:
    ordered = msgs.orderBy("conversation_id", *turns.message_order())
    return ordered.select("conversation_id", "id", "timestamp", "speaker")


# --- lookups ---


def conversations(msgs: DataFrame) -> DataFrame:
    named = normalize.normalise_names(msgs)
    return named.select("conversation_id", "category", "host_mode").distinct()


def assign_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(load(spark, sf_dir))
    prompts, defaults = fixtures.prompts(spark, sf_dir), fixtures.default_prompts(spark, sf_dir)
    return lookups.assign_prompt(rows, prompts, defaults, "prompt").select("conversation_id", "prompt")


def assign_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(load(spark, sf_dir))
    drawn = lookups.assign_claim(rows, fixtures.claims(spark, sf_dir), "claim")
    return drawn.select("conversation_id", "claim")


def assign_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(load(spark, sf_dir))
    drawn = lookups.assign_topic(rows, fixtures.questions(spark, sf_dir), "topic")
    return drawn.select("conversation_id", "question")


def render_host_reaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    msgs = load(spark, sf_dir)
    host = turns.host_strategy(turns.last_statement(msgs)).where(F.col("strategy").isNotNull())
    drawn = lookups.render_host_reaction(host, fixtures.templates(spark, sf_dir), "reaction")
    return drawn.select("id", "strategy", F.md5("reaction").alias("reaction_md5"))


# --- statistics ---

SIGNED = cluster.SCORES


def signed_bots(msgs: DataFrame) -> DataFrame:
    return cluster.with_signed_scores(normalize.main_bots(msgs)).select("id", "escalation", *SIGNED)


def seeded_sample(msgs: DataFrame) -> DataFrame:
    whole = signed_bots(msgs).na.drop(subset=SIGNED)
    return cluster.seeded_sample(whole, 100).select("id", *SIGNED)


def kmeans_assign(msgs: DataFrame) -> DataFrame:
    bots = signed_bots(msgs)
    sample = cluster.seeded_sample(bots.na.drop(subset=SIGNED))
    assigned = cluster.assign_clusters(bots, sample).select("id", "cluster")
    whole = cluster.cluster_scores(bots).select("id", F.col("cluster").alias("whole"))
    return assigned.join(whole, "id").select("id", (F.col("cluster") == F.col("whole")).alias("same"))


def feature_importance(msgs: DataFrame) -> DataFrame:
    """Whether each importance is a share, and their total."""
    rows = cluster.feature_importance(signed_bots(msgs))
    total = F.sum("importance").over(W.partitionBy())
    return rows.select("feature", F.col("importance").between(0, 1).alias("in_range"), total.alias("total"))


def scored_rate1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by mode and topic over levels that the library scored itself."""
    msgs = load(spark, sf_dir)
    scored = enrich.enrich(msgs, fixtures.scorer(spark, sf_dir))
    return six_places(reports.rate1000_by_mode_topic(scored))


def mann_whitney_small(msgs: DataFrame) -> DataFrame:
    """The rank test inside each conversation, which has few messages of a level."""
    bots = cluster.with_signed_scores(normalize.main_bots(msgs))
    tested = stats.mann_whitney(bots, SIGNED, by=["conversation_id"])
    return tested.select("conversation_id", "metric", "n1", "n2", "u", "p")


def collocations_by_bot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word cloud terms with collocations, stop words from a table."""
    stop = spark.createDataFrame([(w,) for w in fixtures.STOP_WORDS], "word string")
    return terms.collocations(bots_text(load(spark, sf_dir)), ["speaker"], stop)


def bots_text(msgs: DataFrame) -> DataFrame:
    return normalize.procon_bots(msgs).select("speaker", "message")


QUERIES: dict[str, Query] = {
    # sources and sinks
    "scan_messages": lambda s, d: scan_messages(load(s, d)),
    "scan_scored_text": on_messages(M.scan_scored_text),
    "append_messages": append_messages,
    "append_numbered": append_numbered,
    "ingest_conversations": ingest_conversations,
    "ensure_columns": on_messages(ensure_columns),
    "backfill_unscored": backfill_unscored,
    "backfill_table": backfill_table,
    "write_report_csv": write_report_csv,
    "rounded_mode_table": rounded_mode_table,
    "latest_messages": on_messages(latest_messages),
    # projections and filters
    "norm_category": on_messages(lambda m: m.select("id", N.title_name("category").alias("category"))),
    "norm_mode_level": on_messages(
        lambda m: normalize.normalise_names(m).select("id", "host_mode", "escalation_level")
    ),
    "drop_null_keys": on_messages(
        lambda m: normalize.normalise_names(normalize.drop_null_keys(m)).select("id", "host_mode", "escalation_level")
    ),
    "filter_api": on_messages(lambda m: normalize.only_api(m).select("id", "api")),
    "topic_semi_join": topic_semi_join,
    "filter_procon": on_messages(lambda m: normalize.only_procon(m).select("id", "host_mode")),
    "filter_normal": on_messages(lambda m: normalize.without_procon(m).select("id", "host_mode")),
    "exclude_host": on_messages(lambda m: normalize.without_host(m, anywhere=True).select("id", "speaker")),
    "filter_speakers": on_messages(lambda m: normalize.only_speakers(m, V.BOTS).select("id", "speaker")),
    "speaker_regex": on_messages(lambda m: m.where(normalize.speaker_matches()).select("id", "speaker")),
    "filter_modes": on_messages(lambda m: normalize.only_modes(m).select("id", "host_mode")),
    "parse_timestamp": on_messages(parse_timestamp),
    "message_length": on_messages(lambda m: m.select("id", N.message_length().alias("length"))),
    "signed_sentiment": on_messages(signed_sentiment),
    "escalation_ordinal": on_messages(lambda m: m.select("id", N.level_ordinal().alias("ordinal"))),
    "label_agreement": on_messages(label_agreement),
    "coerce_turn": on_messages(coerce_turn),
    "turn_from_id": on_messages(turn_from_id),
    "resolve_speaker": on_messages(resolve_speaker),
    "model_input_text": on_messages(lambda m: m.select("id", N.model_input().alias("text"))),
    "message_preview": on_messages(lambda m: m.select("id", N.preview().alias("preview"))),
    "nonblank_messages": on_messages(
        lambda m: m.select("id", "message").where(~N.is_blank()).select("id")
    ),
    # scoring
    "lexicon_compound": lexicon_compound,
    "lexicon_default_rules": lexicon_default_rules,
    "lexicon_polarity": lexicon_polarity,
    "model_scores": model_scores,
    "model_fallback": model_fallback,
    "toxicity_flag": on_messages(lambda m: m.select("id", E.is_toxic().alias("toxic"))),
    "escalation_score": on_messages(lambda m: m.select("id", E.escalation_score().alias("score"))),
    "escalation_level": on_messages(
        lambda m: m.select("id", E.escalation_level(E.escalation_score()).alias("level"))
    ),
    "escalation_reasons": on_messages(escalation_reasons),
    "escalation_keywords": on_messages(escalation_keywords),
    "phrase_table": phrase_table,
    "keyword_or_toxic": on_messages(keyword_or_toxic),
    "enrich_messages": enrich_messages,
    "analyze_texts": analyze_texts,
    # dashboard
    "conversation_summary": on_messages(reports.conversation_summary),
    "escalation_counts": on_messages(reports.escalation_counts),
    "escalation_by_day": on_messages(reports.escalation_by_day),
    "box_scores": on_messages(reports.box_scores),
    # host-mode reports
    "count_by_mode_level": on_messages(reports.count_by_mode_level),
    "modal_level": on_messages(modal_level),
    "level_series": on_messages(level_series),
    "avg_length_by_level": on_messages(reports.avg_length_by_level),
    "box_length_by_level": on_messages(reports.box_length_by_level),
    "pct_by_mode": on_messages(reports.pct_by_mode),
    "pct_by_mode_long": on_messages(reports.pct_by_mode_long),
    "pct_by_mode_table": on_messages(reports.pct_by_mode_table),
    # main reports
    "messages_per_topic": on_messages(reports.messages_per_topic),
    "rate1000_by_topic": on_messages(reports.rate1000_by_topic),
    "rate1000_by_mode": on_messages(reports.rate1000_by_mode),
    "rate1000_by_mode_topic": on_messages(reports.rate1000_by_mode_topic),
    "strong_heatmap": on_messages(reports.strong_heatmap),
    "rate1000_topic_mode_level": on_messages(reports.rate1000_topic_mode_level),
    "dense_grid": on_messages(
        lambda m: counts(
            normalize.main_bots(m), ["category", "host_mode"], axes=reports.TOPIC_AXIS | reports.MODE_AXIS
        )
    ),
    "transformer_label_by_level": on_messages(lambda m: reports.label_by_level(m, "transformer_label")),
    "distilbert_label_by_level": on_messages(lambda m: reports.label_by_level(m, "distilbert_label")),
    "agreement_by_level": on_messages(reports.agreement_by_level),
    "level_by_bot": on_messages(reports.level_by_bot),
    "box_sentiment_by_level": on_messages(reports.box_sentiment_by_level),
    "sentiment_trend": on_messages(reports.main_sentiment_trend),
    "label_share_transformer": on_messages(lambda m: reports.label_share(m, "transformer_label")),
    "label_share_distilbert": on_messages(lambda m: reports.label_share(m, "distilbert_label")),
    "level_share_by_turn": on_messages(reports.level_share_by_turn),
    "level_trend_ci": on_messages(reports.level_trend_ci),
    "level_trend_bootstrap": on_messages(reports.level_trend_bootstrap),
    "sentiment_histogram": on_messages(lambda m: distributions.histogram(signed_bots(m), SIGNED)),
    "sentiment_density": on_messages(lambda m: distributions.density(signed_bots(m), SIGNED)),
    # reasons
    "parse_reasons": on_messages(
        lambda m: m.select("id", F.array_join(parse_reasons(), "|").alias("reasons"), F.size(parse_reasons()).alias("n"))
    ),
    "reason_rows": on_messages(lambda m: reasons.reason_rows(m).select("id", "escalation", "reason")),
    "reason_frequency": on_messages(lambda m: reasons.reason_frequency(normalize.main_bots(m))),
    "reason_family_frequency": on_messages(lambda m: reasons.reason_family_frequency(normalize.main_bots(m))),
    "reason_by_level": on_messages(lambda m: reasons.reason_by_level(normalize.main_bots(m))),
    "reason_share_by_level": on_messages(lambda m: reasons.reason_share_by_level(normalize.main_bots(m))),
    # pro/con reports
    "procon_level_by_bot": on_messages(reports.procon_level_by_bot),
    "procon_rate1000": on_messages(reports.procon_rate1000),
    "procon_strong_heatmap": on_messages(reports.procon_strong_heatmap),
    "procon_sentiment_trend": on_messages(reports.procon_sentiment_trend),
    "procon_label_share": on_messages(reports.procon_label_share),
    "procon_level_share": on_messages(reports.procon_level_share),
    "procon_level_band": on_messages(reports.procon_level_band),
    "role_level_pct": on_messages(reports.role_level_pct),
    "box_procon": on_messages(reports.box_procon),
    # words
    "tokens": on_messages(
        lambda m: m.select("id", F.size(terms.words()).alias("n"), F.md5(F.array_join(terms.words(), " ")).alias("words_md5"))
    ),
    "top_words_by_level": on_messages(lambda m: terms.top_words(m, ["escalation"], fixtures.STOP_WORDS)),
    "negative_words": lambda s, d: terms.negative_words(load(s, d), fixtures.valence_lexicon(s, d)),
    "negative_words_by_level": lambda s, d: terms.negative_words(
        load(s, d), fixtures.valence_lexicon(s, d), ["escalation"]
    ),
    "term_freq_by_bot": on_messages(lambda m: terms.term_frequencies(bots_text(m), ["speaker"], fixtures.STOP_WORDS)),
    "bigram_freq_by_bot": on_messages(
        lambda m: terms.bigram_frequencies(bots_text(m), ["speaker"], fixtures.STOP_WORDS)
    ),
    "collocations_by_bot": collocations_by_bot,
    # statistics
    "mann_whitney": on_messages(lambda m: stats.mann_whitney(signed_bots(m), SIGNED).drop("p")),
    "mann_whitney_p": on_messages(lambda m: stats.mann_whitney(signed_bots(m), SIGNED).select("metric", "p")),
    "mann_whitney_small": on_messages(mann_whitney_small),
    "kmeans_sentiment": on_messages(
        lambda m: cluster.in_nearest_cluster(signed_bots(m)).select("id", "nearest")
    ),
    "pca_sentiment": on_messages(lambda m: cluster.project_scores(signed_bots(m)).select("id", "pc1", "pc2")),
    "seeded_sample": on_messages(seeded_sample),
    "kmeans_assign": on_messages(kmeans_assign),
    "feature_importance": on_messages(feature_importance),
    "scored_rate1000": scored_rate1000,
    # turns
    "turn_index": on_messages(lambda m: turns.turn_index(normalize.main_bots(m)).select("id", "conversation_id", "turn")),
    "reply_context": on_messages(reply_context),
    "reply_prompt": on_messages(reply_prompt),
    "host_strategy": on_messages(lambda m: turns.host_strategy(m).select("id", "host_turns", "strategy")),
    "ordered_messages": on_messages(ordered_messages),
    # lookups
    "assign_prompt": assign_prompt,
    "assign_claim": assign_claim,
    "assign_topic": assign_topic,
    "render_host_reaction": render_host_reaction,
}
