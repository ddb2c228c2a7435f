"""The message table: schema, readers, writers and additive schema evolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("conversation_id", T.StringType()),
        T.StructField("speaker", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("sentiment_score", T.DoubleType()),
        T.StructField("escalation", T.StringType()),
        T.StructField("textblob_polarity", T.DoubleType()),
        T.StructField("textblob_subjectivity", T.DoubleType()),
        T.StructField("vader_compound", T.DoubleType()),
        T.StructField("vader_neg", T.DoubleType()),
        T.StructField("vader_neu", T.DoubleType()),
        T.StructField("vader_pos", T.DoubleType()),
        T.StructField("transformer_label", T.StringType()),
        T.StructField("transformer_score", T.DoubleType()),
        T.StructField("toxicity_is_toxic", T.BooleanType()),
        T.StructField("toxicity_score", T.DoubleType()),
        T.StructField("category", T.StringType()),
        T.StructField("host_mode", T.StringType()),
        T.StructField("escalation_reason", T.StringType()),
        T.StructField("distilbert_label", T.StringType()),
        T.StructField("distilbert_score", T.DoubleType()),
        T.StructField("api", T.StringType()),
    ]
)

#: Signal columns in the order the data model lists them.
SIGNALS = [
    "sentiment_score",
    "escalation",
    "textblob_polarity",
    "textblob_subjectivity",
    "vader_compound",
    "vader_neg",
    "vader_neu",
    "vader_pos",
    "transformer_label",
    "transformer_score",
    "toxicity_is_toxic",
    "toxicity_score",
    "escalation_reason",
    "distilbert_label",
    "distilbert_score",
]


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Read a stored message table; missing columns come back as nulls."""
    reader = spark.read.format(fmt).options(**options)
    if fmt in ("csv", "json"):
        reader = reader.schema(MESSAGE_SCHEMA)
    return ensure_columns(reader.load(path), MESSAGE_SCHEMA)


def read_messages_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """Read the table from a database; pass ``partitionColumn``/``lowerBound``/
    ``upperBound``/``numPartitions`` so that the scan is split over executors."""
    loaded = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return ensure_columns(loaded, MESSAGE_SCHEMA)


def scan_scored_text(msgs: DataFrame) -> DataFrame:
    """Level and text of the messages that have a text (two columns reach the scan)."""
    return msgs.select("escalation", "message").where(F.col("message").isNotNull())


def ensure_columns(df: DataFrame, schema: T.StructType = MESSAGE_SCHEMA) -> DataFrame:
    """Add each missing column with its type as nulls; columns present stay untouched.

    Names are compared as the session compares them, by default without case.
    """
    sensitive = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    known = str if sensitive else str.lower
    present = {known(c) for c in df.columns}
    missing = [
        F.lit(None).cast(f.dataType).alias(f.name) for f in schema if known(f.name) not in present
    ]
    return df.select("*", *missing)


def append_messages(msgs: DataFrame, path: str) -> None:
    """Append messages; the table is laid out by host mode, which most reports filter on."""
    msgs.write.mode("append").partitionBy("host_mode").parquet(path)


def latest(msgs: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` latest rows by timestamp text, newest id first on ties."""
    return msgs.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def write_report_csv(report: DataFrame, path: str, one_file: bool = False) -> None:
    """Write a report table as CSV with a header; the caller says whether as one file.

    Arrays become JSON text because CSV has no nested values.
    """
    flat = [
        F.to_json(f.name).alias(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        else F.col(f.name)
        for f in report.schema
    ]
    rows = report.select(*flat)
    if one_file:
        rows = rows.repartition(1)
    rows.write.mode("overwrite").option("header", True).csv(path)


def read_report_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def rounded(report: DataFrame) -> DataFrame:
    """Round every fractional column to an integer, halves to even."""

    def as_int(field: T.StructField) -> Column:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.bround(field.name, 0).cast("int").alias(field.name)
        return F.col(field.name)

    return report.select(*[as_int(f) for f in report.schema])
