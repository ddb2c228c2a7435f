"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from debatelens.llm.common import own_names, stored

SEED = "mix-1"
#: Without given weights a source weighs its size to this power: 1 keeps shares, 0 levels them.
TEMPERATURE = 0.7
#: Bytes of the rate table that every task may hold; a larger one is joined.
MOST_BROADCAST = 16 << 20
#: A larger rate is drawn in equal parts of at most this: exp(-rate) ends near 708.
MOST_RATE = 700.0
#: Copies of a row are made in arrays of this many.
BLOCK = 10000


def source_rates(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    total: float = 1.0,
    temperature: float = TEMPERATURE,
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """(source, size, rate): one row per source, with the mean count of each of its documents.

    Sizes are UTF-8 bytes plus one per document. Rates are such that the sources'
    expected sizes have the proportions of the weights and add up to ``total`` times the
    size of ``docs``. Sources that given weights don't name get rate 0.
    """
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long") + 1
    sizes = docs.select(F.col(source_col).cast("string").alias("source"), size.alias("size"))
    sizes = sizes.groupBy("source").agg(F.sum("size").alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(float(temperature))))
    else:
        given = F.lit(0.0)
        for name, weight in weights.items():
            given = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(given)
        weighed = sizes.withColumn("weight", given)
    weighed = stored(weighed, "sizes")
    all_size, all_weight = weighed.agg(F.sum("size"), F.sum("weight")).first()
    rate = F.col("weight") / F.col("size") * (total * (all_size or 0) / all_weight if all_weight else 0.0)
    return weighed.select("source", "size", rate.alias("rate"))


def _steps(rate: Column) -> Column:
    """The values of the Poisson distribution function at 0, 1, 2, ... up to where it
    is 1 within the 52 bits of a draw."""
    most = F.ceil(rate + 10 * F.sqrt(rate) + 20).cast("int")
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("f"), F.array(first).alias("all"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        return F.struct(p.alias("p"), (a["f"] + p).alias("f"), F.concat(a["all"], F.array(a["f"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda a: a["all"])


def _draw(key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _with_source_rows(rows: DataFrame, table: DataFrame, name: str, of: str, key: str, salt: str, most: int) -> DataFrame:
    """Join the rows with the table of their sources (null is one), by its measured size."""
    steps = table.columns[-1]
    size = table.agg(F.sum(F.size(steps) * 8 + F.coalesce(F.octet_length(of), F.lit(0)) + 32)).first()[0] or 0
    same = F.col(name).eqNullSafe(F.col(of))
    if size <= most:
        return rows.join(F.broadcast(table), same)
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    other = f"{salt}_of"
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    rows = rows.withColumn(salt, F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    return rows.join(table.withColumn(other, copies), same & (F.col(salt) == F.col(other))).drop(other)


def poisson_mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    total: float = 1.0,
    temperature: float = TEMPERATURE,
    seed: str = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    numbered: bool = True,
    most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """``docs`` with each row as many times as its Poisson draw says, in a global shuffle.

    The draw inverts the Poisson distribution whose mean is the source's rate, at a point
    that depends on the seed and the id only (on the text where the id is null), so a
    task that runs again draws the same. The rates go to every task if they take at most
    ``most_broadcast`` bytes; of more sources each has its rate once per salt, and its rows
    meet them spread by their key, so no source is one task. A rate above ``MOST_RATE`` is the sum of draws
    for equal parts of it, each with its number in the key. Adds ``copy`` (from 1), ``n_copies`` and
    ``shuffle_key``, by which rows are dealt out and sorted; without ``numbered`` only
    the columns of ``docs``. A null source is a source of its own, a null text has size
    1, rows with one id and one source are drawn alike. Columns that clash with new names
    keep theirs, the new ones get an underscore. An empty table gives no rows.
    """
    rates = source_rates(docs, weights, total, temperature, source_col, text_col)
    parts = F.greatest(F.ceil(F.col("rate") / MOST_RATE), F.lit(1)).cast("long")
    rates = rates.withColumn("parts", parts)
    table = stored(rates.select("source", "parts", _steps(F.col("rate") / F.col("parts")).alias("steps")), "rates")
    copy, n_copies, order = own_names(docs, ["copy", "n_copies", "shuffle_key"])
    helpers = ["draw_key", "draw_source", "rate_source", "rate_steps", "rate_parts", "copy_block", "salt"]
    key, name, of, steps, parts, block, salt = own_names(docs, helpers)
    base = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col)), F.lit("")))
    rows = docs.withColumns({key: base, name: F.col(source_col).cast("string")})
    table = table.select(F.col("source").alias(of), F.col("parts").alias(parts), F.col("steps").alias(steps))
    rows = _with_source_rows(rows, table, name, of, key, salt, most_broadcast)

    def count(key: Column) -> Column:
        u = _draw(key)
        return F.size(F.filter(steps, lambda x: x <= u)).cast("long")

    def more(n: Column, part: Column) -> Column:
        return n + count(F.concat_ws(":", F.lit("part"), part.cast("string"), F.col(key)))

    first = count(F.col(key))
    rest = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col(parts) - 1), F.lit(0).cast("long"), more)
    rows = rows.withColumn(n_copies, F.when(F.col(parts) > 1, first + rest).otherwise(first))
    rows = rows.where(F.col(n_copies) > 0).drop(steps, parts, of, name, salt)
    # one array of all copies could be too large
    rows = rows.withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n_copies) - 1) / BLOCK))))
    start = F.col(block) * BLOCK
    rows = rows.withColumn(copy, F.explode(F.sequence(start + 1, F.least(start + BLOCK, F.col(n_copies))))).drop(block)
    rows = rows.withColumn(order, F.md5(F.concat_ws(":", F.col(key), F.col(copy).cast("string"))))
    mixed = rows.repartition(F.col(order)).sortWithinPartitions(order)
    return mixed.select(*docs.columns, *([copy, n_copies, order] if numbered else []))
