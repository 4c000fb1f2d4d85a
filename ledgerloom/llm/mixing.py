"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.storage import columns, free, written

#: Sources up to which their rates are broadcast; more are joined with salt.
MOST_SOURCES, SALT = 100_000, 32


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 of seed and parts."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_draw(rate: Column, u: Column) -> Column:
    """How many values of the distribution function, at 0, 1, ..., are u at most: as many as leave less than 1e-15 of
    the mass are looked at, one after the other, so that nothing is held for large rates."""
    last = F.ceil(rate + 10 * F.sqrt(rate) + 30).cast("int")
    zero = F.struct((-rate).alias("log"), F.exp(-rate).alias("cdf"), F.lit(0).alias("n"))

    def step(s: Column, k: Column) -> Column:
        log = s["log"] + F.log(rate) - F.log(k.cast("double"))
        return F.struct(log.alias("log"), (s["cdf"] + F.exp(log)).alias("cdf"), (s["n"] + (s["cdf"] <= u).cast("int")).alias("n"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), zero, step, lambda s: s["n"] + (s["cdf"] <= u).cast("int"))).otherwise(0)


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | DataFrame, default: float = 0.0, total: float | None = None, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"
) -> DataFrame:
    """docs with copy, copies and shuffle_key: each row as often as a Poisson draw says, in an order shuffled globally.

    A source's rate is its share of the weights times total over its own size, in UTF-8 bytes of text; total is the
    size of all by default. weights: by source, or a table (source, weight); others have default. The draw inverts the
    distribution at a number from the MD5 of seed and id, so that it is the same in every run and for rows that repeat
    an id. copy counts from 1 to copies; rows with 0 copies go. shuffle_key orders the result within partitions, and
    decides the partition: all copies are spread alike, however large a source is.

    A null source is a source, with weight default. Null or empty texts have no size but are drawn like others; a
    source without any bytes has rate 0. Null ids are drawn like the empty text. Weights under 0 are 0. An empty table
    gives no rows. Columns copy, copies and shuffle_key are replaced; all others stay as they are.
    """
    spark = docs.sparkSession
    given = weights if isinstance(weights, DataFrame) else spark.createDataFrame([(str(k), float(v)) for k, v in weights.items()], "source string, weight double")
    docs = docs.select(*columns(docs, "copy", "copies", "shuffle_key"))
    of, rate_of, salt_of, u_of = free(docs.columns, "source_of_rate", "rate_of_source", "salt_of_rate", "u_of_row")
    source, absent = F.col(source_col).cast("string"), F.lit(default).cast("double")
    sizes = docs.groupBy(source.alias("s_source")).agg(F.sum(F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")).alias("s_bytes"))
    sizes = sizes.join(given.select(F.col("source").alias("g_source"), F.col("weight").cast("double").alias("g_weight")), F.col("s_source") == F.col("g_source"), "left")
    sizes = written(sizes.select("s_source", "s_bytes", F.greatest(F.coalesce("g_weight", absent), F.lit(0.0)).alias("s_weight")), "sizes")
    all_ = sizes.agg(F.sum("s_bytes").alias("bytes"), F.sum("s_weight").alias("weight"), F.count("*").alias("n")).first()  # three numbers
    bytes_, weight = float(total if total is not None else all_.bytes or 0), float(all_.weight or 0)
    rate = F.when((F.col("s_bytes") > 0) & F.lit(weight > 0), F.col("s_weight") / F.lit(weight or 1.0) * F.lit(bytes_) / F.col("s_bytes")).otherwise(F.lit(0.0))
    rates = sizes.select(F.col("s_source").alias(of), rate.alias(rate_of))
    if all_.n <= MOST_SOURCES:
        drawn = docs.join(F.broadcast(rates), source.eqNullSafe(F.col(of)))
    else:
        salted = rates.withColumn(salt_of, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        drawn = docs.join(salted, source.eqNullSafe(F.col(of)) & (F.pmod(F.xxhash64(id_col), F.lit(SALT)) == F.col(salt_of)))
    drawn = drawn.withColumn(u_of, uniform(seed, F.col(id_col))).withColumn("copies", poisson_draw(F.col(rate_of), F.col(u_of))).where("copies > 0")
    drawn = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("copy")))
    out = drawn.select(*columns(docs), "copies", "copy", key.alias("shuffle_key"))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
