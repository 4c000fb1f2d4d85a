"""URL filters by a temporal list join: entries become validity intervals, captures see what was listed at fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.storage import columns, free

#: Path segments of patterns_of() by default, and salts over which the captures of one key are spread.
DEPTH, SALT = 3, 16

RESULT = ("verdict", "pattern", "valid_from", "valid_to")
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and a final dot; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), HOST, 1), r"\.$", "")


def patterns_of(url: Column, depth: Column | int = DEPTH) -> Column:
    """What could be listed for a URL: its host and the domains above it down to two labels, each alone and with up to
    depth path segments."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segments = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")
    deepest = F.least(F.size(segments), F.lit(depth))
    paths = F.transform(F.sequence(F.lit(0), deepest), lambda i: F.when(i > 0, F.concat(F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/"))).otherwise(F.lit("")))
    each = F.flatten(F.transform(domains, lambda d: F.transform(paths, lambda p: F.concat(d, p))))
    return F.when(host != "", F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, valid_from, valid_to) of dated entries (pattern, listed_at, action): an entry holds until the
    pattern's next one, the last without end (null). `remove` only ends. Of entries of one pattern and time the
    action first in order of names holds; entries with a null in pattern or time are left out."""
    dated = entries.where("pattern is not null and listed_at is not null").groupBy("pattern", "listed_at").agg(F.min("action").alias("action"))
    until = F.lead("listed_at").over(Window.partitionBy("pattern").orderBy("listed_at"))
    return dated.select("pattern", "action", F.col("listed_at").alias("valid_from"), until.alias("valid_to")).where("action in ('block', 'allow')")


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """captures with verdict, pattern, valid_from, valid_to: of the entries active at fetch time the one with the longest
    pattern decides, `block` or `allow`; without one the verdict is `pass` and the rest is null.

    Each (url, time) is looked up once, with its few possible patterns as keys; the keys of one host, however many, are
    spread over salts, for each of which the list has a copy. Only urls and times are shuffled for that.

    Paths are matched at any depth, up to that of the deepest pattern of the list, which an aggregate over it gives; a
    pattern, with a path or not, is of its own host and of the hosts below it.

    A null or malformed url, or a null time, passes. Rows that repeat are all kept. Patterns are lower-case hosts with
    an optional path. Without captures there are no rows, without entries all pass. Columns of the same names are replaced;
    all others, whatever their names, stay as they are.
    """
    captures = captures.select(*columns(captures, *RESULT))
    # no pattern is asked for that has more segments than the deepest of the list
    slashes = F.length("pattern") - F.length(F.replace(F.col("pattern"), F.lit("/"), F.lit("")))
    depth = entries.agg(F.coalesce(F.max(slashes), F.lit(0)).alias("depth")).first().depth
    asked = captures.select(F.col(url_col).alias("u"), F.col(time_col).alias("t")).where("u is not null and t is not null").distinct()
    keys = asked.select("u", "t", F.explode(patterns_of(F.col("u"), depth)).alias("pattern"), F.pmod(F.xxhash64("u", "t"), F.lit(SALT)).alias("salt"))
    listed = intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    hit = keys.join(listed, ["pattern", "salt"]).where((F.col("t") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("t") < F.col("valid_to"))))
    u, t, b = free(captures.columns, "url_asked", "time_asked", "best_entry")
    best = hit.groupBy(F.col("u").alias(u), F.col("t").alias(t)).agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "action", "valid_from", "valid_to")).alias(b))
    out = captures.join(best, (F.col(url_col) == F.col(u)) & (F.col(time_col) == F.col(t)), "left")
    return out.select(*columns(captures), F.coalesce(F.col(f"{b}.action"), F.lit("pass")).alias("verdict"), *[F.col(f"{b}.{c}").alias(c) for c in RESULT[1:]])
