"""The thin queries opN_<name>: each applies its operator to its whole table and gives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.ann import nearest
from ledgerloom.llm.decontaminate import contaminations
from ledgerloom.llm.language import identify_language, language_prototypes
from ledgerloom.llm.lm import score_documents
from ledgerloom.llm.mixing import mix_sources
from ledgerloom.llm.near_dups import near_duplicates
from ledgerloom.llm.sharding import balanced_shards
from ledgerloom.llm.token_files import read_token_files, write_token_files
from ledgerloom.llm.urls import filter_urls, host_of
from ledgerloom.llm.warc import read_bundles, write_bundles

#: The public vocabulary's file.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items of which they hold a passage, a fifth of its words edited at most."""
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def days(*parts: Column) -> Column:
    """0 to 365 from the MD5 of the parts."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long") % 366).cast("int")


def dated_list(pages: DataFrame) -> DataFrame:
    """A list of dated entries for the hosts of the pages and the domains above them, as the tables have none: for each
    pattern five entries on days of 2024 and with actions that an MD5 gives."""
    host = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    patterns = host.select("host").union(host.select(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))).union(host.select(F.concat("host", F.lit("/en")))).where("host <> ''").distinct()
    number = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")
    act = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("act"), "pattern", "k")), 1, 8), 16, 10).cast("long") % 4
    return patterns.select(F.col("host").alias("pattern"), number).select(
        "pattern",
        F.to_timestamp(F.date_add(F.lit("2024-01-01").cast("date"), days(F.lit("day"), F.col("pattern"), F.col("k")))).alias("listed_at"),
        F.when(act <= 1, "block").when(act == 2, "allow").otherwise("remove").alias("action"),
    )


def op2_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the list entries active when it was fetched; a fetch day comes from the id's MD5."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.to_timestamp(F.date_add(F.lit("2024-01-01").cast("date"), days(F.lit("fetch"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    out = filter_urls(pages.withColumn("fetched_at", fetched), dated_list(pages))
    return out.select("page_id", host_of(F.col("url")).alias("host"), "fetched_at", "verdict", "pattern", "valid_from", "valid_to")


OP2 = r"""
with c as (
  select page_id, url, timestamp '2024-01-01' + to_days(cast(('0x' || substr(md5('fetch:' || coalesce(cast(page_id as varchar), '')), 1, 8))::bigint % 366 as integer)) as fetched_at,
    regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '\.$', '') as host,
    list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '') as segs
  from pages),
h as (select distinct host from c where host <> ''),
p as (select host as pattern from h union select regexp_extract(host, '([^.]+\.[^.]+)$', 1) from h union select host || '/en' from h),
e as (
  select pattern, timestamp '2024-01-01' + to_days(cast(('0x' || substr(md5('day:' || pattern || ':' || k), 1, 8))::bigint % 366 as integer)) as listed_at,
    ('0x' || substr(md5('act:' || pattern || ':' || k), 1, 8))::bigint % 4 as act
  from p, range(5) t(k) where pattern <> ''),
d as (select pattern, listed_at, min(case when act <= 1 then 'block' when act = 2 then 'allow' else 'remove' end) as action from e group by all),
v as (select pattern, action, listed_at as valid_from, lead(listed_at) over (partition by pattern order by listed_at) as valid_to from d),
k as (
  select distinct page_id, url, fetched_at, array_to_string(list_slice(labels, i, len(labels)), '.') || case when j > 0 then '/' || array_to_string(list_slice(segs, 1, j), '/') else '' end as pattern
  from (select *, string_split(host, '.') as labels, unnest(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)) as i from c where host <> ''), (select unnest(range(0, (select max(len(segs)) + 1 from c))) as j) where j <= len(segs)),
m as (
  select k.page_id, k.url, k.fetched_at, v.pattern, v.action, v.valid_from, v.valid_to,
    row_number() over (partition by k.page_id, k.url, k.fetched_at order by length(v.pattern) desc, v.pattern desc) as r
  from k join v on k.pattern = v.pattern and v.action in ('block', 'allow') and k.fetched_at >= v.valid_from and (v.valid_to is null or k.fetched_at < v.valid_to))
select c.page_id, c.host, c.fetched_at, coalesce(m.action, 'pass') as verdict, m.pattern, m.valid_from, m.valid_to
from c left join m on m.r = 1 and m.page_id = c.page_id and m.url = c.url and m.fetched_at = c.fetched_at
"""

#: Target weights of the mixture: one source counts twice, all others once.
WEIGHTS = {"src0": 2.0}


def op3_poisson_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, replicated so that sources have their target weights, in shuffled order."""
    mixed = mix_sources(table(spark, sf_dir, "documents"), WEIGHTS, default=1.0, seed="mix")
    return mixed.select("doc_id", "source", "copy", "copies", "shuffle_key", F.md5("text").alias("text_md5"))


OP3 = """
with d as (select doc_id, source, text, coalesce(octet_length(encode(text)), 0) as b from documents),
s as (select source, sum(b) as bytes, case source when 'src0' then 2.0 else 1.0 end as w from d group by source),
r as (select source, cast(w as double) / (select sum(cast(w as double)) from s) * (select cast(sum(bytes) as double) from s) / cast(bytes as double) as rate from s where bytes > 0),
c as (
  select source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) over (partition by source order by k) as cdf
  from r, range(2000) t(k) where k <= ceil(rate + 10 * sqrt(rate) + 30)),
u as (select *, cast(('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), '')), 1, 13))::bigint as double) / 4503599627370496.0 as u from d),
n as (select u.doc_id, u.source, u.text, (select count(*) from c where c.source is not distinct from u.source and c.cdf <= u.u) as copies from u)
select doc_id, source, cast(copy as integer) as copy, cast(copies as integer) as copies,
  md5('mix:order:' || coalesce(cast(doc_id as varchar), '') || ':' || copy) as shuffle_key, md5(text) as text_md5
from n, range(1, 200) t(copy) where copy <= copies
"""


def op4_balanced_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards, equal texts together as far as equal counts of rows allow."""
    return balanced_shards(table(spark, sf_dir, "documents"), shards=24)


def op5_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles are similar by 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, similarity=(80, 100))


def op6_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, written to seekable bundles and read back by their index."""
    back = read_bundles(write_bundles(table(spark, sf_dir, "pages")), payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6 = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes < 100 or first_id is null or page_id is not distinct from first_id then 'response' else 'revisit' end as record_type,
  case when payload_bytes < 100 or first_id is null or page_id is not distinct from first_id then null else first_id end as refers_to
from f
"""


def op7_gated_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents by a gated recurrent model; a seventh of the documents is held out."""
    return score_documents(table(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2)


def op8_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo by; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % by


def op9_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a third of the documents is held out of learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (remainder("doc_id", 3) == 1).alias("held_out"))
    learned = language_prototypes(docs.where("not held_out"))
    return identify_language(docs.select("doc_id", "text", "held_out"), learned).select("doc_id", "held_out", "lang_pred", "score")


def op10_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to files of directly addressable codes and read from them."""
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), TOKENIZER, end_id=0))


QUERIES = {f.__name__: f for f in (op1_pigeonhole_decontamination, op2_temporal_url_filter, op3_poisson_mixture, op4_balanced_propagation, op5_minhash_near_dups, op6_seekable_warc, op7_gated_recurrent_lm, op8_additive_quantisation, op9_hyperdimensional_language, op10_addressable_codes)}
ORACLE: dict[str, str] = {"op2_temporal_url_filter": OP2, "op3_poisson_mixture": OP3, "op6_seekable_warc": OP6}
