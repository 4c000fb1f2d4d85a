"""From raw documents to token files, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.decontaminate import decontaminated
from ledgerloom.llm.language import UNKNOWN, exact_cosines, gram_profiles, identify_language, prototypes_of
from ledgerloom.llm.mixing import mix_sources
from ledgerloom.llm.near_dups import near_duplicates
from ledgerloom.llm.queries import TOKENIZER, WEIGHTS
from ledgerloom.llm.storage import columns, free, small_batches, written
from ledgerloom.llm.token_files import read_token_files, write_token_files

#: Bundles of texts that share no n-gram have a cosine with a deviation of 1 / sqrt(512) = 0.044. From SURE on, seven
#: deviations, that noise is no matter; texts below it are looked at again by exact counts of n-grams, where such texts
#: have 0. At sf0.1 the least exact cosine of a labelled document is 0.031 ("Avec."), and LEAST_COSINE is a third of that.
SURE, LEAST_COSINE, SALT = 0.31, 0.01, 16


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents without a letter, and those that are like no language learned from the labelled ones.

    Null and empty texts have no letter and go. Rows that repeat, null ids and texts of any length are judged each by its
    whole text; a null lang teaches nothing. Columns of any names stay as they are. An empty table gives no rows."""
    pred, score, key, salt = free(docs.columns, "lang_pred", "lang_score", "text_key", "text_salt")
    with small_batches(spark):
        profiles = written(gram_profiles(docs), "profiles")
        known = identify_language(docs, prototypes_of(profiles), pred_col=pred, score_col=score)
        known = written(known.where(F.col(pred) != UNKNOWN), "known")
        # equal texts, however many, are looked at once, and looked up under salts
        doubtful = known.where(F.col(score) < SURE).withColumns({key: F.sha2("text", 256), salt: F.pmod(F.xxhash64("doc_id"), F.lit(SALT))})
        texts = doubtful.select(F.col(key).alias("key"), "text").dropDuplicates(["key"])
        like = written(exact_cosines(texts, profiles).where(F.col("cosine") >= LEAST_COSINE).select("key"), "like")
    like = like.select(F.col("key").alias(key), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias(salt))
    sure = known.where(F.col(score) >= SURE).select(*columns(docs))
    return sure.union(doubtful.join(like, [key, salt], "left_semi").select(*columns(docs)))


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, by 5-word shingles, stays: that with the smallest id.

    Of rows that repeat an id and a text one stays; rows with a null id all stay, and so do null and empty texts. Texts
    are compared whole; other columns, whatever their names, stay as they are. An empty table gives no rows."""
    kept = near_duplicates(docs, words=5, similarity=(80, 100)).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(*columns(docs)).union(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that hold a passage of a benchmark item.

    Null and empty texts hold none and stay, as do null ids; rows that repeat are judged each, on their whole texts, and
    columns of any names stay as they are. Without documents, or without items, nothing goes."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicates documents so that sources have their target weights, in shuffled order.

    A null source is a source with weight 1; null and empty texts are drawn like others unless their source has no byte;
    rows that repeat an id are drawn alike, null ids like an empty one. Columns of any names stay as they are, also
    those named copy, copies and shuffle_key. An empty table gives no rows."""
    drawn = ("copy", "copies", "shuffle_key")
    own = [c for c in docs.columns if c.lower() in drawn]
    aside = dict(zip(own, free([*docs.columns, *drawn], *[f"own_{c}" for c in own]), strict=True))
    mixed = mix_sources(docs.withColumnsRenamed(aside), WEIGHTS, default=1.0, seed="mix")
    return mixed.drop(*drawn).withColumnsRenamed({v: k for k, v in aside.items()}).select(*columns(docs))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes files of token ids in directly addressable codes; per document what is read back from them.

    Null and empty texts are the end id alone; null ids come first; rows that repeat are written as often; texts of any
    length are encoded whole; other columns are ignored. Without documents there are no files and no rows."""
    return read_token_files(write_token_files(docs, TOKENIZER, end_id=0))


STAGES = [("language", language), ("near_dups", near_dups), ("decontaminate", decontaminate), ("mixture", mixture), ("token_files", token_files)]

#: Components, prototypes and token files aren't expressible in SQL; tests/llm/test_pipeline.py has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as a table and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
