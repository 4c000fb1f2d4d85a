import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from ledgerloom.llm.language import gram_profiles, language_prototypes, prototypes_of
from ledgerloom.llm.storage import written
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "123"), (None, "the and of that"), (9004, "the of and that in it"), (9005, "\0"), (9006, "the\0and of <|endoftext|> it")], "doc_id long, text string")
    docs = docs.unionByName(odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("src0").alias("source"), F.length("text").cast("long").alias("n_chars"))).union(docs.where("doc_id = 7"))
    columns = docs.columns
    steps = {}
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SF), name)
        steps[name] = docs.collect()
        assert name == "token_files" or docs.columns == columns
    ids = lambda name: {r.doc_id for r in steps[name]}
    all_ = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()} | {9004: "the of and that in it", 9006: "the\0and of <|endoftext|> it", None: "the and of that"}
    assert ids("language") == set(all_)
    whole = {i: t for i, t in all_.items() if i is not None}
    kept = {i for i, c in brute.components(whole, 5).items() if i == c}
    assert ids("near_dups") == kept | {None} and len(steps["near_dups"]) == len(kept) + 1
    items = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = lambda text: any(i and brute.nearest_edits(i, re.findall(r"\w+", text.lower())) <= len(i) // 5 for i in items if any(" ".join(i[k : k + 3]) in " ".join(re.findall(r"\w+", text.lower())) for k in range(len(i) - 2)))
    assert ids("decontaminate") == {i for i in kept | {None} if not leaks(all_[i])}
    assert ids("mixture") <= ids("decontaminate") and len(steps["mixture"]) > 0.5 * len(steps["decontaminate"])
    from tokenizers import Tokenizer

    plain, start = Tokenizer.from_file(P.TOKENIZER), 0
    got = sorted(map(tuple, steps["token_files"]), key=lambda r: r[1])
    for row, r in zip(got, sorted(steps["mixture"], key=lambda r: (r.doc_id is not None, r.doc_id or 0)), strict=True):
        tokens = plain.encode(r.text, add_special_tokens=False).ids + [0]
        assert row == (r.doc_id, start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes()))
        start += len(tokens)


def test_run_and_no_documents(spark, tmp_path):
    assert P.run(spark, SF).count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SF), name)
    assert docs.count() == 0 and docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_foreign_letters_and_short_labelled_texts(spark):
    """Texts that share no n-gram with a learned language go, whatever their bundles' cosine; short labelled ones stay."""
    r = random.Random(3)
    rows = [(20_000 + i, " ".join("".join(chr(r.randrange(*span)) for _ in range(r.randint(1, 8))) for _ in range(100)), None) for i in range(60) for span in [[(0x430, 0x450), (0x4E00, 0x5000)][i % 2]]]
    short = [(30_000, "A.\nAll rights reserved.", "en"), (30_001, "Avec.", "fr"), (30_002, "A.", "en"), (30_003, "A.", "en")]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame(rows + short, "doc_id long, text string, lang string").select("doc_id", "text", "lang", F.lit("src0").alias("source"), F.length("text").cast("long").alias("n_chars"))
    got = {x.doc_id for x in P.language(spark, docs.unionByName(odd), SF).select("doc_id").collect()}
    assert not got & {i for i, *_ in rows} and {i for i, *_ in short} <= got
    lettered = {x.doc_id for x in docs.collect() if any(c.isalpha() for c in x.text or "")}
    assert lettered <= got


def test_prototypes_of_profiles_are_those_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, learned = language_prototypes(docs)
    again = prototypes_of(gram_profiles(docs))
    assert names == again[0] and np.array_equal(learned, again[1])


def test_columns_of_any_names_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = ["score", "its_score", "lang_pred", "lang_score", "Lang_Score_", "text_key", "s_source", "s_rate", "s_u", "copy", "Copies", "shuffle_key", "n", "rep", "a.b", "component"]
    docs = docs.select("*", *[F.concat(F.lit(f"{c}:"), "doc_id").alias(c) for c in own])
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == columns and docs.count() > 0
        for r in docs.limit(20).collect():
            assert all(r[c] == f"{c}:{r.doc_id}" for c in own)
