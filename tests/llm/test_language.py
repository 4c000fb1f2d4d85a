import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm.language import GRAM, bundled, gram_profiles, identify_language, language_prototypes, letter_vector, prototypes_of
from ledgerloom.llm.queries import op9_hyperdimensional_language

SYLLABLES = {"aa": ["ka", "to", "mi", "ra", "ne"], "bb": ["sch", "ung", "ein", "ter", "ach"], "cc": ["ção", "lh", "nho", "mente", "os"]}


def docs(n, seed):
    r = random.Random(seed)
    return [(i, " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(3, 40))), lang) for i in range(n) for lang in [r.choice(list(SYLLABLES))]]


def test_bundles_are_sums_of_bound_permuted_vectors():
    text = "Ab, ça-b 9 b"
    want = np.zeros(512)
    padded = [0, *map(ord, "ab"), 0, *map(ord, "ça"), 0, ord("b"), 0, ord("b"), 0]
    for i in range(len(padded) - GRAM + 1):
        g = padded[i : i + GRAM]
        if g[1]:
            want += np.prod([np.roll(letter_vector(c), GRAM - 1 - k).astype(float) for k, c in enumerate(g)], axis=0)
    got = bundled(["x y", text, "", "123"])
    assert np.array_equal(got[1], want) and not got[2].any() and not got[3].any()


def test_held_out_accuracy(spark):
    df = spark.createDataFrame(docs(300, 1), "doc_id long, text string, lang string")
    learned = language_prototypes(df.where("doc_id % 3 = 0"))
    rows = identify_language(df.where("doc_id % 3 > 0"), learned).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    base = docs(60, 2)
    rows = [(1, None, "aa"), (2, "", None), (3, "123 !?", "bb"), (None, "kato mira", None), (4, "kato mira " * 40_000, None), (4, "z", "aa")]
    df = spark.createDataFrame(base + rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("own"), "k": F.lit(0)})
    learned = language_prototypes(df)
    assert learned[0] == ["aa", "bb", "cc"]
    odd = identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), learned).collect()
    assert [(r.lang_pred, r.score) for r in odd[:3]] == [("und", 0.0)] * 3 and [r.lang_pred for r in odd[3:5]] == ["aa", "aa"]
    assert identify_language(df.limit(0), learned).count() == 0
    none = language_prototypes(df.where("lang is null and doc_id = 2"))
    assert {(r.lang_pred, r.score) for r in identify_language(df, none).collect()} == {("und", 0.0)}
    assert set(identify_language(df, learned).columns) == {"doc_id", "text", "lang", "k", "lang_pred", "score"}


def test_nul_characters_are_gaps_inside_a_text(spark):
    rows = [(1, "ka\0to", "aa"), (2, "\0", "aa"), (3, "\0\0sch\0ung\0", "bb"), (4, "", "bb"), (5, "sch ung", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language_prototypes(df)
    assert np.array_equal(prototypes_of(gram_profiles(df))[1], learned[1])
    got = {r.doc_id: r.lang_pred for r in identify_language(df, learned).collect()}
    assert got == {1: "aa", 2: "und", 3: "bb", 4: "und", 5: "bb"}
    vectors = bundled(["ka\0to", "ka to", "x", "\0\0sch\0ung\0", "sch ung"])
    assert np.array_equal(vectors[0], vectors[1]) and np.array_equal(vectors[3], vectors[4])


def test_predictions_by_plain_code(spark):
    """Every prediction is that of the plain bundles' cosines, worked out text by text with Python's own counts."""
    from collections import Counter

    rows = docs(80, 5)

    def vector(text):
        letters = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        total = np.zeros(512)
        for w in letters:
            padded = [0, *map(ord, w), 0]
            for g, n in Counter(tuple(padded[i : i + GRAM]) for i in range(len(padded) - GRAM + 1)).items():
                total += n * np.prod([np.roll(letter_vector(c), GRAM - 1 - k).astype(float) for k, c in enumerate(g)], axis=0)
        return total

    sums = {lang: sum(vector(t) for i, t, x in rows if x == lang and i % 2) for lang in SYLLABLES}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify_language(df, language_prototypes(df.where("doc_id % 2 = 1"))).collect()}
    for i, t, _ in rows:
        v = vector(t)
        cos = {x: v @ s / np.linalg.norm(v) / np.linalg.norm(s) for x, s in sums.items()}
        assert got[i].lang_pred == max(cos, key=cos.get) and abs(got[i].score - max(0, *cos.values())) < 1e-9


def test_the_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op9_hyperdimensional_language(spark, sf).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert r.lang_pred != "und" or not any(c.isalpha() for c in want[r.doc_id].text or "")
    held = [r for r in rows if r.held_out and want[r.doc_id].lang and r.lang_pred != "und"]
    assert sum(r.lang_pred == want[r.doc_id].lang for r in held) >= 0.97 * len(held) > 10
