import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import near_dups as N
from ledgerloom.llm.near_dups import near_duplicates
from ledgerloom.llm.queries import op5_minhash_near_dups
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def texts(seed):
    """Bases with exact copies, copies with a few words changed, short and empty texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out, n = {}, 0
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 8, 40, 120]))]
        for _ in range(r.randint(1, 9)):
            copy = base[:]
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            out[n] = r.choice(["{}", " {}\n", "{} "]).format(r.choice([" ", "\n"]).join(copy))
            n += 1
    return out | {n: "", n + 1: None, n + 2: " \t", n + 3: "One", n + 4: "one", n + 5: "two words", n + 6: "TWO\twords"}


@pytest.mark.parametrize("seed,words", [(1, 4), (2, 5)])
def test_as_brute_force(spark, seed, words):
    t = texts(seed)
    rows = near_duplicates(spark.createDataFrame(list(t.items()), SCHEMA), words=words).collect()
    want = brute.components(t, words)
    assert {r.doc_id: r.component_id for r in rows} == want
    assert all(r.n_shingles == len(brute.shingles(t[r.doc_id], words)) and r.kept == (r.doc_id == want[r.doc_id]) for r in rows)


def test_a_large_group_of_near_copies(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    t = {}
    for i in range(300):
        copy = base[:]
        for _ in range(r.randint(0, 6)):
            copy[r.randrange(150)] = f"x{r.randrange(10**6)}"
        t[i] = " ".join(copy)
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(list(t.items()), SCHEMA)).collect()}
    assert got == brute.components(t, 4)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [(1, long), (2, long + " more"), (None, long), (None, None), (3, "x y z v"), (3, "x y z v"), (4, "a b c d")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"n": F.lit(1), "component_id": F.lit("own"), "sketch": F.lit(2)})
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (2, 1, False), (None, None, True), (None, None, True), (3, 3, True), (3, 3, True), (4, 4, True)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0


def near_copies(n, edits, seed=5, words=150):
    r = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    out = {}
    for i in range(n):
        copy = base[:]
        for _ in range(r.randint(0, edits)):
            copy[r.randrange(words)] = f"x{r.randrange(10**6)}"
        out[i] = " ".join(copy)
    return out


@pytest.mark.parametrize("edits", [3, 6])
def test_rows_grow_with_the_group_not_with_its_square(spark, monkeypatch, edits):
    """All rows that are written or dealt out for one group of near copies; its square would be 16 times as many."""
    rows = []

    def counted(f):
        def of(*args):
            out = f(*args)
            rows.append(out.count())
            return out

        return of

    monkeypatch.setattr(N.Scratch, "written", counted(N.Scratch.written))
    monkeypatch.setattr(N, "_cells", counted(N._cells))
    totals = []
    for n in (80, 320):
        rows.clear()
        near_duplicates(spark.createDataFrame(list(near_copies(n, edits).items()), SCHEMA))
        totals.append(sum(rows))
    assert totals[1] < 8 * totals[0]


def test_the_exact_way_finds_what_hubs_and_best_candidates_miss(spark):
    """A chain of texts, each similar enough to its neighbours only."""
    words = [f"w{i}" for i in range(300)]
    chain = {i: " ".join(words[4 * i : 4 * i + 100]) for i in range(40)}
    t = chain | {100 + i: x for i, x in near_copies(60, 8, seed=2, words=60).items()}
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame(list(t.items()), SCHEMA)).collect()}
    assert got == brute.components(t, 4)


def test_the_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    t = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = brute.components(t, 4)
    rows = op5_minhash_near_dups(spark, sf).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {i: (len(brute.shingles(t[i], 4)), c, c == i) for i, c in want.items()} and len(rows) == len(t)


def test_nothing_but_the_result_stays_in_the_shared_folder(spark):
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = {x.name for x in folder.iterdir()}
    near_duplicates(spark.createDataFrame(list(near_copies(30, 6).items()), SCHEMA)).count()
    left = {x.name for x in folder.iterdir()} - before
    assert len(left) == 1 and all(x.startswith("near-dups-") for x in left)


def test_an_id_with_two_texts(spark):
    """Both texts of the smallest id of their sets have their links found."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a), (3, b), (4, a + " more"), (5, b + " more"), (6, "else " + b), (0, "c d e f g")]
    got = sorted((r.doc_id, r.component_id, r.n_shingles) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted([(1, 1, 57), (1, 1, 57), (2, 1, 57), (3, 1, 57), (4, 1, 58), (5, 1, 58), (6, 1, 58), (0, 0, 2)])
