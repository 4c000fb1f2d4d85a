import random
import re
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate as D
from ledgerloom.llm.decontaminate import Matcher, contaminations, decontaminated
from ledgerloom.llm.queries import op1_pigeonhole_decontamination
from tests.llm import brute

LETTERS = ["a", "b", "c", "d", "e", "Foo", "bär", "x1"]


def test_as_brute_force():
    r = random.Random(2)
    for _ in range(150):
        items = [(i, " ".join(r.choice(LETTERS) for _ in range(r.randint(0, 14)))) for i in range(3)]
        texts = [None]
        for _ in range(4):
            w = [r.choice(LETTERS) for _ in range(r.randint(0, 30))]
            if planted := items[0][1].split():
                for _ in range(r.randint(0, 3)):
                    planted[r.randrange(len(planted))] = r.choice(LETTERS)
                w[5:5] = planted
            texts.append(", ".join(w))
        got = {(t, i): e for t, i, e, _, _ in Matcher(items).matches(pa.array(texts))}
        want = {}
        for k, t in enumerate(texts):
            for i, x in items:
                a, b = re.findall(r"\w+", x.lower()), re.findall(r"\w+", (t or "").lower())
                if a and (e := brute.nearest_edits(a, b)) <= len(a) // 5:
                    want[k, i] = e
        assert got == want


ITEM = "the quick brown fox jumps over the lazy dog and runs far away today"


def test_documents(spark):
    rows = [(1, f"Before. {ITEM.upper()}! After"), (2, ITEM.replace("fox", "cat").replace("lazy ", "")), (3, "the quick brown fox sleeps"), (None, ITEM), (4, None), (5, ""), (6, ("word " * 50_000) + ITEM), (6, ("word " * 50_000) + ITEM), (7, "“The quick” brown—fox jumps over the lazy dog and runs far away today")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item_id": F.lit("own"), "edits": F.lit(9)})
    items = spark.createDataFrame([(10, ITEM), (11, None), (12, ""), (13, "?!")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.edits) for r in contaminations(df, items).collect()), key=str)
    assert got == sorted([(1, 10, 0), (2, 10, 2), (None, 10, 0), (6, 10, 0), (6, 10, 0), (7, 10, 0)], key=str)
    clean = decontaminated(df, items)
    assert sorted(r.doc_id for r in clean.collect()) == [3, 4, 5] and clean.columns == df.columns
    assert contaminations(df.limit(0), items).count() == 0 and contaminations(df, items.limit(0)).count() == 0
    assert decontaminated(df, items.limit(0)).count() == len(rows)


def test_items_in_many_blocks(spark, monkeypatch):
    """Each block is a file; items that are the same words are looked for once and found under all their ids."""
    r = random.Random(4)
    items = [(i, " ".join(r.choice(LETTERS) for _ in range(12))) for i in range(20)] + [(90, ITEM), (91, ITEM + "!"), (None, ITEM)]
    texts = [(i, " ".join(r.choice(LETTERS) for _ in range(60))) for i in range(10)] + [(50, "x " + ITEM)]
    df, it = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(str, contaminations(df, it).collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 150)
    assert len(D._blocks(it, "item_id", "text")) > 4
    assert sorted(map(str, contaminations(df, it).collect())) == one and sum("doc_id=50" in x for x in one) == 3
    assert 50 not in {x.doc_id for x in decontaminated(df, it).collect()}


def test_memory_of_a_long_item_is_linear():
    words = [f"w{i}" for i in range(20_000)]
    m = Matcher([(1, " ".join(words))])
    text = words[:]
    for i in range(0, 20_000, 10):
        text[i] = "other"
    item = m.items[0]
    hashes = D.words_of(pa.array([" ".join(text[:600])])).hashes().tolist()
    tracemalloc.start()
    item.nearest(hashes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20
    short = Matcher([(1, " ".join(words[:3000]))]).matches(pa.array(["x " + " ".join(text[:3000])]))
    assert short == [(0, 1, 300, 600, 3001)]


def test_items_without_budget_are_found_word_for_word():
    m = Matcher([(1, "alpha beta gamma delta"), (2, "omega")])
    got = [(t, i, e) for t, i, e, _, _ in m.matches(pa.array(["x alpha beta gamma delta", "alpha beta delta", "Omega.", "omegas"]))]
    assert got == [(0, 1, 0), (2, 2, 0)]


def test_the_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    words = lambda t: re.findall(r"[^\W_]+", re.sub("[\u2000-\u206f]", " ", (t or "").lower()))
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = words(r.text)
        held = set(text)
        # an item within budget has four of five of its words in the document
        want |= {(r.doc_id, i) for i, w in items.items() if w and sum(x in held for x in w) >= len(w) - len(w) // 5 and brute.nearest_edits(w, text) <= len(w) // 5}
    got = [(r.doc_id, r.item_id) for r in op1_pigeonhole_decontamination(spark, sf).collect()]
    assert set(got) == want and len(got) == len(want) > 0
