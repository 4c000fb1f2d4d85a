import hashlib
import random

import pytest

from ledgerloom.operators import replay as rp
from ledgerloom.operators.components import components
from tests.helpers import evidence


def reference(rows):
    """Evidence (op, a, b, confidence, txid) replayed plainly: {address: (anchor, confidence, size)}."""
    seen, pairs = {}, {}
    for op, a, b, c, txid in sorted(rows):
        if a == b:
            continue
        for x in (a, b):
            seen.setdefault(x, len(seen))
        key = (min(a, b), max(a, b))
        pairs.setdefault(key, (op, {}))[1].setdefault(txid or f"op:{op}", []).append(c)
    root = {a: a for a in seen}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    near = {a: [] for a in seen}
    for (a, b), (_, by) in sorted(pairs.items(), key=lambda p: p[1][0]):
        left = 1.0
        for c in by.values():
            left *= 1 - max(c)
        if find(a) != find(b):
            root[find(a)] = find(b)
            near[a].append((b, 1 - left))
            near[b].append((a, 1 - left))
    groups = {}
    for a in seen:
        groups.setdefault(find(a), []).append(a)
    out = {}
    for members in groups.values():
        anchor = min(members, key=seen.get)
        conf, todo = {anchor: 1.0}, [anchor]
        while todo:
            v = todo.pop()
            for w, c in near[v]:
                if w not in conf:
                    conf[w] = min(conf[v], c)
                    todo.append(w)
        for m in members:
            out[m] = (anchor, round(conf[m], 9), len(members))
    return out


def replayed(spark, rows, **options):
    got = rp.replay(evidence(spark, *rows), **options).collect()
    for r in got:
        assert r.cluster_id == hashlib.sha256(r.anchor_address.encode()).hexdigest()[:32]
    return {r.address: (r.anchor_address, round(r.confidence, 9), r.size) for r in got}


def test_basics(spark):
    got = replayed(spark, [(1, "A", "B", 0.95, "t1"), (2, "A", "C", 0.95, "t2"), (3, "D", "E", 0.9, "t3")])
    assert got == {"A": ("A", 1.0, 3), "B": ("A", 0.95, 3), "C": ("A", 0.95, 3), "D": ("D", 1.0, 2), "E": ("D", 0.9, 2)}


@pytest.mark.parametrize("rows,want", [([(1, 0.5, "t1"), (2, 0.5, "t2")], 0.75), ([(1, 0.6, "t"), (2, 0.9, "t")], 0.9), ([(1, 0.5, "t1"), (2, 0.4, "t2"), (3, 0.3, None)], 0.79)])
def test_combined_confidence(spark, rows, want):
    assert replayed(spark, [(op, "A", "B", c, t) for op, c, t in rows])["B"][1] == pytest.approx(want, abs=1e-9)


def test_invalidated_and_loops_don_t_count(spark):
    assert set(replayed(spark, [(1, "A", "B", 0.9, "t1", "invalidated"), (2, "B", "C", 0.9, "t2"), (3, "D", "D", 0.9, "t3")])) == {"B", "C"}


def test_threshold_splits_and_filters_before_combining(spark):
    rows = [(1, "A", "B", 0.9, "t1"), (2, "C", "D", 0.9, "t2"), (3, "B", "C", 0.2, "t3"), (4, "E", "F", 0.5, "t4"), (5, "E", "F", 0.5, "t5")]
    assert replayed(spark, rows)["D"][0] == "A"
    assert {a: v[0] for a, v in replayed(spark, rows, least=0.6).items()} == {"A": "A", "B": "A", "C": "C", "D": "C"}


def test_a_late_strong_edge_that_closes_a_cycle_is_ignored(spark):
    assert replayed(spark, [(1, "A", "B", 0.3, "t1"), (2, "B", "C", 0.4, "t2"), (3, "A", "C", 0.99, "t3")])["C"][1] == 0.3


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("local_edges", [0, 10**6])
def test_random_graphs_either_way(spark, seed, local_edges):
    r = random.Random(seed)
    rows = [(op, f"a{r.randrange(25)}", f"a{r.randrange(25)}", r.choice([0.2, 0.4, 0.6, 0.95]), r.choice([None, f"t{r.randrange(9)}"])) for op in range(1, 28)]
    want = reference(rows)
    shuffled = rows[:]
    r.shuffle(shuffled)
    assert replayed(spark, shuffled, local_edges=local_edges) == want


def test_no_evidence(spark):
    assert rp.replay(evidence(spark)).count() == 0


@pytest.mark.parametrize("local", [0, 1000])
def test_components_of_chains_stars_and_loops(spark, local):
    rows = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(20)] + [(7, 7), (None, 3)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(rows, "x long, y long"), local).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(20)}}


def test_materialised_rounds_to_three_places(spark):
    rows = [(1, "A", "B", 0.95, "t1"), (2, "A", "B", 0.95, "t2")]
    _, members = rp.materialised(rp.replay(evidence(spark, *rows)))
    assert {r.address: str(r.membership_confidence) for r in members.collect()} == {"A": "1.000", "B": "0.997"}
