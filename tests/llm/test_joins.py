import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from wirefold.llm import set_join, vector_join
from wirefold.llm.components import components

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def smallest(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def sets_of(rows, n=5):
    out = {}
    for i, text in rows:
        w = re.findall(r"[^ \t-\r]+", (text or "").translate(FOLD))
        out[i] = {tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    return out


def brute(rows, n=5, num=75, den=100):
    sets = sets_of(rows, n)
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and den * len(
        sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in smallest(ids, links).items()}


def corpus(seed, n, sizes, shared=False):
    """Random texts with near copies at all distances, chains, exact copies and, if asked for, shared passages."""
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(3000)
    passage = [word() for _ in range(40)]
    out = []
    while len(out) < n:
        t = [word() for _ in range(r.choice(sizes))]
        if shared:
            t += passage
        out.append(t)
        for _ in range(r.randrange(5)):
            t = list(t)
            for _ in range(r.randrange(1, 2 + len(t) // 12)):
                k = r.randrange(len(t))
                t[k:k + r.randrange(2)] = [word()] * r.randrange(2)
            out.append(t or ["w"])
            if r.random() < 0.3:
                out.append(list(t))
    return [(i, " ".join(t)) for i, t in enumerate(out[:n])]


@pytest.mark.parametrize("seed,sizes,shared,bands", [
    (1, [3, 5, 6, 8, 12, 30], False, set_join.Bands()),
    (2, [20, 80, 150, 300], True, set_join.Bands()),
    (3, [5, 8, 12, 20, 40, 90], True, set_join.Bands(slack=1.0, single=1)),
    (4, [40, 90, 200], False, set_join.Bands(slack=1.05, single=8)),
    (5, [20, 50, 120], False, set_join.Bands(num=60, den=100))])
def test_components_match_all_pairs(spark, seed, sizes, shared, bands):
    rows = corpus(seed, 150, sizes, shared)
    got = set_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), bands)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute(rows, 5, bands.num, bands.den)


def test_deletion_neighbourhoods_are_used(spark):
    rows = corpus(3, 150, [5, 8, 12, 20, 40, 90], True)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    short = lambda bands: set_join.document_facts(docs, bands, 2000).filter("exists(facts, f -> f.short > 0)").count()
    assert short(set_join.Bands(slack=1.0, single=1)) > 3
    assert short(set_join.Bands()) == 0


def test_sizes_stay_within_neighbouring_bands():
    for bands in (set_join.Bands(), set_join.Bands(single=1), set_join.Bands(num=60)):
        edges = bands.edges(5000)
        band = lambda n: int(np.searchsorted(edges, n, "left")) - 1  # noqa: B023, E731
        for a in range(1, 1500):
            b = bands.largest_partner(a)
            assert band(b) - band(a) in (0, 1)
            mine = {s: (m, e) for s, m, e in bands.schemes(a, edges)}
            for s, m, e in bands.schemes(b, edges):
                if s in mine:
                    assert e >= bands.errors(a, b) and mine[s][1] >= bands.errors(a, b) and (not m or m > e)


def test_set_join_edges(docs, rows, none, clashing):
    got = set_join.similar_components(docs)
    known = [(i, t) for i, t, *_ in rows if i is not None]
    want = brute(dict(known).items())
    assert got.count() == len(rows)
    for r in got.collect():
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert set_join.similar_components(none).count() == 0
    assert set_join.similar_components(clashing).count() == len(rows)


def test_hot_group(spark):
    """Many copies of one text, and many near copies of another."""
    r = random.Random(9)
    base = ["w%d" % r.randrange(900) for _ in range(120)]
    rows = [(i, " ".join(base)) for i in range(150)]
    for i in range(150, 350):
        t = list(base)
        for _ in range(r.randrange(1, 6)):
            t[r.randrange(len(t))] = "x%d" % r.randrange(900)
        rows.append((i, " ".join(t)))
    got = set_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute(rows)


@pytest.mark.parametrize("links", [
    [], [(1, 2), (2, 3), (5, 4), (4, 4), (7, 7)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)],
    [(i, (i * 7) % 101) for i in range(101)]])
def test_connected_components(spark, links):
    got = components(spark.createDataFrame(links, "a long, b long"))
    nodes = {x for a, b in links if a != b for x in (a, b)}
    want = {n: c for n, c in smallest(nodes, [x for x in links if x[0] != x[1]]).items()}
    assert {r["node"]: r["component"] for r in got.collect()} == {n: c for n, c in want.items() if n != c} | {
        r["node"]: r["component"] for r in got.collect() if r["node"] == r["component"]}
    assert {n for n, c in want.items() if n != c} <= {r["node"] for r in got.collect()}


def vectors(seed, n=400, dim=12):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(20, dim))
    x = centre[rng.integers(0, 20, n)] + rng.normal(size=(n, dim)) * rng.choice([0.05, 0.3, 1.0], (n, 1))
    x[5:9], x[9], x[10] = x[4], x[4] * 7.5, x[4] * 1e-200
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


def vector_brute(rows, cosine):
    ok = {i: np.array(v, float) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    ok = {i: v / np.abs(v).max() for i, v in ok.items()}
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.sqrt(
        (ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= cosine]
    n = {i: sum(i in x for x in links) for i, _ in rows}
    return {i: (n[i], c, c == i) for i, c in smallest([i for i, _ in rows], links).items()}


@pytest.mark.parametrize("cosine,blocks,seed", [(0.9, None, 1), (0.9, 16, 2), (0.5, 24, 3), (0.99, None, 4)])
def test_vector_links_match_all_pairs(spark, monkeypatch, cosine, blocks, seed):
    if blocks:
        monkeypatch.setattr(vector_join, "BLOCK_NUMBERS", blocks * 12)
    rows = vectors(seed) + [(900, None), (901, []), (902, [0.0] * 12), (903, [1.0] * 11 + [None]),
                            (904, [float("nan")] * 12), (905, [float("inf")] + [1.0] * 11), (906, [1.0, 2.0])]
    got = vector_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cosine)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got.collect()} == vector_brute(rows, cosine)


def test_vectors_of_every_length_are_joined(spark):
    rows = vectors(6, 60) + [(100 + i, v[:7]) for i, v in vectors(7, 50)] + [(200, [1.0, 2.0]), (201, [2.0, 4.0])]
    want = vector_brute(rows, 0.9)
    assert all(any(want[i][0] for i in ids) for ids in (range(60), range(100, 150), (200, 201)))
    got = vector_join.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got.collect()} == want


def test_vector_edges(spark):
    schema = "vec_id long, embedding array<float>, Key string, `unit` int, label int"
    assert vector_join.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 0.0], "k", 1, 2), (None, [1.0, 0.0], "k", 1, 2), (1, [1.0, 0.0], None, 1, 2), (3, [2.0, 0.0], "", 1, 2)]
    got = vector_join.near_duplicates(spark.createDataFrame(rows, schema)).orderBy("vec_id").collect()
    assert [tuple(r) for r in got] == [(None, 0, None, False), (1, 2, 1, True), (1, 2, 1, True), (3, 2, 1, False)]
    nothing = vector_join.near_duplicates(spark.createDataFrame([(1, [0.0]), (2, None)], "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, nothing.collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("block,route", [(512, 1 << 22), (7, 1 << 22), (5, 300)])
def test_blocks_and_routes_lose_no_link(spark, monkeypatch, block, route):
    """A family of near misses and links around the threshold, met in small blocks and over several tasks."""
    monkeypatch.setattr(set_join, "ROUTE_MEMBERS", route)
    monkeypatch.setattr(set_join.links_in_groups, "__defaults__", (block,))
    monkeypatch.setattr(set_join, "ROUNDS", (1,))
    r = random.Random(11)
    base, rows = ["w%d" % r.randrange(2000) for _ in range(100)], []
    for i in range(90):
        t = list(base)
        for k in r.sample(range(100), r.randrange(1, 4)):
            t[k] = "x%d" % r.randrange(2000)
        rows.append((i, " ".join(t)))
    got = set_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    want = brute(rows)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got.collect()} == want
    assert 3 < len({c for _, c in want.values()}) < 80
