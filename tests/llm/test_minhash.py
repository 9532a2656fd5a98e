from __future__ import annotations

import math
import random
from collections import Counter

from texts import prose

from segue.llm import components as cc
from segue.llm import minhash as mh
from segue.llm.components import components


def brute(rows):
    """Classes by the exact similarity of all pairs."""
    rows = [(i, t or "") for i, t in rows]
    df = Counter(w for _, t in rows for w in set(mh.split(t)))
    n = len(rows)
    idf = lambda w: 1 + math.log(n / max(df[w], n * mh.RARE, 1))

    def features(text):
        words = mh.split(text)
        if not words:
            return {}
        width = min(mh.WORDS, len(words))
        grams = Counter(tuple(words[i : i + width]) for i in range(max(1, len(words) - mh.WORDS + 1)))
        return {g: c * sum(map(idf, g)) / width for g, c in grams.items()}

    known = [(i, t, features(t)) for i, t in rows if i is not None]
    parent = {i: i for i, *_ in known}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, t, f) in enumerate(known):
        for j, u, g in known[:a]:
            common = sum(min(f[x], g[x]) for x in f.keys() & g.keys())
            total = sum(f.values()) + sum(g.values()) - common
            if t == u or total and common / total >= mh.SIMILARITY:
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    return {i: root(i) for i in parent}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = "new" + str(rng.randrange(1000))
    return " ".join(words)


def test_classes_are_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(cc, "HELD_BLOCK", 4)
    monkeypatch.setattr(cc, "READ_BLOCK", 8)
    monkeypatch.setattr(cc, "HUB_BLOCK", 4)
    rows, key = [], 0
    for _ in range(12):
        base = prose(rng, 120).split()
        for n in [0, 0, 1, 1, 2, 2, 3, 3, 4, 5][: rng.randrange(1, 11)]:
            rows.append((key := key + rng.randrange(1, 4), edited(rng, base, n)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in mh.near_classes(docs).collect()} == brute(rows)


def test_odd_rows(spark, odd, none):
    found = [(r["doc_id"], r["class_id"]) for r in mh.near_classes(odd).collect()]
    assert sorted((x for x in found if x[0] is not None)) == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (6, 6), (6, 6), (7, 6), (8, 8)]
    assert sorted(str(c) for i, c in found if i is None) == ["1", "None"]  # a null text counts as the empty one
    kept = mh.deduplicated(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "6", "8", "None"]
    assert mh.near_classes(none).count() == 0 and mh.deduplicated(none).count() == 0


def test_samples_agree_as_weighted_jaccard():
    import numpy as np

    rng = np.random.default_rng(1)
    sampler = mh.Sampler(600)
    hashes = np.sort(rng.integers(0, 1 << 63, 300, np.uint64))
    a, b = rng.random(300) + 0.5, rng.random(300) + 0.5
    found = sampler.samples(np.concatenate([hashes, hashes]), np.concatenate([a, b]), np.array([300, 300]))
    assert abs((found[0] == found[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.06


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40, 60)] + [(100, i) for i in range(101, 140)] + [(7, 3), (3, 9), (5, 5)]
    nodes = spark.createDataFrame([(i,) for i in range(150)], "node long")
    found = {r["node"]: r["component"] for r in components(nodes, spark.createDataFrame(links, "a long, b long")).collect()}
    expect = {i: i for i in range(150)} | {i: 40 for i in range(40, 61)} | {i: 100 for i in range(100, 140)} | {7: 3, 9: 3}
    assert found == expect


def test_recall_of_near_copies(spark):
    """Of all pairs of the test documents at 0.8 or more, by all pairs, nine in ten and more are in one class (all are, as banding misses 1 in 1,000)."""
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    own = {r["doc_id"]: r["class_id"] for r in mh.near_classes(docs).collect()}
    hashes, idf, rarest = mh.word_idf(docs)
    texts = mh.Shingles(hashes, idf, rarest)
    every, weights, sizes = texts.of([t or "" for _, t in rows])
    owner = np.repeat(np.arange(sizes.size), sizes)
    sums = np.bincount(owner, weights, sizes.size)
    order = np.argsort(every, kind="stable")
    cut = np.flatnonzero(np.diff(every[order])) + 1
    common = Counter()
    for part in np.split(order, cut):
        for n, i in enumerate(part):
            for j in part[:n]:
                common[(owner[j], owner[i])] += min(weights[i], weights[j])
    near = [(a, b) for (a, b), c in common.items() if c >= 0.8 * (sums[a] + sums[b] - c)]
    caught = [own[rows[a][0]] == own[rows[b][0]] for a, b in near]
    assert len(near) > 50 and sum(caught) >= 0.99 * len(caught)
    # classes hold nothing else: every class is connected by such pairs and equal texts
    linked = components(spark.createDataFrame([(r[0],) for r in rows], "node long"), spark.createDataFrame([(rows[a][0], rows[b][0]) for a, b in near], "a long, b long"))
    assert {r["node"]: r["component"] for r in linked.collect()} == own
