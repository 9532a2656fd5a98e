from __future__ import annotations

import random
from collections import defaultdict

from texts import prose

from segue.llm import mixing


def expected_targets(sizes):
    """The capped shares by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return target


def make(spark, n, seed=3):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(0, 30)), rng.choice(["s1"] * 5 + ["s2", "s3", None, "Z"])) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_targets_taken_and_reruns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 20)
    monkeypatch.setattr(mixing, "FAN", 3)
    docs, rows = make(spark, 900)
    found = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: r["doc_id"]
    assert [tuple(r) for r in sorted(found, key=key)] == [tuple(r) for r in sorted(again, key=key)] and len(found) == 900
    sizes, taken, source = defaultdict(int), defaultdict(int), {i: s for i, _, s in rows}
    for i, t, s in rows:
        sizes[s] += len(t.split())
    for r in found:
        taken[source[r["doc_id"]]] += r["copies"] * r["size"]
        assert r["copies"] in (0, 1, 2) and r["source_size"] == sizes[source[r["doc_id"]]]
    goal = expected_targets(sizes)
    assert all(abs(r["target"] - goal[source[r["doc_id"]]]) < 1e-6 for r in found)
    assert all(abs(taken[s] - goal[s]) <= 30 for s in sizes)


def test_pairs_keep_words_and_means():
    rng = random.Random(1)
    for _ in range(300):
        p, q, s, t = rng.random() * 0.98 + 0.01, rng.random() * 0.98 + 0.01, rng.randrange(1, 99), rng.randrange(1, 99)
        a, b = zip(*[mixing.pair(p, s, q, t, (k + 0.5) / 2000) for k in range(2000)])
        assert all(abs(x * s + y * t - p * s - q * t) < 1e-9 and (x in (0.0, 1.0) or y in (0.0, 1.0)) for x, y in zip(a, b))
        assert abs(sum(a) / 2000 - p) < 2e-3 and abs(sum(b) / 2000 - q) < 2e-3


def test_odd_rows(spark, odd, none):
    found = mixing.mix(odd).collect()
    assert len(found) == odd.count() and all(r["copies"] is not None for r in found)
    assert {r["size"] for r in found if r["doc_id"] in (1, 2, 3)} == {0}
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0


def test_rows_are_taken_as_often_as_said(spark):
    docs, _ = make(spark, 200, 9)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, ["doc_id"]).collect()}
    counted = defaultdict(int)
    for r in mixing.mixed(docs).collect():
        counted[r["doc_id"]] += 1
    total = sum(copies.values())
    assert set(counted.values()) <= {1, 2} and abs(sum(counted.values()) - total) <= 60


def test_repeated_rows_are_taken_no_more_often_than_said(spark):
    """Three and forty equal rows: what is taken of all words comes near the target, whatever repeats."""
    text = lambda n, w: " ".join([w] * n)
    rows = [(1, text(20, "a"), "s", None)] * 3 + [(2, text(9, "b"), "s", "x")] * 40 + [(2, text(9, "b"), "s", None)] + [(3 + i, text(7, "c"), "s", "x") for i in range(50)] + [(500 + i, text(30, "d"), "t", None) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, note string")
    goals = {r["doc_id"]: r["target"] for r in mixing.mix(docs).collect()}
    counted, notes = defaultdict(int), set()
    for r in mixing.mixed(docs).collect():
        counted[r["doc_id"]] += 1
        notes.add((r["doc_id"], r["note"]))
    words, source = {r[0]: len(r[1].split()) for r in rows}, {r[0]: r[2] for r in rows}
    for s in "st":
        assert abs(sum(n * words[i] for i, n in counted.items() if source[i] == s) - goals[1 if s == "s" else 500]) <= 30
    assert notes <= {(r[0], r[3]) for r in rows}
