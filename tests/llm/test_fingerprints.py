from __future__ import annotations

import hashlib
import random

import numpy as np
from texts import prose

from segue.llm import fingerprints as fp


def slow_walk(points):
    """One character at a time, by the random bits themselves."""
    spent = fp._tables()[0]
    now, ends = 0, []
    for p in points.tolist():
        now += int(spent[(p ^ (p >> 8)) & 255, now % fp.PERIOD])
        ends.append(now)
    return ends


def test_walks_together_are_walks_alone(monkeypatch):
    rng = random.Random(1)
    texts = [fp.points_of(prose(rng, rng.randrange(0, 60))) for _ in range(100)]
    monkeypatch.setattr(fp, "LOCKSTEP", 20)
    assert [e.tolist() for e in fp.walk(texts, [0] * 100)] == [slow_walk(t) for t in texts]


def test_edits_are_near_and_others_are_not():
    rng = random.Random(2)
    words = prose(rng, 400).split()
    edited = words[:100] + ["new"] + words[101:300] + words[302:]
    a, b, c = fp._lanes([fp.points_of(" ".join(w)) for w in (words, edited, prose(rng, 400).split())])
    assert (a == b).mean() > 0.6 > 0.3 > (a == c).mean()


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.sha1((r[1] or "").encode()).hexdigest()))
    out = []
    for i, (key, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + following[:k]
        p = [fp.points_of(x) for x in (text, edited, following)]
        own, new, other = (fp.sample(x, np.array(slow_walk(x), np.int64)) for x in p)
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.as_text(own), fp.as_text(new), float((own == new).mean()), float((own == other).mean())))
    return sorted(map(repr, out))


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r)[:7] for r in fp.edit_probe(docs).collect()]
    assert sorted(map(repr, got)) == brute(rows)


def test_probe_is_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(fp, "RANGE_ROWS", 10)
    check(spark, [(3 * i, prose(rng, rng.randrange(0, 40))) for i in rng.sample(range(90), 80)])


def test_probe_of_odd_rows(spark, odd, none, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 2)
    check(spark, [(r["doc_id"], r["text"]) for r in odd.collect()])
    check(spark, [(5, "only one document")])
    assert fp.edit_probe(none).count() == 0


def test_classes_and_prints(spark, odd, none):
    rng = random.Random(6)
    words = prose(rng, 300).split()
    near = words[:150] + ["edit"] + words[151:]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words)), (4, prose(rng, 300)), (5, None), (6, ""), (None, " ".join(near)), (None, "by itself")], "node long, text string")
    prints = fp.fingerprints(docs, "node")
    found = [(r["node"], r["class_id"]) for r in fp.classes(prints, 0.7, "node").collect()]
    assert sorted(x for x in found if x[0] is not None) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5)] and sorted(str(c) for i, c in found if i is None) == ["1", "None"]
    assert fp.fingerprints(odd).count() == odd.count() == fp.edit_classes(odd).count() and fp.classes(fp.fingerprints(none)).count() == 0 == fp.edit_classes(none).count()


def test_classes_are_brute_force(spark, monkeypatch):
    """By all pairs: documents that share a band and agree in 0.6 of all lanes, in one group of near copies that is cut into blocks."""
    from segue.llm import components as cc

    monkeypatch.setattr(cc, "HELD_BLOCK", 4)
    monkeypatch.setattr(cc, "READ_BLOCK", 8)
    monkeypatch.setattr(cc, "HUB_BLOCK", 4)
    rng = random.Random(7)
    rows = []
    for _ in range(6):
        base = prose(rng, 60).split()
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randrange(0, 9)):
                words[rng.randrange(len(words))] = "new" + str(rng.randrange(99))
            rows.append((len(rows) * 3, " ".join(words)))
    prints = fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    lanes = {r["doc_id"]: np.array(list(r["fingerprint"])) for r in prints}
    parent = {i: i for i in lanes}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in lanes:
        for b in lanes:
            if a < b and (lanes[a] == lanes[b]).mean() >= 0.6 and any((lanes[a][x] == lanes[b][x]).all() for x in fp._tables()[4]):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    got = {r["doc_id"]: r["class_id"] for r in fp.classes(spark.createDataFrame(prints), 0.6).collect()}
    assert got == {i: root(i) for i in lanes} and 6 <= len(set(got.values())) < 72


def test_digits_are_kept_as_bytes_and_keys_are_shuffled_once(spark, monkeypatch, capsys):
    from segue.llm import components as cc

    plans, written = {}, cc.written

    def seen(df, name):
        plans.setdefault(name, df)
        return written(df, name)

    monkeypatch.setattr(fp, "written", seen)
    monkeypatch.setattr(cc, "written", seen)
    rng = random.Random(8)
    docs = spark.createDataFrame([(i % 5, prose(rng, 20)) for i in range(9)], "doc_id long, text string")
    found = fp.edit_classes(docs).collect()
    assert all(len(r["fingerprint"]) == len(r["edited_fingerprint"]) == 128 and len(r["edited_sha256"]) == 64 for r in found)
    kept = [f.dataType.simpleString() for name in ("fingerprints", "fingerprint-nodes", "fingerprint-classes") for f in plans[name].schema]
    assert "binary" in kept and "string" not in kept
    capsys.readouterr()
    plans["key-sizes"].explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1


def all_pairs(rows, threshold):
    """Links of rows (node, z) by all pairs: those that share a band and agree in threshold of all lanes."""
    lanes = [fp._lanes_of([z])[0] for _, z in rows]
    like = lambda a, b: (a == b).mean() >= threshold and any((a[x] == b[x]).all() for x in fp._tables()[4])
    return {(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i + 1, len(rows)) if like(lanes[i], lanes[j])}


def near_rows(rng, many):
    """Fingerprints of which many are alike in more than 0.8 of their lanes, others in less."""
    base, rows = rng.integers(0, 16, fp.LANES), []
    for node in range(many):
        lanes = np.where(rng.random(fp.LANES) < rng.choice([0.02, 0.15, 0.3]), rng.integers(0, 16, fp.LANES), base).astype(np.uint8)
        rows.append((node, (lanes[0::2] << 4 | lanes[1::2]).tobytes()))
    return rows


def test_pairs_in_buckets_are_all_pairs(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(fp, "BUCKETS", 7)
    rows = near_rows(np.random.default_rng(9), 40)
    bands = fp._bands_of(fp._lanes_of([z for _, z in rows]))
    buckets = {}
    for row, keys in zip(rows, bands.tolist()):
        for band, k in enumerate(keys):
            buckets.setdefault((band, k), []).append({"node": row[0], "z": row[1]})
    several = [(band, held) for (band, _), held in buckets.items() if len(held) > 1]
    batch = pa.RecordBatch.from_arrays([pa.array([b for b, _ in several], pa.int32()), pa.array([h for _, h in several], pa.list_(pa.struct([("node", pa.int64()), ("z", pa.binary())])))], names=["band", "rows"])
    found = [(x["a"], x["b"]) for out in fp._alike_in_buckets(iter([batch.slice(0, 3), batch.slice(3)]), 0.8) for x in out.to_pylist()]
    assert len(found) == len(set(found)) and set(found) == all_pairs(rows, 0.8) and 20 < len(found) < 780


def test_small_buckets_are_compared_where_they_are_gathered(spark, monkeypatch):
    """Hubs are only sought in buckets of more than HELD_BLOCK nodes; chance fills the others."""
    from segue.llm import components as cc

    rows = near_rows(np.random.default_rng(10), 30)
    parent = list(range(30))
    for a, b in sorted(all_pairs(rows, 0.8)):
        lo, hi = sorted((parent[a], parent[b]))
        parent = [lo if p == hi else p for p in parent]
    prints = spark.createDataFrame([(i, z.hex()) for i, z in rows], "doc_id long, fingerprint string")
    classes = lambda: {r["doc_id"]: r["class_id"] for r in fp.classes(prints).collect()}
    sought, hubs = [], cc.popular_hubs
    monkeypatch.setattr(cc, "popular_hubs", lambda *rest: sought.append(1) or hubs(*rest))
    assert classes() == dict(enumerate(parent)) and not sought and 1 < len(set(parent)) < 30
    monkeypatch.setattr(cc, "HELD_BLOCK", 3)
    assert classes() == dict(enumerate(parent)) and sought
