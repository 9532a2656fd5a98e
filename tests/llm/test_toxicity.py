from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from texts import prose

from segue.llm import toxicity as tx
from segue.llm.common import id_share
from segue.llm.letters import word_hash
from segue.llm.queries import op8_toxicity

SF = "/root/testdata/sf0.1"


def rates(rows, labels):
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    share = lambda y: np.mean([r["predicted"] for r in held if labels[r["doc_id"]] == y])
    return share(1), share(0)


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    caught, wrong = rates(op8_toxicity(spark, SF).collect(), labels)
    print("caught", caught, "wrong", wrong)
    assert caught > 0.85 and wrong < 0.02


def test_few_labels_are_enough(spark):
    """The classifier learns from texts without a label: with labels of one document in three it is nearly as good."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    few = labels.where(id_share("doc_id", 5) != 0).where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)
    model = tx.learn(docs.where(id_share("doc_id", 5) != 0), few)
    scored = tx.score(docs, model).select("doc_id", (id_share("doc_id", 5) == 0).alias("held_out"), (F.col("score") >= 0.5).cast("int").alias("predicted"))
    caught, wrong = rates(scored.collect(), {r["doc_id"]: r["toxic"] for r in labels.collect()})
    print("caught", caught, "wrong", wrong, model["annotator"], model["groups"])
    assert caught > 0.8 and wrong < 0.03


def test_features_are_words_and_stems():
    rng = random.Random(3)
    texts = [prose(rng, 300), "", "Walking walker walks walked; walk_1", "ünüber über 𝔘𝔫𝔦 x" * 40, "a'b c-d\n\n e"]
    got = {}
    for kind, owner, hashes in tx.features(texts):
        for o, h in zip(owner.tolist(), hashes.tolist()):
            assert (o, kind, h) not in got or kind != tx.WORD
            got[(o, kind, h)] = True
    want = set()
    for i, text in enumerate(texts):
        words = set(re.findall(r"\w+", text.lower()))
        want |= {(i, tx.WORD, word_hash(w)) for w in words}
        for k in tx.STEMS:
            stems = Counter(w[:k] for w in words if len(w) > k)
            want |= {(i, tx.STEM, word_hash(s)) for s in stems} | {(i, tx.OFTEN, word_hash(s)) for s, n in stems.items() if n >= tx.SEVERAL}
    assert set(got) == want


def test_votes_by_brute_force():
    learned = [[(tx.WORD, word_hash("alpha")), (tx.STEM, word_hash("walk"))], [(tx.OFTEN, word_hash("walk"))], []]
    vocabulary = [(tx.WORD, word_hash("alpha")), (tx.WORD, word_hash("you")), (tx.OFTEN, word_hash("walk"))]
    texts = ["You are such an idiot!!!", "Alpha walking", "walks walked walker", "", "THIS NEVER ENDS HERE ok", "what a s**t day", "YOU ARE A MORON", "two!! three"]
    votes, owner, word = tx.Voters(learned, vocabulary).of(texts)
    names = [set(x.split()) for x in tx.LEXICONS.values()]
    for i, text in enumerate(texts):
        words = set(re.findall(r"\w+", text.lower()))
        stems = Counter(w[:4] for w in words if len(w) > 4)
        want = [bool(words & n) for n in names] + ["alpha" in words or "walk" in stems, stems["walk"] >= 3] + [re.search(p, text) is not None for p in tx.PATTERNS.values()]
        assert votes[i].tolist() == [int(x) for x in want], text
        assert word[owner == i].tolist() == [j for j, x in enumerate(["alpha" in words, "you" in words, stems["walk"] >= 3]) if x]


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    n = 40_000
    y = rng.random(n) < 0.2
    real = [(0.8, 0.02), (0.6, 0.05), (0.5, 0.01), (0.3, 0.25)]
    votes = np.stack([rng.random(n) < np.where(y, a, b) for a, b in real] + [np.zeros(n, bool)], axis=1).astype(np.int8)
    votes[:, 4] = votes[:, 0]  # a voter that repeats another
    said = np.where(rng.random(n) < np.where(y, 0.8, 0.1), 1, 0)  # an annotator who is often wrong
    gold = np.where(rng.random(n) < 0.3, said, -1)
    every, counts = np.unique(np.hstack([votes, gold[:, None]]), axis=0, return_counts=True)
    model = tx.LabelModel(every[:, :-1].astype(np.int8), every[:, -1], counts.astype(float))
    assert np.abs(model.toxic[:3] - [0.8, 0.6, 0.5]).max() < 0.06 and np.abs(model.clean[:3] - [0.02, 0.05, 0.01]).max() < 0.03
    assert [0, 4] in model.groups and [3] in model.groups and abs(model.prior - 0.2) < 0.04
    assert abs(model.annotator[0] - 0.8) < 0.06 and abs(model.annotator[1] - 0.1) < 0.04
    # texts without a label get posteriors that fit their class
    none = model.posterior(votes, np.full(n, -1))
    assert ((none > 0.5) == y).mean() > 0.93 and abs(none.mean() - y.mean()) < 0.03
    # as Bayes' rule has it for the real rates, the repeated voter counted once
    odds = np.log(0.2 / 0.8) + sum(np.where(votes[:, j] == 1, np.log(a / b), np.log((1 - a) / (1 - b))) for j, (a, b) in enumerate(real))
    assert np.abs(none - 1 / (1 + np.exp(-odds))).mean() < 0.03


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (2, 1), (4, 0), (4, 1), (99, 1), (None, 1), (6, None), (7, 5)], "doc_id long, toxic int")
    model = tx.learn(odd, labels)
    rows = tx.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    for docs, known in ((none, labels), (odd, labels.where("false"))):
        empty = tx.learn(docs, known)
        scores = {r["doc_id"]: r["score"] for r in tx.score(spark.createDataFrame([(1, "you worthless idiot"), (2, "a fine day")], "doc_id long, text string"), empty).collect()}
        assert scores[1] > 0.5 > scores[2] and tx.score(none, empty).count() == 0
