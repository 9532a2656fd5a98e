from __future__ import annotations

import random
from collections import Counter

import numpy as np
from texts import prose

from segue.llm import language_id as li
from segue.llm.queries import learned_profiles, op5_language_id


def test_grams_by_hand():
    got = li.grams("Ab")
    expect = {"a", "b", "\0a", "ab", "b\0", "\0ab", "ab\0"}
    assert set(got.tolist()) == {sum(ord(c) << (li.BITS * (len(x) - 1 - i)) for i, c in enumerate(x)) | (0, 0, int(li.PAIR), int(li.TRIPLE))[len(x)] for x in expect}
    assert li.grams("a -- a").tolist() and not li.grams("12 !").size and not li.grams("").size


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in op5_language_id(spark, sf).collect() if r["held_out"]]
    assert len(rows) > 300 and sum(r["lang_pred"] == langs[r["doc_id"]] for r in rows) / len(rows) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows(spark, odd, none):
    learned = learned_profiles(odd)
    rows = li.predict(odd, learned, ["doc_id"]).collect()
    assert len(rows) == odd.count()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3, 8)} == {"und"}
    kept = li.accepted(odd, learned)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["6", "6", "7", "None"]  # 4 and 5 are long and like no profile
    assert li.predict(none, {}, ["doc_id"]).count() == 0 and li.profiles(none) == {}
    assert {r["lang_pred"] for r in li.predict(odd, {}, ["doc_id"]).collect()} == {"und"}


def plain_grams(text):
    """The n-grams of a text one by one, as strings; a blank sets off words."""
    marks = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)
    if not marks.strip():
        return []
    marks = " " + " ".join(marks.split()) + " "
    one = [c for c in marks if c != " "]
    two = [marks[i : i + 2] for i in range(len(marks) - 1)]
    three = [marks[i : i + 3] for i in range(len(marks) - 2) if marks[i + 1] != " "]
    return one + two + three


def number(gram):
    """A gram as the operator numbers it, for ties."""
    code = 0
    for c in gram:
        code = code << li.BITS | (0 if c == " " else ord(c))
    return code | (0, 0, int(li.PAIR), int(li.TRIPLE))[len(gram)]


def plain_ranks(grams, places):
    return [g for g, _ in sorted(Counter(grams).items(), key=lambda x: (-x[1], number(x[0])))[:places]]


def test_predictions_by_brute_force(spark):
    """Profiles, out-of-place distances and predictions by a plain loop over n-grams as strings."""
    rng = random.Random(8)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randrange(2, 7)))
    rows = [(i, " ".join(word(lang) for _ in range(rng.randrange(1, 40))), lang) for i, lang in enumerate(rng.choice(list(letters)) for _ in range(90))]
    rows += [(100, "Efgh efgh! ÀÉ", None), (101, "", "aa"), (102, None, "bb"), (103, "12 ?", "cc"), (104, prose(rng, 50), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = li.profiles(docs, places=40)
    profiles = {lang: plain_ranks([g for _, t, own in rows if own == lang and t for g in plain_grams(t)], 40) for lang in letters}
    assert {k: [number(g) for g in v] for k, v in profiles.items()} == learned
    got = {r["doc_id"]: r for r in li.predict(docs, learned, ["doc_id"], places=40).collect()}
    for i, text, _ in rows:
        own = plain_ranks(plain_grams(text or ""), 40)
        if not own:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        away = {lang: sum(abs(p.index(g) - n) if g in p else 40 for n, g in enumerate(own)) / (40 * len(own)) for lang, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        assert got[i]["lang_pred"] == best and abs(got[i]["distance"] - away[best]) < 1e-12
        others = min(d for lang, d in away.items() if lang != best)
        assert abs(got[i]["score"] - max(0.0, 1 - away[best] / others)) < 1e-9


def test_a_language_with_few_n_grams_has_all_of_them(spark):
    """However rare an n-gram is, and ranked as the counts say, ties by hash."""
    rows = [("ab", "xx"), ("ab ab ac", "yy"), ("z" + "q" * 300_000, "zz")]
    found = li.profiles(spark.createDataFrame(rows, "text string, lang string"))
    for text, lang in rows:
        grams, n = np.unique(li.grams(text), return_counts=True)
        assert found[lang] == [int(g) for _, g in sorted(zip((-n).tolist(), grams.tolist()))][: li.PROFILE]
