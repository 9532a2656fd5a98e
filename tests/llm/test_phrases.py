from __future__ import annotations

import random

import duckdb
import pandas as pd
import pytest
from compare import rows_of

from segue.llm import phrases

SCHEMA = "doc_id long, text string, lang string"


def both(spark, rows, least, **more):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = phrases.collocations(docs, least=least, **more).toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang"]).astype({"text": "object", "lang": "object"}))
    sql = phrases.ORACLE.replace(f"f >= {phrases.LEAST}", f"f >= {least}")
    return rows_of(got), rows_of(con.execute(sql).fetch_df())


def texts(rng, n):
    fixed = ["A b C d e f g h", "x  y\tz q", "one two three four five six, seven"]
    out = []
    for i in range(n):
        words = []
        while len(words) < rng.randrange(1, 60):
            words += rng.choice(fixed).split(" ") if rng.random() < 0.3 else [rng.choice("abcdefgé") * rng.randrange(1, 3) + rng.choice(["", "", ".", ",", "\n", "\r\n", " ", "\t"])]
        out.append((i, " ".join(words), rng.choice(["en", "de", None, "und"])))
    return out


@pytest.mark.parametrize("least", [3, 10])
def test_equal_to_its_sql(spark, least):
    got, want = both(spark, texts(random.Random(least), 120), least)
    assert got == want and len(got) > 20


def test_few_counters_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SEGMENT", 3)
    got, want = both(spark, texts(random.Random(1), 80), 4, buckets=64)
    assert got == want and got


def test_counts_of_shorter_runs_follow_from_the_edges(spark):
    rows = texts(random.Random(2), 60)
    of = phrases.counts(spark.createDataFrame(rows, SCHEMA), least=1)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want: dict = {}
    for _, text, lang in rows:
        for c in ".,;:!?\r\x0b\x0c":
            text = text.replace(c, "\n")
        for piece in text.translate(low).split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    key = (lang or "und", " ".join(w[i : i + k]))
                    want[key] = want.get(key, 0) + 1
    got = {(r["lang"], r["gram"]): r["n"] for k in of for r in of[k].collect()}
    assert got == want


def test_paths_are_compacted(spark):
    docs = spark.createDataFrame([(i, f"w{i} " + " ".join(f"p{j}" for j in range(40)) + f" v{i}", "en") for i in range(5)], SCHEMA)
    of = phrases.counts(docs, least=5)
    often = {k: of[k].where("n >= 5") for k in of}
    found = phrases.paths(often[5], often[4]).collect()
    assert [len(r["words"]) for r in found] == [40] and found[0]["words"][:2] == ["p0", "p1"] and found[0]["n"] == 5
    assert phrases.candidates(of, 5).count() == 36  # whatever is shorter lies in the path


def test_odd_rows(spark, odd, none):
    assert phrases.collocations(none).count() == 0
    rows = [(r["doc_id"], r["text"] and r["text"][:4000], r["lang"]) for r in odd.collect()] * 2 + [(9, "\x00a \x1fb " * 9, "en")]
    got, want = both(spark, rows, 2)
    assert got == want and got
    assert phrases.collocations(odd.where("doc_id = 6"), least=2).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
