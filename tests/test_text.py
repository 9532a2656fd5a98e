from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from segue.functions import text as fx
from segue.functions.vectors import learning_rate, normalized, pair_loss, sigmoid

#: Input, normalize_text, split_artists, whether the native form agrees with the full one.
CASES = [
    ("Beyoncé", "beyonc", ["beyonc"], True), ("Don’t Stop", "don t stop", ["don t stop"], True), ("Straße", "strasse", ["strasse"], True), ("Ёлка", "елка", ["елка"], True),
    ("AC/DC", "ac dc", ["ac", "dc"], True), ("Tyler, The Creator", "tyler the creator", ["the creator", "tyler"], True), ("A feat. B", "a feat b", ["a", "b"], True),
    ("A Feat. B feat C", "a feat b feat c", ["a", "b", "c"], True), ("A x B", "a x b", ["a", "b"], True), ("Axl", "axl", ["axl"], True), ("Холостяк", "холостяк", ["олостяк"], True),
    ("Баста х Смоки", "баста х смоки", ["баста", "смоки"], True), ("日本", "", [], True), ("ﬁre", "fire", ["fire"], False), ("１２３", "123", ["123"], False), ("½ moon", "1 2 moon", ["1 2 moon"], False), ("", "", [], True),
]


def test_normalised_texts_and_artists(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)] + [(99, None)], "i int, t string")
    rows = {r["i"]: r for r in df.select("i", fx.normalize_text("t").alias("n"), fx.normalize_text_full("t").alias("f"), fx.split_artists("t").alias("a"), fx.text_key("t").alias("k"), fx.artists_key("t").alias("ka")).collect()}
    for i, (_, norm, artists, agrees) in enumerate(CASES):
        assert rows[i]["f"] == norm == fx.folded(CASES[i][0]) == rows[i]["k"]
        assert rows[i]["ka"] == artists
        if agrees:
            assert rows[i]["n"] == norm and rows[i]["a"] == artists
    assert rows[99]["n"] == rows[99]["k"] == "" and rows[99]["a"] == rows[99]["ka"] == []


def test_plain_text_is_normalised_exactly(spark):
    """Every character that keys treat natively, by itself and between letters, as the full form has it."""
    import re

    plain = [chr(c) for c in range(0x3000) if re.match(fx.PLAIN, chr(c))]
    df = spark.createDataFrame([(c,) for c in plain] + [(f"a{c}b",) for c in plain], "t string")
    wrong = [r["t"] for r in df.select("t", fx.normalize_text("t").alias("n")).collect() if r["n"] != fx.folded(r["t"])]
    assert len(plain) > 400 and wrong == []


def test_keys_compose_accents(spark):
    df = spark.createDataFrame([("Cafe\u0301", "Sigur Ro\u0301s feat. \ufb01re")], "t string, a string")
    row = df.select(fx.text_key("t").alias("k"), fx.artists_key("a").alias("a"), fx.component(F.lit(0.12349)).alias("c")).first()
    assert row["k"] == fx.folded("Café") == "caf" and row["a"] == ["fire", "sigur r s"] and row["c"] == "0.123"


def test_canonical_titles_of_any_letters(spark):
    df = spark.createDataFrame([("\ufb01re (Live)", "fire"), ("Cafe\u0301 - Remix", "caf"), ("Café", "caf"), ("\uff11\uff12\uff13 Demo", "123"), ("½ Moon (Radio Edit)", "1 2 moon")], "t string, want string")
    assert [r["c"] for r in df.select(fx.canonical_title("t").alias("c")).collect()] == [r["want"] for r in df.collect()]


def test_canonical_titles_lines_and_formats(spark):
    df = spark.createDataFrame([("Song (Live) - Remastered Version", "a - b - c", 3723), ("Live", "only title", 61), (None, "x - ", 5)], "t string, line string, s int")
    artist, title = fx.split_line("line")
    rows = df.select(fx.canonical_title("t").alias("c"), artist.alias("a"), title.alias("b"), fx.duration_text("s").alias("d")).collect()
    assert [tuple(r) for r in rows] == [("song", "a", "b - c", "1h 2m 3s"), ("", "", "only title", "1m 1s"), ("", "x", "", "5s")]
    assert df.select(fx.has_cyrillic("t", F.lit("ё")).alias("x")).first()["x"]


@pytest.mark.parametrize(("artist", "title", "score"), [("nirvana", "x", 100), ("nirvana band", "x", 92), ("x", "nirvana live", 88), ("the nirvana", "x", 82), ("x", "my nirvana", 78), ("", "", 0), (None, None, 0)])
def test_search_ladder(spark, artist, title, score):
    df = spark.createDataFrame([(artist, title)], "a string, t string").fillna("")
    assert df.select(fx.search_score("nirvana", "a", "t").alias("s")).first()["s"] == score


def test_search_ladder_of_two_words(spark):
    df = spark.createDataFrame([("a nir", "vana b", 70), ("vana", "nir", 60), ("nir x", "q", 11), ("q", "q", 0)], "a string, t string, s int")
    assert all(r["x"] == r["s"] for r in df.select("s", fx.search_score("nir vana", "a", "t").alias("x")).collect())


def test_arithmetic(spark):
    df = spark.createDataFrame([([3.0, 4.0], 800.0), ([0.0, 0.0], -800.0)], "v array<double>, x double")
    rows = df.select(normalized(F.col("v")).alias("n"), sigmoid(F.col("x")).alias("s"), pair_loss(F.lit(1.0), F.lit(1)).alias("l")).collect()
    assert rows[0]["n"] == [0.6, 0.8] and rows[1]["n"] == [0.0, 0.0] and (rows[0]["s"], rows[1]["s"]) == (1.0, 0.0) and abs(rows[0]["l"]) < 1e-6
    assert learning_rate(0.025, 0, 4) == 0.025 and abs(learning_rate(0.025, 4, 4) - 0.00625) < 1e-12
