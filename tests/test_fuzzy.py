from __future__ import annotations

import random

import pytest

from segue.operators import fuzzy


def grams(t):
    return {t[i : i + 3] for i in range(max(1, len(t) - 2))}


def tables(spark, rng, n):
    word = lambda: "".join(rng.choice("abcdeо") for _ in range(rng.randrange(1, 7)))
    words = [word() for _ in range(40)]
    right = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))) for i in range(n)] + [(n, ""), (n + 1, "a")]
    left = []
    for i, (_, t) in enumerate(right):
        cut = rng.randrange(len(t) + 1)
        left.append((i, (t[:cut] + rng.choice(["", "x", "ab"]) + t[cut + 1 :]).strip()))
    frame = lambda rows: spark.createDataFrame(rows, "ord long, title_key string")
    return left, right, frame(left), frame(right)


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 1.0])
def test_all_pairs_and_no_more(spark, least):
    left, right, a, b = tables(spark, random.Random(int(least * 10)), 250)
    want = {}
    for x in {t for _, t in left if t}:
        for y in {t for _, t in right if t}:
            p = len(grams(x) & grams(y)) / len(grams(x) | grams(y))
            if p >= least:
                want[x, y] = round(p, 9)
    rows = fuzzy.similar_titles(a, b, least).collect()
    assert {(r["left_title"], r["right_title"]): round(r["similarity"], 9) for r in rows} == want and len(rows) == len(want)


def test_few_titles_meet(spark):
    """Of all pairs of distinct titles, those that meet by a trigram and a length are few."""
    _, _, a, b = tables(spark, random.Random(3), 1500)
    titles = [fuzzy.distinct_titles(x) for x in (a, b)]
    order = fuzzy.gram_counts(*titles)
    met = fuzzy.meetings(*[fuzzy.fuzzy_index(t, order, 0.7) for t in titles], 0.7)
    assert fuzzy.similar_titles(a, b, 0.7).count() <= met.count() < 0.05 * titles[0].count() * titles[1].count()
    with pytest.raises(ValueError):
        fuzzy.similar_titles(a, b, 0.0)
