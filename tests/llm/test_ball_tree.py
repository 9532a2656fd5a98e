from __future__ import annotations

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from compare import rows_of

from segue.llm import ball_tree as bt

DOCS, ITEMS = "doc_id long, text string, extra int", "item_id long, text string"


def wanted(rows, items, k):
    con = duckdb.connect()
    frame = lambda x, c: pd.DataFrame([r[:2] for r in x], columns=c).astype({c[0]: "Int64", "text": "object"})
    con.register("documents", frame(rows, ["doc_id", "text"]))
    con.register("benchmark", frame(items, ["item_id", "text"]))
    return rows_of(con.execute(bt.ORACLE.replace(f"rank <= {bt.FIRST}", f"rank <= {k}")).fetch_df())


def text(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(1)
    tongues = [[f"{t}{'éaß'[i % 3]}{i}" for i in range(150)] for t in ("Ab", "cd", "ef")]
    rows = [(i, text(rng, rng.choice(tongues), rng.randrange(1, 80)), 0) for i in range(700)]
    rows += [(1000 + i, rows[5][1], 0) for i in range(80)] + [(3, "cda0", 1), (None, "Abé0 " * 9, 1), (2000, None, 1), (2001, "", 1), (2002, " -- ", 1), (2003, text(rng, tongues[0], 20_000), 1)]
    items = [(i, text(rng, rng.choice(tongues), rng.randrange(1, 12))) for i in range(25)] + [(4, "abÉ0 ABé0"), (90, rows[5][1]), (90, rows[5][1]), (91, None), (92, "..."), (93, "nowhere"), (None, rows[9][1])]
    return rows, items


@pytest.mark.parametrize("item_terms", [1 << 18, 250])
def test_equal_to_its_sql(spark, tables, monkeypatch, item_terms):
    rows, items = tables
    got = bt.ranked(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, ITEMS), 7, item_terms=item_terms).toPandas()
    assert rows_of(got) == wanted(rows, items, 7)


def test_odd_rows(spark, odd, none):
    items = odd.selectExpr("doc_id AS item_id", "text")
    got = bt.ranked(odd, items, 3).toPandas()
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert rows_of(got) == wanted(rows, rows, 3)
    assert bt.ranked(none, items).count() == 0 and bt.ranked(odd, items.where("false")).count() == 0


def subtrees(vectors, layout, group_count):
    ends = np.concatenate([[0], np.cumsum([len(t) for t, _ in vectors])])
    terms, parts = (np.concatenate([v[i] for v in vectors]) for i in (0, 1))
    tree = bt.Tree(ends, terms, parts, layout.group)
    return tree, *tree.balls(layout.group, group_count)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    vectors = []
    for i in range(400):
        terms = np.sort(rng.choice(np.arange(100) + 100 * (i % 4), 12, replace=False))
        vectors.append((terms, rng.integers(1, 1_000_000, 12)))
    layout = bt.Layout(vectors, 400, 4)
    tree, centres, radii = subtrees(vectors, layout, layout.groups)
    dense = np.zeros((400, 400))
    for i, (t, v) in enumerate(vectors):
        dense[i, t] = v
    nodes = len(tree.nodes)
    assert sorted(tree.order.tolist()) == list(range(400)) and nodes == 31 and max(hi - lo for lo, hi in tree.nodes[15:]) <= bt.LEAF
    pruned = 0
    for i in range(40):
        query = np.zeros(400)
        query[rng.choice(np.arange(100) + 100 * (i % 4), 10, replace=False)] = rng.integers(1, 9000, 10)
        norms = np.array([np.sqrt((query[layout.group == g] ** 2).sum()) for g in range(layout.groups)])
        bounds = centres @ query[tree.used] + radii @ norms
        scores = dense @ query
        for (lo, hi), bound in zip(tree.nodes, bounds):
            assert scores[tree.order[lo:hi]].max() <= bound + 1
        pruned += sum(bound < np.sort(scores)[-5] for bound in bounds[15:])
    assert pruned > 40 * 16 / 4  # the leaves of other tongues at least


def test_few_documents_are_scored(spark, tables):
    rows, items = tables
    own = bt.Items([t for _, t in items])
    context = spark.sparkContext
    vectors = bt.vectors(spark.createDataFrame(rows, DOCS), context.broadcast(own.hashes), "doc_id", "text")
    corpus = bt.statistics(vectors, own.hashes.size)
    sample = [(np.array(r["terms"]), corpus.parts(np.full(len(r["terms"]), r["n"]), np.array(r["times"]))) for r in vectors.where("size(terms) > 0").collect()]
    layout = bt.Layout(sample, own.hashes.size, 8)
    built = bt.index(vectors, context.broadcast(corpus), context.broadcast(layout))
    read = bt._search(built, bt.Asked(own, corpus, layout, 50), layout.groups).toPandas()
    assert 0 < read["read"].sum() < 0.6 * len(items) * len(rows)


def test_large_weights_are_exact():
    items = bt.Items(["a b", "a"])
    corpus = bt.Corpus(3, 9, np.array([1, 1]))
    corpus.weights = np.array([2**33, 5], np.int64)
    asked = bt.Asked(items, corpus, bt.Layout([], 2, 4), 2)
    assert asked.kind is np.int64
    search = bt.Search(asked, 1)
    ends, terms, parts = np.array([0, 2, 3]), np.array([0, 1, 0]), np.array([999_999, 3, 999_999])
    tree = bt.Tree(ends, terms, parts, np.zeros(2, np.int32))
    centres, radii = tree.balls(np.zeros(2, np.int32), 1)
    node, column = np.nonzero(centres)
    picked = np.concatenate([np.arange(ends[d], ends[d + 1]) for d in tree.order])
    sizes = np.diff(ends)[tree.order]
    search.subtree(np.array([7, 8])[tree.order], np.concatenate([[0], np.cumsum(sizes)]), terms[picked], parts[picked], np.searchsorted(node, np.arange(len(tree.nodes) + 1)), tree.used[column], centres[node, column], radii.ravel())
    assert sorted(search.best[0]) == [(2**33 * 999_999, -8), (2**33 * 999_999 + 15, -7)]
