from __future__ import annotations

import duckdb
import pandas as pd
from compare import rows_of

from segue.llm import url_filter as uf

URLS = [
    "https://WWW.Example.COM/en/a?x#y", "http://example.com/en/", "http://a.example.com/en/1", "http://notexample.com/en/1", "http://example.com", "http://example.com?/en/", "x://net/es/1", "x://a.net/fr", "x://a.net/fr/",
    "no scheme", "", None, "://com/", "http://É.com/É/a b", "http://a.b.com/1/2/3/4/5", "http://a.net/de/1", "http://a.net/de/1", "http://user@h.org:80/x",
]


def both(spark, urls):
    rows = list(enumerate(urls))
    got = uf.judged(spark.createDataFrame(rows, "page_id long, url string")).toPandas()
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url"]).astype({"url": "object"}))
    return got, con.execute(uf.oracle()).fetch_df()


def test_hosts_paths_and_rules(spark):
    got, want = both(spark, URLS)
    assert rows_of(got) == rows_of(want)
    rule = {r.page_id: r.rule for r in got.itertuples()}
    none = lambda i: rule[i] is None or rule[i] != rule[i]
    assert [rule[i] for i in (0, 1, 2, 3, 6, 8, 12)] == ["www.example.com/en/", "example.com/en/", "example.com/en/", "com/", "net/es/", "net/fr/", "com/"]
    assert all(none(i) for i in (4, 5, 7, 9, 10, 11, 15)) and got[got.page_id == 0].host.item() == "www.example.com"


def test_branches_are_merged_and_templates_rejected(spark):
    letters = "abcdefghij"
    urls = [f"http://h.net/{lang}/{i}" for lang in ("es", "fr", "en", "de") for i in range(30)] + [f"http://h.net/about/{'xyz'[i % 3]}/q" for i in range(30)]
    urls += [f"http://example.com/{lang}/{i}" for lang in ("en", "de", "fr") for i in range(20)] + ["http://k.net/x", "http://n.org/x", "http://k.net/"]
    urls += [f"http://h.com/{a}{b}{c}/p" for a in letters for b in letters for c in "ab"]
    got, want = both(spark, urls)
    assert rows_of(got) == rows_of(want)
    row = {u: r for u, r in zip(urls, got.sort_values("page_id").itertuples())}
    # branches that no rule fits are judged with those that are like them, and others by the nodes above
    assert {row[f"http://h.net/{lang}/3"].template for lang in ("es", "fr", "en", "de")} == {"*de/{n}"}
    assert row["http://h.net/en/3"].verdict == "block" and row["http://h.net/en/3"].rule is None and row["http://h.net/en/3"].purity > 0.9
    assert row["http://h.net/about/x/q"].verdict == row["http://k.net/x"].verdict == "block" and row["http://n.org/x"].verdict == "allow"
    # labels that differ keep branches of one profile apart; a node with many branches has a wildcard
    assert (row["http://example.com/de/3"].template, row["http://example.com/en/3"].template) == ("*de/{n}", "en/{n}")
    assert row["http://h.com/aaa/p"].template == "*/p"


def test_whole_paths_and_deep_trees(spark):
    deep = "/".join("abcdefghijklmnop")
    urls = [f"http://a.net/{deep}/{i}" for i in range(5)] + [f"http://a.net/es/{deep}/{i}" for i in range(5)] + [f"http://b.net/{i % 7}x/{'yz'[i % 2]}" for i in range(40)]
    got, want = both(spark, urls)
    assert rows_of(got) == rows_of(want)
    assert f"{deep}/{{n}}" in set(got.template) and f"es/{deep}/{{n}}" in set(got.template)


def test_no_pages(spark):
    assert uf.judged(spark.createDataFrame([], "page_id long, url string, host string")).count() == 0
