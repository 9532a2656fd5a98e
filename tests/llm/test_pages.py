from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from texts import prose

from segue.llm import pages as pg
from segue.llm.pages import Page


def text_of(html, gone=()):
    page = Page(html, "h")
    page.keyed()
    return page.main_text(set(gone))[0]


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<br>b  \n c<p>d<b>e<p>f</b>g", "a b c\nde\nfg"),
        ("<div>x<p>y</div>z", "x\ny\nz"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", "a\nb\nc\nd"),
        ("<head><title>t</title><body>b", "b"),
        ("<script>var t='</p>';</script><style>p{}</style>x<!-- c > --> y<!-->z", "x yz"),
        ("<script>never closed <p>x", ""),
        ("<title>a</titles>b</title>c", "c"),
        ("a<p title='x>y' data-q=\"'\">b<p don't>c", "a\nb\nc"),
        ("&lt;p&gt; &#233;&eacute;&copy &am &unknown; &amp;amp;", "<p> éé© &am &unknown; &amp;"),
        ("x<p>y</p", "x\ny"),
        ("x<p class='unclosed>y</p>z", "x"),
        ("1 < 2 and 3 > 2 <3 </ x> <?php ?> y", "1 < 2 and 3 > 2 <3 y"),
        ("<nav>m</nav><header>h</header><article><header><h1>T</h1></header><p>a</p><footer>f</footer></article><footer>f</footer>", "T\na"),
        ("<div class='sideBar x'>s</div><div id=comments>c</div><div role=search>r</div><form>q<p>w</form><p>a", "a"),
        ("<body class='has-sidebar'><main><p>a</main><p>outside", "a"),
        ("<article><p>a<div class='cookie-notice'>n</div><aside>s</aside><section class=comments><article>c</article></section></article>", "a"),
        ("<select><option>a<option>b</select><button>c</button><textarea><p>d</textarea><noscript>e</noscript>f", "f"),
        ("<a href=/x>l</a> m <a>n<p>o</a>p", "l m n\nop"),
        ("</div></p>a</article><p>b", "a\nb"),
        ("<p>  a b\x0c </p>", "a b"),
    ],
)
def test_blocks(html, text):
    assert text_of(html) == text


def test_deep_and_long_pages():
    assert text_of("<div>" * 30_000 + "x" + "</div>" * 30_000 + "<p>y") == "x\ny"
    assert text_of("<b>" * 20_000 + "x" + "<p>y" * 3) == "x\ny\ny\ny"
    assert text_of("<div>" * 300 + "<script>a</script>b<select>c</select>" + "</div>" * 300 + "d") == "b\nd"
    assert len(text_of("<p>word " * 100_000).split("\n")) == 100_000


def site(rng, n):
    """Pages of a host that names nothing: a bar and links that differ, articles that share a passage, a page with a bar of its own."""
    pool = [f"<a href=/{i}>{prose(rng, 2)}</a> " for i in range(6)]
    shared = prose(rng, 60)
    out = []
    for i in range(n):
        own = [prose(rng, 30) for _ in range(3)] + [shared] * (i % 5 == 0)
        html = f"<body><div class=top><span>Site</span> name</div><div class=z>{rng.choice(pool)}{rng.choice(pool)}</div><div class=body>" + "".join(f"<p>{x}</p>" for x in own) + "</div><div class=end>All rights</div>"
        out.append((html, "\n".join(own)))
    return out


def test_what_a_site_repeats_goes(spark):
    rng = random.Random(4)
    found = site(rng, 40)
    rows = [(i, f"http://A.example/{i}", html) for i, (html, _) in enumerate(found)] + [(100, "http://b.example/", found[0][0])]
    got = {r["page_id"]: r for r in pg.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i]["text"] == text and got[i]["n_chars"] == len(text) for i, (_, text) in enumerate(found))
    assert got[100]["text"].startswith("Site name\n") and got[100]["blocks_repeated"] == 0  # a host with one page shows no template
    assert got[0]["blocks_repeated"] == 3 and got[0]["blocks_named"] == 0


def test_templates_by_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        host = rng.choice("ab")
        parts = [rng.choice(["<div>x</div>", "<div>y</div>", "<ul><li><a>l</a></ul>", f"<ul><li><a>l{rng.randrange(9)}</a></ul>", f"<p>{rng.randrange(9)}</p>", "<article><p>q<p>r</article>"]) for _ in range(rng.randrange(1, 5))]
        rows.append((i, host, "".join(parts)))
    df = spark.createDataFrame(rows, "own long, host string, html string")
    got = {r["key"] % (1 << 64) for r in pg.templates(pg.elements(df)).collect()}
    size, counts, kind = Counter(h for _, h, _ in rows), Counter(), {}
    for _, host, html in rows:
        keys = {}
        for e in Page(html, host).keyed():
            keys.setdefault((host, e.slot, e.hash), (e.main, 2 * e.linked >= e.text))
        counts.update(keys.keys())
        for k, (main, links) in keys.items():
            kind[k] = tuple(a or b for a, b in zip(kind.get(k, (False, False)), (main, links)))
    want, slots = set(), defaultdict(list)
    for (host, slot, key), n in counts.items():
        main, links = kind[host, slot, key]
        if n >= pg.LEAST_PAGES and n >= (pg.MAIN_SHARE if main else pg.SHARE) * size[host]:
            want.add(key)
        if not main:
            slots[slot].append((n, links))
    want |= {s for s, x in slots.items() if sum(n for n, _ in x) >= pg.LEAST_PAGES and sum(n for n, _ in x if n > 1) >= pg.SLOT_SHARE * sum(n for n, _ in x) and 2 * sum(n for n, links in x if links) >= sum(n for n, _ in x)}
    assert got == want and want


def test_copies_of_an_article_stay(spark):
    html = "<nav>m</nav><article><h1>T</h1><p>Of.</p></article>"
    rows = [(i, "http://h/", html) for i in range(9)] + [(50 + i, "http://h/", f"<nav>m</nav><article><p>{i}</article>") for i in range(9)]
    got = pg.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == ("T\nOf." if r["page_id"] < 50 else str(r["page_id"] - 50)) for r in got)


def test_odd_rows(spark):
    rows = [(1, None, "<p>a"), (None, "http://x", "<p>b"), (2, "no host", None), (3, "http://x", ""), (3, "http://x", ""), (4, "://Y:80?q", "<p>c")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, own string, host int")
    got = pg.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars", "blocks_repeated", "blocks_named"]
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got.collect()) == [("1", "a", 1), ("2", "", 0), ("3", "", 0), ("3", "", 0), ("4", "c", 1), ("None", "b", 1)]
    assert [r["h"] for r in df.select(pg.host_of("url").alias("h")).collect()] == ["", "x", "", "x", "x", "y:80"]
    assert pg.extract(df.where("false")).count() == 0
