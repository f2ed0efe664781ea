"""Main text extraction: what the template pass removes, against a brute-force count; what class names may not remove."""

import collections

import pytest
from pyspark.sql import functions as F

from lumenfold.llm import html_text

SCHEMA = "page_id long, url string, html string"


def site(host, n, start):
    """Pages whose menu and tail are plain, unmarked boxes; the tail stands on every third page only."""
    rows = []
    for i in range(n):
        menu = "".join(f"<div><span>{host} part {k}</span></div>" for k in range(3))
        tail = f"<div><div>Made by {host}</div><div>All rights</div></div>" if i % 3 == 0 else ""
        body = f"<div>{menu}</div><div><h1>Story {host} {i}</h1><p>Text {i} of {host}.</p><div>Shared remark {i // 2}.</div></div>{tail}"
        rows.append((start + i, f"https://{host}/{i}?x", f"<html><body>{body}</body></html>"))
    return rows


def brute(rows):
    """Template hashes per host by counting page names in Python."""
    pages = collections.defaultdict(set)
    for _, url, page in rows:
        p = html_text.Page(page)
        for h in p.containers():
            pages[(url.split("/")[2] if url else "", h)].add(p.name)
    return {k for k, names in pages.items() if len(names) >= html_text.MIN_PAGES}


@pytest.fixture(scope="module")
def rows():
    return site("a.org", 12, 0) + site("b.org", 15, 100) + site("c.org", 9, 200)


def test_unmarked_templates_of_three_hosts_go(spark, rows):
    found = brute(rows)
    assert len({h for h, _ in found}) == 3
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    for page_id, url, page in rows:
        host = url.split("/")[2]
        assert got[page_id] == html_text.extract(page, {h for x, h in found if x == host})
        assert "part" not in got[page_id] and "Story" in got[page_id] and "Shared remark" in got[page_id]
        assert ("Made by" in got[page_id]) == (host == "c.org" and page_id % 3 == 2 and page_id % 100 % 3 == 0)
    keyed = spark.createDataFrame(rows, SCHEMA).select("page_id", "url", "html", html_text.host().alias("_host"), F.col("page_id").alias("_k1"), F.lit(0).cast("long").alias("_k2"))
    hosts = {i: u.split("/")[2] for i, u, _ in rows}
    assert {(hosts[r._k1], r.hash) for r in html_text.template_subtrees(keyed).collect()} == found


def test_copies_of_an_article_are_no_template(spark):
    page = "<body><div><h1>One story</h1></div><div><div>First half {}</div><div>Second half</div></div></body>"
    rows = [(i, "http://a.org/", page.format(i)) for i in range(9)]
    got = html_text.main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all("Second half" in r.text for r in got)


def test_class_names_leave_the_article_alone():
    keep = [
        "<main class='has-sidebar'><p>all</p></main>",
        "<div id='content' class='no-sidebar'><h1>t</h1><p>all</p></div>",
        "<article class='post no-comments'><p>all</p></article>",
        "<article><p class='notice'>all</p><p><span class='comment'>of it</span></p></article>",
        "<article><section class='related-work'><p>all</p></section><div class='side-effects'>more</div></article>",
        "<form id='aspnet'><article><p>all</p></article></form>",
    ]
    for page in keep:
        assert "all" in html_text.extract(page) and html_text.extract(page).count("\n\n") == page.count("</p>") + page.count("</div>") + page.count("</h1>") - 1 - page.count("id='content'")
    gone = "<div class='site-sidebar'>x</div><div role='navigation'>x</div><ul class='comments-list'><li>x</ul><div class='ad top'>x</div><aside>x</aside><form>x</form><header>x</header><footer>x</footer>"
    assert html_text.extract(f"<body>{gone}<article><p>all of the text</p></article>{gone}</body>") == "all of the text"


def test_little_articles_do_not_hide_the_rest():
    assert html_text.extract("<article>card</article><p>the main text of this page stands outside of it</p>").startswith("card\n\nthe main")


def test_odd_pages_and_clashing_columns(spark):
    rows = [(1, None, None, "a"), (1, None, None, "b"), (None, "", "", None), (2, "no host", "<p>x", "c"), (3, "http://a/", "<div>" * 3000 + "deep", "d"), (4, "http://a/", "w " * 200_000, "e")]
    df = spark.createDataFrame(rows, f"{SCHEMA}, _k1 string").withColumns({c: F.lit("z") for c in ("blocks", "template", "hash", "_host", "text", "live")})
    got = [(r.page_id, r.text) for r in html_text.main_text(df).collect()]
    assert sorted(got, key=str) == sorted([(1, ""), (1, ""), (None, ""), (2, "x"), (3, "deep"), (4, " ".join(["w"] * 200_000))], key=str)
    assert html_text.main_text(df.limit(0)).count() == 0
