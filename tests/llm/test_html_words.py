"""Class words never take a page's article away; they only tell chrome beside it."""

import pytest

from hearthledger.llm.html_extraction import extract, infer

ARTICLE = "<article><h1>A title</h1><p>The first paragraph of the story goes on for a while.</p><p>And so does the second one, with more words.</p></article>"
TEXT = "A title The first paragraph of the story goes on for a while. And so does the second one, with more words."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body class='post has-sidebar'>{ARTICLE}</body></html>",
        f"<html><body class='sidebar'>{ARTICLE}</body></html>",
        f"<body><div id='page' class='site has-header-image'>{ARTICLE}<div class='sidebar'>Elsewhere</div></div></body>",
        f"<body><main><div class='content no-sidebar'>{ARTICLE}</div></main></body>",
        f"<body><div class='sidebar'>{ARTICLE}</div><div class='sidebar'>More to read</div></body>",
        f"<body><div class='site-header'>Our site</div>{ARTICLE}<section class='comments-area'><p>Nice one, thanks!</p></section></body>",
        ARTICLE.replace("<h1>A title</h1>", "<header class='entry-header'><h1>A title</h1></header>"),
        ARTICLE.replace("<h1>", "<h1 class='widget-title'>"),
        ARTICLE.replace("<p>And", "<section id='related-work'><p>And").replace("</p></article>", "</p></section></article>"),
        ARTICLE.replace("<p>And", "<div class='social-science'><p>And").replace("</p></article>", "</p></div></article>"),
        ARTICLE.replace("<p>And", "<p id='search-methods'>And"),
        ARTICLE.replace("</article>", "<div class='ad-slot'>Buy now</div><div class='related posts'>Next story</div></article>"),
        ARTICLE.replace("</article>", "<div class='share-buttons'>Tell a friend</div><div id='comments'><p>First!</p></div></article>"),
    ],
)
def test_the_article_stays_whole(page):
    assert extract(page, infer([page])) == TEXT
    many = [page.replace("A title", f"A title {i}").replace("story", f"story {i}") for i in "abcdefgh"]
    wrapper = infer(many)
    assert [extract(x, wrapper) for x in many] == [TEXT.replace("A title", f"A title {i}").replace("story", f"story {i}") for i in "abcdefgh"]


def test_a_part_of_most_text_is_not_barred_by_its_class():
    page = "<body><div class='widget'><p>" + "The whole story stands in a widget, for some reason. " * 5 + "</p></div><div class='menu'>Home About</div></body>"
    assert extract(page, infer([page])).startswith("The whole story") and "Home" not in extract(page, infer([page]))


def test_hosts_fold_alike_however_pages_are_dealt(spark):
    from hearthledger.llm import html_extraction

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    fan, html_extraction.FAN = html_extraction.FAN, 2
    try:
        a, b = ({r["page_id"]: r["text"] for r in html_extraction.extract_text(pages.repartition(n)).collect()} for n in (1, 7))
    finally:
        html_extraction.FAN = fan
    assert a == b and sum(map(len, a.values())) > 0
    assert a == {r["page_id"]: r["text"] for r in html_extraction.extract_text(pages).collect()}
