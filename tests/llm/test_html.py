from graphloom.llm.html import extract, main_text

ARTICLE = "<p>First, a <b>long</b> paragraph of the article, with commas, and <a href='/x'>one link</a> in it.</p><p>Second&nbsp;paragraph &amp; more,\n\t spread over   lines, all of it.</p>"
WANT = "First, a long paragraph of the article, with commas, and one link in it.\nSecond paragraph & more, spread over lines, all of it."


def test_plain_article_and_furniture():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
    <header><p>Site name, slogan, words, and more, words</p></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies, and, so, on.</p></div><!-- <p>no</p> -->
    <div id="main"><article><h1>Title</h1>{ARTICLE}<form><p>Sign up, now, here</p></form></article></div>
    <aside class=x><p>Other, things, to, read, here, today, and, tomorrow</p></aside>
    <div class="ad">Buy, this, thing, now, and, more, and, more, and, more</div>
    <section id="comments"><p>Great, article, I, liked, it, a, lot, indeed, very, much</p></section>
    <footer>&copy; me</footer></body></html>"""
    assert main_text(page) == "Title\n" + WANT


def test_container_without_article_element():
    page = f"<body><div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><h1>Title</h1><div class=content>{ARTICLE}</div><div class='reader comments'><p>no, no, no</p></div></body>"
    assert main_text(page) == "Title\n" + WANT


def test_sections_are_siblings():
    page = f"<body><main><section>{ARTICLE}</section><section>{ARTICLE}</section></main></body>"
    assert main_text(page) == WANT + "\n" + WANT


def test_misnesting_and_truncation():
    assert main_text("<article><h1>H</h1><p><b>a b.<br><p>c d.</p><p>e") == "H\na b.\nc d.\ne"
    assert main_text("<div><p>one, two<div>three</div>") == "one, two\nthree"
    assert main_text("<ul><li>a<li>b") == "a\nb"
    assert main_text('<p title="a>b">x</p>') == "x"
    assert main_text("a < b and c") == "a < b and c"
    assert main_text("<p>x<script>never closed") == "x"


LONG = "This is a long sentence of the article, with commas, clauses, and enough words to count as text. " * 3


def test_names_that_only_contain_a_furniture_word():
    want = LONG.strip()
    for wrapper in ('class="no-sidebar"', 'class="social-policy"', 'class="story-with-comments"', 'id="page" class="site has-sidebar"', 'class="left-sidebar"', 'class="adventure headers-and-footers"', 'id="commentary"', 'class="entry-header-wide"'):
        assert main_text(f"<body><div {wrapper}><p>{LONG}</p></div></body>") == want
        assert main_text(f"<body><div {wrapper}><article><p>{LONG}</p></article></div><div class=sidebar><p>{LONG}</p></div></body>") == want
    assert main_text(f'<article><div class="entry-header"><h1>Title</h1></div><p>{LONG}</p></article>') == "Title\n" + want
    assert main_text(f'<article><div class="header"><h1>Title</h1></div><p>{LONG}</p></article>') == "Title\n" + want


def test_links_inside_an_article_stay():
    page = f"<article><p>{LONG}</p><ul><li><a href=1>First source</a><li><a href=2>Second source</a><li><a href=3>Third source</a></ul></article>"
    assert main_text(page) == LONG.strip() + "\nFirst source\nSecond source\nThird source"


def test_names_of_furniture():
    names = "comments comment-list reader-comments commentsSection cookie-notice site-footer footer__inner main-nav navBar top-menu sidebar sidebar-left right-sidebar ad ad-slot ad-300x250 advert-box newsletter-signup social-share share-buttons related-posts related-articles breadcrumbs site-header skip-link widget-area subscribe-form promo-box login-form article-comments".split()
    for name in names:
        for kind in ("class", "id"):
            assert main_text(f"<body><div {kind}='{name}'><p>{LONG}</p></div><article><p>Short text.</p></article></body>") == "Short text."
            assert main_text(f"<body><div><p>{LONG}{LONG}</p></div><div {kind}={name}><p>Not this, not, this, either.</p></div></body>") == f"{LONG}{LONG}".strip()


def test_comments_that_are_articles():
    page = f"<body><div class=post><article><p>{LONG}</p></article><ol class='comment-list'><li><article class='comment-body'><p>{LONG} {LONG}</p></article></ol></div></body>"
    assert main_text(page) == LONG.strip()


def test_odd_inputs():
    assert main_text(None) == main_text("") == main_text("<html>") == main_text("<p> \n </p>") == ""
    assert len(main_text("<div>" * 20000 + "x")) == 1
    assert main_text("<article>" + "<p>word, word</p>" * 50000 + "</article>").count("\n") == 49999


def test_every_page_of_the_table_keeps_its_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in extract(pages).collect()}
    for p in pages.collect():
        body = p.html[p.html.index("<article>") + 9 : p.html.index("</article>")]
        import html
        import re

        parts = re.split(r"</?(?:p|h1)>", body)
        want = "\n".join(t for x in parts if (t := " ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split())))
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, None, None, "t"), (None, "u", "<p>a", "t"), (None, "u", "<p>a", "t")], "page_id long, url string, html string, text string")
    assert sorted(r.text for r in extract(df).collect()) == ["", "a", "a"]
    assert extract(df.limit(0)).count() == 0
