import re
import time
from html import unescape

from corpuslab.llm import html_text as H


def text_of(html, template=()):
    return "\n\n".join(H.blocks(H.mains(H.parse(html)), set(template)))


def test_structure():
    page = """<!doctype html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li>x</ul></nav>
    <!-- <p>no</p> --><div class="ad">buy</div><article><header><h1>Head &amp; more</h1></header><p><b>One<br>two <i>th</i>ree<p>four&nbsp; five
    </p><form>f</form><div class="share-buttons">s</div><ul><li>a<li>b</ul><pre>c
    d</pre><script>var t="</p>";</script><section id="comments"><p>reader</p></section></article><footer>&copy;</footer>"""
    assert text_of(page) == "Head & more\n\nOne two three\n\nfour five\n\na\n\nb\n\nc d"


def test_marks():
    assert text_of('<article><div class="entry-header"><h1>T</h1></div><p data-id="menu">x</p><div id="side-bar">s</div><p hidden>h</p></article>') == "T\n\nx"
    assert text_of('<div class="page header">H</div><p class="headers-up">x</p><div role="banner">b</div>') == "x"


def test_subjects_of_articles_are_no_marks():
    kept = [
        '<section id="cookies"><h2>Cookies</h2><p>bake</p></section>', '<section id="navigation"><p>stars</p></section>', '<h2 id="comments">Comments in C</h2>', '<div class="cookie-recipe"><p>c</p></div>',
        '<div class="menu-planning-guide"><p>m</p></div>', '<div class="toolbar-design"><p>t</p></div>', '<section id="menu-items"><p>i</p></section>', '<div id="sponsored"><p>s</p></div>', '<p class="promotion-law">law</p>',
    ]
    gone = [
        '<ins class="adsbygoogle">ad</ins>', '<section class="responses"><p>r</p></section>', '<div class="werbung">w</div>', '<div class="ad-slot-2">a</div>', '<section id="comments"><p>c</p></section>',
        '<div id="cookie-banner">c</div>', '<div class="post-comments">p</div>', '<div class="c-sidebar__widget">s</div>', '<div id="respond">r</div>',
    ]
    for piece in kept:
        assert text_of(f"<article><p>x</p>{piece}</article>") != "x", piece
    for piece in gone:
        assert text_of(f"<article><p>x</p>{piece}</article>") == "x", piece


def test_broken_markup():
    assert text_of("a < b <p title=\"x>y</p>") == "a < b\n\ny"
    assert text_of("<p>x<!-- never closed <p>y") == "x"
    assert text_of("<script>x") == ""
    assert text_of("") == ""
    assert text_of("plain") == "plain"
    assert text_of("<div>" * 5000 + "deep" + "</div>" * 10) == "deep"


def test_what_holds_the_article_stays():
    assert text_of('<div class="content has-sidebar"><article><p>x</p></article></div>') == "x"
    assert text_of('<div class="sidebar page"><article class="post comments-open"><p>x</p></article></div>') == "x"
    assert text_of('<form id="aspnet"><article><p>x</p></article></form>') == "x"
    assert text_of('<article><div class="related-work"><p>w</p></div><p>a <math><mi>b</mi></math></p><div class="related-posts">r</div></article>') == "w\n\na b"
    assert text_of('<aside><article>teaser</article></aside><article class="post">x</article>') == "x"
    assert text_of("<p>a\x00b</p>") == "a\x00b"


def test_time_is_linear_in_the_length():
    began = time.process_time()
    for page in ['<a href="x ' * 200_000, "<div>" * 200_000, "<b>" * 100_000 + "<p>x</i>" * 100_000, "<i><td>" + "<b>" * 50_000 + "</i>" * 50_000, "<a '\">" * 200_000, "<!-- " * 200_000, "< >" * 200_000]:
        H.blocks(H.mains(H.parse(page)))
    assert time.process_time() - began < 40


def test_content_in_half_of_a_host_is_template_and_revisions_are_not(spark):
    def page(title, body, more=""):
        return f"<body><article><h1>{title}</h1><p>{body}</p>{more}<p>Subscribe for 5 a month.</p></article></body>"

    rows = [(k, f"https://h.example/{k}", page(f"title {k}", f"text {k}")) for k in range(20)]
    rows += [(100 + k, f"https://h.example/r{k}", page("one title", "the body of an article", f"<div><p>revised {k}</p></div><div><p>kept</p></div>")) for k in range(40)]
    rows += [(200 + k, f"https://h.example/p{k}", page(f"promoted {k}", f"words {k}", "<section><p>Our offer</p></section>")) for k in range(6)]
    rows += [(300, "https://small.example/1", page("title", "text"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("template", H.F.lit(1))
    for limit in (0, 1000):
        got = {r.page_id: r.text for r in H.extract(df, broadcast_rows=limit).collect()}
        assert got[3] == "title 3\n\ntext 3"
        assert got[105] == "one title\n\nthe body of an article\n\nrevised 5\n\nkept"
        assert got[202] == "promoted 2\n\nwords 2"
        assert got[300] == "title\n\ntext\n\nSubscribe for 5 a month."


def test_template_subtrees_recur(spark):
    def page(k, body):
        return f"<body><div><p>Welcome to our site</p></div><p>{body} {k}</p><div><span>shared {k % 2}</span></div></body>"

    rows = [(k, f"https://h.example/{k}", page(k, "text")) for k in range(30)]
    rows += [(100, "https://other.example/1", page(1, "text")), (101, None, page(1, "text")), (102, "https://h.example/n", None), (102, "https://h.example/n", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", H.F.lit(1))
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    assert got[3] == "text 3"
    assert got[100] == got[101] == "Welcome to our site\n\ntext 1\n\nshared 1"
    assert got[102] == ""
    assert H.extract(df).count() == 34
    assert H.extract(df.where("false")).count() == 0


def test_query_against_plain_reading_of_the_article(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = H.query(spark, sf_dir).collect()
    assert {r.page_id for r in rows} == set(pages)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.DOTALL)[1]
        parts = re.split(r"</?(?:p|h1|article)>", article)
        want = [" ".join(unescape(re.sub(r"<[^>]*>", " " if "<br>" in x else "", x)).split()) for x in parts]
        assert r.text == "\n\n".join(x for x in want if x)
        assert r.n_chars == len(r.text)
