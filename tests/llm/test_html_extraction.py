import html
import re
import time

from hearken.llm import html_extraction as H
from hearken.llm.queries import QUERIES
from tests.llm.data import SMALL


def article(page):
    """Brute force for the synthetic pages: what stands in the article, cut at block tags."""
    body = re.search(r"<article>(.*?)</article>", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", body[1]) if body else []
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "br" in x else "", x)).split()) for x in parts]
    return "\n".join(b for b in blocks if b)


def test_synthetic_pages(spark):
    want = {r["page_id"]: article(r["html"]) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in QUERIES["op7_html_extraction"](spark, SMALL).collect()}
    assert {k: r["text"] for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_boilerplate_and_references():
    page = """<html><body class="with sidebar"><header>Site</header><nav>Menu</nav><article><header><h1>T &amp; U</h1></header>
    <p>One<br>two <b>three</b>&nbsp;four<p class="lead">x &lt;y&gt; &#233;</p><div class="ad-box ad">Buy</div><ul><li>a<li>b</ul>
    <form>Mail</form><section class="comments"><p>first!</p></section><script>if (a < b) "</p>"</script></article><aside>Side</aside><footer>F</footer></body>"""
    assert H.main_text(page) == "T & U\nOne two three four\nx <y> é\na\nb"
    assert H.main_text(None) == H.main_text("") == ""
    assert H.main_text("just text <p>more") == "just text\nmore"
    assert H.main_text("<div>" * 50000 + "deep") == "deep"


def test_names_alone_do_not_delete_main_text():
    """Telling words in the names of an article, or beside other words in its parts."""
    body = "<h1>T</h1><p>One.</p>"
    for attributes in ('class="post menu-recipes"', 'id="reply-to-critics"', 'class="comment"', 'id="ad"', 'class="social related"'):
        assert H.main_text(f"<body><article {attributes}>{body}</article><footer>F</footer></body>") == "T\nOne."
    for part in ('<h2 id="related-work">X</h2>', '<section id="social-policy"><p>X</p></section>', '<p class="notice">X</p>', '<div class="menu-recipes">X</div>', '<h2 class="comments">X</h2>', '<div id="banner-years"><p>X</p></div>', '<ul class="sponsor-states"><li>X</ul>'):
        assert H.main_text(f"<article>{body}{part}</article>") == "T\nOne.\nX", part
        assert H.main_text(f"<main>{body}{part}</main>") == "T\nOne.\nX", part
    for part in ('<div class="ad">X</div>', '<section id="comments"><p>X</p></section>', '<ol class="comment-list"><li>X</ol>', '<article class="comment">X</article>', '<div class="big share-buttons">X</div>', '<div class="related-posts">X</div>', '<div role="search">X</div>', '<div hidden>X</div>', '<table class="newsletter-box"><tr><td>X</table>'):
        assert H.main_text(f"<article>{body}{part}</article>") == "T\nOne.", part


def test_site_templates_go(spark):
    rows = [(i, f"http://h{i % 2}.com/{i}", f"<body><div>Welcome to the site</div><div>Own text {i}</div><div>Bottom</div></body>", 1) for i in range(40)]
    rows += [(100, None, None, 1), (101, "http://lone.com", "<body><div>Welcome to the site</div></body>", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    assert all(got[i] == f"Own text {i}" for i in range(40))
    assert got[100] == "" and got[101] == "Welcome to the site"
    assert H.extract(pages.limit(0)).count() == 0


def test_templates_without_telling_names(spark):
    """A large host whose sidebar is on a tenth of its pages, copies of one page on a small host, and no
    articles: only the counted subtrees can tell what is the page's own."""
    rows = [(i, f"http://big.com/{i}", f"<body><div><span>Home</span><span>All</span></div>{'<div><b>Read this too</b> of ours</div>' if i % 10 == 0 else ''}<div>Own text {i}</div></body>", "x", None) for i in range(600)]
    rows += [(1000 + i, f"http://copied.com/{i}", f"<head><script>n={i}</script></head><body><div>The one story</div></body>", "x", None) for i in range(5)]
    rows += [(1100 + i, f"http://copied.com/o{i}", f"<body><div>Other {i}</div></body>", "x", None) for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, hashes string")
    got = {r["page_id"]: r["text"] for r in H.extract(pages).collect()}
    assert all(got[i] == f"Own text {i}" for i in range(600))
    assert all(got[1000 + i] == "The one story" and got[1100 + i] == f"Other {i}" for i in range(5))
    without = {r["page_id"]: r["text"] for r in H.extract(pages, share=2.0, many=1 << 40).collect()}
    assert sum(without[i] != got[i] for i in range(600)) == 600


def test_repeated_rows(spark):
    rows = [(1, "http://a.com", "<article>T</article>"), (1, "http://a.com", "<article>T</article>")]
    assert [r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()] == ["T", "T"]


def test_hostile_pages_cost_linear_time():
    pages = ["<blockquote>" * 50000 + "x", "x" + "</b>" * 50000, "<article>" * 50000 + "x", "<table><p><td>" + "<blockquote>" * 50000 + "x", "<p>" + "<span>" * 50000 + "<div>" * 50000 + "x", "<ul>" + "<li>a" * 50000]
    for page in pages:
        began = time.process_time()
        assert H.main_text(page).endswith(("x", "a"))
        assert time.process_time() - began < 5


def test_cells_and_items_close():
    assert H.main_text("<table><tr><td>a<td>b<tr><td>c</table>d") == "a\nb\nc\nd"
    assert H.main_text("<ul><li>a<ul><li>b<li>c</ul><li>d</ul></b></p>e") == "a\nb\nc\nd\ne"
