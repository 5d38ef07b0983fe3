"""Main text of pages: blocks, references, what is left out, and the hosts' votes."""

import re
import time
from html import unescape

from tessera.llm import _common, html_text


def brute(html):
    """The article of the synthetic pages by plain substitutions."""
    inner = html.split("<article>", 1)[1].split("</article>")[0]
    inner = re.sub(r"<[^>]*$", "", inner)
    parts = re.split(r"</?(?:p|h1|footer|div)[^>]*>", inner)
    return "\n".join(t for t in (" ".join(unescape(re.sub(r"<[^>]+>", " ", p)).split()) for p in parts) if t)


def test_pages(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r["page_id"]: brute(r["html"].split("<footer>")[0]) for r in df.collect()}
    got = html_text.main_text(df).collect()
    assert len(got) == len(want)
    for r in got:
        assert r["text"] == want[r["page_id"]]
        assert r["n_chars"] == len(r["text"])


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="p-7"><header><h1>Site</h1></header>
<nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div><div id=wrap>
<main><article><h1>A &amp; B</h1><p>One  two<br>three &lt;x&gt; &copy <b>bold</b>text<p>Second &nbsp; <a href="#">link</a>
<div class="advert">Buy now buy now buy now</div><script>var a="</p><p>no</p>";</script><ul><li>x<li>y</ul>
<form><input><button>Send</button></form><aside>aside</aside><section class="comments"><p>First! what a long comment this is, much longer than all</p></section>
</article></main><div class="sidebar"><p>Side text that is long enough to be taken for content by a naive reader</p></div></div>
<footer>&copy; foot</footer></body></html>"""


def test_what_is_left_out():
    assert html_text.extract(PAGE, None) == "A & B\nOne two three <x> © boldtext\nSecond link\nx\ny"


def test_host_vote_decides(spark, monkeypatch):
    def page(box, n):
        return f"<body><div class='{box}'><p>{'real text ' * n}</p></div><div class='box'><p>{'filler ' * 6}</p></div></body>"

    rows = [(i, "http://Host.example/a", page("w", 10)) for i in range(5)] + [(9, "https://host.example:80/b", page("w", 1)), (10, None, page("w", 3)), (11, "http://h/", None), (12, "http://h/", ""), (12, "http://h/", "<p"), (None, "x", "just words & more <!-- never closed")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {(r["page_id"], r["url"]): r["text"] for r in html_text.main_text(df).collect()}
    assert got[(9, "https://host.example:80/b")] == "real text"
    assert got[(11, "http://h/")] == "" and got[(None, "x")] == "just words & more"
    monkeypatch.setattr(_common, "HOT_ROWS", 2)
    for most in (0, 100_000):  # paths shuffled and salted, and broadcast
        assert sorted((tuple(r) for r in html_text.main_text(df, broadcast_hosts=most).collect()), key=str) == sorted((tuple(r) for r in html_text.main_text(df).collect()), key=str)
    assert html_text.main_text(df).count() == len(rows) and html_text.main_text(df.limit(0)).count() == 0


def test_broken_pages_end():
    for html in ("<" * 50_000, "<a " * 20_000, "<p>" * 50_000 + "x", "&" * 50_000, "<div>" * 3_000 + "deep", "<!--", "<script>", '<a b="' * 200):
        html_text.extract(html, None)


def test_wrappers_are_not_what_they_have():
    html = "<body class='x'><div class='site with-sidebar no-comments'><div class='ad1'>buy</div><div class='text2'><p>Kept text here</p></div><ul class='comment-list'><li>Reader says much more than the author ever did</li></ul></div></body>"
    assert html_text.extract(html, None) == "Kept text here"


def test_words_in_values_are_no_attributes():
    inside = ['style="overflow: hidden"', "style='visibility: visible; overflow: hidden'", 'title="The hidden city"', "data-x='a aria-hidden=true b'", 'alt="x role=navigation y"', 'title="a class=advert b"', "data-hidden", "style = 'x hidden y' lang=en", 'title="a > hidden b"', "data-a=x/hidden"]
    for a in inside:
        for tag in ("div", "main", "article"):
            assert html_text.extract(f"<body><{tag} {a}><p>Kept text here</p></{tag}></body>", None) == "Kept text here", a
    for a in ("hidden", 'hidden=""', "HIDDEN", 'style="x"hidden', "aria-hidden=true", 'aria-hidden = "true"', "role=navigation", 'title="x" class="advert"', "id='advert'/"):
        assert html_text.extract(f"<body><div {a}><p>Gone</p></div><p>Kept</p></body>", None) == "Kept", a
    for a in ("x=" * 50_000, "x " * 50_000, "x" + " " * 100_000, "= " * 50_000, 'a="' * 50_001):
        html_text.extract(f"<div {a}>text", None)


def test_a_megabyte_takes_seconds():
    n = 100_000
    begun = time.time()
    for html in ("<b>" * n + "</i>" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<b>" * n + "<div></div>" * n, "<div>" * n + "<li></li>" * n, "<p>" + "<b>" * n + "<p>" * n, "<td>" * n, "<div><li>" * n, "<ul><li>" * n, "<main>" + "<div class=toc>" * n + "x"):
        html_text.extract(html, None)
    assert time.time() - begun < 60


def test_deep_paths_stay_apart():
    name = "c" * 20
    deep = f"<div class={name}>" * 90
    html = f"<body>{deep}<p>short junk</p><div class=a><p>{'the real text ' * 9}</p></div><div class=b><p>short junk again</p></div>"
    page = html_text._Page(html)
    assert len(set(page.path)) == len(page.path)
    path = next(p for p, i in zip(page.path, range(len(page.path))) if i == len(page.path) - 2)
    assert html_text.extract(html, path) == ("the real text " * 9).strip()


def test_doubtful_names_inside_an_article():
    said = [("section", "legal"), ("div", "toc"), ("div", "tags"), ("p", "related"), ("div", "rail"), ("p", "foot")]
    for tag, name in said:
        html = f"<body><article><p>First part.</p><{tag} class='{name}'>Plain words of the author, with <a href=x>a link</a> in it.</{tag}><p>Last part.</p></article></body>"
        assert html_text.extract(html, None) == "First part.\nPlain words of the author, with a link in it.\nLast part.", name
        html = f"<body><article><p>First part.</p><{tag} class='{name}'>See <a href=x>another page of ours</a> <a href=y>and one more</a></{tag}><p>Last part.</p></article></body>"
        assert html_text.extract(html, None) == "First part.\nLast part.", name
        html = f"<body><article><p>First part.</p></article><{tag} class='{name}'>Plain words of no author.</{tag}></body>"
        assert html_text.extract(html, None) == "First part.", name
    for name in ("alert", "discussion", "comments", "advert", "cookie-notice"):
        assert html_text.extract(f"<article><p>One.</p><div class={name}><p>Two.</p></div></article>", None) == "One."
    assert html_text.extract("<article><p>Press <button>OK</button> or <label>the box</label>.</p><button>Share</button><form><label>Name</label></form></article>", None) == "Press OK or the box."
