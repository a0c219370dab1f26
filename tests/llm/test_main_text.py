"""Main text against pages whose main text is known."""

import random
import time

import pytest

from cropframe.llm import main_text, queries

RULES = main_text.Rules()
PROSE = "The rain that fell on the hills of the north was more than the river could take, and the fields by it were lost. "
LONG = PROSE * 3
MENU = "<ul><li><a href='/a'>Home</a></li><li><a href=/b>All of the news</a></li></ul>"


def text(page):
    return main_text.main_text(page, RULES)


def squeezed(s):
    return " ".join(s.split())


def test_article_without_what_surrounds_it():
    page = f"""<!DOCTYPE html><html><head><title>T &amp; T</title><style>p {{}}</style><script>var a = "<p>{LONG}</p>";</script>
    </head><body class="has-sidebar"><header><h1>Site</h1><p>{LONG}</p></header><nav>{MENU}</nav>
    <div class="cookie-notice">{LONG}</div><!-- <p>{LONG}</p> --><div class="ad">Buy it.</div>
    <article class="post category-comments"><h1>Rain &amp; hills</h1><p><b>First</b> line<br>next&nbsp;line <p>Short.<p>{LONG}
    <div class="adContainer">{LONG}</div><aside>{LONG}</aside><form><p>{LONG}</p><button>Send</button></form>
    <p>With a <a href=x>link</a> of the kind that <i>any</i> text may have in it, and that is no reason to leave it out.</p>
    <ul class=related><li><a href=q>{PROSE}</a></li></ul><p>End.</p><footer>By the author of the text</footer></article>
    <section id="comments"><h2>Comments</h2><article class="comment"><p>{LONG}</p></article></section>
    <div class="sidebar"><p>{LONG}</p></div><footer>&copy; 2024 &middot; {PROSE}</footer></body></html>"""
    assert text(page) == squeezed(f"""Rain & hills First line next line Short. {LONG} With a link of the kind that any text
        may have in it, and that is no reason to leave it out. End.""")


def test_pages_without_article_go_by_words_length_and_links():
    page = f"""<body><div>{MENU}</div><div>Up to date</div><div><h2>Heading</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>
    <div>Zebra xylophone quartz jigsaw vex {"gizmo lorem wicked " * 12}</div>
    <div><a href=a>More of the news that you will want to read today</a> and <a href=b>still more of it, all for you</a></div>
    <div>&copy; the owner of the site</div></body>"""
    assert text(page) == squeezed(f"Heading {LONG} Short. {LONG}")


def test_other_languages_do_without_stop_words():
    words = "qaqa wewe ririr tutut " * 12
    assert text(f"<div>{MENU}</div><div><p>{words}</p><p>{words}</p></div>") == squeezed(words * 2)


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("   ", ""), ("<p></p>", ""), ("<article></article>", ""),
    ("<article>one", "one"), ("<article><p>one<script>var x = '</p>", "one"), ("<article>one<!-- two", "one"),
    ("<article>one <p cla", "one"), ("<article>a &lt;b&gt; c &am", "a <b> c &am"), ("<article>1 < 2 > 1</article>", "1 < 2 > 1"),
    ("<article>a<b>b</b>c<br/>d</article>", "abc d"), ("<article>a<div>b</div>c</article>", "a b c"),
    ("<article title='x > y'>one</article>", "one"), ('<article title="x>one</article>', "one"),
    ("<article><p hidden>no</p><p style='display: none'>no</p>yes</article>", "yes"),
    ("<article>&#233;&eacute;&#x1F600;\x1c x</article>", "éé\U0001f600 x"),
    ("<head><title>t<body><article>one</article>", ""), ("<head><meta x><p>gone</p><article>one</article>", "one"),
    ("<article>a<span class=ad><span>no</span> no</span>b</article>", "a b"), ("<ARTICLE>One</ARTICLE>", "One"),
    ("</div></p><article></li>one</article></div>", "one"), ("plain text", "plain text"),
])
def test_odd_pages(page, want):
    assert text(page) == want


def test_work_is_linear_in_the_page():
    for part in ("<div>", "<a <", "<p>x", "<li><ul>", "&amp;", "<!-- ", "<a href=\"", "</span>", "<li><div>", "<b>"):
        began = time.time()
        text(part * 100_000 + ">")
        assert time.time() - began < 10, part


def random_page(rng):
    """A page and its main text."""
    say = lambda a, b: squeezed(" ".join(rng.choices(PROSE.split(), k=rng.randint(a, b))))
    main = [say(1, 6)] + [say(1, 120) for _ in range(rng.randint(1, 8))]
    ad = lambda: rng.choice([f"<div class=ad>{say(1, 60)}</div>", f"<!-- {say(1, 9)} -->", f"<aside><p>{say(40, 90)}</aside>",
                             f"<form>{say(3, 60)}<input name=a></form>", f"<script>p('<p>{say(1, 9)}</p>')</script>", ""])
    body = f"<h1>{main[0]}</h1>" + "".join(f"<p>{ad()}{p}{rng.choice(['</p>', ''])}" if rng.random() < 0.3 else f"<p>{p}</p>"
                                           for p in main[1:])
    page = f"<html><head><title>{main[0]}</title></head><body>{ad()}<nav>{MENU}</nav>{ad()}<article>{body}</article>{ad()}"
    return page + f"<section class='comments'><p>{say(20, 90)}</p></section><footer>{say(1, 60)}</footer>", " ".join(main)


def test_random_pages():
    rng = random.Random(7)
    for _ in range(300):
        page, want = random_page(rng)
        assert text(page) == want


def test_operator_on_odd_tables(spark):
    rows = [(1, "u", LONG, "n"), (1, "u", LONG, "n"), (None, None, f"<article>{LONG}", None), (2, "u", None, "n"), (3, None, "", "n"),
            (4, "v", "<p>" + LONG * 2000, "n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    pages = pages.selectExpr("*", "1 as n_chars", "'x' as page", "'y' as c0")
    got = sorted((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in main_text.extract(pages).collect())
    want = [(r[0] or 0, r[1] or "", text(r[2]), len(text(r[2]))) for r in rows]
    assert got == sorted(want) and len(got) == 6
    assert main_text.extract(pages.where("false")).count() == 0


def test_query_over_the_given_pages(spark):
    import html
    import re

    sf = "/root/testdata/sf0.01"
    got = {r["page_id"]: r for r in queries.op12_main_text(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.search("<article>(.*?)(</article>|$)", p["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", article))).split())
        assert got[p["page_id"]]["text"] == want and got[p["page_id"]]["n_chars"] == len(want)
        assert got[p["page_id"]]["url"] == p["url"]
