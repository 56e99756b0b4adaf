"""Main text: pages made around a known article, and odd markup."""

import random
import re

import pytest

from gridframe.llm import html_extract
from gridframe.llm.html_extract import main_text
from gridframe.llm.queries import op1_html_extract


def sentence(rng, n):
    return " ".join(rng.choice("river stone quiet market window harbour letter garden winter morning".split()) for _ in range(n)) + "."


@pytest.mark.parametrize("seed", range(12))
def test_planted_articles(seed):
    rng = random.Random(seed)
    paragraphs = [sentence(rng, rng.randrange(12, 90)) for _ in range(rng.randrange(2, 9))]
    menu = "<ul>" + "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(rng.randrange(4, 20))) + "</ul>"
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    shell = rng.choice(["<article>{}</article>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="story"><div>{}</div></div>'])
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style><script>var a = "<p>no</p>";</script></head><body>
        <header><h1>Site</h1></header><nav>{menu}</nav>{shell.format(body)}<aside class="sidebar">{menu}<p>Read more here</p></aside>
        <div class="comments"><p>{sentence(rng, 40)}</p></div><form><input><p>Sign up now</p></form><footer><p>Copyright</p></footer></body></html>"""
    assert main_text(page) == "\n".join(paragraphs)


CASES = {
    "entities": ("<body><p>caf&eacute; &amp; &#x41;&#66; &lt;b&gt; &copy</p></body>", "café & AB <b> ©"),
    "white space": ("<body><p> a \n\t b</p>\n\n<p>c</p></body>", "a b\nc"),
    "inline": ("<body><p>one <b>two</b>three <i>four</i></p></body>", "one twothree four"),
    "unclosed": ("<body><p>first<p>second<ul><li>x<li>y</ul>", "first\nsecond\nx\ny"),
    "comment": ("<body><!-- <p>no</p> --><p>yes</p></body>", "yes"),
    "script": ('<body><p>a</p><script>if (a < b) "</p>";</script><p>b</p></body>', "a\nb"),
    "no markup": ("plain words only", "plain words only"),
    "other attributes": ('<body><div><p title="the hidden truth">one</p><p data-hidden="false">two</p><p class="share-price">three</p><p data-x=class="ad">four</p></div></body>', "one\ntwo\nthree\nfour"),
    "hidden": ('<body><div><p>one</p><p hidden>no</p><p aria-hidden="TRUE">no</p><p style="x:1; Display: none">no</p></div></body>', "one"),
    "split reference": ("<body><p>a &<b>amp;</b> b &amp;amp; c</p></body>", "a &amp; b &amp; c"),
    "open quote": ('<body><p class="x>text</p><p>more</p></body>', None),
    "nothing": ("<html><body><nav><a href=x>y</a></nav></body></html>", ""),
    "deep": ("<body>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</body>", "deep"),
    "long": ("<body>" + "<p>word word</p>" * 20000 + "</body>", "\n".join(["word word"] * 20000)),
}


@pytest.mark.parametrize("name", CASES)
def test_markup(name):
    page, text = CASES[name]
    got = main_text(page)
    assert text is None or got == text


@pytest.mark.parametrize("name", ["content with-sidebar", "layout no-ads", "page has-comments", "page-with-share-bar", "social-story", "related-work"])
def test_wrappers_with_such_names(name):
    rng = random.Random(3)
    paragraphs = [sentence(rng, n) for n in (60, 45, 70)]
    for inner in ("{}", "<article>{}</article>", "<div><div>{}</div></div>"):
        for tag in ("div", "section"):
            page = f'<body><nav><a href="/">Home</a></nav><{tag} class="{name}">{inner.format("".join(f"<p>{p}</p>" for p in paragraphs))}</{tag}><div class="comments"><p>{sentence(rng, 30)}</p></div></body>'
            assert main_text(page) == "\n".join(paragraphs)


def test_long_comments_do_not_become_the_article():
    rng = random.Random(8)
    story, comment = sentence(rng, 40), sentence(rng, 400)
    for name in ("comments", "comment"):
        assert main_text(f'<body><article><h1>Title</h1><p>{story}</p></article><div class="{name}"><p>{comment}</p></div></body>') == f"Title\n{story}"


def test_density_finds_articles_without_their_tags(spark, sf):
    pages = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").select("html").collect() if r["html"]]
    bare = [re.sub(r"<(/?)(article|main)\b", r"<\1div", x) for x in pages]
    assert sum(main_text(a) == main_text(b) for a, b in zip(pages, bare, strict=True)) >= 0.98 * len(pages)


def test_density_leaves_unmarked_lists_of_links_and_keeps_short_paragraphs():
    rng = random.Random(9)
    paragraphs = [sentence(rng, 80), "Short.", sentence(rng, 50), sentence(rng, 90), "Yes."]
    links = "".join(f'<li><a href="/{i}">Another page {i}</a></li>' for i in range(30))
    page = f'<body><div><ul>{links}</ul></div><div><h1>Head</h1><p><b>By someone</b></p><div>{"".join(f"<p>{p}</p>" for p in paragraphs)}</div></div><div><ul>{links}</ul></div></body>'
    assert main_text(page) == "\n".join(["Head", "By someone", *paragraphs])


def test_table(spark):
    page = "<body><article><p>Some text &amp; more</p></article></body>"
    pages = spark.createDataFrame([(1, None, page, "x", 5), (1, None, page, "x", 5), (2, "u", None, None, 5), (None, "u", "", "", 5)], "page_id long, url string, html string, text string, n_chars int")
    rows = html_extract.extract(pages).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in rows) == [(0, "", 0), (1, "Some text & more", 16), (1, "Some text & more", 16), (2, "", 0)]
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_query(spark, sf):
    rows = op1_html_extract(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    # The driver's pages hold the text of real paragraphs; markup never survives.
    assert sum(r["n_chars"] > 200 for r in rows) > len(rows) / 2 and not any("</" in r["text"] for r in rows)
