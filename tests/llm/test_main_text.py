import html as H
import re

import pytest

from paperlode.llm import main_text as M

PARA = "This is a sentence of the article, long enough to count, with commas, and more of them."
MORE = "Another paragraph follows here, and it says something else, at some length, to its end."


def plain(page):
    """The article of pages of the test tables, which are all of one layout."""
    article = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?h1>|</?p>", article)
    return "\n".join(b for b in (" ".join(H.unescape(re.sub(r"</?b>|<br>", " ", b)).split()) for b in blocks) if b)


def test_equals_plain_reading_of_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: (r.url, plain(r.html)) for r in pages.collect()}
    got = M.extract(pages).collect()
    assert len(got) == len(want) and all((r.url, r.text) == want[r.page_id] and r.n_chars == len(r.text) for r in got)


ARTICLE = f"<h1>Title</h1><p>{PARA}</p><p>{MORE}</p>"
WANT = f"Title\n{PARA}\n{MORE}"
MENU = "<ul>" + "".join(f"<li><a href=/{i}>Section {i}</a></li>" for i in range(8)) + "</ul>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class=top>{MENU}</div><div id=content>{ARTICLE}</div><div class='sidebar'><p>{PARA}</p></div></body>",
        f"<main>{ARTICLE}<section class=comments><p>{PARA} {PARA}</p></section></main>",
        f"<article><header><nav>{MENU}</nav><h1>Title</h1><span>by someone</span></header><p>{PARA}</p><aside>{MORE}</aside><p>{MORE}</p><footer>tags</footer></article>",
        f"<body><div>{MENU}<div><div>{ARTICLE}</div></div></div><div><form><p>{PARA}</p></form></div>",
        f"<body><header><h1>Site</h1></header><div class='cookie-notice'><p>{PARA}{PARA}{PARA}</p></div><article class='post has-sidebar'>{ARTICLE}<div class=share><a>a</a></div></article>",
        f"<body><section><h1>Title</h1><p>{PARA}</p></section><section><p>{MORE}</p></section><div>{MENU}</div>",
        f"<body><article>{ARTICLE}<ol id='comment-list'><li>{PARA}<li>{PARA}</ol></article><div role=complementary>{PARA * 9}</div>",
        f"<body><article><h1>Title<p>{PARA}<script>var x = '</p><p>no';</script><style>p{{}}</style><p>{MORE}<!-- <p>{PARA}</p> --></article>",
        f"<BODY><ARTICLE><H1>Title</H1><P CLASS='lead'>{PARA}</P><DIV hidden>{PARA}</DIV><DIV style='display: none'>{PARA}</DIV><P>{MORE}",
        f"<body><article>{ARTICLE}</article><div class=ad>{PARA * 20}</div><div class='newsletter-signup'>{PARA * 20}</div>",
    ],
)
def test_layouts(page):
    assert M.main_text(f"<!DOCTYPE html><html><head><title>T, t</title></head>{page}") == WANT


def test_blocks_space_and_references():
    page = "<article><p>a &amp; b&nbsp;&#8212;\n\n <b>c</b><i>d</i> e<br>f &lt;p&gt; &amp</p> tail, <b>bold</b><ul><li>one<li>two <a href='>'>x</a></ul><table><tr><td>1<td>2</table><pre> x\n y </pre>1 < 2 &am</article>"
    assert M.main_text(page) == "a & b — cd e f <p> &\ntail, bold\none\ntwo x\n1\n2\nx y\n1 < 2 &am"


def test_inline_end_tags_stay_inside_their_block():
    assert M.main_text("<article><p><b>One.<br><p>Two.</p></b> rest</p></article>") == "One.\nTwo.\nrest"


def test_short_page_without_container():
    assert M.main_text("just text") == "just text"
    assert M.main_text("<p>Short.") == "Short."
    assert M.main_text("<nav>menu</nav>") == ""


@pytest.mark.parametrize("unit", ["<", '<a "', "<div>", "<p>a</b>", '<a href="', "<!--", "<script>", "<ul><li>", "&#", "<table><tr><td>x"])
def test_broken_markup_is_read_in_bounded_time(unit):
    M.main_text(unit * 20_000)


def test_odd_rows(spark):
    rows = [(None, None, None, "x"), (1, "u", "", "x"), (1, "u", "", "x"), (2, "u", f"<article>{'<p>' + PARA:s}" * 1 + f"<p>{MORE}" * 20_000, "x")]
    got = sorted(map(tuple, M.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")).collect()), key=str)
    text = "\n".join([PARA] + [MORE] * 20_000)
    assert got == sorted([(None, None, "", 0), (1, "u", "", 0), (1, "u", "", 0), (2, "u", text, len(text))], key=str)
    assert M.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
