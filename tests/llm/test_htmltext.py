"""Main text of pages: the classifier on odd markup, and the operator against an independent reading of the pages."""

import html
from html.parser import HTMLParser

import numpy as np
import pytest

from beaconflow.llm import htmltext as H

SF = "/root/testdata/sf0.01"


class Plain(HTMLParser):
    """Headings and paragraphs of the article element, by the parser of the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.within, self.parts = False, [[]]

    def handle_starttag(self, tag, attrs):
        self.within |= tag == "article"
        if tag in ("p", "h1"):
            self.parts.append([])
        if tag == "br":
            self.parts[-1].append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1"):
            self.parts.append([])
        self.within &= tag != "article"

    def handle_data(self, data):
        if self.within:
            self.parts[-1].append(data)


def brute(page):
    p = Plain()
    p.feed(page or "")
    p.close()
    return "\n".join(t for t in (" ".join("".join(x).split()) for x in p.parts) if t)


def test_operator_equals_another_parser(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in H.extract(pages, keep=["page_id", "url"]).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == brute(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_the_tree_fits_its_table_and_trains_alike():
    x, y = H.labelled()
    assert np.mean((H.judge(H.trained(), x) >= 0.5) != y) < 0.01
    assert H.grow(x, y) == H.trained()


def test_grow_finds_the_split_with_least_impurity():
    x = np.array([[0, 5], [1, 4], [2, 3], [3, 2], [4, 1], [5, 0]], float)
    assert H.grow(x, np.array([0, 0, 1, 1, 1, 1.0])) == (0, 1.5, (0.0,), (1.0,))
    assert H.grow(x, np.zeros(6)) == (0.0,) and H.grow(np.ones((4, 1)), np.array([0, 1, 0, 1.0])) == (0.5,)


WORDS = " ".join(["plain words of a longer paragraph that goes on"] * 6) + "."
PARTS = {
    "menu": "<nav><a href=/>Home</a> <a href=/>News</a></nav>", "header": "<header><p>The daily page</p></header>",
    "sidebar": f"<div class='sidebar'><p>{WORDS} side</p></div>", "aside": f"<aside><p>{WORDS} aside</p></aside>",
    "notice": f"<div id='cookie-notice'>{WORDS} cookies</div>", "advert": f"<div class='ad'>{WORDS} buy</div>",
    "form": "<form><label>Mail</label><input name=x><button>Send</button></form>", "script": "<script>if (a < b) { x = '</p><p>' }</script>",
    "style": "<style>p > a { color: red }</style>", "comments": f"<section class='reader-comments'><article class='comment'><p>{WORDS} me too</p></article></section>",
    "footer": "<footer>&copy; somebody</footer>", "hidden": "<div style='display: none'>unseen</div>", "comment": "<!-- <p>gone</p> -- > still -->",
}


@pytest.mark.parametrize("name", PARTS)
@pytest.mark.parametrize("where", ["before", "inside", "after"])
def test_what_is_no_article_goes_wherever_it_stands(name, where):
    part = PARTS[name]
    if name == "header" and where == "inside":
        return  # an article's own header holds its heading
    inner = ["<h1>A heading</h1>", f"<p>{WORDS}</p>", "<p>Be.</p>"]
    inner.insert(2, part if where == "inside" else "")
    page = f"<html><body>{part if where == 'before' else ''}<article>{''.join(inner)}</article>{part if where == 'after' else ''}</body></html>"
    assert H.main_text(page) == f"A heading\n{WORDS}\nBe."


def test_markup_that_is_not_well_formed():
    assert H.main_text("<article><p><b>one <i>two<p>three<br>four</b> five<li>six") == "one two\nthree four five\nsix"
    assert H.main_text("<ARTICLE><P title='a>b' x=\"c>d\">up</P></ARTICLE>") == "up"
    assert H.main_text("<article>a &lt;b&gt; &amp;amp; &#233;&eacute; &am x &amp\u00a0 y < z 1<2</article>") == "a <b> &amp; éé &am x & y < z 1<2"
    assert H.main_text("<article><p>kept</p><!-- never closed <p>gone</p>") == "kept"
    assert H.main_text("<article><p>kept</p><script>never closed <p>gone</p>") == "kept"
    assert H.main_text("<article><p>one</p></div></section></p><p>two</p>") == "one\ntwo"
    assert H.main_text("<head><title>no</title><article><p>the head is never closed</p>") == "the head is never closed"
    assert H.main_text("<article><p a='never closed>x</p></article>") == "x"


def test_pages_without_an_article_element():
    menu = "".join(f"<li><a href=/>Link {i}</a></li>" for i in range(6))
    page = f"<body><ul>{menu}</ul><div class=content><h2>{WORDS}</h2><p>{WORDS}</p><p>{WORDS}</p></div><div><a href=/>More</a></div></body>"
    assert H.main_text(page) == "\n".join([WORDS] * 3)


def test_odd_rows(spark):
    long = "<article>" + "".join(f"<p>paragraph {i} &amp; more</p>" for i in range(60_000)) + "</article>"
    rows = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "<article>x</article>", None), (3, long, "t"), (4, "<b><div>" * 60_000 + "x", "n"), (5, "<" * 5000, "lt")]
    df = spark.createDataFrame([(i, h, t, 7) for i, h, t in rows], "page_id long, html string, text string, n_chars int")
    got = H.extract(df)
    assert got.columns == ["page_id", "text", "n_chars"]
    by = {}
    for r in got.collect():
        by.setdefault(r.page_id, []).append(r)
    assert [r.text for r in by[1]] == [""] and [r.text for r in by[2]] == ["", ""] and by[None][0].text == "x"
    assert by[3][0].text == "\n".join(f"paragraph {i} & more" for i in range(60_000)) and by[3][0].n_chars == len(by[3][0].text)
    assert H.extract(df.limit(0)).collect() == []


def test_references_are_decoded_once():
    assert H.main_text("<article>&amp;lt;p&amp;gt;</article>") == html.unescape("&amp;lt;p&amp;gt;") == "&lt;p&gt;"
