"""The labelled table of the page classifier: page layouts in pieces, ``+`` main text, ``-`` other.

``{n}`` stands for n words of running text, ``{n!}`` for n words without a final stop.  Each layout is written out at several scales.
"""

from __future__ import annotations

import re

#: Layouts (fixed values): every string is a label and a piece of a page.
LAYOUTS = [
    # an article element among menus, adverts and a footer
    ["-<html><head><title>{6!}</title></head><body><nav><ul><li><a href=/>{1!}</a></li><li><a href=/>{1!}</a></li><li><a href=/>{2!}</a></li></ul></nav>",
     "-<div class=ad>{9}</div>", "+<article><h1>{8!}</h1>", "+<p>{60}</p>", "+<p>{35} <a href=/>{3!}</a> {20}</p>", "+<p>{2}</p>", "+<p>{90}</p></article>",
     "-<footer>{12}</footer>"],
    # parts inside the article that are no article, and comments below
    ["-<body><header><a href=/>{3!}</a><p>{6!}</p></header>", "+<main><article><header><h1>{7!}</h1></header>", "+<p>{80}</p>", "-<div class='ad-slot'>{14}</div>",
     "+<h2>{4!}</h2>", "+<p>{55}</p>", "-<aside><p>{25}</p></aside>", "+<ul><li>{9!}</li>", "+<li>{7!}</li></ul>", "+<p><a href=/>{5!}</a></p>", "+<p>{40}</p></article>",
     "-<section id=comments><h3>{2!}</h3>", "-<p>{45}</p>", "-<p>{30}</p></section></main>", "-<footer><p>{20}</p></footer>"],
    # main without article, a form and a notice
    ["-<body><div class='cookie-notice'><p>{22}</p></div>", "-<div class=sidebar><p>{18}</p><ul><li><a href=/>{3!}</a></li><li><a href=/>{2!}</a></li></ul></div>",
     "+<main><h1>{6!}</h1>", "+<p>{50}</p>", "+<blockquote>{30}</blockquote>", "-<form><p>{12}</p><button>{1!}</button></form>", "+<p>{70}</p>", "+<p>{6}</p></main>",
     "-<div class=related><p>{16}</p></div>"],
    # a menu of links inside the article
    ["+<article><h1>{9!}</h1>", "-<ul><li><a href=/>{2!}</a></li>", "-<li><a href=/>{3!}</a></li>", "-<li><a href=/>{2!}</a></li>", "-<li><a href=/>{2!}</a></li></ul>",
     "+<p>{45}</p>", "+<p>{75}</p></article>", "-<div><a href=/>{3!}</a></div>", "-<p>{15}</p>", "-<p>{60}</p>"],
    # no telling elements: words and links decide
    ["-<body><div><a href=/>{1!}</a> | <a href=/>{1!}</a> | <a href=/>{2!}</a></div>", "-<div><a href=/>{3!}</a></div>", "+<div><h1>{8!}</h1>", "+<p>{65}</p>",
     "+<p>{40}</p>", "+<p>{12}</p>", "+<p>{85}</p></div>", "-<div><a href=/>{4!}</a></div>", "-<div><a href=/>{5!}</a></div>", "-<div>{4!}</div>"],
    ["-<table><tr><td><a href=/>{2!}</a></td><td><a href=/>{2!}</a></td></tr></table>", "-<div><a href=/>{6!}</a></div>", "+<div>{55}</div>",
     "+<div>{30} <a href=/>{4!}</a> {25}</div>", "+<div>{70}</div>", "-<div><a href=/>{2!}</a> {1!} <a href=/>{2!}</a></div>", "-<div>{3!} <a href=/>{2!}</a></div>"],
    ["+<p>{50}</p>", "+<p>{80}</p>", "+<p>{20}</p>"],
    ["-<div class='banner'>{10}</div>", "+<div class=post><h2>{5!}</h2>", "+<p>{75}</p>", "+<p>{30}</p></div>", "-<div class='post-comments'><p>{40}</p>", "-<p>{25}</p></div>",
     "-<div id=footer>{15}</div>"],
    # advertising and comments around an article element without marks
    ["-<p>{25}</p>", "+<article><p>{30}</p>", "+<p>{4}</p>", "+<h2>{3!}</h2>", "+<p>{3!}</p></article>", "-<p>{70}</p>", "-<h3>{3!}</h3>", "-<p>{35}</p>"],
]
#: Word counts of the paragraphs of further articles, where length and links say nothing: every third, fourth, ... is a link.
PARAGRAPHS = (40, 1, 3, 90, 2, 7, 25, 1, 60, 4, 12, 2)
#: Scales at which each layout is written out.
SCALES = (0.25, 0.5, 1.0, 2.5, 6.0)
FILLER = "one more word of running text that says little about its page".split()


def words(n: int, stop: bool, at: int) -> str:
    """``n`` words, starting at a place of the list, with a final stop or not."""
    return " ".join(FILLER[(at + i) % len(FILLER)] for i in range(n)) + ("." if stop else "")


def articles():
    """Layouts of articles with short and long, linked and plain paragraphs, between menus, notices and footers or alone."""
    for shift in range(12):
        sizes = PARAGRAPHS[shift:] + PARAGRAPHS[:shift]
        body = [f"+<p><a href=/>{{{n}!}}</a></p>" if i % (3 + shift % 3) == 2 else f"+<p>{{{n}}}</p>" for i, n in enumerate(sizes[:4 + shift % 5])]
        name = ("article", "main")[shift % 2]
        before = ["-<nav><a href=/>{2!}</a></nav>", f"-<div class=notice>{{{sizes[0]}}}</div>", f"-<div>{{{sizes[1]}}}</div>"][:shift % 4]
        after = [f"-<footer>{{{sizes[2]}}}</footer>", f"-<p>{{{sizes[3]}}}</p>", "-<p><a href=/>{2!}</a></p>"][:shift % 3]
        yield [*before, f"+<{name}>" + body[0][1:], *body[1:-1], body[-1] + f"</{name}>", *after]
        yield [*before, f"+<{name}><h1><a href=/>{{6!}}</a></h1>", f"+<p><a href=/>{{{sizes[2]}!}}</a> {{1!}}</p>", *body[:2], f"-<div class=promo>{{{sizes[4]}}}</div>", *body[2:]]


def samples():
    """Pages, each with (start, 1 or 0) of its pieces."""
    for layout in [*LAYOUTS, *articles()]:
        for scale in SCALES:
            page, spans = "", []
            for piece in layout:
                spans.append((len(page), int(piece[0] == "+")))
                # link texts keep their size: menus do not grow with a page
                page += re.sub(r"\{(\d+)(!?)\}", lambda m: words(max(1, round(int(m[1]) * (1 if m[2] else scale))), not m[2], len(page)), piece[1:])
            yield page, spans
