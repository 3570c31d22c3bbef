"""Main text of HTML pages: flat text blocks, judged by a decision tree.

A page is cut into blocks wherever a block-level tag begins or ends.  A block is described by its own and its
neighbours' word counts and link densities and by the elements it stands in; the tree is trained on the small
labelled table of ``html_samples``.  Pages are read one by one inside tasks: nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .batches import add_columns
from .html_samples import samples

#: Tags that begin and end blocks (fixed values).
BLOCK = set("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select
summary table tbody td tfoot th thead tr ul""".split())
#: Tags without content; tags whose content is no markup and no text of the page; tags whose content is left out.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes noscript xmp".split())
LEFT_OUT = set("head template svg select datalist object audio video canvas".split())
#: Tags that an equal (or listed) start tag ends.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",), "a": ("a",)}
#: An implied end does not reach beyond these.
SCOPE = set("ul ol menu dl table div section article aside nav footer header form main body blockquote figure td th".split())
#: Tags that hold no main text, and words of class, id and role that say so: always, or unless the name is of a page's frame.
BOILER = set("nav footer aside form button menu dialog fieldset".split())
STRONG = set("""ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored comment comments
commentlist disqus discussion replies respond cookie cookies consent gdpr newsletter subscribe nav navbar navigation menu
breadcrumb breadcrumbs footer masthead pagination pager login signin signup copyright popup modal paywall disclaimer""".split())
WEAK = set("""sidebar header banner notice notices alert widget widgets social share sharing related recommended promo
promoted topbar toolbar overlay search complementary contentinfo teaser teasers""".split())
FRAME = set("with has no content main page wrapper layout container".split())

TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<([/!?]?)([a-zA-Z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: What the tree sees of a block.
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "scope", "boiler", "heading", "sentence")


class Element:
    """An open element and what it passes on to the text in it."""

    __slots__ = ("name", "gone", "boiler", "weak", "article", "main", "link", "heading")

    def __init__(self, name: str, attributes: str, up: "Element | None"):
        names, hidden = attribute_words(attributes) if attributes.strip(" /") else (set(), False)
        self.name = name
        self.gone = bool(up and up.gone) or name in LEFT_OUT
        self.link = bool(up and up.link) or name == "a"
        self.heading = bool(up and up.heading) or name in ("h1", "h2", "h3", "h4", "h5", "h6")
        hints = set() if name in ("html", "body") else names
        self.boiler = bool(up and up.boiler) or name in BOILER or hidden or bool(hints & STRONG)
        within = bool(up and (up.article or up.main))
        self.article = (bool(up and up.article) or name == "article" or "articlebody" in names) and not self.boiler
        self.main = (bool(up and up.main) or name == "main" or "main" in names and name == "div") and not self.boiler
        weak = name == "header" and not within or bool(hints & WEAK) and not hints & FRAME and not (within and "header" in hints)
        # an article inside what looked like a side part was no side part
        self.weak = (bool(up and up.weak) or weak) and not (name in ("article", "main") and not hints & WEAK)


def attribute_words(attributes: str) -> tuple[set[str], bool]:
    """Words of class, id, role and itemprop, and whether the element is hidden."""
    words, hidden = set(), False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        else:
            words |= {w.lower() for w in WORD.findall(value)} | ({value.lower()} if name == "itemprop" else set())
    return words, hidden


def blocks(page: str) -> list[tuple]:
    """The text blocks of a page in order: (text, words, linked words, in an article, in main, boilerplate, heading, start).

    Character references are decoded once, white space is one space, empty blocks are left out.  Tags may be
    unclosed or closed twice, quotes and comments unclosed.
    """
    out: list[tuple] = []
    stack: list[Element] = []
    open_: Counter = Counter()  # open elements by name, so that the stack is only searched for what it holds
    run: list[str] = []
    state = {"words": 0, "linked": 0, "start": 0, "of": None}

    def flush() -> None:
        text = " ".join("".join(run).split())
        if text:
            e = state["of"]
            n = text.count(" ") + 1
            out.append((text, n, min(state["linked"], n), bool(e and e.article), bool(e and e.main),
                        bool(e and (e.boiler or e.weak)), bool(e and e.heading), state["start"]))
        run.clear()
        state.update(linked=0, of=None)

    def add(raw: str, at: int) -> None:
        top = stack[-1] if stack else None
        if not raw or top and top.gone:
            return
        text = html.unescape(raw) if "&" in raw else raw
        n = len(text.split())
        if n and state["of"] is None:
            state.update(of=top or Element("html", "", None), start=at)
        if top and top.link:
            state["linked"] += n
        run.append(text)

    def close(upto: int) -> None:
        open_.subtract(e.name for e in stack[upto:])
        del stack[upto:]

    def end_implied(names: tuple[str, ...]) -> None:
        """Close the innermost element of these names, unless an element of SCOPE stands between."""
        if any(open_[n] > 0 for n in names):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name in names:
                    return close(i)
                if stack[i].name in SCOPE:
                    return

    at = 0
    while True:
        m = TAG.search(page, at)
        if not m:
            add(page[at:], at)
            break
        add(page[at:m.start()], at)
        at, name = m.end(), (m.group(2) or "").lower()
        kind = m.group(1)
        if not name or kind in ("!", "?"):
            continue
        if kind == "/":
            if name in BLOCK:
                flush()
            if open_[name] > 0:
                i = next(i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name)
                # an end tag of an inline element does not end a block around it
                if name in BLOCK or name in LEFT_OUT or not any(e.name in BLOCK for e in stack[i + 1:]):
                    close(i)
            continue
        if name in RAW:
            end = re.compile(f"</{name}\\b", re.I).search(page, at)
            if end is None:
                break
            at = end.start()
            continue
        if name in BLOCK:
            flush()
            if open_["head"] > 0 and name != "head":  # the body begins
                close(next(i for i, e in enumerate(stack) if e.name == "head"))
            end_implied(("p",))
        elif name == "br":
            run.append(" ")
        if name in ENDS:
            end_implied(ENDS[name])
        if name not in VOID and not (m.group(3).endswith("/") and name in LEFT_OUT):
            stack.append(Element(name, m.group(3), stack[-1] if stack else None))
            open_[name] += 1
    flush()
    return out


def features(found: list[tuple]) -> np.ndarray:
    """FEATURES of each block; ``scope``: 1 inside the page's article (or main part), -1 beside it, 0 where there is none."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b[1] for b in found], float)
    density = np.array([b[2] for b in found]) / words
    article, main, boiler, heading = (np.array([b[i] for b in found], bool) for i in (3, 4, 5, 6))
    inside = article if (article & ~boiler).any() else main
    scope = np.where(inside, 1.0, -1.0) if (inside & ~boiler).any() else np.zeros(len(found))
    sentence = np.array([b[0][-1] in ".!?:;…\"'”»)" for b in found], float)
    # a neighbour counts if it stands in the same kind of place: a menu above an article says nothing about its heading
    alike = (scope[1:] == scope[:-1]) & (boiler[1:] == boiler[:-1])
    before, after = (lambda x: np.append(0.0, x[:-1] * alike)), (lambda x: np.append(x[1:] * alike, 0.0))
    return np.column_stack([words, density, before(words), before(density), after(words), after(density), scope,
                            boiler.astype(float), heading.astype(float), sentence])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2) -> tuple:
    """A binary tree by Gini impurity: (feature, threshold, left, right), or the share of main blocks in a leaf.

    At most ``depth`` levels, at least ``least`` rows a leaf; ties go to the first feature and the lowest threshold.
    """
    share = float(y.mean()) if len(y) else 0.0
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, left = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y) + 1)
        cut = np.flatnonzero(v[:-1] < v[1:])
        cut = cut[(n[cut] >= least) & (len(y) - n[cut] >= least)]
        if not len(cut):
            continue
        nl, nr, a, b = n[cut], len(y) - n[cut], left[cut], left[-1] - left[cut]
        impurity = a * (nl - a) / nl + b * (nr - b) / nr
        i = int(impurity.argmin())
        if best is None or impurity[i] < best[0] - 1e-12:
            best = (float(impurity[i]), f, float((v[cut[i]] + v[cut[i] + 1]) / 2))
    if best is None or best[0] >= share * (1 - share) * len(y) - 1e-12:
        return (share,)
    _, f, t = best
    low = x[:, f] <= t
    return (f, t, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def judge(tree: tuple, x: np.ndarray) -> np.ndarray:
    """The share of main blocks in the leaf of each row."""
    out = np.zeros(len(x))

    def walk(node: tuple, rows: np.ndarray) -> None:
        if len(node) == 1:
            out[rows] = node[0]
            return
        low = x[rows, node[0]] <= node[1]
        walk(node[2], rows[low])
        walk(node[3], rows[~low])

    walk(tree, np.arange(len(x)))
    return out


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """FEATURES and labels of all blocks of the labelled table."""
    xs, ys = [], []
    for page, spans in samples():
        found = blocks(page)
        starts = np.array([s for s, _ in spans])
        at = np.searchsorted(starts, [b[7] for b in found], side="right") - 1
        xs.append(features(found))
        ys.append(np.array([spans[i][1] for i in at], float))
    return np.concatenate(xs), np.concatenate(ys)


@lru_cache(maxsize=1)
def trained() -> tuple:
    """The tree of the labelled table; the same in every process."""
    return grow(*labelled())


def main_text(page: str | None, tree: tuple | None = None) -> str:
    """The main blocks of a page, joined by line feeds; empty for null, empty or pages without main text."""
    found = blocks(page or "")
    if not found:
        return ""
    keep = judge(tree or trained(), features(found)) >= 0.5
    return "\n".join(b[0] for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, page: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns but the page) with ``text`` (main text) and ``n_chars`` (its code points) of every row.

    Rows are independent: null and empty pages give the empty text, equal rows and ids stay as they are, columns named
    ``text`` or ``n_chars`` are replaced.  A page of any length is read whole.
    """
    tree = trained()

    def work(found: list) -> dict[str, list]:
        texts = [main_text(p, tree) for p in found]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    keep = [c for c in pages.columns if c != page] if keep is None else keep
    return add_columns(pages, keep, page, "text string, n_chars long", work)
