"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into flat blocks at block-level tags. Each block has its word count and its link
density, those of the blocks before and after it (Kohlschuetter, Fankhauser and Nejdl, 2010), the words of its wider
neighbourhood, and the share of the page's words and the link density of the element that holds it. These are what the
decision tree splits by first. Element names (inside an article, inside page furniture, a heading) and how much the
element's class, id and role have been learnt to speak for an article are weak features: a split by one has to be ``HANDICAP`` times as
good as the best by words and links. Tree and names are learnt from the small labelled table of
``html_labels``; there is no list of names. Blocks found to be the article are joined in page order.

Null pages count as empty and have an empty text, as have pages without a block of the article.
Nothing else is dropped or capped. Unclosed and stray tags, comments, CDATA, '<' in running text
and attributes with '>' are read as browsers do, near enough. Pages are read in one forward pass. Repeated rows give equal texts.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synblock.llm.html_labels import labelled

_TAG = re.compile(
    r"""<(?:!--(?P<comment>.*?)(?:-->|\Z)|[!?][^>]*+>|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>"'<]*+)(?P<attributes>(?:[^<>"']++|"[^"]*+"|'[^']*+')*+|[^<>]*+)>)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
#: Element names of the HTML standard by what they hold.
_RAW = frozenset("script style noscript template textarea title iframe select button svg object canvas audio video math datalist".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HOLDERS = frozenset("article aside body details dialog div fieldset figure footer form head header html main menu nav section table".split())
_KEPT_OPEN = _HOLDERS | frozenset("ol td ul".split())
_FURNITURE = frozenset("aside dialog footer form head header menu nav".split())

TEXT = ("words", "density", "words before", "density before", "words after", "density after", "words in 3 before", "words in 3 after", "share of holder", "density of holder")
WEAK = ("in article", "in furniture", "heading", "names")
HANDICAP = 2.0


class Element(NamedTuple):
    """An open element with what it passes on to the blocks in it."""

    name: str
    holder: int
    article: bool
    furniture: bool
    names: float
    tokens: tuple[str, ...] = ()
    parent: Element | None = None


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    heading: bool
    element: Element


ROOT = Element("", 0, False, False, 0.0)


def tokens_of(attributes: str) -> tuple[tuple[str, ...], bool]:
    """The words of an element's class, id and role, and whether it is hidden."""
    found, hidden = [], False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "role"):
            found += [x for x in re.split(r"[\s_-]+", value.lower()) if x]
        elif key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value)) or (key == "aria-hidden" and value == "true"):
            hidden = True
    return tuple(found), hidden


def blocks(page: str, weights: dict[str, float] | None = None) -> list[Block]:
    """Flat text blocks of a page in order, white space turned into single spaces; ``weights`` are those of names."""
    weights, out, stack, is_open = weights or {}, [], [ROOT], Counter()
    text: list[str] = []
    link: list[str] = []
    in_link = heading = False
    holders, at, size = 0, 0, len(page)
    endless: set[str] = set()  # names of raw elements that end nowhere below
    last = page.rfind(">")  # beyond it only a comment can begin

    def end() -> None:
        nonlocal text, link
        if text:
            whole = "".join(text)
            if words := (entities.unescape(whole) if "&" in whole else whole).split():
                linked = len("".join(link).split()) if link else 0
                out.append(Block(" ".join(words), len(words), min(linked, len(words)), heading, stack[-1]))
            text, link = [], []

    def put(s: str) -> None:
        if s:
            text.append(s)
            if in_link:
                link.append(s)

    def close(name: str) -> None:
        if not is_open[name]:
            return
        if name in ("p", "li"):  # not beyond the element that holds it
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    break
                if stack[i].name in _KEPT_OPEN:
                    return
        while True:
            last = stack.pop()
            is_open[last.name] -= 1
            if last.name == name:
                return

    while at < size:
        i = page.find("<", at)
        if i < 0:
            break
        m = _TAG.match(page, i) if i < last or page.startswith("<!--", i) else None
        if m is None:
            put(page[at : i + 1])
            at = i + 1
            continue
        put(page[at:i])
        at = m.end()
        if m["name"] is None:
            continue
        name, closing, attributes = m["name"].lower(), bool(m["end"]), m["attributes"]
        if name in _RAW:
            if not closing and not attributes.endswith("/") and name not in endless:
                stop = re.compile(rf"</{name}\b[^>]*+>?", re.I).search(page, at)
                if stop:
                    at = stop.end()
                    text.append(" ")
                elif name in ("script", "style"):
                    at = size
                else:
                    endless.add(name)
            continue
        if name in _BLOCK:
            end()
            in_link = False
            if name in _HEADINGS:
                heading = not closing
            elif not closing or name != "p":
                heading = False
        elif name in ("br", "img", "input", "wbr"):
            put(" ")
        elif name == "a":
            in_link = not closing
        if name not in _BLOCK or name in _VOID:
            continue
        if closing:
            close(name)
        else:
            close("p")
            if name in ("li", "option"):
                close(name)
            up = stack[-1]
            tokens, hidden = tokens_of(attributes) if attributes else ((), False)
            if name in _HOLDERS or name in ("ol", "ul"):
                holders += 1
            inner = name in _HOLDERS or name in ("ol", "ul")
            furniture = name != "body" and (up.furniture or hidden or (name in _FURNITURE and not (name == "header" and is_open["article"])))
            score = up.names + sum(weights.get(x, 0.0) for x in tokens)
            stack.append(Element(name, holders if inner else up.holder, up.article or name in ("article", "main"), furniture, score, tokens, up if tokens or up.tokens or up.parent else None))
            is_open[name] += 1
    put(page[at:])
    end()
    return out


def features(found: list[Block]) -> np.ndarray:
    """Of each block the features named in ``TEXT`` and ``WEAK``."""
    if not found:
        return np.zeros((0, len(TEXT) + len(WEAK)))
    words = np.array([b.words for b in found], float)
    linked = np.array([b.linked for b in found], float)
    _, holder = np.unique([b.element.holder for b in found], return_inverse=True)
    held, held_links = np.bincount(holder, words), np.bincount(holder, linked)
    flags = np.array([(b.element.article, b.element.furniture, b.heading, b.element.names) for b in found], float).reshape(-1, 4)
    if not flags[:, 0].any():
        flags[:, 0] = 0.5  # the page doesn't say where its article is
    density, sums, n = linked / words, np.r_[0.0, np.cumsum(words)], np.arange(len(found))
    near = lambda lo, hi: sums[np.clip(hi, 0, len(found))] - sums[np.clip(lo, 0, len(found))]
    before, after = (lambda x: np.r_[0.0, x[:-1]]), (lambda x: np.r_[x[1:], 0.0])
    share, link_share = held[holder] / sums[-1], held_links[holder] / held[holder]
    return np.column_stack([words, density, before(words), before(density), after(words), after(density), near(n - 3, n), near(n + 1, n + 4), share, link_share, flags])


def train(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 8, handicap: float = HANDICAP, weak: int = len(TEXT)) -> tuple:
    """A CART tree by Gini impurity: leaves ``(share,)`` and nodes ``(feature, threshold, low, high)``.

    What a split by a feature from ``weak`` on takes off the impurity counts ``1 / handicap``.
    """
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return (share,)
    best, whole = None, len(y) * share * (1 - share)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, c, n = x[order, f], np.cumsum(y[order]), len(y)
        k = np.flatnonzero(v[1:] > v[:-1]) + 1
        k = k[(k >= least) & (n - k >= least)]
        if len(k):
            a, b = c[k - 1] / k, (c[-1] - c[k - 1]) / (n - k)
            gain = (whole - k * a * (1 - a) - (n - k) * b * (1 - b)) / (handicap if f >= weak else 1.0)
            i = int(np.argmax(gain))
            if best is None or gain[i] > best[0] + 1e-12:
                best = (gain[i], f, (v[k[i]] + v[k[i] - 1]) / 2)
    if best is None or best[0] <= 1e-12:
        return (share,)
    low = x[:, best[1]] <= best[2]
    return (best[1], float(best[2]), *(train(x[s], y[s], depth - 1, least, handicap, weak) for s in (low, ~low)))


def path(tree: tuple, row: np.ndarray) -> tuple[list[int], bool]:
    """Features that decide on a block, and the verdict."""
    used = []
    while len(tree) > 1:
        used.append(tree[0])
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return used, tree[0] >= 0.5


def predict(tree: tuple, row: np.ndarray) -> bool:
    return path(tree, row)[1]


def name_weights(pages: list[str]) -> dict[str, float]:
    """Of each name in the labelled pages the logarithm of how much more often it holds blocks of the article than others, smoothed."""
    good, bad, total = Counter(), Counter(), Counter()
    for page in pages:
        for b in blocks(page):
            names, e = set(), b.element
            while e is not None:
                names.update(e.tokens)
                e = e.parent
            is_good = b.text[0] == "+"
            total[is_good] += 1
            (good if is_good else bad).update(names)
    odds = (total[True] + 1) / (total[False] + 1)
    return {x: float(np.log((good[x] + 1) / (bad[x] + 1) / odds)) for x in good | bad}


class Classifier(NamedTuple):
    tree: tuple
    weights: dict[str, float]


def classifier(pages: list[str] | None = None, handicap: float = HANDICAP) -> Classifier:
    """Learnt from the labelled table; with an infinite handicap, from words and links alone."""
    pages = labelled() if pages is None else pages
    weights, x, y = name_weights(pages), [], []
    for page in pages:
        found = blocks(page, weights)
        x.append(features(found))
        y += [b.text[0] == "+" for b in found]
    x = np.concatenate(x)
    return Classifier(train(x if np.isfinite(handicap) else x[:, : len(TEXT)], np.array(y, float), handicap=handicap), weights)


def main_text(page: str | None, by: Classifier) -> str:
    """The article of one page."""
    found = blocks(page or "", by.weights)
    return " ".join(b.text for b, row in zip(found, features(found), strict=True) if predict(by.tree, row))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id_col, url_col, text, n_chars)`` for every row of ``pages``."""
    by = classifier()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(p.as_py(), by) for p in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], [id_col, url_col, "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias(url_col), F.col(html_col).cast("string").alias("_h"))
    return rows.mapInArrow(of, f"`{id_col}` long, `{url_col}` string, text string, n_chars long")
