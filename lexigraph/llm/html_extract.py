"""Main text of a web page by tag-path ratios.

Every text node has a path: the names (and first class) of its elements from the root down. Per path, the text length and
the punctuation marks are summed and set against the number of nodes; the ratios are given back to the nodes in page
order, smoothed over neighbours, fused by multiplication and cut at a share of their length-weighted mean. The paths that pass
are content, and the smallest element that holds all of their text is the root. Element names are a prior: boilerplate
elements take no part, and where an ``article`` or ``main`` holds nearly all chosen text, it is the root and text outside it has to
pass twice the threshold. Inside the root a text node stays if its path passes or it stands between nodes that do. What is left is
decided by its branch, the largest element around it without chosen text: headings, paragraphs, lists, tables and
the like belong to the article (but for lists of links), other elements only where the root is an ``article`` or ``main``.

A word in a class or id marks boilerplate only on ``div``, ``aside``, ``section``, ``ul``, ``ol`` and ``form``, and only if all of the token says so
(``share-buttons``, not ``share-price``). A ``header`` inside an article is part of it.

Null or empty html, or a page without text: empty text. Unclosed or crossing tags are closed as browsers do for the
common cases. Repeated rows are treated alike. The whole page is read in one pass, however deep its elements are nested; nothing is capped.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names and attribute words of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
                   "strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object select".split())
BOILER_TAGS = frozenset("nav header footer aside form button dialog menu head fieldset".split()) | RAW
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# What boilerplate is called, and what its parts are called besides.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsors sponsored promo promos promotion nav navbar navigation menu menus "
    "breadcrumb breadcrumbs masthead footer sidebar rail widget widgets comment comments disqus respond replies reply cookie cookies consent gdpr notice "
    "notices alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing social related recommend recommended "
    "recommendations pagination pager toolbar hidden disclaimer paywall".split())
NEUTRAL_WORDS = frozenset(
    "area bar block box bottom button buttons center col column container content form group header icons inner item items left links list main message "
    "outer page panel post posts primary right row secondary section site slot text top unit up wrap wrapper".split())
BOILER_PLACES = frozenset("div aside section ul ol form".split())
#: What an article may be, and what it is made of besides paragraphs that pass.
BOXES = frozenset("div section article main body td center".split())
STRUCTURE = frozenset("h1 h2 h3 h4 h5 h6 hgroup header p ul ol dl table pre blockquote figure address details".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
CLOSE_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
                    "h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("ul ol table article section div main body td th blockquote aside nav header footer form".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|"
                    r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTR = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"'>]|$)""", re.I)


def _says_boilerplate(token: str) -> bool:
    parts = [p for p in re.split(r"[-_]+", token.lower()) if p]
    return any(p in BOILER_WORDS for p in parts) and all(p in BOILER_WORDS or p in NEUTRAL_WORDS for p in parts)


class _Page:
    """Elements in page order (parent, end of its branch, tag, boilerplate or not, path) and text nodes of one page.

    An element's branch is the run of elements from it up to its ``end``, so being inside is a comparison of numbers.
    """

    def __init__(self, source: str):
        self.parent, self.end, self.tag, self.boiler, self.named, self.path = [-1], [0], ["#root"], [False], [False], [0]
        self.paths: dict[tuple[int, str], int] = {}
        self.nodes: list[tuple[int, int, str, bool]] = []  # element, block, text, inside a link
        self.stack, self.where, self.scopes, self.cells = [0], {}, [0], [0]
        self._parse(source)
        self._close(0)

    def _open(self, tag: str, raw: str) -> None:
        up = self.stack[-1]
        words, named = [], tag in ("article", "main")
        boiler = tag in BOILER_TAGS and not (tag == "header" and self.named[up])
        for m in _ATTR.finditer(raw) if raw.strip() else ():
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                words += value.split()
            elif name == "itemprop":
                named = named or value.lower() == "articlebody"
            elif name == "role":
                boiler, named = boiler or value.lower() in BOILER_ROLES, named or value.lower() in ("main", "article")
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                boiler = True
        boiler = boiler or tag in BOILER_PLACES and any(map(_says_boilerplate, words))
        at = len(self.parent)
        self.parent.append(up)
        self.end.append(0)
        self.tag.append(tag)
        self.boiler.append(boiler or self.boiler[up])
        self.named.append(named or self.named[up])
        step = (self.path[up], tag + (f".{words[0]}" if words else ""))
        self.path.append(self.path[up] if tag in INLINE else self.paths.setdefault(step, len(self.paths) + 1))
        self.where.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPE:
            self.scopes.append(len(self.stack))
            if tag not in ("td", "th"):
                self.cells.append(len(self.stack))
        self.stack.append(at)

    def _close(self, k: int) -> None:
        """Closes the open elements from place ``k`` of the stack on."""
        while len(self.stack) > k:
            e = self.stack.pop()
            self.end[e] = len(self.parent)
            if e:
                self.where[self.tag[e]].pop()
            for marks in (self.scopes, self.cells):
                if marks and marks[-1] == len(self.stack):
                    marks.pop()

    def _parse(self, source: str) -> None:
        block, at, where = 0, 0, self.where
        position, n = 0, len(source)
        while at < n:
            m = _TOKEN.search(source, at)
            start = m.start() if m else n
            if start > position and not self.boiler[self.stack[-1]]:
                self.nodes.append((self.stack[-1], block, source[position:start], bool(where.get("a"))))
            if not m:
                break
            at = position = m.end()
            slash, name, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if name is None:
                continue
            tag = name.lower()
            if tag not in INLINE:
                block += 1
            last = (where.get(tag) or [0])[-1]
            if slash:
                if last and not (tag in INLINE and self.scopes[-1] > last):
                    self._close(last)
                continue
            if tag in CLOSES or tag in CLOSE_P:
                ends = CLOSES.get(tag, set()) | ({"p"} if tag in CLOSE_P else set())
                # The innermost element that the new one ends, unless a scope lies between.
                k = max((where[t][-1] for t in ends if where.get(t)), default=0)
                if k and k >= (self.cells if tag == "tr" else self.scopes)[-1]:
                    self._close(k)
            if tag in VOID or raw.endswith("/") and tag in ("svg", "path", "br", "img"):
                continue
            self._open(tag, raw)
            if tag in RAW:  # nothing inside is markup or text
                end = _raw_end(tag).search(source, at)
                at = position = end.end() if end else n
                self._close(len(self.stack) - 1)


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


def _smooth(values: list[float]) -> list[float]:
    kernel = (0.1, 0.2, 0.4, 0.2, 0.1)  # near a Gaussian of standard deviation 1
    out = []
    for i in range(len(values)):
        num = den = 0.0
        for k, w in zip(range(i - 2, i + 3), kernel, strict=True):
            if 0 <= k < len(values):
                num, den = num + w * values[k], den + w
        out.append(num / den)
    return out


def _is_named(page: _Page, e: int) -> bool:
    return e > 0 and page.named[e] and not page.named[page.parent[e]] and not page.boiler[e]


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def path_scores(nodes: list[tuple[int, int, bool]], marks: list[int]) -> tuple[list[float], float]:
    """Fused score of each text node ``(path, length, inside a link)`` and the length-weighted mean. Text in links counts as none."""
    length, mark, count = {}, {}, {}
    for (p, n, link), k in zip(nodes, marks, strict=True):
        count[p] = count.get(p, 0) + 1
        length[p] = length.get(p, 0) + (0 if link else n)
        mark[p] = mark.get(p, 0) + (0 if link else k)
    text_ratio = _smooth([length[p] / count[p] for p, *_ in nodes])
    mark_ratio = _smooth([mark[p] / count[p] for p, *_ in nodes])
    fused = [a * (0.5 + b) if length[p] else 0.0 for (p, *_), a, b in zip(nodes, text_ratio, mark_ratio, strict=True)]
    return fused, sum(f * n for f, (_, n, _) in zip(fused, nodes, strict=True)) / sum(n for _, n, _ in nodes)


def main_text(source: str | None, share: float = 0.3) -> str:
    """The article's text; ``share`` of the length-weighted mean score is the threshold of a path."""
    if not source:
        return ""
    page = _Page(source)
    nodes = [(e, block, entities.unescape(t), link) for e, block, t, link in page.nodes]
    full = [x for x in nodes if x[2].strip()]
    if not full:
        return ""
    fused, mean = path_scores([(page.path[e], len(t), link) for e, _, t, link in full], [len(PUNCTUATION.findall(t)) for _, _, t, _ in full])
    best: dict[int, float] = {}
    for (e, *_), f in zip(full, fused, strict=True):
        best[page.path[e]] = max(best.get(page.path[e], 0.0), f)
    passes = {p for p, f in best.items() if f >= share * mean and f > 0} or set(best)
    strong = {p for p in passes if best[p] >= 2 * share * mean}

    def mass_of(chosen) -> list[int]:
        """Chosen text in each element's branch."""
        mass = [0] * len(page.parent)
        for e, _, t, _ in chosen:
            mass[e] += len(t)
        for e in range(len(mass) - 1, 0, -1):
            mass[page.parent[e]] += mass[e]
        return mass

    chosen = [x for x in full if page.path[x[0]] in passes]
    mass = mass_of(chosen)
    article = max((e for e in range(len(mass)) if _is_named(page, e) and mass[e] >= 0.8 * mass[0]), default=0)
    if article:
        chosen = [x for x in chosen if article <= x[0] < page.end[article] or page.path[x[0]] in strong]
        mass = mass_of(chosen)
    root = max(e for e in range(len(mass)) if mass[e] == mass[0])  # the last of them is the innermost
    inside = lambda e, top: top <= e < page.end[top]
    while root and page.tag[root] not in BOXES:  # a single paragraph is not the whole article: its heading stands beside it
        root = page.parent[root]
    if article and inside(root, article):
        root = article

    # The branch of each element without chosen text, and how much of it is links.
    branch = list(range(len(mass)))
    words, linked = [0] * len(mass), [0] * len(mass)
    for e in range(1, len(mass)):
        if not mass[e] and not mass[page.parent[e]]:
            branch[e] = branch[page.parent[e]]
    for e, _, t, link in full:
        words[branch[e]] += len(t.strip())
        linked[branch[e]] += len(t.strip()) if link else 0
    heads = {branch[e] for e in range(len(mass)) if page.tag[e] in HEADINGS}
    picked = [(e, block) for e, block, *_ in chosen]
    first, last = picked[0][1], picked[-1][1]

    def stays(e: int, block: int) -> bool:
        if mass[e] or first <= block <= last and inside(e, root):
            return not article or inside(e, article) or page.path[e] in strong
        if not inside(e, root):
            return False
        top = branch[e]
        if article and inside(e, article):
            return True
        if page.tag[top] == "header" and top not in heads or linked[top] > 0.7 * words[top]:
            return False
        return page.tag[top] in STRUCTURE

    blocks: dict[int, list[str]] = {}
    for e, block, t, _ in nodes:
        if stays(e, block):
            blocks.setdefault(block, []).append(t)
    return " ".join(x for x in (" ".join("".join(parts).split()) for parts in blocks.values()) if x)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (its code points), one row per row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(h) for h in b.column(2).to_pylist()], pa.string())],
                                             ["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    out = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
