"""Main text by tag-path ratios: brute-force scores, what an article keeps, pages without named articles, deep nesting."""

import html
import re
import time
from html.parser import HTMLParser

import pytest

from lexigraph.llm import html_extract

BODY = "<p>" + "Some long sentence, with words and marks. " * 6 + "</p>"
FOLDER = "/root/testdata/sf0.001"


def plain(source):
    return " ".join(html.unescape(re.sub("<[^>]*>", " ", source)).split())


@pytest.mark.parametrize("at", [0, 1, 2])
@pytest.mark.parametrize("part", [
    '<h2 id="related-work">Related work</h2>', '<section id="social-impact">Impact here</section>', '<p class="notice">Notice it</p>', '<div class="share-price">12 EUR</div>',
    "<ul><li><a href=x>Source A</a></li><li><a href=y>Source B</a></li></ul>", "<header><h2>Own head</h2></header>", "<table><tr><td>1</td><td>2</td></tr></table>"])
def test_an_article_keeps_its_parts(part, at):
    parts = [BODY, BODY]
    parts.insert(at, part)
    whole = "".join(parts)
    assert html_extract.main_text(f"<nav><a>m</a></nav><article>{whole}</article><footer>foot</footer>") == plain(whole)


@pytest.mark.parametrize("part", ['<div class="share-buttons">Share this, now.</div>', '<aside>By the way, this.</aside>', '<section id="comments"><p>Nice post, friend. Wow, such.</p></section>',
                                  '<div class="ad-slot top">Buy, now!</div>', '<form>Sign, up.</form>', '<footer>Foot, note.</footer>', '<div role="navigation">Go, there.</div>'])
@pytest.mark.parametrize("frame", ["<article>{}</article>", "<div>{}</div>", "<body>{}</body>"])
def test_boilerplate_goes_inside_and_out(frame, part):
    for inner in (BODY + part + BODY, part + BODY + BODY, BODY + BODY + part):
        assert html_extract.main_text(frame.format(inner)) == plain(BODY + BODY)


def test_paths_decide_where_no_name_does():
    """Teasers without a telling name: their path fails the threshold, and passes if there is none."""
    teaser = "<div class=t2><span>Seven ways to do it</span></div>"
    page = f"<body><div class=x><h1>Title</h1>{BODY}{BODY}{BODY}<div class=z>{teaser * 6}</div></div></body>"
    assert html_extract.main_text(page) == "Title " + plain(BODY * 3)
    assert html_extract.main_text(page, 0.0) == plain(page)
    # A strong text outside the named article is content, a weak one isn't.
    page = f"<body><div class=lead>{BODY}</div><article><h1>Title</h1>{BODY * 9}</article><div class=z>{teaser}</div></body>"
    assert html_extract.main_text(page) == plain(BODY) + " Title " + plain(BODY * 9)


def test_pages_without_article_elements_give_the_same_text(spark):
    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        renamed = re.sub(r"<(/?)(article|main)\b", r"<\1div", r["html"])
        assert html_extract.main_text(renamed) == html_extract.main_text(r["html"])


class Brute(HTMLParser):
    """Paths of well-formed pages, by another parser."""

    def __init__(self, source):
        super().__init__()
        self.at, self.found = [], []
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        self.at.append((tag, dict(attrs).get("class", "").split()[:1]))

    def handle_endtag(self, tag):
        self.at.pop()

    def handle_data(self, data):
        if data.strip():
            path = "/".join(t + "".join(f".{c}" for c in cls) for t, cls in self.at if t not in html_extract.INLINE)
            self.found.append((path, data, any(t == "a" for t, _ in self.at)))


def test_scores_against_brute_force():
    page = (f'<body><div class="x y"><h1>Title</h1>{BODY}<p>Short <b>bold, here</b> one.</p><ul><li><a>Link, one</a></li><li>item; two</li></ul></div>'
            f'<div class="z"><p>Other. Text!</p>{BODY}</div></body>')
    found = Brute(page).found
    mark = lambda t: len(re.findall(r"[.,;:!?]", t))
    ratios = []
    for value in (len, mark):
        per = {p: sum(value(t) for q, t, a in found if q == p and not a) / sum(1 for q, *_ in found if q == p) for p, *_ in found}
        raw, k = [per[p] for p, *_ in found], {-2: 0.1, -1: 0.2, 0: 0.4, 1: 0.2, 2: 0.1}
        ratios.append([sum(w * raw[i + d] for d, w in k.items() if 0 <= i + d < len(raw)) / sum(w for d, w in k.items() if 0 <= i + d < len(raw)) for i in range(len(raw))])
    silent = {p for p, *_ in found if not any(q == p and not a for q, _, a in found)}
    want = [0.0 if p in silent else a * (0.5 + b) for (p, *_), a, b in zip(found, *ratios, strict=True)]
    parsed = html_extract._Page(page)
    nodes = [(parsed.path[e], len(t), link) for e, _, t, link in parsed.nodes if t.strip()]
    assert [n[1:] for n in nodes] == [(len(t), a) for _, t, a in found]
    same = lambda rows: [[a[0] == b[0] for b in rows] for a in rows]  # noqa: E731  equal paths are equal numbers
    assert same(nodes) == same(found)
    got, mean = html_extract.path_scores(nodes, [mark(t) for _, t, _ in found])
    assert got == pytest.approx(want) and mean == pytest.approx(sum(f * len(t) for f, (_, t, _) in zip(want, found, strict=True)) / sum(len(t) for _, t, _ in found))


@pytest.mark.parametrize("source", ["<div>" * 100_000 + "text, here" + "</div>" * 100_000, "<b>" * 100_000 + "<hr>" * 100_000 + "</x>" * 100_000 + "text, here",
                                    "<div><p>" + "<span>" * 100_000 + "<address>" * 50_000 + "text, here", "<li><i>" * 100_000 + "text, here"])
def test_deep_pages_take_time_in_proportion(source):
    start = time.process_time()
    assert html_extract.main_text(source).endswith("text, here")
    assert time.process_time() - start < 8  # quadratic work would take minutes
