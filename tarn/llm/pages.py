"""Main text of web pages: flat blocks, their neighbours' word counts and link densities, and a decision tree.

A page is cut into text blocks at block-level tags. Each block has its word count, link density (share of words in
links) and those of the blocks before and after it, beside what its enclosing elements say: their names, and words of
their class, id and role that speak for furniture, or only may. A decision tree, trained here on a small table of
labelled blocks, decides which blocks are the article's.

Defined cases: a null or empty page has empty text; broken markup (unclosed or cut-off tags, entities and comments)
is read as far as it goes; character references are decoded once; pages of any length are read whole; repeated rows
are each extracted; other columns are ignored.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import _store

# Element names of HTML by what they do to text.
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre section select summary table tbody td template tfoot th thead title tr ul".split())
SILENT = frozenset("script style head title template iframe audio video canvas".split())
RAW = frozenset("script style title textarea".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements and words of class, id and role that tell of a page's furniture and of its article.
FURNITURE = frozenset("nav header footer aside form menu dialog button select textarea".split())
FURNITURE_WORDS = re.compile(r"(?:^|[^a-z])(?:ads?|adverts?|advertisements?|banners?|breadcrumbs?|comments?|comment-?list|cookies?|consent|copyright|disqus|footer|foot|head|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|pagination|popup|promo|promoted|related|replies|reply|respond|share|sharing|sidebar|side|signup|skip|social|sponsor|sponsored|subscribe|tags|toolbar|widget|gdpr)(?:$|[^a-z])")
# Of these, words that also name parts of an article: beside one of its words they are a hint and no more.
HINT_WORDS = re.compile(r"(?:^|[^a-z])(?:head|header|notice|notices|related|reply|respond|side|skip|social|tags)(?:$|[^a-z])")
ARTICLE_WORDS = re.compile(r"(?:^|[^a-z])(?:article|articlebody|body|content|entry|main|post|story|text)(?:$|[^a-z])")

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_CLOSE = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}
_WHITE = re.compile(r"\s+")

FEATURES = ["words", "density", "words_before", "density_before", "words_after", "density_after", "furniture", "named_furniture", "hinted", "article", "heading"]


@dataclass
class Block:
    text: str
    words: int
    linked: int
    furniture: bool
    named: bool
    hinted: bool
    article: bool
    heading: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order, without those that no reader sees."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[bool, ...]]] = []  # name; silent, furniture, named, hinted, article, heading
    now = (False,) * 6
    unclosed: set[str] = set()
    text: list[str] = []
    linked: list[str] = []
    links = 0

    def end() -> None:
        whole = _WHITE.sub(" ", html.unescape("".join(text))).strip()
        if whole:
            in_links = _WHITE.sub(" ", html.unescape(" ".join(linked))).strip()
            found.append(Block(whole, whole.count(" ") + 1, min(whole.count(" ") + 1, len(in_links.split())), *now[1:]))
        text.clear()
        linked.clear()

    at, size = 0, len(page)
    while at < size:
        tag = page.find("<", at)
        if tag < 0:
            tag = size
        m = _TAG.match(page, tag) if tag < size else None
        piece = page[at : tag if m or tag == size else tag + 1]
        if piece and not now[0]:
            text.append(piece)
            if links:
                linked.append(piece)
        if m is None:
            at = tag + 1 if tag < size else size
            continue
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA[") and not now[0]:
                text.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in BLOCK:
            end()
        if closing:
            if name == "a":
                links = max(0, links - 1)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    now = stack[k][1]
                    del stack[k:]
                    break
            continue
        if name == "a":
            links += 1
        if name in VOID or (m[3] or "").endswith("/"):
            continue
        said, hidden = "", False
        for a in _ATTRIBUTE.finditer(m[3] or ""):
            key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
            if key in ("class", "id", "role"):
                said += " " + value
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                hidden = True
        if name in ("p", "li"):  # the end tag may be left out
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    now = stack[k][1]
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK:
                    break
        stack.append((name, now))
        telling = bool(said and ARTICLE_WORDS.search(said))
        article = name in ("article", "main") or telling
        furniture = name in FURNITURE and not (name == "header" and now[4])
        named = bool(said and FURNITURE_WORDS.search(said)) and name not in ("html", "body", "article", "main")
        hinted = named and telling and not FURNITURE_WORDS.search(_without_hints(said))
        now = (now[0] or name in SILENT or hidden, now[1] or furniture, now[2] or (named and not hinted), now[3] or hinted, now[4] or article, now[5] or name in HEADINGS)
        if name in RAW and name not in unclosed:  # what it holds is no markup, if it is closed at all
            close = _CLOSE[name].search(page, at)
            if close is None:
                unclosed.add(name)
            if close or name in ("script", "style"):
                at = close.start() if close else size
    end()
    return found


def _without_hints(said: str) -> str:
    """Class words without those that only hint; twice, since two of them may share the sign between them."""
    return HINT_WORDS.sub(" ", HINT_WORDS.sub(" ", said))


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block."""
    words = np.array([0, *(b.words for b in found), 0], float)
    density = np.array([0, *(b.density for b in found), 0], float)
    own = np.array([[b.furniture, b.named, b.hinted, b.article, b.heading] for b in found], float).reshape(-1, 5)
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], own])


# Labelled examples, invented for this purpose: words of the blocks and whether they belong to the article.
# a: article, n: furniture; [..] marks linked words. Each line is one layout.
_LAYOUTS = [
    "<nav>n:[3] n:[1] n:[2]</nav> <article><h1>a:6</h1> a:40 a:62 a:1 a:18</article> <footer>n:9</footer>",
    "<header>n:4</header> <nav>n:[1] n:[1]</nav> <main><h1>a:3</h1> a:22 a:2 a:90</main> <aside>n:12 n:[5]</aside> <footer>n:5 n:30</footer>",
    "<div class=ad>n:14</div> <article>a:2 a:1 a:8 a:45</article> <div class=ad>n:35</div>",
    "<div class=menu>n:[2] n:[3]</div> <div class=content>a:7 a:55 a:3 a:80</div> <div class=comments>n:25 n:40 n:3</div>",
    "<div class=header>n:3</div> <div>a:30 a:44 a:9 a:60</div> <div>n:[4] n:[6] n:[3]</div> <div class=footer>n:8</div>",
    "<div>n:[1] n:[2] n:[1] n:2</div> <div>a:28 a:75 a:33 a:51</div> <div>n:3 n:[2] n:4</div>",
    "<article><h1>a:9</h1> a:120 <aside>n:20</aside> a:64 <section class=comments>n:30 n:22</section></article> <footer>n:18</footer>",
    "<div class=cookie-notice>n:26</div> <article>a:13 a:4 a:1</article> <section id=comments>n:50 n:60</section> <form>n:6 n:2</form>",
    "<main>a:5 a:[2] a:48 a:70 <div class=related>n:[6] n:[8]</div> a:15</main>",
    "<div class=sidebar>n:16 n:[4]</div> <div id=main>a:11 a:2 a:37</div> <div class=newsletter>n:24</div>",
    "n:[2] n:[3] n:[1] a:41 a:66 a:29 n:[4] n:[2] n:5",
    "<h1>a:8</h1> a:53 <h2>a:3</h2> a:31 a:19 <footer>n:12</footer>",
    # furniture within the article, short and long
    "<article>a:1 <aside>n:1</aside> a:2 <form>n:1</form> a:70 <nav>n:2 n:[1]</nav> a:3 <footer>n:4</footer></article>",
    "<article><header><h1>a:5</h1> a:4</header> a:33 <aside>n:85</aside> a:21 <form>n:45 n:1</form> <footer>n:60</footer></article>",
    "<main><nav>n:[2] n:[2]</nav> a:9 a:1 <aside>n:44 n:7</aside> a:52 <form>n:3</form></main> <footer>n:70</footer>",
    "<article>a:16 <div class=ad>n:1</div> a:1 <div class=advert>n:66</div> a:90 <div class=share>n:2 n:[1]</div> <div class=newsletter>n:31</div></article>",
    "<article>a:3 <div class=comment-body>n:38</div> <div id=comments>n:1 n:95</div></article>",
    "<article>a:24 a:[3] a:6 a:1 a:[1] a:110 a:2 <ul>a:4 a:3 a:[2]</ul> <table>a:1 a:1</table> a:5</article>",
    # furniture as long as articles, without any article element
    "<nav>n:40 n:[1]</nav> a:60 a:34 <aside>n:90 n:55</aside> a:47 <form>n:50</form> <footer>n:100</footer>",
    "<div id=sidebar>n:80 n:41</div> a:72 a:38 a:55 <div class=comments>n:64 n:77 n:30</div> <div class=notice>n:48</div>",
    "<header>n:35 n:1</header> <div class=post>a:2 a:1 a:61 a:1 a:17</div> <div class=cookie>n:58</div>",
    # class words of both sorts: an article's own head, and what only looks like one
    "<div class=post-header><h1>a:7</h1> a:4</div> <div class=post-body>a:66 a:40</div> <div class=post-footer>n:14</div>",
    "<div class=article-header><h1>a:5</h1></div> <div class=article-text>a:58 a:2 a:71</div> <div class=article-comments>n:44 n:29</div>",
    "<div class=main-content><p class=skip-content>a:31</p> a:48 <p class=content-tags>n:[2] n:[1]</p> a:22</div>",
    "<div class=content-header><p>a:19</p> a:25</div> <div class=entry>a:80</div> <div class=related-content>n:[7] n:[5] n:[6]</div>",
    "<div class=header-main>n:[2] n:[1] n:[1]</div> <div class=text>a:27 a:36</div> <div class=social-content>n:[1] n:[1]</div>",
    "<div class=side-content>n:[3] n:[4] n:2</div> <article>a:33 <div class=notice-text>a:41 a:28</div> a:17</article>",
    "<div class=main-head>n:[1] n:[2]</div> <main>a:14 a:95</main> <div class=reply-body>a:38 a:62</div>",
    # lists of links that an article has, whatever stands beside them
    "<article>a:[1] a:[2] a:30 a:[8] a:[3] a:[4] a:[2]</article> <footer>n:9</footer>",
    "<main>a:[6] a:12 a:[1] a:[1] a:[1] a:2 a:[12] a:[5] a:1</main> <nav>n:[2] n:[1]</nav>",
    "<article><h1>a:[4]</h1> a:[3] a:[2] a:61 a:[9] a:[14] a:1 a:[1]</article>",
    "<nav>n:[1]</nav> <div class=content>a:[2] a:[2] a:1 a:[7] a:40 a:[3]</div>",
    # bare pages, down to their last block
    "a:41 a:66 a:30", "a:12 a:3", "<h1>a:4</h1> a:20 a:7", "<nav>n:[2] n:[1]</nav> a:30 a:3", "a:1 a:2 a:30 a:9", "<h1>a:2</h1> a:9", "a:25 a:80 a:1", "a:5", "a:17", "a:2",
    # nothing but words and links of a block and its neighbours
    "n:[1] n:[2] n:[1] a:6 a:54 a:3 a:47 a:[2] a:68 n:[3] n:[2] n:[4] n:[1]",
    "n:2 n:[3] n:[2] a:88 a:12 a:42 n:[1] n:[1] n:6",
    "n:[6] n:[9] n:[7] a:35 a:24 a:57 a:8 a:61 n:[8] n:[5] n:[11]",
    "<div>n:[2] n:[2] n:[2] n:[2]</div> <div>a:9 a:21 a:45 a:33</div> <div>n:[2] n:[3]</div>",
]


def _examples() -> tuple[np.ndarray, np.ndarray]:
    rows, labels = [], []
    for layout in _LAYOUTS:
        page, marks = [], []
        for part in re.findall(r"<[^>]*>|[an]:\[?\d+\]?", layout):
            if part[0] == "<":
                page.append(part)
                continue
            marks.append(part[0] == "a")
            words = " ".join(["word"] * int(re.sub(r"\D", "", part)))
            page.append(f"<div><a href=x>{words}</a></div>" if "[" in part else f"<div>{words}</div>")
        found = blocks("".join(page))
        rows.append(features(found))
        labels += marks
    return np.vstack(rows), np.array(labels, float)


@dataclass
class Tree:
    """A binary decision tree: at each node a feature and a threshold, or the share of article blocks."""

    feature: int = -1
    threshold: float = 0.0
    low: Tree | None = None
    high: Tree | None = None
    share: float = 0.0

    @staticmethod
    def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> Tree:
        """By the largest fall of the Gini impurity; ties go to the earlier feature and the lower threshold."""
        node = Tree(share=float(y.mean()))
        if depth == 0 or len(y) < 2 * least or node.share in (0.0, 1.0):
            return node
        best = (len(y) * node.share * (1 - node.share) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for t in (values[:-1] + values[1:]) / 2:
                low = y[x[:, f] <= t]
                high = y[x[:, f] > t]
                if min(len(low), len(high)) >= least:
                    impurity = sum(len(s) * s.mean() * (1 - s.mean()) for s in (low, high))
                    if impurity < best[0] - 1e-12:
                        best = (impurity, f, float(t))
        if best[1] < 0:
            return node
        node.feature, node.threshold = best[1], best[2]
        side = x[:, node.feature] <= node.threshold
        node.low, node.high = Tree.grow(x[side], y[side], depth - 1, least), Tree.grow(x[~side], y[~side], depth - 1, least)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0 or self.low is None or self.high is None:
            return np.full(len(x), self.share)
        out = np.empty(len(x))
        side = x[:, self.feature] <= self.threshold
        out[side], out[~side] = self.low.predict(x[side]), self.high.predict(x[~side])
        return out


@functools.lru_cache(maxsize=1)
def tree() -> Tree:
    return Tree.grow(*_examples())


def main_text(page: str | None) -> str:
    """The article's blocks, joined in page order by one line feed."""
    found = blocks(page or "")
    if not found:
        return ""
    keep = tree().predict(features(found)) >= 0.5
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, html_column: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per row: the key columns, text and n_chars."""
    _store.ship(pages.sparkSession)
    rows = pages.select(*keys, F.col(html_column).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [main_text(p.as_py()) for p in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keys, "text", "n_chars"])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{kinds}, text string, n_chars bigint")
