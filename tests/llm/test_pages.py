import html
import re

import pytest

from tarn.llm import pages

from .helpers import DATA, HAS_DATA


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        (None, ""),
        ("<article><p>x &amp;amp; y &lt;b&gt; &#233;\n\t z</p><!-- <p>no</p> --><p> </p><p>two</article>", "x &amp; y <b> é z\ntwo"),
        ("<nav><a href=/>home</a></nav><article><h1>T</h1><p>one <b>two</b><br>three</p><script>var p='</p>'</script></article><footer>f</footer>", "T\none two\nthree"),
        ("<article><p>keep</p><div class=comments><p>no</p></div><aside>no</aside><form>no</form><p>also</p></article>", "keep\nalso"),
        ("<article><p>a < b</p></article>", "a < b"),
        ("<body><article><p hidden>no</p><p style='display: none'>no</p><p>yes</p>", "yes"),
        ("<article><p>cut off", "cut off"),
        ("<article><p>Let <math><mi>x</mi></math> be the value</p><noscript>shown</noscript><object>told</object></article>", "Let x be the value\nshown\ntold"),
        ("<article><p>text</p><button>Send</button><select><option>one</option></select></article>", "text"),
        ("<div class='post-header'><h1>The title of it</h1></div><div class='post-body'><p>" + "word " * 40 + "</p></div>", "The title of it\n" + " ".join(["word"] * 40)),
        ("<article><p class='skip-content'>" + "word " * 30 + "</p><p>end of it</p></article>", " ".join(["word"] * 30) + "\nend of it"),
        ("<html><body><p>only this</p></body></html>", "only this"), ("<p>one two three</p><p>four</p>", "one two three\nfour"),
        ("<article><ul><li><a href=/a>one</a></li><li><a href=/b>two words</a></li></ul><p><a href=/c>a third link</a></p></article>", "one\ntwo words\na third link"),
        ("<title>a <b> c</title><article><p>x</p></article>", "x"), ("<title>never closed <article><p>x</p></article>", ""),
        ("<style>p{}</style><title>no</title><main><p>yes</p></main><div class='cookie-notice'>no</div>", "yes"),
    ],
)
def test_cases(page, text):
    assert pages.main_text(page) == text


UNSEEN = [
    "<ul class=topmenu>n:[2] n:[1] n:[3]</ul> <section class=story>a:12 a:66 a:3 a:29</section> <div class=advertisement>n:18</div> <div id=footer>n:11</div>",
    "<div role=navigation>n:[1] n:[1] n:[2]</div> <div role=main><h1>a:4</h1> a:51 a:[1] a:37</div> <div role=complementary class=sidebar>n:26</div>",
    "<div class=consent>n:33</div> <main><h2>a:2</h2> a:73 a:6 a:1</main> <section class=comment-list>n:47 n:15 n:8</section> <form>n:3 n:20</form>",
    "<div>n:[2] n:[1] n:[1] n:[3]</div> <div>a:49 a:38 a:71</div> <div>n:[1] n:[4] n:[2]</div>",
    "<header>n:5</header> <article><header><h1>a:8</h1></header> a:64 <aside>n:19</aside> a:35 <blockquote>a:22</blockquote></article> <footer>n:7 n:[2]</footer>",
    "<div class=entry-header><h1>a:6</h1></div> <div class=entry-content>a:82 a:44 a:1 a:18</div> <div class=entry-footer>n:9</div> <div class=subscribe>n:12</div>",
]


def test_unseen_layouts(monkeypatch):
    tree = pages.tree()
    used = lambda t: set() if t is None or t.feature < 0 else {pages.FEATURES[t.feature]} | used(t.low) | used(t.high)
    assert used(tree) & {"words_before", "density_before", "words_after", "density_after"}
    monkeypatch.setattr(pages, "_LAYOUTS", UNSEEN)
    x, y = pages._examples()
    assert ((tree.predict(x) >= 0.5) == y).mean() > 0.97


def test_tree_and_examples():
    x, y = pages._examples()
    assert ((pages.tree().predict(x) >= 0.5) == y).mean() > 0.95


def test_broken_markup_is_linear():
    for page in ("<" * 20_000, "<a " * 20_000, "<div>" * 5_000 + "x", "<!--" * 20_000, '<a "' * 20_000, "</p>" * 20_000):
        assert isinstance(pages.main_text(page), str)


def test_extract(spark):
    rows = [(1, "u", "<article><p>a  b</p></article>"), (1, "u", "<article><p>a  b</p></article>"), (None, None, None), (2, "v", "<article><p>" + "w " * 200_000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars", "3 AS label")
    got = pages.extract(df).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (1, 3), (1, 3), (2, 399_999)]
    assert pages.extract(df.limit(0)).columns == ["page_id", "url", "text", "n_chars"]
    assert pages.extract(df.limit(0)).collect() == []


@pytest.mark.skipif(not HAS_DATA, reason="needs the driver's tables")
def test_articles_of_the_tables(spark):
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.read.parquet(f"{DATA}/pages.parquet")).collect()}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)
        if article:
            parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", p))).strip() for p in re.split(r"</?(?:h1|p|br)\b[^>]*>", article[1])]
            assert got[r["page_id"]] == "\n".join(filter(None, parts))
