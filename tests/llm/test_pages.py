import time

import numpy as np
import pytest

from tilewright.llm import pages


@pytest.fixture(scope="module")
def extractor():
    return pages.Extractor.train()


def test_held_out_accuracy(extractor):
    doms, labels = pages.training_set(150, seed=1234)
    x, parent, begin = pages.node_features(doms, extractor.lexicon)
    kept, y = pages.decode(extractor.trees.log_odds(x), parent, begin), np.concatenate(labels)
    some = y >= 0
    assert (kept[some] == (y[some] == 1)).mean() > 0.985


def test_decoding_is_the_best_consistent_labelling():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = 7
        parent = np.array([0] + [rng.integers(0, i) for i in range(1, n)])
        odds = rng.standard_normal(n) * 2
        log1, log0 = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        best = max(
            (
                (sum(log1[i] if bits >> i & 1 else log0[i] for i in range(1, n)), bits)
                for bits in range(1, 1 << n, 2)
                if all(bits >> parent[i] & 1 or not bits >> i & 1 for i in range(1, n))
            ),
        )
        got = pages.decode(odds, parent, np.array([0, n]))
        assert got.tolist() == [bool(best[1] >> i & 1) for i in range(n)]


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{x}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href=/a>Home</a>
<li><a href=/b>News</a></ul></nav><!-- ad --><div class="ad">Buy &lt;this&gt; now.</div><article><h1>A  title&nbsp;here</h1><p><b>First &amp; bold.<br><p>Second
 line, with <a href="/x">a link</a> inside.</p><p>1 &lt; 2 &#233;</p></article><div class="comments"><p>Nice post!</p></div><footer>&copy; x &middot; y.</footer></body></html>"""
WANT = "A title here\nFirst & bold.\nSecond line, with a link inside.\n1 < 2 é"


def test_a_page(extractor):
    assert extractor.texts([PAGE]) == [WANT]


@pytest.mark.parametrize("cut", [len(PAGE) - k for k in (1, 8, 30, 60, 100)])
def test_pages_that_break_off(extractor, cut):
    assert extractor.texts([PAGE[:cut]]) == [WANT]


def test_odd_pages(extractor):
    deep = "<div>" * 3000 + "<p>Some deep text, and more.</p>"
    got = extractor.texts(["", " ", "<", "<p", "plain text only", "<p>x<y", "a < b", deep, "<script>x", "&amp"])
    assert got[0] == got[1] == "" and got[4] == "plain text only" and got[8] == ""
    assert len(got) == 10


def shown(page):
    return "".join(s or "|" for _, _, s in pages.parse(page).texts)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>one</>two</p>three", "onetwo three"),
        ("<p>I </3 you> and more</p>three", "I and more three"),
        ("<div title=Bob's>one</div><p>two</p>", "one two"),
        ("<div title=Bob's>one</div><p>don't</p>", "one don't"),
        ("<div title='a>b' class=\"c>d\">one</div>two", "one two"),
        ("<div title=\"open>one</div><p>two</p>", "one two"),
        ("<head><title>t</title><body><p>one</p>", "one"),
        ("<head><meta charset=x><title>t</title><p>one</p>two", "one two"),
        ("<p>one</p><p class='x", "one"),
        ("<head><title>t</title>one two<p>three</p>", "one two three"),
        ("<head><meta charset=x>one", "one"),
        ("<button>menu<article><p>one</p></article>", "one"),
        ("<video src=x><h1>one</h1><p>two</p>", "one two"),
        ("<object><p>one</p>", "one"),
        ("<svg><path d=x><p>one</p>two", "one two"),
        ("<noscript>none<p>one</p>", "one"),
        ("<noscript><p>none</p></noscript><p>one</p>", "one"),
        ("<video><p>none</p></video>one", "one"),
        ("<button>menu<article>one</article><button>x</button>two", "one two"),
        ("<i>a<b>b</i>c</b><p>d</p>", "abc d"),
    ],
)
def test_no_text_is_lost_after_odd_tags(page, want):
    assert " ".join(shown(page).replace("|", " ").split()) == want


@pytest.mark.parametrize("page", ["<div>" * 12_000 + "<p>x", "<i>" * 12_000 + "<b>" * 12_000 + "</i>" * 12_000, "<x><table>" + "<div>" * 12_000 + "</x>" * 12_000, "<button>" + "<p>" * 12_000])
def test_time_grows_with_the_page(page):
    start = time.process_time()
    pages.parse(page)
    assert time.process_time() - start < 1


def test_frame(spark, extractor):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, None, PAGE, "y"), (None, "v", None, None), (3, "w", "", "")], "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in pages.extract(df, extractor).select("row.*", "text", "n_chars").collect()), key=str)
    assert got == sorted([(1, "u", WANT, len(WANT)), (1, None, WANT, len(WANT)), (None, "v", "", 0), (3, "w", "", 0)], key=str)
    assert pages.extract(df.limit(0), extractor).count() == 0
    kept = pages.extract(df.withColumn("n_chars", pages.F.lit(7)), extractor, keep=("text", "n_chars", "html")).select("row.*").collect()
    assert sorted(str(r.text) for r in kept) == ["", "None", "x", "y"] and all(r.n_chars == 7 for r in kept)
