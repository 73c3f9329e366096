from __future__ import annotations

import random

import numpy as np
import pytest

from quillmill.llm import htmltext, queries

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header class="masthead"><a href=/>Site</a></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies to improve this site.</p></div>
<article><h1>A &lt;fine&gt; title</h1><p>First&nbsp;paragraph with <b>bold</b> and <a href=x>a link</a>,
over two lines &amp; more.</p><p>Second paragraph, which says a little more about the thing.</p></article>
<section class="comments"><h3>Comments</h3><p class="comment">Great post, thanks!</p></section>
<aside class="sidebar"><h4>Related</h4><ul><li><a href=/r>Other story</a></li></ul></aside>
<form id="search"><p>Search <input name=q></p></form><footer><p>Copyright all rights reserved</p></footer></body></html>"""


def test_article_only(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "plain text only"), (1, "u", PAGE), (5, "u", "<p>unclosed <b>tags"), (6, "u", "<!-- x --><script>never closed")]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and text[1] == "A <fine> title First paragraph with bold and a link, over two lines & more. Second paragraph, which says a little more about the thing."
    assert text[2] == text[3] == text[6] == "" and all(r["n_chars"] == len(r["text"]) for r in got)
    with pytest.raises(ValueError):
        htmltext.extract(spark.createDataFrame([], "html string, text string"))


def test_held_out_pages_of_the_generator():
    pages, labels = htmltext.samples(range(100_000, 100_200))
    scores = htmltext.labeller().scores(pages)
    right = sum(int(((s > 0) == np.array(own)).sum()) for s, own in zip(scores, labels, strict=True))
    assert right > 0.97 * sum(map(len, labels))


def test_gradients_equal_differences():
    net = htmltext.Labeller(1)
    pages, labels = htmltext.samples(range(4))
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    _, grad = net.gradients(pages, labels)
    rng = random.Random(0)
    for name in ("out", "xf", "hb", "cf", "embed"):
        flat, slope = net.p[name].reshape(-1), grad[name].reshape(-1)
        for i in rng.sample(np.flatnonzero(np.abs(slope) > 1e-5).tolist(), 3):
            before, found = flat[i], []
            for step in (1e-3, -1e-3):
                flat[i] = before + step
                found.append(net.gradients(pages, labels)[0])
            flat[i] = before
            assert abs((found[0] - found[1]) / 2e-3 - slope[i]) < 1e-3 + 0.05 * abs(slope[i])


def test_every_page_has_a_row(spark, sf_dir):
    got = queries.op9_html_text(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert sum(r["n_chars"] > 0 for r in got) > 0.9 * len(got)


def test_markup_that_is_not_well_formed_loses_no_text():
    texts = lambda page: [text for _, text, _ in htmltext.blocks(page)]
    assert texts("<p title=it's>hello</p><p>world's end</p>") == ["hello", "world's end"]
    assert texts('<p title="a > b">x</p><p alt="never closed>y</p><p>z</p>')[0] == "x"
    assert texts("<form><datalist><option value=a>no<option value=b>no</datalist></form><article>Text.</article>") == ["Text."]
    assert texts("<select><option>no<article>Text.</article>") == ["Text."]
    assert texts("<title>Never closed <p>Text.</p>") == ["Never closed", "Text."]
    assert texts("<textarea>no</textarea><svg><title>no</title><text>no</text></svg>Text.<script>var a = '<p>no</p>'") == ["Text."]


def test_every_word_of_a_block_is_a_feature():
    import numpy as np

    same = "one two three four five six seven eight nine ten eleven twelve "
    a, b = (htmltext.features([(["p"], same + end, 0.0)])[0][0] for end in ("thirteen", "fourteen"))
    assert not np.array_equal(np.sort(a), np.sort(b))


def test_article_of_every_test_page_is_kept_and_nothing_else(spark):
    """The test pages' main text stands in an article element, which the network isn't told."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r["page_id"]: r["text"] for r in htmltext.extract(pages.select("page_id", "url", "html")).collect()}
    kept = wrong = missed = 0
    for r in pages.collect():
        want = [text for path, text, _ in htmltext.blocks(r["html"]) if "article" in path]
        truth = " ".join(want)
        kept += len(truth)
        if found[r["page_id"]] != truth:
            others = [text for path, text, _ in htmltext.blocks(r["html"]) if "article" not in path]
            missed += sum(len(x) for x in want if x not in found[r["page_id"]])
            wrong += sum(len(x) for x in others if x in found[r["page_id"]])
    assert missed <= 0.01 * kept and wrong <= 0.01 * kept


def test_long_pages_and_empty_tables(spark):
    schema = "page_id long, html string, url string"
    long = "<article>" + "<p>Some words of a paragraph that goes on for a while, and ends.</p>" * 20_000 + "</article>"
    rows = spark.createDataFrame([(1, long, "a"), (2, None, None), (3, "", "c"), (3, "", "c")], schema)
    found = {r["page_id"]: r["n_chars"] for r in htmltext.extract(rows).collect()}
    assert found[1] > 1_000_000 and found[2] == found[3] == 0
    assert htmltext.extract(rows.limit(0)).collect() == [] and htmltext.extract(rows).count() == 4
