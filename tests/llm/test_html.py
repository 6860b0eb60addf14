import html
import random
import re
import time

import numpy as np

from pixelweft.llm import html_extract as H


def expected(source):
    body = re.search(r"<article>(.*?)(?:</article>|$)", source, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", body))
    return "\n".join(b for b in blocks if b)


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r.page_id: expected(r.html) for r in pages.collect()}
    got = H.main_text(pages).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_unseen_layouts():
    model, r, right, nodes = H.trained(), random.Random(123), 0, []
    for _ in range(150):
        source = H._generated(r)
        page, want = H.Page(source.replace(' data-y="1"', "")), H._marked(source)
        kept = [k for t, k in zip(page.text, page.decode(model.log_odds(H.features([page])))) if t is not None]
        nodes += [bool(a) == b for a, b in zip(want, kept)]
        right += [bool(a) for a in want] == kept
    assert np.mean(nodes) > 0.99 and right > 0.9 * 150


def test_hand_written_page():
    source = """<html><head><title>t</title></head><body><div class="cookie-notice"><p>We use cookies on this site. Please accept.</p><button>OK</button></div>
    <header><a href="/">Home</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
    <main><h1>A &amp; B</h1><p>First paragraph   with
    some text, long enough to be read. It has two sentences.<p>Second&nbsp;one, also of decent length, <a href=x>with a link</a> in it.</p>
    <aside class="sidebar"><h3>Related</h3><a href=c>Other story</a></aside>
    <section id="comments"><h3>Comments</h3><p>bob: I disagree with all of this, strongly.</p></section></main>
    <form><label>Mail</label><input></form><footer>&copy; 2020 Somebody. All rights reserved.</footer><script>var x = "<p>no</p>";</script></body></html>"""
    (text,) = H.extract_many([source], H.trained())
    assert text == "A & B\nFirst paragraph with some text, long enough to be read. It has two sentences.\nSecond one, also of decent length, with a link in it."


def test_unclosed_elements_take_no_text_along():
    article = "<article><h1>The title</h1><p>Some words here, and more of them. Yes, two sentences.</p><p>Another one, of decent length. It ends here.</p></article>"
    want = "The title\nSome words here, and more of them. Yes, two sentences.\nAnother one, of decent length. It ends here."
    pages = [f"<html><head><title>x</title><body>{article}</body></html>", f"<head><meta charset=utf-8><link href=x>{article}", f"<html><head><title>x</title></head><body><head>{article}", f"<head><template><p>no</p></template><script>1</script></head>{article}"]
    pages += [f"<body><div><{t}>no{article}</div></body>" for t in ("button", "select><option", "svg><g", "video", "canvas")]
    pages += [f"<body><div><button>no{article}</div><button>no<p>no</p></button></body>", f"<body>{article[:-10]}<button><b><p>no</p></b></button></article></body>"]
    assert H.extract_many(pages, H.trained()) == [want] * len(pages)
    assert [t for t in H.Page("<head>Just text").text if t] == ["Just text"]
    inner = "<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds here, as we can see. <object data=x>A fallback text.</object> And more words.</p></article>"
    (text,) = H.extract_many(["<body>" + article.replace("</article>", inner) + "</body>"], H.trained())
    assert text.endswith("\nSo x=2 holds here, as we can see. A fallback text. And more words.")


def test_decoding_has_no_contradictions():
    page = H.Page("<div><p>a</p><div><p>b</p><p>c</p></div></div>")
    r = np.random.default_rng(0)
    for _ in range(200):
        kept = page.decode(r.normal(size=len(page.tag)) * 3)
        assert all(kept[page.parent[i]] or not kept[i] for i in range(1, len(kept)))


def test_odd_rows(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    rows = [(1, None, None), (2, "u", ""), (None, "u", "just text"), (3, "u", deep), (4, "u", "<p>unclosed <b>tag < 5 & <!-- open"), (4, "u", "<p>unclosed <b>tag < 5 & <!-- open"), (5, "u", '<a href="never closed'), (6, "u", "<article><h1>T</h1>" + "<p>Some words here, and more of them. Yes.</p>" * 5000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = H.main_text(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[1].text == by[2].text == "" and by[1].n_chars == 0
    assert by[6].text.count("\n") == 5000
    assert H.main_text(df.limit(0)).count() == 0


def test_time_grows_in_proportion_to_the_page():
    """About a megabyte each of what a page can break; none takes long, and what is read of a broken tag is what is left."""
    m = 100_000
    hard = ["<!-- " * m, "<![CDATA[" * m + ">", "<b>" * m + "</i>" * m, "<a " * m, "<a '\">" * m + ">", '<a "> " <a ">' * m, "<li><b>" + "<b>" * m + "<li></li>" * m, "<li><ul>" + "<b>" * m + "<li></li>" * m]
    hard += ["<p><li>" + "<b>" * m + "<div></div>" * m, "<script>" + "</script x " * m, "<" + "a" * m + ' "not closed >', "<a " + "b" * m + ">", "&#" + "9" * m, "<!" * m, "<div>" * m, "<button>" * m, "<" * m + ">"]
    began = time.process_time()
    pages = [H.Page(source) for source in hard]
    assert time.process_time() - began < 40
    assert [t for t in pages[12].text if t] == ["�"]
    assert [t for t in H.Page('<p class="a>one</p><p>two</p>').text if t] == ["one", "two"]
    assert [t for t in H.Page("<p title='x>y'>one<!-- not closed > two</p>").text if t] == ["one two"]
