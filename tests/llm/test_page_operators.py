"""Pages operators on small fixtures."""

import base64
import hashlib
import re
import time
import zipfile

import numpy as np
import pytest

from drovekit.llm import html_text, url_lists, warc
from drovekit.llm.common import components, new_path

P = "This is a long paragraph of the story, with commas, and more than enough words to count as one."


def test_article_without_the_rest():
    page = f"""<html><body class="has-sidebar"><header><h1>Site</h1></header><div id=cookie-banner>We use cookies, ok?</div>
    <nav><a href=x>Home</a></nav><div class=wrap><div class="post-content"><h1>Title &amp; more</h1><p>{P}<p>{P}<script>x('</p>')</script>
    <ul><li>one<li>two, <a href=q>link</a></ul><div class="ad">Buy now, cheap, best</div><p>Yes.</p></div>
    <div class="sidebar"><p>{P}{P}</div></div><section id="comments"><p>{P * 3}</p></section><form><p>{P}</p></form><footer>c</footer>"""
    assert html_text.main_text(page) == "\n".join(["Title & more", P, P, "one", "two, link", "Yes."])


@pytest.mark.parametrize(("html", "text"), [(None, ""), ("", ""), ("<p>", ""), ("plain &lt;b&gt;", "plain <b>"), ("<article><h1>T</h1><p><b>a.<br><p>b\n c</article>", "T\na.\nb c"), ("<!-- x --><p>a<!-- ", "a"), ("<p>cut <b", "cut"), ("<script>if (a<b) '</p>'</script><p>z", "z")])
def test_odd_pages(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize("wrapper", ["class='content with-sidebar'", "id='content-sidebar-wrap'", "class='post social-enabled'", "class='has-sidebar'"])
@pytest.mark.parametrize("article", ["<article>{}</article>", "<div class=entry>{}</div>", "<div>{}</div>"])
def test_wrappers_that_name_their_sidebar(wrapper, article):
    page = f"<h1>Site</h1><div {wrapper}>{article.format(f'<p>{P}<p>{P}<p>{P}')}</div>"
    assert html_text.main_text(page).endswith("\n".join([P, P, P]))


def test_junk_in_and_beside_a_wrapper_goes():
    page = f"<div class='content with-sidebar'><article><p>{P}<p>{P}</article><div class=sidebar><p>{P * 2}</div></div><div id=comments><div class=comment-body><p>{P * 9}</div></div>"
    assert html_text.main_text(page) == f"{P}\n{P}"


def test_an_advert_beside_a_short_text_goes():
    assert html_text.main_text(f"<article><p>Short.</p><div class=ad>{P}</div></article>") == "Short."


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", f"<article><p>{P}</article>", 1), (None, None, None, 1), (1, "u", "", 1)], "page_id long, url string, html string, text long")
    assert sorted(map(str, (tuple(r) for r in html_text.extract(pages).collect()))) == sorted(map(str, [(1, "u", P, len(P)), (None, None, "", 0), (1, "u", "", 0)]))
    assert html_text.extract(pages.limit(0)).count() == 0


PAGES = [(5, "u", "x"), (3, None, "x"), (None, "a b\n", "x"), (9, "b", None), (8, "c", ""), (-4, "d", "yé" * 5000), (3, "e", "x"), (1 << 62, "f", "yé" * 5000)]


@pytest.mark.parametrize("zip64", [False, True])
def test_warc_round_trip(spark, zip64):
    pages = spark.createDataFrame([(*r, 1) for r in PAGES], "page_id long, url string, html string, sha long").repartition(3)
    packages = warc.write_packages(pages, new_path(spark, "warc"), member=200, zip64=zip64)
    got = sorted(map(str, (tuple(r) for r in warc.read_packages(packages).collect())))
    first = {"x": 3, "": 8, "yé" * 5000: -4}
    want = []
    for i, _, html in PAGES:
        html = html or ""
        sha = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        want.append((i, len(html.encode()), sha, *(("response", None) if i == first[html] else ("revisit", first[html]))))
    assert got == sorted(map(str, want))
    for r in packages.collect():
        assert zipfile.ZipFile(r.file.removeprefix("file://")).testzip() is None


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame(PAGES[:4], "page_id long, url string, html string")
    assert {r.record_type for r in warc.warc_round_trip(pages, least_bytes=2).collect()} == {"response"}
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_temporal_lists(spark):
    e = spark.createDataFrame([("d:x.com", "block", "add", "2024-01-10"), ("d:x.com", "block", "remove", "2024-02-10"), ("d:x.com", "block", "add", "2024-06-01"), ("p:a.x.com/ok", "allow", "add", "2024-01-15"), ("d:y.org", "block", "add", "2024-01-01"), ("d:y.org", "block", "remove", "2024-01-01"), (None, "block", "add", "2024-01-01")], "key string, kind string, action string, day string").withColumn("day", __import__("pyspark").sql.functions.to_date("day"))
    c = spark.createDataFrame([(1, "http://a.X.com/ok/1", "2024-01-12"), (2, "http://a.x.com/ok/1?q", "2024-01-20"), (3, "http://x.com./", "2024-02-10"), (4, "https://u@x.com:8/", "2025-01-01"), (5, "http://y.org/", "2024-01-01"), (6, None, "2024-01-20"), (7, "http://x.com/", None), (None, "no url", "2024-01-20"), (1, "http://a.X.com/ok/1", "2024-01-12")], "page_id long, url string, day string")
    got = {(r.page_id, r.n_active, r.blocked, r.pattern) for r in url_lists.judged(c, e).collect()}
    assert got == {(1, 1, True, "d:x.com"), (2, 2, False, "p:a.x.com/ok"), (3, 0, False, None), (4, 1, True, "d:x.com"), (5, 0, False, None), (6, 0, False, None), (7, 0, False, None), (None, 0, False, None)}
    assert url_lists.judged(c, e).count() == 9
    assert url_lists.judged(c.limit(0), e).count() == 0 and url_lists.judged(c, e.limit(0)).filter("blocked").count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def scored_by_definition(html):
    """The kept blocks, each sum taken over all of a container's blocks anew."""
    root = html_text.parse(html)
    if not html_text._without_junk(root):
        root = html_text.parse(html, by_name=False)
    nodes = html_text._nodes(root)
    is_node = lambda c: isinstance(c, html_text.Node)

    def own(x):
        return [b for c in x.children for b in (own(c) if is_node(c) else [c])]

    chars = {x: sum(len(t) for t, _ in own(x)) for x in nodes}
    density = {x: sum(k for _, k in own(x)) / chars[x] if chars[x] else 0.0 for x in nodes}
    gained = {}
    for x in nodes:
        for t, k in (c for c in x.children if not is_node(c)):
            if len(t) >= 25 and not re.fullmatch("h[1-6]", x.tag):
                points = (1 + sum(t.count(c) for c in ",，、") + min(len(t) / 100, 3.0)) * (1 - k / len(t))
                up = x if x.tag in ("div", "section", "article", "main", "body", "td") else x.parent or x
                for share in (1, 2, 3, 4):
                    if up is not None:
                        gained[up] = gained.get(up, 0.0) + points / share
                        up = up.parent
    scores = {x: (gained[x] + x.points) * (1 - density[x]) for x in gained if x is not root}
    return root, nodes, scores, {x: [t for t, _ in own(x)] for x in nodes}


def test_html_scores_by_definition():
    rng = np.random.default_rng(5)
    tags = "div p section article ul li a b td h2 blockquote".split()
    sentences = ["Some words, and more of them, in a sentence that is long.", "Short.", "A second block of text, with commas, which reads like an article."]
    for _ in range(300):
        html = "".join(f"<{rng.choice(tags)}>" if (c := rng.random()) < 0.45 else f"</{rng.choice(tags)}>" if c < 0.7 else str(rng.choice(sentences)) for _ in range(rng.integers(1, 50)))
        root, nodes, scores, texts = scored_by_definition(html)
        got = html_text.main_text(html)
        if not scores:
            whole = [x for x in nodes if x.tag in ("article", "main") and texts[x]]
            assert got == "\n".join(texts[max(whole, key=lambda x: sum(map(len, texts[x])))] if whole else texts[root])
            continue
        best = max(scores.values())
        tops = [x for x in scores if scores[x] > best - 1e-9]  # the chosen one, or a container around it
        around = {id(y) for x in tops for y in (x, *(p for p in nodes if p in ancestors(x)))}
        assert any("\n".join(texts[x]) in got for x in nodes if id(x) in around and texts[x])
        assert set(got.split("\n")) <= set(texts[root])


def ancestors(x):
    while (x := x.parent) is not None:
        yield x


def test_html_of_any_depth_and_length():
    n = 100_000
    words = "words and words, of some length here. "
    for html in ("<div>x" * n, f"<div><p>{words}" * (n // 4), "<a><div>" + "<b>" * n + "</a>" * n, "<div class=ad>x</div>" * n + f"<p>{words}", "<ul>" + "<li>x" * n, "<nav>" + "<div>" * n + "</p>" * n, "<table>" + "<tr><td>x" * n):
        began = time.process_time()
        html_text.main_text(html)
        assert time.process_time() - began < 20  # minutes, were it quadratic
    text = html_text.main_text(f"<article>{'<p>' + words * 3}</p>" + f"<p>{words * 20_000}</p></article>")
    assert len(text) > 700_000 and text.count("\n") == 1


def test_html_ties():
    block = "<p>One paragraph of words, and of commas, that is long enough to count as text of an article.</p>"
    assert html_text.main_text(f"<div>{block}</div><div>{block.replace('One', 'Two')}</div>").split("\n")[0].startswith("One")  # the first of equal containers, and its sibling
    assert html_text.main_text(f"<div><div>{block}</div></div>").startswith("One")
