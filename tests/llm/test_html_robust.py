"""Unclosed and malformed markup, names that only look like something else, lists of links, and very long pages."""

import time

import pytest

from plenum.llm import html

LONG = [" ".join(f"{i} word after word of a long paragraph".split()) + " and more of it" * 12 for i in range(4)]
PARAS = "".join(f"<p>{t}</p>" for t in LONG)


def article(inside: str) -> str:
    return f"<body><nav><a href=x>menu</a></nav><article><h1>Head</h1>{PARAS}{inside}</article><footer>foot</footer></body>"


def kept(inside: str) -> list[str]:
    found = html.main_text(article(inside)).split("\n\n")
    assert found[: len(LONG) + 1] == ["Head", *LONG]
    return found[len(LONG) + 1 :]


@pytest.mark.parametrize(
    "inside,want",
    [
        ("<ul><li class=share>Share it<li>first real point<li>second point</ul>", ["first real point", "second point"]),
        ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td class=ad>x<td>1<th>2<tr><td>3</table>", ["1", "2", "3"]),
        ("<dl><dt class=promo>t<dd>one<dt>u<dd>two</dl>", ["one", "u", "two"]),
        ("<div class='related-work'><p>Others did it too.</p></div>", ["Others did it too."]),
        ("<div id='header-files'><p>stdio.h</p></div>", ["stdio.h"]),
        ("<div class=header>Part two</div>", ["Part two"]),
        ("<div class='related-articles'><a href=1>One more</a> <a href=2>And two</a></div>", []),
        ("<ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul>", []),
        ("<p>See <a href=1>this</a> and that.</p>", ["See this and that."]),
        ("<section class='reader-comments'><p>I liked it very much, as I always do.</p></section>", []),
        ("<div class='cookie-notice'>We use cookies</div><div id=newsletter><p>Sign up</p></div><div class='ad-slot'>Buy</div>", []),
        ("<div role=navigation>menu</div><p hidden>x</p>", ["x"]),
        ("<p>a &amp; b &#233; &lt;c&gt;<br>d</p><pre>e\n f</pre>", ["a & b é <c> d", "e f"]),
        ("</div></p></article2><p>after", ["after"]),
        ("<p>one<p>two<div>three</div>four", ["one", "two", "three", "four"]),
        ("<script>if (a < b) document.write('<p>no</p>')</script><style>p{}</style><!-- no --><p>yes", ["yes"]),
    ],
)
def test_inside_an_article(inside, want):
    assert kept(inside) == want


def test_threshold_and_clusters_choose_the_region():
    short = "".join(f"<div>line {i}</div>" for i in range(6))
    page = f"<div><div>{short}</div><div id=x><h2>Title</h2>{PARAS}<p>End.</p></div><div>{short}</div></div>"
    assert html.main_text(page) == "\n\n".join(["Title", *LONG, "End."])
    two = f"<article>{PARAS}</article><article><p>short</p></article>"
    assert html.main_text(two) == "\n\n".join(LONG)


def test_nothing_to_find():
    for page in (None, "", " \n", "<html></html>", "<nav>menu</nav>", "<", "<p", "<!-- never closed", "<script>never closed"):
        assert html.main_text(page) == "" or "<" in html.main_text(page)


@pytest.mark.parametrize("tag", ["div", "li", "b", "p", "td", "ul", "a", "section", "h1", "article"])
def test_many_unclosed_tags(tag):
    began = time.perf_counter()
    found = html.main_text(f"<body>{PARAS}" + f"<{tag}>x " * 100_000)
    assert time.perf_counter() - began < 10
    assert LONG[0] in found or tag == "article"  # an article is the region, and leaves out what stands before it


def test_tables_of_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", article(""), "no", "x"), (1, "u", article(""), "no", "x"), (None, None, None, None, None), (2, "v", "", "", ""), (3, "w", "<p>é</p>", None, None)]
    found = html.extract(spark.createDataFrame(rows, schema))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    text = "\n\n".join(["Head", *LONG])
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, [(1, "u", text, len(text)), (1, "u", text, len(text)), (None, None, "", 0), (2, "v", "", 0), (3, "w", "é", 1)]))
    assert html.extract(spark.createDataFrame([], schema)).collect() == []


REFERENCES = "".join(f'<li><a href="/{i}">ref {i}</a></li>' for i in range(5))
REFS = [f"ref {i}" for i in range(5)]


@pytest.mark.parametrize(
    ("inside", "want"),
    [
        (f"<h2>References</h2><ul>{REFERENCES}</ul>", ["References", *REFS]),
        (f"<h2>Related posts</h2><ul>{REFERENCES}</ul>", []),
        (f"<ul>{REFERENCES}</ul><p>{LONG[0]} Again.</p>", [*REFS, f"{LONG[0]} Again."]),
        (f"<ul>{REFERENCES}</ul>", []),
        (f'<div class="share links"><ul>{REFERENCES}</ul></div><p>{LONG[0]} Again.</p>', [f"{LONG[0]} Again."]),
        (f'<p class="notice">{LONG[0]} Noticed.</p>', [f"{LONG[0]} Noticed."]),
        (f'<div class="notice"><p>{LONG[0]} Noticed.</p></div>', []),
    ],
)
def test_what_belongs_to_an_article(inside, want):
    assert kept(inside) == want


def test_forms():
    page = f"<body><form id=f><div id=x><h1>Title</h1>{PARAS}<input name=a><select><option>no</option></select></div></form><div>short</div></body>"
    assert html.main_text(page) == "\n\n".join(["Title", *LONG])
    assert html.main_text(f"<body><article><h1>Title</h1>{PARAS}</article><form><p>Subscribe here with your name</p></form></body>") == "\n\n".join(["Title", *LONG])
    assert kept("<form><p>Write to us about this</p></form>") == []


def test_smoothing_against_plain_sums():
    import numpy as np

    rng = np.random.default_rng(2)
    for sigma in (0.5, 1.0, 2.5):
        for n in (1, 2, 7, 60):
            ratios = rng.uniform(0, 300, n)
            reach = int(3 * sigma)
            weight = [np.exp(-((k / sigma) ** 2) / 2) for k in range(-reach, reach + 1)]
            want = [sum(w * ratios[min(max(i + k, 0), n - 1)] for w, k in zip(weight, range(-reach, reach + 1), strict=True)) / sum(weight) for i in range(n)]
            assert np.allclose(html.smoothed(ratios, sigma), want)


def test_threshold_and_width_decide(monkeypatch):
    """Link lists with texts of middling length at the end: whether their lines are below the threshold decides, and so does the smoothing."""
    long_links = "".join(f'<li><a href="/{i}">{"a fairly long title of a piece of text " * 2}{i}</a></li>' for i in range(4))
    page = f"<article><h1>Title</h1>{PARAS}<ul>{long_links}</ul></article>"
    found = {}
    for threshold in (0.0, 0.5, 1.5):
        for sigma in (0.4, 4.0):
            monkeypatch.setattr(html, "THRESHOLD", threshold)
            monkeypatch.setattr(html.smoothed, "__defaults__", (sigma,))
            found[threshold, sigma] = html.main_text(page)
    assert "fairly" in found[0.0, 0.4] and "fairly" not in found[1.5, 4.0] and len(set(found.values())) > 1
    two = f"<div><div id=a>{PARAS}</div><div id=b>{'<div>a line of text here</div>' * 8}</div></div>"
    chosen = set()
    for threshold in (0.0, 1.2):
        monkeypatch.setattr(html, "THRESHOLD", threshold)
        monkeypatch.setattr(html.smoothed, "__defaults__", (1.0,))
        chosen.add(html.main_text(two))
    assert len(chosen) == 2
