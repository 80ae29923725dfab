"""Operator 8: layout of lists, cells and spans, visibility, and a plain version on pages made at random."""

import html
import random

import pytest

from roadloom.llm.html import ALIGNED, extract_text, render


@pytest.mark.parametrize(("page", "text"), [
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<table><tr><td>a<td rowspan=3>b<td>c<tr><td>d<td>e</table>", "a  b  c\nd     e"),
    ("<table><tr><td><ul><li>x<li>y</ul><td>z</table>", "- x  z\n- y"),
    ("<table><tr><td><pre>1\n 2</pre><td>z</table>", "1   z\n 2"),
    ("<table><tr><td colspan=2>ab<td>c<tr><td>d<td>e<td>f</table>", "ab    c\nd  e  f"),
    ("<p>a<span style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</span>", "ayes"),
    ("<div style='visibility:hidden'><img alt=no><select><option>no</select><p style='visibility:visible'>in</div>out", "in\n\nout"),
    ("<dialog>no</dialog>a<dialog open>b</dialog>", "a\nb"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>u</details>", "s\nt\nu"),
    ("<p hidden>no<p>a", "a"),
    ("<p style='display:none'>no<b style='visibility:visible'>no</b><p>a", "a"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c"),
    ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"),
    ("", ""), ("<", "<"), ("&amp;&lt;", "&<"),
])
def test_layout(page, text):
    assert render(page) == text


def test_wide_cells_are_not_padded():
    page = "<table><tr><td>" + "w" * 100_000 + "<td>x" + "<tr><td>a<td>b" * 500 + "</table>"
    out = render(page)
    assert len(out) < 100_000 + 500 * (ALIGNED + 10) and out.split("\n")[1:] == ["a  b"] * 500 and out.startswith("w" * 100_000 + "  x")


def test_long_page():
    page = "<div>" * 3000 + "<p>word</p>" * 50_000
    assert render(page).split() == ["word"] * 50_000


def make(r, depth):
    """(source, visible words) of a random tree."""
    parts, words = [], []
    for _ in range(r.randint(1, 4)):
        kind = r.random()
        if depth == 0 or kind < 0.4:
            w = f"w{r.randint(0, 999)}&"
            parts.append(f" {html.escape(w)} ")
            words.append(w)
            continue
        inner, seen = make(r, depth - 1)
        if kind < 0.5:
            parts.append(r.choice(["<script>{}</script>", "<style>{}</style>", "<!--{}-->", "<template>{}</template>"]).format("w0 no"))
        elif kind < 0.6:
            parts.append(r.choice(["<div hidden>{}</div>", "<div style='display:none'>{}</div>", "<noscript>{}</noscript>", "<dialog>{}</dialog>"]).format(inner))
        elif kind < 0.75:
            parts.append(f"<table><tr><td>{inner}</td></tr></table>")
            words += seen
        else:
            parts.append(r.choice(["<div>{}</div>", "<b>{}</b>", "<section>{}</section>", "<blockquote>{}</blockquote>", "<span>{}</span>", "<article>{}</article>"]).format(inner))
            words += seen
    return "".join(parts), words


@pytest.mark.parametrize("seed", range(60))
def test_all_visible_words_in_order(seed):
    page, words = make(random.Random(seed), 5)
    assert render(page).split() == words


def test_rows(spark):
    rows = [(1, "<p>a", "u"), (1, "<p>a", "u"), (2, None, "u"), (3, "", "u"), (None, "<p>b", "u"), (4, "<p>" + "x " * 600_000, "u")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted(((r.page_id or 0, r.text) for r in extract_text(df).collect()), key=str)
    assert got == sorted([(1, "a"), (1, "a"), (2, ""), (3, ""), (0, "b"), (4, ("x " * 600_000).strip())], key=str)
    assert extract_text(df.where("false")).count() == 0
