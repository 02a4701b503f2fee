import html

import pytest

import cases
from sharelode.llm.extraction import extract, main_text

P1 = "The first paragraph, which is long enough, says a few things &amp; more."
P2 = "Another one follows it, with commas, and tells <b>what</b> comes\n  next."
T1, T2 = html.unescape(P1), "Another one follows it, with commas, and tells what comes next."


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain words", "plain words"), ("<nav><a href=x>Home</a></nav>", ""),
    (f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Title</h1><p>{P1}</p><p>Short.</p>"
     f"<p>{P2}</p></article><footer>&copy; me</footer></body></html>", f"Title\n{T1}\nShort.\n{T2}"),
    (f"<div id='sidebar'><p>{P1}</p></div><div class='post-content'><p>{P2}</p><p>{P1}</p></div>"
     f"<section class='user-comments'><p>{P1}</p><p>{P1}</p><p>{P1}</p></section>", f"{T2}\n{T1}"),
    (f"<main><header class=site-header>Site</header><div><h2>Head</h2><p>{P1}</p><aside>no</aside>"
     f"<form><p>{P2}</p></form><div class='ad'>buy</div></div></main>", f"Head\n{T1}"),
    (f"<article><p>{P1}<br><p>{P2}<script>if (a < b) '</p>'</script></article><div role=alert><p>{P1}</p></div>",
     f"{T1}\n{T2}"),
    (f"<div class=cookie-notice>{P1}</div><div><p>{P1}</p><ul><li>one</li><li>two, three</li></ul><p>{P2}</p></div>",
     f"{T1}\none\ntwo, three\n{T2}"),
    (f"<!-- <p>{P1}</p> --><article><p title='a > b'>{P1}</article", T1 + ""),
    (f"<article><p>&lt;p&gt; &#233;&#x4E00;&nbsp;x,  {P1}</p></article>", f"<p> é一 x, {T1}"),
])
def test_pages(page, text):
    assert main_text(page) == text


def test_links_do_not_make_an_article():
    links = "".join(f"<li><a href=/{i}>A headline, quite long, about something number {i}</a></li>" for i in range(60))
    page = f"<div><ul>{links}</ul></div><div><p>{P1}</p><p>{P2}</p></div>"
    assert main_text(page) == f"{T1}\n{T2}"


def test_broken_and_deep_pages():
    assert main_text("<p>a<b>c</p>" + "<div>" * 20_000 + "x" + "</div>" * 20_000) == "ac\nx"
    assert main_text("<" * 20_000) == "<" * 20_000
    assert main_text("<a href='" * 3000).startswith("<a") or main_text("<a href='" * 3000) == ""
    assert main_text("<article>" + f"<p>{P1}</p>" * 5000 + "</article>").count("\n") == 4999


def test_rows(spark):
    rows = [(1, f"<article><p>{P1}</p></article>"), (2, None), (3, ""), (None, "x"), (1, f"<article><p>{P1}</p></article>")]
    df = cases.frame(spark, rows, "page_id long, html string").selectExpr("*", "'u' as url", "1 as text")
    found = extract(df).collect()
    assert cases.ordered(tuple(r) for r in found) == cases.ordered(
        [(1, "u", T1, len(T1)), (2, "u", "", 0), (3, "u", "", 0), (None, "u", "x", 1), (1, "u", T1, len(T1))])
    assert extract(df.filter("false")).count() == 0
