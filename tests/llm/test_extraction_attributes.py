"""Only an element's own class, id, role, hidden, aria-hidden and style tell that it is left out."""

import pytest

from sharelode.llm.extraction import main_text

P = "A paragraph that is long enough, with a comma or two, and with words to keep."
Q = "Another paragraph of the same article, which is there to be kept, as it has words."


@pytest.mark.parametrize("attributes", [
    'href="/articles/hidden-treasures"', 'title="a hidden gem"', 'data-hidden="false"', 'data-id="sidebar"',
    'href="?id=comments"', "title='class=sidebar'", 'title = " id=footer "', "href=/a?class=menu", "href=?id=comments&x",
    'x-class="menu"', 'data-role=navigation', 'aria-label="style=display:none"', 'alt="a" title="x role=alert"',
    'class="lead"id="p1"', "hidden-until=1", 'data-style="display: none"', 'onclick="a(\'x\', hidden)"',
    'id="" title="sidebar"', "=hidden", "a=\"1\"/title='hidden'", 'class="first" class="sidebar"', "title=a/hidden",
])
def test_other_attributes_keep_the_text(attributes):
    assert main_text(f"<article><p>{P}</p><div {attributes}><p>{Q}</p></div></article>") == f"{P}\n{Q}"
    assert main_text(f"<article><p>{P} <a {attributes}>words</a></p></article>") == f"{P} words"


@pytest.mark.parametrize("attributes", [
    "hidden", "HIDDEN", "hidden=''", 'hidden="until-found"', "class=sidebar", 'class = "x sidebar"', "CLASS='sidebar'",
    "ID=comments", 'title="x"id="comments"', "role=navigation", 'aria-hidden="true"', "style='color:red;display: none'",
    "href=/x hidden", 'data-id="main"\nclass="menu"', "x/hidden", 'a="b"/class="ad"', "title='a' hidden/", "class=sidebar hidden=",
])
def test_own_attributes_leave_it_out(attributes):
    assert main_text(f"<article><p>{P}</p><div {attributes}><p>{Q}</p></div></article>") == P


def test_long_and_broken_attributes():
    for attributes in ("a" * 200_000, "a=" * 100_000, "a " * 100_000, "= " * 100_000, "a='b' " * 50_000, "a" + " " * 200_000):
        assert main_text(f"<article><p {attributes}>{P}</p></article>") == P
