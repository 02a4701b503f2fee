"""Names of classes and ids alone empty no page, and page furniture still goes."""

import pytest

from sharelode.llm.extraction import main_text

A = "The first paragraph of the article, which is long enough to be one, tells how it all began in the town."
B = "The second paragraph goes on with it, and says, among other things, what came of the plan in the end."
C = "The third paragraph ends the article, with a few words on what is to come, and on whom it will concern."
TEXT = f"{A}\n{B}\n{C}"
BODY = f"<p>{A}</p><p>{B}</p><p>{C}</p>"
AROUND = ("<header><a href=/>Home</a></header><nav><a href=/a>News</a></nav>", "<footer>The publisher, 2024</footer>")


@pytest.mark.parametrize("start, end", [
    *((f'<div class="{name}">', "</div>") for name in (
        "content has-sidebar", "layout-with-sidebar", "no-sidebar", "main-wrap sidebar-right", "header-fixed", "legal-news",
        "side-effects", "share-price", "text-ad-free", "page comments-open", "sidebar-right", "is-menu-open", "headerFixed")),
    ('<article class="post comments-open">', "</article>"), ('<article class="post sidebar">', "</article>"),
    ('<form id="aspnetForm">', "</form>"), ('<form><div class="widget">', "</div></form>"),
    ('<div id="side"><div class="no-ads">', "</div></div>"),
])
def test_wrappers_keep_the_article(start, end):
    assert main_text(f"<body>{AROUND[0]}{start}{BODY}{end}{AROUND[1]}</body>") == TEXT


@pytest.mark.parametrize("start, end", [
    *((f'<div class="{name}">', "</div>") for name in (
        "side-effects", "share-price", "legal-news", "has-sidebar", "text-ad-free", "related-work")),
    ('<p class="share-price">', "</p>"),
])
def test_sections_of_an_article_stay(start, end):
    assert main_text(f"<article><p>{A}</p>{start}{B}{end}<p>{C}</p></article>") == TEXT


@pytest.mark.parametrize("name", [
    "sidebar", "left-sidebar", "sidebar-right", "sidebar-inner", "user-comments", "comment-list", "comments-area", "commentBody",
    "cookie-notice", "cookie-bar", "newsletter-cta", "ad", "ad-slot", "ad_container", "site-footer", "footer-widgets", "menu-item",
    "related-posts", "share-buttons", "social-icons", "popup", "subscribe", "breadcrumbs", "promo-box", "nav-2", "ad-3",
])
def test_furniture_goes(name):
    inside = f"<div class='{name}'><p>{B}</p></div>"
    assert main_text(f"<div><p>{A}</p>{inside}<p>{C}</p></div>") == f"{A}\n{C}"
    assert main_text(f"<article><h1>Title</h1><p>{A}</p></article><div id='{name}'><p>{B}</p><p>{C}</p></div>") == f"Title\n{A}"
    assert main_text(f"<div>{inside}</div>") == ""


@pytest.mark.parametrize("name", ["user-comments", "cookie-notice", "newsletter", "ad-slot"])
def test_long_comments_and_notices_go_where_the_article_is_short(name):
    assert main_text(f"<div><p>{A}</p></div><div class='{name}'>" + BODY * 10 + "</div>") == A
    assert main_text(f"<div class='{name}'>" + BODY * 10 + "</div>") == ""


def test_hints_go_by_links():
    links = "".join(f"<a href=/{i}>A headline, number {i}</a> " for i in range(9))
    assert main_text(f"<div><p>{A}</p><p>{B}</p><div class='header-fixed'>{links}</div><p>{C}</p></div>") == TEXT
    assert main_text(f"<article><p>{A}</p><div class='share-tools'>Share</div><p>{B}</p><p>{C}</p></article>") == TEXT


def test_comment_articles_go():
    comment = f"<article class='comment'><p>{B}</p></article>"
    assert main_text(f"<article><p>{A}</p>{comment}</article>{comment}") == A
    assert main_text(f"<article><p>{A}</p><form><p>{B}</p><input></form></article>") == A


def test_deep_furniture():
    deep = "<div class=sidebar>" * 5000
    assert main_text(f"{deep}{BODY}{'</div>' * 5000}") == TEXT
