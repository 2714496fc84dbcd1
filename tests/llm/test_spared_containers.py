"""Articles inside containers with unwanted names or inside forms are extracted; parts that are no article still go."""

from __future__ import annotations

import pytest
from sieveline.llm import html_extract

TEXT = ("Long, plain text. " * 20).strip()


@pytest.mark.parametrize("open_tag", ["<div class='content-sidebar-wrap'>", "<div class='site-content has-sidebar'>", "<div class='no-sidebar'>", "<div class='content with-header'>", "<div id='page-share-enabled'>", "<form action='/'>", "<form class='no-sidebar'><div class='with-header'>"])
def test_containers_of_the_article_stay(open_tag):
    closing = "".join(f"</{t.split()[0]}>" for t in reversed(open_tag.replace(">", "").split("<")[1:]))
    page = f"<html><body><nav><a href='/'>Home</a></nav>{open_tag}<div class='entry'><p>{TEXT}</p><p>{TEXT}</p></div><div class='sidebar'><p>Side, side</p></div>{closing}<div class='foot'>me</div></body></html>"
    assert html_extract.main_text(page) == f"{TEXT}\n{TEXT}"


@pytest.mark.parametrize("name", ["comments", "comments-area", "cookie-notice", "sidebar"])
def test_longer_parts_that_are_no_article_go(name):
    page = f"<body><div class='entry'><p>{TEXT}</p></div><div class='{name}'>{f'<p>Nice, nice. {TEXT}</p>' * 5}</div></body>"
    assert html_extract.main_text(page) == TEXT


def test_link_lists_with_layout_names_go():
    page = f"<body><div class='entry'><p>{TEXT}</p></div><div class='site-nav'>{'<p><a href=x>' + TEXT + '</a></p>'}{'<p><a href=x>' + TEXT + '</a></p>'}</div></body>"
    assert html_extract.main_text(page) == TEXT


def test_text_after_letters_that_lower_case_lengthens():
    page = "<p>" + "İ" * 60 + " first, one.</p><script>var a = '</p>';</script><p>Second paragraph, of the article.</p><SCRIPT>x</SCRIPT><p>Third, one.</p>"
    assert html_extract.main_text(page) == "İ" * 60 + " first, one.\nSecond paragraph, of the article.\nThird, one."


def test_unclosed_media_hold_nothing():
    for tag in ("video", "audio", "object", "svg", "canvas", "select", "template", "iframe", "noscript"):
        page = f"<article><p>First, of all.</p><{tag} src='x'><p>Second, para.</p></article>"
        assert html_extract.main_text(page) == "First, of all.\nSecond, para.", tag
    assert html_extract.main_text("<article><p>First, of all.</p><script>x<p>Second</p></article>") == "First, of all."
    assert html_extract.main_text("<article><p>a, <a href='x>b</a></p><p>c, d</p></article>") == "a, b\nc, d"


def test_time_grows_with_the_length():
    import time

    shapes = {
        "nested": "<div>x ", "open tags": "<a ", "open quotes": '<a "', "ends": "<b>", "titles": "<title>", "comments": "<!", "parts": "<div class='menu'><p>some words here, and more</p>",
        "items": "<section><li>x</li>", "forms": "<form>x", "paragraphs": "<b><p>x</p>",
    }
    for name, piece in shapes.items():
        page = piece * 20_000 + "</i>" * 20_000
        began = time.process_time()
        html_extract.main_text(page)
        assert time.process_time() - began < 10, name
