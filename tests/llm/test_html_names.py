"""HTML extraction keeps text whose class or id only resembles furniture."""

import pytest

from fauntrack.llm import html_extract

P = "Words of a paragraph, with commas, that go on for a while so that they score. " * 3


@pytest.mark.parametrize("wrapper", ["div class='content-with-sidebar'", "div class='post no-sidebar'", "section class='article-header'", "div class=side", "div id=menu", "form action=/ id=aspnetForm", "div class='header page'"])
def test_wrappers_keep_their_text(wrapper):
    page = f"<body><div class=menu><a>x</a></div><{wrapper}><p>{P}</p><p>{P}</p></{wrapper.split()[0]}><div class=footer>end</div></body>"
    assert html_extract.extract(page) == f"{P.strip()}\n{P.strip()}"


def test_part_of_a_name_is_no_name():
    page = f"<article><p>{P}</p><p class='side-note'>A note, at the side.</p><p>{P}</p></article>"
    assert "A note, at the side." in html_extract.extract(page)


def test_furniture_still_goes():
    page = f"<main><article><p>{P}</p></article><div class=comments>" + f"<p>Reply. {P}</p>" * 9 + "</div></main><form><p>Your name, please</p></form>"
    assert html_extract.extract(page) == P.strip()
    page = f"<article><p>{P}</p><div class=comments>" + f"<p>Reply. {P}</p>" * 9 + "</div></article>"
    assert html_extract.extract(page) == P.strip()
