"""Pages whose text stands in no paragraph, and markup that nests or never ends."""

from __future__ import annotations

import time

import pytest

from tallywise.llm.main_text import main_text

SENTENCE = "The harvest was late this year, and the mills, old as they are, ran through the night. "
STORY = (SENTENCE * 40).strip()


@pytest.mark.parametrize("page", [
    f"<body>{STORY}</body>",
    f"<html><head><title>T</title></head><body><nav><a href=x>Home</a> Menu</nav>{STORY}<footer>Imprint</footer></body></html>",
    f"<body><center>{STORY}</center></body>",
    STORY,
    f"<fieldset>{STORY}</fieldset>",
])
def test_text_in_no_paragraph(page):
    assert main_text(page) == STORY


def test_breaks_inside_the_body():
    page = "<body>" + "<br><br>".join([SENTENCE] * 30) + "</body>"
    assert main_text(page) == STORY.removesuffix(" ")[: len(" ".join([SENTENCE.strip()] * 30))]


def test_paragraphs_still_win_over_stray_text():
    page = f"<body>Skip to content<div class=menu><a>Home</a></div><article><h1>Title</h1><p>{STORY}</p></article></body>"
    assert main_text(page) == f"Title\n{STORY}"


@pytest.mark.parametrize("page", [
    "<div>" * 200_000 + STORY,
    "<div>" * 200_000 + "</p>" * 200_000 + f"<p>{STORY}</p>",
    "<center>" * 200_000 + STORY,
    "<li><center>" * 100_000 + STORY,
    f"<p>{STORY}" + "<form>" * 10 + "<center>" * 100_000,
    "</div></p></li></table>" * 100_000 + f"<p>{STORY}</p>",
    "<table><tr><td>" * 60_000 + f"<p>{STORY}</p>",
])
def test_time_is_linear(page):
    start = time.monotonic()
    got = main_text(page)
    assert time.monotonic() - start < 20
    assert got in ("", STORY)
