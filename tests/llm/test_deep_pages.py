"""Pages of a megabyte that nest without end, and article text in elements that are no furniture."""

import time

import pytest

from cuebook.llm import text_density

HOSTILE = {"b": "<p>" + "<b>x" * 250_000, "font": "<div>" + "<font>x" * 80_000 + "</i>" * 80_000, "nav": "<nav>" + "<b>" * 100_000 + "</i>" * 100_000,
           "nested nav": "<nav>" * 100_000 + "</nav></b>" * 80_000, "rows": "<table>" + "<tr><td>x" * 80_000, "items": "<ul>" + "<li>x<b>" * 80_000,
           "div": "<div>" * 150_000 + "x", "quotes": '<a "x>' * 150_000, "open": "<" * 1_000_000}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_grows_with_the_page(name):
    page = HOSTILE[name]
    begin = time.process_time()
    text_density.main_text(page)
    assert time.process_time() - begin < 30  # a quadratic walk takes hours


@pytest.mark.parametrize("wrapper", ["fieldset", "object", "map"])
def test_wrappers_that_say_nothing_keep_their_text(wrapper):
    long = "Words of an article that goes on for a while, as articles do. " * 5
    assert text_density.main_text(f"<main><{wrapper}><p>{long}</p></{wrapper}></main>") == long.strip()


def test_rows_end_their_cells():
    page = text_density.Page("<table><tr><td>a<td>b<tr><td>c</table><ul><li><p>x<li><p>y</ul>")
    assert [page.name[page.parent[i]] for i, n in enumerate(page.name) if n in ("tr", "td", "li")] == ["table", "tr", "tr", "table", "tr", "ul", "ul"]
