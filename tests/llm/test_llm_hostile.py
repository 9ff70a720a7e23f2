"""Pages that no browser would make: parsed in time of their length, with all their text."""

import time

import pytest

from blockloom.llm import html_extract as html

SIZE = 1_000_000
HOSTILE = {
    "unclosed quotes": "<a '" * (SIZE // 4) + '<a ">',
    "quotes in names": "<a" * (SIZE // 2) + " '>",
    "stray end tags": "<b>" * (SIZE // 8) + "</i>" * (SIZE // 8),
    "end tags beyond a block": "<i><div>" + "<b>" * (SIZE // 8) + "</i>" * (SIZE // 8),
    "deep blocks": "<div>" * (SIZE // 5),
    "deep inline": "<b>x" * (SIZE // 4),
    "self-closed": "<b>" * (SIZE // 8) + "<br/>" * (SIZE // 8),
    "raw ends with quotes": "<script></script '" * (SIZE // 18) + ">",
    "comments": "<!--" * (SIZE // 4),
    "angles": "<" * SIZE,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_grows_with_the_length(name):
    began = time.monotonic()
    html.parsed(HOSTILE[name])
    assert time.monotonic() - began < 20  # a quadratic walk takes hours


def test_deep_elements_keep_their_text_and_few_nodes():
    n = 3 * html.OPEN
    page = "".join(f"<div class='c{k}'>t{k} " for k in range(n)) + "</div>" * n + "<p>end</p>"
    blocks, styles = html.parsed(page)
    assert [b.text for b in blocks] == [f"t{k}" for k in range(n)] + ["end"]
    assert len(styles) <= html.DEPTH + 2 and max(x.depth for x in styles.values()) == html.DEPTH
    wide = "<div>" + "".join(f"<p class='c{k}'>t{k}</p>" for k in range(2 * html.NODES))
    blocks, styles = html.parsed(wide)
    assert len(blocks) == 2 * html.NODES and len(styles) == html.NODES


def test_what_looks_like_a_tag():
    texts = lambda page: [b.text for b in html.main_blocks(page)]
    assert texts("<p>a <b title='x>y'>b</b> c") == ["a b c"]
    assert texts("<p>a <b title='x>y>b</b> c</p>") == ["a <b title='x>y>b c"]  # its quote never ends, so it is no tag
    assert texts("<p>3 < 4 <5 a<b") == ["3 < 4 <5 a"]  # no > follows the last
    assert texts("<p>one</i></b></div> two</p>") == ["one two"]
    assert texts("<i>a<div>b</i>c</div>d</i>e") == ["a", "bc", "d", "e"] or texts("<i>a<div>b</i>c</div>d</i>e") == ["a", "bc", "de"]


def test_articles_stand_before_comments_and_adverts():
    long = "Words of a reader. " * 20
    kept = lambda page: [b.text for b in html.main_blocks(page)]
    assert kept(f"<article><h1>T</h1><p>A short article.</p></article><section class='comments'><p>{long}</p></section>") == ["T", "A short article."]
    assert kept(f"<article><h1>T</h1><p>A short article.</p><div id='comments'><p>{long}</p></div></article>") == ["T", "A short article."]
    assert kept(f"<div class='ad'><p>{long}</p></div><article><p>Short.</p></article>") == ["Short."]
    assert kept(f"<div class='sidebar-layout'><p>{long}</p></div>") == [long.strip()]  # nothing else, and no article
    assert kept(f"<div class='banner-page'><article><p>{long}</p></article></div><article><p>More.</p></article>") == [long.strip(), "More."]
    assert kept(f"<article><div class='social-story'><p>{long}</p></div></article>") == [long.strip()]
