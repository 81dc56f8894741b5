"""Captions and heads of pages."""

import pytest

from lodestone.llm import media


def items(html):
    return [(x["text"] or x["ref"], x["caption"]) for x in media.sequence(html)]


def test_a_figcaption_beside_an_alt_text_is_kept():
    assert items("<figure><img src=a alt=x><figcaption>told <b>here</b></figcaption></figure>after") == [("a", "x"), ("told here", None), ("after", None)]


@pytest.mark.parametrize("start", ["<body>", "<p>", "<div>", ""])
def test_a_head_without_an_end_tag_ends(start):
    page = f"<html><head><meta charset=utf-8><title>T</title> <style>s</style><noscript><p>n</p></noscript>{start}one<p>two"
    assert items(page) == [("one", None), ("two", None)]
    assert items("<head><title>T</title></head>one") == [("one", None)]


def test_noscript_is_text_in_a_body():
    assert items("<body>a<noscript>b<img src=x></noscript>c") == [("ab", None), ("x", None), ("c", None)]
    assert items("<head><noscript>b<body>c") == [("c", None)]


def test_captions_break_words_and_end_before_media():
    assert items("<figure><img src=x><figcaption>one<p>two</p>three<br>four</figcaption></figure>") == [("x", "one two three four")]
    assert items("<figure><img src=x><figcaption>left open<img src=y>after") == [("x", None), ("left open", None), ("y", None), ("after", None)]
    assert items("<figure><figcaption>first<figcaption>second</figcaption><img src=x></figure>end") == [("first second", None), ("x", None), ("end", None)]
