"""Pages whose class names say nothing, names that only look like noise, and deep markup."""

import gc
import time

import pytest

from quillmill.llm import html_text

P = [f"Paragraph {i} of the article has a number of words that make it long enough to be read as text." for i in range(5)]


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}</body></html>"


def test_neutral_names_without_an_article():
    comments = "".join(f'<div class="x7"><span class="x8">user{i}</span><p>I have read this and want to say a long thing about it, number {i} of many such things.</p></div>' for i in range(3))
    raw = page(
        '<div class="x1"><a href=/>Home</a> <a href=/a>News</a> <a href=/b>About us</a> <a href=/c>Contact</a></div>'
        f'<div class="x2"><h1>Title of it</h1><div class="x3">{"".join(f"<p>{x}</p>" for x in P)}</div><div class="x4"><h3>3 Comments</h3>{comments}</div><div class="x5">Short box beside it.</div></div>'
        '<div class="x6"><p>&copy; 2024 Example Ltd. All rights reserved.</p></div>'
    )
    assert html_text.extract(raw).split("\n\n") == ["Title of it", *P]


def test_flat_body():
    raw = page(f"<h1>Title</h1>{''.join(f'<p>{x}</p>' for x in P)}<ul><li><a href=1>One more</a><li><a href=2>Two more</a><li><a href=3>Three more</a></ul><h2>Comments</h2><p>A reader says so.</p>")
    assert html_text.extract(raw).split("\n\n") == ["Title", *P]


def test_article_in_several_boxes_of_one_class():
    raw = page(f'<div class="w"><div class="s"><p>{P[0]}</p><p>{P[1]}</p></div><div class="s"><p>{P[2]}</p><p>{P[3]}</p><p>{P[4]}</p></div></div><div class="f">© 2020 X</div>')
    assert html_text.extract(raw).split("\n\n") == P


@pytest.mark.parametrize(
    "attributes",
    ['title="the hidden cost of it"', 'data-id="comments-3"', 'data-role="banner"', "data-hidden", 'data-x=\'class="ad"\'', 'class="notice-of-motion"', 'class="related-work"', 'id="notification-systems"', 'aria-label="search"'],
)
def test_attributes_that_only_look_like_noise(attributes):
    for tag in ("p", "div", "section"):
        raw = page(f"<article><h1>T</h1><p>{P[0]}</p><{tag} {attributes}>{P[1]}</{tag}></article>")
        assert html_text.extract(raw).split("\n\n") == ["T", P[0], P[1]]


@pytest.mark.parametrize("attributes", ["hidden", "HIDDEN", 'style="display: none"', 'aria-hidden="true"', 'class="ad"', 'class="x ad-slot-1"', 'id="comments"', 'class="related-posts"', 'class="share-buttons"', 'class="post-comments"', 'role="search"'])
def test_names_of_parts_that_are_no_content(attributes):
    raw = page(f"<article><h1>T</h1><p>{P[0]}</p><div {attributes}><p>{P[1]}</p></div></article>")
    assert html_text.extract(raw).split("\n\n") == ["T", P[0]]


@pytest.mark.parametrize("name", ["discussion", "social", "related-work", "notification-systems", "copyright"])
def test_sections_with_ids_of_their_titles(name):
    raw = page(f'<article><h1>T</h1><p>{P[0]}</p><section id="{name}"><h2 id="{name}-2">{name}</h2><p>{P[1]}</p></section></article>')
    assert html_text.extract(raw).split("\n\n") == ["T", P[0], name, P[1]]


def test_comments_as_articles_and_outside_of_it():
    raw = page(f'<article><h1>T</h1><p>{P[0]}</p><p>{P[1]}</p></article><div class="q"><p>{P[2]}</p><p>{P[3]}</p></div><article class="comment"><p>{P[4]}</p></article>')
    assert html_text.extract(raw).split("\n\n") == ["T", P[0], P[1]]


@pytest.mark.parametrize("parts", [("<b>", "<hr>"), ("<span>", "</div>"), ("<div>", "<li>"), ("<p><button><b>", "<hr>"), ("<nav><i>", "</b>"), ("<ul><li>", "</p>"), ("<table><tr><td>", "<tr>"), ("<div><p>text", "</span>")])
def test_linear_in_depth(parts):
    def took(n):
        raw = page(parts[0] * n + parts[1] * n + "end")
        best = 9e9
        gc.disable()  # collections fall on any of the runs
        for _ in range(5):
            began = time.process_time()
            html_text.extract(raw)
            best = min(best, time.process_time() - began)
        gc.enable()
        return best

    took(1000)
    assert took(8000) < 3 * took(4000) + 0.02
