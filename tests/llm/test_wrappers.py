"""Pages whose article lies in a part with a word that marks other parts, odd markup, and the choice of blocks by brute force."""

import random
import time

import pytest

from nocturne.llm import html_extract as H
from nocturne.llm.html_extract import main_text

BODY = "<p>The first paragraph, which is long enough to count.</p><p>The second one, which is long enough too.</p>"
TEXT = "The first paragraph, which is long enough to count. The second one, which is long enough too."
SIDE = "<div class='sidebar'><p>Side text, not of the article.</p></div>"


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='content has-sidebar'><article>{BODY}</article>{SIDE}</div>",
        f"<div class='layout no-sidebar'><div class='elementor-widget'><article>{BODY}</article></div></div>",
        f"<section id='no-menu'><main>{BODY}</main></section>",
        f"<div class='layout no-sidebar'>{BODY}{SIDE}</div>",
        f"<div class='container has-sidebar'>{BODY}</div>",
        f"<div class='sidebar-left page'>{BODY}</div>",
        f"<section class='news legal'>{BODY}</section>",
        f"<form id='aspnetForm'>{BODY}</form>",
        f"<svg/><article>{BODY}</article>",
        f"<script src='a.js'/><article>{BODY}</article>",
        f"<svg><article>{BODY}</article>",
        f"<article class='post tag-ads category-legal'>{BODY}</article>{SIDE}",
        f"<div class='has-sidebar'>{BODY}<div class='comments'>" + "<div class='comment'><p>A reader's words, of some length.</p></div>" * 9 + "</div></div>",
        f"<article>{BODY}</article><div class='related'><article><p>A card, short.</p></article></div>",
        f"<article>{BODY}</article><div id='comments'><article class='comment-body'><p>Nice, really.</p></article></div>",
        f"<article>{BODY}</article><div class='x' style='display:none'><main><p>Not seen, never.</p></main></div>",
        f"<article>{BODY}<div class='share'>Tweet</div><p><span class='ad'>Buy</span></p><p class='advert'>Buy more, now.</p></article>",
        f"<article>{BODY}</article><div class='ad'>{'An advert with a lot of text, and more of it. ' * 9}</div>",
    ],
)
def test_marked_wrappers(page):
    assert main_text(f"<html><head><title>T</title><body><nav>Menu</nav>{page}<footer>foot</footer></body></html>") == TEXT


def test_words_in_the_article_stay():
    assert main_text(f"<article><p class='lead share-link'>A lead of the article, with words.</p>{BODY}</article>") == f"A lead of the article, with words. {TEXT}"
    assert main_text(f"<article><p>The <span class='social'>social</span> <b class='ad'>word</b>, here it is.</p>{BODY}</article>") == f"The social word, here it is. {TEXT}"
    assert main_text("<article><ul><li><p>one, two and three<li><p>second thing, here it is</ul></article>") == "one, two and three second thing, here it is"


@pytest.mark.parametrize(
    "unit", ["<div>x, y ", "<div><p>a, b", "<b>x", "<svg>", "<a '", "<a '<p \"", "<a 'x\" >", "<!-", "</div>", "<li><p>x", "<table><td>x", "<span class=ad>x", "<div class=ad>x", "&#"]
)
def test_time_is_linear_in_odd_markup(unit):
    begin = time.perf_counter()
    main_text(unit * 30_000 + ">")
    assert time.perf_counter() - begin < 8


def brute(blocks, parent, tag):
    """The choice, with paths as tuples of tags and every sum taken anew."""
    def full(j):
        return () if j == 0 else (*full(parent[j]), (j, tag[j]))

    paths = [full(p) for p, _ in blocks]
    order = list(dict.fromkeys(paths))
    ratio = lambda f: [sum(f(t) for q, (_, t) in zip(paths, blocks) if q == p) / paths.count(p) for p in order]
    smooth = lambda x: [(2 * v + x[max(0, i - 1)] + x[min(len(x) - 1, i + 1)]) / 4 for i, v in enumerate(x)]
    a, b = smooth(ratio(len)), smooth(ratio(lambda t: sum(t.count(c) for c in ".,;:!?")))
    score = {p: x * (1 + y) * (0.4 if any(t.endswith("*") for _, t in p) else 1) for p, x, y in zip(order, a, b)}
    mean = sum(score[p] * len(t) for p, (_, t) in zip(paths, blocks)) / sum(len(t) for _, t in blocks)
    content = [score[p] >= 0.5 * mean for p in paths]
    total = sum(len(t) for (_, t), c in zip(blocks, content) if c)
    heads = {p[:k] for p in paths for k in range(len(p))}
    weight = {h: sum(len(t) for p, (_, t), c in zip(paths, blocks, content) if c and len(p) > len(h) and p[: len(h)] == h) for h in heads}
    held = max((h for h in heads if 2 * weight[h] > total), key=len, default=())
    for k in range(1, len(held) + 1):
        if held[k - 1][1].rstrip("*") in ("article", "main"):
            held = held[:k]
            break
    return [c or p[: len(held)] == held and not any(t.endswith("*") for _, t in p[len(held) :]) for p, c in zip(paths, content)]


def test_choice_of_blocks_by_brute_force():
    rng = random.Random(5)
    chosen = 0
    for _ in range(400):
        page = H.Page("")
        paths = [0]
        for _ in range(rng.randint(1, 12)):
            paths.append(page.step(rng.choice(paths), rng.choice(["div", "p", "section*", "article", "main", "td", "*"])))
        blocks = [(rng.choice(paths[1:]), "".join(rng.choice("ab .,;") for _ in range(rng.randint(1, 60)))) for _ in range(rng.randint(1, 20))]
        got = H.chosen_blocks(blocks, page.parent, page.tag)
        assert got == brute(blocks, page.parent, page.tag)
        chosen += sum(got) < len(got)
    assert chosen > 50


def test_planted_articles_among_other_parts():
    """Pages put together of an article and parts that aren't: exactly the article comes out."""
    rng = random.Random(6)
    said = lambda n: " ".join(rng.choice("alpha beta, gamma delta. epsilon zeta; eta theta".split()) for _ in range(n))
    other = ["<nav><ul><li><a>{}</a></li></ul></nav>", "<div class='ad'>{}</div>", "<aside><p>{}</p></aside>", "<footer><p>{}</p></footer>", "<div id=comments><div class='comment'><p>{}</p></div></div>",
             "<form><label>{}</label></form>", "<div class='cookie-notice'>{}</div>", "<header><h2>{}</h2></header>", "<ul class='menu'><li>{}</li></ul>", "<p hidden>{}</p>", "<script>{}</script>", "<!-- {} -->"]
    for _ in range(200):
        paragraphs = [said(rng.randint(15, 60)) for _ in range(rng.randint(2, 8))]
        inner = "".join(f"<p>{p}</p>" for p in paragraphs)
        open_, close = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div class='content'>", "</div>"), ("<div class='wrap has-sidebar'>", "</div>")])
        parts = [rng.choice(other).format(said(rng.randint(2, 25))) for _ in range(rng.randint(0, 8))]
        parts.insert(rng.randrange(len(parts) + 1), open_ + inner + close)
        assert main_text("<body>" + "\n".join(parts) + "</body>") == " ".join(paragraphs)
