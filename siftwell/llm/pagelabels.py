"""Labelled web pages to learn from: pages of real size made by rule from a seed, each with
the texts of its blocks that are content. Layouts differ in what holds the content (an
article, a main, a div, nothing), in the markup of its blocks, and in what stands around it
(menus, notices, adverts, lists of links, teasers, legal lines), with nothing in names or classes to
tell these apart."""

from __future__ import annotations

import random

_PARTS = "ba ke lo mi nu ra se ti vo du fa gi ho ja ol en ar is um or".split()


def _words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(_PARTS) for _ in range(rng.choice((1, 2, 2, 3)))) for _ in range(n)]


def _sentences(rng: random.Random, n: int) -> str:
    out: list[str] = []
    while len(out) < n:
        s = _words(rng, min(n - len(out), rng.randint(4, 18)))
        s[0], s[-1] = s[0].capitalize(), s[-1] + "."
        out += s
    return " ".join(out)


def _content(rng: random.Random) -> tuple[str, list[str]]:
    """Markup and block texts of one article."""
    head = " ".join(_words(rng, rng.randint(3, 9))).capitalize()
    html, texts = [f"<h1>{head}</h1>"], [head]

    def add(tag: str, n: int) -> None:
        t = _sentences(rng, n)
        texts.append(t)
        if rng.random() < 0.3:  # inline markup within a block
            w = t.split(" ")
            i = rng.randrange(len(w))
            w[i] = f"<{(k := rng.choice(('b', 'em', 'a')))}>{w[i]}</{k}>"
            t = " ".join(w)
        html.append(f"<{tag}>{t}" + ("" if tag == "p" and rng.random() < 0.1 else f"</{tag}>"))

    for _ in range(rng.randint(2, 14)):
        kind = rng.random()
        if kind < 0.8:
            add("p", rng.randint(8, 90))
        elif kind < 0.86:
            add("h2", rng.randint(2, 7))
        elif kind < 0.92:
            add("blockquote", rng.randint(10, 40))
        else:
            html.append("<ul>")
            for _ in range(rng.randint(2, 6)):
                add("li", rng.randint(3, 16))
            html.append("</ul>")
    return "\n".join(html), texts


def _links(rng: random.Random) -> str:
    items = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in _words(rng, rng.randint(3, 14)))
    return f"<ul>{items}</ul>"


def _line(rng: random.Random) -> str:
    return f"<div>{' '.join(_words(rng, rng.randint(1, 8)))}</div>"


def page(rng: random.Random) -> tuple[str, list[str]]:
    """(html, texts of the content's blocks in order)."""
    inside, texts = _content(rng)
    before = [rng.choice((_links, _line))(rng) for _ in range(rng.randint(1, 4))]
    after = [rng.choice((_links, _line))(rng) for _ in range(rng.randint(1, 5))]
    around = rng.choice(("article", "article", "main", "div", "section", ""))
    body = f"<{around}>{inside}</{around}>" if around else inside
    if around == "article" and rng.random() < 0.3:
        body = f"<main>{body}</main>"
    title = " ".join(_words(rng, 4))
    return f"<html><head><title>{title}</title><style>p{{margin:0}}</style></head><body>{''.join(before)}{body}{''.join(after)}</body></html>", texts


def pages(n: int, seed: int) -> list[tuple[str, list[str]]]:
    rng = random.Random(seed)
    return [page(rng) for _ in range(n)]
