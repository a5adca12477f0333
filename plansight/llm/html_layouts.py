"""The small labelled table that the block classifier of ``html_text`` is trained on.

Page layouts, with a placeholder per text block: ``{+p}`` is a paragraph of
the article, ``{-s}`` a short text of the page around it, and so on. Filled
with invented words (those of the article start with m, others with b), every
layout gives pages whose blocks carry their label in their first letter.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

#: Least and most words of a block by kind; lengths are drawn evenly in their logarithm.
KINDS = {"p": (2, 160), "q": (9, 160), "h": (1, 14), "s": (1, 5), "n": (4, 40), "c": (3, 120), "t": (1, 9)}

MENU = "<ul><li><a href='/1'>{-s}</a></li><li><a href='/2'>{-s}</a></li><li><a href='/3'>{-s}</a></li></ul>"
LINKS = "<div><a href='/1'>{-s}</a> | <a href='/2'>{-s}</a> | <a href='/3'>{-t}</a></div>"
BODY = "<h1>{+h}</h1><p>{+p}</p><p>{+p} <a href='/x'>{+s}</a> {+p}</p><h2>{+h}</h2><p>{+p}<ul><li>{+p}<li>{+p}</ul><p>{+p}</p>"
PLAIN = "<h1>{+h}</h1><p>{+q}</p><p>{+q} <a href='/x'>{+s}</a> {+q}</p><p>{+q}</p>"
RAGGED = "<h1>{+h}</h1><p><b>{+p}<br><p>{+p}<p>{+p}</p><p><b>{+s}<br><p>{+p}</p><blockquote>{+p}</blockquote>"
COMMENTS = "<h3>{-s}</h3><div><b>{-s}</b><p>{-c}</p></div><div><b>{-s}</b><p>{-c}</p><p>{-c}</p></div>"
FORM = "<form><p>{-n}</p><label>{-s}</label><input><button>{-s}</button></form>"

#: The layouts: given by their parts, so that each part is seen in several places.
LAYOUTS = [
    f"<nav>{MENU}</nav><div class='ad'>{{-n}}</div><article>{RAGGED}</article><footer>{{-n}}</footer>",
    f"<nav>{MENU}</nav><!-- x --><div class='advert'>{{-s}}</div><article><h1>{{+h}}</h1></article><footer>{{-n}}</footer>",
    f"<header><h1>{{-s}}</h1><p>{{-n}}</p><nav>{MENU}</nav></header><main><article>{BODY}</article></main><aside><p>{{-n}}</p>{MENU}</aside>"
    f"<footer>{LINKS}<p>{{-n}}</p></footer>",
    f"<div id='header'><div>{{-s}}</div>{LINKS}</div><div id='content'>{PLAIN}</div><div id='sidebar'><h3>{{-s}}</h3><p>{{-n}}</p>{MENU}</div>"
    f"<div id='footer'><p>{{-n}}</p></div>",
    f"<header>{{-s}}</header><main><header><h1>{{+h}}</h1><p>{{+t}}</p></header><p>{{+p}}</p><p>{{+p}}</p><aside>{{-n}}</aside><p>{{+p}}</p></main>"
    f"<section class='comments'>{COMMENTS}{FORM}</section><footer>{{-n}}</footer>",
    f"<div class='cookie-notice'><p>{{-n}}</p><button>{{-s}}</button></div><nav>{MENU}</nav><article>{BODY}</article>"
    f"<div id='comments'>{COMMENTS}</div><footer>{{-n}}</footer>",
    f"<div>{LINKS}</div><div>{PLAIN}</div><div>{LINKS}</div><div>{{-s}}</div>",
    f"<div>{MENU}</div><div>{PLAIN}</div><div>{MENU}</div><p>{{-s}}</p>",
    f"<table><tr><td>{MENU}</td><td>{PLAIN}</td></tr></table><div>{LINKS}</div>",
    f"<div class='navbar'>{LINKS}</div><div class='post'><h2>{{+h}}</h2><div class='entry-content'><p>{{+p}}</p><p>{{+p}}</p><p>{{+p}}</p></div>"
    f"<div class='share'><a href='/f'>{{-s}}</a></div></div><div class='related'><h3>{{-s}}</h3>{MENU}</div><div class='footer'>{{-n}}</div>",
    f"<article>{BODY}<div class='promo'>{{-n}}</div><p>{{+p}}</p><section id='comments'>{COMMENTS}</section></article><footer>{{-n}}</footer>",
    f"<article><h1>{{+h}}</h1><p>{{+p}}</p><nav>{MENU}</nav><p>{{+p}}</p>{FORM}<p>{{+t}}</p><footer><p>{{-n}}</p></footer></article>",
    f"<form id='page'><div>{LINKS}</div><div id='main'>{PLAIN}<p>{{+q}}</p></div><div class='sidebar'>{{-n}}</div></form>",
    f"<header><a href='/'>{{-s}}</a></header><article><p>{{+p}}</p></article><aside><article><h4><a href='/z'>{{-s}}</a></h4><p>{{-n}}</p></article></aside>",
    f"<nav>{MENU}</nav><article><h1>{{+h}}</h1><table><tr><td>{{+t}}</td><td>{{+t}}</td></tr><tr><td>{{+t}}</td><td>{{+t}}</td></tr></table><p>{{+p}}</p>"
    f"</article><div>{{-n}}</div><div>{LINKS}</div>",
    f"<main><h1>{{+h}}</h1><p>{{+p}}</p><p><a href='/a'>{{+t}}</a> {{+q}}</p><ul><li><a href='/b'>{{+s}}</a> {{+p}}</li></ul></main><p>{{-n}}</p>",
    f"<div role='banner'>{{-n}}</div><div role='navigation'>{MENU}</div><div role='main'>{PLAIN}<p>{{+p}}</p></div>"
    f"<div role='complementary'>{{-n}}</div><div role='contentinfo'>{{-n}}</div>",
    f"<div>{{-s}}</div>{LINKS}{PLAIN}<p>{{+q}}</p>{COMMENTS.replace('<div>', '<div class=comment>')}<div>{{-s}}</div>",
    f"<nav>{MENU}</nav><section><h1>{{+h}}</h1><p>{{+q}}</p><p>{{+q}}</p><p>{{+q}}</p></section>",
    f"<div class='nav'>{MENU}</div><div class='ad'>{{-n}}</div><div class='text'><h1>{{+h}}</h1><p>{{+p}}</p><p>{{+p}}</p><p>{{+p}}</p></div>",
    PLAIN, f"<div>{MENU}</div>{PLAIN}", "<h1>{+h}</h1><p>{+q}</p><p>{+q}</p><p>{+q}</p><p>{+q}</p>",
    "<div>{+q}</div><div>{+q}</div><div>{+q}</div>",
    "<p>{+q}</p><p>{+p}</p><p>{+q}</p>", "<p>{+p}</p>", "{+p}", "<h1>{+h}</h1><p>{+q}</p>", "<article><p>{+t}</p></article>",
]


def pages(seed: int, copies: int, layouts: list[str] | None = None) -> Iterator[str]:
    """Pages of every layout, ``copies`` of each."""
    rng = random.Random(seed)

    def fill(m: re.Match) -> str:
        low, high = KINDS[m[2]]
        n = max(low, round(low * (high / low) ** rng.random()))
        letter = "m" if m[1] == "+" else "b"
        words = [letter + "".join(rng.choices("aeionrstl", k=rng.randint(1, 9))) for _ in range(n)]
        return " ".join(words) + ("." if m[2] in "pqnc" and rng.random() < 0.8 else "")

    for layout in LAYOUTS if layouts is None else layouts:
        for _ in range(copies):
            yield "<html><head><title>b</title></head><body>" + re.sub(r"\{([+-])(\w)\}", fill, layout) + "</body></html>"
