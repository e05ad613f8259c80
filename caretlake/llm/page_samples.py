"""Labelled pages to learn from: made-up layouts, and pages whose own markup tells.

A label is the sentinel character in a block's text: such blocks belong to the article.
"""

from __future__ import annotations

from random import Random

from caretlake.llm.html_blocks import Block, blocks_of, features

SENTINEL = ""

# Parts of a page around the article: elements, words of class and id, words of the text.
FURNITURE = {
    "menu": ("nav div ul", "nav menu navbar navigation breadcrumb breadcrumbs crumbs pagination "
             "pager links topnav skip", "home about contact news index next previous"),
    "header": ("header div", "header masthead topbar banner logo branding top site",
               "welcome home site menu login search"),
    "sidebar": ("aside div section", "sidebar side aside widget rail related recommended popular "
                "trending archive tags complementary more", "related popular archive more latest"),
    "advert": ("div aside section", "ad ads advert advertisement adsense sponsored sponsor promo "
               "promotion adslot", "advertisement sponsored buy sale offer"),
    "notice": ("div section p", "cookie cookies consent notice notification alert gdpr modal popup "
               "newsletter subscribe signup paywall disclaimer dialog", "cookies accept privacy "
               "subscribe newsletter agree consent"),
    "form": ("form", "search login signup contact form subscribe", "search email password send name"),
    "comments": ("div section ol article", "comment comments respond reply replies discussion "
                 "thread responses", "reply comments says posted"),
    "share": ("div ul", "share sharing social follow toolbar buttons", "share tweet follow print"),
    "footer": ("footer div", "footer foot copyright legal colophon bottom credits contentinfo",
               "copyright © rights reserved imprint privacy terms"),
}
ARTICLE = ("article main div section", "article content post entry story main body text")

# Elements that stand for their parts in pages of the table, and words that do.
_AROUND_TAGS = "nav header footer aside form button select textarea label title dialog".split()


_PARTS = ("th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve "
          "ch ie un la que ción men ge ver ß ü é ñ ö").split()


def _words(rng: Random, n: int) -> str:
    """Made-up words; some capitals and stops."""
    words = ["".join(rng.choices(_PARTS, k=rng.randint(1, 4))) for _ in range(max(1, n))]
    return " ".join(w.capitalize() + "." if rng.random() < 0.1 else w for w in words)


def _element(rng, tags: str, names: str, inside: str, bare: bool = False) -> str:
    tag = "div" if bare else rng.choice(tags.split())
    mark = "" if bare else _mark(rng, names, needed=tag in ("div", "section", "ul", "ol", "p", "article"))
    return f"<{tag}{mark}>{inside}</{tag}>"


def _mark(rng, names: str, needed: bool) -> str:
    if not needed and rng.random() < 0.5:
        return ""
    chosen = rng.sample(names.split(), 1 + (rng.random() < 0.4))
    if rng.random() < 0.3:
        chosen.append(rng.choice("box wrapper block inner left right main".split()))
    return f' {"id" if rng.random() < 0.2 else "class"}="{rng.choice("-_ ").join(chosen)}"'


def _furniture(rng, kind: str, bare: bool = False) -> str:
    tags, names, words = FURNITURE[kind]
    some = lambda: rng.choice(words.split())
    links = "".join(f'<li><a href="/x">{_words(rng, rng.randint(1, 3))}</a></li>'
                    for _ in range(rng.randint(1, 6)))
    if kind == "menu":
        inside = f"<ul>{links}</ul>" if rng.random() < 0.7 else links.replace("li>", "span>")
    elif kind in ("sidebar", "share"):
        inside = f"<h3>{some()} {_words(rng, 2)}</h3><ul>{links}</ul>"
        if rng.random() < 0.5:
            inside += f"<p>{_words(rng, rng.randint(3, 39))}</p>"
    elif kind == "form":
        inside = (f"<label>{some()}</label><input name=q><button>{some()}</button>"
                  f"<p>{_words(rng, rng.randint(1, 11))}</p>")
    elif kind == "comments":
        inside = "".join(f'<div><b>{_words(rng, 1)}</b> {some()}<p>{_words(rng, rng.randint(3, 59))}</p></div>'
                         for _ in range(rng.randint(1, 3)))
    elif kind in ("advert", "notice") and rng.random() < 0.7:
        inside = _words(rng, rng.randint(2, 29))
        inside = f"<p>{inside}</p>" if rng.random() < 0.4 else inside
    elif kind == "header" and not bare and rng.random() < 0.5:
        inside = f"<h1>{_words(rng, 2)}</h1><p>{_words(rng, 4)}</p>"
    else:
        inside = f"{some()} {_words(rng, rng.randint(1, 11))} {some()}"
    return _element(rng, tags, names, inside, bare)


def _article(rng, bare: bool) -> str:
    parts = []
    if rng.random() < 0.85:
        level = "h1" if rng.random() < 0.7 else "h2"
        parts.append(f"<{level}>{SENTINEL}{_words(rng, rng.randint(1, 9))}</{level}>")
    for _ in range(rng.randint(1, 8) if rng.random() < 0.8 else rng.randint(9, 40)):
        size = rng.choice((1, 1, 1, 2, 4, 8)) if rng.random() < 0.4 and not bare else rng.randint(12, 119)
        own = SENTINEL + _words(rng, size)
        draw = rng.random()
        if draw < 0.6:
            parts.append(f"<p>{own}</p>")
        elif draw < 0.7:
            parts.append(f"<p><b>{own}<br>{SENTINEL}{_words(rng, 8)}")
        elif draw < 0.78:
            parts.append("<ul>" + "".join(f"<li>{SENTINEL}{_words(rng, rng.randint(1, 14))}</li>"
                                          for _ in range(3)) + "</ul>")
        elif draw < 0.84:
            parts.append(f"<blockquote>{own}</blockquote>")
        elif draw < 0.88:
            parts.append(f"<table><tr><td>{own}</td><td>{SENTINEL}{_words(rng, 2)}</td></tr></table>")
        elif draw < 0.92:
            parts.append(f"<figure><img><figcaption>{own}</figcaption></figure>")
        elif draw < 0.96:
            parts.append(f'<p>{own} <a href="/x">{_words(rng, 3)}</a></p><h3>{SENTINEL}{_words(rng, 4)}</h3>')
        else:
            parts.append(f"<div>{own}</div>")
    for kind in ("advert", "share", "sidebar", "comments", "notice", "form", "menu"):
        if not bare and rng.random() < 0.12:
            parts.insert(rng.randint(0, len(parts)), _furniture(rng, kind))
    inside = "".join(parts)
    if not bare and rng.random() < 0.4:
        inside = _element(rng, *ARTICLE, inside)
    return inside if bare and rng.random() < 0.5 else _element(rng, *ARTICLE, inside, bare)


def made_page(rng: Random) -> str:
    """A page of a random layout; a bare one has no names, so only its texts tell."""
    bare = rng.random() < 0.12
    before = ["menu"] if bare else ["header", "menu", "notice", "advert", "form", "sidebar", "share"]
    after = ["menu", "footer"] if bare else ["sidebar", "share", "advert", "comments", "form", "notice",
                                             "menu", "footer"]
    title = f"<head><title>{_words(rng, 5)}</title></head>" if rng.random() < 0.9 else ""
    top = [_furniture(rng, k, bare) for k in rng.sample(before, len(before)) if rng.random() < 0.45]
    body = [_article(rng, bare)]
    below = [_furniture(rng, k, bare) for k in after if rng.random() < 0.5]
    inside = "".join([*top, *body, *below])
    if rng.random() < 0.4:
        inside = f'<div{_mark(rng, "page wrapper container site layout root outer", False)}>{inside}</div>'
    return f"<html>{title}<body>{inside}</body></html>"


def told_by_markup(html: str) -> tuple[list[Block], list[bool]]:
    """Blocks of a page with <article> or <main>, and which of them it marks as the article's."""
    blocks = blocks_of(html)
    inside = features("article", "") | features("main", "")
    around = frozenset().union(*(features(t, "") for t in _AROUND_TAGS))
    words = " ".join(names for _, names, _ in FURNITURE.values())
    around |= features("", f' class="{words}"') - features("", "")
    return blocks, [bool(b.path & inside) and not b.path & around for b in blocks]


def made_up(pages: int, seed: int = 7) -> list[tuple[list[Block], list[bool]]]:
    rng, out = Random(seed), []
    for _ in range(pages):
        blocks = blocks_of(made_page(rng))
        labels = [SENTINEL in b.text for b in blocks]
        for b in blocks:
            b.text = b.text.replace(SENTINEL, "")
        out.append((blocks, labels))
    return out
