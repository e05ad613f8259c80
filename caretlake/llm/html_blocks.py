"""Web pages as sequences of blocks: text, the path of tags it stands under, how much is linked."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape
from zlib import crc32

# Markup, as far as it matters here: comments, declarations, tags with quoted attributes, and
# tags whose quotes never close. Other "<" are text.
_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?:[^a-zA-Z>][^>]*+)?(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)"
    r"(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|</?(?P<odd>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)", re.DOTALL)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""",
                    re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Elements that don't end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no text of the page.
_RAW = frozenset("script style noscript template iframe noembed noframes svg math canvas object "
                 "audio video".split())
# What an opening tag ends, and the elements that keep it from looking further.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}),
         "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
         "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
         "option": ({"option"}, {"select"}), "body": ({"head"}, {"body"})}

PATH_BUCKETS, WORD_BUCKETS = 1_024, 1_024


@dataclass
class Block:
    text: str
    path: frozenset   # buckets of tags, and of parts of class, id and role, from the root on
    linked: int       # characters inside links


def blocks_of(html: str) -> list[Block]:
    """The blocks in page order; markup nothing closes ends with the page.

    Linear in the page: a path holds every bucket once, however deep the page is.
    """
    out, pieces, linked = [], [], 0
    stack, open_tags = [("", frozenset())], {}
    link = 0  # depth of the stack where an open link began
    at, end = 0, len(html)

    def flush():
        nonlocal pieces, linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, stack[-1][1], linked))
            pieces, linked = [], 0

    def cut(depth: int):
        nonlocal link
        for tag, _ in stack[depth:]:
            open_tags[tag] -= 1
        del stack[depth:]
        if link > depth:
            link = 0

    def text(piece: str):
        nonlocal linked
        if piece:
            piece = unescape(piece) if "&" in piece else piece
            pieces.append(piece)
            if link:
                linked += len(piece.strip())

    while at < end:
        found = _MARKUP.search(html, at)
        if found is None:
            text(html[at:])
            break
        text(html[at:found.start()])
        at = found.end()
        tag = (found["tag"] or found["odd"] or "").lower()
        if not tag:
            continue
        closing = found["close"] or found[0].startswith("</")
        if tag in INLINE:
            if tag == "a":
                link = 0 if closing else len(stack)
            continue
        flush()
        if closing:
            if open_tags.get(tag):
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                cut(depth)
            continue
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.IGNORECASE).search(html, at)
            if close is None and tag not in ("script", "style"):
                continue
            at = close.start() if close else end
            continue
        if open_tags.get("p"):
            depth = len(stack) - 1
            while depth and stack[depth][0] not in ("p", "table", "button"):
                depth -= 1
            if stack[depth][0] == "p":
                cut(depth)
        if tag in VOID:
            continue
        same, stops = _ENDS.get(tag, ((), ()))
        if any(open_tags.get(t) for t in same):
            depth = len(stack) - 1
            while depth and stack[depth][0] not in same and stack[depth][0] not in stops:
                depth -= 1
            if depth and stack[depth][0] in same:
                cut(depth)
        own, above = features(tag, found["rest"] or ""), stack[-1][1]
        stack.append((tag, above if own <= above else above | own))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    return out


_FEATURES: dict = {}


def features(tag: str, rest: str) -> frozenset:
    """Buckets of a tag and of the words of its class, id and role."""
    found = _FEATURES.get((tag, rest))
    if found is None:
        names = [f"<{tag}>"]
        for value in _NAMED.findall(rest) if rest else ():
            names += [p.lower() for p in _PART.findall(unescape("".join(value)))]
        found = frozenset(crc32(n.encode()) % PATH_BUCKETS for n in names)
        if len(_FEATURES) > 50_000:
            _FEATURES.clear()
        _FEATURES[tag, rest] = found
    return found


_WORDS: dict = {}


def word_buckets(text: str) -> list[int]:
    """A bucket for each word, in small letters, without regard to punctuation around it."""
    out = []
    for word in text.split():
        bucket = _WORDS.get(word)
        if bucket is None:
            bare = word.lower().strip(".,;:!?()[]\"'«»„“”…|/").encode()
            bucket = crc32(bare) % WORD_BUCKETS
            if len(_WORDS) > 200_000:
                _WORDS.clear()
            _WORDS[word] = bucket
        out.append(bucket)
    return out
