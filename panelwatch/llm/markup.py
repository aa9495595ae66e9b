"""Blocks of a web page: a small reader of HTML for :mod:`panelwatch.llm.pages`.

``blocks`` goes through the tags once, keeps the open elements on a stack and says for each piece of text whether it is
left out and in which region it stands. Unclosed and stray tags are allowed: end tags without a start are ignored, a
block closes an open paragraph, and an article is only closed by its own end. The work is linear in the page.
"""

from __future__ import annotations

import re
from html import unescape

# Kinds of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong "
             "sub sup time tt u var wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
DROPPED = set("script style noscript template svg iframe object embed canvas audio video head title aside fieldset button select "
              "option textarea datalist dialog menuitem footer noembed noframes".split())
#: Left out, but an article inside counts (the element was not closed, or the whole page is one form).
PIERCED = {"nav", "form", "menu"}
ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}

# Words in class names, ids and roles. An article inside an element of the second list counts all the same.
NEVER = set("comment comments disqus respond replies related recommended recommendations breadcrumb breadcrumbs pagination pager share sharing "
            "social newsletter subscribe subscription signup login complementary contentinfo search form dialog".split())
LAYOUT = set("ad ads adbox adslot adsbygoogle advert adverts advertisement advertising advertorial adsense banner sponsor sponsored sponsors promo promotion cookie cookies consent gdpr "
             "popup modal overlay notice notices notification notifications alert sidebar header footer nav navbar navigation menu menubar masthead "
             "topbar toolbar widget widgets".split())
CONTENT = set("content article post story entry main".split())
NOT_AN_ARTICLE = {"comment", "reply", "related", "teaser", "promo", "ad", "advert"}

TAG = re.compile(r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)|[!?/][^>]*(?:>|\Z))", re.S)
END = re.compile(r"=\s*([\"'])|>")
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
KEPT, LAID_OUT, LEFT_OUT = 0, 1, 2
ANYWHERE, IN_CONTENT, IN_MAIN, IN_ARTICLE = range(4)


def tag_end(html: str, at: int, lost: set) -> int:
    """Place after the ``>`` that ends the tag; -1 if there is none. ``lost`` holds quotes known not to come again."""
    while m := END.search(html, at):
        quote = m.group(1)
        if not quote:
            return m.end()
        at = m.end()
        if quote not in lost:
            close = html.find(quote, at)
            if close < 0:
                lost.add(quote)
            else:
                at = close + 1
    return -1


def verdict(name: str, attributes: str, region: int) -> tuple[int, int]:
    """How an element is treated by its own name, class, id and role: (left out, region)."""
    own = IN_ARTICLE if name == "article" else IN_MAIN if name == "main" else ANYWHERE
    out = LEFT_OUT if name in DROPPED else LAID_OUT if name in PIERCED or name == "header" and region < IN_ARTICLE else KEPT
    if out == LEFT_OUT or name in ("html", "body") or "=" not in attributes:
        return out, own
    for key, *values in ATTRIBUTE.findall(attributes):
        for label in "".join(values).split():
            if key.lower() == "role" and label.lower() in ("main", "article"):
                own = max(own, IN_MAIN if label.lower() == "main" else IN_ARTICLE)
                continue
            words = [w.lower() for w in PARTS.findall(label)]
            if own >= IN_MAIN:
                out = max(out, LEFT_OUT if len(words) == 1 and words[0] in NOT_AN_ARTICLE else KEPT)
            elif words and words[0] not in ("has", "no", "with", "without"):
                if region == IN_ARTICLE and "header" in words:
                    words.remove("header")
                if NEVER.intersection(words):
                    return LEFT_OUT, own
                if LAYOUT.intersection(words):
                    out = max(out, LAID_OUT)
                elif CONTENT.intersection(words):
                    own = max(own, IN_CONTENT)
    return out, own


def blocks(html: str) -> tuple[list[str], bool]:
    """Texts of the main region's blocks in page order, and whether the page marks that region (article or main)."""
    found, text = [], []
    stack = [("", KEPT, ANYWHERE, False)]  # name, left out, region, inline
    open_at: dict[str, list[int]] = {}
    solid, articles = [0], []              # places of elements that are not inline, and of articles
    lost: set[str] = set()

    def flush():
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                found.append((stack[-1][2], joined))
            text.clear()

    def close(place):
        while len(stack) > place:
            name, _, _, inline = stack.pop()
            open_at[name].pop()
            if not inline:
                solid.pop()
            if articles and articles[-1] == len(stack):
                articles.pop()

    at = 0
    while at < len(html):
        start = html.find("<", at)
        m = TAG.match(html, start) if start >= 0 else None
        while start >= 0 and not m:
            start = html.find("<", start + 1)
            m = TAG.match(html, start) if start >= 0 else None
        if stack[-1][1] == KEPT:
            piece = html[at:start if start >= 0 else len(html)]
            if piece:
                text.append(unescape(piece) if "&" in piece else piece)
        if start < 0:
            break
        at, name = m.end(), m.group(2)
        if not name:
            continue
        name, ending = name.lower(), bool(m.group(1))
        first, at = at, tag_end(html, at, lost)
        if at < 0:
            break
        inline = name in INLINE or "-" in name
        if not inline:
            flush()
        if ending:
            places = open_at.get(name)
            if places:
                place = places[-1]
                if place > solid[-1] if inline else name in ("article", "main") or not articles or place > articles[-1]:
                    close(place)
            continue
        if name in VOID:
            continue
        if not inline and stack[solid[-1]][0] == "p":
            close(solid[-1])
        if name in ITEMS and stack[solid[-1]][0] in ITEMS[name]:
            close(solid[-1])
            if name == "tr" and stack[solid[-1]][0] == "tr":
                close(solid[-1])
        _, outer, region, _ = stack[-1]
        out, own = verdict(name, html[first:at - 1], region)
        if own >= IN_MAIN and out == KEPT and outer == LAID_OUT:
            outer = KEPT
        if name in RAW:
            m = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, at)
            if not m:
                break
            if max(out, outer) == KEPT:
                text.append(html[at:m.start()])
            at = tag_end(html, m.end(), lost)
            if at < 0:
                break
            continue
        if html[at - 2] == "/" and outer == LEFT_OUT:
            continue  # <path/> and the like inside drawings
        stack.append((name, max(out, outer), max(own, region), inline))
        open_at.setdefault(name, []).append(len(stack) - 1)
        if not inline:
            solid.append(len(stack) - 1)
        if name == "article":
            articles.append(len(stack) - 1)
    flush()
    best = max((region for region, _ in found), default=ANYWHERE)
    return [t for region, t in found if region == best], best >= IN_MAIN
