"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A page is parsed into elements and runs of text. Each gets features of its
subtree (text, links, tags and sentences against each other and the page), of its
and its ancestors' tags and attribute tokens, of its depth and of its siblings.
Boosted trees, trained here on generated pages whose parts are known, give the
odds that a node holds article text. Decoding chooses the labels of all nodes
together: what is below a dropped node is dropped, and among such labellings the
likeliest is found by one pass up and one down the tree.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gbdt import BoostedTrees

_NAME = r"<(/?)([a-zA-Z][^\s/>]*+)"
#: A tag; one where quotes hold no "<", for pages on which a quote is not closed; one that ends at the first ">" whatever the quotes are.
_TAG_AT = re.compile(_NAME + r"""((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_BROKEN_TAG_AT = re.compile(_NAME + r"""((?:[^<>"']++|"[^"<]*"|'[^'<]*')*+)>""")
_ANY_TAG_AT = re.compile(_NAME + r"([^>]*)>")
_ATTR = re.compile(r"""(?<![-\w:.@])([a-zA-Z_:@][-\w:.]*+)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: A number above all characters, which is too long to be read as one.
_HUGE = re.compile(r"&#0*[1-9][0-9]{7,};?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
SKIP = frozenset("head script style template noscript iframe svg canvas audio video select textarea button datalist".split())
RAW = frozenset("script style textarea title iframe noscript".split())
#: Start tags that may stand in a head; any other, or text, ends it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Elements of SKIP that end at the next block boundary if nothing closes them; those of NO_NEST end at another of their kind.
ENDS_OPEN, NO_NEST = frozenset("svg canvas audio video select button datalist".split()), frozenset("select button".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr legend li main menu nav ol p pre section summary table caption thead tbody tfoot tr td th ul".split())
#: Start tags that end an open element of these kinds, as far as the nearest of the others.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "li"}

#: Attribute tokens by what they speak of; each group is a feature of a node and of its ancestors.
TOKENS = {
    "good": "article content post entry story main body text page prose copy",
    "ad": "ad ads advert advertisement adsense banner sponsor sponsored promo promotion promoted commercial",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs sitemap topbar skip",
    "frame": "header footer masthead colophon copyright legal logo branding foot head",
    "side": "sidebar aside rail widget widgets related recommended more trending popular tags tag cloud secondary side complementary",
    "note": "notice cookie cookies consent gdpr alert modal popup overlay banner toast dialog warning message subscribe newsletter signup paywall",
    "talk": "comment comments reply replies respond discussion disqus thread feedback reviews review commenter",
    "form": "form login search searchbox input register contact field",
    "share": "share sharing social follow tweet like buttons tools toolbar meta byline author date",
}
_GROUPS = {t: i for i, words in reversed(list(enumerate(TOKENS.values()))) for t in words.split()}
_N = len(TOKENS)
TAGS = ["nav", "footer", "header", "aside", "form", "article", "main", "section", "p", "h1", "h2", "li", "ul", "table", "td", "blockquote", "pre", "figure", "div", "a", "#text"]
_TAG = {t: i for i, t in enumerate(TAGS)} | {"h3": 10, "h4": 10, "h5": 10, "h6": 10, "ol": 12, "dl": 12, "menu": 12, "dt": 11, "dd": 11, "th": 14, "figcaption": 17, "fieldset": 4, "label": 4}
#: Ancestors that speak for or against a node.
_ABOVE = {"nav": 0, "footer": 0, "header": 1, "aside": 0, "form": 0, "article": 2, "main": 2, "blockquote": 3, "li": 4, "ul": 4, "ol": 4}
N_FEATURES = 22 + 2 * _N + 5 + 1


def _closed(source: str, name: str) -> set[int]:
    """Where the start tags of name that have an end tag of their own begin."""
    out, opened = set(), []
    for m in re.finditer(rf"<(/?){name}(?=[\s/>])", source, re.I):
        if not m[1]:
            if name in NO_NEST:
                opened.clear()
            opened.append(m.start())
        elif opened:
            out.add(opened.pop())
    return out


class Page:
    """Nodes in document order: tag, parent, depth, tokens; text nodes carry their characters, and inline elements are passed through."""

    def __init__(self, source: str) -> None:
        self.tag: list[str] = ["#root"]
        self.parent: list[int] = [-1]
        self.groups: list[int] = [0]
        self.text: list[str | None] = [None]
        self.linked: list[int] = [0]
        self._parse(source)

    def _add(self, tag: str, parent: int, groups: int = 0, text: str | None = None) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.groups.append(groups)
        self.text.append(text)
        self.linked.append(0)
        return len(self.tag) - 1

    def _parse(self, source: str) -> None:
        """In time proportional to the page: tags and places of open elements are found without looking at those between."""
        tags, blocks = ["#root"], [0]  # open elements and the block node that each stands for
        where: dict[str, list[int]] = {}  # heights of the open elements by tag
        open_blocks = [0]  # heights of the open block elements
        skip = links = 0  # open elements of SKIP, open links
        run: list[str] = []
        run_linked = 0
        at, n = 0, len(source)
        last_end = source.rfind(">")
        broken = False  # some quote in a tag is not closed
        ended = {"-->": False, "]]>": False}  # there is none any more
        headed = False  # a head has begun, or cannot any more
        closed: dict[str, set[int]] = {}
        loose: list[int] = []  # heights of the open elements that nothing closes

        def flush() -> None:
            nonlocal run, run_linked
            if run:
                text = " ".join("".join(run).split())
                if text:
                    self.linked[self._add("#text", blocks[-1], 0, text)] = min(run_linked, len(text))
                run, run_linked = [], 0

        def push(tag: str, block: int) -> None:
            nonlocal skip, links
            where.setdefault(tag, []).append(len(tags))
            if tag in BLOCK:
                open_blocks.append(len(tags))
            tags.append(tag)
            blocks.append(block)
            skip += tag in SKIP
            links += tag == "a"

        def pop() -> None:
            nonlocal skip, links
            tag = tags[-1]
            if tag in BLOCK:
                flush()
                open_blocks.pop()
            tags.pop()
            blocks.pop()
            where[tag].pop()
            if loose and loose[-1] == len(tags):
                loose.pop()
            skip -= tag in SKIP
            links -= tag == "a"

        def pop_to(height: int) -> None:
            while len(tags) > height:
                pop()

        def nearest(names: set[str]) -> int:
            return max((where[x][-1] for x in names if where.get(x)), default=-1)

        while at < n:
            m = None
            begin = at
            if source[at] == "<" and at < last_end:
                after = source[at + 1]
                if after in "!?":
                    end = -1
                    for start, stop in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                        if source.startswith(start, at) and not ended[stop]:
                            end = source.find(stop, at + len(start))
                            ended[stop] = end < 0
                    at = source.index(">", at + 2) + 1 if end < 0 else end + 3
                    continue
                m = (_BROKEN_TAG_AT if broken else _TAG_AT).match(source, at)
                if m is None and (m := _ANY_TAG_AT.match(source, at)):
                    broken = True
            if m is None:
                end = source.find("<", at + 1) if at < last_end else n
                piece = source[at : end if end >= 0 else n]
                at += len(piece)
                if tags[-1] == "head" and not piece.isspace():
                    pop()
                if not skip:
                    piece = html.unescape(_HUGE.sub("\ufffd", piece)) if "&" in piece else piece
                    run.append(piece)
                    run_linked += len(piece) if links else 0
                continue
            at = m.end()
            name = m[2].lower()
            if loose and (name in BLOCK or name in NO_NEST and not m[1] and tags[loose[-1]] == name):
                while loose:
                    pop_to(loose[-1])
            if m[1]:
                if where.get(name):
                    pop_to(where[name][-1])
                continue
            if name == "head":
                if headed:
                    continue
                headed = True
            elif name not in IN_HEAD:
                headed = True
                if tags[-1] == "head":
                    pop()
            if name == "br":
                run.append(" ")
            if name in VOID:
                if name == "hr" and not skip:
                    flush()
                continue
            if name in ENDS_P and tags[open_blocks[-1]] == "p":
                pop_to(open_blocks[-1])
            if name in CLOSES:
                kinds, stop = CLOSES[name]
                if (k := nearest(kinds)) > nearest(stop):
                    pop_to(k)
            if name == "a" and links:
                pop_to(max(where["a"][-1], open_blocks[-1] + 1))
            if m[0].endswith("/>") and name in ("svg", "math", "use", "path"):
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at) if at < last_end else None
                at = end.end() if end else n
                continue
            if name in BLOCK and not skip:
                flush()
                bits = 0
                if m[3]:
                    for key, *values in _ATTR.findall(m[3]):
                        if (key := key.lower()) in ("class", "id", "role", "itemprop") or key.startswith(("aria-l", "data-")):
                            for part in _PART.findall("".join(values)):
                                if (g := _GROUPS.get(part.lower())) is not None:
                                    bits |= 1 << g
                push(name, self._add(name, blocks[-1], bits))
            else:
                push(name, blocks[-1])
            if name in ENDS_OPEN:
                if name not in closed:
                    closed[name] = _closed(source, name)
                if begin not in closed[name]:
                    loose.append(len(tags) - 1)
        pop_to(1)
        flush()

    def decode(self, odds: np.ndarray) -> list[bool]:
        """Keep or drop for each node: the likeliest labels of which no kept one is below a dropped one."""
        n = len(self.tag)
        keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        best = [0.0] * n  # of the children, each as is best below a kept node
        none = [0.0] * n  # all of them dropped
        gain = [False] * n
        for i in range(n - 1, 0, -1):
            k, d = keep[i] + best[i], drop[i] + none[i]
            gain[i] = bool(k > d)
            p = self.parent[i]
            best[p] += max(k, d)
            none[p] += d
        kept = [True] * n
        for i in range(1, n):
            kept[i] = kept[self.parent[i]] and gain[i]
        return kept

    def main_text(self, odds: np.ndarray) -> str:
        return "\n".join(t for t, k in zip(self.text, self.decode(odds)) if t is not None and k)


def features(pages: list[Page]) -> np.ndarray:
    """One row for each node of all pages, page after page."""
    up: list[int] = []  # the parent; a root is its own
    depth, above, upper, no, began, root = [], [], [], [], [], []
    children, same, words, chars, linked, marks, stops, tags, texts = [], [], [], [], [], [], [], [], []
    for page in pages:
        base, total, kinds = len(up), 0, {}
        for k, (tag, p, t) in enumerate(zip(page.tag, page.parent, page.text)):
            if k:
                p += base
                depth.append(depth[p] + 1)
                a = _ABOVE.get(page.tag[p - base])
                above.append(above[p] if a is None else above[p] | 1 << a)
                upper.append(upper[p] | page.groups[p - base])
                no.append(children[p])
                children[p] += 1
                same.append(key := (p, tag))
                kinds[key] = kinds.get(key, 0) + 1
            else:
                p = base
                depth.append(0), above.append(0), upper.append(0), no.append(0), same.append(None)
            up.append(p), began.append(total), root.append(base), children.append(0)
            if t is None:
                words.append(0), chars.append(0), linked.append(0), marks.append(0), stops.append(0), tags.append(1), texts.append(0)
            else:
                n = len(t)
                words.append(t.count(" ") + 1), chars.append(n), linked.append(page.linked[k]), tags.append(0), texts.append(1)
                stops.append(t.count(". ") + t.count("! ") + t.count("? ") + t.endswith((".", "!", "?")))
                marks.append(t.count("|") + t.count("»") + t.count("©") + t.count("·"))
                total += n
        for k in range(base, len(same)):
            same[k] = kinds.get(same[k], 1)
        for i in range(len(up) - 1, base, -1):
            p = up[i]
            words[p] += words[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            marks[p] += marks[i]
            stops[p] += stops[i]
            tags[p] += tags[i]
            texts[p] += texts[i]
    x = np.zeros((len(up), N_FEATURES), np.float32)
    f = lambda a: np.array(a, np.float32)
    up, words, chars, linked, stops, texts, began, no, same = np.array(up), f(words), f(chars), f(linked), f(stops), f(texts), f(began), f(no), f(same)
    total, of = np.maximum(chars[np.array(root)], 1), f(children)[up]
    x[:, 0] = [_TAG.get(t, 18) for page in pages for t in page.tag]
    x[:, 1] = np.log1p(words)
    x[:, 2] = np.log1p(chars)
    x[:, 3] = linked / np.maximum(chars, 1)
    x[:, 4] = chars / np.maximum(f(tags) + texts, 1)
    x[:, 5] = stops / np.maximum(words, 1)
    x[:, 6] = np.log1p(stops)
    x[:, 7] = f(marks) / np.maximum(words, 1)
    x[:, 8] = chars / total
    x[:, 9] = began / total
    x[:, 10] = (began + chars) / total
    x[:, 11] = depth
    x[:, 12] = no
    x[:, 13] = of - no
    x[:, 14] = same
    x[:, 15] = same / np.maximum(of, 1)
    x[:, 16] = x[up, 3]
    x[:, 17] = x[up, 4]
    x[:, 18] = x[up, 8]
    x[:, 19] = chars / np.maximum(chars[up], 1)
    x[:, 20] = x[up, 0]
    x[:, 21] = words / np.maximum(texts, 1)
    groups, upper, above = np.array([g for page in pages for g in page.groups]), np.array(upper), np.array(above)
    x[:, 22 : 22 + _N] = groups[:, None] >> np.arange(_N) & 1
    x[:, 22 + _N : 22 + 2 * _N] = upper[:, None] >> np.arange(_N) & 1
    x[:, 22 + 2 * _N : 27 + 2 * _N] = above[:, None] >> np.arange(5) & 1
    x[:, -1] = [1 << b if (b := _ABOVE.get(t)) is not None else 0 for page in pages for t in page.tag]
    return x


def _generated(r: random.Random) -> tuple[str, None]:
    """A page of random words whose article parts carry data-y="1" on their innermost block."""
    vocabulary = ["".join(r.choice(["th", "er", "on", "an", "re", "in", "le", "de", "ou", "ti", "es", "or", "ch", "ei", "ar"]) for _ in range(r.randint(1, 4))) for _ in range(150)]
    w = lambda a, b: " ".join(r.choices(vocabulary, k=r.randint(a, b)))
    s = lambda a, b: w(a, b).capitalize() + r.choice(["."] * 8 + ["!", "?", ""])
    junk = r.random() < 0.15
    loud = lambda t: " ".join(x + r.choice(["***", "$$$", "%%%", "!!"]) for x in t.split()) if junk else t
    link = lambda t: f'<a href="/{r.randint(1, 999)}">{t}</a>'
    styled = r.random() < 0.75  # parts of the page carry telling attributes
    name = lambda group: f' {r.choice(["class", "class", "id"])}="{r.choice(TOKENS[group].split())}{r.choice(["", "", "-box", "-" + r.choice(vocabulary), " " + r.choice(vocabulary)])}"'

    def prose(a: int, b: int) -> str:
        t = " ".join(s(2, 22) for _ in range(r.randint(a, b)))
        if r.random() < 0.2:
            t = f"{t} {link(w(1, 3))} {s(2, 9)}"
        if r.random() < 0.15:
            t = f"<b>{t}</b>" if r.random() < 0.5 else f"<b>{t}<br>"
        return loud(t) if "<" not in t else t

    def article() -> str:
        y, out = ' data-y="1"', []
        out.append(f"<h1{y}>{loud(w(2, 12))}</h1>")
        if r.random() < 0.1:
            out.append(f"<h2{y}>{w(2, 6)}</h2>")
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 8, 12, 20])):
            k = r.random()
            if k < 0.74:
                out.append(f"<p{y}>{prose(1, r.choice([1, 1, 3, 6]))}" + "</p>" * (r.random() < 0.9))
            elif k < 0.8:
                out.append(f"<h{r.randint(2, 4)}{y}>{w(1, 6)}</h2>".replace("</h2>", "") + "</h2></h3></h4>")
            elif k < 0.86:
                t = r.choice(["ul", "ol"])
                out.append(f"<{t}>" + "".join(f"<li{y}>{prose(1, 2) if r.random() < 0.5 else w(1, 5)}</li>" for _ in range(r.randint(2, 6))) + f"</{t}>")
            elif k < 0.9:
                out.append(f"<blockquote{y}>{prose(1, 3)}</blockquote>" if r.random() < 0.5 else f"<blockquote><p{y}>{prose(1, 3)}</p></blockquote>")
            elif k < 0.93:
                out.append(f"<pre{y}>{w(3, 20)}</pre>")
            elif k < 0.96:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td{y}>{w(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>")
            else:
                out.append(f"<figure><img src=x><figcaption{y}>{s(2, 9)}</figcaption></figure>")
            if r.random() < 0.06:
                out.append(advert())
            if r.random() < 0.03:
                out.append(share())
        return "".join(out)

    def links(a: int, b: int) -> str:
        t = r.choice(["<ul>{}</ul>", "{}", "<ol>{}</ol>"])
        each = (lambda x: f"<li>{x}</li>") if "l>" in t else (lambda x: f"{x}{r.choice([' ', ' | ', ' · '])}")
        return t.format("".join(each(link(w(1, 3))) for _ in range(r.randint(a, b))))

    def menu() -> str:
        return f"<nav{name('menu') * (r.random() < 0.3)}>{links(2, 12)}</nav>" if r.random() < 0.6 else f"<div{name('menu')}>{links(2, 12)}</div>"

    def top() -> str:
        inner = link(w(1, 2)) + f"<p>{w(1, 9)}</p>" * (r.random() < 0.5) + menu() * (r.random() < 0.5)
        return f"<header{name('frame') * (r.random() < 0.3)}>{inner}</header>" if r.random() < 0.6 else f'<div {r.choice(["class", "id"])}="{r.choice(["header", "masthead", "topbar", "site-header", "branding"])}">{inner}</div>'

    def bottom() -> str:
        inner = f"&copy; {w(1, 3)} &middot; {' '.join(s(2, 14) for _ in range(r.randint(1, 4)))}" if r.random() < 0.7 else f"<p>{s(3, 14)}</p>{links(2, 6)}"
        return f"<footer>{inner}</footer>" if r.random() < 0.65 else f'<div {r.choice(["class", "id"])}="{r.choice(["footer", "site-footer", "colophon", "copyright", "legal"])}">{inner}</div>'

    def advert() -> str:
        return f"<div{name('ad')}>{loud(s(2, 12)) if r.random() < 0.8 else '<p>' + s(4, 25) + '</p>' + link(w(1, 2))}</div>" if r.random() < 0.85 else f"<aside{name('ad')}>{s(3, 9)}</aside>"

    def side() -> str:
        inner = "".join(r.choice([lambda: f"<h3>{w(1, 3)}</h3>{links(2, 7)}", lambda: f"<p>{s(4, 18)}</p>", advert])() for _ in range(r.randint(1, 4)))
        return f"<aside{name('side') * styled}>{inner}</aside>" if r.random() < 0.6 else f"<div{name('side')}>{inner}</div>"

    def notice() -> str:
        inner = r.choice([f"<p>{s(5, 25)}</p>", s(5, 25)]) + link(w(1, 2)) * (r.random() < 0.4) + "<button>ok</button>" * (r.random() < 0.4)
        return f"<{(t := r.choice(['div', 'div', 'section', 'aside']))}{name('note')}>{inner}</{t}>"

    def form() -> str:
        inner = f"<label>{w(1, 3)}</label><input name=a>" + f"<p>{s(3, 10)}</p>" * (r.random() < 0.4) + f"<button>{w(1, 2)}</button>"
        return f"<form{name('form') * (r.random() < 0.5)}>{inner}</form>"

    def comments() -> str:
        c = lambda: r.choice([f"<p>{w(1, 2)}: {prose(1, 3)}</p>", f'<div class="comment"><b>{w(1, 2)}</b><p>{prose(1, 4)}</p></div>', f"<li>{w(1, 2)} <p>{prose(1, 3)}</p></li>"])
        return f"<{(t := r.choice(['div', 'section', 'ol', 'ul', 'div']))}{name('talk')}>" + f"<h3>{w(1, 2)}</h3>" * (r.random() < 0.6) + "".join(c() for _ in range(r.randint(1, 6))) + f"</{t}>"

    def share() -> str:
        return f"<div{name('share')}>{links(2, 5) if r.random() < 0.7 else w(2, 6)}</div>"

    parts = {"top": top, "menu": menu, "advert": advert, "notice": notice, "side": side, "form": form, "share": share, "comments": comments, "bottom": bottom}
    pick = lambda p, k: "".join(parts[x]() for x in r.sample(k, len(k)) if r.random() < p)
    before = pick(0.45, ["top", "menu", "advert", "notice", "side", "form", "share"])
    after = pick(0.4, ["side", "comments", "share", "form", "advert", "notice", "menu"]) + (bottom() if r.random() < 0.75 else "")
    inside = pick(0.12, ["share", "comments", "advert", "form"])
    kind = r.random()
    if kind < 0.5:
        mid = f"<article{name('good') * (r.random() < 0.3)}>{article()}{inside}</article>"
    elif kind < 0.6:
        mid = f"<main>{article()}{inside}</main>"
    elif kind < 0.9:
        mid = f"<div{name('good')}>{article()}{inside}</div>"
    else:
        mid = f"<div><div>{article()}</div></div>"
    if r.random() < 0.3:
        mid = f"<{(t := r.choice(['div', 'main', 'section']))}{name('good') * (r.random() < 0.6)}>{pick(0.15, ['side', 'menu', 'advert'])}{mid}{pick(0.25, ['side', 'comments', 'share'])}</{t}>"
    if r.random() < 0.2:
        before, after = f"<div>{before}", f"{after}</div>"
    return f"<html><head><title>{w(2, 6)}</title></head><body>{before}{mid}{after}</body></html>"


@functools.cache
def trained(pages: int = 400, seed: int = 7) -> BoostedTrees:
    """The model, trained on generated pages; a node's label is whether any article text is in or below it."""
    r, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        source = _generated(r)
        # the mark sits on the innermost block; its text nodes are the article's
        page = Page(source.replace(' data-y="1"', ' id="yyy"'))
        marked = _marked(source)
        y = np.zeros(len(page.tag))
        seen = 0
        for i, t in enumerate(page.text):
            if t is not None:
                y[i] = marked[seen] if seen < len(marked) else 0
                seen += 1
        for i in range(len(y) - 1, 0, -1):
            y[page.parent[i]] = max(y[page.parent[i]], y[i])
        xs.append(features([page])[1:])
        ys.append(y[1:])
    return BoostedTrees(trees=40, depth=4).fit(np.concatenate(xs), np.concatenate(ys))


class _Marks(Page):
    """A page that notes for each text node whether the block it is in carries the mark."""

    def __init__(self, source: str) -> None:
        self.marks: list[int] = []
        self.blocks: dict[int, int] = {0: 0}
        super().__init__(source)

    def _add(self, tag: str, parent: int, groups: int = 0, text: str | None = None) -> int:
        i = super()._add(tag, parent, groups, text)
        if tag == "#text":
            self.marks.append(self.blocks[parent])
        else:
            self.blocks[i] = groups >> 62 & 1
        return i


def _marked(source: str) -> list[int]:
    _GROUPS["yyy"] = 62
    try:
        return _Marks(source.replace(' data-y="1"', ' id="yyy"')).marks
    finally:
        del _GROUPS["yyy"]


def extract_many(sources: list[str | None], model: BoostedTrees) -> list[str]:
    pages = [Page(s or "") for s in sources]
    odds = model.log_odds(features(pages)) if pages else np.zeros(0)
    cuts = np.cumsum([0, *(len(p.tag) for p in pages)])
    return [p.main_text(odds[a:b]) for p, a, b in zip(pages, cuts, cuts[1:])]


def main_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages.

    Null and empty pages, and pages without article text, give an empty text. The
    whole page is read and nothing of the article is cut. Repeated rows give a row
    each; null ids and urls are kept; other columns are ignored.
    """
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                texts = extract_many(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
