"""Main text of web pages: gradient-boosted trees over DOM-node features, then hierarchical decoding.

A page is parsed into elements with the implied end tags of HTML, in time that is linear in its length whatever it holds; content
outside head and body opens the body. A quoted attribute value ends at its quote; if there is none, its tag ends at the next ``>``.
Each element that holds text has features of its tag, attribute tokens, depth, subtree density (text, links, blocks) and siblings;
the trees give it the log odds of being main text. Tags and attribute tokens enter by evidence: hashed to a table of log odds that is
learned from labelled pages, so that no list of good or bad names is given. Decoding maximises the summed odds under one constraint: no
element is kept inside one that is not. Kept elements' blocks are joined by a line break, white space inside a block (Unicode's) is one
space.

Evidence and trees are trained on TRAINING_PAGES pages that this module makes from a seed, with known main text, and on WITHHELD_PAGES
whose classes and ids are random letters; that is the bound on the sample. They are trained once on the driver and broadcast.

Null and empty pages have the empty text. Pages are never cut; nesting is handled without recursion. Repeated rows and
pages are extracted alike.
"""

from __future__ import annotations

import html as entities
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.process_cache import kept, only
from tessera.llm.boosting import Boosted
from tessera.llm.words import slices

TRAINING_PAGES, WITHHELD_PAGES, SEED = 4000, 300, 11

#: Elements by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
DROPPED = frozenset("script style template noscript iframe svg math canvas object head title textarea select option button input audio video map".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
HEAD_TAGS = frozenset("html head base link meta noframes noscript script style template title".split())
ENDS_P = BLOCKS - frozenset("body html caption dd dt li legend optgroup option tbody td tfoot th thead tr".split())
#: An opening tag closes an open one of these, unless an element of the second set stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, set()),
}
#: An opening block closes an open p, unless one of these stands between.
P_WALLS = "table td th li div section article blockquote button caption object".split()
MARKUP = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
COMMENT_END = re.compile(r"--!?>")
NAME = re.compile(r"[\s/]*+(?:[^\s/>][^\s/>=]*+)?\s*+(=\s*+)?")
UNQUOTED = re.compile(r"[^\s>]*+")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-label)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
STOP = re.compile(r"[.!?。！？]")
#: Buckets of the table of evidence, and how many elements a token must have been seen in for half of its weight.
BUCKETS, DOUBT = 4096, 4


class Node:
    __slots__ = ("tag", "parent", "depth", "tokens", "children", "order", "text", "links", "blocks", "paragraphs", "stops", "elements", "index", "hidden")

    def __init__(self, tag: str, parent: Node | None, tokens: frozenset = frozenset(), hidden: bool = False):
        self.tag, self.parent, self.tokens, self.hidden = tag, parent, tokens, hidden
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node] = []
        self.text = self.links = self.blocks = self.paragraphs = self.stops = self.elements = 0
        self.index = 0


def _tokens(attributes: str) -> tuple[frozenset, bool]:
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return frozenset(), False
    found, hidden = [], False
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name == "hidden":
            hidden = True
        else:
            found += [t.lower() for t in TOKENS.findall(m[2] or m[3] or m[4] or "")]
    return frozenset(found), hidden


class Tags:
    """Where the tags of a page end."""

    def __init__(self, page: str):
        self.page, self.last = page, {q: page.rfind(q) for q in "\"'"}

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose attributes begin at ``at``, or the page's length."""
        page, size = self.page, len(self.page)
        simple = page.find(">", at)
        if simple < 0:
            return size
        if page.find("'", at, simple) < 0 and page.count('"', at, simple) % 2 == 0:
            return simple
        while at < size and page[at] != ">":
            m = NAME.match(page, at)
            at = m.end()
            if not m[1]:
                continue
            if page[at : at + 1] in self.last and at < size:
                if self.last[page[at]] <= at:  # the quote is never closed
                    return size if (end := page.find(">", at)) < 0 else end
                at = page.find(page[at], at + 1) + 1
            else:
                at = UNQUOTED.match(page, at).end()
        return at


class Open:
    """The open elements: a stack, and for each tag those of its name."""

    def __init__(self, root: Node):
        self.root, self.stack, self.blocks, self.named = root, [root], [], {}

    def push(self, node: Node) -> None:
        self.stack.append(node)
        self.named.setdefault(node.tag, []).append(node)
        if node.tag in BLOCKS:
            self.blocks.append(node)

    def close(self, node: Node) -> None:
        """Close an open element and all inside it."""
        while True:
            last = self.stack.pop()
            self.named[last.tag].pop()
            if last.tag in BLOCKS:
                self.blocks.pop()
            if last is node:
                return

    def depth(self, tags) -> int:
        """Of the innermost open element of some tags; -1 if there is none."""
        return max((own[-1].depth for t in tags if (own := self.named.get(t))), default=-1)

    def innermost(self, tag: str, below: int = -1) -> Node | None:
        own = self.named.get(tag)
        return own[-1] if own and own[-1].depth > below else None

    def outermost(self, tags, below: int) -> Node | None:
        """The outermost open element of some tags that is deeper than ``below``."""
        found = [own[k] for t in tags if (own := self.named.get(t)) and (k := bisect_right(own, below, key=lambda n: n.depth)) < len(own)]
        return min(found, key=lambda n: n.depth, default=None)

    def block_depth(self) -> int:
        return self.blocks[-1].depth if self.blocks else -1


def parsed(page: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """Elements in page order, the root first, and runs of text with their element."""
    root = Node("html", None)
    nodes, runs, at, end, tags, open_ = [root], [], int(page.startswith("\ufeff")), len(page), Tags(page), Open(root)
    body = None

    def content() -> None:
        """Make way for content: in the root or an open head it is the body's."""
        nonlocal body
        here = open_.stack[-1]
        if here is not root and (here.tag != "head" or here.parent is not root):
            return
        if here is not root:
            open_.close(here)
        if not body:
            body = Node("body", root)
            root.children.append(body)
            nodes.append(body)
        open_.push(body)

    while at < end:
        m = MARKUP.search(page, at)
        upto = m.start() if m else end
        if upto > at:
            if not page[at:upto].isspace():
                content()
            runs.append((open_.stack[-1], page[at:upto]))
        if not m:
            break
        if not m[3]:
            stop = COMMENT_END.search(page, m.end() - 2) if m[1] else None  # <!--> is a whole comment
            closed = stop.end() if stop else end if m[1] else page.find(">", m.end()) + 1
            at = closed or end
            continue
        tag, begin = m[3].lower(), m.end()
        stop = tags.end(begin)
        attributes, at = page[begin:stop], stop + 1
        if m[2]:
            # an inline end tag does not close a block
            if node := open_.innermost(tag, -1 if tag in BLOCKS else open_.block_depth()):
                open_.close(node)
            continue
        if tag == "html" or tag == "head" and body:
            continue
        if tag not in HEAD_TAGS and tag != "body":
            content()
        if tag in ENDS_P and (node := open_.innermost("p", open_.depth(P_WALLS))):
            open_.close(node)
        if tag in CLOSES:
            ends, walls = CLOSES[tag]
            if node := open_.outermost(ends, open_.depth(walls)):
                open_.close(node)
        if tag == "a" and (node := open_.innermost("a", open_.block_depth())):
            open_.close(node)
        tokens, hidden = _tokens(attributes)
        if tag == "body":
            if body:  # its attributes are the open body's
                body.tokens, body.hidden = body.tokens | tokens, body.hidden or hidden
            else:
                content()
                body.tokens, body.hidden = tokens, hidden
            continue
        here = open_.stack[-1]
        node = Node(tag, here, tokens, hidden)
        here.children.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS and tag not in RAW and tag != "a":
            if tag in ("br", "hr"):
                runs.append((node, ""))
            continue
        nodes.append(node)
        if tag in RAW:  # what stands in it is no content
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)", re.I).search(page, at)
            at = end if not close else (page.find(">", close.end()) + 1 or end)
            continue
        open_.push(node)
    return nodes, runs


def blocks_of(nodes: list[Node], runs: list[tuple[Node, str]]) -> list[tuple[Node, str]]:
    """Blocks of text in page order with the innermost block element that holds each."""
    for i, n in enumerate(nodes):
        n.index = i
    dropped = [False] * len(nodes)
    holder: list[Node] = [nodes[0]] * len(nodes)
    for n in nodes[1:]:
        up = n.parent.index
        dropped[n.index] = dropped[up] or n.tag in DROPPED or n.hidden
        holder[n.index] = n if n.tag in BLOCKS else holder[up]
    out: list[tuple[Node, str]] = []
    now, pieces = None, []

    def close():
        if text := " ".join("".join(pieces).split()):
            out.append((now, text))

    for node, text in runs:
        if node.tag in ("br", "hr"):
            if node.tag == "hr":
                close()
                now, pieces = None, []
            elif now is not None:
                pieces.append(" ")
            continue
        if dropped[node.index]:
            continue
        block = holder[node.index]
        if block is not now:
            close()
            now, pieces = block, []
        pieces.append(entities.unescape(text) if "&" in text else text)
    close()
    return out


def hints(node: Node) -> list[int]:
    """Buckets of a node's attribute tokens."""
    return [crc32(t.encode()) % BUCKETS for t in sorted(node.tokens)]


def tag_hint(node: Node) -> int:
    return crc32(f"<{node.tag}>".encode()) % BUCKETS


def features(nodes: list[Node], runs: list[tuple[Node, str]], blocks: list[tuple[Node, str]], evidence: list[float]) -> list[list[float]]:
    """One row for each element. ``evidence``: log odds of each bucket of hints."""
    from math import log1p

    in_link = [False] * len(nodes)
    for n in nodes[1:]:
        in_link[n.index] = in_link[n.parent.index] or n.tag == "a"
    linked: dict[int, int] = {}
    for node, text in runs:
        if node.tag not in ("br", "hr") and in_link[node.index]:
            linked[node.index] = linked.get(node.index, 0) + len(text.strip())
    for node, text in blocks:
        node.text += len(text)
        node.blocks += 1
        node.paragraphs += node.tag == "p"
        node.stops += len(STOP.findall(text))
    for i, size in linked.items():
        nodes[i].links += size
    for n in reversed(nodes):
        n.elements += 1
        if n.parent:
            up = n.parent
            up.text += n.text
            up.links += n.links
            up.blocks += n.blocks
            up.paragraphs += n.paragraphs
            up.stops += n.stops
            up.elements += n.elements
    total = max(1, nodes[0].text)
    above = [(0.0, 0.0, 0.0)] * len(nodes)  # of what encloses a node: summed evidence of tokens, of tags, least evidence
    out = []
    place: dict[int, int] = {}
    tags: dict[int, Counter] = {}
    for n in nodes:
        own, by_tag = [evidence[h] for h in hints(n)] or [0.0], evidence[tag_hint(n)]
        up = n.parent
        if up:
            k = place[up.index] = place.get(up.index, -1) + 1
            siblings = len(up.children)
            if up.index not in tags:
                tags[up.index] = Counter(c.tag for c in up.children)
            alike = tags[up.index][n.tag]
            of_parent, outer = n.text / max(1, up.text), above[up.index]
        else:
            k, siblings, alike, of_parent, outer = 0, 1, 1, 1.0, (0.0, 0.0, 0.0)
        above[n.index] = (outer[0] + sum(own), outer[1] + by_tag, min(outer[2], min(own), by_tag))
        out.append(
            [
                n.depth, sum(own), min(own), max(own), by_tag, *outer, n.tag == "p", n.tag in ("h1", "h2", "h3", "h4"), n.tag in ("li", "ul", "ol", "dl"), n.tag in ("div", "section"), log1p(n.text), n.links / max(1, n.text), log1p(n.text / n.elements),
                n.paragraphs / max(1, n.blocks), n.stops * 100 / max(1, n.text), log1p(n.text / max(1, n.blocks)), k / siblings, alike / siblings, log1p(siblings), of_parent, n.text / total,
            ]
        )
    return out


def decoded(nodes: list[Node], odds: list[float]) -> list[bool]:
    """The likeliest labels in which nothing is kept inside what is not."""
    keep, drop = [0.0] * len(nodes), [0.0] * len(nodes)
    for n in reversed(nodes):
        i = n.index
        keep[i] += odds[i] / 2
        drop[i] -= odds[i] / 2
        if n.parent:
            up = n.parent.index
            keep[up] += max(keep[i], drop[i])
            drop[up] += drop[i]
    labels = [True] * len(nodes)
    for n in nodes[1:]:
        labels[n.index] = labels[n.parent.index] and keep[n.index] > drop[n.index]
    return labels


def extract(pages: list[str], model: tuple[Boosted, list[float]]) -> list[str]:
    """The main text of each page."""
    import numpy as np

    trees, evidence = model
    done, rows = [], []
    for page in pages:
        nodes, runs = parsed(page)
        blocks = blocks_of(nodes, runs)
        done.append((nodes, blocks))
        rows += features(nodes, runs, blocks, evidence)
    odds = trees.logit(np.array(rows, dtype=float)).tolist() if rows else []
    out, at = [], 0
    for nodes, blocks in done:
        labels = decoded(nodes, odds[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n".join(text for node, text in blocks if labels[node.index]))
    return out


def made_page(rnd: random.Random, withheld: bool = False) -> tuple[str, list[tuple[str, bool]]]:
    """A page from the seed: its HTML and its blocks, each with whether it is main text. ``withheld``: names tell nothing, and what is
    not main text has headings and full stops as well."""
    blocks: list[tuple[str, bool]] = []
    syllable = lambda: rnd.choice("ka lo mi ter sun ve pra ol in est ar do we qui zo bel".split())
    word = lambda: "".join(syllable() for _ in range(rnd.randint(1, 4)))

    def sentence(n=None, stop=True):
        return " ".join(word() for _ in range(n or rnd.choice([1, rnd.randint(1, 5), rnd.randint(2, 22), rnd.randint(5, 30)]))).capitalize() + (rnd.choice(".....!?") if stop else "")

    def block(tag, text, main):
        blocks.append((text, main))
        odd = rnd.random()
        inner = f"<b>{text}" if odd < 0.1 else f"<em>{text}</em>" if odd < 0.15 else text
        return f"<{tag}>{inner}" + ("" if tag in ("p", "li") and rnd.random() < 0.2 else f"</{tag}>")

    def links(n):
        out = ""
        for _ in range(n):
            t = sentence(rnd.randint(1, 3), withheld and rnd.random() < 0.2)
            blocks.append((t, False))
            out += f'<li><a href="/{word()}">{t}</a></li>'
        return f"<ul>{out}</ul>"

    def heading():
        return block(rnd.choice(["h3", "h4", "h5"]), sentence(rnd.randint(1, 3), False), False) if withheld and rnd.random() < 0.4 else ""

    def remark():
        """A reader's comment: a name, perhaps, and what is said."""
        if not withheld or rnd.random() < 0.5:
            return note(1)
        name = sentence(rnd.randint(1, 2), False)
        blocks.append((name, False))
        return f"<{rnd.choice(['b', 'span', 'strong'])}>{name}</b></span></strong>" + block("p", " ".join(sentence() for _ in range(rnd.randint(1, 2))), False)

    def note(n=None):
        return "".join(block(rnd.choice(["p", "div"]), " ".join(sentence() for _ in range(rnd.randint(1, 3))), False) for _ in range(n or rnd.randint(1, 3)))

    def bare(n=None):
        t = " ".join(sentence() for _ in range(n or rnd.randint(1, 3)))
        blocks.append((t, False))
        return t

    def named(kinds, inner, tags="div section ul".split()):
        tag, name = rnd.choice(tags), rnd.choice(kinds)
        if withheld:
            return opaque(tag, inner)
        name = rnd.choice([name, f"{word()}-{name}", f"site-{name}", f"{name} {word()}", f"{name}_{rnd.randint(1, 9)}"])
        return f'<{tag} {rnd.choice(["class", "class", "id", "role"])}="{name}">{inner}</{tag}>'

    def opaque(tag, inner):
        name = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(1, 9)))
        return f"<{tag}>{inner}</{tag}>" if rnd.random() < 0.2 else f'<{tag} {rnd.choice(["class", "id"])}="{name}{rnd.randint(0, 99)}">{inner}</{tag}>'

    def menu(n):
        """Links with or without a list around them."""
        if rnd.random() < 0.5:
            return links(n)
        words = [sentence(rnd.randint(1, 2), rnd.random() < 0.2) for _ in range(n)]
        blocks.append((" ".join(words), False))
        return " ".join(f'<a href="/{word()}">{w}</a>' for w in words)

    def noise():
        kind = rnd.randint(0, 9)
        if kind == 0:
            return f"<aside>{rnd.choice([note(), links(rnd.randint(1, 8))])}</aside>"
        if kind == 1:
            return named(["sidebar", "related", "widget", "recommended", "aside", "promoted", "outbrain", "taboola", "carousel", "more-links"], heading() + rnd.choice([links, note])(rnd.randint(1, 6)))
        if kind in (2, 3):
            return named(["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "banner", "adv", "donate"], rnd.choice([note, bare])(1), ["div"])
        if kind == 4:
            return named(["cookie-notice", "consent", "notice", "gdpr", "popup", "cookie-banner", "notification", "modal", "overlay", "privacy", "paywall", "dialog"], rnd.choice([note, bare])(1), ["div", "section"])
        if kind == 5:
            return named(["newsletter", "subscribe", "signup", "login", "register", "subscription"], f"<form>{note(1)}<input name=q><button>Go</button></form>", ["div"])
        if kind == 6:
            return f"<form action=/s><label>{bare(1)}</label><input></form>"
        if kind == 7:
            return named(["comments", "comment-list", "replies", "discussion", "respond", "disqus", "feedback", "shout"], heading() + "".join(named(["comment", "reply"], remark(), ["div", "li"]) for _ in range(rnd.randint(1, 4))), ["div", "section"])
        if kind == 8:
            return named(["share", "sharing", "social", "tags", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar", "tools"], links(rnd.randint(1, 5)))
        return named(["menu", "nav", "navbar", "navigation", "topbar", "masthead", "skip-links"], links(rnd.randint(1, 9)))

    def body():
        out = block(rnd.choice(["h1", "h1", "h2"]), sentence(rnd.randint(2, 9), rnd.random() < 0.5), True) if rnd.random() < 0.9 else ""
        for _ in range(rnd.choice([1, 2, 3, 5, 8, 12, 20])):
            kind = rnd.random()
            if kind < 0.75:
                out += block("p", " ".join(sentence() for _ in range(rnd.choice([1, 1, 2, 4, 7]))), True)
            elif kind < 0.82:
                out += block(rnd.choice(["h2", "h3"]), sentence(rnd.randint(1, 6), False), True)
            elif kind < 0.9:
                out += "<ul>" + "".join(block("li", sentence(), True) for _ in range(rnd.randint(1, 5))) + "</ul>"
            elif kind < 0.94:
                out += f"<blockquote>{block('p', sentence(), True)}</blockquote>"
            elif kind < 0.97:
                out += block(rnd.choice(["pre", "div"]), sentence(), True)
            elif kind < 0.985:
                out += "<table><tr>" + "".join(block("td", sentence(rnd.randint(1, 3), False), True) for _ in range(rnd.randint(2, 4))) + "</tr></table>"
            else:
                out += noise()
        return out

    html = f"<html><head><title>{sentence()}</title><style>p{{}}</style><script>var a='</p>'</script></head><body>"
    if rnd.random() < 0.8:
        html += f"<header>{rnd.choice([bare(1), block('h2', sentence(2, False), False)])}</header>" if rnd.random() < 0.4 else ""
        html += f"<nav>{links(rnd.choice([1, rnd.randint(1, 9)]))}</nav>"
    html += "".join(noise() for _ in range(rnd.randint(0, 3)))
    wrap = rnd.random()
    inner = body()
    tag = rnd.choice(["div", "div", "div", "section"])
    if withheld:
        html += opaque("div", menu(rnd.randint(1, 9))) if rnd.random() < 0.5 else ""
        cells = [f"<td>{inner}</td>"] if wrap > 0.7 else []
        if cells and rnd.random() < 0.7:
            cells.insert(rnd.randint(0, 1), f"<td>{menu(rnd.randint(1, 9))}</td>")
        inner = f"<table><tr>{''.join(cells)}</tr></table>" if cells else f"<article>{inner}</article>" if wrap < 0.1 else opaque(tag, inner)
    elif wrap < 0.35:
        inner = f"<article>{inner}</article>"
    elif wrap < 0.5:
        inner = f"<main>{inner}{noise() if rnd.random() < 0.3 else ''}</main>"
    elif wrap < 0.75:
        name = rnd.choice(["content", "post-content", "entry", "article-body", "main", "story", "post", "page-content", "post__text", "prose", "body", "articleBody", "mainContent"])
        inner = f'<{tag} {rnd.choice(["class", "id"])}="{rnd.choice([name, name, f"{name} {word()}", f"{word()}-{name}"])}">{inner}</{tag}>'
    elif wrap < 0.8:
        inner = f"<table><tr><td>{inner}</td></tr></table>"
    elif wrap < 0.9:
        inner = f"<{tag}>{inner}</{tag}>"
    else:
        inner = f'<{tag} class="{word()}">{inner}</{tag}>'
    html += f"<div>{inner}</div>" if rnd.random() < 0.3 else inner
    html += "".join(noise() for _ in range(rnd.randint(0, 3)))
    if rnd.random() < 0.85:
        html += f"<footer>{rnd.choice([note, bare])(1)}</footer>" if rnd.random() < 0.8 else named(["footer", "copyright"], bare(1), ["div"])
    return html + rnd.choice(["</body></html>", "</body></html>", ""]), blocks


def labelled(page: str, truth: list[tuple[str, bool]]) -> tuple[list[Node], list, list, list]:
    """Elements, runs and blocks of a page, and each element's label: whether it is main text, or None without text. An element is main
    text if most of its subtree's text is."""
    wanted = dict(truth)
    nodes, runs = parsed(page)
    blocks = blocks_of(nodes, runs)
    good, size = [0] * len(nodes), [0] * len(nodes)
    elements = [1] * len(nodes)
    for node, text in blocks:
        good[node.index] += wanted.get(text, False) * len(text)
        size[node.index] += len(text)
    for n in reversed(nodes[1:]):
        good[n.parent.index] += good[n.index]
        size[n.parent.index] += size[n.index]
        elements[n.parent.index] += elements[n.index]
    # what encloses the main text must be kept, or nothing in it could be
    main = lambda i, n: good[i] > 0 and (2 * good[i] > size[i] or n.tag == "body" or elements[i] > 12)
    return nodes, runs, blocks, [main(n.index, n) if n.parent and size[n.index] else None for n in nodes]


def trained(pages: int = TRAINING_PAGES, seed: int = SEED, withheld: int = WITHHELD_PAGES) -> tuple[Boosted, list[float]]:
    """Evidence of hints from one half of the made pages, and trees fitted to the other half with it and to further pages whose names
    tell nothing, so that the trees learn what links, sizes and places say by themselves."""
    import math

    import numpy as np

    rnd = random.Random(seed)
    made = [labelled(*made_page(rnd)) for _ in range(pages)]
    opaque = [labelled(*made_page(rnd, True)) for _ in range(withheld)]
    seen = [[0, 0] for _ in range(BUCKETS)]
    for nodes, _, _, labels in made[::2]:
        for n, label in zip(nodes, labels):
            if label is not None:
                for h in {*hints(n), tag_hint(n)}:
                    seen[h][label] += 1
    bad, good = (sum(x[k] for x in seen) or 1 for k in (0, 1))
    rate = good / (good + bad)
    odds = lambda b, g: math.log((g + DOUBT * rate) / (b + DOUBT * (1 - rate))) - math.log(rate / (1 - rate))
    evidence = [odds(*x) for x in seen]
    rows, wanted = [], []
    for nodes, runs, blocks, labels in made[1::2] + opaque:
        for row, label in zip(features(nodes, runs, blocks, evidence), labels):
            if label is not None:
                rows.append(row)
                wanted.append(label)
    return Boosted(rounds=100).fit(np.array(rows, dtype=float), np.array(wanted, dtype=float)), evidence


def trained_once() -> tuple[Boosted, list[float]]:
    """trained(), kept by the process."""
    return kept("html-trees", (TRAINING_PAGES, SEED, WITHHELD_PAGES), trained)


def main_text(html: Column, shared) -> Column:
    """The main text of a column of pages; ``shared`` is a broadcast state of the trees."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only()
        model = Boosted.of(shared.value[0]), shared.value[1]
        for batch in slices(batches, 128):
            yield pa.array(extract([p or "" for p in batch.to_pylist()], model), pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string").asNondeterministic()(html)


def extracted(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """Columns ``keep``, then the main text, one row for each page. A kept column ``text`` gives way."""
    keep = [c for c in keep if c != "text"]
    model = trained_once()
    shared = pages.sparkSession.sparkContext.broadcast((model[0].state(), model[1]))
    return pages.select(*keep, main_text(F.col(html), shared).alias("text"))
