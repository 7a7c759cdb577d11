"""Main text of web pages by a tree-structured graphical model over the page's blocks.

Every block element is a variable, content or not. A node's potential weighs its features (tag, role,
words of its class and id, links, text); a parent and its child share a potential that says how they go
together. Sum-product messages passed up and then down the tree give each node's exact marginal. The
weights are trained by the gradient of the likelihood, for which the same messages are used.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, tidy

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside section article main table thead tbody tr td th caption form fieldset figure figcaption blockquote pre address details summary dialog center menu search hgroup label legend".split())
#: Never text of a page: these hold markup or fallbacks.
HIDDEN = frozenset("head template svg math object select button datalist canvas audio video applet frameset".split())
#: Never text of a page: what they hold is not markup.
RAW = frozenset("script style title textarea iframe noscript noembed noframes".split())
#: Elements that a following one of its own kind, or a block, ends without an end tag.
CLOSES = {"p": frozenset(BLOCKS - {"label", "legend"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "tbody", "thead"}), "td": frozenset({"td", "th", "tr", "tbody"}), "th": frozenset({"td", "th", "tr", "tbody"})}
#: Words of class and id names.
CUES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip sitemap".split(),
    "side": "sidebar side aside rail widget widgets related recommended trending popular tags tagcloud more".split(),
    "edge": "header masthead topbar top footer foot bottom copyright colophon branding logo".split(),
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner dfp outbrain taboola affiliate".split(),
    "note": "cookie cookies consent gdpr notice popup modal overlay alert newsletter subscribe subscription signup paywall disclaimer toast".split(),
    "talk": "comment comments commentlist disqus reply replies respond discussion feedback reviews".split(),
    "form": "form login search searchbox contact input register".split(),
    "share": "share sharing social follow like tweet facebook twitter".split(),
    "text": "article content main post entry story body text prose page-content blog copy".split(),
}
_CUE = {w: k for k, ws in CUES.items() for w in ws}
#: Words of short texts: what stands around articles says so in words, in the four languages.
SAYS = {
    "menu": "home about contact archive archives faq help sitemap next previous older newer back menu startseite kontakt accueil inicio contacto index forum blog".split(),
    "edge": "copyright rights reserved powered privacy terms impressum datenschutz imprint mentions légales aviso".split(),
    "note": "cookie cookies consent accept agree subscribe newsletter inbox unsubscribe akzeptieren accepter aceptar abonnieren".split(),
    "ad": "advertisement advertising sponsored promoted anzeige publicité publicidad sale discount deal offer".split(),
    "side": "related recommended popular trending tags categories recent bookmarks also latest kategorien catégories categorías".split(),
    "share": "share tweet follow like facebook twitter linkedin teilen partager compartir".split(),
    "talk": "comment comments reply replies says wrote said responses kommentar kommentare antworten schrieb commentaires répondre comentarios responder ago report upvote".split(),
    "form": "search login password username submit send suche anmelden recherche buscar register".split(),
}
_SAY = {w: k for k, ws in SAYS.items() for w in ws}
#: Words that notices and adverts in whole sentences are made of; two of a kind at a block's begin speak.
TELLS = {
    "note": "cookie cookies consent privacy data device partners stores store browsing preferences accept agree newsletter inbox subscribe sign daten geräte datenschutz zustimmen données confidentialité datos privacidad".split(),
    "ad": "buy cheap today shop price prices free delivery offer offers deal deals discount sale order save kaufen günstig rabatt acheter promotion comprar oferta ofertas".split(),
}
_TELL = {w: k for k, ws in TELLS.items() for w in ws}
_WORD = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])|[a-z]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_DATED = re.compile(r"\b\d{1,2}[:.]\d\d\b|\b(?:19|20)\d\d\b")
_TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 legend summary caption dt".split())
#: A comment's begin, a tag (quotes count after an equals sign, if they are closed), or other markup.
_MARKUP = re.compile(r"""<!--(?:-?>)?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>|<[!?/][^>]*+>""", re.S)
_COMMENT_END = re.compile("--!?>")
_REST = re.compile("[^<>]*>?")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_BLOCK_TAG = re.compile(r"</?(?:" + "|".join(sorted(BLOCKS, key=len, reverse=True)) + r")(?=[\s/>])", re.I)
#: Characters of a node's own text that are looked at for words of SAYS; longer ones speak in sentences.
SHORT = 90


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "chars", "linked", "all_chars", "all_linked", "all_stops", "head", "stops", "before")

    def __init__(self, tag: str, attrs: dict, parent: int, before: int):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[int] = []
        self.chars = self.linked = self.all_chars = self.all_linked = self.stops = self.all_stops = 0
        self.head = ""
        self.before = before  # characters of the page's text before it


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in _ATTR.findall(source):
        if v[:1] in "\"'":
            v = v[1:-1]
        out.setdefault(k.lower(), unescape(v) if "&" in v else v)
    return out


def _events(html: str) -> list[tuple[str, str, str]]:
    """("t", text, ""), ("s", tag, attributes) or ("e", tag, "") in order, without what RAW elements hold.

    A RAW element that isn't ended goes to the next tag of a block, a comment that isn't to the next angle bracket.
    """
    out: list[tuple[str, str, str]] = []
    at, n, low = 0, len(html), None
    dead: set[str] = set()  # what has no end from here on
    closing = html.rfind(">")
    while at < n:
        m = _MARKUP.search(html, at) if at <= closing else None
        if m is None:
            out.append(("t", html[at:], ""))
            break
        if m.start() > at:
            out.append(("t", html[at : m.start()], ""))
        at, tag = m.end(), m.group(2)
        if tag is None:
            if m.group() == "<!--":
                end = None if "--" in dead else _COMMENT_END.search(html, at)
                if end is None:
                    dead.add("--")
                at = (end or _REST.match(html, at)).end()
            continue
        tag = tag.lower()
        if m.group(1):
            out.append(("e", tag, ""))
        elif tag in RAW:
            out.append(("s", tag, ""))
            if m.group(3).rstrip().endswith("/"):
                continue
            low = html.lower() if low is None else low
            end = -1 if tag in dead or len(low) != n else low.find("</" + tag, at)
            if len(low) != n:  # a letter whose small form is longer
                found = re.compile("</" + tag, re.I).search(html, at)
                end = found.start() if found else -1
            if end < 0:
                dead.add(tag)
                found = _BLOCK_TAG.search(html, at)
                at = found.start() if found else n
            else:
                close = html.find(">", end)
                at = n if close < 0 else close + 1
        else:
            out.append(("s", tag, m.group(3)))
    return out


def _ends(events: list[tuple[str, str, str]]) -> dict[int, int]:
    """The event that ends each HIDDEN element, for those that are ended within their parent."""
    stack: list[tuple[str, int]] = []
    held: Counter = Counter()
    out: dict[int, int] = {}
    for k, (kind, tag, more) in enumerate(events):
        if kind == "t" or (tag not in HIDDEN and tag not in BLOCKS):
            continue
        if kind == "s":
            if not (tag in HIDDEN and more.rstrip().endswith("/")):
                stack.append((tag, k))
                held[tag] += 1
        elif held[tag]:
            while True:
                name, begin = stack.pop()
                held[name] -= 1
                if name == tag:
                    if tag in HIDDEN:
                        out[begin] = k
                    break
    return out


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(nodes, parents before children; text blocks in page order with their nodes).

    A HIDDEN element that is ended hides what it holds. One that isn't hides text up to the next block or to its parent's
    end; a head without end tag hides nothing, as its own elements do.
    """
    events = _events(html)
    ends = _ends(events)
    nodes = [Node("html", {}, -1, 0)]
    blocks: list[tuple[int, list[str]]] = []
    opened: Counter = Counter()
    at, links, fresh, soft, seen, k = 0, 0, True, False, 0, -1
    while k + 1 < len(events):
        k += 1
        kind, tag, more = events[k]
        if kind == "t":
            if soft or (fresh or not blocks or blocks[-1][0] != at) and not tag.strip():
                continue
            text = unescape(tag) if "&" in tag else tag
            if fresh or not blocks or blocks[-1][0] != at:
                blocks.append((at, []))
                fresh = False
            blocks[-1][1].append(text)
            size = len(text.strip())
            if size:
                node = nodes[at]
                if len(node.head) < SHORT:
                    node.head += text[: SHORT + 40] + " "
                node.chars += size
                node.linked += size * links
                node.stops += text.count(". ") + text.rstrip().endswith((".", "!", "?"))
                seen += size
        elif kind == "s":
            if tag in HIDDEN:
                if k in ends:
                    k = ends[k]
                    fresh = fresh or tag == "head"
                elif tag != "head" and not more.rstrip().endswith("/"):
                    soft = True
            elif tag in BLOCKS:
                soft = False
                if tag == "html":
                    nodes[0].attrs = _attributes(more)
                    continue
                node = nodes[at]
                if tag in CLOSES.get(node.tag, ()):
                    opened[node.tag] -= 1
                    at = node.parent
                nodes.append(Node(tag, _attributes(more) if more else {}, at, seen))
                nodes[at].children.append(len(nodes) - 1)
                at = len(nodes) - 1
                opened[tag] += 1
                fresh = True
                links = 0 if tag not in ("div", "h1", "h2", "h3", "h4", "p") else links
            elif tag in ("br", "hr"):
                fresh = True
            elif tag == "a":
                links = 1
        elif tag == "a":
            links = 0
        elif tag in BLOCKS:
            fresh = True
            if opened[tag] > 0:
                soft = False
                while nodes[at].tag != tag:
                    opened[nodes[at].tag] -= 1
                    at = nodes[at].parent
                opened[tag] -= 1
                at = nodes[at].parent
    for node in reversed(nodes):
        node.all_chars += node.chars
        node.all_linked += node.linked
        node.all_stops += node.stops
        if node.parent >= 0:
            up = nodes[node.parent]
            up.all_chars += node.all_chars
            up.all_linked += node.all_linked
            up.all_stops += node.all_stops
    return nodes, [(i, t) for i, parts in blocks if (t := " ".join("".join(parts).split()))]


def _said(text: str) -> list[str]:
    """Kinds of SAYS among the words of a short text."""
    if not text or len(text) > SHORT + 1:
        return []
    out = {_SAY[w] for w in map(str.lower, _LETTERS.findall(text)) if w in _SAY}
    if "©" in text:
        out.add("edge")
    return sorted(out)


def _told(text: str) -> list[str]:
    """Kinds of TELLS of which two words stand at a block's begin."""
    found = Counter(k for w in set(map(str.lower, _LETTERS.findall(text))) if (k := _TELL.get(w)))
    return sorted(k for k, n in found.items() if n >= 2)


def features(nodes: list[Node]) -> list[list[str]]:
    """Each node's features: tag, names, size, links and sentences of itself and of what is below it, words of short texts and of notices, repeated siblings, what the heading before it says, place in the page."""
    whole = max(1, nodes[0].all_chars)
    said = [_said(x.head) if x.chars else [] for x in nodes]
    out: list[list[str]] = []
    after: list[str] = [""] * len(nodes)
    twins = [0] * len(nodes)
    leads = [False] * len(nodes)  # headings beside paragraphs in sentences: what they say is the article's, but for a talk
    for x in nodes:
        kinds = Counter((nodes[c].tag, nodes[c].attrs.get("class")) for c in x.children)
        heading = ""
        prose = any(nodes[c].tag == "p" and nodes[c].stops for c in x.children)
        for c in x.children:
            child = nodes[c]
            leads[c] = prose and child.tag in _TITLES and "talk" not in said[c]
            twins[c] = kinds[child.tag, child.attrs.get("class")]
            if child.tag in HEADINGS:
                heading = said[c][0] if said[c] else "other"
            else:
                after[c] = heading
    for i, x in enumerate(nodes):
        a = x.attrs
        fs = ["bias", f"tag={x.tag}"]
        if a:
            cues = {cue for key in ("class", "id") if a.get(key) for w in _WORD.findall(a[key]) if (cue := _CUE.get(w.lower()))}
            fs += [f"cue={c}" for c in sorted(cues)]
            if role := a.get("role"):
                fs.append(f"role={role}")
            if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", ""):
                fs.append("hidden")
        if x.all_chars:
            fs.append(f"links={min(4, int(5 * x.all_linked / x.all_chars))}")
            fs.append(f"all={min(7, int(math.log2(x.all_chars)) // 2)}")
            fs.append(f"prose={min(3, x.all_stops * 80 // x.all_chars)}")
            fs.append(f"part={min(3, int(4 * x.all_chars / whole))}")
        if x.chars:
            fs.append(f"own={min(5, int(math.log2(x.chars)) // 2)}")
            fs.append(f"stops={min(x.stops, 3)}")
            if x.chars <= SHORT and _DATED.search(x.head):
                fs.append("dated")
        else:
            fs.append("own=none")
        fs += ["leads"] if leads[i] else [f"says={k}" for k in said[i]]
        if x.chars and x.tag not in _TITLES:
            fs += [f"tells={k}" for k in _told(x.head)]
        if after[i]:
            fs.append(f"after={after[i]}")
        if twins[i] > 1 and x.tag not in ("p", "li", "td", "tr", "th"):
            fs.append(f"twins={min(3, twins[i])}")
        if x.parent >= 0:
            fs.append(f"under={nodes[x.parent].tag}")
            fs.append(f"place={min(3, 4 * x.before // whole)}")
            if x.tag in ("p", "li", "td", "div") and said[x.parent]:
                fs.append(f"upsays={said[x.parent][0]}")
        out.append(fs)
    return out


class TreeModel:
    """Weights of node features and of parent-child pairs; marginals by sum-product."""

    def __init__(self):
        self.node: dict[str, float] = {}
        self.pair = {kind: [[0.5, -0.5], [-0.5, 0.5]] for kind in ("cue", "plain")}  # [parent][child]

    @staticmethod
    def kind(fs: list[str]) -> str:
        return "cue" if any(f[:4] in ("cue=", "role") for f in fs) or fs[1] in ("tag=nav", "tag=aside", "tag=header", "tag=footer", "tag=form", "tag=article", "tag=main") else "plain"

    def messages(self, parents: list[int], fs: list[list[str]], kinds: list[str]):
        """(log odds of every node by all evidence, by its own subtree; upward messages)."""
        n = len(parents)
        up = [sum(self.node.get(f, 0.0) for f in x) for x in fs]
        sent = [0.0] * n
        for i in range(n - 1, 0, -1):
            w = self.pair[kinds[i]]
            sent[i] = _lse(w[1][0], w[1][1] + up[i]) - _lse(w[0][0], w[0][1] + up[i])
            up[parents[i]] += sent[i]
        full = up[:]
        for i in range(1, n):
            w = self.pair[kinds[i]]
            rest = full[parents[i]] - sent[i]
            full[i] = up[i] + _lse(w[0][1], w[1][1] + rest) - _lse(w[0][0], w[1][0] + rest)
        return full, up, sent

    def fit(self, pages: list[tuple[list[int], list[list[str]], list[int]]], rounds: int = 80, rate: float = 0.3, decay: float = 0.0005) -> TreeModel:
        past: dict = {}
        for _ in range(rounds):
            grad: dict = {}
            for parents, fs, y in pages:
                kinds = [self.kind(x) for x in fs]
                full, up, sent = self.messages(parents, fs, kinds)
                for i, x in enumerate(fs):
                    d = y[i] - 1 / (1 + math.exp(-max(-60.0, min(60.0, full[i]))))
                    for f in x:
                        grad[f] = grad.get(f, 0.0) + d
                    if i:
                        w, rest = self.pair[kinds[i]], full[parents[i]] - sent[i]
                        joint = [w[p][c] + p * rest + c * up[i] for p in (0, 1) for c in (0, 1)]
                        top = max(joint)
                        e = [math.exp(j - top) for j in joint]
                        z = sum(e)
                        for p in (0, 1):
                            for c in (0, 1):
                                k = (kinds[i], p, c)
                                grad[k] = grad.get(k, 0.0) + (y[parents[i]] == p and y[i] == c) - e[2 * p + c] / z
            for k, g in grad.items():
                old = self.node.get(k, 0.0) if isinstance(k, str) else self.pair[k[0]][k[1]][k[2]]
                g -= decay * len(pages) * old
                past[k] = past.get(k, 1e-6) + g * g
                new = old + rate * g / math.sqrt(past[k])
                if isinstance(k, str):
                    self.node[k] = new
                else:
                    self.pair[k[0]][k[1]][k[2]] = new
        return self

    def content(self, nodes: list[Node]) -> list[float]:
        """Each node's log odds of being content."""
        fs = features(nodes)
        return self.messages([x.parent for x in nodes], fs, [self.kind(x) for x in fs])[0]


def _lse(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


# --- labelled pages -----------------------------------------------------------------------------------------

#: The labelled table: pages as sites build them. data-y labels an element and what is below it: 1 content, 0 not. In braces: t a title,
#: s a sentence, p a paragraph, l a link, n a name, d a date, and (..|..) one of several; [..] comes up to five times.
PAGES = (
    """<html><body data-y=1 class=single><div id=page data-y=1><div data-y=0 id=masthead><a href=/>{t}</a><p>{t}</p></div><div data-y=0 class=menu-main><ul><li><a href=/>Home</a><li><a href=/a>About</a>[<li>{l}]</ul></div>
    <div id=primary><div class=hentry data-y=1><h1>{t}</h1><p>{p}</p>[<p>{p}</p>]<h2>{t}</h2>[<p>{p}</p>]<div data-y=0 class=sharedaddy><h3>Share this:</h3><ul><li><a href=x>Twitter</a><li><a href=y>Facebook</a></ul></div></div>
    <div data-y=0 class=feed><h3>3 thoughts on {t}</h3><ol>[<li><div><cite>{n}</cite> says:<br>{d} at 10:12 am</div><p>{s}</p><div><a href=r>Reply</a></div></li>]</ol><h3>Leave a Reply</h3><form><p>Your email address will not be published.</p><label>Name</label><input></form></div></div>
    <div data-y=0 id=secondary><h2>Recent Posts</h2><ul>[<li>{l}]</ul><h2>Archives</h2><ul>[<li><a href=z>{d}</a>]</ul></div><div data-y=0 id=colophon>Proudly powered by {t}</div></div></body></html>""",
    """<html><body data-y=1><table data-y=1 width=100%><tr data-y=0><td colspan=2><b>{t}</b><br>{t}</td></tr><tr data-y=1><td data-y=0 width=120>{l}<br>{l}<br>[{l}<br>]</td><td data-y=1><h2>{t}</h2><p>{p}<p>{p}[<p>{p}]</td></tr><tr data-y=0><td colspan=2>Copyright {d} {n}. All rights reserved.</td></tr></table></body></html>""",
    """<html><body data-y=1><table data-y=1><tr data-y=0><td><a href=/>Home</a> | {l} | {l} [| {l} ]</td></tr><tr data-y=1><td data-y=1>{p}<br><br>{p}<br><br>[{p}<br>]</td></tr><tr data-y=0><td>Home | Contact | (Site map|Search|Help)</td></tr></table></body></html>""",
    """<html><body data-y=1><center data-y=0><a href=/>(Up|Home|Index)</a> <a href=n>Next</a> <a href=b>Previous</a></center><h1>{t}</h1><p>{p}[<p>{p}]<pre>{s}</pre>[<p>{p}]<hr><address data-y=0>{n}, last changed {d}</address></body></html>""",
    """<html><body data-y=1><h1>{t}</h1><p>{p}[<p>{p}]<ul><li>{s}<li>{s}[<li>{s}]</ul><p>{p}<dl><dt>{t}<dd>{s}<dt>{t}<dd>{s}</dl></body></html>""",
    """<html><body data-y=1><header data-y=0><div><a href=/>{t}</a></div><nav><ul>[<li>{l}</li>]</ul></nav><form><input><button>Go</button></form></header><main data-y=1><article data-y=1><header data-y=1><h1>{t}</h1><p data-y=0>By <a href=u>{n}</a>, {d}</p></header><p>{p}</p>[<p>{p}</p>]<figure><img><figcaption>{s}</figcaption></figure>[<p>{p}</p>]<aside data-y=0><h4>(Read more|Related|More on this)</h4>{l}{l}</aside>[<p>{p}</p>]</article>
    <section data-y=0><h2>(Comments|Responses|Discussion) (3)</h2>[<article><header>{n} <time>{d}</time></header><p>{s}</p><footer><a href=r>Reply</a> <a href=l>Like</a></footer></article>]</section></main><footer data-y=0><ul>[<li>{l}</li>]</ul><small>&copy; {d} {t}</small></footer></body></html>""",
    """<html><body data-y=1><div data-y=0><div>We use cookies to improve {t}. <a href=c>Accept</a> <a href=p>Privacy</a></div></div><div data-y=0><a href=/>{t}</a></div><div data-y=0>[<a href=q>{n}</a> ]</div><div data-y=1><div><h1>{t}</h1><div data-y=0>{n} | {d}</div><div>{p}</div>[<div>{p}</div>]<div data-y=0>Advertisement<div>{s}</div></div>[<div>{p}</div>]</div></div>
    <div data-y=0><div>Comments</div>[<div><div>{n} - 3 hours ago</div><div>{p}</div><div><a href=r>Reply</a></div></div>]</div><div data-y=0><div>You may also like</div>[<div><a href=x>{t}</a></div>]</div><div data-y=0>Terms of use | Privacy | Contact</div></body></html>""",
    """<html><body data-y=1><div data-y=0 role=navigation><a href=i>index</a> <a href=m>modules</a> | <a href=n>next</a> | <a href=p>previous</a></div><div data-y=1 class=document><div data-y=1 role=main><h1>{t}<a href=#x>¶</a></h1><p>{p}</p><pre>{s} = {s}</pre><p>{p}</p><dl><dt>{n}({n})</dt><dd><p>{p}</p></dd></dl>[<p>{p}</p>]<table><tr><th>{t}</th><th>{t}</th></tr>[<tr><td>{s}</td><td>{s}</td></tr>]</table></div><div data-y=0 class=sphinxsidebar><h3>Table of Contents</h3><ul>[<li>{l}</li>]</ul><h3>Quick search</h3><form><input></form></div></div><div data-y=0 class=footer>&copy; Copyright {d}, {n}. Created using {t}.</div></body></html>""",
    """<html><body data-y=1><div data-y=0 class=nav-top>{l}{l}</div><div data-y=1 class=thread><h1>{t}</h1><div data-y=1><div data-y=1 class=question><p>{p}</p>[<p>{p}</p>]<pre>{s}</pre></div></div><div data-y=0><h2>2 Replies</h2>[<div><p>{p}</p><div>{n} replied {d}</div></div>]</div></div><div data-y=0>{l} {l} {l}</div></body></html>""",
    """<html><body data-y=1><nav data-y=0>[{l} ]</nav><article data-y=1><h1>{t}</h1>[<p>{p}</p>]<p>{s} <a href=r>{t}</a>, {s}</p>[<p>{p}</p>]<blockquote><p>{p}</p></blockquote></article><div data-y=0 class=promo>{s}</div><footer data-y=0>{t} {d}</footer></body></html>""",
    """<html><body data-y=1><nav data-y=0><ul>[<li>{l}</li>]</ul></nav><div data-y=0 class=ad>{s}</div><article data-y=1><h1>{t}</h1><p>{t}</p></article><footer data-y=0>&copy; {n} &middot; {s}</footer></body></html>""",
    """<html><body data-y=1><div class=container data-y=1><div data-y=0 class=row><h4>{t}</h4><span>{s}</span></div><div class=row data-y=1><div class=col-8 data-y=1><h2>{t}</h2><h5 data-y=0>{n}, {d}</h5>[<p>{p}</p>]<ol><li>{s}</li><li>{s}</li>[<li>{p}</li>]</ol><p>{p}</p></div><div data-y=0 class=col-4><div><h4>(Categories|Tags|Popular)</h4>[<a href=t>{n}</a> ]</div><div><h4>Newsletter</h4><p>Subscribe and get {s}</p><form><input><button>Subscribe</button></form></div></div></div></div><div data-y=0>[{l} ]</div></body></html>""",
    """<html><body data-y=1><div data-y=0 id=mw-head><ul>[<li>{l}</li>]</ul></div><div data-y=1 id=content><h1>{t}</h1><div data-y=0 class=hatnote>For other uses, see <a href=o>{t}</a>.</div><p><b>{t}</b> {p}</p>[<p>{p} <a href=w>{t}</a> {s}</p>]<div data-y=0 id=toc><h2>Contents</h2><ul>[<li><a href=#1>1 {t}</a></li>]</ul></div><h2>{t}<span data-y=0>[<a href=e>edit</a>]</span></h2>[<p>{p}</p>]<table><caption>{t}</caption><tr><th>{t}<td>{s}<tr><th>{t}<td>{s}</table></div><div data-y=0 id=catlinks>Categories: [{l} | ]</div><div data-y=0><ul><li>This page was last edited on {d}.</li><li><a href=p>Privacy policy</a></li></ul></div></body></html>""",
    """<html><body data-y=1><header data-y=0><h1>{t}</h1><p>{s}</p></header><section data-y=1><h2>{t}</h2><p>{p}</p>[<p>{p}</p>]</section><section data-y=1><h2>{t}</h2>[<p>{p}</p>]</section><aside data-y=0><p>{s}</p><ul>[<li>{l}</li>]</ul></aside><footer data-y=0><p>{s}</p></footer></body></html>""",
    """<html><body data-y=1><form data-y=1 id=aspnet><div data-y=0>{l} | {l} | {l}</div><div data-y=1><h1>{t}</h1><div>{p}</div><br>{p}<br><br>{p}</div><div data-y=0>{t} &copy; {d}</div></form></body></html>""",
    """<html><body data-y=1><div data-y=0 class=topbar>{n} <a href=l>Login</a> <a href=r>Register</a></div><div data-y=1><div data-y=0 class=breadcrumb><a href=/>Home</a> &gt; {l} &gt; {t}</div><h1>{t}</h1><div data-y=1><p>{p}</p><ul><li>{s}<li>{s}</ul>[<p>{p}</p>]</div><div data-y=0><a href=b>Buy now</a> <span>Special offer: {t}</span></div></div><div data-y=0><h3>Customer reviews</h3>[<div><b>{n}</b> wrote on {d}: <p>{p}</p></div>]</div></body></html>""",
    """<html><body data-y=1><div data-y=0 role=banner>{t}</div><div data-y=1 role=main><h1>{t}</h1>[<p>{p}</p>]</div><div data-y=0 role=complementary>{s} {l}</div><div data-y=0 role=contentinfo>{s}</div><div data-y=0 role=dialog><p>{s}</p><button>OK</button></div></body></html>""",
    """<html><body data-y=1><p>{p}</p>[<p>{p}</p>]</body></html>""",
    """<html><body data-y=1><div data-y=0>{l} {l} {l}</div><main data-y=1><h1>(About us|Contact|Help and FAQ|Privacy and terms|Über uns und Kontakt)</h1><p>{p}</p><h2>(Subscribe|Our newsletter and privacy|Related work|Terms and rights|Follow us|Search tips|{t})</h2><p>{p}</p>[<p>{p}</p>]<h2>(Contact|Latest news|Login|Archive|{t})</h2><p>{p}</p></main><div data-y=0>&copy; {d} {n}</div></body></html>""",
    """<html><body data-y=1><div data-y=0><p>(We value your privacy.|We use cookies to store data on your device.|This site stores data about your browsing and shares it with partners.|Wir speichern Daten und Cookies auf Ihrem Gerät.) {s}</p></div><div data-y=1><h1>{t}</h1><p>{p}</p>[<p>{p}</p>]<div data-y=0>(Buy cheap|Shop for|Save today on|Order now: free delivery of) {t} (today|at the best price|while offers last|, free delivery). {s}</div><p>{p}</p></div><div data-y=0><h3>(Newsletter|Stay in touch)</h3><p>(Sign up and get our newsletter in your inbox.|Subscribe to get news in your inbox.)</p></div></body></html>""",
    """<html><body data-y=1>{p}<br><br>{p}<br><br>{p}</body></html>""",
    """<html><body data-y=1><div data-y=0><ul>[<li>{l}</li>]</ul></div><h3>{t}</h3><p>{s}</p><p>{p}</p><ul><li>{s}</li><li>{s}</li></ul><p>{s}</p><div data-y=0><p>{l}</p><p>Powered by {n}</p></div></body></html>""",
    """<html><body data-y=1><div data-y=1 class=recipe><h1>{t}</h1><p>{p}</p><h2>{t}</h2><ul><li>{t}</li><li>{t}</li>[<li>{t}</li>]</ul><h2>{t}</h2><ol><li>{s}</li>[<li>{s}</li>]</ol></div><div data-y=0><h2>Comments</h2>[<div><p>{n}</p><p>{s}</p></div>]</div><div data-y=0><p>Sponsored</p><a href=a>{s}</a></div></body></html>""",
)
_WORDS = {
    "en": "the river of an old town and its people were known for bread wool music after long winter many came to work in small houses near water where children played until evening light".split(),
    "de": "der alte Fluss und die Stadt waren bekannt für Brot Wolle Musik nach langem Winter kamen viele zur Arbeit in kleine Häuser nahe am Wasser wo Kinder bis zum Abend spielten".split(),
    "fr": "la vieille ville et ses habitants étaient connus pour le pain la laine et la musique après un long hiver beaucoup venaient travailler dans de petites maisons près de l eau".split(),
    "es": "la vieja ciudad y su gente eran conocidas por el pan la lana y la música después de un largo invierno muchos venían a trabajar en casas pequeñas cerca del agua".split(),
}
_NAMES = "Anna Bernd Carla David Elena Franck Greta Hugo Inés Jonas Klara Luis".split()


def labelled_pages(n: int = 230, seed: int = 3) -> list[str]:
    """The training table: PAGES filled with seeded words; in part of them class and id say nothing and no element but div stands around blocks."""
    r = random.Random(seed)

    def fill(page: str) -> str:
        words = _WORDS[r.choice(["en", "en", "de", "fr", "es"])]
        text = lambda lo, hi: " ".join(r.choice(words) for _ in range(r.randint(lo, hi)))
        sentence = lambda: text(*r.choice([(2, 6), (6, 18), (6, 18)])).capitalize() + r.choice(".....!?")
        date = lambda: r.choice([f"{r.randint(1, 28)} May {r.randint(1999, 2024)}", f"{r.randint(1999, 2024)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}", f"{r.randint(2, 9)}/{r.randint(1, 28)}/20{r.randint(10, 24)}"])
        values = {
            "{t}": lambda: text(1, 7).capitalize(),
            "{s}": sentence,
            "{p}": lambda: " ".join(sentence() for _ in range(r.choice([1, 2, 3, 4, 6]))),
            "{l}": lambda: f'<a href="/{r.choice(words)}">{text(1, 3)}</a>',
            "{n}": lambda: r.choice(_NAMES) + r.choice(["", " " + r.choice(_NAMES)]),
            "{d}": date,
        }
        page = re.sub(r"\[([^\[\]]*)\]", lambda m: m.group(1) * r.choice([0, 1, 2, 3, 5]), page)
        page = re.sub(r"\(([^()|]*(?:\|[^()|]*)+)\)", lambda m: r.choice(m.group(1).split("|")), page)
        return re.sub(r"\{[tsplnd]\}", lambda m: values[m.group()](), page)

    out = []
    for k in range(n):
        page = fill(PAGES[k % len(PAGES)])
        style = r.random()
        if style < 0.45:  # names that say nothing
            page = re.sub(r" (class|id)=[^ >]+", lambda m: r.choice([f" class=c{r.randint(100, 999)}", "", " class=col-1"]), page)
        if style < 0.2:
            page = re.sub(r"(</?)(?:nav|header|footer|aside|article|main|section)(?=[ >])", r"\1div", page)
        out.append(page)
    return out


def labels(nodes: list[Node]) -> list[int]:
    y: list[int] = []
    for x in nodes:
        own = x.attrs.get("data-y")
        y.append(int(own) if own is not None else y[x.parent] if x.parent >= 0 else 1)
    return y


@lru_cache(maxsize=4)
def trained(n: int = 230, seed: int = 3) -> TreeModel:
    data = []
    for html in labelled_pages(n, seed):
        nodes, _ = parse(html)
        data.append(([x.parent for x in nodes], features(nodes), labels(nodes)))
    return TreeModel().fit(data)


def extract(html: str, model: TreeModel) -> tuple[str, int, int]:
    """(main text, blocks kept, blocks)."""
    nodes, blocks = parse(html)
    odds = model.content(nodes)
    kept = [t for i, t in blocks if odds[i] >= 0]
    return " ".join(kept), len(kept), len(blocks)


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: TreeModel | None = None) -> DataFrame:
    """(id, url, text, n_chars, n_blocks, n_kept) of every row.

    A null page counts as empty: no text. Ids and urls may be null or repeated, each row has its own result; other columns,
    whatever their names, are not looked at; an empty table gives no rows. Pages of any length are read whole, one at a time;
    a node whose odds are even counts as content. The model is trained on the driver from the small labelled table and travels with
    the function; one narrow pass over Arrow batches, nothing is shuffled.
    """
    bound_batches(df.sparkSession)
    model = model or trained()
    slim = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("u"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("h"))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(url_col, df.schema[url_col].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_blocks", T.LongType()), T.StructField("n_kept", T.LongType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                rows = [extract(h, model) for h in part.column(2).to_pylist()]
                texts = [t for t, _, _ in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array([n for _, _, n in rows], pa.int64()), pa.array([k for _, k, _ in rows], pa.int64())], names=schema.names)

    return slim.mapInArrow(run, schema)
