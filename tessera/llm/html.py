"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A tolerant scan of the html gives the leaf blocks of the document tree in page order,
each with its ancestors' tags and class words.  Features of ancestors and of the text
score two labels, content and other; neighbouring labels score each other; the best
labelling of a page is found by Viterbi.  The weights are trained by gradient ascent on
the exact likelihood (forward and backward sums) over labelled pages that `labelled_pages`
writes in many layouts, with menus, notices, adverts, forms, sidebars and comments, so
no page of the tables is used to train.

Cases: null, empty or text-less html gives the empty text; unclosed and crossing tags
are closed as browsers do for heads, paragraphs and list items; a solidus before `>` closes
only foreign elements; references without semicolon are decoded; blocks know their
ancestors by shared nodes, so that deep nesting takes linear memory; nothing is dropped or
capped for length; of labellings that score alike the one with the earlier `other` wins;
repeated rows each get a row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import random
import re
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

#: Elements that don't break a block, elements without an end, elements of the head, elements whose content is no markup.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
#: Elements whose content isn't shown and breaks no block; those of the first two close themselves by a solidus.
FOREIGN = frozenset("svg math template object".split())
#: An opening tag of the first closes an open one of the second, up to the nearest of the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_PARAGRAPH = ({"p"}, {"div", "article", "section", "td", "body"})

#: A comment, a declaration, or a tag: its solidus, name and attributes; quotes count where a value begins.
_TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+)(?:>|\Z)""", re.DOTALL
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAMING = frozenset("class id role itemprop aria-label".split())
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/\Z""")
_PART = re.compile(r"[a-zA-Z][a-z]+|[A-Z]+(?![a-z])|[a-z]+")
_WORD = re.compile(r"\w+")


@dataclass(eq=False, slots=True)
class Node:
    """An open element: its tag, class words and parent.

    fresh: a block element whose tag none above has; own: the nearest block element's tag;
    sided, main: whether it or one above is of an aside's or of an article's kind.
    """

    tag: str
    words: tuple[str, ...]
    parent: Node | None
    hidden: bool
    fresh: bool
    own: str
    sided: bool
    main: bool


@dataclass(slots=True)
class Block:
    """A leaf block: its text, the element that holds it, the share of its characters in links."""

    text: str
    node: Node | None
    linked: float


def _read(attributes: str) -> tuple[tuple[str, ...], bool]:
    """Words of the naming attributes, and whether the element is hidden."""
    words, hidden = set(), False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in _NAMING:
            words.update(w.lower() for w in _PART.findall(value))
            hidden = hidden or (name == "class" and "hidden" in value.split())
        elif name == "hidden":
            hidden = hidden or value.lower() != "false"
        elif name == "style":
            hidden = hidden or _UNSEEN.search(value) is not None
        elif name == "aria-hidden":
            hidden = hidden or value.lower() == "true"
    return tuple(sorted(words)), hidden


class _Scan:
    """The stack of open elements while a page is read, and the blocks so far."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack: list[Node] = []
        self.open: dict[str, int] = {}
        self.hidden = 0
        self.parts: list[str] = []
        self.linked = 0

    def close(self) -> None:
        """The block ends here."""
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, self.stack[-1] if self.stack else None, min(1.0, self.linked / max(1, len(text)))))
            self.parts, self.linked = [], 0

    def says(self, text: str) -> None:
        if self.stack and self.stack[-1].tag == "head" and not text.isspace():
            self.pop(len(self.stack) - 1)
        if not self.hidden:
            said = entities.unescape(text) if "&" in text else text
            self.parts.append(said)
            if self.open.get("a"):
                self.linked += len(said)

    def push(self, tag: str, words: tuple[str, ...], hidden: bool) -> None:
        above, block = self.stack[-1] if self.stack else None, tag not in INLINE
        self.stack.append(Node(
            tag, words, above, hidden, block and tag not in ("html", "body") and not self.open.get(tag), tag if block else above.own if above else "",
            (above.sided if above else False) or tag in ("nav", "footer", "aside", "form", "header"), (above.main if above else False) or tag in ("article", "main"),
        ))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.hidden += hidden

    def pop(self, to: int) -> None:
        """Close elements from the top down to place `to`."""
        if not self.hidden and any(n.tag not in INLINE for n in self.stack[to:]):
            self.close()
        while len(self.stack) > to:
            node = self.stack.pop()
            self.open[node.tag] -= 1
            self.hidden -= node.hidden

    def close_open(self, closing: set[str], border: set[str]) -> None:
        """Close open elements of some tags up to the nearest border."""
        for k in range(len(self.stack) - 1, -1, -1):
            if not any(self.open.get(t) for t in closing):
                return
            if self.stack[k].tag in closing:
                self.pop(k)
            elif self.stack[k].tag in border:
                return

    def ends(self, tag: str) -> None:
        if tag == "p" and not self.open.get("p") and not self.hidden:
            self.close()
        if not self.open.get(tag):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                self.pop(k)
                return
            if tag in INLINE and self.stack[k].tag not in INLINE:  # an inline end tag doesn't close the blocks around
                return

    def begins(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.says("\n")
            return
        if self.stack and self.stack[-1].tag == "head" and tag not in HEAD:
            self.pop(len(self.stack) - 1)
        if tag in FOREIGN or self.hidden:
            if tag not in VOID and not _SELF_CLOSED.search(attributes):
                self.push(tag, (), tag in FOREIGN)
            return
        if tag not in INLINE:
            self.close()
            self.close_open(*CLOSES.get(tag, _PARAGRAPH))
            if tag != "p" and self.open.get("p"):
                self.pop(max(i for i, n in enumerate(self.stack) if n.tag == "p"))
        if tag not in VOID:
            words, hidden = _read(attributes) if attributes else ((), False)
            self.push(tag, words, hidden or tag == "head")


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks with text, in page order."""
    scan, at = _Scan(), 0
    while at < len(page):
        m = _TAG.search(page, at)
        if at < (m.start() if m else len(page)):
            scan.says(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            scan.ends(tag)
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s>/])[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
        else:
            scan.begins(tag, m[3])
    if not scan.hidden or scan.parts:
        scan.close()
    return scan.blocks


def _node_features(node: Node) -> list[str]:
    """What an ancestor adds to the features of the blocks below it."""
    return ([f"in={node.tag}"] if node.fresh else []) + [f"class={w[:6]}" for w in node.words]


def _own_features(blocks: list[Block], k: int) -> list[str]:
    """Features of a block's text and place, and of all its ancestors at once."""
    b, n = blocks[k], blocks[k].node
    # the class of 32 words and more is the last
    words = sum(1 for _ in islice(_WORD.finditer(b.text), 32))
    f = ["bias", f"own={n.own if n else ''}", f"words={min(6, words.bit_length())}", f"linked={int(b.linked * 3.99)}"]
    if n and n.sided and n.main:
        f.append("aside in article")
    if b.text[-1:] in ".!?…»”\"":
        f.append("sentence")
    if "©" in b.text or "·" in b.text or "|" in b.text:
        f.append("mark")
    if not any(map(str.isalpha, b.text)):
        f.append("no letter")
    if k == 0:
        f.append("first")
    if k == len(blocks) - 1:
        f.append("last")
    return f


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that each block has."""
    out = []
    for k, b in enumerate(blocks):
        f, node = _own_features(blocks, k), b.node
        while node:
            f += _node_features(node)
            node = node.parent
        out.append(f)
    return out


@dataclass
class Chain:
    """Weights: per feature (other, content), and transitions [from, to]."""

    weights: dict[str, tuple[float, float]]
    turns: np.ndarray

    def scores(self, names: list[list[str]]) -> np.ndarray:
        get, zero = self.weights.get, (0.0, 0.0)
        out = np.empty((len(names), 2))
        for k, f in enumerate(names):
            a = b = 0.0
            for name in f:
                x, y = get(name, zero)
                a += x
                b += y
            out[k] = a, b
        return out

    def decode(self, names: list[list[str]]) -> list[int]:
        """The best labelling, by Viterbi."""
        return self._best(self.scores(names).tolist())

    def label(self, blocks: list[Block]) -> list[int]:
        """decode(features(blocks)); each ancestor is scored once, upon its parent's score."""
        get, zero = self.weights.get, (0.0, 0.0)
        total = lambda names, a=0.0, b=0.0: (a + sum(get(n, zero)[0] for n in names), b + sum(get(n, zero)[1] for n in names))
        held: dict[int, tuple[float, float]] = {id(None): zero}
        scored = []
        for k, block in enumerate(blocks):
            above, node = [], block.node
            while id(node) not in held:
                above.append(node)
                node = node.parent
            for node in reversed(above):
                held[id(node)] = total(_node_features(node), *held[id(node.parent)])
            scored.append(total(_own_features(blocks, k), *held[id(block.node)]))
        return self._best(scored)

    def _best(self, s: list) -> list[int]:
        if not s:
            return []
        (oo, oc), (co, cc) = self.turns.tolist()
        o, c = s[0]
        back = []
        for x, y in s[1:]:
            to_o, to_c = (0, o + oo) if o + oo >= c + co else (1, c + co), (0, o + oc) if o + oc >= c + cc else (1, c + cc)
            back.append((to_o[0], to_c[0]))
            o, c = to_o[1] + x, to_c[1] + y
        label = int(c > o)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 30, rate: float = 0.15, ridge: float = 1e-3, seed: int = 5) -> Chain:
    """Maximise the likelihood of the labels, page by page, with adaptive steps."""
    names = sorted({n for p, _ in pages for f in p for n in f})
    number = {n: i for i, n in enumerate(names)}
    w, t = np.zeros((len(names), 2)), np.zeros((2, 2))
    gw, gt = np.full_like(w, 1e-2), np.full_like(t, 1e-2)
    held = []
    for p, y in pages:
        flat = np.array([number[n] for f in p for n in f])
        cuts = np.cumsum([0, *(len(f) for f in p)])
        held.append((flat, cuts, np.array(y)))
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(held)
        for flat, cuts, y in held:
            n = len(y)
            s = np.add.reduceat(w[flat], cuts[:-1], axis=0)
            before, after = np.empty((n, 2)), np.zeros((n, 2))
            before[0] = s[0]
            for k in range(1, n):
                before[k] = s[k] + np.logaddexp(before[k - 1, 0] + t[0], before[k - 1, 1] + t[1])
            for k in range(n - 2, -1, -1):
                x = s[k + 1] + after[k + 1]
                after[k] = np.logaddexp(t[:, 0] + x[0], t[:, 1] + x[1])
            z = np.logaddexp(*before[-1])
            p = np.exp(before + after - z)
            g = -p
            g[np.arange(n), y] += 1
            step = np.zeros_like(w)
            np.add.at(step, flat, np.repeat(g, np.diff(cuts), axis=0))
            pair = np.exp(before[:-1, :, None] + t + (s[1:] + after[1:])[:, None, :] - z).sum(axis=0) if n > 1 else np.zeros((2, 2))
            turn = -pair
            np.add.at(turn, (y[:-1], y[1:]), 1)
            step -= ridge * w
            gw += step**2
            gt += turn**2
            w += rate * step / np.sqrt(gw)
            t += rate * turn / np.sqrt(gt)
    return Chain({n: (float(w[i, 0]), float(w[i, 1])) for n, i in number.items()}, t)


def labelled_pages(count: int = 260, seed: int = 11) -> list[tuple[str, list[tuple[str, int]]]]:
    """Pages in many layouts with each block's text and label (1: content)."""
    rng = random.Random(seed)
    syllables = "an be co de el fi ga ho in ju ka lo me no or pe qua ri so tu un ver wi xa yo zé ño ça ß ung ción eau".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    phrase = lambda a, z: " ".join(word() for _ in range(rng.randint(a, z)))

    def sentence() -> str:
        s = phrase(1, 25)
        return s[:1].upper() + s[1:] + rng.choice([".", ".", ".", "!", "?", ""])

    prose = lambda most: " ".join(sentence() for _ in range(rng.randint(1, most)))
    pages = []
    for _ in range(count):
        said: list[tuple[str, int]] = []
        body: list[str] = []

        def put(tag: str, text: str, label: int, attributes: str = "", shut: bool = True) -> str:
            said.append((" ".join(text.split()), label))  # noqa: B023
            inner = f"<b>{text}" if rng.random() < 0.1 else text
            return f"<{tag}{attributes}>{inner}" + (f"</{tag}>" if shut else "")

        def links(n: int, label: int = 0) -> str:
            return "<ul>" + "".join("<li>" + put("a", phrase(1, 3), label, ' href="/x"') + "</li>" for _ in range(n)) + "</ul>"  # noqa: B023

        def some(*kinds):  # noqa: ANN002, ANN202
            return rng.choice(kinds)

        def boxed(kind: str, inner: str) -> str:
            tag = {"nav": "nav", "footer": "footer", "header": "header", "aside": "aside", "form": "form"}.get(kind)
            names = {
                "nav": ("nav", "menu", "navbar", "breadcrumb", "navigation"), "footer": ("footer", "foot", "copyright", "site-footer"),
                "header": ("header", "masthead", "banner", "topbar"), "aside": ("sidebar", "widget", "related", "side"),
                "ad": ("ad", "advert", "ads", "sponsored", "promo", "advertisement"), "notice": ("notice", "cookie", "consent", "alert", "newsletter", "popup", "banner", "subscribe"),
                "comments": ("comments", "comment-list", "comment", "discussion", "replies", "respond"), "form": ("form", "search", "login", "signup"),
                "share": ("share", "social", "tags", "meta", "pagination"),
            }[kind]
            if tag is None or rng.random() < 0.4:
                tag = "section" if kind == "comments" and rng.random() < 0.4 else "div"
            attribute = f' {some("class", "id")}="{some(*names)}"' if tag in ("div", "section") or rng.random() < 0.4 else ""
            return f"<{tag}{attribute}>{inner}</{tag}>"

        def noise(kind: str) -> str:
            if kind == "nav":
                return boxed("nav", links(rng.randint(2, 9)))
            if kind == "header":
                return boxed("header", put(some("h1", "div", "p", "span"), phrase(1, 5), 0) + (links(3) if rng.random() < 0.5 else ""))
            if kind == "footer":
                return boxed("footer", put(some("p", "div", "span"), some("&copy; ", "", "Copyright ") + phrase(1, 12) + some("", " &middot; " + phrase(1, 5)), 0) + (links(3) if rng.random() < 0.4 else ""))
            if kind == "comments":
                return boxed("comments", "".join(put(some("h3", "h4"), phrase(1, 3), 0) if k == 0 else put(some("p", "div", "li"), prose(4), 0) for k in range(rng.randint(1, 6))))
            if kind == "form":
                return boxed("form", put("label", phrase(1, 3), 0) + "<input name=x>" + "<div>" + put("button", phrase(1, 2), 0) + "</div>")
            if kind == "share":
                return boxed("share", links(rng.randint(2, 5)) if rng.random() < 0.6 else put("span", phrase(1, 5), 0))
            if kind == "aside":
                return boxed("aside", put("h3", phrase(1, 3), 0) + (links(rng.randint(2, 6)) if rng.random() < 0.6 else put("p", prose(2), 0)))
            return boxed(kind, put(some("p", "div", "span"), prose(2), 0))

        bare = rng.random() < 0.15  # nothing but an article, perhaps of one paragraph
        for kind in ("notice", "header", "nav", "ad", "form"):
            if not bare and rng.random() < 0.5:
                body.append(noise(kind))
        container = some("<article>", "<article>", "<main>", '<div class="content">', '<div class="post">', '<div id="main">', '<div class="article-body">', '<main><article>', '<section class="story">')
        wrapped = some(0, 0, 1, 2)
        body += [f'<div{some("", f""" class="{some("wrapper", "container", "page", "row", "col", "site", "inner")}" """)}>' for _ in range(wrapped)]
        body.append(container)
        paragraph = some("p", "p", "p", "div")  # some pages set their paragraphs in plain divisions
        joint = some(*[" "] * 7, " | ", " · ", " © ")  # and some texts are full of signs
        wanted = lambda most: joint.join(prose(most).split(" "))  # noqa: B023, E731
        if rng.random() < (0.3 if bare else 0.8):
            body.append(put(some("h1", "h1", "h2"), phrase(2, 10), 1))
        for _ in range(rng.randint(1, 3 if bare else 12)):
            r = rng.random()
            if r < 0.72:
                body.append(put(paragraph, wanted(6), 1, shut=paragraph == "div" or rng.random() < 0.8))
            elif r < 0.8:
                body.append(put(some("h2", "h3"), phrase(1, 6), 1))
            elif r < 0.86:
                body.append("<ul>" + "".join(put("li", wanted(1), 1) for _ in range(rng.randint(1, 4))) + "</ul>")
            elif r < 0.9:
                body.append("<blockquote>" + put("p", wanted(3), 1) + "</blockquote>")
            elif r < 0.93:
                body.append(put("pre", phrase(2, 12), 1))
            else:
                body.append(noise(some("ad", "share", "notice", "aside", "ad")))
        body.append("".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", container))) + "</div>" * wrapped)
        for kind in ("share", "comments", "aside", "ad", "form", "footer"):
            if not bare and rng.random() < 0.5:
                body.append(noise(kind))
        pages.append(("<!DOCTYPE html><html><head><title>" + phrase(2, 5) + "</title><style>p{}</style></head><body>" + "".join(body) + some("</body></html>", ""), said))
    return pages


def model(count: int = 260) -> Chain:
    """Train on the labelled pages."""
    held = []
    for page, said in labelled_pages(count):
        blocks = blocks_of(page)
        if len(blocks) == len(said):  # as it is for all of these layouts
            held.append((features(blocks), [label for _, label in said]))
    return train(held)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""
    spread = pages.sparkSession.sparkContext.broadcast(chain or model())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = spread.value
        texts = []
        for page in batch.column("html").to_pylist():
            blocks = blocks_of(page) if page else []
            labels = found.label(blocks)
            texts.append("\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y))
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )

    held = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return map_arrow(held, run, "page_id long, url string, text string, n_chars long", rows=500)
