"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: the text between two block-level tags, with the path of tags, classes and ids
above it. A bidirectional LSTM in numpy reads the page's sequence of blocks, each as a vector of hashed path
parts, hashed words, a few measures and its distance in the tree of elements from the blocks beside it, and says of every block whether it belongs to the article, with the
whole page as context. It learns from made-up pages whose blocks' roles are known because a grammar of common layouts makes
them; fit() is seeded, so every session gets the same weights.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.llm.common import map_texts

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|object|textarea|select|head)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|</?[a-zA-Z][^<>\"']*(?:\"[^\"]*\"[^<>\"']*|'[^']*'[^<>\"']*)*>|</?[a-zA-Z][^>]*>", re.DOTALL | re.IGNORECASE)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
_TOKEN = re.compile(r"[a-z]+")
_WORD = re.compile(r"\w+|[©®|·•»]")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open tag of these ends an open one of the same set up to the nearest container.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NOT_IN_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
PATH, WORDS, EXTRA = 256, 48, 14
HIDDEN = 16


@dataclass
class Block:
    path: tuple[str, ...]  # names and marks above the text, outermost first
    text: str
    linked: int  # characters inside links
    nest: tuple[int, ...] = ()  # numbers of the open elements, outermost first: the same number is the same element


def _marks(tag: str) -> list[str]:
    out = []
    if "=" in tag:
        for m in _MARK.findall(tag):
            out += [t[:-1] if len(t) > 3 and t[-1] == "s" else t for t in _TOKEN.findall(m.lower())]
    return out


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order: character references decoded, runs of white space as one space, trimmed, none empty."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], tuple[int, ...]]] = [("", (), ())]
    parts: list[str] = []
    links = linked = at = opened = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(stack[-1][1], text, linked, stack[-1][2]))
            parts, linked = [], 0

    for m in _PIECE.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        if m.group(1) or page[m.start() + 1] in "!?":
            if m.group(1) and m.group(1).lower() not in ("svg",):
                flush()
            continue
        tag = m.group()
        name = _NAME.match(tag).group(1).lower()
        if name in INLINE:
            if name == "a":
                links = 0 if tag[1] == "/" else 1
            elif name == "br":
                parts.append(" ")
            continue
        flush()
        links = 0
        if tag[1] == "/":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name in VOID:
            continue
        if name in NOT_IN_P and stack[-1][0] == "p":
            stack.pop()
        while len(stack) > 1 and stack[-1][0] in CLOSES.get(name, ()):
            stack.pop()
        if not tag.endswith("/>"):
            opened += 1
            stack.append((name, (*stack[-1][1], name, *("." + t for t in _marks(tag))), (*stack[-1][2], opened)))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


@lru_cache(200_000)
def _slot(token: str, size: int) -> tuple[int, float]:
    h = zlib.crc32(token.encode("utf-8", "surrogatepass"))
    return h % size, 1.0 if h >> 20 & 1 else -1.0


@lru_cache(20_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH, dtype=np.float32)
    for depth, token in enumerate(reversed(path)):
        k, sign = _slot(token, PATH)
        v[k] += sign * (1.0 if depth < 4 else 0.7)
    return v


def _apart(one: Block, other: Block) -> tuple[float, float, float]:
    """How near two blocks are in the tree of elements: up from one and down to the other (1 is none, less the further), and whether their paths are equal."""
    common = 0
    for a, b in zip(one.nest, other.nest, strict=False):
        if a != b:
            break
        common += 1
    return 1 / (1 + len(one.nest) - common), 1 / (1 + len(other.nest) - common), float(one.path == other.path)


def features(page: list[Block]) -> np.ndarray:
    """One row per block: its path, its words, measures of its text, and how far in the tree the blocks before and after it are."""
    x = np.zeros((len(page), PATH + WORDS + EXTRA), dtype=np.float32)
    total = sum(len(b.text) for b in page) or 1
    for i, b in enumerate(page):
        words = _WORD.findall(b.text.lower())
        x[i, :PATH] = _path_vector(b.path)
        for w in words:
            k, sign = _slot(w, WORDS)
            x[i, PATH + k] += sign
        x[i, PATH : PATH + WORDS] /= max(1.0, len(words) ** 0.5, len(words) / 40**0.5)  # of long blocks the mean, so that length adds nothing
        n = len(b.text)
        x[i, PATH + WORDS : PATH + WORDS + 8] = (np.log1p(n) / 6, min(1.0, b.linked / n), b.text.count(".") / max(1, len(words)), n / total, i / len(page), b.text[-1] in ".!?:;\"'", min(1.0, len(words) / 40), 1)
        if i:
            x[i, -6:-3] = _apart(b, page[i - 1])
        if i + 1 < len(page):
            x[i, -3:] = _apart(b, page[i + 1])
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Net:
    """Weights of both directions: input, recurrent, bias (gates in, forget, out, candidate); and of the output."""

    wx: list[np.ndarray]
    wh: list[np.ndarray]
    b: list[np.ndarray]
    out: np.ndarray
    direct: np.ndarray
    bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [*self.wx, *self.wh, *self.b, self.out, self.direct, self.bias]


def _new(seed: int) -> Net:
    rng = np.random.default_rng(seed)
    size = PATH + WORDS + EXTRA
    make = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    bias = np.zeros(4 * HIDDEN, dtype=np.float32)
    bias[HIDDEN : 2 * HIDDEN] = 1
    return Net([make(size, 4 * HIDDEN) for _ in range(2)], [make(HIDDEN, 4 * HIDDEN) for _ in range(2)], [bias.copy(), bias.copy()], make(2 * HIDDEN, 1), np.zeros((size, 1), dtype=np.float32), np.zeros(1, dtype=np.float32))


def _pass(x: np.ndarray, live: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: bool):
    """One direction over x (steps, pages, size); states stand still where a page has ended (live is 0)."""
    steps, pages = x.shape[:2]
    h = c = np.zeros((pages, HIDDEN), dtype=np.float32)
    z = x @ wx + b
    hs, saved = np.zeros((steps, pages, HIDDEN), dtype=np.float32), []
    for t in range(steps):
        g = z[t] + h @ wh
        s = _sigmoid(g[:, : 3 * HIDDEN])
        i, f, o, u = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
        on = live[t][:, None]
        new_c = np.where(on, f * c + i * u, c)
        tc = np.tanh(new_c)
        new_h = np.where(on, o * tc, h)
        if keep:
            saved.append((h, c, i, f, o, u, tc, on))
        h, c = new_h, new_c
        hs[t] = h
    return hs, saved


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), PATH + WORDS + EXTRA), dtype=np.float32)
    live = np.zeros((steps, len(pages)), dtype=bool)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
        live[: len(p), k] = True
    return x, live


def logits(net: Net, pages: list[np.ndarray], keep: bool = False):
    x, live = _padded(pages)
    ahead, sa = _pass(x, live, net.wx[0], net.wh[0], net.b[0], keep)
    back, sb = _pass(x[::-1], live[::-1], net.wx[1], net.wh[1], net.b[1], keep)
    h = np.concatenate((ahead, back[::-1]), axis=2)
    y = (h @ net.out + x @ net.direct + net.bias)[:, :, 0]
    return y, (x, live, h, sa, sb)


def _gradient(net: Net, pages: list[np.ndarray], labels: list[np.ndarray]) -> list[np.ndarray]:
    y, (x, live, h, sa, sb) = logits(net, pages, True)
    target = np.zeros_like(y)
    for k, own in enumerate(labels):
        target[: len(own), k] = own
    d = ((_sigmoid(y) - target) * live / live.sum()).astype(np.float32)[:, :, None]
    over = lambda a, b: a.reshape(-1, a.shape[2]).T @ b.reshape(-1, b.shape[2])
    grads = {"out": over(h, d), "direct": over(x, d), "bias": d.sum(axis=(0, 1))}
    dh_all = d @ net.out.T
    sides = []
    for k, (saved, xs) in enumerate(((sa, x), (sb, x[::-1]))):
        own = dh_all[:, :, :HIDDEN] if k == 0 else dh_all[::-1, :, HIDDEN:]
        dh = dc = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
        dz = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=np.float32)
        dwh = np.zeros_like(net.wh[k])
        for t in range(len(xs) - 1, -1, -1):
            h0, c0, i, f, o, u, tc, on = saved[t]
            g = dh + own[t]
            do, dct = g * tc * on, (dc + g * o * (1 - tc * tc)) * on
            step = np.concatenate((dct * u * i * (1 - i), dct * c0 * f * (1 - f), do * o * (1 - o), dct * i * (1 - u * u)), axis=1)
            dz[t] = step
            dwh += h0.T @ step
            dh = step @ net.wh[k].T + np.where(on, 0, g)
            dc = np.where(on, dct * f, dc)
        sides.append((over(xs, dz), dwh, dz.sum(axis=(0, 1))))
    return [sides[0][0], sides[1][0], sides[0][1], sides[1][1], sides[0][2], sides[1][2], grads["out"], grads["direct"], grads["bias"]]


# What the grammar of pages draws from: names that layouts commonly give their parts.
_ASIDE = {
    "nav": ["nav", "div.menu", "ul.nav", "div.navbar", "div#navigation", "div.breadcrumb", "ul.pagination", "div.topbar", "header nav", "div.links", "div.toc"],
    "header": ["header", "div.header", "div#masthead", "div.banner", "div.logo", "header.site-header", "div.tagline"],
    "footer": ["footer", "footer", "footer p", "div.footer", "div#footer", "footer.site-footer", "div.copyright", "div.legal", "div.colophon"],
    "side": ["aside", "div.sidebar", "div#sidebar", "aside.widget", "div.related", "section.related-posts", "div.recommended", "div.popular", "div.trending", "div.tags", "div.author-bio", "div.meta", "div.read-more", "section.more"],
    "ad": ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "aside.promo", "div.banner-ad", "div.ad-slot", "section.sponsor", "div.promotion", "ins.adsbygoogle"],
    "notice": ["div.cookie", "div#cookie-notice", "div.consent", "div.notice", "div.alert", "div.newsletter", "div.subscribe", "div.popup", "div.modal", "p.disclaimer", "div.gdpr", "div.paywall", "div.warning"],
    "form": ["form", "form.search", "form#login", "div.search form", "form.contact", "form.signup", "div.login", "fieldset"],
    "share": ["div.share", "ul.social", "div.share-buttons", "div.social-links", "div.toolbar", "div.buttons"],
    "comment": ["div.comments", "section#comments", "div.comment", "ol.comment-list", "div#disqus", "section.reader-comments", "div.replies", "div.responses", "section.discussion", "div.reviews"],
}
_MAIN = ["article", "article", "article", "main", "main", "main article", "div.content", "div#content", "div.post", "div.entry-content", "div.article-body", "section.story", "div.post-content article", "div#main", "div.main-content", "article.post", "div.text", "article div.body", "div", "section"]
_SAYINGS = {
    "nav": "Home News Sport About Contact Help Login Archive World Politics Business Next Previous Menu Topics",
    "header": "The Daily News Site Welcome Blog Magazine Your source for",
    "footer": "© Copyright 2024 All rights reserved · Terms Privacy Policy Imprint Contact",
    "side": "Related articles Popular posts Recommended for you Tags Read more Latest by the author",
    "ad": "Advertisement Sponsored Buy now Sale Offer Discount Free shipping Shop",
    "notice": "We use cookies to improve this site. Accept Decline Subscribe to our newsletter Sign up Notice",
    "form": "Search Email Password Name Submit Send Log in Register Your message",
    "share": "Share on Tweet Email Print Like Follow us",
    "comment": "says: I agree with this. Reply Report Great article thanks Comments user ago Leave a comment",
}


#: What lines of an article say that are about the text, not part of its story.
_LINES = "This work is licensed under the License, version Released in the public domain Copyright by the author Permission granted to copy Reprinted from Source Published Contact Email Note".split()


class _Grammar:
    """Pages as (html, wanted): wanted is the blocks of the article in order."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        syllables = [a + b for a in "b c d f g l m n p r s t v th sh ".split(" ") for b in "a e i o u an er in on es ä é".split()]
        self.syllables = syllables
        self.invent()

    def invent(self) -> None:
        """New words: the network can't learn an article by its own words, only asides by what they often say."""
        self.words = ["".join(self.r.choices(self.syllables, k=self.r.randint(1, 4))) for _ in range(self.r.choice([5, 60, 250]))]

    def say(self, n: int, kind: str = "") -> str:
        own = _SAYINGS.get(kind, "").split()
        words = [self.r.choice(own) if own and self.r.random() < 0.45 else self.r.choice(self.words) for _ in range(max(1, n))]
        text, every = "", self.r.randint(6, 18)
        for i, w in enumerate(words):
            text += ("" if not i else ". " if i % every == 0 else ", " if self.r.random() < 0.05 else " ") + (w.capitalize() if i % every == 0 else w)
        return text + (self.r.choice([".", ".", "!", "?"]) if n > 6 else "")

    def tag(self, spec: str, inner: str) -> str:
        for part in reversed(spec.split()):
            m = re.match(r"(\w+)(?:([.#])([\w-]+))?", part)
            noise = self.r.choice(["", "", "", f' data-x="{self.r.random():.3f}"', ' style="margin:0"'])
            mark = f' {"class" if m[2] == "." else "id"}="{m[3]}"' if m[2] else ""
            if mark and m[2] == "." and self.r.random() < 0.3:
                mark = mark[:-1] + " " + self.r.choice(self.words) + '"'
            elif not mark and self.r.random() < 0.15:
                mark = f' class="{self.r.choice(self.words)} {self.r.choice(["wrap", "row", "col", "box", "inner", "container", "section"])}"'
            inner = f"<{m[1]}{mark}{noise}>{inner}</{m[1]}>"
        return inner

    def link(self, text: str) -> str:
        return f'<a href="/{self.r.randint(0, 999)}">{text}</a>'

    def aside(self, kind: str, inside: bool = False) -> str:
        r, spec = self.r, self.r.choice(_ASIDE[kind])
        if kind in ("nav", "share") or (kind in ("side", "footer") and r.random() < 0.5):
            item = lambda: self.link(self.say(r.randint(1, 7), kind))
            inner = "<ul>" + "".join(f"<li>{item()}</li>" for _ in range(r.randint(2, 9))) + "</ul>" if r.random() < 0.7 else " ".join(item() for _ in range(r.randint(2, 7)))
            inner = (f"<h3>{self.say(2, kind)}</h3>" if r.random() < 0.3 else "") + inner
        elif kind == "form":
            inner = "".join(f"<label>{self.say(2, kind)}</label><input name=x>" + ("<br>" if r.random() < 0.5 else "") for _ in range(r.randint(1, 4))) + f"<button>{self.say(1, kind)}</button>"
            inner = (f"<p>{self.say(r.randint(3, 15), kind)}</p>" if r.random() < 0.4 else "") + inner
        elif kind == "comment":
            inner = (f"<h3>{self.say(2, kind)}</h3>" if r.random() < 0.6 else "") + "".join(self.tag(r.choice(["div", "li", "div.comment", "article", "p"]), f"<p>{self.say(r.randint(3, 60) if r.random() < 0.98 else r.randint(100, 600), kind)}</p>" + (f"<span>{self.say(2, kind)}</span>" if r.random() < 0.4 else "")) for _ in range(r.randint(1, 6)))
        else:
            body = self.say(r.randint(1, 45), kind)
            if kind == "footer" and r.random() < 0.5:
                body = f"{r.choice(['&copy;', '&copy;', 'Copyright', '&reg;'])} {r.choice(self.words)}.{r.choice(self.words)}.{r.choice(['com', 'org', 'net', 'de'])} {r.choice(['&middot;', '|', '-', '&bull;'])} {body}"
            inner = r.choice([body, f"<p>{body}</p>", f"<p>{body}</p><p>{self.say(r.randint(3, 30), kind)}</p>", f"<h4>{self.say(3, kind)}</h4><p>{body}</p>", f"<span>{body}</span> {self.link(self.say(2, kind))}"])
        return self.tag(spec, inner)

    def odd(self) -> str:
        """A paragraph that an article may hold though it reads like no story: a notice, one word many times, words with symbols, a row of a table."""
        r = self.r
        n = int(r.choice([2, 6, 15, 40, 120]) * r.uniform(0.5, 1.5)) + 1
        form = r.randrange(5)
        if form == 0:
            return " ".join(r.choice(_LINES) if r.random() < 0.7 else r.choice(self.words) for _ in range(r.randint(3, 16))) + r.choice([".", "", ", version 2."])
        if form == 1:
            return " ".join([r.choice(self.words) + r.choice(["", ","])] * n).capitalize()
        if form == 2:
            marks = r.sample(["&amp;&amp;", "%%", "$$", "##", "**", "??", "~~", "==", "@@", ".", ""], 4)
            return " ".join(r.choice(self.words) + r.choice(marks) for _ in range(n)).capitalize()
        if form == 3:
            return " | ".join(r.choice(self.words) for _ in range(n)).capitalize() + r.choice(["", " |"])
        return "".join(r.choice(self.words) for _ in range(r.randint(1, 4))) if r.random() < 0.5 else " ".join(str(r.randint(0, 10**r.randint(1, 8))) for _ in range(n))

    def article(self) -> list[str]:
        r, out = self.r, []
        odd = r.random() < 0.5
        if r.random() < 0.8:
            out.append(f"<h1>{self.say(r.randint(3, 12))}</h1>")
        for _ in range(int(r.choice([1, 2, 4, 8, 14]) * r.uniform(0.7, 1.5)) + 1):
            body = self.say(r.choice([1, 3, 8, 25, 60, 120]) if r.random() < 0.98 else r.randint(200, 2500))
            if body[-1] not in ".!?" and r.random() < 0.6:
                body += "."  # a short sentence, or what is left of one
            if odd and r.random() < 0.4:
                body = self.odd()
            if r.random() < 0.3:
                cut = body.split(" ")
                k = r.randrange(len(cut))
                cut[k] = r.choice([f"<b>{cut[k]}</b>", self.link(cut[k]), f"<em>{cut[k]}</em>", f"{cut[k]}<br>"])
                body = " ".join(cut)
            end = "" if r.random() < 0.15 else "</p>"
            out.append(r.choice([f"<p>{body}{end}"] * 9 + [f"<h2>{self.say(r.randint(1, 8))}</h2>", f"<h3>{self.say(r.randint(1, 8))}</h3>", f"<blockquote><p>{body}</p></blockquote>", f"<ul><li>{self.say(r.randint(1, 20))}</li><li>{body}</li></ul>", f"<div>{body}</div>", f"<pre>{body}</pre>", f"<table><tr><td>{self.say(2)}</td><td>{self.say(3)}</td></tr></table>", f"<figure><figcaption>{self.say(6)}</figcaption></figure>"]))
        if odd and r.random() < 0.6:
            out.append(f"<p>{self.odd()}</p>")
        return out

    def page(self) -> tuple[list[Block], np.ndarray]:
        r = self.r
        self.invent()
        # The article's pieces are marked by a character that texts don't have, and the mark is taken off the blocks again.
        pieces = [re.sub(r">([^<>]+)", lambda m: ">\x01" + m[1], p) for p in self.article()]
        inside = [self.aside(r.choice(["ad", "share", "side", "notice", "comment", "form", "nav"])) for _ in range(r.choice([0, 0, 0, 1, 2]))]
        for a in inside:
            pieces.insert(r.randint(1, len(pieces)), a)
        if r.random() < 0.25:
            pieces.append(self.aside("comment"))
        main = self.tag(r.choice(_MAIN), "".join(pieces))
        before = [self.aside(k) for k in ("notice", "header", "nav", "ad", "form", "side") if r.random() < 0.45]
        after = [self.aside(k) for k in ("share", "comment", "side", "ad", "form", "nav", "notice") if r.random() < 0.35] + [self.aside("footer")] * (r.random() < 0.8)
        r.shuffle(before)
        body = "".join([*before, self.tag(r.choice(["div", "div.wrap", "div.container", "div#page"]), main) if r.random() < 0.4 else main, *after])
        found = blocks(f"<html><head><title>x</title></head><body>{body}</body></html>")
        wanted = np.array(["\x01" in b.text for b in found])
        return [Block(b.path, " ".join(b.text.replace("\x01", "").split()) or "x", b.linked, b.nest) for b in found], wanted


@lru_cache(2)
def fit(pages: int = 2500, rounds: int = 8, seed: int = 11, rate: float = 0.01) -> Net:
    """The weights, by Adam on `pages` pages of the grammar."""
    grammar = _Grammar(seed)
    made = [grammar.page() for _ in range(pages)]
    made = sorted(((features(b), y) for b, y in made if b), key=lambda m: len(m[1]))
    net, rng = _new(seed), np.random.default_rng(seed)
    params = net.params()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, batches = 0, [made[at : at + 32] for at in range(0, len(made), 32)]
    for k in range(rounds):
        for i in rng.permutation(len(batches)):
            step += 1
            grads = _gradient(net, [x for x, _ in batches[i]], [y for _, y in batches[i]])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            for p, g, m, s in zip(params, grads, first, second, strict=True):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (0.3 if k >= rounds - 2 else 1) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def main_texts(net: Net, pages: list[str], threshold: float = 0.5, most: int = 20_000) -> list[str]:
    """The article of each page: its blocks in order, joined by line feeds. Pages go through the network in batches of at most `most` steps, or alone."""
    found = [blocks(p) for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i, b in enumerate(found) if b), key=lambda i: len(found[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(found[order[end]]) * (end + 1 - at) <= most:
            end += 1
        own = order[at:end]
        y, _ = logits(net, [features(found[i]) for i in own])
        for k, i in enumerate(own):
            out[i] = "\n".join(b.text for b, s in zip(found[i], y[:, k], strict=False) if s > np.log(threshold / (1 - threshold)))
        at = end
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", net: Net | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages: the article's text, '' if there is none, and its code points.

    A null or empty html has no text; markup that ends early is read as far as it goes. Repeated rows and null ids and urls stay.
    Other columns aren't read.
    """
    kinds = dict(pages.dtypes)
    net = net or fit()

    def run(_, cols, texts):
        got = main_texts(net, texts)
        return {"page_id": cols["page_id"], "url": cols["url"], "text": got, "n_chars": [len(t) for t in got]}

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("text"))
    return map_texts(rows, run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
