"""Operator 4: main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into its leaf blocks: the runs of text between the starts and ends of block-level elements, each with
the elements around it. Markup, comments, scripts, styles, templates and the page's head never become blocks; a head
without end tag ends at the first text or element that cannot be in it. The text of formulas (annotations included)
stays where it is. Each block has features of its ancestors (tags, words of their classes and ids, roles, hidden ones) and of its text (length,
share of link text, end, signs, and its words, each by its share of the block's, so that a word weighs much in a short
notice and little in a long paragraph). ``fit`` trains the weights of the features and of the
transitions on labelled pages by conditional likelihood; ``extract`` decodes every page by Viterbi and joins the
blocks that are content.

No table has labelled pages, so ``training_pages`` makes them: layouts of many kinds, with invented words, in which it
is known what is the article. ``fit`` takes any other labelled pages as well. The model is a few hundred weights.

Character references are decoded, white space (as str.split sees it, <br> included) inside a block becomes one space,
blocks are trimmed and joined in page order by one line feed; a block without characters is none. A null or empty page,
and one without content, gives the empty text. Unclosed and wrongly nested tags are read as browsers do in the common
cases; what follows an unclosed comment, script or tag is part of it. Repeated rows are extracted each. Other columns pass
through; columns named like the outputs are replaced. An empty table gives an empty result. Pages of any length are read
whole, forward and once, so time grows with their length. Of two labellings of a page that are as likely, the one with
fewer blocks of content is taken.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktrail.llm.common import free_name, table

#: Elements whose content is no text of the page.
_RAW = frozenset("script style noscript template svg iframe object canvas video audio textarea select title".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_VALUE_OR_END = re.compile(r"=\s*+([\"'])|>")
_RAW_END = {tag: re.compile(rf"</{tag}\s*+>", re.IGNORECASE) for tag in _RAW}
#: Elements that may stand in one another, as in browsers; deeper ones count as siblings.
_DEPTH = 512


@dataclass(frozen=True)
class _Token:
    """A piece of markup from ``start`` to ``end``: a tag, or (without ``tag``) what is passed over, such as a comment."""

    start: int
    end: int
    tag: str = ""
    closing: bool = False
    attributes: str = ""
    raw: str = ""


def _tokens(page: str) -> Iterator[_Token]:
    """The markup of a page, read forward once.

    A quote opens a value after an equals sign only; a value whose quote is never closed ends with its tag. A tag that is
    never closed reaches to the end of the page, and so does a comment.
    """
    at, n = 0, len(page)
    last = {q: page.rfind(q) for q in "\"'>"}
    while (i := page.find("<", at)) >= 0:
        at = i + 1
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = n if end < 0 else end + 3
            yield _Token(i, at)
            continue
        if page.startswith(("<!", "<?"), i):
            if last[">"] > i:
                at = page.find(">", i) + 1
                yield _Token(i, at)
            continue
        closing = page.startswith("</", i)
        name = _NAME.match(page, i + 1 + closing)
        if not name:
            continue
        pos = name.end()
        while (m := _VALUE_OR_END.search(page, pos)) and m.group() != ">":
            quote = m.group(1)
            pos = page.find(quote, m.end()) + 1 if last[quote] >= m.end() else m.end()
        at = end = m.end() if m else n
        if not m:
            yield _Token(i, n)
            continue
        tag, attributes = name.group().lower(), page[name.end() : end - 1]
        if tag in _RAW and not closing:
            if not (tag == "svg" and attributes.endswith("/")):
                ends = _RAW_END[tag].search(page, end)
                at = ends.end() if ends else n
            yield _Token(i, at, raw=tag)
        else:
            yield _Token(i, end, tag, closing, attributes)


_ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that leave a head open whose end tag is left out.
_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag closes the innermost of these elements, if none of the second kind is in between.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
_SCOPE = frozenset({"button", "table", "td", "th", "caption", "html"})
_KEEPS_P = frozenset({"button", "label", "option", "legend", "summary", "body", "html", "head", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"})
_WORD = re.compile(r"[a-z]+")


def _attribute_features(tag: str, attributes: str) -> tuple[str, ...]:
    found = [f"in:{tag}"]
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            found += [f"of:{w}" for w in _WORD.findall(value)]
        elif name == "role":
            found.append(f"role:{value}")
        elif name == "hidden" or name == "aria-hidden" and value == "true" or "display:none" in value.replace(" ", ""):
            found.append("hidden")
    return tuple(found)


@lru_cache(maxsize=4096)
def _around(tag: str, attributes: str) -> tuple[str, ...]:
    return _attribute_features(tag, attributes)


def blocks(page: str | None) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, features of the elements around it, characters of it in links) of each leaf block of a page."""
    if not page:
        return []
    out: list[tuple[str, tuple[str, ...], int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    pieces: list[str] = []
    state = [0, 0]  # open links, characters in links
    in_head = False

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                features: list[str] = []
                own = ""
                for tag, found in stack:
                    features += found
                    if tag in _BLOCK:
                        own = tag
                out.append((text, tuple(dict.fromkeys([*features, f"is:{own}"])), min(state[1], len(text))))
            pieces.clear()
        state[1] = 0

    def close(at: int) -> None:
        for tag, _ in stack[at:]:
            if tag == "a":
                state[0] -= 1
        del stack[at:]

    def innermost(tags: Iterable[str], barriers: Iterable[str]) -> int:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in barriers:
                return -1
        return -1

    def leave_head() -> None:
        if (i := innermost(("head",), ())) >= 0:
            close(i)

    at = 0
    for m in _tokens(page):
        if in_head and (page[at : m.start].strip() or (m.raw or "html") not in _HEAD or m.tag and not m.closing and m.tag not in _HEAD):
            in_head = False
            leave_head()
        if m.start > at and not in_head:
            text = page[at : m.start]
            pieces.append(text)
            if state[0] > 0:
                state[1] += len(text)
        at = m.end
        tag = m.tag
        if not tag:
            continue
        if m.closing:
            if tag in _BLOCK:
                flush()
            if tag == "head":
                in_head = False
            i = innermost((tag,), ())
            if i >= 0 and (tag in _BLOCK or not any(t in _BLOCK for t, _ in stack[i:])):
                close(i)
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in _BLOCK:
            flush()
            if tag == "body":
                in_head = False
            elif tag == "head":
                in_head = True
            if tag not in _KEEPS_P and (i := innermost(("p",), _SCOPE)) >= 0:
                close(i)
            if tag in _CLOSES and (i := innermost(*_CLOSES[tag])) >= 0:
                close(i)
        if tag not in _VOID and not m.attributes.endswith("/") and len(stack) < _DEPTH:
            stack.append((tag, _around(tag, m.attributes) if len(m.attributes) < 400 else _attribute_features(tag, m.attributes)))
            if tag == "a":
                state[0] += 1
    if at < len(page) and (not in_head or page[at:].strip()):
        if in_head:
            leave_head()
        pieces.append(page[at:])
    flush()
    return out


def features(page: list[tuple[str, tuple[str, ...], int]]) -> list[dict[str, float]]:
    """The features of each block and their values."""
    found = []
    for i, (text, around, linked) in enumerate(page):
        n = text.count(" ") + 1
        share = linked / len(text)
        own = [*around, "words:" + ("1" if n == 1 else "2-4" if n < 5 else "5-11" if n < 12 else "12-29" if n < 30 else "30+")]
        own.append("linked:" + ("none" if share == 0 else "part" if share < 0.5 else "most"))
        own.append("stop" if text[-1] in ".!?…。" else "no stop")
        if "©" in text:
            own.append("copyright")
        if "|" in text or "»" in text or "·" in text:
            own.append("separator")
        if i == 0:
            own.append("first")
        if i == len(page) - 1:
            own.append("last")
        values = dict.fromkeys(own, 1.0)
        words = _WORD.findall(text.lower())
        for word in words:
            values[f"word:{word}"] = values.get(f"word:{word}", 0.0) + 1 / len(words)
        found.append(values)
    return found


@dataclass(frozen=True)
class PageModel:
    """Weights of the two labels (0 other, 1 content): by feature, for the first block, and of transitions."""

    weights: dict[str, float]  # for content, against other
    start: float
    transitions: tuple[tuple[float, float], tuple[float, float]]


def fit(pages: Iterable[tuple[str, list[str]]], rounds: int = 200, ridge: float = 0.003, least: int = 3, least_word: int = 40) -> PageModel:
    """Train on pages (HTML, texts of the blocks that are content) by the gradient of the conditional likelihood.

    Features in fewer than ``least`` blocks, and words in fewer than ``least_word``, are not learned.
    """
    read = [(blocks(page), set(content)) for page, content in pages]
    read = [(b, c) for b, c in read if b]
    named = [features(b) for b, _ in read]
    counts: dict[str, int] = {}
    for page in named:
        for block in page:
            for f in block:
                counts[f] = counts.get(f, 0) + 1
    names = sorted(f for f, n in counts.items() if n >= (least_word if f.startswith("word:") else least))
    number = {f: i for i, f in enumerate(names)}
    longest = max((len(p) for p in named), default=1)
    # the features of all blocks in one list (the last one is of every block), with the places of the blocks
    y, there = np.zeros((longest, len(named)), int), np.zeros((longest, len(named)), bool)
    held, values, at, sizes = [], [], [], []
    for j, (page, (found, content)) in enumerate(zip(named, read, strict=True)):
        for t, block in enumerate(page):
            own = [number[f] for f in block if f in number] + [len(names)]
            held += own
            values += [v for f, v in block.items() if f in number] + [1.0]
            at.append((t, j))
            sizes.append(len(own))
            y[t, j], there[t, j] = found[t][0] in content, True
    feature, value, rows, cols = np.array(held, int), np.array(values), *np.array(at, int).reshape(-1, 2).T
    first = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(int)
    w, start, trans = np.zeros(len(names) + 1), 0.0, np.zeros((2, 2))
    mean, square = np.zeros(len(w) + 5), np.zeros(len(w) + 5)
    pages_n = np.arange(len(named))
    for k in range(1, rounds + 1):
        emit = np.zeros((longest, len(named), 2))
        if len(first):
            emit[rows, cols, 1] = np.add.reduceat(w[feature] * value, first)
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[0] = emit[0] + np.array([0.0, start])
        for t in range(1, longest):
            step = np.logaddexp(forward[t - 1][:, :1] + trans[0], forward[t - 1][:, 1:] + trans[1]) + emit[t]
            forward[t] = np.where(there[t][:, None], step, forward[t - 1])
        for t in range(longest - 2, -1, -1):
            ahead = backward[t + 1] + emit[t + 1]
            step = np.logaddexp(trans[:, 0] + ahead[:, :1], trans[:, 1] + ahead[:, 1:])
            backward[t] = np.where(there[t + 1][:, None], step, 0)
        total = np.logaddexp(forward[-1][:, 0], forward[-1][:, 1])
        p1 = np.exp(np.minimum(forward[:, :, 1] + backward[:, :, 1] - total, 0)) * there
        slope_w = np.bincount(feature, weights=np.repeat((y - p1)[rows, cols], sizes) * value, minlength=len(w))
        slope_start = float((y[0] - p1[0]).sum())
        slope_trans = np.zeros((2, 2))
        for t in range(1, longest):
            both = there[t]
            joint = forward[t - 1][:, :, None] + trans + (emit[t] + backward[t])[:, None, :] - total[:, None, None]
            slope_trans -= (np.exp(np.minimum(joint, 0)) * both[:, None, None]).sum(0)
            np.add.at(slope_trans, (y[t - 1][both], y[t][both]), 1)
        slope = np.concatenate((slope_w - ridge * len(pages_n) * w / 10, [slope_start], slope_trans.ravel())) / len(pages_n)
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        move = 0.1 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
        w, start, trans = w + move[: len(w)], start + float(move[len(w)]), trans + move[len(w) + 1 :].reshape(2, 2)
    weights = {f: float(v) for f, v in zip([*names, ""], w, strict=True)}
    return PageModel(weights, start, ((float(trans[0, 0]), float(trans[0, 1])), (float(trans[1, 0]), float(trans[1, 1]))))


def labels(model: PageModel, named: list[dict[str, float]]) -> list[int]:
    """The most likely labels of a page's blocks, by Viterbi."""
    if not named:
        return []
    (t00, t01), (t10, t11) = model.transitions
    get, base = model.weights.get, model.weights.get("", 0.0)
    zero, one, back = 0.0, 0.0, []
    for i, block in enumerate(named):
        emit = base + sum(get(f, 0.0) * v for f, v in block.items())
        if i == 0:
            one = emit + model.start
            continue
        back.append((0 if zero + t00 >= one + t10 else 1, 0 if zero + t01 >= one + t11 else 1))
        zero, one = max(zero + t00, one + t10), max(zero + t01, one + t11) + emit
    out = [1 if one > zero else 0]
    for before in reversed(back):
        out.append(before[out[-1]])
    return out[::-1]


def main_text(model: PageModel, page: str | None) -> str:
    """The content of one page."""
    found = blocks(page)
    return "\n".join(b[0] for b, keep in zip(found, labels(model, features(found)), strict=True) if keep)


_OUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame, model: PageModel, page: str = "html") -> DataFrame:
    """``pages`` with text and n_chars (code points) added."""

    @F.pandas_udf(_OUT)
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [main_text(model, p) for p in batch]
            yield pd.DataFrame({"text": found, "n_chars": [len(t) for t in found]})

    told = free_name(pages, "told")
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in _OUT.names]
    return pages.withColumn(told, texts(F.col(f"`{page}`"))).select(*kept, f"{told}.*")


#: Words that notices and controls of the invented pages use, and articles now and then.
_NOTICE_WORDS = "cookie cookies privacy copyright rights reserved subscribe newsletter share follow login register comment comments reply advertisement sponsored related menu home search".split()


class _Maker:
    """Invented labelled pages."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choice("abcdefghijklmnoprstuvwé") for _ in range(r.randint(1, 9))) for _ in range(r.randint(low, high)))

    def sentence(self, low: int = 2, high: int = 25) -> str:
        text = self.words(low, high).capitalize()
        return text + self.r.choice([".", ".", ".", ".", "!", "?", ""])

    def prose(self) -> str:
        said = [self.sentence() for _ in range(self.r.choice([1, 1, 2, 3, 5, 9]))]
        if self.r.random() < 0.2:  # articles speak of such things too, and hold signs
            odd = ["All rights reserved.", "Share this.", f"Read the {self.r.choice(_NOTICE_WORDS)} {self.r.choice(_NOTICE_WORDS)}.", f"{self.words(1, 2)} | {self.words(1, 2)} | {self.words(1, 2)}", "© 2020.", f"{self.words(1, 1)} · {self.words(1, 3)}"]
            said.insert(self.r.randint(0, len(said)), self.r.choice(odd))
        return " ".join(said)

    def named(self, tag: str, *names: str) -> str:
        """A start tag with one of the names in its class or id, alone or with others."""
        name = self.r.choice(names)
        name = self.r.choice([name, name, f"{name}-{self.r.choice(['box', 'wrap', 'inner', 'block', 'area'])}", f"site-{name}", f"{name} {self.words(1, 1)}"])
        return f'<{tag} {self.r.choice(["class", "class", "id"])}="{name}">'

    def links(self, low: int = 2, high: int = 7) -> str:
        n = self.r.randint(low, high)
        if self.r.random() < 0.6:
            return "<ul>" + "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(n)) + "</ul>"
        return " | ".join(f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(n))

    def menu(self) -> str:
        tag = self.r.choice(["nav", "nav", "div", "ul"])
        start = self.r.choice(["<nav>", '<nav role="navigation">', self.named("nav", "nav", "menu")]) if tag == "nav" else self.named(tag, "nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topnav", "pagination")
        return f"{start}{self.links()}</{tag}>"

    def header(self) -> str:
        start, end = self.r.choice([("<header>", "</header>"), (self.named("header", "header", "masthead"), "</header>"), (self.named("div", "header", "masthead", "topbar", "branding"), "</div>")])
        inside = self.r.choice([f"<h1>{self.words(1, 4)}</h1>", f"<div>{self.words(1, 3)}</div><p>{self.sentence()}</p>", f'<a href="/">{self.words(1, 2)}</a>', f"<p>{self.sentence()}</p>"])
        return f"{start}{inside}{self.menu() if self.r.random() < 0.4 else ''}{end}"

    def footer(self) -> str:
        start, end = self.r.choice([("<footer>", "</footer>"), ("<footer>", "</footer>"), (self.named("div", "footer", "bottom", "copyright", "colophon"), "</div>")])
        inside = self.r.choice([f"&copy; {self.words(1, 2)} &middot; {self.prose()}", f"<p>&copy; 2020 {self.words(1, 4)}. All rights reserved.</p>", f"<p>{self.prose()}</p>", self.links(), f"<div>{self.words(1, 5)}</div><p>{self.sentence()}</p>"])
        return f"{start}{inside}{end}"

    def heading(self) -> str:
        tag = self.r.choice(["h2", "h3", "h3", "h4"])
        return f"<{tag}>{self.words(1, 4)}</{tag}>"

    def text_in(self) -> str:
        return self.r.choice([self.prose(), f"<p>{self.prose()}</p>", f"{self.heading()}<p>{self.prose()}</p>", f"{self.heading()}{self.links()}", f"<p>{self.sentence()}</p><p>{self.prose()}</p>"])

    def container(self, *names: str) -> tuple[str, str]:
        tag = self.r.choice(["div", "div", "div", "section", "aside"])
        return self.named(tag, *names), f"</{tag}>"

    def aside(self) -> str:
        start, end = self.r.choice([("<aside>", "</aside>"), (self.named("aside", "sidebar", "related"), "</aside>"), self.container("sidebar", "widget", "related", "recommended", "trending", "popular")])
        return start + self.text_in() + end

    def advert(self) -> str:
        start, end = self.container("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "sponsor")
        return f"{start}{self.text_in()}{end}"

    def notice(self) -> str:
        start = self.r.choice([self.named("div", "cookie", "cookies", "consent", "notice", "gdpr", "alert", "popup", "modal", "newsletter", "paywall", "disclaimer"), '<div role="dialog">', '<div role="alert">', "<dialog>"])
        cue = self.r.choice(["", "", "This site uses cookies. ", "Privacy notice. "])
        end = "</dialog>" if start == "<dialog>" else "</div>"
        return f"{start}{cue}{self.text_in()}{'<button>OK</button>' if self.r.random() < 0.5 else ''}{end}"

    def form(self) -> str:
        start = self.r.choice(["<form>", "<form action='/s'>", self.named("form", "search", "login", "subscribe", "signup", "contact")])
        return f"{start}<label>{self.words(1, 3)}</label><input name=q>{f'<p>{self.sentence()}</p>' if self.r.random() < 0.5 else ''}<button>{self.words(1, 2)}</button></form>"

    def comments(self) -> str:
        tag = self.r.choice(["div", "section", "ol"])
        start = self.named(tag, "comments", "comment", "discussion", "responses", "replies", "disqus")
        inner = self.r.choice(['<div class="comment">', '<div class="reply">', "<div>", '<article class="comment">', "<li>"])
        end = "</article>" if "article" in inner else "</li>" if inner == "<li>" else "</div>"
        head = self.heading() if self.r.random() < 0.6 else ""
        return start + head + "".join(f"{inner}{f'<b>{self.words(1, 2)}</b>' if self.r.random() < 0.5 else ''}<p>{self.prose()}</p>{end}" for _ in range(self.r.randint(1, 5))) + f"</{tag}>"

    def share(self) -> str:
        return f"{self.named('div', 'share', 'social', 'tags', 'toolbar')}{self.links(2, 4)}</div>"

    def page(self) -> tuple[str, list[str]]:
        """One page, and the texts of its content blocks."""
        r, kept, body = self.r, [], []

        def keep(start: str, text: str, end: str) -> str:
            kept.append(" ".join(html.unescape(re.sub(r"<[^>]*>", "", text)).split()))
            return start + text + end

        inner = []
        if r.random() < 0.8:
            title = keep("<h1>", self.words(2, 9).capitalize() + r.choice(["", "."]), "</h1>")
            inner.append(f"<header>{title}</header>" if r.random() < 0.15 else title)
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            kind = r.random()
            if kind < 0.62:
                text = self.prose()
                if r.random() < 0.15:
                    text = f"{self.sentence()} <a href='/x'>{self.words(1, 3)}</a> {self.sentence()}"
                inner.append(keep("<p>", f"<b>{text}" if r.random() < 0.1 else text, r.choice(["</p>", "</p>", "</p>", "<br>", ""])))
            elif kind < 0.70:
                inner.append(keep("<h2>", self.words(1, 6).capitalize(), "</h2>"))
            elif kind < 0.76:
                inner.append("<ul>" + "".join(keep("<li>", self.sentence(1, 12), "</li>") for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.80:
                inner.append(f"<blockquote>{keep('<p>', self.prose(), '</p>')}</blockquote>")
            elif kind < 0.83:
                inner.append("<table>" + "".join("<tr>" + "".join(keep("<td>", self.words(1, 4), "</td>") for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 3))) + "</table>")
            elif kind < 0.86:
                inner.append(f"<figure><img src=a.png>{keep('<figcaption>', self.sentence(), '</figcaption>')}</figure>")
            elif kind < 0.875:
                inner.append(keep("<div>", self.prose(), "</div>"))
            elif kind < 0.89:
                inner.append(keep("<pre>", self.words(2, 12), "</pre>"))
            else:
                inner.append(r.choice([self.advert, self.advert, self.notice, self.share, self.form, self.aside])())
        start, end = r.choice([("<article>", "</article>")] * 3 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), (self.named("div", "content", "article", "post", "entry", "story", "body", "text", "main"), "</div>"), (self.named("section", "content", "article", "post", "story"), "</section>"), (self.named("article", "post", "entry"), "</article>"), ("<div>", "</div>")])
        article = start + "".join(inner) + end
        before = [f for f in (self.menu, self.header, self.advert, self.notice, self.form, self.aside) if r.random() < 0.45]
        after = [f for f in (self.comments, self.aside, self.advert, self.share, self.footer, self.notice, self.form) if r.random() < 0.45]
        r.shuffle(before)
        body = [*(f() for f in before), article, *(f() for f in after)]
        if r.random() < 0.06:  # columns by a table
            side = f"<td class='{r.choice(['sidebar', 'left', 'nav', 'right'])}'>{self.text_in()}</td>"
            own = f"<td class='{r.choice(['content', 'main', 'text', 'body'])}'>{''.join(inner)}</td>"
            body = [f"<table><tr>{side}{own}</tr></table>" if r.random() < 0.5 else f"<table><tr>{own}{side}</tr></table>"]
        if r.random() < 0.3:
            body = [f'<div class="{r.choice(["page", "wrapper", "container"])}">', *body, "</div>"]
        extra = r.choice(["", "<script>var t='</p>';</script>", "<!-- ad -->", "<style>p{margin:0}</style>"])
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title></head><body>{extra}{''.join(body)}</body></html>", kept


def training_pages(n: int = 1000, seed: int = 1) -> list[tuple[str, list[str]]]:
    """``n`` invented labelled pages."""
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]


def op4_crf_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), fit(training_pages())).select("page_id", "url", "text", "n_chars")
