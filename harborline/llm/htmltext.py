"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, each with its open elements.  Features of a block
are its ancestors' tags, the words of their class, id and role, and the shape of its text (length, links,
punctuation).  The chain has two labels, main and rest, and two transition tables: for neighbours that are
elements of one kind under one parent, and for others.  It is trained by log-likelihood and decoded by Viterbi.

Pages carry no labels, so labelled pages are made: a bounded sample of pages, labelled by their semantic containers
(`article` and `main` hold main text, `nav`, `footer`, an advert's division and the like do not), and the same texts set
into other layouts, where each block's label is known, so that the model does not lean on one layout.

Texts of main blocks are joined by a line feed, in page order.  Character references are decoded; any white space of
Unicode is white space.  Scripts, styles, templates, titles, text areas and comments are never text.  Null and empty pages, and pages
without main blocks, give an empty text.  Unclosed and misplaced tags are closed as browsers close them, roughly.
Repeated rows give repeated results; other columns are kept as they are.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import text_column

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe noembed noframes xmp svg math".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main "
    "menu nav ol p pre search section summary table ul".split()
)
BLOCK = CLOSES_P | frozenset("body caption colgroup dd dt head html legend li noscript optgroup option select tbody td tfoot th thead tr button label".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
SCOPE = frozenset("table td th caption button object html".split())
#: What a start tag closes, and how far up.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
}
TABLE_PARTS = frozenset("table tbody td tfoot th thead tr caption".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>""")
NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block(NamedTuple):
    """A leaf block: its text, the characters of it in links, and its open elements as (tag, attributes)."""

    text: str
    linked: int
    path: tuple[tuple[str, str], ...]


@lru_cache(None)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.I)


def _closed(stack: list[tuple[str, str]], names: set | frozenset, barriers: set | frozenset) -> bool:
    """Pop up to the nearest of names, unless a barrier stands above it."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] in names:
            del stack[i:]
            return True
        if stack[i][0] in barriers:
            return False
    return False


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page that have text, in page order; time is linear in the page."""
    found: list[Block] = []
    stack: list[tuple[str, str]] = []
    pieces: list[str] = []
    path, linked, link_at, at, n = None, 0, -1, 0, len(page)

    def said(text: str) -> None:
        nonlocal path, linked
        if "&" in text:
            text = entities.unescape(text)
        if path is None:
            if not text or text.isspace():
                if pieces or not text:
                    pieces.append(text)
                return
            path = tuple(stack)
        pieces.append(text)
        if link_at >= 0:
            linked += len(text)

    def ended() -> None:
        nonlocal path, linked
        if path is not None:
            text = " ".join("".join(pieces).split())
            if text:
                found.append(Block(text, linked, path))
        pieces.clear()
        path, linked = None, 0

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            said(page[at:])
            break
        if lt > at:
            said(page[at:lt])
        after = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            at = n if end < 0 else end + 3
            continue
        m = TAG.match(page, lt)
        if m is None:
            if after.isascii() and after.isalpha() or after in ("/", "!", "?") and after:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                said("<")
                at = lt + 1
            continue
        at = m.end()
        name = m.group(2).lower()
        if name in BLOCK:
            ended()
        if m.group(1):
            if name in BLOCK:
                if name not in ("body", "html"):
                    _closed(stack, {name}, {"table"} if name in TABLE_PARTS - {"table"} else set() if name == "table" else {"td", "th", "table"})
            else:
                _closed(stack, {name}, BLOCK)
            if name == "a" or len(stack) < link_at:
                link_at = -1
            continue
        if name == "br":
            said(" ")
            continue
        if name in CLOSES_P:
            _closed(stack, {"p"}, SCOPE)
            if name in HEADINGS and stack and stack[-1][0] in HEADINGS:
                stack.pop()
        if name in ENDS:
            _closed(stack, *ENDS[name])
        if name == "body":
            stack[:] = [e for e in stack if e[0] == "html"]
        if len(stack) < link_at:
            link_at = -1
        if name in RAW:
            end = _end_of(name).search(page, at)
            at = n if end is None else page.find(">", end.end()) + 1 or n
            continue
        if name in VOID:
            continue
        if name == "a":
            link_at = len(stack)
        stack.append((name, m.group(3)))
    ended()
    return found


@lru_cache(1 << 14)
def words_of(attributes: str) -> tuple[str, ...]:
    """Lower-case words of class, id and role; a plural's s is cut off."""
    found = dict.fromkeys(w.lower() for _, v in NAMES.findall(attributes) for w in WORDS.findall(v))
    return tuple(w[:-1] if len(w) > 3 and w.endswith("s") else w for w in found)


def path_features(path: tuple[tuple[str, str], ...]) -> set[str]:
    found = set()
    for tag, attributes in path:
        if tag in BLOCK or tag == "a":
            found.add(f"in {tag}")
        if attributes:
            found.update(f"named {w}" for w in words_of(attributes))
    near = next((tag for tag, _ in reversed(path) if tag in BLOCK), "")
    found.add(f"leaf {near}")
    return found


def text_features(block: Block) -> list[str]:
    text = block.text
    spaces, share = text.count(" ") + 1, block.linked / len(text)
    found = [f"words {min(6, spaces.bit_length())}", f"links {min(3, int(share * 4))}", f"ends {text[-1] in '.!?…。'}"]
    if "©" in text or "®" in text:
        found.append("rights")
    if text.count(",") * 12 > spaces:
        found.append("commas")
    return found


def joined(a: Block, b: Block) -> int:
    """The transition table of two neighbours: 0 for elements of one kind and one parent, 1 elsewhere."""
    return 0 if a.path == b.path else 1


# Labelled pages


#: Containers of text that is not main: words that name them, by how their content is set.
REST = {
    "links": (
        "menu", "nav", "navigation", "navbar", "breadcrumb", "toc", "tags", "pagination", "pager", "social", "share", "sharing", "related", "recommended", "trending",
        "popular", "links", "sitemap", "languages", "categories", "archive", "more", "skip",
    ),
    "prose": (
        "ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "consent", "gdpr", "notice", "notification", "alert",
        "popup", "modal", "overlay", "disclaimer", "warning", "newsletter", "subscribe", "paywall", "sidebar", "side", "aside", "widget", "rail", "header", "masthead",
        "topbar", "logo", "footer", "copyright", "legal", "credits", "hidden", "toolbar", "message",
    ),
    "fields": ("form", "search", "login", "signup", "contact", "poll", "survey", "register"),
    "comments": ("comments", "comment", "respond", "replies", "reply", "discussion", "disqus", "thread", "reviews"),
}
#: Elements that say the same by themselves.
REST_TAGS = {"links": ("nav", "menu"), "prose": ("aside", "header", "footer", "noscript", "dialog"), "fields": ("form", "search"), "comments": ()}
MAIN = ("", "", "content", "post", "entry", "story", "body", "text", "main", "articleBody", "post-content", "page", "prose")
MAIN_TAGS = ("article", "main", "div", "div", "section", "td")
REST_WORDS = frozenset(w[:-1] if len(w) > 3 and w.endswith("s") else w for words in REST.values() for w in words)
REST_ELEMENTS = frozenset(t for tags in REST_TAGS.values() for t in tags) | {"head", "select", "button"}


def plain_label(block: Block) -> int:
    """1 for text in `article` or `main`, outside of any container that says otherwise."""
    if any(tag in REST_ELEMENTS or not REST_WORDS.isdisjoint(words_of(attributes)) for tag, attributes in block.path):
        return 0
    return int(any(tag in ("article", "main") for tag, _ in block.path))


def dressed(main: list[str], rest: list[str], rng: random.Random) -> str:
    """A page of other layout: main texts in one container, the rest around and within it; data-truth tells them apart."""
    out: list[str] = []

    def wrapped(tag: str, word: str, inner: str, truth: str) -> str:
        name = f' {rng.choice(("class", "id", "class"))}="{word}"' if word else ""
        return f'<{tag}{name} data-truth="{truth}">{inner}</{tag}>'

    def some(n: int) -> list[str]:
        return [entities.escape(rng.choice(rest if rng.random() < 0.6 else main)) for _ in range(n)]

    def extra(kinds: tuple[str, ...] = ("links", "prose", "fields", "comments")) -> str:
        kind = rng.choice(kinds)
        if kind == "links":
            items = [f'<a href="/x">{" ".join(t.split()[:4])}</a>' for t in some(rng.randint(2, 7))]
            inner = "<ul>" + "".join(f"<li>{t}</li>" for t in items) + "</ul>" if rng.random() < 0.7 else " | ".join(items)
        elif kind == "prose":
            texts = [" ".join(t.split()[: rng.choice((2, 3, 5, 99))]) for t in some(rng.randint(1, 3))]
            inner = "".join(t if rng.random() < 0.4 else f"<p>{t}</p>" for t in texts)
        elif kind == "fields":
            inner = "".join(f'<label>{" ".join(t.split()[:3])}</label><input>' for t in some(rng.randint(1, 3))) + "<button>ok</button>"
        else:
            inner = "".join(rng.choice(("<p>{}</p>", "<li>{}</li>", '<div class="body"><p>{}</p></div>', '<div class="text">{}</div>')).format(t) for t in some(rng.randint(1, 6)))
        if rng.random() < 0.35:
            level = rng.randint(1, 5)
            inner = f"<h{level}>{' '.join(some(1)[0].split()[: rng.randint(1, 9)])}</h{level}>" + inner
        if REST_TAGS[kind] and rng.random() < 0.4:
            return wrapped(rng.choice(REST_TAGS[kind]), rng.choice(("", rng.choice(REST[kind]))), inner, "rest")
        return wrapped(rng.choice(("div", "div", "section", "ul" if kind == "links" else "div")), rng.choice(REST[kind]), inner, "rest")

    body = []
    for i, text in enumerate(main):
        tag = rng.choice(("h1", "h2")) if i == 0 and rng.random() < 0.7 else rng.choice(("p", "p", "p", "p", "p", "div", "blockquote", "li", "h2"))
        text = entities.escape(text)
        if rng.random() < 0.1:
            text = f'<a href="/y">{text[:20]}</a>{text[20:]}' if "&" not in text[:26] else text
        body.append(f"<{tag}>{text}" + ("" if tag in ("p", "li") and rng.random() < 0.3 else f"</{tag}>"))
        if rng.random() < 0.35:
            body.append(extra())
    if rng.random() < 0.3:
        body.append(extra(("comments", "links")))
    tag = rng.choice(MAIN_TAGS)
    inner = wrapped(tag, rng.choice(MAIN), "".join(body), "main")
    if tag == "td":
        inner = "<table><tr>" + ("<td class=\"sidebar\" data-truth=\"rest\">" + some(1)[0] + "</td>" if rng.random() < 0.5 else "") + inner + "</tr></table>"
    out = [extra(("links", "prose")) for _ in range(rng.randint(1, 3))] + [inner] + [extra() for _ in range(rng.randint(1, 4))]
    whole = "".join(out)
    return "<html><body>" + (f'<div id="wrapper">{whole}</div>' if rng.random() < 0.5 else whole) + "</body></html>"


def truth(block: Block) -> int:
    """The label that the innermost data-truth of a made page gives."""
    for _, attributes in reversed(block.path):
        if "data-truth" in attributes:
            return int('data-truth="main"' in attributes)
    return 0


def labelled(pages: Iterable[str], copies: int = 5, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    """Blocks and labels of the pages, and of `copies` other layouts of each."""
    rng, plain = random.Random(seed), []
    for page in pages:
        found = blocks(page)
        if found:
            plain.append((found, [plain_label(b) for b in found]))
    taught = [x for x in plain if any(x[1])]
    rest = [b.text for found, labels in taught for b, y in zip(found, labels) if not y] or ["menu", "notice"]
    made = []
    for found, labels in taught:
        main = [b.text for b, y in zip(found, labels) if y]
        for _ in range(copies):
            start = rng.randrange(len(main))
            made.append(blocks(dressed(main[start : start + 8], rest, rng)))
    return taught + [(found, [truth(b) for b in found]) for found in made if found]


# The conditional random field


class Model(NamedTuple):
    """weights: score of main minus rest by feature; steps: (table, from, to) scores."""

    weights: dict[str, float]
    steps: np.ndarray


def fit(sequences: list[tuple[list[Block], list[int]]], rounds: int = 150, penalty: float = 1e-5, longest: int = 32) -> Model | None:
    """Greatest mean log-likelihood less the squared weights, by Adam on batched forward and backward sums.

    Sequences are cut at `longest` blocks for training only.  No sequences: None.
    """
    pieces = [(b[i : i + longest], y[i : i + longest]) for b, y in sequences for i in range(0, len(b), longest)]
    if not pieces:
        return None
    names: dict[str, int] = {}
    size, length = len(pieces), max(len(b) for b, _ in pieces)
    gold, mask, kind = np.zeros((size, length), int), np.zeros((size, length), bool), np.zeros((size, length), int)
    rows, columns = [], []
    for s, (found, labels) in enumerate(pieces):
        gold[s, : len(found)], mask[s, : len(found)] = labels, True
        kind[s, 1 : len(found)] = [joined(a, b) for a, b in zip(found, found[1:])]
        for i, block in enumerate(found):
            for f in {*path_features(block.path), *text_features(block)}:
                rows.append(s * length + i)
                columns.append(names.setdefault(f, len(names)))
    rows, columns = np.array(rows), np.array(columns)
    x = np.zeros(len(names) + 8)
    mean, spread, total = np.zeros_like(x), np.zeros_like(x), mask.sum()
    pairs = mask[:, 1:] & mask[:, :-1]
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (kind[:, 1:][pairs], gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
    for step in range(1, rounds + 1):
        weights, steps = x[:-8], x[-8:].reshape(2, 2, 2)
        score = np.bincount(rows, weights[columns], size * length).reshape(size, length)
        share, both = marginals(score, steps, kind, mask)
        expected = np.stack([(both * ((kind[:, 1:] == k) & pairs)[..., None, None]).sum((0, 1)) for k in (0, 1)])
        gap = np.where(mask, gold - share, 0).reshape(-1)
        slope = np.concatenate([np.bincount(columns, gap[rows], len(names)), (seen - expected).reshape(-1)]) / total - penalty * x
        mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope * slope
        x = x + 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-9)
    return Model(dict(zip(names, x[:-8].round(9).tolist())), x[-8:].reshape(2, 2, 2).round(9))


def marginals(score: np.ndarray, steps: np.ndarray, kind: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of main at each place, and of each pair of labels at places i and i + 1, of padded sequences."""
    size, length = score.shape
    node = np.stack([np.zeros_like(score), np.where(mask, score, 0.0)], 2)
    edge = steps[kind]  # (size, length, 2, 2)
    edge[~mask] = 0.0
    ahead, behind = np.zeros((length, size, 2)), np.zeros((length, size, 2))
    ahead[0] = node[:, 0]
    for i in range(1, length):
        ahead[i] = np.logaddexp.reduce(ahead[i - 1][:, :, None] + edge[:, i], 1) + node[:, i]
    for i in range(length - 2, -1, -1):
        behind[i] = np.logaddexp.reduce(edge[:, i + 1] + (node[:, i + 1] + behind[i + 1])[:, None, :], 2)
    whole = np.logaddexp.reduce(ahead[-1], 1)
    share = np.exp(ahead + behind - whole[None, :, None])[:, :, 1].T
    pairs = ahead[:-1].transpose(1, 0, 2)[:, :, :, None] + edge[:, 1:] + (node[:, 1:] + behind[1:].transpose(1, 0, 2))[:, :, None, :]
    return share, np.exp(pairs - whole[:, None, None, None])


def best_labels(score: list[float], kinds: list[int], steps: list) -> list[int]:
    """Viterbi: the labels of the greatest sum of scores; of equals, rest."""
    if not score:
        return []
    rest, main, back = 0.0, score[0], []
    for s, k in zip(score[1:], kinds):
        (rr, rm), (mr, mm) = steps[k]
        to_rest, to_main = main + mr > rest + rr, main + mm > rest + rm
        back.append((to_rest, to_main))
        rest, main = (main + mr if to_rest else rest + rr), (main + mm if to_main else rest + rm) + s
    label = int(main > rest)
    out = [label]
    for choice in reversed(back):
        label = int(choice[label])
        out.append(label)
    return out[::-1]


class Extractor:
    """main_text with the scores of paths remembered."""

    def __init__(self, model: Model, remembered: int = 20_000):
        self.weights, self.steps, self.most = model.weights, model.steps.tolist(), remembered
        self.paths: dict[tuple, float] = {}

    def scored(self, block: Block) -> float:
        score = self.paths.get(block.path)
        if score is None:
            if len(self.paths) >= self.most:
                self.paths.clear()
            score = self.paths[block.path] = sum(self.weights.get(f, 0.0) for f in sorted(path_features(block.path)))
        return score + sum(self.weights.get(f, 0.0) for f in text_features(block))

    def main_text(self, page: str | None) -> str:
        found = blocks(page) if page else []
        labels = best_labels([self.scored(b) for b in found], [joined(a, b) for a, b in zip(found, found[1:])], self.steps)
        return "\n".join(b.text for b, y in zip(found, labels) if y)


def train(pages: DataFrame, html_column: str = "html", most_pages: int = 160, most_chars: int = 50_000, copies: int = 5) -> Model | None:
    """A model from the labelled pages made of `most_pages` different pages of up to most_chars characters, those of the least
    hashes.  Hashes alone are ordered; the pages that have the chosen ones come to the driver once each.

    None if there is no page that can be labelled.
    """
    found = pages.where(F.length(html_column) <= most_chars).select(F.col(html_column).alias("__html"), F.xxhash64(html_column).alias("__h"))
    chosen = [r[0] for r in found.select("__h").distinct().orderBy("__h").limit(most_pages).collect()]
    if not chosen:
        return None
    rows = found.where(F.col("__h").isin(chosen)).groupBy("__h").agg(F.min("__html").alias("__html")).orderBy("__h").collect()
    return fit(labelled([r[1] for r in rows], copies))


def extract(pages: DataFrame, model: Model | None, html_column: str = "html", name: str = "text") -> DataFrame:
    """Add the main text, empty where there is none; without a model all are."""
    if model is None:
        return pages.withColumn(name, F.lit(""))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def texts(found: list[str | None]) -> list[str]:
        extractor = Extractor(shared.value)
        return [extractor.main_text(page) for page in found]

    return pages.withColumn(name, text_column(F.col(html_column), "string", texts))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    found = extract(pages.select("page_id", "url", "html"), train(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
