"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks. Each block is read as a vector of its tag path (tags and the words of
class, id and role), a vector of its hashed words, and a few measures. A part of the path is read by what stands around
it: whether an article begins further out, and whether its element holds most of the page. A bidirectional LSTM in numpy
runs over the whole page and labels every block as article or not, so what stands before and behind a block counts.

There are no labelled pages. The network learns from a bounded sample of the given ones, labelled by what their markup
says (article, nav, footer, ...), and from variants of them in which containers bear other usual names and notices,
sidebars, forms, adverts and reader comments made of the pages' own texts are put in, wrappers with telling names hold the
whole page, headings have headers of their own, or all is nested deep in containers that only lay the page out.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.text import ALNUM, slices, words

MAX_TRAINING_PAGES = 600
#: leaves of a page that one training sequence shows; labelling always reads the whole page
TRAINING_LEAVES = 160
TAGS, WORDS = 1 << 12, 1 << 12
TAG_SIZE, WORD_SIZE, HIDDEN, MEASURES = 32, 6, 16, 6

# HTML's elements that do not start a block, have no end tag, or hold no text to read.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe textarea select title".split())
#: void elements that end a block; the others stand within one
BREAKS = frozenset("base col hr input".split())
#: in formulas and drawings elements are inline, these are not shown, and HTML's own blocks end an unclosed one
FOREIGN = frozenset("math svg".split())
UNSHOWN = frozenset("annotation annotation-xml desc metadata".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
_SCOPE = {"p": (), "li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][\w:-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*)|[^>=])*)>?|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|(\S*)))?""")
_PART = re.compile(r"[a-z]+|[0-9]+")


@dataclass
class Leaf:
    path: tuple[str, ...]  #: tags and name parts from the root down
    text: str
    linked: float  #: share of the text inside links
    told: tuple[str, ...] | None = None  #: the path's parts with what stands around them


def _names(attributes: str) -> list[str]:
    if "=" not in attributes:
        return []
    out = []
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role"):
            out += [f".{x}" for x in _PART.findall((m[2] or m[3] or m[4] or "").lower())]
    return out


def leaves(page: str) -> list[Leaf]:
    """The page's blocks of text in order; scripts, styles, comments and other markup are none."""
    out: list[Leaf] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    in_link, linked, size = False, 0, 0
    foreign = ""
    unclosed: set[str] = set()  # elements without an end tag from here on

    def ends(name: str, at: int) -> re.Match | None:
        stop = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
        if stop is None:
            unclosed.add(name)
        return stop

    def close() -> None:
        nonlocal linked, size
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                path = tuple(x for tag, names in stack for x in (tag, *names))
                out.append(Leaf(path, text, linked / max(size, 1)))
            held.clear()
        linked = size = 0

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                held.append(token)
                size += len(token)
                linked += len(token) * in_link
            elif token.startswith("<![CDATA["):
                pass
            continue
        tag, ending = tag.lower(), bool(m[1])
        if (tag in RAW or (foreign and tag in UNSHOWN)) and not ending:
            if not m[3].endswith("/"):
                if stop := ends(tag, at):
                    at = stop.end()
                else:  # as far as the element around it
                    stop = ends(stack[-1][0], at) if stack else None
                    at = stop.start() if stop else end
            if tag in ("textarea", "select", "iframe"):
                close()
            continue
        if tag in FOREIGN:
            foreign = "" if ending or m[3].endswith("/") else tag
            held.append(" " if tag == "svg" else "")
            continue
        if foreign and tag not in BLOCKS:
            if tag == "text":
                held.append(" ")
            continue
        foreign = ""
        if tag == "object" or (tag in VOID and tag not in BREAKS and tag not in INLINE):
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not ending
            elif tag in ("br", "img", "wbr"):
                held.append(" " if tag != "wbr" else "")
            continue
        close()
        in_link = False
        if ending:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in VOID:
            continue
        closes, scope = _CLOSES.get(tag, {"p"}), _SCOPE.get(tag, ())
        while stack:
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in closes or stack[i][0] in scope), None)
            if i is None or stack[i][0] in scope or any(x[0] not in closes for x in stack[i:]):
                break
            del stack[i:]
        if not m[3].endswith("/"):
            stack.append((tag, tuple(_names(m[3]))))
    close()
    return out


# Usual names of what is not the article, and of what holds it.
BESIDE = frozenset(
    ".ad .ads .adv .advert .advertisement .sponsor .sponsored .promo .banner .cookie .cookies .consent .notice .gdpr .popup .modal "
    ".sidebar .side .aside .menu .nav .navbar .navigation .breadcrumb .breadcrumbs .header .masthead .footer .foot .comment "
    ".comments .disqus .reply .replies .share .social .related .recommended .newsletter .subscribe .signup .login .search .form "
    ".widget .toolbar .pagination .tags .copyright .legal .complementary .contentinfo".split()
)
BESIDE_TAGS = frozenset("nav footer aside form header menu dialog head button".split())
WITHIN = frozenset("article main .article .content .post .entry .story .body .main".split())
HEADERS = frozenset("header .header .masthead".split())
HEADED = frozenset(".article .entry .post .story".split())
#: before a name, these say that something else on the page is so named
OF_OTHERS = frozenset(".has .with .no .without".split())
LANDMARKS = frozenset("h1 main nav footer".split())


def _elements(path: tuple[str, ...]) -> list[tuple[str, ...]]:
    """The path cut into its elements, each a tag and its name parts."""
    starts = [i for i, x in enumerate(path) if not i or x[0] != "."]
    return [path[a:b] for a, b in zip(starts, [*starts[1:], len(path)])]


def outline(page: list[Leaf]) -> list[list[tuple[tuple[str, ...], bool]]]:
    """Every leaf's elements from the root down, and whether each wraps the page: holds half of its text or more, and its
    main heading, main part, menu or footer. Elements of equal paths count as one."""
    sizes: dict[tuple[str, ...], int] = {}
    for leaf in page:
        sizes[leaf.path] = sizes.get(leaf.path, 0) + len(leaf.text)
    nodes: dict[tuple, int] = {}
    held: list[int] = []
    marked: list[bool] = []
    routes: dict[tuple[str, ...], list[tuple[tuple[str, ...], int]]] = {}
    for path, size in sizes.items():
        route, at = [], -1
        for element in _elements(path):
            at = nodes.setdefault((at, element), len(nodes))
            if at == len(held):
                held.append(0)
                marked.append(False)
            held[at] += size
            route.append((element, at))
        inner = False
        for element, at in reversed(route):
            marked[at] |= inner
            inner = inner or element[0] in LANDMARKS
        routes[path] = route
    half = sum(sizes.values()) / 2
    made = {path: [(e, marked[at] and held[at] >= half) for e, at in route] for path, route in routes.items()}
    return [made[leaf.path] for leaf in page]


def _label(route: list[tuple[tuple[str, ...], bool]]) -> int:
    inside, last = False, route[-1][0][0] if route else ""
    for (tag, *names), wraps in route:
        if tag in ("html", "body"):
            continue
        own = [x for x, before in zip(names, ["", *names]) if before not in OF_OTHERS]
        beside = [x for x in (tag, *own) if x in BESIDE or x in BESIDE_TAGS]
        if beside and not (wraps and (tag == "form" or tag not in BESIDE_TAGS)):
            headed = inside or any(x in HEADED for x in own)
            if not (headed and last in ("h1", "h2") and HEADERS.issuperset(beside)):
                return 0
            inside = True
        elif tag in WITHIN or any(x in WITHIN for x in own):
            inside = True
    return int(inside or last in ("p", "h1", "h2", "h3", "h4", "blockquote", "pre"))


def named(page: list[Leaf]) -> list[int]:
    """What the markup says of the leaves: 1 in the article, 0 beside it. Any container with the name of something beside
    the article decides, be it within the article or around one (reader comments as articles), but for the names of html,
    body and of wrappers of the page, and for the main headings in a header of the article. Where no container tells,
    paragraphs and headings count as article."""
    return [_label(route) for route in outline(page)]


def told(page: list[Leaf]) -> list[Leaf]:
    """The leaves with the parts of their paths as the network reads them: marked if the element wraps the page or is html
    or body, and if an article begins further out; and the innermost element once more."""
    if page and page[0].told is not None:
        return page
    made: dict[tuple[str, ...], tuple[str, ...]] = {}
    for leaf, route in zip(page, outline(page)):
        if leaf.path in made:
            continue
        parts, inside = [], False
        for element, wraps in route:
            outer = element[0] in ("html", "body")
            sign = ("~" if wraps or outer else "") + ("/" if inside else "")
            parts += [
                ("?" if before in OF_OTHERS else "") + sign + x for x, before in zip(element, ["", *element])
            ]
            inside = inside or (not outer and any(x in WITHIN for x in element))
        if route:
            parts.append("^" + route[-1][0][0])
        made[leaf.path] = tuple(dict.fromkeys(parts))
    return [replace(leaf, told=made[leaf.path]) for leaf in page]


#: what stands beside telling names in one class
NEUTRAL = (".bar", ".block", ".body", ".box", ".content", ".inner", ".item", ".left", ".list", ".main", ".page", ".post", ".right", ".text", ".top", ".wrapper")
COMMENTS = (".comment", ".comments", ".disqus", ".replies")

# Usual parts of containers that only lay a page out.
LAYOUT = ("div", ".container", ".row", ".col", ".md", ".sm", ".4", ".6", ".12", ".wrap", ".inner", ".outer", ".grid", ".flex", ".list", ".unstyled", ".item", ".group", ".block", "section", "ul", "li")


def _nested(path: tuple[str, ...], rng: np.random.Generator) -> tuple[str, ...]:
    """The path with up to 40 parts of layout, from an element on, between its outer elements and its last one."""
    starts = [i for i, x in enumerate(path) if x[0] != "."]
    at = starts[int(rng.integers(min(2, len(starts) - 1), len(starts)))] if starts else 0
    number = int(rng.integers(1, 41))
    return (*path[:at], "div", *(LAYOUT[i] for i in rng.integers(len(LAYOUT), size=number)), *path[at:])


def _variant(page: list[Leaf], texts: list[str], rng: np.random.Generator) -> tuple[list[Leaf], np.ndarray]:
    """The page with containers of other names, and with blocks beside the article put in; and its labels."""
    y = named(page)
    holder = [("main",), ("div", ".content"), ("div", ".post", ".body"), ("section", ".entry", ".content"), ("div", ".article"), ("article",), ("main", "article"), ("div", ".story"), (), ("div",)]
    chosen = holder[rng.integers(len(holder))]
    forms = [("h2",), ("ul", "li"), ("ol", "li"), ("div",), ("div", "p"), ("blockquote", "p"), ("pre",), ("table", "tr", "td"), ("section", "p"), ("figure", "figcaption")]
    headed = [(), (), ("header",), ("header", ".entry", ".header"), ("div", ".post", ".header")][rng.integers(5 if any(x in WITHIN for x in chosen) else 2)]
    out: list[Leaf] = []
    for leaf, label in zip(page, y):
        path: list[str] = []
        for x in leaf.path:
            path += chosen if x == "article" else (x,)
        if label and path[-1] == "p" and chosen and rng.random() < 0.25:  # articles hold other elements too
            path[-1:] = forms[rng.integers(len(forms))]
        if label and path[-1] in ("h1", "h2") and headed:
            path[-1:-1] = headed
        out.append(Leaf(tuple(path), leaf.text, leaf.linked))
    beside = sorted(BESIDE)
    for _ in range(int(rng.integers(1, 8))):
        kind = (0, 1, 2, 3, 3, 3, 4, 4, 5)[rng.integers(9)]
        name = beside[rng.integers(len(beside))]
        outer = {0: ("aside",), 1: ("form",), 2: ("header",), 3: ("div", name), 4: ("section", name), 5: (("div", "section", "ol")[rng.integers(3)], COMMENTS[rng.integers(len(COMMENTS))])}[kind]
        outer = outer + ((beside[rng.integers(len(beside))],) if rng.random() < 0.3 else ())
        if kind in (3, 4) and rng.random() < 0.4:
            outer = outer + (NEUTRAL[rng.integers(len(NEUTRAL))],)
        if kind == 5:
            outer = outer + [(), (), ("article",), ("li", "article"), ("div", "article", ".comment"), ("li", "div", ".post")][rng.integers(6)]
        inner = [("p",), ("ul", "li"), ("div",), (), ("h3",), ("div", "p")][rng.integers(6)]
        at = int(rng.integers(len(out) + 1))
        inside = rng.random() < 0.5 and 0 < at < len(out) and y[at - 1] == 1
        if not inside and rng.random() < 0.2:
            inner = (("h1",), ("h2",))[rng.integers(2)]
        base = ("html", "body") + (chosen if inside else ())
        for _ in range(int(rng.integers(1, 4))):
            text = texts[rng.integers(len(texts))]
            if rng.random() < 0.5:
                text = " ".join(text.split()[: int(rng.integers(1, 12))])
            out.insert(at, Leaf(base + outer + inner, text, float(rng.random() < 0.3)))
            y.insert(at, 0)
    if rng.random() < 0.5:  # the parts of the page in another order
        starts = [i for i, l in enumerate(out) if not i or l.path[:4] != out[i - 1].path[:4]]
        runs = [range(a, b) for a, b in zip(starts, [*starts[1:], len(out)])]
        order = [i for r in rng.permutation(len(runs)) for i in runs[r]]
        out, y = [out[i] for i in order], [y[i] for i in order]
    if rng.random() < 0.75:  # a page of many nested containers
        out = [Leaf(_nested(l.path, rng), l.text, l.linked) for l in out]
    wrapper: tuple[str, ...] = ()
    if rng.random() < 0.3:  # names of the whole page
        wrapper = tuple(beside[i] if rng.random() < 0.5 else ".page" for i in rng.integers(len(beside), size=3))
    if rng.random() < 0.4:
        names = tuple(x for i in rng.integers(len(beside), size=2) for x in ((".has",) if rng.random() < 0.3 else ()) + (beside[i],))
        wrapper += [("form",), ("form", ".page", ".form"), ("div", *names), ("section", *names), ("div", ".content", *names)][rng.integers(5)]
    if wrapper:
        out = [Leaf((*l.path[:2], *wrapper, *l.path[2:]), l.text, l.linked) if l.path[:2] == ("html", "body") else l for l in out]
    return told(out), np.array(y)


@dataclass
class Batch:
    """Pages as arrays: sparse tag and word rows of every leaf, measures, and each page's bounds."""

    tags: tuple[np.ndarray, np.ndarray]
    words: tuple[np.ndarray, np.ndarray]
    measures: np.ndarray
    bounds: np.ndarray


_tag_rows: dict[tuple[str, ...], np.ndarray] = {}


def _tags(path: tuple[str, ...]) -> np.ndarray:
    if (made := _tag_rows.get(path)) is None:
        if len(_tag_rows) > 20_000:
            _tag_rows.clear()
        made = _tag_rows[path] = np.array([zlib.crc32(x.encode()) % TAGS for x in path] or [0])
    return made


def encode(pages: list[list[Leaf]]) -> Batch:
    flat = [l for p in pages for l in told(p)]
    tags = [_tags(l.told) for l in flat]
    tag_bounds = np.concatenate([[0], np.cumsum([len(t) for t in tags])]).astype(np.int64)
    word_rows, counts = [], []
    for _, _, data, offsets in slices(pa.array([l.text for l in flat], pa.large_string())):
        found = words(data, offsets, ALNUM, lower=True)
        word_rows.append((found.hashes >> np.uint64(52)).astype(np.int64))
        counts.append(np.diff(found.bounds))
    counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    size = np.array([len(l.text) for l in flat], dtype=np.float32)
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in pages])]).astype(np.int64)
    place = np.arange(len(flat)) - np.repeat(bounds[:-1], np.diff(bounds))
    total = np.repeat(np.diff(bounds), np.diff(bounds))
    measures = np.zeros((len(flat), MEASURES), dtype=np.float32)
    if len(flat):
        measures[:, 0] = np.log1p(size) / 5
        measures[:, 1] = [l.linked for l in flat]
        measures[:, 2] = place / np.maximum(total, 1)
        measures[:, 3] = np.log1p(counts) / 4
        measures[:, 4] = [l.text[-1] in ".!?" for l in flat]
        measures[:, 5] = 1
    return Batch(
        (np.concatenate(tags) if tags else np.zeros(0, np.int64), tag_bounds),
        (np.concatenate(word_rows) if word_rows else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(counts)])),
        measures,
        bounds,
    )


def _summed_rows(table: np.ndarray, rows: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The mean of every leaf's rows."""
    at, bounds = rows
    out = np.zeros((len(bounds) - 1, table.shape[1]), dtype=np.float32)
    filled = np.flatnonzero(np.diff(bounds))
    if len(filled):
        out[filled] = np.add.reduceat(table[at], bounds[filled], axis=0) / np.diff(bounds)[filled, None]
    return out


#: of a path's vector, the first part is a sum of its rows over this, the rest the greatest values of them
SUMMED, DIVISOR = TAG_SIZE // 2, 4


def _path_rows(table: np.ndarray, rows: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Every leaf's path: sums, in which its parts add up, and greatest values, in which a telling part counts alike in
    short and long paths."""
    at, bounds = rows
    if len(bounds) < 2:
        return np.zeros((0, table.shape[1]), np.float32)
    shown = table[at]
    added = np.add.reduceat(shown[:, :SUMMED], bounds[:-1], axis=0) / np.float32(DIVISOR)
    return np.concatenate([added, np.maximum.reduceat(shown[:, SUMMED:], bounds[:-1], axis=0)], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Both directions of the LSTM and the output layer."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 3) -> Labeller:
        rng = np.random.default_rng(seed)
        n = TAG_SIZE + WORD_SIZE + MEASURES
        w = {"tag": rng.normal(0, 0.5, (TAGS, TAG_SIZE)), "word": rng.normal(0, 0.1, (WORDS, WORD_SIZE))}
        for side in "lr":
            w[f"x{side}"] = rng.normal(0, n**-0.5, (n, 4 * HIDDEN))
            w[f"h{side}"] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN))
            w[f"b{side}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        w["out"] = rng.normal(0, 0.1, (2 * HIDDEN + n, 1))
        w["shift"] = np.zeros(1)
        return Labeller({k: v.astype(np.float32) for k, v in w.items()})

    def _inputs(self, batch: Batch) -> np.ndarray:
        tags, words_ = _path_rows(self.weights["tag"], batch.tags), _summed_rows(self.weights["word"], batch.words)
        return np.concatenate([tags, words_, batch.measures], axis=1)

    def _run(self, x: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """x: steps, pages, inputs. The states of every step."""
        w_h, pre = self.weights[f"h{side}"], x @ self.weights[f"x{side}"] + self.weights[f"b{side}"]
        h = c = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
        out = np.empty((*x.shape[:2], HIDDEN), dtype=np.float32)
        for t in range(len(x)):
            gates = pre[t] + h @ w_h
            ifo, g = _sigmoid(gates[:, : 3 * HIDDEN]), np.tanh(gates[:, 3 * HIDDEN :])
            i, f, o = ifo[:, :HIDDEN], ifo[:, HIDDEN : 2 * HIDDEN], ifo[:, 2 * HIDDEN :]
            before_h, before_c = h, c
            c = f * c + i * g
            s = np.tanh(c)
            h = out[t] = o * s
            if keep is not None:
                keep.append((i, f, o, g, before_c, before_h, s))
        return out

    def _back(self, x: np.ndarray, side: str, kept: list, d_out: np.ndarray, grads: dict) -> np.ndarray:
        w_h = self.weights[f"h{side}"]
        dh = dc = np.zeros((x.shape[1], HIDDEN), dtype=np.float32)
        d_pre = np.empty((*x.shape[:2], 4 * HIDDEN), dtype=np.float32)
        for t in range(len(x) - 1, -1, -1):
            i, f, o, g, before_c, _, s = kept[t]
            dh = dh + d_out[t]
            dc = dc + dh * o * (1 - s * s)
            d_pre[t] = np.concatenate(
                [dc * g * i * (1 - i), dc * before_c * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)], axis=1
            )
            dh, dc = d_pre[t] @ w_h.T, dc * f
        states = np.stack([k[5] for k in kept])
        flat = d_pre.reshape(-1, 4 * HIDDEN)
        grads[f"h{side}"] = states.reshape(-1, HIDDEN).T @ flat
        grads[f"x{side}"] = x.reshape(-1, x.shape[2]).T @ flat
        grads[f"b{side}"] = flat.sum(axis=0)
        return d_pre @ self.weights[f"x{side}"].T

    @staticmethod
    def _grids(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leaf of (step, page) forwards and backwards, and whether there is one."""
        size = np.diff(bounds)
        step = np.arange(max(int(size.max(initial=0)), 1))[:, None]
        real = step < size[None, :]
        ahead = np.where(real, bounds[:-1][None, :] + step, 0)
        return ahead, np.where(real, bounds[1:][None, :] - 1 - step, 0), real

    def logits(self, batch: Batch) -> np.ndarray:
        if not len(batch.measures):
            return np.zeros(0, np.float32)
        x = self._inputs(batch)
        both = [np.zeros((len(x), HIDDEN), np.float32) for _ in "lr"]
        ahead, back, real = self._grids(batch.bounds)
        for grid, side, held in ((ahead, "l", both[0]), (back, "r", both[1])):
            held[grid[real]] = self._run(x[grid] * real[:, :, None], side)[real]
        return (np.concatenate([*both, x], axis=1) @ self.weights["out"] + self.weights["shift"])[:, 0]

    def gradients(self, batch: Batch, y: np.ndarray) -> dict[str, np.ndarray]:
        x = self._inputs(batch)
        ahead, back, real = self._grids(batch.bounds)
        states, runs = [], []
        for grid, side in ((ahead, "l"), (back, "r")):
            kept: list = []
            xs = x[grid] * real[:, :, None]
            run = self._run(xs, side, kept)
            held = np.zeros((len(x), HIDDEN), np.float32)
            held[grid[real]] = run[real]
            states.append(held)
            runs.append((grid, side, xs, kept))
        joined = np.concatenate([*states, x], axis=1)
        d = ((_sigmoid((joined @ self.weights["out"] + self.weights["shift"])[:, 0]) - y) / len(y)).astype(np.float32)[:, None]
        grads = {"out": joined.T @ d, "shift": d.sum(axis=0)}
        d_joined = d @ self.weights["out"].T
        dx = d_joined[:, 2 * HIDDEN :].copy()
        for n, (grid, side, xs, kept) in enumerate(runs):
            d_out = np.where(real[:, :, None], d_joined[:, n * HIDDEN : (n + 1) * HIDDEN][grid], 0).astype(np.float32)
            d_xs = self._back(xs, side, kept, d_out, grads)
            dx[grid[real]] += d_xs[real]
        (at, bounds), table = batch.tags, self.weights["tag"]
        d_tags = np.repeat(dx[:, :TAG_SIZE], np.diff(bounds), axis=0)
        d_tags[:, :SUMMED] /= DIVISOR
        d_tags[:, SUMMED:] *= table[at, SUMMED:] == np.repeat(x[:, SUMMED:TAG_SIZE], np.diff(bounds), axis=0)
        grads["tag"] = np.zeros_like(table)
        np.add.at(grads["tag"], at, d_tags)
        number = np.diff(batch.words[1])
        d_words = dx[:, TAG_SIZE : TAG_SIZE + WORD_SIZE] / np.maximum(number, 1)[:, None].astype(np.float32)
        grads["word"] = np.zeros_like(self.weights["word"])
        np.add.at(grads["word"], batch.words[0], np.repeat(d_words, number, axis=0))
        return grads


def train(pages: list[list[Leaf]], shown_pages: int = 20_000, size: int = 24, rate: float = 1.5e-2) -> Labeller:
    """Fit on leaf sequences, labelled by their markup, with a fresh variant of every page in every pass.

    There are as many passes as show ``shown_pages`` pages and variants in all, so few pages are seen more often.
    """
    net = Labeller.fresh()
    pages = [p for p in pages if p]
    if not pages:
        return net
    rng = np.random.default_rng(17)
    pages = [told(p) for p in pages]
    labels = [np.array(named(p)) for p in pages]
    texts = [l.text for p in pages for l in p]
    first = {n: np.zeros_like(a) for n, a in net.weights.items()}
    second = {n: np.zeros_like(a) for n, a in net.weights.items()}
    epochs = -(-shown_pages // (2 * len(pages)))
    step, total = 0, epochs * -(-2 * len(pages) // size)
    for _ in range(epochs):
        shown = [*zip(pages, labels), *(_variant(p, texts, rng) for p in pages)]
        order = rng.permutation(len(shown))
        for a in range(0, len(order), size):
            chosen = []
            for i in order[a : a + size]:
                page, y = shown[i]
                begin = int(rng.integers(0, max(1, len(page) - TRAINING_LEAVES + 1)))
                chosen.append((page[begin : begin + TRAINING_LEAVES], y[begin : begin + TRAINING_LEAVES]))
            step += 1
            now = rate * (1 - step / (total + 1))
            grads = net.gradients(encode([p for p, _ in chosen]), np.concatenate([y for _, y in chosen]))
            for n, g in grads.items():
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.99 * second[n] + 0.01 * g * g
                net.weights[n] = (
                    net.weights[n] - now * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)
                ).astype(np.float32)
    return net


def model(pages: DataFrame, most: int = MAX_TRAINING_PAGES) -> Labeller:
    """Fit on the leaves of at most ``most`` pages, by hash of their id."""
    chosen = (
        pages.where("page_id is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(most)
    )
    sample = pages.where("html is not null").select("page_id", "html").join(F.broadcast(chosen), "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("path", pa.list_(pa.string())), ("text", pa.string()), ("linked", pa.float64())]))
        for batch in batches:
            made = [
                [{"path": list(l.path), "text": l.text, "linked": l.linked} for l in leaves(h.as_py())]
                for h in batch.column("html")
            ]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), pa.array(made, kind)], names=["page_id", "leaves"])

    rows = sample.mapInArrow(run, "page_id long, leaves array<struct<path: array<string>, text: string, linked: double>>").collect()
    rows.sort(key=lambda r: (r.page_id, len(r.leaves)))
    return train([[Leaf(tuple(l.path), l.text, l.linked) for l in r.leaves] for r in rows])


def labelled(pages: list[list[Leaf]], net: Labeller) -> list[np.ndarray]:
    """Whether each leaf belongs to the article. Pages of like length run together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
    a = 0
    while a < len(order):
        b, leaves_ = a, 0
        while b < len(order) and b - a < 128 and leaves_ < 20_000:
            leaves_ += len(pages[order[b]])
            b += 1
        batch = encode([pages[i] for i in order[a:b]])
        said = net.logits(batch) > 0
        for n, i in enumerate(order[a:b]):
            out[i] = said[batch.bounds[n] : batch.bounds[n + 1]]
        a = b
    return out


def extract(pages: DataFrame, net: Labeller) -> DataFrame:
    """The rows of ``pages`` with main_text and blocks (each leaf's text and label). A null or empty page has an empty text.
    Columns of the new names are replaced."""
    pages = pages.drop("main_text", "blocks")
    names, source = pages.columns, pages.columns.index("html")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    sent = pages.sparkSession.sparkContext.broadcast(net)
    kind = pa.list_(pa.struct([("text", pa.string()), ("article", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                held = [leaves(h.as_py() or "") for h in batch.column(source)]
                marks = labelled(held, sent.value)
                texts = ["\n".join(l.text for l, m in zip(p, y.tolist()) if m) for p, y in zip(held, marks)]
                blocks = [[{"text": l.text, "article": m} for l, m in zip(p, y.tolist())] for p, y in zip(held, marks)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(texts, pa.string()), pa.array(blocks, kind)], names=[*names, "main_text", "blocks"]
                )

    return pages.mapInArrow(run, schema + ", main_text string, blocks array<struct<text: string, article: boolean>>")


def op1(pages: DataFrame) -> DataFrame:
    found = extract(pages.select("page_id", "url", "html"), model(pages))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
