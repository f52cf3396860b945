"""Main text of HTML pages by gradient-boosted trees over DOM nodes.

A page is parsed into blocks of text and the elements around them. Each node has features of its
subtree (text and link density, sentences, controls), of its place (depth, siblings, share of the page)
and of its attribute tokens, whose weights are learned. Boosted trees give the probability that a
node holds main text; a tree programme then takes the most likely choice without contradictions: no
node is in whose parent is out, and an element is in only with one of its children.

Training labels come from pages that say what is what by semantic elements (``article``, ``main``
against ``nav``, ``aside``, ``footer``, ...). So that the trees do not learn one template, each such page
is also laid out anew with other elements, names and boilerplate made from the sample's own texts.
"""

from __future__ import annotations

import html
import pickle
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import column, pieces

# Elements by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rt rp s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section summary table ul".split()
)
#: What a start tag closes, and the element within which it does.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}),
}
CONTROLS = frozenset("input button select textarea option form fieldset".split())
MAIN, ASIDE = frozenset(["article", "main"]), frozenset("nav aside footer header form dialog menu".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>")
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
TOKEN = re.compile(r"[a-z]+")
#: Attribute that marks main text in pages made for training; it is no feature.
MARK = " data-main"


@dataclass(frozen=True)
class Settings:
    """Pages that are learned from, layouts made of each; number, depth and step of the trees."""

    pages: int = 400
    layouts: int = 3
    trees: int = 60
    depth: int = 5
    step: float = 0.25
    bins: int = 32
    least: int = 5


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: tuple[str, ...] = ()
    text: str | None = None
    links: int = 0
    main: bool = False
    children: list[int] = field(default_factory=list)


def parse(page: str) -> list[Node]:
    """The nodes of a page in order, parents first; a text block is a node ``#text`` of its element.

    Unclosed elements end where HTML ends them; a tag or comment that the page's end cuts off is left out.
    """
    nodes = [Node("html", -1, 0)]
    stack, parts, links, linked = [0], [], 0, False

    def block():
        nonlocal parts, links
        text = " ".join("".join(parts).split())
        if text:
            at = stack[-1]
            nodes[at].children.append(len(nodes))
            nodes.append(Node("#text", at, nodes[at].depth + 1, text=text, links=min(links, len(text)), main=nodes[at].main))
        parts, links = [], 0

    def close(tags, within=frozenset()):
        for k in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[k]].tag
            if tag in tags:
                block()
                del stack[k:]
                return
            if tag in within:
                return

    at, end = 0, len(page)
    while at < end:
        cut = page.find("<", at)
        if cut != at:
            text = html.unescape(page[at : cut if cut >= 0 else end])
            parts.append(text)
            links += len(text) if linked else 0
            if cut < 0:
                break
        at = cut
        follows = page[at + 1 : at + 2]
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = stop + 3 if stop >= 0 else end
        elif follows in ("!", "?"):
            stop = page.find(">", at)
            at = stop + 1 if stop >= 0 else end
        elif not (follows.isascii() and (follows.isalpha() or follows == "/")):
            parts.append("<")
            at += 1
        elif not (found := TAG.match(page, at)):
            if follows == "/" and not page[at + 2 : at + 3].isalpha():
                stop = page.find(">", at)
                at = stop + 1 if stop >= 0 else end
            else:
                at = end
        else:
            closing, tag, attributes, at = found[1], found[2].lower(), found[3], found.end()
            if closing:
                if tag == "a":
                    linked = False
                elif tag not in INLINE and tag not in VOID:
                    close({tag})
                elif tag == "br":
                    parts.append(" ")
                continue
            if tag in RAW:
                if tag == "textarea":
                    nodes[stack[-1]].children.append(len(nodes))
                    nodes.append(Node(tag, stack[-1], nodes[stack[-1]].depth + 1))
                stop = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(page, at)
                at = end if not stop else (page.find(">", stop.end()) + 1 or end)
            elif tag in INLINE:
                linked = tag == "a" or linked
            elif tag == "br":
                parts.append(" ")
            else:
                block()
                linked = False
                if tag in CLOSES_P:
                    close({"p"}, {"table", "td", "th", "button", "li"})
                if tag in CLOSES:
                    close(*CLOSES[tag])
                if tag in ("html", "body", "head", "hr") or tag in VOID and tag != "input":
                    continue
                own = nodes[stack[-1]]
                tokens = tuple(TOKEN.findall(" ".join(v for _, v in NAMES.findall(attributes)).lower())) if attributes else ()
                own.children.append(len(nodes))
                nodes.append(Node(tag, stack[-1], own.depth + 1, tokens, main=own.main or attributes.endswith(MARK)))
                if tag not in VOID and not attributes.endswith("/"):
                    stack.append(len(nodes) - 1)
    block()
    return nodes


def tokens(node: Node) -> list[str]:
    return ["<" + node.tag, *node.tokens]


def _subtrees(nodes: list[Node]) -> list[list[int]]:
    """Characters, words, characters of links, blocks, elements, sentence marks and controls in every node."""
    sums = [[0] * 7 for _ in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        node, own = nodes[i], sums[i]
        if node.text is not None:
            t = node.text
            own[:] = (len(t), t.count(" ") + 1, node.links, 1, 0, t.count(". ") + t.count(", ") + t.endswith((".", "!", "?")), 0)
        else:
            own[4] += 1
            own[6] += node.tag in CONTROLS
        up = sums[node.parent]
        for k, v in enumerate(own):
            up[k] += v
    return sums


def _places(nodes: list[Node], sums: list[list[int]], weights: dict[str, float]) -> list[tuple]:
    """Depth, token weights of the node and of what it stands in, and its place among its siblings."""
    out, start, told = [], 0, {}
    for i, node in enumerate(nodes):
        tag = weights.get("<" + node.tag, 0.0)
        here = [weights.get(t, 0.0) for t in node.tokens] or [0.0]
        if not i:
            out.append((0, tag, min(here), max(here), 0.0, 0.0, 0.0, 0, 1, 0, 0, 1.0, 0))
            continue
        above = out[node.parent]
        if node.parent not in told:
            family = nodes[node.parent].children
            tags = [nodes[c].tag for c in family]
            counts = {t: tags.count(t) / len(tags) for t in set(tags)}
            told[node.parent] = (family, {c: k for k, c in enumerate(family)}, counts)
        family, order, counts = told[node.parent]
        k = order[i]
        out.append((
            node.depth, tag, min(here), max(here), min(above[1], above[2], above[4]), max(above[1], above[3], above[5]), above[1],
            min(k, 50), len(family), sums[family[k - 1]][0] if k else 0, sums[family[k + 1]][0] if k + 1 < len(family) else 0,
            counts[node.tag], start,
        ))
        start += len(node.text) if node.text is not None else 0
    return out


def features(pages: list[list[Node]], weights: dict[str, float]) -> np.ndarray:
    """One row a node of all pages; the weights are those of tag and attribute tokens."""
    sums = [_subtrees(nodes) for nodes in pages]
    places = np.array([row for nodes, own in zip(pages, sums) for row in _places(nodes, own, weights)], float)
    total = np.maximum(1, np.repeat([own[0][0] for own in sums], [len(own) for own in sums])).astype(float)
    chars, words, links, blocks, elements, marks, controls = np.array([row for own in sums for row in own], float).T
    subtree = [
        np.log1p(chars), np.log1p(words), links / np.maximum(1, chars), chars / np.maximum(1, elements + blocks), chars / total,
        marks / np.maximum(1, words), chars / np.maximum(1, blocks), np.log1p(blocks), np.log1p(controls), chars / np.maximum(1, words),
    ]
    places[:, 8:11] = np.log1p(places[:, 8:11])
    places[:, 12] /= total
    return np.column_stack([*subtree, places])


def held(nodes: list[Node]) -> np.ndarray:
    """Whether main text stands in each node, for pages made for training."""
    y = np.zeros(len(nodes))
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i].text is not None:
            y[i] = nodes[i].main
        if i and y[i]:
            y[nodes[i].parent] = 1
    return y


# Names that sites give to their parts.
CONTENT_NAMES = ("content", "post", "entry", "article", "story", "main", "text", "body", "post content", "entry content", "article body", "page content", "main content")
PART_NAMES = {
    "menu": ("nav", "menu", "navbar", "navigation", "topnav", "main menu", "breadcrumb", "breadcrumbs", "pagination"),
    "header": ("header", "masthead", "top", "site header", "branding", "banner"),
    "footer": ("footer", "bottom", "site footer", "copyright", "legal", "colophon"),
    "sidebar": ("sidebar", "aside", "widget", "side", "related", "recommended", "popular", "trending", "tags"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "adsbox", "banner ad"),
    "notice": ("cookie", "cookies", "notice", "consent", "alert", "gdpr", "popup", "modal", "overlay", "message", "cookie banner"),
    "form": ("form", "newsletter", "subscribe", "signup", "search", "login", "contact"),
    "comments": ("comments", "comment", "comment list", "responses", "replies", "discussion", "disqus", "comment thread", "reader comments"),
    "share": ("share", "social", "sharing", "follow", "byline meta", "toolbar"),
}
PART_TAGS = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "advert": "ins", "notice": "dialog", "form": "form", "comments": "section", "share": "div"}


def _semantic(page: str) -> list[tuple[str, str, bool]]:
    """(tag, text, main) of the blocks of a page that has an element for its main text, else none."""
    nodes, out = parse(page), []
    for node in nodes:
        if node.text is None:
            continue
        up, main = node.parent, False
        while up > 0:
            if nodes[up].tag in ASIDE:
                main = False
                break
            main |= nodes[up].tag in MAIN
            up = nodes[up].parent
        out.append((nodes[node.parent].tag, node.text, main))
    return out if any(main for _, _, main in out) else []


def _laid_out(blocks, spare: list[str], rng: random.Random) -> str:
    """A page with the main blocks under other elements and names, and parts made of spare texts."""
    bare = rng.random() < 0.2

    def wrap(tag, names, inner):
        name = "" if bare or rng.random() < 0.15 else rng.choice(names).replace(" ", rng.choice(" -_"))
        return f"<{tag} {rng.choice(['class', 'class', 'id'])}=\"{name}\">{inner}</{tag}>" if name else f"<{tag}>{inner}</{tag}>"

    def words(most):
        return html.escape(" ".join(rng.choice(spare).split()[: rng.randint(1, most)]))

    def prose():
        return html.escape(rng.choice(spare))

    def items(count):
        return "<ul>" + "".join(f'<li><a href="/x">{words(3)}</a></li>' for _ in range(count)) + "</ul>"

    def inner(kind):
        if kind == "menu" or kind == "sidebar" and rng.random() < 0.5:
            return items(rng.randint(2, 9))
        if kind == "form":
            return f"<label>{words(3)}</label><input><button>{words(2)}</button>"
        if kind == "notice":
            return f"<p>{prose()}</p>" + (f"<button>{words(2)}</button>" if rng.random() < 0.6 else "")
        if kind == "comments":
            tag = rng.choice(["div", "li", "p"])
            name = "" if bare or tag == "p" else ' class="comment"'
            return f"<h3>{words(2)}</h3>" + "".join(f"<{tag}{name}><b>{words(2)}</b> {prose()}</{tag}>" for _ in range(rng.randint(1, 6)))
        if kind == "share":
            return " ".join(f'<a href="/s">{words(2)}</a>' for _ in range(rng.randint(1, 5)))
        if kind == "header":
            return f'<a href="/">{words(3)}</a><p>{words(8)}</p>' if rng.random() < 0.6 else f"<h2>{words(4)}</h2>"
        return rng.choice([prose(), f"<p>{prose()}</p>", f'&copy; {words(4)} <a href="/l">{words(2)}</a>', f"<h4>{words(3)}</h4><p>{prose()}</p>"])

    def part(kind):
        tag = PART_TAGS[kind] if rng.random() < 0.5 else rng.choice(["div", "section"])
        return wrap(tag, PART_NAMES[kind], inner(kind))

    main, short = [], rng.random() < 0.25
    for tag, text, _ in blocks:
        text = " ".join(text.split()[: rng.randint(1, 4)]) if short else text
        tag = tag if tag in ("h1", "h2", "h3", "p", "li", "blockquote", "pre") else rng.choice(["p", "div"])
        if tag == "li" or rng.random() < 0.08:
            main.append(f"<ul><li{MARK}>{html.escape(text)}</li></ul>")
        else:
            main.append(f"<{tag}{MARK}>{html.escape(text)}</{tag}>")
        if rng.random() < 0.03:
            main.append(part(rng.choice(["advert", "share", "notice", "sidebar"])))
    tail = [part(kind) for kind, share in (("share", 0.2), ("comments", 0.35), ("form", 0.15), ("advert", 0.15)) if rng.random() < share]
    within = rng.random() < 0.4
    content = "".join(main + (tail if within else []))
    content = wrap(rng.choice(["article", "article", "main", "div", "section", "div"]), CONTENT_NAMES, content)
    before = [part(k) for k, share in (("notice", 0.3), ("header", 0.6), ("menu", 0.8), ("advert", 0.4), ("form", 0.1)) if rng.random() < share]
    beside = [part("sidebar") for _ in range(rng.choice([0, 0, 1, 2]))]
    after = ([] if within else tail) + [part(k) for k, share in (("menu", 0.1), ("notice", 0.15), ("footer", 0.85)) if rng.random() < share]
    middle = beside + [content] if rng.random() < 0.4 else [content] + beside
    page = "".join(before) + "".join(middle) + "".join(after)
    return f"<html><body>{wrap('div', ('page', 'wrapper', 'container', 'site'), page) if rng.random() < 0.4 else page}</body></html>"


def training_pages(pages: list[str], layouts: int) -> list[list[Node]]:
    """Parsed pages with main text marked: each as it is, and laid out anew."""
    told = [(page, blocks) for page in pages if (blocks := _semantic(page))]
    spare = [t for _, blocks in told for _, t, main in blocks if not main]
    spare += [s for _, blocks in told for _, t, main in blocks if main for s in re.split(r"(?<=[.!?])\s", t)[:2]]
    out = []
    for k, (page, blocks) in enumerate(told):
        nodes = parse(page)
        for node, (_, _, main) in zip((x for x in nodes if x.text is not None), blocks):
            node.main = main
        out.append(nodes)
        rng = random.Random(k)
        out += [parse(_laid_out([b for b in blocks if b[2]], spare, rng)) for _ in range(layouts)]
    return out


@dataclass
class Model:
    """Token weights and boosted trees as arrays: feature, threshold of each inner node, value of each leaf."""

    weights: dict[str, float]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while at.size and at[0] < len(feature):  # all leaves are equally deep
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += value[at - len(feature)]
        return 1 / (1 + np.exp(-total))


def boosted(x: np.ndarray, y: np.ndarray, given: Settings) -> tuple[list, float]:
    """Trees of second-order boosting on the logistic loss, splits at quantile bins."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, given.bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    total, trees = np.full(len(y), base), []
    for _ in range(given.trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(2**given.depth - 1, np.int64), np.full(2**given.depth - 1, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(given.depth):
            first, wide = 2**level - 1, 2**level
            local, best = at - first, np.full(wide, 1e-6)
            for f, e in enumerate(edges):
                size = len(e) + 1
                key = local * size + binned[:, f]
                gs, hs, ns = (np.bincount(key, w, wide * size).reshape(wide, size).cumsum(1) for w in (g, h, np.ones(len(y))))
                gl, hl, nl = gs[:, :-1], hs[:, :-1], ns[:, :-1]
                gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain = np.where((nl >= given.least) & (nt - nl >= given.least), gain, -1.0)
                if not gain.shape[1]:
                    continue
                cut = gain.argmax(1)
                won = gain[np.arange(wide), cut]
                better = won > best
                best = np.where(better, won, best)
                feature[first : first + wide] = np.where(better, f, feature[first : first + wide])
                threshold[first : first + wide] = np.where(better, e[cut], threshold[first : first + wide])
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        leaf = at - len(feature)
        value = given.step * np.bincount(leaf, g, len(feature) + 1) / (np.bincount(leaf, h, len(feature) + 1) + 1)
        total += value[leaf]
        trees.append((feature, threshold, value))
    return trees, base


def trained(pages: list[str], given: Settings = Settings()) -> Model:
    """A model from whole pages; without a page that tells its main text, one that keeps every block."""
    made = training_pages(pages, given.layouts)
    if not made:
        return Model({}, [], 2.0)
    seen: dict[str, list[float]] = {}
    labels = [held(nodes) for nodes in made]
    for nodes, y in zip(made, labels):
        for node, own in zip(nodes, y):
            for t in tokens(node):
                seen.setdefault(t, [0.0, 0.0])[int(own)] += 1
    every = np.sum(list(seen.values()), axis=0) + 1
    weights = {t: float(np.log((b + 1) / every[1]) - np.log((a + 1) / every[0])) for t, (a, b) in seen.items() if a + b >= 3}
    trees, base = boosted(features(made, weights), np.concatenate(labels), given)
    return Model(weights, trees, base)


def decode(nodes: list[Node], p: np.ndarray) -> list[int]:
    """The text nodes of the likeliest choice in which parents of chosen nodes are chosen too."""
    p = np.clip(p, 1e-6, 1 - 1e-6)
    yes, no = np.log(p).tolist(), np.log(1 - p).tolist()
    need = [0.0 if node.text is not None else float("-inf") for node in nodes]  # least loss of taking one child
    inside = [0.0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].parent
        taken = yes[i] + inside[i] + min(0.0, need[i])
        yes[i] = taken
        no[up] += no[i]
        inside[up] += max(taken, no[i])
        need[up] = max(need[up], taken - no[i])
    yes[0] += inside[0] + min(0.0, need[0])
    out, todo = [], [0] if yes[0] > no[0] else []
    while todo:
        i = todo.pop()
        if nodes[i].text is not None:
            out.append(i)
            continue
        chosen = [c for c in nodes[i].children if yes[c] > no[c]]
        todo += chosen or [max(nodes[i].children, key=lambda c: yes[c] - no[c])]
    return sorted(out)


def fit(pages: DataFrame, settings: Settings = Settings(), key: str = "page_id", text: str = "html") -> Model:
    """Learns from ``settings.pages`` whole pages that name their main element, those of least hash."""
    told = pages.select(F.xxhash64(key, text).alias("h"), F.col(text).alias("page")).filter(F.col("page").rlike(r"(?i)<(article|main)[\s>]"))
    sample = told.orderBy("h", "page").limit(settings.pages).select("page")

    def run(batches):
        held = [t for batch in batches for t in column(batch, "page").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trained(held, settings))], pa.binary())], ["model"])

    return pickle.loads(sample.coalesce(1).mapInArrow(run, "model binary").first()["model"])


def extract(pages: DataFrame, model: Model, key: str = "page_id", text: str = "html", carry: tuple[str, ...] = ("url",)) -> DataFrame:
    """``key``, the columns to ``carry`` and the main ``text`` of every page: its blocks, one a line.

    A NULL or empty page has an empty text; each row is read by itself, so repeated rows stay.
    """
    names = [key, *carry]
    kinds = dict(pages.dtypes)
    picked = pages.select(*names, F.col(text).alias("_page"))

    def run(batches):
        for batch in pieces(batches, "_page"):
            parsed = [parse(page or "") for page in column(batch, "_page").to_pylist()]
            p, at, out = model.probability(features(parsed, model.weights)), 0, []
            for nodes in parsed:
                own = p[at : at + len(nodes)]
                at += len(nodes)
                out.append("\n".join(nodes[i].text for i in decode(nodes, own)) if len(nodes) > 1 else "")
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in names], pa.array(out, pa.string())], [*names, "text"])

    return picked.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", text string")
