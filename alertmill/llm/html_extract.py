"""Main text of web pages by minimum cut.

A page becomes blocks of text in page order. A classifier of their shape and the marks of their surroundings give each block
a cost for either label, which become capacities to the two terminals; neighbours in the page, and blocks that share a
container, are tied by smoothness edges. The maximum flow finds the cheapest labelling; the content side is the text.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.llm.common import arrow_map, shared
from alertmill.llm.warc import END, TAG

#: Pages that the classifier is fitted on (expected number, chosen by hash), and how many blocks their evidence may outweigh the prior.
FIT_PAGES, EVIDENCE = 4096, 500.0
#: Capacities are whole multiples of 1/SCALE.
SCALE = 1000
#: Costs of surroundings, the bound on the classifier's say, and the ties between neighbours and to shared containers.
OUT, INSIDE, OUTSIDE, NAMED, SHAPE = -9.0, 4.0, -5.0, 2.0, 3.0
NEAR, SHARED = 3.0, 1.0

# fixed values: elements without text of their own page, up to their end tag; those of the first line run to the page's end if they lack one
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
DROPPED = RAW | frozenset("noscript template svg math canvas object audio video select datalist button head".split())
# fixed values: elements that stand on lines of their own, and those that their like ends
BLOCKS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
LIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
FENCES = frozenset("ul ol menu dir dl table article section main nav aside body div form".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# fixed values: elements and roles that are no part of an article, and those that hold one
OUT_TAGS, OUT_ROLES = frozenset("nav footer aside form menu dialog fieldset search".split()), frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert status menu menubar toolbar tablist".split())
MAIN_ROLES = frozenset(("main", "article"))
# fixed values: words in class names and ids
OUT_WORDS = re.compile(
    r"(?:\w*nav|nav(?:bar|igation|list|links?)?|\w*menus?|menu\w*|breadcrumbs?|crumbs?|pagination|pager|masthead|topbar|\w*banners?|foot|footers?|\w{2,}footer|side|sidebars?\w*|\w{2,}sidebar|rail|related|recommend\w*|popular|trending"
    r"|aside|widgets?|ads?|adv|advert\w*|adbox|adsense|adslot|adunit|sponsor\w*|promos?|promot\w*|outbrain|taboola|cookies?\w*|consent|gdpr|ccpa|notices?|notifications?|alerts?|popups?|modals?|overlays?|lightbox|newsletters?|subscri\w*|signup|signin|login|register|search\w*"
    r"|share|sharing|social\w*|follow|comments?|comment\w*|disqus|respond|repl(?:y|ies)|discussions?|responses?|reactions?|feedback|forms?|toolbars?|copyright|legal|disclaimer|skip|hidden"
    r"|kommentare?|werbung|anzeigen?|hinweise?|commentaires?|publicite|comentarios?|publicidad)"
)
IN_WORDS = re.compile(r"(?:articles?|\w*article|posts?|blogpost|entry|hentry|story|content|contents|maincontent|main|body|text|prose|articlebody|post(?:body|content|text))")
HEAD_WORDS = frozenset(("header", "head", "heading", "pageheader", "siteheader"))
LAYOUT_WORDS = frozenset(("with", "has", "no", "without", "is", "not", "elementor"))
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
ATTR = re.compile(r"(?i)(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
UNSEEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")


# -- pages as blocks


def mark(name: str, rest: str) -> int:
    """What an element's tag and attributes say of its text: -1 no part of the article, 1 an article's name, 2 a landmark, 0 nothing."""
    out = -1 if name in OUT_TAGS else 2 if name in ("article", "main") else 0
    if not rest or rest == ">" or name in ("html", "body"):
        return out
    named = 0
    for key, *values in ATTR.findall(rest):
        key, value = key.lower(), "".join(values)
        if key == "role":
            role = value.strip().lower()
            out = -1 if role in OUT_ROLES else max(out, 2) if role in MAIN_ROLES else out
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and UNSEEN.search(value):
            return -1
        elif key in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in NAMES.findall(one)]
                if LAYOUT_WORDS.intersection(words):
                    continue
                good = any(IN_WORDS.fullmatch(w) for w in words)
                if any(OUT_WORDS.fullmatch(w) for w in (*words, "".join(words))) or not good and HEAD_WORDS.intersection(words):
                    named = -1
                elif good and not named:
                    named = 1
    if named < 0 and name not in ("main", "article", *HEADINGS) or named < 0 and out == 2 and name == "article":
        return -1
    return out or max(named, 0)


class Box:
    """An open or closed element that holds blocks."""

    __slots__ = ("name", "up", "depth", "mark", "plain", "mains")

    def __init__(self, name: str, up: Box | None, mark: int):
        self.name, self.up, self.depth, self.mark, self.plain, self.mains = name, up, up.depth + 1 if up else 0, mark, 0, 0


class Piece:
    """A block: its text, the share of it inside links, and its box."""

    __slots__ = ("text", "linked", "box")

    def __init__(self, text: str, linked: float, box: Box):
        self.text, self.linked, self.box = text, linked, box


def blocks_of(markup: str) -> list[Piece]:
    """The blocks of a page in page order. Tags that are not closed end where their like or their container does, stray end tags
    count for nothing; references are decoded, white space becomes one space, blocks without other characters are none."""
    root = box = Box("", None, 0)
    out: list[Piece] = []
    boxes, text = [root], []
    linked, in_link, at, size = 0, None, 0, len(markup)

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                share = min(1.0, linked / len(whole))
                out.append(Piece(whole, share, box))
                box.plain += int(len(whole) * (1 - share))
            text.clear()
        linked = 0

    def close(to: Box) -> None:
        nonlocal box, in_link
        if in_link is not None and in_link.depth > to.depth:
            in_link = None
        box = to

    def add(raw: str) -> None:
        nonlocal linked
        if "&" in raw:
            raw = html.unescape(raw)
        text.append(raw)
        if in_link is not None:
            linked += len(raw)

    while (m := TAG.search(markup, at)) is not None:
        if m.start() > at:
            add(markup[at : m.start()])
        at = m.end()
        comment, end, name, rest = m.groups()
        if comment:
            stop = markup.find("-->", max(m.start() + 4, at - 1))
            at = size if stop < 0 else stop + 3
            continue
        if not name:
            continue
        name = name.lower()
        if name in DROPPED:
            if not end and not rest.endswith("/>"):
                stop = (END.get(name) or END.setdefault(name, re.compile(rf"(?i)</{name}\s*+>"))).search(markup, at)
                if stop:
                    at = stop.end()
                elif name in RAW:
                    at = size
            text.append(" ")
        elif name in BLOCKS:
            flush()
            if end:
                up = box
                while up is not None and up.name != name and not (name in LIKE and up.name in FENCES):
                    up = up.up
                if up is not None and up.name == name:
                    close(up.up)
                continue
            if name == "p" or name not in LIKE:
                inner = box
                while inner.up is not None and inner.name not in FENCES and inner.name != "p":
                    inner = inner.up
                if inner.name == "p":
                    close(inner.up)
            elif name in LIKE:
                inner, last = box, None
                while inner is not None and inner.name not in FENCES:
                    if inner.name in LIKE[name]:
                        last = inner
                    inner = inner.up
                if last is not None:
                    close(last.up)
            if name != "html":
                box = Box(name, box, mark(name, rest))
                boxes.append(box)
        elif name == "a":
            in_link = None if end else box
        elif name in ("br", "wbr", "hr"):
            if name == "hr":
                flush()
            elif name == "br":
                text.append(" ")
    if at < size:
        add(markup[at:])
    flush()
    for b in reversed(boxes[1:]):
        b.up.plain += b.plain
        b.up.mains += b.mains + (b.name == "main")
    # what wraps the whole page is no form, and what holds the main element is no sidebar
    for b in boxes:
        if b.mark < 0 and (b.mains or b.name == "form" and 2 * b.plain > root.plain > 0):
            b.mark = 0
    return out


def surroundings(pieces: list[Piece]) -> list[int]:
    """For each block: -1 inside what is no part of an article, 2 inside a landmark, 1 inside what is named like an article, 0 else;
    on pages with a landmark, -2 outside of it."""
    out, known = [], {}
    for piece in pieces:
        trail, up = [], piece.box
        while up is not None and up not in known:
            trail.append(up)
            up = up.up
        got = known[up] if up is not None else 0
        for b in reversed(trail):
            inside_article = got == 2
            # an article's own header holds its title
            own = b.mark if not (b.name == "header" and b.mark >= 0) else 0 if inside_article or b.up and b.up.mark == 1 else -1
            got = -1 if got == -1 or own == -1 else max(got, own)
            known[b] = got
        out.append(got)
    if any(x == 2 for x in out):
        out = [x if x in (-1, 2) else -2 for x in out]
    return out


# -- the classifier of shapes


#: The bins of each feature with the prior weight of each: length, share of links, sentence end, comma, kind of element, copyright sign.
PRIOR = {"size": (-1.2, -0.7, 0.0, 0.8, 1.4, 1.8), "links": (0.5, 0.0, -1.2, -2.5), "ends": (-0.4, 0.8), "comma": (0.0, 0.3), "kind": (0.6, 1.0, -0.6, -0.3, -0.4), "rights": (0.0, -2.0)}
WEIGHTS = np.concatenate([np.array(x) for x in PRIOR.values()])
STARTS = np.cumsum([0, *(len(x) for x in PRIOR.values())])[:-1].tolist()
KINDS = {**dict.fromkeys(HEADINGS, 0), **dict.fromkeys(("p", "pre", "blockquote"), 1), **dict.fromkeys(("li", "dt", "dd"), 2), **dict.fromkeys(("td", "th", "caption"), 3)}


def shape(piece: Piece) -> tuple[int, ...]:
    """The bin of each feature."""
    n, text, linked = len(piece.text), piece.text, piece.linked
    size = 0 if n < 10 else 1 if n < 30 else 2 if n < 80 else 3 if n < 200 else 4 if n < 500 else 5
    return (size, 0 if linked == 0 else 1 if linked < 0.2 else 2 if linked < 0.5 else 3, int(text.rstrip("\"')]»”’")[-1:] in ".!?…。！？:;"), int("," in text or "、" in text), KINDS.get(piece.box.name, 4), int("©" in text))


def fitted(counts: list[tuple[tuple[int, ...], int, int]], strength: float = 1.0) -> np.ndarray:
    """The most likely weights after (bins, label, count) under a normal prior around ``PRIOR``, by Newton steps; both labels
    weigh as much as the rarer one, and ``EVIDENCE`` blocks together at most. Without examples of either they are the prior's."""
    totals = [sum(c[2] for c in counts if c[1] == label) for label in (0, 1)]
    if not all(totals):
        return WEIGHTS
    x = np.zeros((len(counts), len(WEIGHTS)))
    for row, (bins, _, _) in zip(x, counts):
        row[np.add(bins, STARTS)] = 1
    y, n = np.array([c[1] for c in counts], float), np.array([c[2] for c in counts], float)
    n *= min(EVIDENCE / 2, *totals) / np.array(totals)[y.astype(int)]
    w = WEIGHTS.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), x.T @ (n * (y - p)) - strength * (w - WEIGHTS))
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(pages: DataFrame, html_col: str = "html", most: int = FIT_PAGES) -> np.ndarray:
    """Weights from about ``most`` pages, chosen by the hash of their markup; blocks in landmarks are examples of content, those
    in menus and the like of boilerplate, others of neither. Counts of equal bins are added up on the executors; their number is bounded by the bins."""
    n = pages.count()
    rows = pages.select(F.col(f"`{html_col}`").cast("string").alias("html")).where("html is not null")
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < int((1 << 20) * most / n))
    names = list(PRIOR)

    def step(batch):
        counts = Counter()
        for markup in batch.column("html").to_pylist():
            pieces = blocks_of(markup)
            counts.update((shape(p), int(s == 2)) for p, s in zip(pieces, surroundings(pieces)) if s in (-1, 2))
        keys = list(counts)
        return {**{c: [k[0][i] for k in keys] for i, c in enumerate(names)}, "label": [k[1] for k in keys], "n": [counts[k] for k in keys]}

    found = arrow_map(rows, ", ".join(f"{c} int" for c in [*names, "label"]) + ", n long", step, "html").groupBy(*names, "label").agg(F.sum("n").alias("n")).orderBy(*names, "label").collect()
    return fitted([(tuple(r[c] for c in names), r["label"], r["n"]) for r in found])


# -- the cut


def min_cut(costs: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """Which nodes are on the source side of the minimum cut with most nodes there, by the maximum flow (Dinic's algorithm).

    A node with a positive cost is tied to the source, with a negative one to the sink; ``edges`` tie nodes both ways.
    """
    n = len(costs)
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[int] = []
    links: list[list[int]] = [[] for _ in range(n + 2)]

    def tie(a: int, b: int, there: int, back: int) -> None:
        links[a].append(len(to))
        to.append(b)
        cap.append(there)
        links[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, c in enumerate(costs):
        if c > 0:
            tie(source, i, c, 0)
        elif c < 0:
            tie(i, sink, -c, 0)
    for (a, b), w in edges.items():
        tie(a, b, w, w)
    while True:
        # distances to the sink, so that what cannot reach it is known at the end
        level = [-1] * (n + 2)
        level[sink], queue = 0, [sink]
        for u in queue:
            far = level[u] + 1
            for e in links[u]:
                v = to[e]
                if level[v] < 0 and cap[e ^ 1]:
                    level[v] = far
                    queue.append(v)
        if level[source] < 0:
            return [x < 0 for x in level[:n]]
        turn, path, u = [0] * (n + 2), [], source
        while True:
            if u == sink:
                least = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= least
                    cap[e ^ 1] += least
                k = next(i for i, e in enumerate(path) if not cap[e])
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            own, i = links[u], turn[u]
            while i < len(own) and not (cap[own[i]] and level[to[own[i]]] == level[u] - 1):
                i += 1
            turn[u] = i
            if i < len(own):
                path.append(own[i])
                u = to[own[i]]
            elif path:
                u = to[path.pop() ^ 1]
                turn[u] += 1
            else:
                break


def network(pieces: list[Piece], weights: np.ndarray) -> tuple[list[int], dict[tuple[int, int], int]]:
    """Costs (blocks first, then containers, which have none) and smoothness edges of a page."""
    table = weights.tolist()
    shapes: dict[tuple[int, ...], float] = {}
    costs = []
    for piece, near in zip(pieces, surroundings(pieces)):
        bins = shape(piece)
        u = shapes.get(bins)
        if u is None:
            u = shapes[bins] = max(-SHAPE, min(SHAPE, sum(table[s + b] for s, b in zip(STARTS, bins))))
        costs.append(round(SCALE * (u + {-1: OUT, -2: OUTSIDE, 0: 0.0, 1: NAMED, 2: INSIDE}[near])))
    edges: dict[tuple[int, int], int] = {}
    for i in range(len(pieces) - 1):
        a, b, steps = pieces[i].box, pieces[i + 1].box, 0
        while a is not b:
            if a.depth >= b.depth:
                a = a.up
            else:
                b = b.up
            steps += 1
        edges[i, i + 1] = round(SCALE * NEAR / (1 + steps / 2))
    # a block hangs on what holds its element, that on its own holder; holders without a second branch tie nothing
    tied, number = round(SCALE * SHARED), {}
    for i, piece in enumerate(pieces):
        up, child, w = piece.box.up or piece.box, i, tied
        while up is not None:
            new = up not in number
            holder = number.setdefault(up, len(pieces) + len(number))
            edges[child, holder] = edges.get((child, holder), 0) + w
            if not new:
                break
            child, up, w = holder, up.up, tied // 2
    return costs + [0] * len(number), edges


def main_text(markup: str, weights: np.ndarray = WEIGHTS) -> str:
    """The blocks on the content side of the cut, in page order, one a line."""
    pieces = blocks_of(markup)
    if not pieces:
        return ""
    content = min_cut(*network(pieces, weights))
    return "\n".join(p.text for p, keep in zip(pieces, content) if keep)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the page's main text and its length in code points.

    A null page is empty, and a page without main text has the empty text; null ids and URLs stay null, repeated rows give
    equal rows, other columns are ignored, an empty table gives no rows. Without ``weights`` the classifier is fitted first.
    """
    sent = shared(pages.sparkSession, fit(pages, html_col) if weights is None else weights)
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))

    def step(batch):
        text = [main_text(x, sent.value) for x in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": text, "n_chars": [len(x) for x in text]}

    return arrow_map(rows, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long", step, "html")


def op12_html_extraction(spark, sf_dir):
    """All of ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
