"""Main text of web pages by a tree-structured graphical model.

Each block element of a page is a node of a tree with a hidden label, content
or not.  A node's features (tag, class words, link density, text length) give
its unary potential, parent and child labels are tied by a potential per kind
of child, and sum-product message passing, once upward and once downward,
yields exact marginals.  Text blocks whose element's marginal reaches 0.5 are
the main text.

The potentials are trained from labelled pages: pages that mark their article
(``article``, ``main`` or ``itemprop=articleBody``) label their own nodes, with
navigation, asides, adverts, forms and comments inside it as negatives.  Each such
page teaches three times: as it is, with the marked element turned into a plain
``div`` without names, and with that element taken away, so that its blocks stand
beside menus and footers in what is around it.  The model thus learns pages that
mark nothing, too.  Class words count as whole tokens only, and never against a
marked article itself.  At most ``MAX_LABELLED`` pages are read for that, those with
the smallest hash of their id; their counts are summed by Spark and are bounded by
the feature set.

A page with text outside of menus, forms and the like, none of which reaches 0.5,
gives the blocks next to the likeliest of them: pages with prose are never empty.

Defined results: a null, empty or text-free page gives an empty text; broken
and truncated markup is read as far as it goes (open elements end with the
page) in time linear in the page; elements that the page hides (``hidden``,
``display:none``) have no text; repeated rows give equal results; an empty table
trains the prior model; extra columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: documented bound of the pages that the potentials are trained on
MAX_LABELLED = 4_000

# Fixed sets of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title noembed noframes xmp".split())
#: elements read like others, but without text: controls
MUTE = frozenset("select datalist".split())
#: elements that stand in a line though they are KNOWN tags
INLINE = frozenset(["label"])
SECTIONS = frozenset("body div section article main aside nav header footer form ul ol dl table "
                     "tbody thead tfoot tr fieldset details dialog menu search".split())
KNOWN = SECTIONS | frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th caption figure "
                             "figcaption address summary label button center".split())
#: elements that begin a block; all others, unknown ones too, stand in a line
BLOCKS = (KNOWN | frozenset("dir dd dt fieldset hgroup legend listing optgroup option plaintext slot "
                            "colgroup rt rp ruby frameset frame".split())) - INLINE
#: an opening tag that ends an open paragraph, and items that end their like
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure "
                     "footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table "
                     "ul".split())
LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
        "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

TAG = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s/=]|\Z)|style\s*=\s*["']?[^"'>]*(?:display\s*:\s*none|visibility\s*:\s*hidden)""",
                    re.I)
QUOTED = re.compile(r"""(?<!style=)"[^"]*"|(?<!style=)'[^']*'""", re.I)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
# Fixed words of class tokens.  A token is bad as a whole: each of its parts
# between hyphens is listed, at least one of them as bad; a part's head or foot
# ("section-header") is not, and words for content count after a bad word only.
BAD_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertisements advertising sponsor sponsors sponsored "
    "sponsoring promo promos promotion promotions promoted nav navs navbar navigation navlist navmenu "
    "subnav topnav menu menus menubar menuitem submenu breadcrumb breadcrumbs foot footer footers header "
    "masthead side sidebar sidebars sidenav widget widgets widgetarea related recommend recommended "
    "recommendation recommendations share sharing social cookie cookies cookiebar consent notice notices "
    "banner banners alert alerts popup modal comment comments commentlist reply replies disqus form forms "
    "login signup subscribe subscription newsletter search searchbar searchbox searchform pager pagination "
    "copyright legal hidden".split())
HEADS = frozenset("header foot footer footers".split())
PLACES = frozenset("site page global top bottom left right main primary secondary sticky fixed mobile "
                   "desktop us".split())
PARTS = frozenset("wrap wrapper container area region section block box bar row col column group list "
                  "item items link links inner outer slot unit respond button buttons btn icon icons "
                  "media policy numbers children depth even odd level".split())
CONTENT = frozenset("content body text title articles stories posts author meta metadata".split())
GOOD_WORDS = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main|post|entry|story|text|body)(?:$|[\s_-])",
                        re.I)


def bad_names(names: str) -> bool:
    """Whether a class, id or role word names something besides the article."""
    return any(_bad_token([x for x in re.split("[_-]+", token) if x]) for token in names.lower().split())


def _bad_token(parts: list[str]) -> bool:
    bad = False
    for x, before in zip(parts, ["", *parts]):
        if x in BAD_WORDS:
            bad = bad or not (x in HEADS and before in PARTS)
        elif not (x in PLACES or x in PARTS or x.isdigit() or bad and x in CONTENT):
            return False
    return bad


@dataclass
class Node:
    tag: str
    parent: int
    names: str = ""             # class, id and role words
    own: int = 0                # characters of own text
    linked: int = 0             # of them inside links
    marks: bool = False         # the page marks this element as its article


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, list[str]]] = field(default_factory=list)  # (node, text parts)


class _Open:
    """Open elements of a page; knows at once whether a name is open."""

    def __init__(self):
        self.stack: list[tuple[str, int, bool]] = [("body", 0, False)]  # name, block node, mute
        self.count: Counter = Counter()         # open blocks by name
        self.inline = [Counter()]               # open inline elements within each open block
        self.near = [Counter()]                 # open blocks by name within each open section
        self.links = self.mute = 0

    def push(self, name: str, node: int, mute: bool) -> None:
        self.stack.append((name, node, mute))
        self.mute += mute
        self.links += name == "a"
        if name not in BLOCKS:
            self.inline[-1][name] += 1
            return
        self.count[name] += 1
        self.inline.append(Counter())
        if name in SECTIONS:
            self.near.append(Counter())
        else:
            self.near[-1][name] += 1

    def pop(self) -> str:
        name, _node, mute = self.stack.pop()
        self.mute -= mute
        self.links -= name == "a"
        if name not in BLOCKS:
            self.inline[-1][name] -= 1
            return name
        self.count[name] -= 1
        self.inline.pop()
        if name in SECTIONS:
            self.near.pop()
        else:
            self.near[-1][name] -= 1
        return name

    def is_open(self, name: str) -> bool:
        return (self.count if name in BLOCKS else self.inline[-1])[name] > 0


def _hides(attributes: str) -> bool:
    if "hidden" not in attributes.lower() and "none" not in attributes.lower():
        return False
    return bool(HIDDEN.search(QUOTED.sub('""', attributes)))


def parse(source: str) -> Page:
    """Block elements and text blocks of a page, in page order."""
    page = Page([Node("body", -1)])
    opened = _Open()
    fresh, at, end = True, 0, len(source)

    def text(piece: str) -> None:
        nonlocal fresh
        if not piece or opened.mute:
            return
        node = opened.stack[-1][1]
        if fresh:
            page.blocks.append((node, []))
            fresh = False
        page.blocks[-1][1].append(piece)
        size = len(piece.strip())
        page.nodes[node].own += size
        if opened.links:
            page.nodes[node].linked += size

    def close(names) -> None:
        """Close up to and with the innermost of ``names``."""
        nonlocal fresh
        while True:
            name = opened.pop()
            fresh = fresh or name in BLOCKS
            if name in names:
                return

    while at < end:
        tag = TAG.search(source, at)
        text(html.unescape(source[at:tag.start() if tag else end]))
        if not tag:
            break
        at = tag.end()
        closing, name, attributes = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        if not name:
            continue                    # a comment, doctype or stray close
        name, attributes = name.lower(), attributes or ""
        if closing:
            if opened.is_open(name):    # an inline end does not leave its block
                close({name})
            continue
        if name in ("html", "body", "head"):
            continue
        if name in RAW:                 # to its end tag, whatever stands between
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = stop.end() if stop else end
            continue
        if name in VOID:
            if name == "br":
                text("\n")
            elif name == "hr":
                fresh = True
            continue
        ends = LIKE.get(name, set()) | ({"p"} if name in CLOSES_P else set())
        if any(opened.near[-1][e] for e in ends if e not in SECTIONS) or name == "tr" and opened.stack[-1][0] == "tr":
            close({e for e in ends if e in SECTIONS or opened.near[-1][e]})
        mute = name in MUTE or _hides(attributes)
        if name not in BLOCKS:
            opened.push(name, opened.stack[-1][1], mute)
            continue
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        names = " ".join(html.unescape(found.get(k, "")) for k in ("class", "id", "role"))
        page.nodes.append(Node(name, opened.stack[-1][1], names, marks=name in ("article", "main")
                               or found.get("itemprop", "").lower() == "articlebody"))
        opened.push(name, len(page.nodes) - 1, mute)
        fresh = True
    return page


def bad_elements(page: Page) -> list[bool]:
    """Whether each node's names are bad.  Names do not count against an element
    that the page marks as its article; an article inside an article (a comment)
    or inside something else than content has no such claim."""
    inside: list[str] = []          # "": neutral ground, "article", or "bad"
    out = []
    for node in page.nodes:
        above = inside[node.parent] if node.parent >= 0 else ""
        claimed = node.marks and (above == "" or above == "article" and node.tag != "article")
        bad = not claimed and bad_names(node.names)
        out.append(bad)
        inside.append("bad" if bad or above == "bad" or node.tag in NEGATIVE and not claimed
                      else "article" if node.marks and node.tag != "main" else above)
    return out


def features(page: Page) -> list[list[str]]:
    """Features of each node; text sizes are summed over the subtree."""
    total = [n.own for n in page.nodes]
    linked = [n.linked for n in page.nodes]
    for i in range(len(page.nodes) - 1, 0, -1):
        total[page.nodes[i].parent] += total[i]
        linked[page.nodes[i].parent] += linked[i]
    out, bad_ones = [], bad_elements(page)
    for i, node in enumerate(page.nodes):
        bad, good = bad_ones[i], GOOD_WORDS.search(node.names)
        out.append([f"tag={node.tag if node.tag in KNOWN else 'other'}",
                    "names=" + ("bad" if bad else "good" if good else "none"),
                    f"links={min(4, linked[i] * 5 // total[i]) if total[i] else 'none'}",
                    f"size={min(6, int(math.log2(1 + total[i])) // 2)}"])
    return out


def _kind(node: Node) -> str:
    return "section" if node.tag in SECTIONS else "text"


def tie(node: Node) -> str:
    """The kind of a node's tie to its parent; the page itself ties in its own way, as
    its text may stand beside all that is not."""
    return _kind(node) + ("@page" if node.parent == 0 else "")


NEGATIVE = frozenset("nav aside footer header form menu dialog search fieldset button".split())


def own_labels(page: Page) -> list[int] | None:
    """Labels that a page with a marked article gives its nodes."""
    if not any(n.marks for n in page.nodes):
        return None
    labels = []
    for node, named in zip(page.nodes, bad_elements(page)):
        above = labels[node.parent] if node.parent >= 0 else 0
        bad = node.tag in NEGATIVE or named
        labels.append(0 if bad else 1 if node.marks or above else 0)
    return labels


def variants(page: Page) -> list[tuple[Page, list[int]]]:
    """What a labelled page teaches: itself, with its marked elements as plain
    ``div``, and without them (their blocks stand in what is around them)."""
    labels = own_labels(page)
    if labels is None:
        return []
    masked = Page([replace(n, tag="div", names="", marks=False) if n.marks and y else n
                   for n, y in zip(page.nodes, labels)])
    kept, place, nodes, own = [], [], [], []
    for i, (node, y) in enumerate(zip(page.nodes, labels)):
        up = place[node.parent] if node.parent >= 0 else -1
        if i and node.marks and y:          # gone: what it held belongs to the parent
            place.append(up)
            nodes[up] = replace(nodes[up], own=nodes[up].own + node.own, linked=nodes[up].linked + node.linked)
            own[up] = 1
        else:
            place.append(len(nodes))
            nodes.append(replace(node, parent=up, marks=False))
            own.append(y)
    return [(page, labels), (masked, labels), (Page(nodes), own)]


def counts(page: Page) -> Counter:
    """Feature and parent-child label counts of one labelled page."""
    out: Counter = Counter()
    for shown, labels in variants(page):
        for node, own, y in zip(shown.nodes, features(shown), labels):
            kind = _kind(node)
            out[f"{kind}|{y}"] += 1
            for f in own:
                out[f"{kind}|{f}|{y}"] += 1
            if node.parent >= 0:
                out[f"{tie(node)}|{labels[node.parent]}|{y}"] += 1
    return out


#: prior counts, so that a corpus without labelled pages has a model too
PRIOR = {"section|0|0": 40, "section|0|1": 4, "section|1|1": 80, "section|1|0": 3,
         "text|0|0": 40, "text|0|1": 6, "text|1|1": 60, "text|1|0": 3,
         "section@page|0|0": 40, "section@page|0|1": 10, "section@page|1|1": 10, "section@page|1|0": 30,
         "text@page|0|0": 40, "text@page|0|1": 6, "text@page|1|1": 60, "text@page|1|0": 3,
         **{f"section|tag={t}|1": 12 for t in ("article", "main")},
         **{f"section|tag={t}|{y}": 12 for t in ("div", "section", "body", "ul", "ol", "table", "tr") for y in (0, 1)},
         **{f"section|tag={t}|0": 40 for t in ("nav", "aside", "footer", "header", "form", "menu")},
         **{f"text|tag={t}|{y}": 12 for t in ("p", "h1", "h2", "h3", "li", "td", "other") for y in (0, 1)},
         **{f"text|tag={t}|1": 12 for t in ("blockquote", "pre")}, "text|tag=button|0": 12,
         **{f"{k}|names={v}|{y}": n for k in ("section", "text")
            for v, y, n in (("bad", 0, 60), ("good", 1, 12), ("none", 0, 60), ("none", 1, 60))},
         **{f"{k}|links={v}|{y}": n for k in ("section", "text")
            for v, y, n in (("4", 0, 60), ("4", 1, 3), ("3", 0, 20), ("3", 1, 4), ("2", 0, 10), ("2", 1, 6),
                            ("1", 0, 10), ("1", 1, 16), ("0", 0, 30), ("0", 1, 60), ("none", 0, 10), ("none", 1, 10))},
         **{f"{k}|size={v}|{y}": n for k in ("section", "text")
            for v, y, n in ((0, 0, 10), (0, 1, 8), (1, 0, 40), (1, 1, 6), (2, 0, 40), (2, 1, 12), (3, 0, 20), (3, 1, 30),
                            (4, 0, 6), (4, 1, 40), (5, 0, 4), (5, 1, 30), (6, 0, 4), (6, 1, 30))},
         **{f"{k}|{y}": 160 for k in ("section", "text") for y in (0, 1)}}
#: how far one feature may move a node's log-odds, down and up: pages of one layout
#: would make single features certain, and a text element is content because of
#: where it stands, so that its own features speak rather against it
LIMITS = {"section": {"tag": (-2.0, 3.0), "names": (-9.0, 4.0), "links": (-5.0, 1.0), "size": (-1.0, 1.0)},
          "text": {"tag": (-1.0, 1.0), "names": (-9.0, 1.0), "links": (-5.0, 1.0), "size": (-1.0, 1.0)}}
#: tags that say nothing by themselves: they hold menus here and text there
PLAIN = frozenset(f"tag={t}" for t in "body div section ul ol dl table tbody thead tfoot tr li td th other".split())
#: most that a child follows its parent
FOLLOWS = {"section": 0.985, "text": 0.997}
WIDTH = {"tag": 60, "names": 3, "links": 6, "size": 7}
#: added to each count; names hardly ever deceive
SMOOTH = {"tag": 0.5, "names": 0.02, "links": 0.5, "size": 0.5}


class ContentModel:
    """Potentials from summed counts."""

    def __init__(self, summed: dict[str, int]):
        n = Counter(PRIOR)
        n.update(summed)
        self.summed, self.n, self.unary = summed, n, {}
        self.pair = {}
        for kind in ("section", "text", "section@page", "text@page"):
            most = FOLLOWS[kind.split("@")[0]]
            for up in (0, 1):
                seen = [n[f"{kind}|{up}|{y}"] + 0.5 for y in (0, 1)]
                share = min(most, max(1 - most, seen[1] / sum(seen)))
                self.pair[kind, up] = [math.log(1 - share), math.log(share)]

    def potential(self, feature: str, kind: str) -> float:
        """Log-odds of content that one feature of a node gives."""
        name = feature.split("=")[0]
        if (feature, kind) not in self.unary:
            more = SMOOTH[name]
            odds = [math.log((self.n[f"{kind}|{feature}|{y}"] + more)
                             / (self.n[f"{kind}|{y}"] + more * WIDTH[name])) for y in (0, 1)]
            low, high = (-0.5, 0.5) if feature in PLAIN else LIMITS[kind][name]
            self.unary[feature, kind] = max(low, min(high, odds[1] - odds[0]))
        return self.unary[feature, kind]

    def unaries(self, page: Page) -> list[list[float]]:
        """Log potentials of each node's two labels."""
        return [[0.0, sum(self.potential(f, _kind(node)) for f in own)]
                for node, own in zip(page.nodes, features(page))]

    def marginals(self, page: Page) -> list[float]:
        """P(content) of each node by sum-product on the tree."""
        nodes, up = page.nodes, self.unaries(page)
        message = [[0.0, 0.0] for _ in nodes]       # to the parent, by parent label
        for i in range(len(nodes) - 1, 0, -1):      # children come after their parents
            kind, parent = tie(nodes[i]), nodes[i].parent
            for y in (0, 1):
                t = self.pair[kind, y]
                message[i][y] = _log_sum(t[0] + up[i][0], t[1] + up[i][1])
                up[parent][y] += message[i][y]
        down = [[0.0, 0.0] for _ in nodes]
        out = []
        for i, node in enumerate(nodes):
            if i:
                # the parent's belief without this child's own message
                rest = [up[node.parent][y] + down[node.parent][y] - message[i][y] for y in (0, 1)]
                for y in (0, 1):
                    down[i][y] = _log_sum(*[rest[z] + self.pair[tie(node), z][y] for z in (0, 1)])
            z = up[i][0] + down[i][0] - up[i][1] - down[i][1]
            out.append(1 / (1 + math.exp(max(-700.0, min(700.0, z)))))
        return out

    def extract(self, source: str | None) -> str:
        page = parse(source or "")
        share = self.marginals(page)
        blocks = [(node, " ".join("".join(parts).split())) for node, parts in page.blocks]
        kept = [b for node, b in blocks if b and share[node] >= 0.5]
        if not kept:        # a page whose prose convinces nowhere: what comes nearest
            barred, prose = self._barred(page), {}
            for node, b in blocks:
                if b and not barred[node] and page.nodes[node].linked < page.nodes[node].own:
                    prose[node] = share[node]
            least = max(prose.values(), default=0) / 4
            kept = [b for node, b in blocks if b and node in prose and prose[node] >= least]
        return "\n".join(kept)

    @staticmethod
    def _barred(page: Page) -> list[bool]:
        """Nodes that are no prose whatever they hold, with all below them."""
        out = []
        for node, named in zip(page.nodes, bad_elements(page)):
            out.append(named or node.tag in NEGATIVE or node.parent >= 0 and out[node.parent])
        return out


def _log_sum(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high + math.log1p(math.exp(low - high))


def train(pages: DataFrame, page: str = "html", id_col: str = "page_id") -> ContentModel:
    """Potentials from the bounded sample of pages that mark their article."""
    found = pages.count()
    share = max(1, (MAX_LABELLED << 20) // max(found, 1))
    rows = pages.where(F.pmod(F.xxhash64(id_col, F.length(page)), F.lit(1 << 20)) < share)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for source in batch.column(0).to_pylist():
                total.update(counts(parse(source or "")))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()),
                                          pa.array(list(total.values()), pa.int64())], ["f", "n"])
    summed = (rows.select(F.col(page).cast("string").alias("h")).mapInArrow(measure, "f string, n long")
              .groupBy("f").agg(F.sum("n").alias("n")).collect())     # bounded by the feature set
    return ContentModel({r["f"]: r["n"] for r in summed})


def extract(pages: DataFrame, model: ContentModel, page: str = "html", out: str = "text",
            columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``pages`` (all but the page itself) with the main text."""
    keep = [c for c in (columns or pages.columns) if c not in (page, out)]
    shared = pages.sparkSession.sparkContext.broadcast(model.summed)
    schema = StructType([pages.schema[c] for c in keep]
                        + [StructField(out, StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ContentModel(shared.value)
        for batch in batches:
            texts = [own.extract(s) for s in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], schema.names)
    return pages.select(*keep, F.col(page).cast("string").alias("\x01page")).mapInArrow(run, schema)
