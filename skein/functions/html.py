"""HTML expressions over a column of raw pages (``Column -> Column``).

These replace a per-row DOM parser with native regex/array expressions, so a
whole ``pages`` table is processed inside whole-stage codegen.  The model is
the one of a lenient HTML tokenizer:

* a tag is ``<`` or ``</`` followed by a letter, up to the next ``>`` outside
  a quoted attribute value; a bare ``a < b`` is text;
* comments, ``<!...>`` declarations, ``<?...?>`` instructions and the bodies
  of ``script``/``style``/``template`` carry no text;
* text nodes are the pieces between those; character references are decoded
  per node, each once: numeric ones by the HTML rules, named ones by the whole
  HTML5 table, legacy names also without the trailing ``;``.

Element selection (``html_select_text``) handles non-nested ``tag``,
``tag.class`` and ``tag#id`` selectors.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import WS, py_strip, url_origin

# --- fixed values -----------------------------------------------------------
COMMENT = r"(?s:<!--.*?-->)"
RAW_TEXT_ELEMENTS = ["script", "style", "template"]
# Meta keys read by the article field extractor.
META_IMAGE = "og:image"
META_DESCRIPTION = "description"
META_KEYWORDS = "keywords"
META_AUTHOR = "author"
META_PUBLISHED = "article:published_time"
EXTRACTION_METHOD = "skein-html"
# --- end of fixed values ----------------------------------------------------


# The rest of a tag up to its '>': whatever is no '=', and after each '=' a
# quoted value taken whole (possessive: one pass, no backtracking).
ATTRS = r"""[^>=]*+(?:=(?:\s*+(?:"[^"]*+"|'[^']*+'))?+[^>=]*+)*+"""
TAG = rf"</?[A-Za-z]{ATTRS}>|<![^>]*>|<\?[^>]*>"
# One attribute: its name and, if any, its value.
ATTRIBUTE = r"""[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+"""


def raw_block(tag: str) -> str:
    return rf"(?is:<{tag}(?:[\s/]{ATTRS})?>.*?</{tag}\s*>)"


# markup whose content is neither text nor elements
HIDDEN = "|".join([COMMENT] + [raw_block(t) for t in RAW_TEXT_ELEMENTS])
# one alternation: anything that separates text nodes
NODE_SPLIT = f"{HIDDEN}|{TAG}"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Characters of the numeric references 128 to 159.
WINDOWS_1252 = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160)]

# One token per character reference or run of other text, left to right.
ENTITY_TOKENS = r"&#[0-9]+;?|&#[xX][0-9A-Fa-f]+;?|&[A-Za-z][A-Za-z0-9]*[;=]?|[^&]+|&"
# Names that are also decoded without ';', longest first.
LEGACY = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))


def _bound(c, fn) -> Column:
    """``fn(c)`` with ``c`` computed once, however often ``fn`` reads it."""
    return F.element_at(F.transform(F.array(_col(c)), fn), 1)


def decode_entities(c, attribute: bool = False) -> Column:
    """Decode character references in one left-to-right pass, as an HTML
    parser does: numeric ones (with or without ';'), the names of HTML5 with
    ';', and the legacy names also without ';' (longest legacy prefix, the
    rest kept; in an attribute value only if no letter, digit or '=' follows).
    Each reference is decoded once, so ``&amp;lt;`` gives ``&lt;`` and
    ``&#38;amp;`` gives ``&amp;``."""
    return _bound(c, lambda t: _decode(t, attribute))


def _decode(t: Column, attribute: bool = False) -> Column:
    tokens = F.regexp_extract_all(t, F.lit(ENTITY_TOKENS), F.lit(0))
    return F.when(~t.contains("&"), t).otherwise(
        F.array_join(F.transform(tokens, lambda k: _decode_token(k, attribute)), ""))


def _names() -> Column:
    """Name (with ';' where it has one) -> characters, folded to one literal."""
    return F.str_to_map(F.lit("\x01".join(f"{n}\x02{c}" for n, c in html5.items())),
                        F.lit("\x01"), F.lit("\x02"))


def _decode_token(tok: Column, attribute: bool) -> Column:
    # numbers without their leading zeros; longer ones are out of range
    dec = F.concat(F.lit("0"), F.regexp_extract(tok, r"^&#0*([0-9]{0,7});?$", 1))
    hexa = F.concat(F.lit("0"), F.regexp_extract(tok, r"^&#[xX]0*([0-9A-Fa-f]{0,6});?$", 1))
    name = F.substr(tok, F.lit(2))
    legacy = F.regexp_extract(name, f"^({'|'.join(LEGACY)})", 1)
    rest = F.substr(name, F.length(legacy) + 1)
    known = F.try_element_at(_names(), name)
    prefix = (legacy != "") & (rest == "") if attribute else legacy != ""
    return (F.when(~tok.startswith("&") | (tok == "&"), tok)
            .when(tok == "&amp;", F.lit("&"))
            .when(tok.rlike("^&#0*[1-9][0-9]{7,};?$"), F.lit("\ufffd"))
            .when(tok.rlike(r"^&#[xX]0*[1-9A-Fa-f][0-9A-Fa-f]{6,};?$"), F.lit("\ufffd"))
            .when(tok.rlike("^&#[0-9]"), _codepoint(dec.cast("int")))
            .when(tok.startswith("&#"), _codepoint(F.conv(hexa, 16, 10).cast("int")))
            .when(known.isNotNull(), known)
            .when(prefix, F.concat(F.try_element_at(_names(), legacy), rest))
            .otherwise(tok))


def _codepoint(n: Column) -> Column:
    """The character that a numeric reference ``n`` stands for: zero,
    surrogates and numbers out of range give U+FFFD, 128 to 159 the characters
    of Windows-1252, others their code point (UTF-32 big-endian decode)."""
    return (F.when((n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), F.lit("\ufffd"))
            .when(n.between(128, 159), F.element_at(F.array(*[F.lit(c) for c in WINDOWS_1252]),
                                                    F.when(n.between(128, 159), n - 127).otherwise(1)))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))


def html_strip(c) -> Column:
    """All text of a fragment glued with no separator (markup removed)."""
    return decode_entities(F.regexp_replace(_col(c), NODE_SPLIT, ""))


def text_nodes(c) -> Column:
    """Array of decoded text nodes (in document order, not stripped)."""
    return F.transform(F.split(_col(c), NODE_SPLIT), lambda t: _decode(t))


def html_text(c, sep: str = "") -> Column:
    """Each text node stripped, empties dropped, joined with ``sep``."""
    nodes = F.transform(text_nodes(c), py_strip)
    return F.array_join(F.filter(nodes, lambda x: x != ""), sep)


def _element_rx(tag: str) -> str:
    return rf"(?is)<{tag}([\s/]{ATTRS})?>(.*?)</{tag}\s*>"


def html_title(c) -> Column:
    """Stripped text of the first ``<title>``; NULL when there is none."""
    rx = _element_rx("title")
    h = _col(c)
    return F.when(h.rlike(rx), html_text(F.regexp_extract(h, rx, 2)))


def attr(tag_text, name: str) -> Column:
    """Decoded value of attribute ``name`` in a start tag: the first of that
    name, read in order (never from inside another value); ``''`` if it has
    no value, NULL if absent."""
    parts = F.regexp_extract_all(_col(tag_text), F.lit(ATTRIBUTE), F.lit(0))
    own = F.get(F.filter(parts, lambda p: p.rlike(rf"(?i)^{name}(?:\s*=|$)")), F.lit(0))
    value = F.regexp_replace(own, r"^[^\s=]++\s*+(?:=\s*+)?+", "")
    return decode_entities(F.regexp_replace(value, r"(?s)^([\"'])(.*)\1$", "$2"), attribute=True)


def _tags(h: Column, tag: str) -> Column:
    """Start tags of one element outside comments and scripts."""
    return F.regexp_extract_all(F.regexp_replace(h, HIDDEN, ""),
                                F.lit(rf"(?i)<{tag}[\s/]{ATTRS}>"), F.lit(0))


def html_meta_entries(c) -> Column:
    """Array<struct<key, value>> in document order: the title first (if
    any), then every ``<meta>`` whose name-or-property and content are both
    non-empty.  Later entries win when turned into a map."""
    h = _col(c)
    tags = _tags(h, "meta")

    def entry(t):
        name = attr(t, "name")
        key = F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(attr(t, "property"))
        return F.struct(key.alias("key"), attr(t, "content").alias("value"))

    metas = F.filter(F.transform(tags, entry),
                     lambda e: (F.coalesce(e["key"], F.lit("")) != "") &
                               (F.coalesce(e["value"], F.lit("")) != ""))
    head = F.filter(F.array(F.struct(F.lit("title").alias("key"),
                                     html_title(h).alias("value"))),
                    lambda e: e["value"].isNotNull())
    return F.concat(head, metas)


def last_wins(entries) -> Column:
    """Keep, for each key, only its last entry (order preserved)."""
    return _bound(entries, lambda e: F.filter(
        e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e) + 1), lambda y: y["key"] == x["key"])))


def html_meta(c) -> Column:
    """Map name-or-property -> content (later duplicates win; a meta named
    'title' overrides the ``<title>`` text)."""
    return F.map_from_entries(last_wins(html_meta_entries(c)))


def html_links(c, base_url=None) -> Column:
    """Hrefs of ``<a>`` tags: ``http*`` kept; root-relative ``/x`` resolved
    against ``base_url`` (without its trailing '/') only when a base is given;
    everything else dropped.  Order and duplicates kept."""
    h = _col(c)
    base = F.coalesce(_col(base_url), F.lit("")) if base_url is not None else F.lit("")
    tags = _tags(h, "a")
    hrefs = F.transform(tags, lambda t: attr(t, "href"))
    resolved = F.transform(hrefs, lambda u: F.when(u.startswith("http"), u).when(
        (base != "") & u.startswith("/"),
        F.concat(F.regexp_replace(base, "/+$", ""), u)))
    return F.filter(resolved, lambda u: u.isNotNull())


def html_select_text(c, selector: str) -> Column:
    """Text of elements matching ``tag``, ``tag.class`` or ``tag#id``, each
    element's stripped text nodes glued, elements joined with one space."""
    tag, cls, eid = selector, None, None
    if "." in selector:
        tag, cls = selector.split(".", 1)
    elif "#" in selector:
        tag, eid = selector.split("#", 1)
    rx = _element_rx(tag)
    h = _col(c)
    elems = F.arrays_zip(F.regexp_extract_all(h, F.lit(rx), F.lit(1)).alias("a"),
                         F.regexp_extract_all(h, F.lit(rx), F.lit(2)).alias("b"))
    if cls is not None:
        elems = F.filter(elems, lambda e: F.array_contains(
            F.split(py_strip(F.coalesce(attr(F.concat(F.lit(" "), e["a"]), "class"),
                                        F.lit(""))), f"{WS}+"), cls))
    if eid is not None:
        elems = F.filter(elems, lambda e: attr(F.concat(F.lit(" "), e["a"]), "id") == eid)
    return F.array_join(F.transform(elems, lambda e: html_text(e["b"])), " ")


def article_body(c) -> Column:
    """Body text: text nodes of the first ``<article>`` (else of all ``<p>``
    elements) stripped and joined with a blank line."""
    h = _col(c)
    art_rx = _element_rx("article")
    article = F.when(h.rlike(art_rx), F.regexp_extract(h, art_rx, 2))
    paras = F.array_join(F.regexp_extract_all(h, F.lit(_element_rx("p")), 2), "\n")
    src = F.coalesce(article, paras)
    return html_text(src, "\n\n")


ARTICLE_FIELDS = ["url", "title", "authors", "publish_date", "text", "top_image",
                  "meta_description", "meta_keywords", "source_domain",
                  "extraction_method", "extracted_at"]


def article_fields(pages, html: str = "html", url: str = "url", extracted_at=None):
    """Article record columns from raw pages (fixed rules, no heuristics).

    Takes and returns a DataFrame: the meta map is computed once in its own
    projection and then read by several fields (a Column-level helper would
    re-evaluate it per reference).  Other input columns are kept.
    """
    from skein.functions.text import url_domain
    keep = [c for c in pages.columns if c not in (html, url)]
    ts = _col(extracted_at) if extracted_at is not None else F.current_timestamp()
    staged = pages.select(*keep, F.col(url).alias("url"),
                          html_meta(F.col(html)).alias("_meta"),
                          article_body(F.col(html)).alias("text"))
    meta = F.col("_meta")
    kw, author = meta[META_KEYWORDS], meta[META_AUTHOR]
    empty = F.array().cast("array<string>")
    return staged.select(
        *keep,
        F.col("url"),
        meta["title"].alias("title"),
        F.when(author.isNotNull(), F.transform(F.split(author, ","), py_strip))
         .otherwise(empty).alias("authors"),
        F.try_to_timestamp(meta[META_PUBLISHED]).alias("publish_date"),
        F.col("text"),
        F.coalesce(meta[META_IMAGE], F.lit("")).alias("top_image"),
        F.coalesce(meta[META_DESCRIPTION], F.lit("")).alias("meta_description"),
        F.when(kw.isNotNull(), F.transform(F.split(kw, ","), py_strip))
         .otherwise(empty).alias("meta_keywords"),
        url_domain(F.col("url")).alias("source_domain"),
        F.lit(EXTRACTION_METHOD).alias("extraction_method"),
        ts.cast("timestamp").alias("extracted_at"))


def page_base(url) -> Column:
    return url_origin(url)
