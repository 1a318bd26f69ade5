"""DuckDB SQL text for the oracle queries of the text/HTML operators.

These build SQL *strings*; DuckDB (RE2) runs them in the checker.  Text rules
share the fixed values of ``skein.functions.text``; the HTML patterns are the
checker's own (plain greedy ones, the common entities only).
"""

from __future__ import annotations


from html.entities import html5

from skein.functions import text as TX


ATTRS = r"""[^>=]*(?:=(?:\s*(?:"[^"]*"|'[^']*'))?[^>=]*)*"""
HIDDEN = "|".join([r"(?s:<!--.*?-->)"] + [rf"(?is:<{t}(?:[\s/]{ATTRS})?>.*?</{t}\s*>)"
                                         for t in ("script", "style", "template")])
NODE_SPLIT = rf"{HIDDEN}|</?[A-Za-z]{ATTRS}>|<![^>]*>|<\?[^>]*>"
ENTITY_TOKENS = r"&#[0-9]+;?|&#[xX][0-9A-Fa-f]+;?|&[A-Za-z][A-Za-z0-9]*;?|[^&]+|&"
# the entities that the checker knows, '&amp;' as any other
COMMON = ["amp", "lt", "gt", "quot", "apos", "nbsp", "copy", "reg", "trade", "middot", "mdash",
          "ndash", "hellip", "lsquo", "rsquo", "ldquo", "rdquo", "laquo", "raquo", "bull", "deg",
          "euro", "pound", "yen", "cent", "sect", "para", "times", "divide", "plusmn", "eacute"]


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(e: str) -> str:
    return f"trim({e}, {lit(TX.WS_CHARS)})"


def squeeze(e: str) -> str:
    return f"regexp_replace({e}, {lit(f'{TX.WS}+')}, ' ', 'g')"


def decode(e: str) -> str:
    tok = "k"
    parts = [f"WHEN regexp_matches({tok}, '^&#[0-9]{{1,7}};?$') "
             f"THEN chr(regexp_extract({tok}, '^&#([0-9]{{1,7}});?$', 1)::INT)",
             f"WHEN regexp_matches({tok}, '^&#[xX][0-9A-Fa-f]{{1,6}};?$') "
             f"THEN chr(('0x' || regexp_extract({tok}, '^&#[xX]([0-9A-Fa-f]{{1,6}});?$', 1))::INT)"]
    for name in COMMON:
        parts.append(f"WHEN {tok} = {lit('&' + name + ';')} THEN {lit(html5[name + ';'])}")
    for name in sorted((n for n in COMMON if n in html5), key=lambda n: -len(n)):
        parts.append(f"WHEN starts_with({tok}, {lit('&' + name)}) "
                     f"THEN {lit(html5[name])} || substr({tok}, {len(name) + 2})")
    case = "CASE " + " ".join(parts) + f" ELSE {tok} END"
    toks = f"regexp_extract_all({e}, {lit(ENTITY_TOKENS)}, 0)"
    return (f"CASE WHEN NOT contains({e}, '&') THEN {e} ELSE "
            f"array_to_string(list_transform({toks}, lambda {tok}: {case}), '') END")


def html_strip(e: str) -> str:
    return decode(f"regexp_replace({e}, {lit(NODE_SPLIT)}, '', 'g')")


def html_text(e: str, sep: str = "") -> str:
    nodes = f"regexp_split_to_array({e}, {lit(NODE_SPLIT)})"
    return (f"array_to_string(list_filter(list_transform({nodes}, "
            f"lambda x: {strip(decode('x'))}), lambda x: x <> ''), {lit(sep)})")


def element_rx(tag: str) -> str:
    return rf"(?is)<{tag}([\s/]{ATTRS})?>(.*?)</{tag}\s*>"


def html_title(e: str) -> str:
    rx = lit(element_rx("title"))
    return (f"CASE WHEN regexp_matches({e}, {rx}) "
            f"THEN {html_text(f'regexp_extract({e}, {rx}, 2)')} END")


def attr(e: str, name: str) -> str:
    rx = lit(rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
    val = (f"regexp_extract({e}, {rx}, 1) || regexp_extract({e}, {rx}, 2) || "
           f"regexp_extract({e}, {rx}, 3)")
    return f"CASE WHEN regexp_matches({e}, {rx}) THEN {decode(val)} END"


def html_links(e: str, base: str) -> str:
    tags = f"regexp_extract_all(regexp_replace({e}, {lit(HIDDEN)}, '', 'g'), " \
           f"{lit(rf'(?is)<a[\s/]{ATTRS}>')}, 0)"
    hrefs = f"list_transform({tags}, lambda t: {attr('t', 'href')})"
    res = (f"list_transform({hrefs}, lambda u: CASE WHEN starts_with(u, 'http') THEN u "
           f"WHEN {base} <> '' AND starts_with(u, '/') THEN "
           f"regexp_replace({base}, '/+$', '') || u END)")
    return f"list_filter({res}, lambda u: u IS NOT NULL)"


def html_select_text(e: str, selector: str) -> str:
    tag, cls, eid = selector, None, None
    if "." in selector:
        tag, cls = selector.split(".", 1)
    elif "#" in selector:
        tag, eid = selector.split("#", 1)
    rx = lit(element_rx(tag))
    n = f"len(regexp_extract_all({e}, {rx}, 1))"
    a = f"regexp_extract_all({e}, {rx}, 1)[i]"
    b = f"regexp_extract_all({e}, {rx}, 2)[i]"
    cond = "true"
    if cls is not None:
        cv = f"coalesce({attr(f"(' ' || {a})", 'class')}, '')"
        cond = f"list_contains(regexp_split_to_array({strip(cv)}, {lit(TX.WS + '+')}), {lit(cls)})"
    if eid is not None:
        cond = f"{attr(f"(' ' || {a})", 'id')} = {lit(eid)}"
    return (f"array_to_string(list_transform(list_filter(range(1, {n} + 1), "
            f"lambda i: {cond}), lambda i: {html_text(b)}), ' ')")


def article_body(e: str) -> str:
    art = lit(element_rx("article"))
    paras = f"array_to_string(regexp_extract_all({e}, {lit(element_rx('p'))}, 2), chr(10))"
    src = f"CASE WHEN regexp_matches({e}, {art}) THEN regexp_extract({e}, {art}, 2) ELSE {paras} END"
    return html_text(src, "\n\n")


def url_validate(e: str) -> str:
    return f"coalesce(regexp_matches({e}, {lit(TX.URL_SCHEME_NETLOC)}), false)"


def url_domain(e: str) -> str:
    return f"regexp_extract({e}, {lit(TX.URL_NETLOC)}, 1)"


def url_origin(e: str) -> str:
    return f"regexp_extract({e}, {lit(r'^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)')}, 1)"


def text_clean(e: str) -> str:
    t = squeeze(html_strip(f"coalesce({e}, '')"))
    t = f"regexp_replace({t}, {lit(TX.CLEAN_DROP)}, '', 'g')"
    return strip(t)


def article_quality(title: str, text: str, url: str, min_length: int = TX.MIN_TEXT_LENGTH) -> str:
    return (f"CASE WHEN {title} IS NULL OR {title} = '' THEN 'Missing title' "
            f"WHEN {text} IS NULL OR {text} = '' THEN 'Missing text content' "
            f"WHEN length({text}) < {min_length} THEN "
            f"'Text too short (' || length({text}) || ' < {min_length} chars)' "
            f"WHEN {url} IS NULL OR {url} = '' THEN 'Missing URL' ELSE 'Valid' END")


def file_slug(title: str, ts: str) -> str:
    t = f"coalesce({title}, 'untitled')"
    t = f"regexp_replace({t}, {lit(TX.SLUG_DROP)}, '', 'g')"
    t = f"regexp_replace({t}, {lit(TX.SLUG_SEP)}, '_', 'g')"
    return f"substr({t}, 1, {TX.SLUG_MAX}) || '_' || strftime({ts}, '%Y%m%d_%H%M%S') || '.json'"


def rewrite(e: str, rules) -> str:
    return TX.sql_rewrite(e, rules)


def words(e: str) -> str:
    return (f"list_filter(regexp_split_to_array({e}, {lit(TX.WS + '+')}), "
            f"lambda x: x <> '')")


def tokens(e: str) -> str:
    return f"list_distinct({words(f'lower({e})')})"


def jaccard(a: str, b: str) -> str:
    ta, tb = tokens(a), tokens(b)
    return (f"CASE WHEN len({ta}) = 0 OR len({tb}) = 0 THEN 0.0 ELSE "
            f"len(list_intersect({ta}, {tb}))::DOUBLE / "
            f"len(list_distinct(list_concat({ta}, {tb}))) END")


def meta_entries_sql(e: str) -> str:
    """Struct list (key, value, pos) of title + metas, document order."""
    tags = f"regexp_extract_all(regexp_replace({e}, {lit(HIDDEN)}, '', 'g'), " \
           f"{lit(rf'(?is)<meta[\s/]{ATTRS}>')}, 0)"
    key = (f"CASE WHEN coalesce({attr('t', 'name')}, '') <> '' THEN {attr('t', 'name')} "
           f"ELSE {attr('t', 'property')} END")
    metas = (f"list_filter(list_transform({tags}, lambda t: {{'key': {key}, "
             f"'value': {attr('t', 'content')}}}), lambda m: coalesce(m.key, '') <> '' "
             f"AND coalesce(m.value, '') <> '')")
    title = html_title(e)
    head = (f"CASE WHEN ({title}) IS NOT NULL THEN [{{'key': 'title', 'value': {title}}}] "
            f"ELSE [] END")
    return f"list_concat({head}, {metas})"



def cosine_ctes(src: str, keys: list[str], a: str, b: str, out: str) -> str:
    """CTEs computing ``out(keys..., cosine)`` from table ``src`` (DuckDB)."""
    k = ", ".join(keys)
    return f"""
{out}_sides AS (SELECT {k}, 0 AS side, {a} AS t FROM {src}
                UNION ALL SELECT {k}, 1 AS side, {b} AS t FROM {src}),
{out}_w AS (SELECT {k}, side, unnest({words('t')}) AS w FROM {out}_sides),
{out}_wc AS (SELECT {k}, side, ' ' || w || ' ' AS pw, count(*) AS c FROM {out}_w GROUP BY ALL),
{out}_n AS (SELECT {k}, side, c, pw, unnest([2, 3, 4]) AS n FROM {out}_wc),
{out}_g AS (SELECT {k}, side, c, substr(pw, i + 1, n) AS gram
            FROM (SELECT *, unnest(range(0, length(pw) - n + 1)) AS i FROM {out}_n
                  WHERE n <= length(pw))),
{out}_gc AS (SELECT {k}, gram, sum(c) FILTER (WHERE side = 0) AS ca,
                    sum(c) FILTER (WHERE side = 1) AS cb FROM {out}_g GROUP BY ALL),
{out}_wt AS (SELECT {k},
     coalesce((1 + ln(ca)) * (ln(3.0 / (1 + (ca IS NOT NULL)::INT + (cb IS NOT NULL)::INT)) + 1), 0.0) AS wa,
     coalesce((1 + ln(cb)) * (ln(3.0 / (1 + (ca IS NOT NULL)::INT + (cb IS NOT NULL)::INT)) + 1), 0.0) AS wb
     FROM {out}_gc),
{out} AS (SELECT {k}, CASE WHEN sum(wa * wa) > 0 AND sum(wb * wb) > 0
                       THEN sum(wa * wb) / sqrt(sum(wa * wa) * sum(wb * wb)) ELSE 0.0 END AS cosine
          FROM {out}_wt GROUP BY ALL)"""


def blank(e: str) -> str:
    return f"({e} IS NULL OR {strip(e)} = '')"


def hybrid_sql(src: str, keys: list[str], a: str, b: str, blank_expr: str,
               w_cos: float, w_jac: float, out_col: str, name: str) -> str:
    """CTEs: ``{name}_prep`` then cosine, then ``{name}(keys..., out_col)``."""
    k = ", ".join(keys)
    on = " AND ".join(f"p.{x} = c.{x}" for x in keys)
    pk = ", ".join(f"p.{x}" for x in keys)
    return f"""
{name}_prep AS (SELECT {k}, {a} AS a, {b} AS b, {blank_expr} AS is_blank FROM {src}),
{name}_ok AS (SELECT * FROM {name}_prep WHERE NOT is_blank),
{cosine_ctes(f'{name}_ok', keys, 'a', 'b', f'{name}_cos')},
{name} AS (SELECT {pk}, CASE WHEN p.is_blank THEN 0.0 ELSE
             greatest(0.0, least(1.0, {w_cos} * coalesce(c.cosine, 0.0) + {w_jac} * {jaccard('p.a', 'p.b')}))
             END AS {out_col}
           FROM {name}_prep p LEFT JOIN {name}_cos c ON {on})"""
