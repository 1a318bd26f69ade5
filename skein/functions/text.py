"""Text, URL and hashing expressions (``Column -> Column``).

All of these are native Spark expressions, so they run inside whole-stage
codegen and compose with filters that Catalyst can push down.

Regex dialect: Java's ``\\w``, ``\\s`` and ``\\b`` are ASCII; the semantics
here follow Python 3 ``str`` regexes, so word characters are written
``[\\p{L}\\p{N}_]`` and whitespace as the explicit class below.  The same class
strings work in RE2 (DuckDB), which is how the oracle SQL is written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Characters Python's str.isspace() / re "\s" treat as whitespace.
WS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# The same characters as a plain string (for trim/btrim).
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
            "\u2028\u2029\u202f\u205f\u3000")
# Python's Unicode "\w".
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"

# Text cleaning keeps word characters, whitespace and this punctuation:
#   . , ! ? ; : - ' " ( ) [ ] { }
CLEAN_DROP = (r"[^\p{L}\p{N}_\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}"
              r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
              r".,!?;:\-'\"()\[\]{}]")
# File names keep word characters, whitespace and '-'.
SLUG_DROP = (r"[^\p{L}\p{N}_\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}"
             r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\-]")
SLUG_SEP = r"[\-\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}" \
           r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
SLUG_MAX = 50
MIN_TEXT_LENGTH = 100

# URL parsing skips leading C0 control characters and spaces first.
URL_SCHEME_NETLOC = r"^[\x{00}-\x{20}]*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+"
URL_NETLOC = r"^[\x{00}-\x{20}]*[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"

# Synonym rewrites applied in this order, after lower-casing.
# Answer relevancy:
RELEVANCY_REWRITES = [
    (r"\bai\b", "artificial intelligence"),
    (r"\bml\b", "machine learning"),
    (r"\brevolutioniz(e|es|ing|ed)\b", "transform"),
    (r"\btransform(s|ing|ed)?\b", "transform"),
    (r"\bmedicine\b", "healthcare"),
    (r"\bhealthcare\b", "healthcare"),
    (r"\bdiagnos(is|tic|e)\b", "diagnosis"),
    (r"\bdetect(s|ing|ion)?\b", "detect"),
    (r"\bdiseases?\b", "disease"),
    (r"\bpredictive\b", "predictive"),
    (r"\banalytics\b", "analytics"),
    (r"\bmodels?\b", "model"),
    (r"\bvia\b", "through"),
    (r"\bhelps?\b", "help"),
    (r"\bused\b", "use"),
    (r"\bwidely\b", "widely"),
    (r"\balgorithms?\b", "algorithm"),
    (r"\bin\b", ""),
    (r"\bfor\b", ""),
]
# Faithfulness:
FAITHFULNESS_REWRITES = [
    (r"\bai\b", "artificial intelligence"),
    (r"\bml\b", "machine learning"),
    (r"\bmedicine\b", "healthcare"),
    (r"\bhealthcare\b", "healthcare"),
    (r"\bdiagnos(is|tic|e)\b", "diagnosis"),
    (r"\bdetect(s|ing|ion)?\b", "detect"),
    (r"\bdiseases?\b", "disease"),
    (r"\bvia\b", "through"),
    (r"\bhelps?\b", "help"),
    (r"\bused\b", "use"),
    (r"\bwidely\b", "widely"),
    (r"\balgorithms?\b", ""),
    (r"\bpurposes?\b", ""),
    (r"\baccuracy\b", "precision"),
    (r"\bin\b", ""),
    (r"\bfor\b", ""),
    (r"\bwith\b", ""),
    (r"\bhigh\b", ""),
]
# --- end of fixed values ----------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def java_word_boundary(pattern: str) -> str:
    """``\\b`` (Python, Unicode) -> Java look-arounds over ``WORD``."""
    out = pattern
    if out.startswith(r"\b"):
        out = f"(?<!{WORD})" + out[2:]
    if out.endswith(r"\b"):
        out = out[:-2] + f"(?!{WORD})"
    return out


# --- URL --------------------------------------------------------------------

def url_validate(url) -> Column:
    """True iff the URL has both a scheme and a network location."""
    u = _col(url)
    return F.coalesce(u.rlike(URL_SCHEME_NETLOC), F.lit(False))


def url_domain(url) -> Column:
    """The network location (host with port / user info), '' if none."""
    return F.regexp_extract(_col(url), URL_NETLOC, 1)


def url_origin(url) -> Column:
    """``scheme://netloc`` of a URL ('' if it has none)."""
    return F.regexp_extract(_col(url), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


# --- whitespace / cleaning --------------------------------------------------

def py_strip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.btrim(_col(c), F.lit(WS_CHARS))


def squeeze_ws(c) -> Column:
    """Python ``re.sub(r'\\s+', ' ', s)``."""
    return F.regexp_replace(_col(c), f"{WS}+", " ")


def text_clean(text) -> Column:
    """Article text cleaning.

    NULL/'' -> ''; markup out and entities decoded; whitespace runs -> one
    space; characters other than word characters, whitespace and basic
    punctuation deleted (which can leave double spaces); stripped.
    """
    from skein.functions.html import html_strip
    t = F.coalesce(_col(text), F.lit(""))
    t = squeeze_ws(html_strip(t))
    t = F.regexp_replace(t, CLEAN_DROP, "")
    return py_strip(t)


def article_quality(title, text, url, min_length: int = MIN_TEXT_LENGTH) -> Column:
    """First failing quality reason, or 'Valid' (tests in this order)."""
    ti, tx, u = _col(title), _col(text), _col(url)
    n = F.length(tx)
    return (F.when(ti.isNull() | (ti == ""), F.lit("Missing title"))
            .when(tx.isNull() | (tx == ""), F.lit("Missing text content"))
            .when(n < min_length,
                  F.format_string(f"Text too short (%d < {min_length} chars)", n))
            .when(u.isNull() | (u == ""), F.lit("Missing URL"))
            .otherwise(F.lit("Valid")))


def file_slug(title, ts) -> Column:
    """``<title slug, first 50>_<yyyyMMdd_HHmmss>.json`` for a saved article."""
    t = F.coalesce(_col(title), F.lit("untitled"))
    t = F.regexp_replace(t, SLUG_DROP, "")
    t = F.regexp_replace(t, SLUG_SEP, "_")
    t = F.substring(t, 1, SLUG_MAX)
    return F.concat(t, F.lit("_"), F.date_format(_col(ts), "yyyyMMdd_HHmmss"),
                    F.lit(".json"))


def text_hash(text) -> Column:
    """Hex SHA-256 of the UTF-8 text."""
    return F.sha2(_col(text), 256)


def similarity(distance) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + _col(distance))


# --- evaluation text helpers ------------------------------------------------

def rewrite(text, rules) -> Column:
    """Lower-case, then apply ordered regex rewrites (word boundaries)."""
    t = F.lower(_col(text))
    return reduce(lambda acc, r: F.regexp_replace(acc, java_word_boundary(r[0]), r[1]),
                  rules, t)


def synonyms_relevancy(text) -> Column:
    return rewrite(text, RELEVANCY_REWRITES)


def synonyms_faithfulness(text) -> Column:
    return rewrite(text, FAITHFULNESS_REWRITES)


def words(text) -> Column:
    """Python ``s.split()``: whitespace-separated words, empties dropped."""
    return F.filter(F.split(_col(text), f"{WS}+"), lambda x: x != "")


def tokens(text) -> Column:
    """Distinct lower-cased whitespace tokens."""
    return F.array_distinct(words(F.lower(_col(text))))


def token_jaccard(a, b) -> Column:
    """|A ∩ B| / |A ∪ B| over token sets; 0 when either set is empty."""
    ta, tb = tokens(a), tokens(b)
    return (F.when((F.size(ta) == 0) | (F.size(tb) == 0), F.lit(0.0))
            .otherwise(F.size(F.array_intersect(ta, tb)) /
                       F.size(F.array_union(ta, tb))))


# --- oracle helpers: the same expressions as DuckDB SQL text -----------------

def sql_py_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def sql_rewrite(expr: str, rules) -> str:
    """DuckDB form of ``rewrite``: RE2 has no look-arounds, so the boundary
    characters are captured and put back, and each rule runs twice so that
    adjacent matches sharing one boundary character are all rewritten."""
    import re
    out = f"lower({expr})"
    for pat, rep in rules:
        core = pat[2:-2] if pat.startswith(r"\b") and pat.endswith(r"\b") else pat
        core = re.sub(r"\((?!\?)", "(?:", core)
        rx = f"(^|{NOT_WORD})(?:{core})({NOT_WORD}|$)"
        for _ in range(2):
            out = f"regexp_replace({out}, '{rx}', '\\1{rep}\\2', 'g')"
    return out


def sql_words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{WS}+'), x -> x <> '')"


def sql_tokens(expr: str) -> str:
    return f"list_distinct({sql_words(f'lower({expr})')})"
