"""Column expressions shared by the native operators.

Only built-in functions: arguments of higher-order functions are evaluated
once per row, so whatever a lambda reads more than once is first bound to a
lambda variable (``bind``) instead of being repeated inside its body.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: matches per inner fold of ``match_spans``
_FOLD = 64

SPAN = "struct<start:int,end:int,m:string>"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def match_spans(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches of ``pattern`` with their places.

    Returns ``array<struct<start,end,m>>`` in code points, end exclusive.
    ``split`` gives the gaps between the matches and ``regexp_extract_all`` the
    matches; a match ends at the running sum of gaps and match lengths.  The
    sum is folded in runs of ``_FOLD`` matches, so that a text with very many
    matches does not copy a growing array once per match.
    """
    rows = F.transform(
        F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                     F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")),
        lambda e: F.struct((F.length(e["gap"]) + F.length(e["m"])).alias("step"), e["m"].alias("m")))

    def places(z: Column) -> Column:
        def run(c: Column) -> Column:
            before = F.aggregate(F.slice(z, F.lit(1), c * _FOLD), F.lit(0),
                                 lambda a, e: a + e["step"])
            zero = F.struct(before.alias("at"), empty(SPAN).alias("out"))
            return F.aggregate(
                F.slice(z, c * _FOLD + 1, F.lit(_FOLD)), zero,
                lambda a, e: F.struct(
                    (a["at"] + e["step"]).alias("at"),
                    F.concat(a["out"], F.array(F.struct(
                        (a["at"] + e["step"] - F.length(e["m"])).alias("start"),
                        (a["at"] + e["step"]).alias("end"), e["m"].alias("m")))).alias("out")),
                lambda a: a["out"])
        runs = F.floor((F.size(z) - 1) / _FOLD).cast("int")
        return F.when(F.size(z) == 0, empty(SPAN)).otherwise(
            F.flatten(F.transform(F.sequence(F.lit(0), runs), run)))

    return bind(F.filter(rows, lambda e: e["m"].isNotNull()), places)


def digits_only(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """True when a string of digits passes the Luhn check."""
    def add(total: Column, d: Column) -> Column:
        doubled = d["v"] * 2
        return total + F.when(d["i"] % 2 == 0, d["v"]).when(doubled > 9, doubled - 9).otherwise(doubled)
    figures = F.transform(F.split(F.reverse(digits), ""),
                          lambda d, i: F.struct(d.try_cast("int").alias("v"), i.alias("i")))
    total = F.aggregate(F.filter(figures, lambda d: d["v"].isNotNull()), F.lit(0), add)
    return total % 10 == 0


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined in the array's order."""
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                     s["end"].cast("string"))), ",")
