"""Personal data by weak-supervision aggregation.

Candidate spans come from fixed patterns.  Six labelers vote -1, 0 or 1 on each
candidate: the strict format check of its kind (regex), a gazetteer of
domains, calling codes, issuer and country prefixes, cue words and counter
cues in the context before it, the characters at its borders, and degenerate
digit runs.  Expectation-maximisation over the counts of equal vote vectors
estimates the labelers' reliabilities per class without any labels; its
posteriors train the final span classifier, a logistic model over the votes
and shape features, which is emitted as a Spark expression.

The base kinds are kept whenever their strict check passes.  The extra kinds
(``ssn``, ``iban``, ``tel``) are added where the classifier accepts them and no
base span overlaps.

The fit needs only counts of distinct (kind, votes, shape) cells: at most
``len(KINDS) * 3**6 * SHAPES`` rows whatever the corpus, aggregated over all
documents.

Defined results: a null or empty text has no spans; repeated rows get equal
results (and count twice in the fit); an empty table fits the prior model;
input columns pass through untouched whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from skein.llm.native import bind, digits_only, empty, luhn_ok, match_spans, spans_text

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "tel")
BASE_KINDS = KINDS[:4]
LABELERS = ("format", "gazetteer", "cue", "counter_cue", "border", "digits")
#: length class (4) x separators (2)
SHAPES = 8
CONTEXT = 32

# Fixed patterns.  Base ones match as their plain forms do; possessive
# quantifiers and look-behinds only spare the matcher hopeless retries.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![a-z])",
    "tel": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
STRICT_IP = rf"^{OCTET}(?:\.{OCTET}){{3}}$"

# Fixed gazetteers.
DOMAINS = r"\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|us|ca|au|jp|cn|in|br|ch|at)$"
CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|4|5))"
COUNTRIES = (r"^(?:AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MT|NL|NO|"
             r"PL|PT|RO|SE|SI|SK|TR)")
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|login)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|contact)\b",
    "ssn": r"(?i)\b(?:ssn|social|security)\b",
    "iban": r"(?i)\b(?:iban|account|bank|transfer)\b",
    "tel": r"(?i)\b(?:phone|tel|call|mobile|fax|contact)\b",
}
COUNTER_CUES = r"(?i)\b(?:version|isbn|issn|order|invoice|page|chapter|section|figure|table|part)\b"


def _may_hold(kind: str, text: Column) -> Column:
    """Cheap necessary condition for a match of the kind."""
    if kind == "email":
        return text.contains("@")
    if kind == "phone":
        return text.contains("+")
    return text.rlike({"ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]",
                       "ssn": r"[0-9]{3}-[0-9]{2}-", "iban": r"[A-Z]{2}[0-9]{2}",
                       "tel": r"[0-9]{3}[.-][0-9]{4}"}[kind])


def _format_ok(kind: str, m: Column) -> Column:
    n = F.length(digits_only(m))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(STRICT_IP)
    if kind == "card":
        return n.between(16, 19) & luhn_ok(digits_only(m))
    if kind == "phone":
        return n.between(8, 15)
    if kind == "ssn":
        return ~m.rlike(r"^(?:000|666|9)|-00-|-0000$")
    if kind == "iban":
        return F.length(m).between(15, 34)
    return ~digits_only(m).rlike(r"^[01]")


def _gazetteer(kind: str, m: Column) -> Column:
    plain = digits_only(m)
    if kind == "email":
        return F.when(F.lower(m).rlike(DOMAINS), 1).otherwise(0)
    if kind == "ip":
        return F.when(m.rlike(r"^(?:0|127|255)\."), -1).otherwise(1)
    if kind == "card":
        return F.when(plain.rlike(ISSUERS), 1).otherwise(-1)
    if kind == "phone":
        return F.when(F.concat(F.lit("+"), plain).rlike(CALLING), 1).otherwise(-1)
    if kind == "iban":
        return F.when(m.rlike(COUNTRIES), 1).otherwise(-1)
    return F.lit(0)


def _described(text: Column, kind: str, s: Column) -> Column:
    """The candidate struct of one match of ``kind``."""
    start, end, m = s["start"], s["end"], s["m"]
    from_ = F.greatest(start - CONTEXT, F.lit(0))
    before = F.substring(text, from_ + 1, start - from_)
    after = F.substring(text, end + 1, F.lit(1))
    ok = _format_ok(kind, m)
    joined = before.rlike(r"[\p{L}\p{N}_]$") | after.rlike(r"^[\p{L}\p{N}_]")
    votes = (F.when(ok, 1).otherwise(-1),
             _gazetteer(kind, m),
             F.when(before.rlike(CUES[kind]), 1).otherwise(0),
             F.when(before.rlike(COUNTER_CUES), -1).otherwise(0),
             F.when(joined, -1).otherwise(1),
             F.when(digits_only(m).rlike(r"([0-9])\1{6}|0123456|1234567"), -1).otherwise(0))
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("ord"), start.alias("start"),
        end.alias("end"), ok.alias("ok"), F.array(*[v.cast("int") for v in votes]).alias("votes"),
        (F.least(F.floor(F.length(m) / 8), F.lit(3)).cast("int") * 2
         + m.rlike(r"[\x20().-]").cast("int")).alias("shape"))


def candidates(text: Column) -> Column:
    """Array of candidate spans of ``text`` with votes and shape."""
    has_digit = text.rlike("[0-9]")

    def of(kind: str) -> Column:
        spans = match_spans(text, PATTERNS[kind])
        if kind == "card":      # shorter digit runs are no card candidates
            spans = F.filter(spans, lambda s: F.length(digits_only(s["m"])).between(16, 19))
        guard = _may_hold(kind, text) if kind == "email" else has_digit & _may_hold(kind, text)
        return F.when(guard, F.transform(spans, lambda s: _described(text, kind, s))).otherwise(
            empty(CANDIDATE))
    return F.concat(*map(of, KINDS))


CANDIDATE = ("struct<kind:string,ord:int,start:int,end:int,ok:boolean,votes:array<int>,shape:int>")


# --- fit ---------------------------------------------------------------------

def vote_cells(docs: DataFrame, text: str = "text") -> list:
    """Counts of equal (kind, votes, shape) over all candidates."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = (docs.select(body.alias("_body"))
            .select(F.explode(candidates(F.col("_body"))).alias("c"))
            .groupBy("c.kind", "c.votes", "c.shape").count())
    return [(r["kind"], tuple(r["votes"]), r["shape"], r["count"]) for r in rows.collect()]


def expectation_maximisation(cells: list, rounds: int = 40, strength: float = 8.0):
    """``(posteriors, table)``: P(personal | votes) per cell and the labelers'
    ``P(vote | class)``.  Smoothing pulls a labeler toward being right in three
    votes of four, so rare kinds keep sensible reliabilities."""
    labelers, values = range(len(LABELERS)), (-1, 0, 1)

    def prior(v: int, y: int) -> float:
        return 0.25 if v == 0 else 0.55 if (v > 0) == bool(y) else 0.20
    table = {(j, v, y): prior(v, y) for j in labelers for v in values for y in (0, 1)}
    share = {kind: 0.6 for kind in KINDS}
    posterior: list[float] = []
    for _ in range(rounds):
        posterior = []
        for kind, votes, _shape, _n in cells:
            odds = math.log(share[kind] / (1 - share[kind])) + sum(
                math.log(table[j, v, 1] / table[j, v, 0]) for j, v in enumerate(votes))
            posterior.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        for y in (0, 1):
            for j in labelers:
                mass = {v: strength * prior(v, y) for v in values}
                for (_k, votes, _s, n), p in zip(cells, posterior):
                    mass[votes[j]] += n * (p if y else 1 - p)
                total = sum(mass.values())
                table.update({(j, v, y): mass[v] / total for v in values})
        for kind in KINDS:
            own = [(n, p) for (k, _v, _s, n), p in zip(cells, posterior) if k == kind]
            share[kind] = ((0.6 * strength + sum(n * p for n, p in own))
                           / (strength + sum(n for n, _p in own)))
    return posterior, table


def _features(kind: str, votes: tuple, shape: int) -> list[str]:
    return ["bias", f"kind={kind}", f"shape={shape}",
            *[f"{name}={v}" for name, v in zip(LABELERS, votes)]]


def train_classifier(cells: list, posterior: list[float], rounds: int = 300,
                     rate: float = 0.5, decay: float = 0.002) -> dict[str, float]:
    """Logistic regression on the soft labels, one weight per feature value.

    Counts enter by their logarithm, so a hot pattern does not drown the rest.
    Pseudo-cells (each labeler alone, both ways) anchor unseen vote values.
    """
    rows = [(_features(k, v, s), p, math.log1p(n)) for (k, v, s, n), p in zip(cells, posterior)]
    rows += [(["bias", f"{name}={v}"], 0.85 if v > 0 else 0.15, 1.0)
             for name in LABELERS for v in (-1, 1)]
    weights: dict[str, float] = {}
    total = sum(n for _f, _p, n in rows)
    for _ in range(rounds):
        slope: dict[str, float] = {}
        for features, p, n in rows:
            z = sum(weights.get(f, 0.0) for f in features)
            error = n * (p - 1 / (1 + math.exp(-z)))
            for f in features:
                slope[f] = slope.get(f, 0.0) + error
        for f, g in slope.items():
            weights[f] = weights.get(f, 0.0) + rate * (g / math.sqrt(total) - decay * weights.get(f, 0.0))
    return weights


def fit(docs: DataFrame, text: str = "text") -> dict[str, float]:
    cells = vote_cells(docs, text)
    posterior, _table = expectation_maximisation(cells)
    return train_classifier(cells, posterior)


# --- apply -------------------------------------------------------------------

def _probability(c: Column, weights: dict[str, float]) -> Column:
    def pick(prefix: str, key: Column, values) -> Column:
        out = F.when(F.lit(False), 0.0)
        for v in values:
            out = out.when(key == F.lit(v), weights.get(f"{prefix}={v}", 0.0))
        return out.otherwise(0.0)
    z = F.lit(weights.get("bias", 0.0)) + pick("kind", c["kind"], KINDS) \
        + pick("shape", c["shape"], range(SHAPES))
    for j, name in enumerate(LABELERS):
        z = z + pick(name, c["votes"][j], (-1, 0, 1))
    return 1 / (1 + F.exp(-z))


def find(docs: DataFrame, weights: dict[str, float], text: str = "text", out: str = "pii",
         columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``columns``) with ``out``: accepted spans ``array<struct<
    ord, start, end, kind, p>>`` by kind as listed, then start."""
    columns = [c for c in (columns or docs.columns) if c != out]
    rows = (docs.select(F.struct(*columns).alias("_row"),
                        F.coalesce(F.col(text), F.lit("")).alias("_body"))
            .select("_row", "_body", candidates(F.col("_body")).alias("_all")))

    def accepted(spans: Column) -> Column:
        base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS) & s["ok"])

        def added(base: Column) -> Column:
            extra = F.filter(spans, lambda s: (
                ~s["kind"].isin(*BASE_KINDS) & s["ok"] & (_probability(s, weights) >= 0.5)
                & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))
            return F.sort_array(F.transform(F.concat(base, extra), lambda s: F.struct(
                s["ord"].alias("ord"), s["start"].alias("start"), s["end"].alias("end"),
                s["kind"].alias("kind"), F.round(_probability(s, weights), 6).alias("p"))))
        return bind(base, added)
    kind = "struct<ord:int,start:int,end:int,kind:string,p:double>"
    return rows.select(
        *[F.col("_row")[c].alias(c) for c in columns],
        F.when(F.size("_all") == 0, empty(kind)).otherwise(accepted(F.col("_all"))).alias(out))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by ``<KIND>``; overlapping spans become
    one replacement named after the first."""
    by_start = F.sort_array(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def put(a: Column, s: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, s["start"] - a["at"])
        fresh = s["start"] >= a["at"]
        return F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(a["out"], gap, F.lit("<"), F.upper(s["kind"]), F.lit(">")))
            .otherwise(a["out"]).alias("out"))
    folded = F.aggregate(
        by_start, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put,
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text) - a["at"])))
    return F.when(F.size(spans) == 0, text).otherwise(folded)


def digest(found: DataFrame, out: str = "pii") -> DataFrame:
    """The columns of query ``op9_pii_spans`` from ``find``'s result."""
    spans = F.col(out)
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(spans).alias("spans"))
