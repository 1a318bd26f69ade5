"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text.  A ledger
table keeps, per blob, which rule versions have scanned it and what they
found; a scan reads only the blobs that some current rule version has not yet
seen, runs only the missing rules on them, appends to the ledger and joins the
findings back to all paths and versions that hold the blob.

Ledger rows: ``blob_id binary, rules array<string>, spans
array<struct<rule, start, end>>``; ``rules`` names the rule versions
(``kind@version``) run in that scan, so a blob without findings is also known.

Defined results: a null text is the empty blob and has no findings; repeated
rows each get the blob's findings; an empty table gives no rows and an empty
ledger segment; columns other than the text pass through untouched, so names
like ``blob_id`` or ``spans`` in the input cannot clash (the operator's own
columns are made in a separate struct).
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from skein.llm.native import empty, match_spans, spans_text

FOUND = "struct<rule:string,start:int,end:int>"


@dataclass(frozen=True)
class Rule:
    """One versioned rule: ``may_hold`` is a cheap necessary condition."""
    kind: str
    version: int
    pattern: str
    may_hold: Callable[[Column], Column]
    keep: Callable[[Column], Column]

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# Fixed patterns of the base rules.
ASSIGN = (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"([A-Za-z0-9+/_.=-]+)")


def _names_a_secret(text: Column) -> Column:
    low = F.lower(text)
    return (low.contains("passw") | low.contains("secret") | low.contains("token")
            | (low.contains("api") & low.contains("key")))


def _always(_m: Column) -> Column:
    return F.lit(True)


RULES: tuple[Rule, ...] = (
    # the base matches `[A-Z0-9]+` and `[0-9a-f]+` are maximal runs, so asking
    # for the least length inside the pattern finds the same spans
    Rule("assign", 1, ASSIGN, _names_a_secret,
         lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}+", lambda t: t.contains("AKIA"), _always),
    Rule("hex", 1, r"[0-9a-f]{32,}+", lambda t: t.rlike(r"[0-9a-f]{32}"), _always),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----",
         lambda t: t.contains("PRIVATE KEY-----"), _always),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}+",
         lambda t: t.contains("gh") & t.rlike(r"gh[pousr]_[A-Za-z0-9]{36}"), _always),
    Rule("slack", 1, r"xox[baprs]-[A-Za-z0-9-]{10,}+", lambda t: t.contains("xox"), _always),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
         lambda t: t.contains(".eyJ"), _always),
)
BASE_KINDS = ("assign", "access", "hex")


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def scan_text(text: Column, todo: Column, rules: tuple[Rule, ...]) -> Column:
    """Findings in ``text`` of the rules whose key is in ``todo``."""
    def found(rule: Rule) -> Column:
        spans = F.transform(
            F.filter(match_spans(text, rule.pattern), lambda s: rule.keep(s["m"])),
            lambda s: F.struct(F.lit(rule.key).alias("rule"), s["start"].alias("start"),
                               s["end"].alias("end")))
        return F.when(F.array_contains(todo, rule.key) & rule.may_hold(text),
                      spans).otherwise(empty(FOUND))
    return F.concat(*map(found, rules))


def read_ledger(spark, ledger: str) -> DataFrame:
    """The ledger's rows; a ledger that was never written is empty."""
    schema = f"blob_id binary, rules array<string>, spans array<{FOUND}>"
    if not _exists(spark, ledger):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(ledger)


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def unseen(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES,
           text: str = "text") -> DataFrame:
    """One row per blob that some rule version has not scanned:
    ``blob_id, text, todo``.  Copies collapse before and after the shuffle."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    body = F.coalesce(F.col(text), F.lit(""))
    blobs = (versions.select(blob_id(body).alias("blob_id"), body.alias("text"))
             .groupBy("blob_id").agg(F.first("text").alias("text")))
    done = (ledger.select("blob_id", F.explode("rules").alias("rule")).distinct()
            .groupBy("blob_id").agg(F.collect_set("rule").alias("done")))
    return (blobs.join(done, "blob_id", "left")
            .select("blob_id", "text",
                    F.array_except(keys, F.coalesce("done", empty("string"))).alias("todo"))
            .where(F.size("todo") > 0))


def update_ledger(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES,
                  text: str = "text") -> None:
    """Scan the unseen blob and rule-version pairs and append them."""
    spark = versions.sparkSession
    new = unseen(versions, read_ledger(spark, ledger), rules, text)
    (new.select("blob_id", F.col("todo").alias("rules"),
                scan_text(F.col("text"), F.col("todo"), rules).alias("spans"))
     .write.mode("append").parquet(ledger))


def findings(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES,
             text: str = "text", out: str = "secrets",
             columns: list[str] | None = None) -> DataFrame:
    """``versions`` (or its ``columns``) with a column ``out``:
    ``array<struct<start, ord, end, kind>>`` ordered by start, then rule.

    A blob that a third of all paths share joins as a skewed key, which
    adaptive execution splits on the side of the paths.
    """
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    kinds = F.create_map(*[x for r in rules for x in (F.lit(r.key), F.lit(r.kind))])
    item = F.struct(F.col("s.start").alias("start"), order[F.col("s.rule")].alias("ord"),
                    F.col("s.end").alias("end"), kinds[F.col("s.rule")].alias("kind"))
    found = (read_ledger(versions.sparkSession, ledger)
             .where(F.size("spans") > 0)
             .select(F.col("blob_id").alias("_blob"), F.explode("spans").alias("s"))
             .where(F.col("s.rule").isin([r.key for r in rules]))
             .groupBy("_blob").agg(F.sort_array(F.collect_set(item)).alias("_found")))
    columns = [c for c in (columns or versions.columns) if c != out]
    paths = versions.select(F.struct(*columns).alias("_row"),
                            blob_id(F.coalesce(F.col(text), F.lit(""))).alias("_key"))
    kind = "struct<start:int,ord:int,end:int,kind:string>"
    joined = paths.join(found, paths["_key"] == found["_blob"], "left")
    return joined.select(*[F.col("_row")[c].alias(c) for c in columns],
                         F.coalesce("_found", empty(kind)).alias(out))


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES,
         text: str = "text", out: str = "secrets",
         columns: list[str] | None = None) -> DataFrame:
    """Bring the ledger up to date and return all findings of all versions."""
    update_ledger(versions, ledger, rules, text)
    return findings(versions, ledger, rules, text, out, columns)


def digest(found: DataFrame, out: str = "secrets") -> DataFrame:
    """The columns of query ``op1_secret_scan`` from ``scan``'s result."""
    spans = F.col(out)
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(spans).alias("spans"))
