"""Article extraction: raw pages -> cleaned, quality-gated article records.

``pages(url, html)`` -> URL check -> article fields -> text and title
cleaning -> quality reason -> valid rows.  Everything is one projection and
one filter over the page table (no shuffle); the quality gate runs before
any embedding work, so later stages only see valid articles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import html as H
from skein.functions import text as TX


def extract_articles(pages: DataFrame, *, url: str = "url", html: str = "html",
                     extracted_at=None, min_length: int = TX.MIN_TEXT_LENGTH,
                     keep_invalid: bool = False, keep_bad_urls: bool = False) -> DataFrame:
    """Article records for the pages whose URL is valid and which pass the
    quality gate (``keep_invalid=True`` keeps every URL-valid page with its
    ``reason`` instead; with ``keep_bad_urls`` pages with an invalid URL are
    kept too, reason ``Invalid URL``).  Other columns of ``pages`` (e.g.
    ``page_id``) are carried along."""
    keep = [c for c in pages.columns if c not in (url, html)]
    names = H.ARTICLE_FIELDS
    src = pages if keep_bad_urls else pages.filter(TX.url_validate(url))
    rec = H.article_fields(src, html, url, extracted_at)
    # The cleaned record is built once as a one-element array of structs and
    # the gate is a lambda over it: a plain filter on the cleaned columns
    # would be pushed below the projection and re-run the regex chain for
    # every reference (expressions holding higher-order functions are not
    # shared by subexpression elimination).
    cleaned = F.struct(*[(TX.text_clean(n) if n in ("title", "text") else F.col(n)).alias(n)
                         for n in names])
    graded = F.transform(F.array(cleaned), lambda r: F.struct(
        *[r[n].alias(n) for n in names],
        F.when(~TX.url_validate(r["url"]), F.lit("Invalid URL"))
         .otherwise(TX.article_quality(r["title"], r["text"], r["url"], min_length))
         .alias("reason")))
    if not keep_invalid:
        graded = F.filter(graded, lambda r: r["reason"] == "Valid")
    out = rec.select(*keep, F.inline(graded))
    return out if keep_invalid else out.drop("reason")


def extraction_stats(pages: DataFrame, articles: DataFrame | None = None,
                     **kw) -> DataFrame:
    """total_extracted, total_failed, total_attempts, success_rate (0 when
    there were no attempts); one aggregate over the graded pages."""
    rec = extract_articles(pages, keep_invalid=True, keep_bad_urls=True, **kw) \
        if articles is None else articles
    s = rec.agg(F.count(F.lit(1)).alias("total_attempts"),
                F.count_if(F.col("reason") == "Valid").alias("total_extracted"))
    return s.select(
        "total_extracted",
        (F.col("total_attempts") - F.col("total_extracted")).alias("total_failed"),
        "total_attempts",
        F.coalesce(F.try_divide(F.col("total_extracted"), F.col("total_attempts")),
                   F.lit(0.0)).alias("success_rate"))
