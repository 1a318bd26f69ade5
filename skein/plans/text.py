"""Text, URL and HTML plans over ``pages``, ``documents`` and ``conversations``.

Each plan is one projection over a whole table: the expressions stay inside
one codegen stage and the Parquet scan reads only the projected columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import html as H
from skein.functions import text as TX
from skein.operators.extract import extract_articles
from skein.plans import sqltext as S
from skein.plans.registry import load, register

# Extraction time used by the slug plan (a parameter, not the wall clock).
SLUG_TIME = "2024-01-01 00:00:00"
SELECTOR = "div.ad"


@register("url_validate", sql="""
SELECT page_id, url, {v} AS url_valid FROM pages""".format(v=S.url_validate("url")))
def q_url_validate(spark, sf):
    p = load(spark, sf, "pages", spread=True)
    return p.select("page_id", "url", TX.url_validate("url").alias("url_valid"))


@register("url_domain", sql="""
SELECT page_id, {d} AS source_domain FROM pages""".format(d=S.url_domain("url")))
def q_url_domain(spark, sf):
    p = load(spark, sf, "pages", spread=True)
    return p.select("page_id", TX.url_domain("url").alias("source_domain"))


@register("html_strip", sql="""
SELECT page_id, {t} AS text FROM pages""".format(t=S.html_strip("html")))
def q_html_strip(spark, sf):
    p = load(spark, sf, "pages", spread=True)
    return p.select("page_id", H.html_strip("html").alias("text"))


@register("html_text", sql="""
SELECT page_id, {t} AS text FROM pages""".format(t=S.html_text("html")))
def q_html_text(spark, sf):
    p = load(spark, sf, "pages", spread=True)
    return p.select("page_id", H.html_text("html").alias("text"))


@register("html_select_text", sql="""
SELECT page_id, {t} AS selected_text FROM pages""".format(
    t=S.html_select_text("html", SELECTOR)))
def q_html_select_text(spark, sf):
    p = load(spark, sf, "pages", spread=True)
    return p.select("page_id", H.html_select_text("html", SELECTOR).alias("selected_text"))


@register("html_title", sql="""
SELECT page_id, {t} AS title FROM pages""".format(t=S.html_title("html")))
def q_html_title(spark, sf):
    p = load(spark, sf, "pages", spread=True)
    return p.select("page_id", H.html_title("html").alias("title"))


@register("html_meta", sql="""
WITH e AS (SELECT page_id, {m} AS entries FROM pages),
x AS (SELECT page_id, unnest(range(len(entries))) AS pos, unnest(entries) AS kv FROM e)
SELECT page_id, kv.key AS key, arg_max(kv.value, pos) AS value
FROM x GROUP BY page_id, kv.key""".format(m=S.meta_entries_sql("html")))
def q_html_meta(spark, sf):
    p = load(spark, sf, "pages", spread=True)
    entries = p.select("page_id", F.posexplode(H.html_meta_entries("html")).alias("pos", "kv"))
    # later duplicates win: the value at the highest position per key
    return (entries.groupBy("page_id", F.col("kv.key").alias("key"))
            .agg(F.max_by("kv.value", "pos").alias("value")))


@register("html_links", sql="""
WITH l AS (SELECT page_id, {l} AS links FROM pages)
SELECT page_id, unnest(range(len(links))) AS pos, unnest(links) AS link FROM l""".format(
    l=S.html_links("html", S.url_origin("url"))))
def q_html_links(spark, sf):
    p = load(spark, sf, "pages", spread=True)
    return p.select("page_id", F.posexplode(H.html_links("html", H.page_base("url")))
                    .alias("pos", "link")).withColumn("pos", F.col("pos").cast("bigint"))


@register("article_fields", sql="""
SELECT page_id, url, {title} AS title, {body} AS text, {dom} AS source_domain,
       '{method}' AS extraction_method
FROM pages""".format(title=S.html_title("html"), body=S.article_body("html"),
                     dom=S.url_domain("url"), method=H.EXTRACTION_METHOD))
def q_article_fields(spark, sf):
    p = load(spark, sf, "pages", spread=True)
    rec = H.article_fields(p.select("page_id", "url", "html"))
    return rec.select("page_id", "url", "title", "text", "source_domain", "extraction_method")


_CLEANED_PAGES = """
WITH f AS (SELECT page_id, url, {title} AS title, {body} AS text FROM pages),
c AS (SELECT page_id, url, {ct} AS title, {cx} AS text FROM f WHERE {valid})
""".format(title=S.html_title("html"), body=S.article_body("html"),
           ct=S.text_clean("title"), cx=S.text_clean("text"), valid=S.url_validate("url"))


@register("article_quality", sql=_CLEANED_PAGES + """
SELECT page_id, {q} AS reason FROM c""".format(q=S.article_quality("title", "text", "url")))
def q_article_quality(spark, sf):
    p = load(spark, sf, "pages", spread=True)
    arts = extract_articles(p, keep_invalid=True, extracted_at=F.lit(SLUG_TIME))
    return arts.select("page_id", "reason")


@register("article_extract", sql=_CLEANED_PAGES + """
SELECT page_id, url, title, text, {d} AS source_domain FROM c
WHERE {q} = 'Valid'""".format(d=S.url_domain("url"), q=S.article_quality("title", "text", "url")))
def q_article_extract(spark, sf):
    p = load(spark, sf, "pages", spread=True)
    arts = extract_articles(p, extracted_at=F.lit(SLUG_TIME))
    return arts.select("page_id", "url", "title", "text", "source_domain")


@register("file_slug", sql=_CLEANED_PAGES + """
SELECT page_id, {s} AS filename FROM c
WHERE {q} = 'Valid'""".format(s=S.file_slug("title", f"TIMESTAMP '{SLUG_TIME}'"),
                              q=S.article_quality("title", "text", "url")))
def q_file_slug(spark, sf):
    p = load(spark, sf, "pages", spread=True)
    arts = extract_articles(p, extracted_at=F.lit(SLUG_TIME).cast("timestamp"))
    return arts.select("page_id", TX.file_slug("title", "extracted_at").alias("filename"))


@register("text_clean", sql="""
SELECT doc_id, {c} AS text FROM documents""".format(c=S.text_clean("text")))
def q_text_clean(spark, sf):
    d = load(spark, sf, "documents", spread=True)
    return d.select("doc_id", TX.text_clean("text").alias("text"))


@register("text_hash", sql="""
SELECT doc_id, sha256(text) AS text_hash FROM documents""")
def q_text_hash(spark, sf):
    d = load(spark, sf, "documents", spread=True)
    return d.select("doc_id", TX.text_hash("text").alias("text_hash"))


@register("tokens", sql="""
WITH t AS (SELECT doc_id, {t} AS tok FROM documents)
SELECT doc_id, len(tok)::BIGINT AS n_tokens,
       sha256(array_to_string(list_sort(tok), ' ')) AS token_digest FROM t""".format(
    t=S.tokens("text")))
def q_tokens(spark, sf):
    d = load(spark, sf, "documents", spread=True)
    t = d.select("doc_id", TX.tokens("text").alias("tok"))
    return t.select("doc_id", F.size("tok").cast("bigint").alias("n_tokens"),
                    F.sha2(F.array_join(F.array_sort("tok"), " "), 256).alias("token_digest"))


@register("synonyms_relevancy", sql="""
SELECT conv_id, turn, {r} AS text FROM conversations""".format(
    r=S.rewrite("text", TX.RELEVANCY_REWRITES)))
def q_synonyms_relevancy(spark, sf):
    c = load(spark, sf, "conversations", spread=True)
    return c.select("conv_id", "turn", TX.synonyms_relevancy("text").alias("text"))


@register("synonyms_faithfulness", sql="""
SELECT conv_id, turn, {r} AS text FROM conversations""".format(
    r=S.rewrite("text", TX.FAITHFULNESS_REWRITES)))
def q_synonyms_faithfulness(spark, sf):
    c = load(spark, sf, "conversations", spread=True)
    return c.select("conv_id", "turn", TX.synonyms_faithfulness("text").alias("text"))


@register("dim_check", sql="""
SELECT vec_id, len(embedding)::INTEGER AS dim, len(embedding) = 64 AS dim_ok FROM embeddings""")
def q_dim_check(spark, sf):
    e = load(spark, sf, "embeddings")
    return e.select("vec_id", F.size("embedding").alias("dim"),
                    (F.size("embedding") == 64).alias("dim_ok"))
