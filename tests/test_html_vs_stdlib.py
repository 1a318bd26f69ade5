"""html_strip / html_text against a text dump made with Python's standard
``html.parser`` (script/style/template bodies and comments excluded,
character references decoded) on every page of the sf0.01 table."""

from html.parser import HTMLParser

from pyspark.sql import functions as F

from skein.functions import html as H


class _Dump(HTMLParser):
    RAW = ("script", "style", "template")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in self.RAW:
            self.skip += 1

    def handle_endtag(self, tag):
        if tag in self.RAW and self.skip:
            self.skip -= 1

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def _dump(html):
    d = _Dump()
    d.feed(html)
    d.close()
    return d.parts


def test_pages_match_stdlib_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.select("page_id", "html", H.html_strip("html").alias("strip"),
                        H.html_text("html").alias("text")).collect()
    assert len(rows) == 250
    for r in rows:
        parts = _dump(r.html)
        assert r.strip == "".join(parts), r.page_id
        assert r.text == "".join(p.strip() for p in parts if p.strip()), r.page_id


def _column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, h string")
    return [r[0] for r in rows.orderBy("i").select(expr.alias("x")).collect()]


def test_references_match_stdlib(spark):
    import html as std
    texts = ["caf&eacute; &AMP; &CounterClockwiseContourIntegral;", "a &amp;lt; b &#38;amp;",
             "&notit; &notin; &copy2 &nosuch; & &; &#;", "&#00000000065; &#x0000000041;",
             "&#0; &#xD800; &#9999999; &#99999999999; &#xFFFFFFFFFF; &#1114112;",
             "&#128; &#150; &#x80;", "&fjlig; &acE; &Aacute &Aacut", "plain", "", None,
             "&#65 &#x41 " * 3, "x&amp" * 50_000]
    got = _column(spark, texts, H.decode_entities("h"))
    for text, found in zip(texts, got):
        assert found == (None if text is None else std.unescape(text)), text


def test_every_name_is_decoded(spark):
    from html.entities import html5
    names = [n for n in html5 if n.endswith(";")]
    assert _column(spark, ["&" + n for n in names], H.decode_entities("h")) == [html5[n] for n in names]


def test_quoted_bracket_does_not_end_a_tag(spark):
    texts = ['<p>a<b title="x > y">b</b> c</p>', "<p>a<b title='\">'>body</b></p>",
             '<img alt="a > b"/>t', "<a href=x'y>z</a>", '<script data-x=">">no</script>yes',
             "1 < 2 <b>x</b>", '<p title = "a\n>b">q</p>']
    got = _column(spark, texts, H.html_strip("h"))
    assert got == ["".join(_dump(t)) for t in texts]


def test_attributes_in_order(spark):
    metas = ['<meta content="a name=b c" name="description">',
             "<META NAME='Description' CONTENT='x > y &eacute; &copy=1'>",
             '<meta name=description content=plain name=late>', '<meta name content="v">',
             '<!-- <meta name="c" content="d"> -->']
    assert _column(spark, metas, H.html_meta("h")) == [
        {"description": "a name=b c"}, {"Description": "x > y \u00e9 &copy=1"},
        {"description": "plain"}, {}, {}]
    links = ['<a title="x > y" href="http://a/b">t</a>', "<a data-href='http://no' href=/r>t</a>",
             '<a href="http://a/?x=1&copy=2&amp;y=3">t</a>', '<a href>t</a><abbr href="http://n">']
    assert _column(spark, links, H.html_links("h", F.lit("http://s/"))) == [
        ["http://a/b"], ["http://s/r"], ["http://a/?x=1&copy=2&y=3"], []]


def test_all_article_fields(spark):
    page = ('<html><head><title>T &gt; U</title><meta name="author" content="A B, C">'
            '<meta property="article:published_time" content="2024-05-06T07:08:09Z">'
            '<meta property="og:image" content="http://i/x.png?a=1&amp;b=2">'
            '<meta content="d > e" name="description"><meta name=keywords content="k1, k2">'
            '</head><body><article class="a>b"><p>One.</p><p>Two.</p></article></body></html>')
    row = H.article_fields(spark.createDataFrame([("http://h.org/p", page)], "url string, html string"),
                           extracted_at=F.lit("2024-01-01 00:00:00")).first().asDict()
    assert row["publish_date"].strftime("%Y-%m-%d %H:%M:%S") == "2024-05-06 07:08:09"
    assert {k: row[k] for k in H.ARTICLE_FIELDS if k not in ("publish_date", "extracted_at")} == {
        "url": "http://h.org/p", "title": "T > U", "authors": ["A B", "C"], "text": "One.\n\nTwo.",
        "top_image": "http://i/x.png?a=1&b=2", "meta_description": "d > e",
        "meta_keywords": ["k1", "k2"], "source_domain": "h.org",
        "extraction_method": H.EXTRACTION_METHOD}
