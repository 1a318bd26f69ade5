"""The remaining operators against brute force, round trips and held-out rows."""

import random
import re
import zlib
from collections import defaultdict

import brute
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import components, decontaminate, html_content, jaccard, langid, packing, queries, warc
from skein.session import shared_path

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TEXTS = "doc_id long, text string"


def key(row):
    return tuple((x is None, x) for x in row)


# --- n-gram Jaccard join -------------------------------------------------------

def variants(seed):
    """Random texts with copies, near copies at every similarity, a shared
    passage, short texts, and the awkward rows."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    rows = []
    for base in range(8):
        text = [rng.choice(words) for _ in range(rng.choice([3, 6, 12, 40, 90]))]
        if base % 2:
            text += passage
        for _ in range(10):
            copy = list(text)
            for _ in range(min(len(copy) - 1, rng.choice([0, 0, 1, 1, 2, 3, 5, 9]))):
                at = rng.randrange(len(copy))
                copy[at:at + 1] = rng.choice([[], [rng.choice(words)], [copy[at], "x"]])
            rows.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    rng.shuffle(rows)
    return [(i + 100, t) for i, t in enumerate(rows)] + brute.rows()


@pytest.mark.parametrize("seed,counters,cell", [(1, 1 << 20, 1024), (2, 64, 3), (3, 1, 1024), (5, 1 << 14, 2)])
def test_jaccard_classes(spark, seed, counters, cell):
    rows = variants(seed)
    docs = spark.createDataFrame(rows, TEXTS).repartition(5)
    got = sorted(map(tuple, jaccard.classes(docs, counters=counters, cell=cell).collect()), key=key)
    assert got == sorted(brute.components(rows), key=key)


def test_jaccard_string_ids(spark):
    rows = [(None if i is None else f"doc-{i}", t) for i, t in variants(6)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    got = sorted(map(tuple, jaccard.classes(docs).collect()), key=key)
    assert got == sorted(brute.components(rows), key=key)


def test_jaccard_unlinked_crowd(spark):
    """Many sets around one shared passage, few of them linked: the cells' trees
    find the links without a row for each pair."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(300):
        tail = [f"t{rng.randrange(10 ** 6)}" for _ in range(rng.randint(8, 20))]
        rows.append((i, " ".join(passage + tail)))
        if i % 50 == 0:
            rows.append((1000 + i, " ".join(passage + tail[:-1] + ["end"])))
    docs = spark.createDataFrame(rows, TEXTS).repartition(4)
    got = sorted(map(tuple, jaccard.classes(docs).collect()), key=key)
    assert got == sorted(brute.components(rows), key=key)


def test_sketch_counts_every_gram(spark):
    rows = [(i, f"common words stand here always and then comes word{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "id long, text string").select(
        "id", F.col("text").cast("binary").alias("t")).repartition(40)
    order = jaccard._order(jaccard._sketch(docs, 1 << 12), 1 << 12)
    sets = [jaccard.grams(t.encode()) for _, t in rows]
    assert int(order.table.sum()) == sum(map(len, sets))
    common = set.intersection(*[set(x.tolist()) for x in sets])
    assert common and all(order.counts(np.array([g], np.uint64))[0] >= 40 for g in common)


def test_jaccard_empty_and_representatives(spark):
    none = spark.createDataFrame([], TEXTS)
    assert jaccard.classes(none).count() == 0
    rows = variants(4)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], TEXTS + ", h string")
    kept = sorted((tuple(r) for r in jaccard.representatives(docs).select("doc_id").collect()), key=key)
    want = {(i,) for i, _n, c in brute.components(rows) if i == c} | {(None,)}
    assert kept == sorted(want, key=key)


def test_prefix_tree_finds_all_links():
    rng = random.Random(5)
    sets = []
    for _ in range(200):
        base = set(rng.sample(range(60), rng.randint(1, 40)))
        sets.append(np.array(sorted(base), np.uint64))
    tree = jaccard.Tree(sets)
    for probe in sets[:50]:
        want = [i for i, s in enumerate(sets)
                if 100 * len(np.intersect1d(s, probe)) >= 75 * len(np.union1d(s, probe))]
        assert sorted(tree.links(probe)) == want


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    edges += [(i, i + 1) for i in range(300, 360)] + [(500, 500), (None, 3), (3, None)]
    got = {r["node"]: r["component"] for r in components.components(
        spark.createDataFrame(edges, "u long, v long")).collect()}
    low = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(100):
        for u, v in edges:
            if u in low and v in low:
                low[u] = low[v] = min(low[u], low[v])
    assert got == low


# --- benchmark decontamination ---------------------------------------------------

def test_edit_distance():
    rng = random.Random(7)
    for _ in range(200):
        pattern = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 70)))
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 90)))
        assert decontaminate.distance(pattern, text)[0] == brute.nearest(pattern, text)


def leak_rows():
    rng = random.Random(8)
    words = ["al", "be", "cär", "dog", "elf", "fun", "gnu", "hat"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(3, 40))).capitalize() + ".")
             for k in range(12)] + [(12, None), (13, ""), (12, "same item under a second row here")]
    rows = []
    for i in range(60):
        item = rng.choice(items[:12])[1]
        text = list(item)
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 6])):
            at = rng.randrange(len(text))
            text[at:at + 1] = rng.choice([[], ["z"], [text[at], " "]])
        noise = [rng.choice(words + ["xylo", "yarn"]) for _ in range(rng.randint(0, 30))]
        rows.append((i, " ".join(noise) + " ?! " + "".join(text) + "\n" + " ".join(noise[:5])))
    return rows + [(None, items[5][1]), (3, None), (4, ""), (5, rows[0][1]), (5, rows[0][1])], items


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 6])
def test_leaks(spark, block):
    rows, items = leak_rows()
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], TEXTS + ", item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find(docs.drop("item_id"), bench, block=block).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in found), key=str) \
        == brute.leaks(rows, items)
    by_id = defaultdict(list)
    for i, t in rows:
        by_id[i].append(t)
    for r in found:     # the span is where the item stands
        assert any(brute.nearest(brute.plain(dict(reversed(items))[r["item_id"]]),
                                 brute.plain((t or "")[r["start"]:r["end"]])) <= r["distance"] + 3
                   for t in by_id[r["doc_id"]]) or r["item_id"] == 12
    gone = {(i, t) for i, t in rows if brute.leaks([(i, t)], items)}
    kept = decontaminate.clean(docs, bench, block=block)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=key) \
        == sorted([x for x in rows if x not in gone], key=key)


def test_leaks_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame(brute.rows(), TEXTS)
    assert decontaminate.find(docs, none).count() == 0
    assert decontaminate.clean(docs, none).count() == len(brute.rows())


def test_leaks_of_the_benchmark(spark):
    con = duckdb.connect()
    rows = con.execute(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    items = con.execute(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall()
    got = {(r["doc_id"], r["item_id"]) for r in queries.op2_benchmark_leaks(spark, SMALL).collect()}
    exact = {(d, i) for d, t in rows for i, x in items if brute.plain(x) in brute.plain(t)}
    assert exact <= got


# --- WARC ---------------------------------------------------------------------------

def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, "é\r\n\r\nü"),
            (4, "http://c", None), (5, "http://d", ""), (None, "http://e", "<p>x</p>"),
            (2, "http://b", "<p>x</p>"), (6, "http://f", "y" * 100_000), (None, "http://g", "alone")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, n string")
    path = shared_path(spark, "warc")
    warc.write(df, path)
    got = warc.read(spark, path).select("*", warc.record_bytes().alias("raw")).collect()
    assert len(got) == len(rows)
    kinds = {(r["id"], r["uri"]): (r["record_type"], r["refers_to"]) for r in got}
    assert kinds[1, "http://a"] == ("revisit", "2") and kinds[None, "http://e"] == ("revisit", "2")
    assert kinds[2, "http://b"] == ("response", None) and kinds[4, "http://c"] == ("revisit", "5")
    assert kinds[None, "http://g"] == ("response", None)
    assert sorted(bytes(r["payload"]).decode() for r in got) == sorted(x[2] or "" for x in rows)
    for r in got:
        head, rest = bytes(r["raw"]).split(b"\r\n\r\n", 1)
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert rest[size:] == b"\r\n\r\n"
    assert spark.read.parquet(f"{path}/payloads").count() == 5
    warc.export(spark, path, f"{path}/files")
    files = spark.read.format("binaryFile").load(f"{path}/files/*.txt").collect()
    assert sum(bytes(f["content"]).count(b"WARC/1.1\r\n") for f in files) == len(rows)
    assert sum(len(f["content"]) for f in files) == sum(len(r["raw"]) for r in got)


def test_warc_empty(spark):
    path = shared_path(spark, "warc")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 0


# --- language ID -----------------------------------------------------------------------

def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op6_language_id(spark, SF).join(docs, "doc_id")
    row = got.agg(F.avg(F.when(F.col("held_out"), (F.col("lang") == F.col("lang_pred")).cast("int"))),
                  F.avg(F.col("rejected").cast("int")), F.min("score"), F.max("score")).first()
    assert row[0] >= 0.98 and row[1] <= 0.002 and 0 <= row[2] <= row[3] <= 1
    ids = {r["doc_id"]: r["held_out"] for r in got.collect()}
    assert all(held == (zlib.crc32(str(i).encode()) % 4 == 2) for i, held in ids.items())


def test_language_awkward(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 2 = 0")
    model = langid.train(docs)
    odd = brute.rows() + [(90, "123 !!"), (91, "qzx kvj wqp xzk qqv jjx zzq wvk pqx " * 20)]
    got = {(r["doc_id"], r["text"]): r for r in langid.identify(
        spark.createDataFrame([(i, t, "?") for i, t in odd], TEXTS + ", score string"), model).collect()}
    assert got[0, None]["lang_pred"] == got[1, ""]["lang_pred"] == got[90, "123 !!"]["lang_pred"] == "und"
    assert got[90, "123 !!"]["rejected"] and got[91, odd[-1][1]]["rejected"]
    assert got[7, "word " * 6000]["lang_pred"] in model.langs
    none = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in langid.identify(
        spark.createDataFrame(brute.rows(), TEXTS), none).collect()} == {"und"}


def test_kneser_ney_is_a_distribution():
    rng = np.random.default_rng(9)
    a, b, c = rng.integers(0, 9, (3, 400))
    keys, n = np.unique(a << 14 | b << 7 | c, return_counts=True)
    model = langid.KneserNey(keys, n)
    for context in (0, 1, 77, int(keys[0]) >> 7):
        total = np.exp(model.log_prob((context << 7) + np.arange(langid.ALPHABET))).sum()
        assert abs(total - 1) < 1e-9


def test_pieces_of_long_texts(monkeypatch):
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(["abc déf " * 50, None, "x", "!"])], ["t"])
    whole = np.concatenate([g for g, _o in langid.pieces(batch, 0)], 1)
    monkeypatch.setattr(langid, "PIECE", 7)
    parts = np.concatenate([g for g, _o in langid.pieces(batch, 0)], 1)
    assert (whole == parts).all() and whole.shape[1] > 100


# --- HTML extraction ----------------------------------------------------------------------

def article_text(page):
    """The article's blocks of the given pages, read off their fixed layout."""
    import html as h
    body = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    blocks = re.split(r"</?(?:h1|p)>", body)
    texts = (" ".join(h.unescape(re.sub(r"<[^>]*>?", " ", b)).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def test_main_text_of_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.op7_main_text(spark, SF).collect()}
    same = [got[p["page_id"]]["text"] == article_text(p["html"]) for p in pages]
    assert sum(same) >= 0.98 * len(same)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


ODD_PAGE = """<html><body><header class=top>Site</header><div class="cookie-notice">We use cookies</div>
<main><article><h1>Caf&eacute; &#38; bar</h1><p>First   <b>bold</b> para<p>Second&nbsp;para
<ul><li>one<li>two</ul><div class="ad">Buy now</div><table><tr><td>cell</table>
<script>if (a < b) { "</p>" }</script><!-- no --></article>
<section id="comments"><p>Great post!</p></section></main>
<aside><a href="/x">More</a></aside><form><label>Mail</label><input></form><footer>&copy; x</footer>"""


def test_main_text_of_odd_pages(spark):
    rows = [(1, "u", ODD_PAGE), (2, "u", None), (3, None, ""), (4, "u", "plain < text"), (None, "u", "<p>x"),
            (5, "u", "<" * 5000 + "<a href='"), (5, "u", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    model = html_content.train(spark.read.parquet(f"{SF}/pages.parquet"))
    got = html_content.extract(pages, model, columns=["page_id", "url"]).collect()
    by = defaultdict(list)
    for r in got:
        by[r["page_id"]].append(r["text"])
    assert by[1][0].split("\n") == ["Café & bar", "First bold para", "Second para", "one", "two", "cell"]
    assert by[2] == by[3] == [""] and len(got) == len(rows)
    prior = html_content.train(spark.createDataFrame([], "page_id long, html string"))
    assert "First bold para" in prior.extract(ODD_PAGE) and "Buy now" not in prior.extract(ODD_PAGE)


def test_marginals_are_exact():
    from itertools import product
    import math
    model = html_content.ContentModel({})
    page = html_content.parse("<div><p>a</p><nav>b</nav></div><p>c</p>")
    own = model.unaries(page)
    mass = [0.0] * len(own)
    total = 0.0
    for labels in product((0, 1), repeat=len(own)):
        w = math.exp(sum(own[i][y] for i, y in enumerate(labels)) + sum(
            model.pair[html_content.tie(n), labels[n.parent]][labels[i]]
            for i, n in enumerate(page.nodes) if i))
        total += w
        for i, y in enumerate(labels):
            mass[i] += w * y
    assert model.marginals(page) == pytest.approx([m / total for m in mass])


# --- packing -----------------------------------------------------------------------------------

def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    rows = brute.rows() + [(200, " odd  word"), (201, "<|startoftext|> x <|endoftext|>"),
                           (202, "combine é ́   ÀÉ don't"), (203, "tok " * 4095), (204, "tok " * 4096)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], TEXTS + ", piece int").repartition(3)
    cut = packing.pieces(docs, packing.default_tokenizer()).cache()
    placed = packing.pack(cut, per_packer=7).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at:at + 4096], "<u4").tobytes()
            want.append((i, k, at, len(part) // 4, zlib.crc32(part)))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in placed]
    assert sorted(got, key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in placed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(packing.pieces(spark.createDataFrame([], TEXTS),
                                       packing.default_tokenizer())).count() == 0


ODD_WORDS = ["tok", "don't", "H\u0331", "I\u0307x", "\u0130", "\ufb01n", "\u212b", "e\u0301", "a\u00a0b", "a\u2003", "\ue000",
             "x\ue000y", "<|endoftext|>", "\x00", "\x1c", "\u0085", "\u6c49\u5b57", "\U0001f44d\U0001f3fd", "\u00c0\u00c9", "***"]


def test_words_are_encoded_as_in_their_text():
    rng = random.Random(3)
    words = packing.WordEncoder(packing.default_tokenizer())
    for k in range(60):
        texts = [" ".join(rng.choices(ODD_WORDS + [f"w{rng.random()}" for _ in range(5)], k=rng.randrange(9)))
                 for _ in range(4)]
        got = list(words.encode([t.encode() for t in texts]))
        assert got == [np.array(words._ids(t), "<u4").tobytes() for t in texts]
        if k % 7 == 0:
            words.forget()


def test_plain_words_need_no_mark(monkeypatch):
    words = packing.WordEncoder(packing.default_tokenizer())
    monkeypatch.setattr(words, "_learn_by_mark", None)      # twice the time
    text = " ".join(f"Word{i}, caf\u00e9{i}" for i in range(2000))
    assert list(words.encode([text.encode()])) == [np.array(words._ids(text), "<u4").tobytes()]


def test_worker_keeps_few_words_after_a_partition(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBER_BYTES", 40_000)
    monkeypatch.setattr(packing, "STAY_BYTES", 10_000, raising=False)
    words = packing.WordEncoder(packing.default_tokenizer())
    often = b" ".join(b"often%d" % i for i in range(20))
    for i in range(40):
        list(words.encode([often + b" " + b" ".join(b"once%d-%d" % (i, k) for k in range(20))]))
    words.forget()
    assert not words.old and words.held <= 10_000 + 200
    assert set(often.split()) <= set(words.young)


def test_best_fit_rule():
    bins = packing.Bins(10, 2)
    assert [bins.put(n) for n in (6, 7, 3, 4, 9, 8, 1)] == [
        (0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (2, 9)]
    assert bins.put(5) == (4, 0) and bins.put(6) == (5, 0)     # the bin of 8 closed first
    assert bins.put(2) == (5, 6)


def test_packing_is_tight(spark):
    got = queries.op8_packing(spark, SF)
    row = got.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert row[1] <= 1.02 * -(-row[0] // 4096) + 1


# --- main text of unmarked and odd layouts ----------------------------------------------------

PROSE = "The council met on Tuesday to discuss the new plan for the old bridge, which many people wanted. "


@pytest.fixture(scope="module")
def content_model():
    from collections import Counter
    total = Counter()
    for (source,) in duckdb.execute(f"SELECT html FROM '{SMALL}/pages.parquet'").fetchall():
        total.update(html_content.counts(html_content.parse(source or "")))
    return html_content.ContentModel(total)


@pytest.mark.parametrize("new,end", [("<div>", "</div>"), ("", ""), ('<div class="wrap"><div>', "</div></div>")])
def test_main_text_without_the_mark(content_model, new, end):
    """The given pages, their article element renamed or taken away."""
    pages = [p for (p,) in duckdb.execute(f"SELECT html FROM '{SF}/pages.parquet'").fetchall()]
    same = [content_model.extract(p.replace("<article>", new).replace("</article>", end)) == article_text(p)
            for p in pages]
    assert sum(same) >= 0.98 * len(same)


def test_main_text_of_unmarked_layouts(content_model):
    get, one = content_model.extract, PROSE.strip()
    assert get(f"<p>{PROSE}</p><p>{PROSE}</p>") == f"{one}\n{one}"
    assert get(PROSE) == one and get(f"<body>{PROSE * 2}") == f"{one} {one}"
    assert get(f"<div class=wrap><p>{PROSE}</p><p>{PROSE}</p></div>") == f"{one}\n{one}"
    menu = "<a href=/>Home</a> <a href=/n>News</a> <a href=/s>Sport</a>"
    assert get(f"<table><tr><td>{menu}</td><td>{PROSE * 3}</td></tr></table>") == " ".join([one] * 3)
    assert get(f"<nav>{menu}</nav>") == "" and get("<p>Short.</p>") == "Short."
    full = get(f"<nav><ul><li>{menu}</li></ul></nav><div><h1>Title</h1><p>{PROSE}</p></div><footer>&copy; x</footer>")
    assert full == f"Title\n{one}"


def test_main_text_markup_rules(content_model):
    get, one = content_model.extract, PROSE.strip()
    assert get(f"<article><p>{PROSE}</p><script src=/a/>var x=1</script><p>{PROSE}</p></article>") == f"{one}\n{one}"
    assert get(f"<article><p>{PROSE}<math><mi>x</mi></math> and <svg><text>y</text></svg></p></article>") \
        == f"{one} x and y"
    hidden = ("<p hidden>a</p><p style='display:none'>b</p><span style=\"x:1;display: none\">c</span>"
              "<div hidden><p>d</p></div><p title='hidden'>Stay here, as the title alone says so.</p>")
    assert get(f"<article><p>{PROSE}</p>{hidden}</article>") == f"{one}\nStay here, as the title alone says so."


@pytest.mark.parametrize("source", ["<div>" * 100_000, "<div>" * 50_000 + "</section>" * 50_000,
                                    "<b>" * 100_000 + "</i>" * 50_000, "<p><blockquote>" * 50_000,
                                    "<span>" * 50_000 + "<p>x</p>" * 50_000, "<ul><li>" * 50_000 + "</ol>" * 50_000])
def test_hostile_pages_take_linear_time(content_model, source):
    import time
    begun = time.process_time()
    content_model.extract(source)
    assert time.process_time() - begun < 5


def test_warc_headers_cannot_be_forged(spark):
    """Values with line ends stay in their line; every record is dated and read back."""
    from datetime import datetime, timezone
    evil = ["http://a\r\nWARC-Payload-Digest: sha1:AAAA", "http://b\r\n\r\nzz", "http://c d<e>%0D%0A", "\n", "", None]
    rows = [(f"id>{k}\r\nX: %0D", u, "<p>same</p>" if k % 2 else f"<p>{k}\r\n\r\n</p>") for k, u in enumerate(evil)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    path = shared_path(spark, "warc")
    warc.write(df, path, date=datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone.utc))
    got = warc.read(spark, path).select("*", warc.record_bytes().alias("raw")).collect()
    assert sorted(((r["id"], r["uri"], bytes(r["payload"]).decode()) for r in got), key=str) == sorted(rows, key=str)
    top = max(i for i, _, h in rows if "same" in h)
    assert {r["refers_to"] for r in got if r["record_type"] == "revisit"} == {top}
    allowed = {"WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Refers-To",
               "WARC-Profile", "Content-Type", "Content-Length"}
    for r in got:
        head, body = bytes(r["raw"]).split(b"\r\n\r\n", 1)
        lines = head.decode().split("\r\n")
        names = [x.split(": ")[0] for x in lines[1:]]
        assert lines[0] == "WARC/1.1" and set(names) <= allowed and len(set(names)) == len(names)
        assert "WARC-Date: 2024-05-06T07:08:09Z" in lines and r["date"] == "2024-05-06T07:08:09Z"
        size = int(next(x for x in lines if x.startswith("Content-Length"))[16:])
        assert body[size:] == b"\r\n\r\n"


def test_short_items_are_searched_exactly(spark):
    items = [(1, "the cat sat"), (2, "yes or no"), (3, "Go"), (4, "?!"), (5, "北京"), (6, None)]
    rows = [(1, "See: the CAT, sat; there"), (2, "the cat sated"), (3, "yes or\nno"), (4, "yes or nothing"),
            (5, "going gone"), (6, "let us go"), (7, "在北京的人"), (8, ""), (9, None), (10, "other the cat  sat")]
    docs = spark.createDataFrame(rows, TEXTS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.find(docs, bench).collect()}
    assert found == {(1, 1, 0), (10, 1, 0), (3, 2, 0), (6, 3, 0), (7, 5, 0)}
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == {2, 4, 5, 8, 9}


def test_words_apart_from_the_rules_have_the_same_ids():
    rng = random.Random(8)
    words = packing.WordEncoder(packing.default_tokenizer())
    assert words.plain is not None
    odd = ODD_WORDS + ["Aḇ", "H̱", "<|ENDOFTEXT|>", "x<|StartOfText|>,", "CafÉ", "été,", "÷", "it's", "We'LL", "a-b",
                       "straße!!", "ª", "µm", "AΣ", "(foo)", "foo...", "x_y", "Å", "naïve;", "n0", "è"]
    for k in range(80):
        texts = ["".join(rng.choice(odd + ["Word", "wORD,"]) + rng.choice([" ", "\n", "\t ", "\x0b", "\x0c\r"])
                         for _ in range(rng.randrange(12))) for _ in range(5)] + ["", " "]
        got = list(words.encode([t.encode() for t in texts]))
        assert got == [np.array(words._ids(t), "<u4").tobytes() for t in texts]
        if k % 9 == 0:
            words.forget()


def test_words_in_capitals_and_before_punctuation_are_encoded_once(monkeypatch):
    words = packing.WordEncoder(packing.default_tokenizer())
    asked = []
    real = words._ids
    monkeypatch.setattr(words, "_ids", lambda text, *more: asked.append(text) or real(text, *more))
    list(words.encode([b"Word word, WORD... word"]))
    assert " ".join(asked).split().count("word") == 1 and "Word" not in " ".join(asked)
