"""Cases of the second review: inputs on which an operator did less than its job."""

import random
from collections import Counter
from functools import cache

import brute
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from skein.llm import decontaminate, html_content, langid, pii

TEXTS = "doc_id long, text string"


# --- personal data ---------------------------------------------------------------

ZERO_PARTS = ["10.0.0.1", "0.0.0.0", "000.00.0.255", "see 192.168.0.1, 127.0.0.1 and 255.255.255.0",
              "0000.0.0.00256 0.0.0.256 1.2.3.4", "0" * 3_000 + ".0.0.0 " + "0" * 3_000 + "256.0.0.0"]


def test_addresses_with_zero_parts(spark):
    docs = spark.createDataFrame(list(enumerate(ZERO_PARTS)), TEXTS)
    got = {r["doc_id"]: r for r in pii.digest(pii.find(docs, pii.fit(docs))).collect()}
    for i, text in enumerate(ZERO_PARTS):
        want = brute.private(text)
        assert (got[i]["n_ip"], got[i]["base_sha256"]) == (want[1], want[4]), text[:40]


def test_addresses_with_zero_parts_are_masked(spark):
    docs = spark.createDataFrame([(1, "host 10.0.0.1 up")], TEXTS)
    found = pii.find(docs, pii.fit(docs))
    assert found.select(pii.masked(found["text"], found["pii"])).first()[0] == "host <IP> up"


# --- main text ---------------------------------------------------------------------

#: class words of article parts that only begin like a form, footer, sidebar, ...
PARTS = ["formula", "formatted", "footnotes", "side-by-side", "commentary", "entry-header",
         "navy-text", "noticeable", "widgetized-not", "searching-for-truth",
         "section-header", "content-sidebar-wrap", "has-sidebar"]
#: class words of elements that are no part of the article
ELSEWHERE = ["form", "footer", "sidebar", "nav", "comments", "comment-list", "site-footer",
             "cookie-notice", "left sidebar", "ad-1", "share-buttons", "related-posts",
             "comment-content", "page-footer", "comment_meta"]
LONG = "A sentence of the article that is long enough to count as text, with some words more. " * 3


@cache
def models():
    given = Counter()
    for source in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        given.update(html_content.counts(html_content.parse(source or "")))
    many = Counter({k: 40 * n for k, n in given.items()})
    return [html_content.ContentModel(c) for c in ({}, given, many)]


@pytest.mark.parametrize("words", PARTS)
def test_class_words_inside_an_article(words):
    page = f"<nav>Menu</nav><article><p>{LONG}</p><div class='{words}'><p>{LONG}part</p></div></article>"
    for model in models():
        assert model.extract(page).endswith("part")
    assert all("Menu" not in m.extract(page) for m in models()[1:])


@pytest.mark.parametrize("words", ELSEWHERE)
def test_class_words_of_other_things(words):
    page = f"<article><p>{LONG}</p><div class='{words}'><p>Other things</p></div></article>"
    for model in models():
        assert model.extract(page) == LONG.strip()


@pytest.mark.parametrize("words", ["post-17 post type-post format-standard", "widget", "banner side", "form"])
@pytest.mark.parametrize("mark", ["article class='{}'", "main class='{}'", "div itemprop=articleBody class='{}'"])
def test_names_do_not_overrule_the_marked_article(words, mark):
    mark = mark.format(words)
    page = f"<nav>Menu</nav><{mark}><h1>Title</h1><p>{LONG}</p></{mark.split()[0]}><footer>End</footer>"
    labels = html_content.own_labels(html_content.parse(page))
    assert labels == [0, 0, 1, 1, 1, 0]
    if not mark.startswith("div"):          # a plain div is the page's mark for training only
        for model in models()[1:]:
            assert model.extract(page) == "Title\n" + LONG.strip()


def test_comments_marked_as_articles_stay_out():
    page = (f"<main><article class='post'><p>{LONG}</p><article class='comment'><p>Nice one</p></article>"
            "</article><ol class=comment-list><li><article class='comment-body'><p>Nice two</p></article></ol></main>")
    assert html_content.own_labels(html_content.parse(page)) == [0, 1, 1, 1, 0, 0, 0, 0, 0, 0]
    assert models()[2].extract(page) == LONG.strip()


# --- benchmark decontamination -------------------------------------------------------

def leaks_found(spark, rows, items):
    docs = spark.createDataFrame(rows, TEXTS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find(docs, bench).collect()
    gone = {r["doc_id"] for r in rows_left(docs, bench)} ^ {i for i, _ in rows}
    assert gone == {r["doc_id"] for r in found}
    return sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in found), key=str)


def rows_left(docs, bench):
    return decontaminate.clean(docs, bench).collect()


def test_edits_on_piece_borders(spark):
    rng = random.Random(11)
    words = ["aaaa", "bbbb", "cccc", "dddd", "eeee", "fün", "gnu"]
    items = [(0, "aaaa bbbb cccc dddd eeee")] + [
        (k, " ".join(rng.choice(words) for _ in range(rng.randint(5, 30)))) for k in range(1, 9)]
    rows = [(0, "aaaa bbbbcccc dddd eeee"), (1, "x aaaa bbbb cccc dddd eeeeee y"), (2, "aaaa bbbbcccc dddeeee")]
    for _k, text in items:
        for _ in range(12):         # words joined, split and lengthened
            t = list(text)
            for _ in range(rng.randint(1, 4)):
                at = rng.choice([i for i, c in enumerate(t) if c == " "] or [0])
                t[at:at + 1] = rng.choice([[], [], ["z", " "], ["-"], [" ", "z"]])
            rows.append((len(rows), "some noise " + "".join(t) + rng.choice(["", "s", " end"])))
    assert leaks_found(spark, rows, items) == brute.leaks(rows, items)


def test_long_texts_over_chunks(monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK", 32)
    item = "one quick brown fox jumps over the lazy dog near the old river bank"
    index = decontaminate.Items([(1, item)], 0.05)
    for shift in range(70):
        got = index.matches((("y" * shift) + " " + item + " z" * 40).encode())
        assert [(g[0], g[1]) for g in got] == [(1, 0)] and got[0][2] == shift + 1


CHINESE = "请问下列哪一个城市是中华人民共和国的首都"
THAI = "กรุงเทพมหานครเป็นเมืองหลวงของประเทศใดในทวีปเอเชีย"
JAPANESE = "日本で一番高い山の名前は何ですか。その高さも答えてください、また何県にあるかも答えなさい。" * 2
FEW = "antidisestablishmentarianism floccinaucinihilipilification"


def test_items_without_word_borders(spark):
    items = [(1, CHINESE), (2, THAI), (3, JAPANESE), (4, FEW), (5, "短い"), (6, "too short words")]
    edited = JAPANESE[:20] + "X" + JAPANESE[21:50] + JAPANESE[52:]
    rows = [(1, CHINESE), (2, f"前面的文字{CHINESE}？后面的文字"), (3, f"x {THAI}y"), (4, f"あれは{edited}です"),
            (5, f"the {FEW.upper()}, twice"), (6, "短い too short words"), (7, CHINESE[:-6])]
    # within the budget of one edit
    rows += [(8, "某" + CHINESE[:9] + "在" + CHINESE[10:]), (9, "某" + CHINESE[:4] + "在在" + CHINESE[6:])]
    assert leaks_found(spark, rows, items) == [
        (1, 1, 0), (2, 1, 0), (3, 2, 0), (4, 3, 3), (5, 4, 0), (8, 1, 1)]


def test_spans_inside_unspaced_words():
    index = decontaminate.Items([(1, CHINESE)], 0.05)
    text = f"Q: 前面的文字{CHINESE}后面"
    (_item, distance, start, end), = index.matches(text.encode())
    assert distance == 0 and text[start:end] == CHINESE


def test_punctuated_unspaced_item_has_its_whole_budget(spark):
    item = " ".join([CHINESE * 2] * 5)
    text = "".join("某" if i % 22 == 3 else c for i, c in enumerate(item))
    edits = sum(a != b for a, b in zip(item, text))
    assert 4 < edits <= int(0.05 * len(item))
    assert leaks_found(spark, [(1, text)], [(1, item)]) == [(1, 1, edits)]


# --- language ID ------------------------------------------------------------------------

def scripts():
    """A large script in most texts, and small languages that share code blocks:
    two apart by their letters, two by their letters' order alone."""
    rng = random.Random(5)
    han = [chr(0x4E00 + i) for i in range(400)]
    letters = [chr(0x10D0 + i) for i in range(32)]
    words = {"ka": ["".join(rng.choice(letters[:14]) for _ in range(5)) for _ in range(30)],
             "xm": ["".join(rng.choice(letters[14:28]) for _ in range(5)) for _ in range(30)],
             "hy": ["".join(chr(0x0561 + rng.randrange(30)) for _ in range(5)) for _ in range(30)]}
    words["yh"] = [w[::-1] for w in words["hy"]]

    def text(lang):
        if lang == "zh":
            return "".join(rng.choice(han) for _ in range(3000))
        return " ".join(rng.choice(words[lang]) for _ in range(40))
    rows = [(i, text(lang), lang) for i, lang in enumerate(["zh"] * 60 + list(words) * 15)]
    return rows, [(i, text(lang), lang) for i, lang in enumerate(["zh", *words] * 8)]


def test_small_languages_beside_a_large_script(spark):
    rows, held = scripts()
    schema = "doc_id long, text string, lang string"
    model = langid.train(spark.createDataFrame(rows, schema))
    got = langid.identify(spark.createDataFrame(held, schema), model).collect()
    assert [r["lang_pred"] for r in got if r["lang_pred"] != r["lang"]] == []
    assert not any(r["rejected"] for r in got)


def test_model_keeps_every_letter(spark):
    rows, _held = scripts()
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for lang, own in zip(model.langs, model.models):
        used = {ord(c) for _i, t, x in rows if x == lang for c in t if c != " "} | {0}
        assert set(own.one.keys.tolist()) == used
    assert len({m.size for m in model.models}) == 1


def test_many_symbols_in_a_piece_score_as_few_do(monkeypatch):
    points = np.array([[0, 0, 97, 0x4E00], [0, 97, 0x4E00, 0x10FFFF], [97, 0x4E00, 0x10FFFF, 0]])
    some = langid.Packer().distinct(points)
    monkeypatch.setattr(langid, "DENSE", 1)
    many = langid.Packer().distinct(points)
    want = (points[0].astype(object) << 42) | (points[1].astype(object) << 21) | points[2].astype(object)
    assert some[0][some[1]].tolist() == many[0][many[1]].tolist() == want.tolist()


def test_held_out_scores_are_those_of_a_model_without_the_row(spark):
    texts = ["ab ab ba cab", "abba cab dab", "bad ab", "xyz ab ab ba"]

    def counted(some):
        grams = np.concatenate([langid.Packer().distinct(g)[0][langid.Packer().distinct(g)[1]]
                                for t in some for s in [langid.symbols(t)]
                                for g in [np.stack([s[:-2], s[1:-1], s[2:]])]])
        return np.unique(grams, return_counts=True)
    whole = langid.KneserNey(*counted(texts), bits=21)
    for k, text in enumerate(texts):
        rest = langid.KneserNey(*counted(texts[:k] + texts[k + 1:]), bits=21)
        rest.three.d, rest.two.d = whole.three.d, whole.two.d
        grams, own = counted([text])
        assert np.allclose(whole.log_prob(grams, own), rest.log_prob(grams))


def test_language_bounds_come_from_every_training_row(spark):
    rng = random.Random(8)
    words = {"a": ["abba", "bab", "cab", "dab", "bade"], "b": ["xyz", "zyx", "wyx", "zzw", "wab"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.randint(1, 6))), x)
            for i in range(4600) for x in ["ab"[i % 2]]]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    batch = pa.RecordBatch.from_arrays([pa.array([t for _i, t, _x in rows])], ["t"])
    true = np.array([model.langs.index(x) for _i, _t, x in rows])
    own, n = model.held_out(batch, 0, true), model.entropies(batch, 0)[1]
    for j, name in enumerate(model.langs):
        mine, size = own[true == j], n[true == j]
        gap = np.abs(mine - np.median(mine))
        want = (np.median(mine), np.median(gap[size >= np.median(size)]) * 1.5 + 1e-3,
                np.median(gap * np.sqrt(size)) * 1.5 + 1e-3)
        assert np.allclose(model.bounds[name], want, rtol=1e-9)


def test_held_out_rows_of_a_batch_are_left_out_one_by_one(spark, monkeypatch):
    rows = [(i, t, x) for i, (t, x) in enumerate([
        ("ab ab ba cab", "a"), (None, "a"), ("xyz zzy", "b"), ("abba cab dab", "a"), ("...", "b"), ("zyx xy", "b")] * 3)]
    model = langid.train(spark.createDataFrame([r for r in rows if r[1]], "doc_id long, text string, lang string"))
    true = np.array([model.langs.index(x) for _i, _t, x in rows])
    batch = pa.RecordBatch.from_arrays([pa.array([t for _i, t, _x in rows], pa.string())], ["t"])
    whole = model.held_out(batch, 0, true)
    alone = [model.held_out(batch.slice(i, 1), 0, true[i:i + 1])[0] for i in range(len(rows))]
    assert np.allclose(whole, alone)
    monkeypatch.setattr(langid, "PIECE", 5)
    assert len(model.held_out(batch, 0, true)) == len(rows)
