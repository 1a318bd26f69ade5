"""The Java-regex forms of the text rules against Python's own regex and
string semantics (Unicode \\w, \\s, \\b, str.split/strip) on the real test
texts: documents (fr/de/es/en) and conversation messages."""

import re

from pyspark.sql import functions as F

from skein.functions import text as TX

SF = "/root/testdata/sf0.01"


def _py_clean(text):
    # the cleaning rules as stated: whitespace runs -> ' ', then drop all but
    # word characters, whitespace and . , ! ? ; : - ' " ( ) [ ] { }, strip
    if not text:
        return ""
    t = re.sub(r"\s+", " ", text)
    t = re.sub(r"\n\s*\n", "\n\n", t)
    t = re.sub(r"[^\w\s\.,!?;:\-'\"()\[\]{}]", "", t)
    return t.strip()


def _py_rewrite(text, rules):
    t = text.lower()
    for pat, rep in rules:
        t = re.sub(pat, rep, t)
    return t


def test_text_clean_matches_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text", TX.text_clean("text").alias("c")).collect()
    bad = [r.doc_id for r in rows if r.c != _py_clean(r.text)]
    assert not bad, bad[:10]


def test_rewrites_and_tokens_match_python(spark):
    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = conv.select("text", TX.synonyms_relevancy("text").alias("r"),
                       TX.synonyms_faithfulness("text").alias("f"),
                       TX.tokens("text").alias("tok")).collect()
    assert len(rows) > 500
    for r in rows:
        assert r.r == _py_rewrite(r.text, TX.RELEVANCY_REWRITES)
        assert r.f == _py_rewrite(r.text, TX.FAITHFULNESS_REWRITES)
        assert sorted(r.tok) == sorted(set(r.text.lower().split()))


def _py_chunks(text, size=1000, overlap=200):
    if not text:
        return []
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while start < len(text):
        end = start + size
        out.append(text[start:end])
        start = end - overlap if overlap > 0 else end
        if overlap >= size and len(out) > 1:
            break
    return out


def test_chunks_match_slicing_loop(spark):
    from skein.operators.chunk import chunk_fixed
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {}
    for r in chunk_fixed(docs).collect():
        got.setdefault(r.doc_id, {})[r.chunk_index] = r.chunk
    for r in docs.collect():
        want = _py_chunks(r.text)
        have = got.get(r.doc_id, {})
        assert [have[i] for i in sorted(have)] == want, r.doc_id


def test_vectorised_embedder_matches_plain_python(spark):
    import hashlib

    import numpy as np

    from skein.operators.embed import hashed_embedder

    def plain(text, dim=128):
        v = np.zeros(dim)
        for w in text.split():
            pw = f" {w} "
            for i in range(len(pw) - 2):
                v[int(hashlib.md5(pw[i:i + 3].encode()).hexdigest()[:4], 16) % dim] += 1
        n = np.sqrt((v * v).sum())
        return (v / n if n else v).astype(np.float32)

    texts = [r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").limit(200).collect()]
    texts += ["", "   ", "a", "ÉÀ 中文 😀 x"]
    got = hashed_embedder(128)(texts)
    for t, g in zip(texts, got):
        assert np.array_equal(g, plain(t)), t[:40]


def _py_tfidf_cos(a, b):
    import math
    from collections import Counter

    def grams(t):
        c = Counter()
        for w in t.split():
            pw = f" {w} "
            for n in (2, 3, 4):
                if n > len(pw):
                    break
                for i in range(len(pw) - n + 1):
                    c[pw[i:i + n]] += 1
                if n == len(pw):
                    break
        return c
    ga, gb = grams(a.lower()), grams(b.lower())
    vocab = set(ga) | set(gb)
    if not vocab:
        return 0.0
    def vec(g):
        v = {}
        for t in vocab:
            if g.get(t):
                df = (t in ga) + (t in gb)
                v[t] = (1 + math.log(g[t])) * (math.log(3 / (1 + df)) + 1)
        return v
    va, vb = vec(ga), vec(gb)
    na = math.sqrt(sum(x * x for x in va.values()))
    nb = math.sqrt(sum(x * x for x in vb.values()))
    if not na or not nb:
        return 0.0
    return sum(va[t] * vb.get(t, 0.0) for t in va) / (na * nb)


def test_pair_similarity_matches_definition(spark):
    import pytest

    from skein.operators.evaluate import pair_similarity
    from skein.plans.evaluation import qa_pairs
    pairs = qa_pairs(spark.read.parquet(f"{SF}/conversations.parquet"))
    p = pairs.select("conv_id", "turn", F.lower("question").alias("a"), F.lower("answer").alias("b"))
    got = {(r.conv_id, r.turn): r for r in pair_similarity(p, ["conv_id", "turn"], "a", "b").collect()}
    for r in p.collect():
        s = got[(r.conv_id, r.turn)]
        assert s.cosine == pytest.approx(_py_tfidf_cos(r.a, r.b), abs=1e-12)
        ta, tb = set(r.a.split()), set(r.b.split())
        assert s.jaccard == pytest.approx(len(ta & tb) / len(ta | tb), abs=1e-12)
