"""Spelling variants, whitening and source mixing against plain Python forms."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import mixing, queries, variants, whitening

SMALL = "/root/testdata/sf0.001"
TEXTS = "doc_id long, text string"


# --- spelling variants -----------------------------------------------------------

def brute_variants(rows, least=7, seen=2, ratio=10):
    n = Counter()
    for doc, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                n[run] += 1
    words = {w: c for w, c in n.items() if c >= seen}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    found = {w: sorted((v for v in words if near(w, v)), key=lambda v: (-words[v], v)) for w in words}
    form = {w: vs[0] if vs and words[vs[0]] >= ratio * words[w] else None for w, vs in found.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w] or "", root(w), words[w], len(found[w]), words[form[w]] if form[w] else 0)
                  for w in words)


def variant_rows(seed):
    rng = random.Random(seed)
    letters = "abcé"
    bases = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 12))) for _ in range(12)]
    bases += ["aaaaaaaa", "aaaaaaaaa", "aaaaaaaaaa", "ababababa", "mississippi", "À" * 8]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 25)):
            w = list(bases[min(int(rng.expovariate(0.4)), len(bases) - 1)])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w[at:at + 1] = rng.choice([[], [rng.choice(letters)], [w[at], rng.choice(letters)], [w[at]] * 2])
            words.append("".join(w).upper() if rng.random() < 0.1 else "".join(w))
        rows.append((i, rng.choice([" ", "-", "\n", "9"]).join(words)))
    long = "".join(rng.choice("xyz") for _ in range(3000))
    rows += [(900, f"{long} {long} {long[:-1]} {long[:-1]}"), (901, long[:1500] + "q" + long[1501:]),
             (902, long[:1500] + "q" + long[1501:])]
    return rows + brute.rows()


@pytest.mark.parametrize("seed,part", [(1, 200_000), (2, 20), (3, 1)])
def test_variants(spark, seed, part):
    rows = variant_rows(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], TEXTS + ", word string, n int").repartition(5)
    out = variants.variants(docs, part=part).collect()
    got = sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in out)
    assert got == brute_variants(rows)
    assert any(r["form"] for r in out)


def test_variant_chain_and_ties(spark):
    # abcdefgh <- abcdefg? <- ...: forms followed to the last, ties by code point
    counts = {"abcdefgz": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefgy": 20, "abcdefghij": 2000}
    rows = [(None, None), (1, "")]
    for w, n in counts.items():
        ids = [i for i in range(20_000) if zlib.crc32(f"{i}:{w}".encode()) % 31][:n]
        rows += [(i, w) for i in ids]
    docs = spark.createDataFrame(rows, TEXTS).repartition(3)
    out = {r["word"]: r for r in variants.variants(docs).collect()}
    assert out["abcdefgz"]["form"] == "abcdefgh" and out["abcdefgz"]["n_near"] == 2
    assert {r["root"] for r in out.values()} == {"abcdefghij", "abcdefgy"}
    assert out["abcdefgy"]["root"] == "abcdefgy" and out["abcdefgy"]["form_n"] is None
    assert variants.variants(spark.createDataFrame([], TEXTS)).count() == 0


def test_trie_numbers_are_nodes(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(400)})
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(4)
    for backwards, part in itertools.product((False, True), (7, 1000)):
        paths = {r["word"]: r["path"] for r in variants.trie_paths(df, backwards, part).collect()}
        assert len(paths) == len(words)
        nodes = defaultdict(set)
        for w, path in paths.items():
            w = w[::-1] if backwards else w
            assert len(path) == len(w)
            for k, node in enumerate(path):
                nodes[w[:k + 1]].add(node)
        numbers = [n for found in nodes.values() for n in found]
        assert all(len(found) == 1 for found in nodes.values()) and len(set(numbers)) == len(nodes)
        if not backwards:
            assert [paths[w][-1] for w in words] == sorted(paths[w][-1] for w in words)


# --- whitening ---------------------------------------------------------------------

def test_scatter_is_exact():
    rng = np.random.default_rng(5)
    for bits, rows, dims in [(1, 3, 2), (11, 130, 5), (20, 64, 3), (40, 70, 3), (62, 65, 2)]:
        u = rng.integers(0, 1 << bits, (rows, dims), dtype=np.int64)
        want = u.astype(object).T @ u.astype(object)
        got = whitening.scatter(u, bits)
        assert all(int(got[i, j]) == want[i, j] for i in range(dims) for j in range(i, dims))


def whiten_rows(seed, dims=6, n=300):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) @ rng.normal(size=(dims, dims))
    rows = [(k, [float(np.float32(v)) for v in r]) for k, r in enumerate(x)]
    rows += [rows[3], (None, rows[4][1])] + [(9_000, rows[5][1])] * 40
    bad = [(1000, None), (1001, []), (1002, [None] * dims), (1003, [float("nan")] * dims),
           (1004, [1.0] * (dims - 1) + [float("-inf")])]
    return rows, bad


def test_whitening(spark):
    rows, bad = whiten_rows(6)
    df = spark.createDataFrame([(i, v, "a") for i, v in rows + bad],
                               "vec_id long, embedding array<float>, component string").repartition(4)
    out = whitening.whiten(df, top=4).collect()
    x = np.floor(np.array([v for _, v in rows]) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    assert len(out) == 4 * n and {r["n"] for r in out} == {n}
    centred = x - sums / n
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    devs = Counter((i, int(((n * v - sums).astype(object) ** 2).sum())) for (i, _), v in zip(rows, x))
    assert Counter((r["vec_id"], int(r["deviation"])) for r in out) == Counter({k: 4 * c for k, c in devs.items()})
    for k in range(1, 5):
        e, axis = values[-k], vectors[:, -k]
        want = Counter((i, round(abs(float(w)), 6)) for (i, _), w in zip(rows, centred @ axis / np.sqrt(e)))
        got = Counter((r["vec_id"], round(abs(r["whitened"]), 6)) for r in out if r["component"] == k)
        assert sum((want - got).values()) <= 2      # a rounding border at most
        assert all(abs(r["explained"] - e / values.sum()) < 1e-9 for r in out if r["component"] == k)
    errors = {r["identity_error"] for r in out}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_whitening_degenerate(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], kind)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], kind)).count() == 0
    # one dimension constant, one a copy of another: one component is left
    rows = [(k, [float(k), 5.0, float(k)]) for k in range(5)]
    out = whitening.whiten(spark.createDataFrame(rows, kind)).collect()
    assert {r["component"] for r in out} == {1} and abs(out[0]["explained"] - 1) < 1e-12
    # a wide range: exact all the same
    rows = [(k, [k * 1e9, -k * 3e12]) for k in range(4)] + [(9, [7.5, 1e13])]
    out = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(spark.createDataFrame(rows, kind)).collect()}
    x = [[int(np.floor(c * 1024)) + 100_000 for c in v] for _, v in rows]
    for (i, _), v in zip(rows, x):
        assert out[i] == sum((5 * c - sum(r[k] for r in x)) ** 2 for k, c in enumerate(v))
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], kind))


def test_whitening_query(spark):
    out = queries.op12_embedding_whitening(spark, SMALL)
    assert dict(out.dtypes)["deviation"] == "bigint" and dict(out.dtypes)["component"] == "int"
    got = out.agg(F.count("*"), F.max("identity_error"), F.max("component")).first()
    assert got[0] == 500 * 8 and got[1] < 1e-4 and got[2] == 8


# --- source mixing -------------------------------------------------------------------

def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, free, out = Fraction(3, 2) * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total >= 2 * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = Fraction(2 * sizes[s])
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def mix_rows(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["b", "b", "b", "a", "é", "Z", None, "c0", "c1"])
        rows.append((i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 3, 7, 20, 90, 90]))), source))
    rows += [(5000, "same row five words here", "b")] * 60 + [(None, "no id", "a"), (5001, None, "empty"),
                                                             (5002, "", "empty"), (5003, "\t \n", None)]
    return rows


@pytest.mark.parametrize("seed,width,buckets", [(1, mixing.WIDTH, 4096), (2, 64, 4), (3, 200, 1)])
def test_mix(spark, seed, width, buckets):
    rows = mix_rows(seed)
    kind = TEXTS + ", source string"

    def run(parts):
        df = spark.createDataFrame(rows, kind).withColumn("size", F.lit("x")).repartition(parts)
        return sorted(map(tuple, mixing.mix(df, width=width, buckets=buckets).collect()), key=str)
    out = run(4)
    assert out == run(7)
    count = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sizes = defaultdict(int)
    for (_, _, s), c in zip(rows, count):
        sizes[s] += c
    wanted = brute_targets(sizes)
    assert Counter((r[0], r[1]) for r in out) == Counter((i, c) for (i, _, _), c in zip(rows, count))
    assert abs(sum(wanted.values()) - Fraction(3, 2) * sum(sizes.values())) == 0
    taken, by_target = defaultdict(int), {round(float(t), 9): s for s, t in wanted.items()}
    for _, size, source_size, target, got in out:
        source = by_target[round(target, 9)]
        assert source_size == sizes[source]
        assert got <= 2 * size and (size == 0 or got % size == 0)
        taken[source] += got
    for s, t in wanted.items():
        assert abs(taken[s] - t) <= 1, (s, taken[s], float(t))


def test_subset_sum_is_nearest():
    rng = random.Random(7)
    for _ in range(150):
        lengths = rng.sample(range(1, 40), rng.randint(1, 4))
        counts = [rng.randint(1, 4) for _ in lengths]
        wanted = rng.randint(0, 90)
        sums = {sum(k * s for k, s in zip(ks, lengths))
                for ks in itertools.product(*[range(c + 1) for c in counts])}
        got = mixing.subset_sum(lengths, counts, wanted)
        assert all(0 <= k <= c for k, c in zip(got, counts))
        assert abs(sum(k * s for k, s in zip(got, lengths)) - wanted) == min(abs(s - wanted) for s in sums)


def test_budget_of_large_source():
    rng = np.random.default_rng(8)
    lengths = np.sort(rng.choice(np.arange(1, 30_000), 3000, replace=False))
    counts = rng.integers(1, 2000, 3000)
    total = int((lengths * counts).sum())
    for wanted in (1, total // 3, total - 1):
        got = mixing.fitted(lengths, counts, wanted, 5)
        assert (got >= 0).all() and (got <= counts).all() and abs(int((got * lengths).sum()) - wanted) <= 1


def test_mix_empty(spark):
    assert mixing.mix(spark.createDataFrame([], TEXTS + ", source string")).count() == 0
    only = mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "a")], TEXTS + ", source string")).collect()
    assert {(r["size"], r["target"], r["taken"]) for r in only} == {(0, 0.0, 0)}
