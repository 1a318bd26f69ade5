"""Spelling variants: words one edit apart, found by a trie-node pair dictionary.

1. Words are counted over all texts (bounded counters a task, one shuffle of
   words and counts).
2. The words are sorted twice, as they are and reversed, in parts of bounded
   size; walking a sorted part numbers the nodes of the trie.  A node's number is
   the place of its last letter in the sorted run of all words, so numbers need
   no dictionary: parts learn their first number, and the path that they share
   with the part before, from one row a part.
3. A word of L letters has L + 1 integer pairs *(prefix node, suffix node)* that
   meet between two letters, and L that skip one letter.  Words of one skipping
   pair differ by a replaced letter; a skipping pair equal to another word's
   meeting pair is a deleted letter (or inserted, seen from the shorter word).
   Equal pairs are equal prefixes and suffixes, so neighbours are exact, and a
   pair holds at most one word a letter and one shorter word: no group grows with
   the corpus.  A letter of a run of equal letters is skipped at its first place
   only, so that two words meet once.
4. Pairs are brought together by one shuffle of integers.  For each word the
   neighbours are counted and the most frequent kept, without listing pairs.
5. Forms are followed to the last by pointer doubling; counts rise tenfold a step,
   so five rounds are enough.

Defined results: null and empty texts have no words; a null id counts as an empty
one in ``<doc_id>:<run>``; repeated rows count each; ties for the most frequent
neighbour go to the smallest word in code-point order; an empty table gives no
rows; very long runs are words like others; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skein.session import write_shared

#: letters after A-Z are lower-cased
LETTERS = "a-zÀ-ÿ"
#: shortest word, in code points
LEAST = 7
#: least occurrences of a word
SEEN = 2
#: a letter is deleted where this divides the checksum
SPOIL = 31
#: a form is at least so many times as frequent
RATIO = 10
#: distinct words counted at once in a task
_HELD = 400_000
#: words in one sorted part
_PART = 200_000


def spoiled(word: str, crc: int) -> str:
    """``word`` without the letter that its checksum names, if it names one."""
    if crc % SPOIL:
        return word
    at = crc % len(word)
    return word[:at] + word[at + 1:]


def count_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                least: int = LEAST) -> DataFrame:
    """``word, n``: words of at least ``least`` code points of all texts."""
    pattern = re.compile(f"[{LETTERS}]{{{least},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not raw:
                    continue
                begun = zlib.crc32(f"{name or ''}:".encode())
                for run, n in Counter(pattern.findall(raw.lower().decode())).items():
                    word = spoiled(run, zlib.crc32(run.encode(), begun))
                    if len(word) >= least:
                        held[word] += n
                if len(held) >= _HELD:
                    yield flush()
                    held.clear()
        yield flush()
    texts = docs.select(F.col(id_col).cast("string").alias("i"),
                        F.col(text).cast("string").cast("binary").alias("t"))
    return texts.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# --- numbering the nodes of a trie ----------------------------------------------

class _Walk:
    """The path of node numbers of one word after the other, in sorted order."""

    def __init__(self, base: int, path: list[int]):
        self.at, self.path, self.last = base, path, None

    def step(self, word: str) -> list[int]:
        if self.last is None:       # what the part before has numbered
            same = len(self.path)
        else:
            same, most = 0, min(len(self.last), len(word))
            while same < most and self.last[same] == word[same]:
                same += 1
        self.path = self.path[:same] + list(range(self.at + same + 1, self.at + len(word) + 1))
        self.at += len(word)
        self.last = word
        return self.path


def _common(a: str, b: str) -> int:
    same = 0
    for x, y in zip(a, b):
        if x != y:
            break
        same += 1
    return same


def _starts(ends: list) -> dict[int, tuple[int, list[int]]]:
    """For each part the number before its first node, and the numbers of the
    prefix that its first word shares with the part before."""
    out: dict[int, tuple[int, list[int]]] = {}
    base, last, path = 0, "", []
    for row in sorted(ends, key=lambda r: r["part"]):
        shared = path[:_common(last, row["first"])]
        out[row["part"]] = (base, shared)
        # the part's own numbers count from 0 and know nothing of the shared ones
        keep = min(len(shared), _common(row["first"], row["last"]))
        path = shared[:keep] + [base + k for k in row["path"][keep:]]
        last = row["last"]
        base += row["total"]
    return out


def trie_paths(words: DataFrame, backwards: bool = False, part: int = _PART) -> DataFrame:
    """``word, path``: the numbers of the trie nodes on each word's way down.

    ``words`` has distinct words; ``backwards`` reads them from the end.  Numbers
    rise with the words' order.  Memory: one word and its path a task.
    """
    key = F.reverse("word") if backwards else F.col("word")
    n = words.count()
    keyed = words.select(key.alias("k"))
    if n > part:
        keyed = keyed.repartitionByRange(-(-n // part), "k").withColumn("part", F.spark_partition_id())
    else:
        keyed = keyed.withColumn("part", F.lit(0))
    keyed = write_shared(keyed.select("k", "part"), "trie")
    rows = keyed.repartition("part").sortWithinPartitions("part", "k")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, walk, first = None, None, ""

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([first]), pa.array([walk.last]),
                 pa.array([walk.at], pa.int64()), pa.array([walk.path], pa.list_(pa.int64()))],
                ["part", "first", "last", "total", "path"])
        for batch in batches:
            for word, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != now:
                    if walk:
                        yield row()
                    now, walk, first = p, _Walk(0, []), word
                walk.step(word)
        if walk:
            yield row()
    starts = _starts(rows.mapInArrow(
        ends, "part int, first string, last string, total long, path array<long>").collect())

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, walk = None, None
        for batch in batches:
            words, flat, ends = batch.column(0).to_pylist(), [], [0]
            for word, p in zip(words, batch.column(1).to_pylist()):
                if p != now:
                    now, walk = p, _Walk(*starts[p])
                flat += walk.step(word)
                ends.append(len(flat))
            yield pa.RecordBatch.from_arrays(
                [pa.array([w[::-1] for w in words] if backwards else words, pa.string()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))],
                ["word", "path"])
    return rows.mapInArrow(paths, "word string, path array<long>")


# --- the pair dictionary ----------------------------------------------------------

MEET, SKIP, REPEAT = 0, 1, 2


def _pairs(rows: DataFrame) -> DataFrame:
    """``p, s, w, n``: every meeting and skipping pair; ``w`` is 4 * word + kind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words, ids, n, down, up = (batch.column(k) for k in range(5))
            letters = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
            size = np.diff(down.offsets.to_numpy())
            ends = np.cumsum(size + 1)
            first, last = ends - size - 1, ends - 1
            total = int(ends[-1])
            # places 0 to L of each word: the node before and the node after
            before, after = np.zeros(total, np.int64), np.zeros(total, np.int64)
            inner = np.ones(total, bool)
            inner[first] = False
            before[inner] = down.flatten().to_numpy()
            inner[first], inner[last] = True, False
            own = np.repeat(np.arange(len(size)), size)
            back = up.flatten().to_numpy()
            start = np.cumsum(size) - size
            turn = start[own] + size[own] - 1 - (np.arange(len(back)) - start[own])
            after[inner] = back[turn]
            begins = np.zeros(len(letters), bool)
            begins[start[size > 0]] = True
            again = np.zeros(len(letters), bool)
            again[1:] = (letters[1:] == letters[:-1]) & ~begins[1:]
            rep = np.repeat(np.arange(len(size)), size + 1)
            wid, count = ids.to_numpy(), n.to_numpy()
            skip = np.flatnonzero(inner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([before, before[skip]])),
                 pa.array(np.concatenate([after, after[skip + 1]])),
                 pa.array(np.concatenate([4 * wid[rep] + MEET, 4 * wid[own] + np.where(again, REPEAT, SKIP)])),
                 pa.array(np.concatenate([count[rep], count[own]]))], ["p", "s", "w", "n"])
    return rows.select("word", "id", "n", "down", "up").mapInArrow(run, "p long, s long, w long, n long")


def _met(pairs: DataFrame) -> DataFrame:
    """``id, near, n, other``: a row for each word and pair that it shares: how
    many neighbours, and the best of them (largest ``n``, then smallest id)."""
    def groups(p, s, w, n):
        """The shared pairs of sorted rows."""
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (s[1:] != s[:-1])
        g = np.cumsum(new) - 1
        keep = np.bincount(g)[g] > 1
        g, w, n = g[keep], w[keep], n[keep]
        if not len(g):
            return None
        order = np.lexsort((w >> 2, -n, g))
        g, w, n = g[order], w[order], n[order]
        kind, wid = w & 3, w >> 2
        none = np.int64(0)
        _, g = np.unique(g, return_inverse=True)
        many = int(g[-1]) + 1

        def firsts(mask):
            """Of each group the first and second row of ``mask``, else -1."""
            at = np.flatnonzero(mask)
            gs = g[at]
            lead = np.ones(len(at), bool)
            lead[1:] = gs[1:] != gs[:-1]
            one, two = np.full(many, -1), np.full(many, -1)
            one[gs[lead]] = at[lead]
            k = np.flatnonzero(lead)
            k = k[(k + 1 < len(at))]
            k = k[gs[k + 1] == gs[k]]
            two[gs[k]] = at[k + 1]
            return one, two
        skips = kind != MEET
        count = np.bincount(g[skips], minlength=many)
        own = np.bincount(g[kind == SKIP], minlength=many)
        top, second = firsts(skips)
        lead, _ = firsts(kind == SKIP)
        short, _ = firsts(kind == MEET)
        rows = np.arange(len(g))
        # a skipping word: the others of its group, and the shorter word
        other = np.where(top[g] == rows, second[g], top[g])
        shorter = np.where(kind == SKIP, short[g], -1)
        near = np.where(skips, count[g] - 1 + (shorter >= 0), own[g])
        best = np.where(skips, other, lead[g])
        bn, bw = np.where(best >= 0, n[best], none), wid[best]
        sn, sw = n[shorter], wid[shorter]
        swap = skips & (shorter >= 0) & ((best < 0) | (sn > bn) | ((sn == bn) & (sw < bw)))
        bn, bw = np.where(swap, sn, bn), np.where(swap, sw, bw)
        has = near > 0
        return pa.RecordBatch.from_arrays(
            [pa.array(wid[has]), pa.array(near[has].astype(np.int64)), pa.array(bn[has]), pa.array(bw[has])],
            ["id", "near", "n", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64)] * 4
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.concatenate([a, b.to_numpy()]) for a, b in zip(rest, batch.columns)]
            # the last pair may go on in the next batch
            p, s = cols[0], cols[1]
            cut = len(p) - int(np.argmax((p[::-1] != p[-1]) | (s[::-1] != s[-1]))) \
                if (p[0], s[0]) != (p[-1], s[-1]) else 0
            rest = [c[cut:] for c in cols]
            if cut and (out := groups(*[c[:cut] for c in cols])) is not None:
                yield out
        if len(rest[0]) and (out := groups(*rest)) is not None:
            yield out
    return (pairs.repartition("p", "s").sortWithinPartitions("p", "s")
            .mapInArrow(run, "id long, near long, n long, other long"))


def _roots(links: DataFrame) -> DataFrame:
    """``id, root``: where each word's forms end."""
    now = write_shared(links.select("id", F.col("other").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("id").alias("k"), F.col("root").alias("far"))
        step = write_shared(
            now.join(ahead, F.col("root") == F.col("k"), "left")
            .select("id", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        now = step.select("id", "root")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST,
             seen: int = SEEN, ratio: int = RATIO, part: int = _PART) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs``."""
    words = write_shared(count_words(docs, id_col, text, least).where(F.col("n") >= seen), "words")
    down = trie_paths(words, part=part).select(F.col("word").alias("w1"), F.col("path").alias("down"))
    up = trie_paths(words, True, part).select(F.col("word").alias("w2"), F.col("path").alias("up"))
    # the node at a word's end is its own: it was not there before
    told = write_shared(
        words.join(down, F.col("word") == F.col("w1")).join(up, F.col("word") == F.col("w2"))
        .select("word", "n", "down", "up", F.element_at("down", -1).alias("id")), "paths")
    best = F.max(F.struct("n", (-F.col("other")).alias("low")))
    near = write_shared(_met(_pairs(told)).groupBy("id").agg(F.sum("near").alias("n_near"), best.alias("best")),
                        "near")
    named = told.select("id", "word", "n")
    links = write_shared(
        named.join(near, "id").where(F.col("best.n") >= ratio * F.col("n"))
        .select("id", (-F.col("best.low")).alias("other"), F.col("best.n").alias("form_n")), "forms")
    names = named.select(F.col("id").alias("k"), F.col("word").alias("name"))
    forms = (links.join(_roots(links), "id")
             .join(names.withColumnRenamed("name", "form"), F.col("other") == F.col("k")).drop("k")
             .join(names.withColumnRenamed("name", "end"), F.col("root") == F.col("k"))
             .select("id", "form", "end", "form_n"))
    return (named.join(near.select("id", "n_near"), "id", "left").join(forms, "id", "left")
            .select("word", "form", F.coalesce("end", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
