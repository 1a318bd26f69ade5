"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of ``e`` edits is cut into ``e + 1`` pieces of
characters, wherever its words end: whoever holds the item with at most ``e``
edits holds one piece exactly.  Rolling character hashes of every text find the
seeds that pieces begin with, a comparison the exact piece hits; a hit fixes the
diagonal on which the whole item must lie, and Myers' bit-parallel edit distance
decides there.

Texts and items are compared after lower-casing A-Z and turning ASCII
punctuation and white space into single spaces; every word carries its leading
space, so items begin at word borders, but for those whose script has none
(``UNSPACED``): these stand anywhere.  ``e`` is ``budget`` of the item's length.

Items too short for an edit are searched exactly, and end where a word ends.

The items are a stated query set: they go through the corpus in blocks of
``BLOCK`` items and ``BLOCK_BYTES``, so what is broadcast at once is bounded.

Defined results: null and empty texts match nothing; null or empty items, and
those of punctuation alone, are no evidence and match nothing; every other item is
searched; a match's span ends at word borders, inside
unspaced words where the match does; repeated rows of either side give repeated results; ties go to the leftmost
end; empty tables give no rows; ``clean`` keeps all input columns, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (IntegerType, LongType, StructField, StructType)

from skein.llm.memory import trimmed

#: items broadcast at once
BLOCK = 20_000
#: bytes of text of the items broadcast at once
BLOCK_BYTES = 16 << 20
BUDGET = 0.05

_WORD = r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
#: letters of scripts without spaces between words: Thai, Lao, Tibetan, Burmese,
#: Khmer, kana, Han, Yi
UNSPACED = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fff\u3005-\u3007"
                      "\u3040-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua4cf"
                      "\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122
               else 32 for b in range(256))
#: longest seeds, and characters hashed at once
SEEDS, CHUNK = (16, 12, 8), 1 << 18
_BITS = 22
_BASE = 0x9E3779B97F4A7C15
_MIX, _SHIFT = np.uint64(0xD6E8FEB86659FD93), np.uint64(64 - _BITS)


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


def _powers(base: int) -> np.ndarray:
    out = np.full(CHUNK + SEEDS[0], base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _prefixed(points: np.ndarray) -> np.ndarray:
    """Prefix sums of a chunk, of which ``_rolled`` takes differences."""
    out = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points + np.uint64(1)) * _UP[:len(points)], out=out[1:])
    return out


def _rolled(sums: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` characters."""
    n = len(sums) - size
    if n <= 0:
        return np.empty(0, np.uint64)
    return (sums[size:] - sums[:n]) * _DOWN[:n] * _MIX


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def distance(pattern: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """``(least distance, its first end)`` of ``pattern`` against substrings of
    ``text`` that end anywhere and begin anywhere (or at 0 if ``anchored``)."""
    m = len(pattern)
    every, high = (1 << m) - 1, 1 << (m - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    up, down, score, best, end = every, 0, m, m, 0
    carry = 1 if anchored else 0
    for j, c in enumerate(text, 1):
        eq = places.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (every & ~(xh | up))
        mh = up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1 | carry) & every
        mh = mh << 1 & every
        up = mh | (every & ~(xv | ph))
        down = ph & xv
        if score < best:
            best, end = score, j
    return best, end


class Items:
    """The piece index of one block of test items."""

    def __init__(self, items: list[tuple], budget: float):
        self.items = []                                # (item id, pattern, budget)
        seeds: dict[int, dict[str, list]] = {}         # size -> seed -> [(item, place, piece)]
        for item_id, text in items:
            words = words_of((text or "").encode())
            pattern = b" ".join(words).decode()
            if not words:
                continue
            if not UNSPACED.match(pattern):
                pattern = " " + pattern
            e = min(int(budget * len(pattern)), len(pattern) - 1)
            number = len(self.items)
            self.items.append((item_id, pattern, e))
            cuts = [k * len(pattern) // (e + 1) for k in range(e + 2)]
            least = len(pattern) // (e + 1)
            size = next((n for n in SEEDS if n <= least), least)
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(size, {}).setdefault(pattern[a:a + size], []).append(
                    (number, a, pattern[a:b]))
        self.seeds = []         # size, sorted hashes, table of their first bits, seed -> pieces
        for size, found in seeds.items():
            keys = np.unique(np.concatenate([_rolled(_prefixed(_points(s)), size) for s in found]))
            table = np.zeros(1 << _BITS, bool)
            table[keys >> _SHIFT] = True
            self.seeds.append((size, keys, table, found))

    def hits(self, norm: str) -> dict[int, set[int]]:
        """Exact piece hits: item -> the diagonals that they fix."""
        out: dict[int, set[int]] = {}
        points = _points(norm)
        longest = max((size for size, *_ in self.seeds), default=1)
        for low in range(0, len(points), CHUNK):
            sums = _prefixed(points[low:low + CHUNK + longest - 1])
            for size, keys, table, found in self.seeds:
                rolled = _rolled(sums, size)[:CHUNK]
                at = np.flatnonzero(table[rolled >> _SHIFT])
                if len(at):
                    place = np.minimum(np.searchsorted(keys, rolled[at]), len(keys) - 1)
                    at = at[keys[place] == rolled[at]]
                for i in (at + low).tolist():
                    for number, begin, piece in found.get(norm[i:i + size], ()):
                        if norm.startswith(piece, i):
                            out.setdefault(number, set()).add(i - begin)
        return out

    @staticmethod
    def _ends(norm: str, at: int) -> bool:
        """Whether a word ends at ``at``, or one without borders stands there."""
        return at >= len(norm) or norm[at] == " " or bool(UNSPACED.match(norm, at - 1))

    def matches(self, raw: bytes | None) -> list[tuple]:
        """``(item id, distance, start, end)`` of each item that the text holds
        within its budget: the nearest occurrence, in code points of the text."""
        words = words_of(raw or b"")
        norm, found, spans = (" " + b" ".join(words).decode() if words else ""), [], None
        for number, fixed in self.hits(norm).items():
            item_id, pattern, e = self.items[number]
            best = None
            diagonals = sorted(fixed)
            while diagonals:
                run = 1             # neighbouring diagonals share one window
                while run < len(diagonals) and diagonals[run] - diagonals[run - 1] <= e:
                    run += 1
                low = max(0, diagonals[0] - e)
                window = norm[low:diagonals[run - 1] + len(pattern) + e]
                del diagonals[:run]
                exact = window.find(pattern)
                d, end = (0, exact + len(pattern)) if exact >= 0 else distance(pattern, window)
                if not e and not self._ends(norm, low + end):
                    continue            # no word's beginning counts as a short item
                if d <= e and (best is None or d < best[0]):
                    best = (d, low, window[:end])
            if best is None:
                continue
            d, low, upto = best
            back = len(pattern) if d == 0 else distance(pattern[::-1], upto[::-1], anchored=True)[1]
            stop, start = low + len(upto), low + len(upto) - back
            if spans is None:
                starts = np.cumsum([0] + [len(w.decode()) + 1 for w in words])
                spans = [m.span() for m in re.finditer(_WORD, raw.decode())]
            first = min(int(np.searchsorted(starts, start, "right")) - 1, len(spans) - 1)
            last = min(int(np.searchsorted(starts, max(start, stop - 1), "right")) - 1, len(spans) - 1)
            begin, finish = spans[first][0], spans[last][1]
            if UNSPACED.match(norm, start):
                begin += start - int(starts[first]) - 1
            if stop > start and UNSPACED.match(norm, stop - 1):
                finish = spans[last][0] + stop - 1 - int(starts[last])
            found.append((item_id, d, begin, finish))
        return sorted(found, key=lambda x: (x[2], x[3], str(x[0])))


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, budget: float, block: int):
    """Broadcast piece indexes of the items, ``block`` items at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t"))
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    parts = max(1, -(-n // (block // 2 or 1)), -(-size // (BLOCK_BYTES // 2)))
    for k in range(parts):
        # deal the query set by text hash: about block / 2 items in each part
        rows = items if parts == 1 else items.where(F.pmod(F.xxhash64("t", "i"), F.lit(parts)) == k)
        yield spark.sparkContext.broadcast(Items([(r["i"], r["t"]) for r in rows.collect()], budget))


def _raw(column: pa.Array) -> list:
    return column.cast(pa.binary() if not pa.types.is_large_string(column.type)
                       else pa.large_binary()).to_pylist()


def find(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, id_col: str = "doc_id",
         text: str = "text", item_id: str = "item_id", item_text: str = "text",
         block: int = BLOCK) -> DataFrame:
    """Leaks: ``id_col, item_id, distance, start, end``, one row for each input
    row and item that it holds within the budget."""
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType),
                         StructField(item_id, benchmark.schema[item_id].dataType),
                         StructField("distance", IntegerType()),
                         StructField("start", LongType()), StructField("end", LongType())])
    rows = docs.select(F.col(id_col), F.col(text).cast("string").alias("_t"))
    out = None
    for items in _blocks(benchmark, item_id, item_text, budget, block):
        def search(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = items.value
            for batch in batches:
                ids, found = batch.column(0), []
                for r, raw in enumerate(_raw(batch.column(1))):
                    found += [(r, *m) for m in index.matches(raw)]
                cols = list(zip(*found)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], target),
                     pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()),
                     pa.array(cols[4], pa.int64())],
                    [id_col, item_id, "distance", "start", "end"])
        from pyspark.sql.pandas.types import to_arrow_type
        target = to_arrow_type(schema[item_id].dataType)
        part = rows.mapInArrow(trimmed(search), schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, text: str = "text",
          item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` without the rows that hold a test item within its budget."""
    names, at = docs.columns, docs.columns.index(text)
    for items in _blocks(benchmark, item_id, item_text, budget, block):
        def keep(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            index = items.value
            for batch in batches:
                mask = [not index.matches(raw) for raw in _raw(batch.column(at))]
                yield batch.filter(pa.array(mask, pa.bool_()))
        docs = docs.mapInArrow(trimmed(keep), docs.schema)
    return docs.select(*names)
