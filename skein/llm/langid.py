"""Language identification with interpolated Kneser-Ney character models.

One trigram character model per language over lower-cased letters, every run of
other characters being one boundary symbol.  Symbols are code points, none are
merged: every letter of every script has its own trigrams.  Trigram counts cover
all training rows.  What the driver builds and broadcasts is one row for each
language and distinct trigram: some ten thousand for an alphabet, more for
syllables and Han.

A model stores each order as sorted hash arrays: packed n-gram keys, sorted,
beside their counts, and context keys beside their totals and kinds.  A text is scored on all its characters; the lowest
length-normalised cross-entropy names the language.

Calibration (scale of the score, rejection bounds) is fitted on all labelled
training rows, each without its own counts: sums for the scale, exact medians and
quantiles for the bounds, all made by Spark.  A text is rejected when it has no letter or when its cross-entropy
lies beyond ``mean + k (spread + deviation / sqrt(n))`` of the language, where
``k`` is twice what all but one in a thousand of them need, and at least 8.

Defined results: null texts and texts without a letter give ``und`` with score
0; without training rows every text gives ``und``; ties go to the language
first in order; repeated rows give equal results; all input columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from skein.llm.memory import trimmed

#: least number of symbols that a model leaves some probability for
ALPHABET = 128
#: symbols in a piece up to which its trigrams are counted in a dense array
DENSE = 96
#: scales tried for the score
SCALES = [0.1 * 1.3 ** k for k in range(25)]
#: characters worked on at once: their arrays take some 300 bytes each
PIECE = 1 << 17
_BITS = 21

_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """Code point -> lower-cased code point of a letter, 0 for others."""
    global _LETTERS
    if _LETTERS is None:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTERS = table
    return _LETTERS


def symbols(text: str) -> np.ndarray:
    """Lower-cased letters of a text, runs of other characters as one 0, with
    boundaries at both ends (two at the start: the first context)."""
    points = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    out = np.concatenate([np.zeros(2, np.uint32), points, np.zeros(1, np.uint32)])
    keep = np.ones(len(out), bool)
    keep[2:] = (out[2:] != 0) | (out[1:-1] != 0)
    out = out[keep]
    return out if len(out) > 2 else out[:0]


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Trigrams of a batch's texts, about ``PIECE`` at a time: the three symbol
    arrays' stack and the row of each trigram.  A long text spans pieces."""
    held, owner, size = [], [], 0
    for row, text in enumerate(batch.column(column).to_pylist()):
        sym = symbols(text) if text else np.zeros(0, np.uint32)
        for at in range(0, max(len(sym) - 2, 0), PIECE):
            part = sym[at:at + PIECE + 2]
            held.append(np.stack([part[:-2], part[1:-1], part[2:]]))
            owner.append(np.full(len(part) - 2, row, np.int64))
            size += len(part) - 2
            if size >= PIECE:
                yield np.concatenate(held, 1), np.concatenate(owner)
                held, owner, size = [], [], 0
    if held:
        yield np.concatenate(held, 1), np.concatenate(owner)


class Packer:
    """Numbers a piece's symbols, so that its trigrams are small keys."""

    def __init__(self):
        self.present = np.zeros(0x110000, bool)
        self.place = np.zeros(0x110000, np.int64)

    def keys(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece's code points, and each trigram in their numbers."""
        self.present[grams] = True
        points = np.flatnonzero(self.present)
        self.present[points] = False
        self.place[points] = np.arange(len(points))
        a, b, c = self.place[grams]
        return points, (a * len(points) + b) * len(points) + c

    def distinct(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed distinct trigrams, and the place of each trigram in them."""
        points, key = self.keys(grams)
        if len(points) > DENSE:
            uniq, at = np.unique(key, return_inverse=True)
            return packed(points, uniq), at
        slot = np.zeros(len(points) ** 3, np.int32)
        slot[key] = 1
        uniq = np.flatnonzero(slot)
        slot[uniq] = np.arange(len(uniq))
        return packed(points, uniq), slot[key]


def packed(points: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Trigrams as three code points in one number."""
    base = len(points)
    return (points[key // base // base] << 2 * _BITS | points[key // base % base] << _BITS
            | points[key % base])


# --- training ----------------------------------------------------------------

def trigram_counts(rows: DataFrame, lang: str, text: str) -> DataFrame:
    """``lang, gram, n`` over all rows; each task sums its own trigrams first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        packer = Packer()
        for batch in batches:
            names, codes = np.unique(np.array(batch.column(0).to_pylist(), str), return_inverse=True)
            for grams, owner in pieces(batch, 1):
                # count in the piece's own small alphabet, then name the code points
                points, key = packer.keys(grams)
                of = codes[owner]
                for code in np.flatnonzero(np.bincount(of)):
                    mine, name = key[of == code], str(names[code])
                    uniq, n = (np.unique(mine, return_counts=True) if len(points) > DENSE else
                               _dense_counts(mine, len(points) ** 3))
                    own = packed(points, uniq)
                    if name in sums:
                        own = np.concatenate([sums[name][0], own])
                        n = np.concatenate([sums[name][1], n])
                        own, back = np.unique(own, return_inverse=True)
                        n = np.bincount(back, n).astype(np.int64)
                    sums[name] = own, n
        for name, (own, n) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(own), pa.string()), pa.array(own, pa.int64()),
                 pa.array(n, pa.int64())], ["lang", "gram", "n"])
    found = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")) \
        .mapInArrow(trimmed(count), "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _dense_counts(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(keys, minlength=size)
    uniq = np.flatnonzero(counts)
    return uniq, counts[uniq]


class Counts:
    """One order of a model: sorted keys beside their counts, and sorted contexts
    beside their totals and kinds, with the order's absolute discount."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, bits: int):
        self.keys, self.n, self.bits = keys, n, bits
        ones, twos = int((n == 1).sum()), int((n == 2).sum())
        self.d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        self.contexts, at = np.unique(keys >> bits, return_inverse=True)
        self.total, self.kinds = np.bincount(at, n), np.bincount(at)

    def get(self, wanted: np.ndarray) -> list[np.ndarray]:
        """Count of each key, total and kinds of its context; 0 where absent."""
        return (_look_up(self.keys, wanted, self.n)
                + _look_up(self.contexts, wanted >> self.bits, self.total, self.kinds))


def _look_up(keys: np.ndarray, wanted: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    if not len(keys):
        return [np.zeros(len(wanted)) for _ in values]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    return [np.where(found, v[at], 0.0) for v in values]


class KneserNey:
    """Interpolated Kneser-Ney model of one language over packed trigrams of
    ``bits`` a symbol; ``size`` symbols share what the seen ones leave."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, bits: int = 7, size: int = ALPHABET):
        self.bits, self.size = bits, size
        order = np.argsort(keys)
        self.three = Counts(keys[order], n[order].astype(float), bits)
        pairs, n2 = np.unique(self.three.keys & (1 << 2 * bits) - 1, return_counts=True)
        self.two = Counts(pairs, n2.astype(float), bits)            # continuation counts
        ends, n1 = np.unique(pairs & (1 << bits) - 1, return_counts=True)
        self.one = Counts(ends, n1.astype(float), bits)

    def log_prob(self, grams: np.ndarray, own: np.ndarray | None = None,
                 row: np.ndarray | None = None) -> np.ndarray:
        """Of distinct trigrams; ``own`` of each are left out of the counts (those
        of a training text, which is then scored as if it had not been read).
        With ``row`` (from 0) they are those of several texts, each left out alone."""
        bits, last = self.bits, (1 << self.bits) - 1
        pair = grams & (1 << 2 * bits) - 1
        n3, t3, k3 = self.three.get(grams)
        n2, t2, k2 = self.two.get(pair)
        n1, t1, _k1 = self.one.get(pair & last)
        if own is not None:
            row = np.zeros(len(grams), np.int64) if row is None else row
            tag = row << 2 * bits               # texts do not share contexts
            n3 = n3 - own
            gone = n3 <= 0
            context = np.unique(tag | grams >> bits, return_inverse=True)[1]
            t3, k3 = (x - np.bincount(context, y)[context] for x, y in ((t3, own), (k3, gone)))
            pairs, first, at = np.unique(tag | pair, return_index=True, return_inverse=True)
            lost = np.bincount(at, gone)
            ended = (n2[first] <= lost) & (lost > 0)
            before, after = (np.unique(x, return_inverse=True)[1] for x in (
                pairs >> bits, pairs >> 2 * bits << bits | pairs & last))
            n2 = n2 - lost[at]
            t2, k2 = (x - np.bincount(before, y)[before][at] for x, y in ((t2, lost), (k2, ended)))
            n1, t1 = n1 - np.bincount(after, ended)[after][at], t1 - np.bincount(row[first], ended)[row]
        one = 0.9 * n1 / np.maximum(t1, 1) + 0.1 / self.size
        return np.log(_interpolated(n3, t3, k3, self.three.d,
                                    _interpolated(n2, t2, k2, self.two.d, one)))


def _interpolated(n, total, kinds, d: float, low: np.ndarray) -> np.ndarray:
    """Discounted share of its context, and what the context leaves to ``low``."""
    some = np.maximum(total, 1)
    return np.maximum(n - d, 0) / some + np.where(total > 0, d * kinds / some, 1.0) * low


@dataclass
class Model:
    """All languages' models with their calibration."""
    langs: list[str]
    models: list[KneserNey]
    scale: float = 1.0
    bounds: dict[str, tuple[float, float, float]] = field(default_factory=dict)  # mean, spread, dev
    k: float = 4.0

    def entropies(self, batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
        """Per row: cross-entropy under each language, and scored symbols."""
        n, packer = np.zeros(batch.num_rows), Packer()
        sums = np.zeros((batch.num_rows, len(self.langs)))
        for grams, owner in pieces(batch, column):
            uniq, at = packer.distinct(grams)
            n += np.bincount(owner, minlength=batch.num_rows)
            for j, model in enumerate(self.models):
                sums[:, j] -= np.bincount(owner, model.log_prob(uniq)[at], batch.num_rows)
        return sums / np.maximum(n, 1)[:, None], n

    def held_out(self, batch: pa.RecordBatch, column: int, of: np.ndarray) -> np.ndarray:
        """Per row: cross-entropy under language ``of`` without the row itself."""
        out, n, packer = np.zeros(batch.num_rows), np.zeros(batch.num_rows), Packer()
        for grams, owner in pieces(batch, column):
            points, key = packer.keys(grams)
            rows, row = np.unique(owner, return_inverse=True)
            n[rows] += np.bincount(row)
            # one number for a row and a trigram; a few rows at a time where they are large
            room = max(1, (1 << 62) // len(points) ** 3)
            for at in range(0, len(rows), room):
                mine = slice(*np.searchsorted(row, [at, at + room]))
                both, own = np.unique((row[mine] - at) * len(points) ** 3 + key[mine], return_counts=True)
                text, gram = both // len(points) ** 3, packed(points, both % len(points) ** 3)
                lang = of[rows[at + text]]
                for j in np.flatnonzero(np.bincount(lang)):
                    some = lang == j
                    logs = self.models[j].log_prob(gram[some], own[some], text[some])
                    out -= np.bincount(rows[at + text[some]], own[some] * logs, len(out))
        return out / np.maximum(n, 1)

    def judge(self, batch: pa.RecordBatch, column: int) -> tuple[list, np.ndarray, np.ndarray]:
        """Per row: language (or ``und``), score, rejected."""
        if not self.langs:
            n = batch.num_rows
            return ["und"] * n, np.zeros(n), np.ones(n, bool)
        ce, n = self.entropies(batch, column)
        best = ce.argmin(1)
        low = ce[np.arange(len(ce)), best]
        score = 1 / np.exp(-self.scale * np.sqrt(n)[:, None] * (ce - low[:, None])).sum(1)
        bound = np.array([self.limit(lang) for lang in self.langs])[best]
        rejected = (n == 0) | (low > bound[:, 0] + self.k * (
            bound[:, 1] + bound[:, 2] / np.sqrt(np.maximum(n, 1))))
        names = [self.langs[b] if c else "und" for b, c in zip(best, n)]
        return names, np.where(n > 0, score, 0.0), rejected

    def limit(self, lang: str) -> tuple[float, float, float]:
        return self.bounds.get(lang, (float("inf"), 0.0, 0.0))


def train(rows: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Model of all labelled rows (null languages and texts teach nothing)."""
    from skein.session import write_shared
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = write_shared(trigram_counts(rows, lang, text), "trigrams")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    models = []
    for name in langs:      # one row for each distinct trigram
        own = counts.where(F.col("lang") == name).select("gram", "n").toArrow()
        models.append(KneserNey(own["gram"].to_numpy(), own["n"].to_numpy(), _BITS))
    seen = np.unique(np.concatenate([m.one.keys for m in models])) if models else []
    for m in models:        # all leave the same for a letter that they never saw
        m.size = max(ALPHABET, len(seen) + 1)
    model = Model(langs, models)
    if langs:
        calibrate(model, rows, lang, text)
    return model


def calibrate(model: Model, rows: DataFrame, lang: str, text: str) -> None:
    """Fit scale and rejection bounds on all training rows, each scored under its
    language as if the model had not read it.  The driver gets sums and, for each
    language, a few quantiles."""
    from skein.operators.evaluate import exact_percentiles
    from skein.session import write_shared
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, losses = ["lang", "n", "own", "losses"], np.zeros(len(SCALES))
        for batch in batches:
            model = shared.value
            ce, n = model.entropies(batch, 1)
            true = np.searchsorted(model.langs, batch.column(0).to_pylist())
            every = np.arange(len(ce))
            ce[every, true] = model.held_out(batch, 1, true)
            margin = (np.sqrt(n)[:, None] * (ce - ce.min(1)[:, None]))[n > 0]
            for j, scale in enumerate(SCALES):
                losses[j] += (np.log(np.exp(-scale * margin).sum(1)) + scale * margin[every[:len(margin)], true[n > 0]]).sum()
            some = pa.array(n > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array(ce[every, true]),
                 pa.nulls(len(n), pa.list_(pa.float64()))], names).filter(some)
        # one row of a task: its losses
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([0.0]), pa.array([0.0]),
                                          pa.array([losses.tolist()], pa.list_(pa.float64()))], names)
    found = write_shared(rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("t"))
                         .mapInArrow(trimmed(measure), "lang string, n double, own double, losses array<double>"),
                         "calibration")
    sums = found.where("losses is not null").agg(*[F.sum(F.col("losses")[j]) for j in range(len(SCALES))]).first()
    own = found.where("lang is not null").select("lang", "n", "own")
    sizes = {r["lang"]: r["c"] for r in own.groupBy("lang").agg(F.count("*").alias("c")).collect()}
    if not sizes:
        return
    model.scale = SCALES[int(np.argmin(list(sums)))]
    own = own.where(F.col("lang").isin([name for name, c in sizes.items() if c >= 5]))

    def of_each(table: DataFrame, value: str) -> DataFrame:
        return exact_percentiles(table, value, [0.5], ["lang"]).select(F.col("lang").alias("_l"), F.col(value).alias("m"))

    def with_median(table: DataFrame, of: DataFrame, name: str) -> DataFrame:
        return table.join(F.broadcast(of), F.col("lang") == F.col("_l")).withColumn(name, F.col("m")).drop("_l", "m")
    own = with_median(own, of_each(own, "own"), "mean")
    own = with_median(own, of_each(own, "n"), "usual")
    own = write_shared(own.withColumn("gap", F.abs(F.col("own") - F.col("mean"))), "gaps")
    off = own.withColumn("wide", F.col("gap") * F.sqrt("n"))
    spread = {r["_l"]: r["m"] * 1.5 + 1e-3 for r in of_each(own.where("n >= usual"), "gap").collect()}
    deviation = {r["_l"]: r["m"] * 1.5 + 1e-3 for r in of_each(off, "wide").collect()}
    mean = {r["lang"]: r["mean"] for r in own.groupBy("lang").agg(F.first("mean").alias("mean")).collect()}
    model.bounds = {name: (mean[name], spread[name], deviation[name]) for name in sorted(mean)}
    if mean:
        table = rows.sparkSession.createDataFrame([(a, *b) for a, b in model.bounds.items()],
                                                  "_l string, _m double, _s double, _d double")
        worst = own.join(F.broadcast(table), F.col("lang") == F.col("_l")).select(
            ((F.col("own") - F.col("_m")) / (F.col("_s") + F.col("_d") / F.sqrt("n"))).alias("worst"))
        far = exact_percentiles(worst, "worst", [0.999]).first()["worst"]
        model.k = max(8.0, float(far) * 2)


# --- prediction --------------------------------------------------------------

def identify(docs: DataFrame, model: Model, text: str = "text",
             out: tuple[str, str, str] = ("lang_pred", "score", "rejected"),
             columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``columns``) with prediction, score and rejection."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in (columns or docs.columns) if c not in out]
    schema = StructType([docs.schema[c] for c in keep] + [
        StructField(out[0], StringType()), StructField(out[1], DoubleType()),
        StructField(out[2], BooleanType())])
    rows = docs.select(*keep, F.col(text).alias("\x01text"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, rejected = shared.value.judge(batch, len(keep))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(names, pa.string()), pa.array(score),
                 pa.array(rejected)], [*keep, *out])
    return rows.mapInArrow(trimmed(predict), schema)
