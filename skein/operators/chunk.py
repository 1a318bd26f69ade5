"""Text chunking: one document row -> many chunk rows.

``chunk_fixed`` is a pure expression (``sequence`` + ``transform`` +
``posexplode``): no shuffle, no Python, code-point offsets on both sides.
``chunk_recursive`` (the legacy separator-based splitter) runs as an Arrow
``mapInPandas`` over document partitions, because its greedy merge is a
sequential scan that DataFrame expressions cannot state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
DEFAULT_CHUNK_SIZE = 1000
DEFAULT_CHUNK_OVERLAP = 200
RECURSIVE_SEPARATORS = ["\n\n", "\n", " ", ""]
# --- end of fixed values ----------------------------------------------------


def chunk_params(size: int | None, overlap: int | None,
                 zero_means_default: bool = True) -> tuple[int, int]:
    """Resolve per-call overrides; like the reference, a 0 (or None) falls
    back to the default unless ``zero_means_default=False``."""
    if zero_means_default:
        size = size or DEFAULT_CHUNK_SIZE
        overlap = overlap or DEFAULT_CHUNK_OVERLAP
    else:
        size = DEFAULT_CHUNK_SIZE if size is None else size
        overlap = DEFAULT_CHUNK_OVERLAP if overlap is None else overlap
    if size <= 0:
        raise ValueError("chunk size must be positive")
    return size, overlap


def chunk_array(text, size: int = DEFAULT_CHUNK_SIZE,
                overlap: int = DEFAULT_CHUNK_OVERLAP) -> Column:
    """Array of fixed-size overlapping chunks of ``text``.

    ``''``/NULL -> empty; ``len <= size`` -> ``[text]``; otherwise chunk i is
    ``text[i*step : i*step + size]`` for every start ``i*step < len`` with
    ``step = size - overlap`` (``size`` when overlap is 0), i.e.
    ``ceil(len / step)`` chunks, the last one possibly inside the previous.
    ``overlap >= size`` stops after two chunks, the second taken with
    Python's slice rules for a start ``size - overlap <= 0``.
    """
    t = F.col(text) if isinstance(text, str) else text
    n = F.length(t)
    if overlap >= size:
        s2, e2 = size - overlap, 2 * size - overlap
        # Python slice t[s2:e2] with s2 <= 0 (negative counts from the end)
        st = F.greatest(F.lit(s2) + n, F.lit(0)) if s2 < 0 else F.lit(0)
        en = (F.greatest(F.lit(e2) + n, F.lit(0)) if e2 < 0
              else F.least(F.lit(e2), n))
        second = F.when(en > st, F.substring(t, st + 1, en - st)).otherwise(F.lit(""))
        many = F.array(F.substring(t, 1, size), second)
    else:
        step = size - overlap if overlap > 0 else size
        many = F.transform(F.sequence(F.lit(0), n - 1, F.lit(step)),
                           lambda s: F.substring(t, s + 1, size))
    return (F.when(t.isNull() | (n == 0), F.array().cast("array<string>"))
            .when(n <= size, F.array(t))
            .otherwise(many))


def chunk_fixed(df: DataFrame, text: str = "text", size: int | None = None,
                overlap: int | None = None, zero_means_default: bool = True,
                index_col: str = "chunk_index", chunk_col: str = "chunk",
                keep: list[str] | None = None) -> DataFrame:
    """One row per chunk: ``keep`` columns (default: all but ``text``),
    ``chunk_index`` (0-based) and ``chunk``."""
    size, overlap = chunk_params(size, overlap, zero_means_default)
    keep = [c for c in df.columns if c != text] if keep is None else keep
    return df.select(*keep, F.posexplode(chunk_array(text, size, overlap))
                     .alias(index_col, chunk_col))


def chunk_counts(df: DataFrame, text: str = "text", size: int | None = None,
                 overlap: int | None = None, zero_means_default: bool = True,
                 keep: list[str] | None = None) -> DataFrame:
    """``num_chunks`` and ``total_characters`` per row, computed without
    materialising the chunks."""
    size, overlap = chunk_params(size, overlap, zero_means_default)
    t = F.col(text)
    n = F.coalesce(F.length(t), F.lit(0))
    if overlap >= size:
        many = F.lit(2)
    else:
        step = size - overlap if overlap > 0 else size
        many = F.ceil(n / F.lit(step))
    num = F.when(n == 0, F.lit(0)).when(n <= size, F.lit(1)).otherwise(many)
    keep = [c for c in df.columns if c != text] if keep is None else keep
    return df.select(*keep, num.cast("bigint").alias("num_chunks"),
                     n.cast("bigint").alias("total_characters"))


def article_chunks(articles: DataFrame, size: int | None = None,
                   overlap: int | None = None) -> DataFrame:
    """Chunks of article records with their metadata attached.

    ``article_id`` is the record's ``url_hash`` when present, else its URL.
    """
    art_id = F.col("url_hash") if "url_hash" in articles.columns else F.col("url")
    src = articles.select(art_id.alias("article_id"), "title", "url",
                          *[c for c in ("authors", "publish_date") if c in articles.columns],
                          "text")
    return chunk_fixed(src, "text", size, overlap)


# ---------------------------------------------------------------------------
# recursive separator splitter (sequential greedy merge -> mapInPandas)
# ---------------------------------------------------------------------------

def _bounds(text: str, lo: int, hi: int, sep: str) -> list[int]:
    """Offsets at which ``text[lo:hi]`` is cut: before every separator."""
    if sep == "":
        return list(range(lo, hi + 1))
    cuts, at = [lo], text.find(sep, lo, hi)
    while at >= 0:
        if at > lo:
            cuts.append(at)
        at = text.find(sep, at + len(sep), hi)
    return [*cuts, hi]


def _windows(cuts: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Greedy spans over neighbouring pieces: as many pieces as fit ``size``;
    the next span begins at the earliest piece that leaves at most ``overlap``
    characters before the piece that did not fit, and room for it."""
    first = 0
    for k in range(len(cuts) - 1):
        if k > first and cuts[k + 1] - cuts[first] > size:
            yield cuts[first], cuts[k]
            while first < k and (cuts[k] - cuts[first] > overlap or cuts[k + 1] - cuts[first] > size):
                first += 1
    if cuts[first] < cuts[-1]:
        yield cuts[first], cuts[-1]


def recursive_spans(text: str, size: int, overlap: int, separators: list[str],
                    lo: int = 0, hi: int | None = None) -> Iterator[tuple[int, int, bool]]:
    """``(start, end, whole)`` of each chunk of ``text[lo:hi]``.  The first
    separator that occurs cuts the text; neighbouring pieces under ``size`` are
    spanned greedily, and a longer piece is cut by the later separators, or
    stands whole when there are none."""
    hi = len(text) if hi is None else hi
    level = next((k for k, s in enumerate(separators) if s == "" or text.find(s, lo, hi) >= 0), None)
    sep = separators[-1] if level is None else separators[level]
    later = [] if level is None or sep == "" else separators[level + 1:]
    run: list[int] = []
    cuts = _bounds(text, lo, hi, sep)
    for start, end in zip(cuts, cuts[1:]):
        if end - start < size:
            run = run or [start]
            run.append(end)
            continue
        if run:
            yield from ((a, b, False) for a, b in _windows(run, size, overlap))
            run = []
        if later:
            yield from recursive_spans(text, size, overlap, later, start, end)
        else:
            yield start, end, True
    if run:
        yield from ((a, b, False) for a, b in _windows(run, size, overlap))


def split_recursive(text: str, size: int = DEFAULT_CHUNK_SIZE,
                    overlap: int = DEFAULT_CHUNK_OVERLAP,
                    separators: list[str] | None = None) -> list[str]:
    """Chunk texts of ``recursive_spans``: spans are stripped and blank ones
    dropped, pieces that no separator could cut stand as they are."""
    seps = RECURSIVE_SEPARATORS if separators is None else separators
    chunks = (text[a:b] if whole else text[a:b].strip()
              for a, b, whole in recursive_spans(text, size, overlap, seps))
    return [c for c in chunks if c]


def chunk_recursive(df: DataFrame, id_col: str = "doc_id", text: str = "text",
                    size: int = DEFAULT_CHUNK_SIZE,
                    overlap: int = DEFAULT_CHUNK_OVERLAP) -> DataFrame:
    """One row per recursive chunk: ``id_col, chunk_index, chunk``."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            ids, idx, chunks = [], [], []
            for key, t in zip(pdf[id_col], pdf[text]):
                if t is None or t == "":
                    continue
                for i, c in enumerate(split_recursive(t, size, overlap)):
                    ids.append(key)
                    idx.append(i)
                    chunks.append(c)
            yield pd.DataFrame({id_col: ids, "chunk_index": idx, "chunk": chunks})

    return df.select(id_col, text).mapInPandas(
        run, f"{id_col} {id_type}, chunk_index int, chunk string")
