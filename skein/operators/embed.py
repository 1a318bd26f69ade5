"""Embedding stage: texts -> vectors, each distinct text computed once.

The embedding model is a *batch function* ``fn(list[str]) -> 2-D array``
applied with ``mapInPandas`` (Arrow batches), so any Python model can be
plugged in.  The built-in default is a deterministic hashed character
3-gram embedder (works offline, reproducible in SQL):

    words of the text (whitespace split) -> each padded with one space on
    both sides -> every character 3-gram -> bucket = first 4 hex digits of
    md5(gram) as an integer, mod D -> term counts -> L2 normalisation.

Dedup and cache are relational: texts meet by ``text_hash`` (SHA-256) before the
model, ``left_anti`` against the persisted cache table, join back after.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import text_hash

# --- fixed values -----------------------------------------------------------
MANY_COPIES = 10_000            # rows of one text that go to one task
DEFAULT_DIM = 128
DEFAULT_MODEL = "hashed-char3"
GRAM = 3
# --- end of fixed values ----------------------------------------------------

BatchFn = Callable[[list], np.ndarray]


_CP = np.uint64(0x110000)          # code point radix for 3-gram ids


def hashed_embedder(dim: int = DEFAULT_DIM) -> BatchFn:
    """The built-in batch embedding function (see module docstring).

    Vectorised: each text becomes its space-padded words laid end to end as
    a code-point array; gram ids are read off with numpy, and md5 is taken
    once per distinct gram (memoised across batches).
    """
    memo: dict[int, int] = {}

    def bucket_of(gid: int) -> int:
        b = memo.get(gid)
        if b is None:
            c0, rest = divmod(gid, int(_CP) * int(_CP))
            c1, c2 = divmod(rest, int(_CP))
            g = chr(c0) + chr(c1) + chr(c2)
            b = int(hashlib.md5(g.encode("utf-8")).hexdigest()[:4], 16) % dim
            memo[gid] = b
        return b

    def embed(texts: list) -> np.ndarray:
        n = len(texts)
        rows, ids = [], []
        for r, t in enumerate(texts):
            ws = t.split() if t else []
            if not ws:
                continue
            s = " " + "  ".join(ws) + " "          # padded words, end to end
            a = np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            lens = np.fromiter((len(w) for w in ws), dtype=np.int64, count=len(ws))
            word_start = np.concatenate(([0], np.cumsum(lens + 2)[:-1]))
            # a padded word of length L + 2 has L grams, starting at 0..L-1
            first = np.repeat(word_start, lens)
            offs = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
            st = first + offs
            ids.append(a[st] * _CP * _CP + a[st + 1] * _CP + a[st + 2])
            rows.append(np.full(len(st), r, dtype=np.int64))
        out = np.zeros((n, dim), dtype=np.float64)
        if ids:
            all_ids = np.concatenate(ids)
            uniq, inv = np.unique(all_ids, return_inverse=True)
            buckets = np.fromiter((bucket_of(int(g)) for g in uniq), dtype=np.int64,
                                  count=len(uniq))[inv]
            flat = np.concatenate(rows) * dim + buckets
            out = np.bincount(flat, minlength=n * dim).reshape(n, dim).astype(np.float64)
        norms = np.sqrt((out * out).sum(axis=1))
        nz = norms > 0
        out[nz] /= norms[nz][:, None]
        return out.astype(np.float32)
    embed.dim = dim  # type: ignore[attr-defined]
    return embed


def embed_texts(df: DataFrame, text: str = "text", fn: BatchFn | None = None,
                out: str = "embedding", batch_size: int = 256,
                dim: int | None = None) -> DataFrame:
    """Append ``out ARRAY<FLOAT>`` computed by the batch function ``fn``.

    Rows keep their order within a partition; a model error fails the task
    (and Spark retries it), as errors surface in the reference.  ``dim``
    turns a wrong vector length into a job error.
    """
    fn = fn or hashed_embedder()
    from pyspark.sql import types as T
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches):
        for pdf in batches:
            for s in range(0, len(pdf), batch_size):
                part = pdf.iloc[s:s + batch_size].copy()
                vecs = np.asarray(fn(part[text].tolist()), dtype=np.float32)
                if dim is not None and vecs.shape[1] != dim:
                    raise ValueError(f"embedding dimension {vecs.shape[1]} != {dim}")
                part[out] = list(vecs)
                yield part

    return df.mapInPandas(run, schema)


def embed_dedup(df: DataFrame, text: str = "text", fn: BatchFn | None = None,
                out: str = "embedding", many: int = MANY_COPIES) -> DataFrame:
    """Embed each distinct text once, beside all rows that hold it.

    Rows are dealt by text hash and sorted by it, once and with their texts, so equal
    texts follow one another and no vector is shuffled.  Texts on more than ``many``
    rows would crowd a task: their rows stay where they are, and their vectors, at
    most one for each ``many`` rows, are broadcast.  ``df`` is read twice (hashes are
    counted first), four times if there are such texts.
    """
    keyed = df.withColumn("text_hash", text_hash(F.col(text)))
    keyed = keyed.select("text_hash", *[c for c in keyed.columns if c != "text_hash"])
    crowded = (keyed.where(F.col("text_hash").isNotNull()).groupBy("text_hash").count()
               .where(F.col("count") > many).select("text_hash").collect())
    if not crowded:
        return _embed_runs(keyed, text, fn, out)
    names = F.broadcast(df.sparkSession.createDataFrame(crowded, "text_hash string"))
    rows = keyed.join(names, "text_hash", "left_semi")
    vecs = embed_texts(rows.select("text_hash", text).dropDuplicates(["text_hash"]), text, fn, out)
    return (_embed_runs(keyed.join(names, "text_hash", "left_anti"), text, fn, out)
            .unionByName(rows.join(F.broadcast(vecs.select("text_hash", out)), "text_hash")))


def _embed_runs(keyed: DataFrame, text: str, fn: BatchFn | None, out: str,
                batch_size: int = 256) -> DataFrame:
    """Append ``out``, computed once for each run of rows with one ``text_hash``; null
    texts get null."""
    import pyarrow as pa
    from pyspark.sql import types as T
    fn = fn or hashed_embedder()
    schema = T.StructType(keyed.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches):
        before, last = None, None               # hash and vector of the row before
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes = batch.column("text_hash").to_numpy(zero_copy_only=False)
            new = np.ones(len(hashes), bool)
            new[1:] = hashes[1:] != hashes[:-1]
            new[:1] = hashes[:1] != before
            null = np.array([h is None for h in hashes], bool)
            new &= ~null
            texts = batch.column(text).take(pa.array(np.flatnonzero(new))).to_pylist()
            made = [np.asarray(fn(texts[s:s + batch_size]), dtype=np.float32)
                    for s in range(0, len(texts), batch_size)]
            if last is not None:
                made.insert(0, last[None, :])
            if made:
                vecs = np.concatenate(made)
                which = (np.cumsum(new) - (last is None))[~null]
                flat = vecs[which].reshape(-1)
            else:                               # nulls alone so far
                vecs, flat = np.empty((0, 0), np.float32), np.empty(0, np.float32)
            lengths = np.where(null, 0, vecs.shape[1])
            made = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat),
                mask=pa.array(null))
            if len(vecs):
                before, last = (hashes[-1], vecs[-1]) if not null[-1] else (None, last)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], schema.names)

    return (keyed.repartition("text_hash").sortWithinPartitions("text_hash")
            .mapInArrow(run, schema))


def embed_cached(df: DataFrame, cache: DataFrame | None, text: str = "text",
                 fn: BatchFn | None = None, model: str = DEFAULT_MODEL,
                 out: str = "embedding", use_cache: bool = True):
    """Embed only the texts the cache lacks.

    Returns ``(embedded_df, new_cache_rows)``; the caller appends
    ``new_cache_rows`` to the cache table.  The cache key is
    (model, text_hash) — a deliberate widening of a hash-only key, so two
    models never share vectors.  ``use_cache=False`` neither reads nor
    writes the cache.
    """
    keyed = df.withColumn("text_hash", text_hash(F.col(text)))
    uniq = keyed.select("text_hash", text).dropDuplicates(["text_hash"])
    if not use_cache or cache is None:
        fresh = embed_texts(uniq, text, fn, out)
        vecs = fresh.select("text_hash", out)
        new_rows = fresh.select(F.lit(model).alias("model"), "text_hash",
                                F.size(out).alias("dimensions"),
                                F.current_timestamp().alias("created_at"), out)
        return keyed.join(vecs, "text_hash", "left"), (new_rows if use_cache else None)
    # one vector per key, also where an append was retried: the latest
    known = (cache.filter(F.col("model") == model).groupBy("text_hash")
             .agg(F.max_by(out, "created_at").alias(out)) if "created_at" in cache.columns else
             cache.filter(F.col("model") == model).groupBy("text_hash").agg(F.first(out).alias(out)))
    missing = uniq.join(known.select("text_hash"), "text_hash", "left_anti")
    fresh = embed_texts(missing, text, fn, out)
    new_rows = fresh.select(F.lit(model).alias("model"), "text_hash",
                            F.size(out).alias("dimensions"),
                            F.current_timestamp().alias("created_at"), out)
    vecs = known.unionByName(fresh.select("text_hash", out))
    return keyed.join(vecs, "text_hash", "left"), new_rows


def cache_stats(requests: DataFrame, cache: DataFrame | None = None,
                text: str = "text", model: str = DEFAULT_MODEL,
                use_cache: bool = True) -> DataFrame:
    """total_requests, hits, misses, cache_size, hit_rate for one batch of
    requests against a cache table.

    A request is a miss when its text is neither in the cache nor seen
    earlier in the batch, so misses = distinct uncached texts and no window
    over a (possibly hot) text is needed.  With ``use_cache=False`` every
    request is a miss and the cache does not grow.
    """
    hashes = requests.select(text_hash(F.col(text)).alias("text_hash"))
    if cache is not None:
        known = cache.filter(F.col("model") == model).select("text_hash").distinct()
    else:
        known = hashes.limit(0)
    # flag each request hash as cached or not, then one aggregate over the
    # requests stacked with the cache keys (the cache size needs its count)
    req = hashes.join(known.withColumn("_cached", F.lit(True)), "text_hash", "left")
    rows = (req.select("text_hash", F.coalesce("_cached", F.lit(False)).alias("_cached"),
                       F.lit(True).alias("_req"))
            .unionByName(known.select("text_hash", F.lit(True).alias("_cached"),
                                      F.lit(False).alias("_req"))))
    s = rows.agg(F.count_if(F.col("_req")).alias("total_requests"),
                 F.count_distinct(F.when(F.col("_req") & ~F.col("_cached"), F.col("text_hash")))
                 .alias("_new"),
                 F.count_if(~F.col("_req")).alias("_before"))
    if use_cache:
        m = F.col("_new")
        size = F.col("_before") + F.col("_new")
    else:
        m = F.col("total_requests")
        size = F.col("_before")
    return s.select(
        "total_requests", (F.col("total_requests") - m).alias("hits"), m.alias("misses"),
        size.alias("cache_size"),
        F.coalesce(F.try_divide(F.col("total_requests") - m, F.col("total_requests")),
                   F.lit(0.0)).alias("hit_rate"))

