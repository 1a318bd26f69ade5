"""Exact and approximate k-nearest-neighbour search over vector tables.

Distances are **squared** Euclidean (what an L2 flat index reports), ranked
ascending with ties broken by vector id.  ``similarity = 1 / (1 + distance)``.

Exact search is a blocked matrix kernel, never a row-per-pair join:

* broadcast plan — when the query side is small (its size is counted first
  and compared with ``broadcast_bytes``), the query matrix is broadcast and
  every vector partition keeps a running top-k per query
  (``mapInArrow``); only ``k`` candidates per query and partition are
  shuffled to the final per-query top-k.
* tiled plan — beyond that bound, queries are hashed into blocks and vectors
  into shards; each (block, shard) tile is a task running the same kernel.
  Queries are copied once per shard and vectors once per block, as packs of
  up to ``PACK_ROWS`` rows (ids and one matrix); a task holds one block and
  reads its shard's packs one after another, ``TILE_FLOATS`` numbers together.

Approximate search (``knn_approx``) is an IVF index: MLlib k-means cells,
vectors stored with their cell, each query probes its ``nprobe`` nearest
cells through an equi-join on the cell id, then runs the exact kernel per
cell group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_BROADCAST_BYTES = 16 << 20      # query matrix bytes allowed in a broadcast
DEFAULT_QUERY_BLOCK = 4096              # queries per tile in the tiled plan, at least
DEFAULT_SHARD_VECTORS = 20_000          # vectors per tile in the tiled plan, at least
TILE_FLOATS = 16 << 20                  # floats of one side of a tile, where there are many tiles
_SINGLE = 1e30                          # squared norms up to which single precision screens
PACK_ROWS = 4096                        # most vectors of a row that the tiled plan moves
PACK_BYTES = 32 << 20                   # numbers a task holds while it packs
_SUB_BLOCK = 1024                       # vectors and
_SUB_QUERIES = 512                      # queries whose products are made at once (2 MB)
_BLOCK_CELLS = 8_000_000                # max distance-matrix cells per block (64 MB)
_EXACT_FLOATS = 1 << 16                 # numbers of candidates that are measured at once (0.5 MB)
_GROUP = 1024                           # vectors of one place that are ruled out together
_AXES = 4                               # widest directions that places are told apart by
_GROUPS_FROM = 4096                     # queries and vectors from which places are worth finding


# ---------------------------------------------------------------------------
# numpy kernel: running top-k of squared distances, ties broken by id
# ---------------------------------------------------------------------------

class _TopK:
    """Running per-query top-k: smallest distance first, then smallest id.

    Distances are ``sum((q - v)^2)`` in double precision, rounded to
    ``tie_digits`` decimals for ranking when that is given.  One matrix product
    per block, ``q.v - |v|^2 / 2`` in single precision, only picks candidates:
    every vector that lies within that product's rounding error (plus one
    rounding step) of the k-th is measured exactly, so the kept rows depend
    neither on block sizes nor on the order of arrival, and ties go to the
    smaller id for any id type that sorts.  Numbers too large for single
    precision are screened in double.

    ``bound`` (squared, one a query) rules out what lies beyond it from the start.

    ``add_all`` with many queries and vectors deals the vectors to groups of one
    place and lets a query meet only groups that can hold one of its k nearest (``_places``).
    """

    def __init__(self, q_ids: np.ndarray, q_mat: np.ndarray, k: int,
                 exclude_self: bool, tie_digits: int | None = None,
                 bound: np.ndarray | None = None):
        self.q_ids = q_ids
        self.q = q_mat.astype(np.float64, copy=False)
        self.q_norm = np.einsum("ij,ij->i", self.q, self.q)
        self.open = np.isfinite(self.q_norm)        # others have no distance to anything
        self.q_max = float(np.max(self.q_norm, initial=0.0, where=self.open))
        self.screens: dict = {}
        self.products = np.empty(0, np.float32)     # of one block, overwritten by the next
        self.k = k
        self.exclude_self = exclude_self
        self.tie_digits = tie_digits
        self.gap = 0.0 if tie_digits is None else 10.0 ** -tie_digits
        self.found, self.waiting = [], 0            # not ranked yet
        self.axes = self.at = None                  # what places are told by, and those of the queries
        self.pairs = 0                              # products made
        self.rows = np.empty(0, dtype=np.int64)
        self.dist = np.empty(0)
        self.key = np.empty(0)
        self.ids = None
        # k-th ranking key so far
        self.kth = np.full(len(q_ids), np.inf) if bound is None else np.array(bound, dtype=np.float64)

    def _exact(self, v: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows))
        step = max(1, _EXACT_FLOATS // max(1, v.shape[1]))
        for s in range(0, len(rows), step):
            diff = self.q[rows[s:s + step]] - v[cols[s:s + step]]
            out[s:s + step] = np.square(diff).sum(axis=1)
        return out

    def _screen(self, kind) -> np.ndarray:
        """The queries with a column of ones, which takes the vectors' norms."""
        if kind not in self.screens:
            out = np.ones((self.q.shape[0], self.q.shape[1] + 1), kind)
            with np.errstate(over="ignore", invalid="ignore"):      # of rows that are emptied next
                out[:, :-1] = self.q
            out[~self.open, :-1] = 0.0
            self.screens[kind] = out
        return self.screens[kind]

    def add(self, v_ids: np.ndarray, v_mat: np.ndarray, only: np.ndarray | None = None, rank: bool = True) -> None:
        """Meet a block of vectors; ``only`` names the queries (row numbers) that meet it.
        Without ``rank`` what is found waits: for queries that meet no more before others."""
        if len(v_ids) == 0 or len(self.q_ids) == 0:
            return
        v = v_mat.astype(np.float64, copy=False)
        if v.shape[1] != self.q.shape[1]:
            raise ValueError(f"vector dimension {v.shape[1]} differs from "
                             f"query dimension {self.q.shape[1]}")
        v_norm = np.einsum("ij,ij->i", v, v)
        finite = np.isfinite(v_norm)
        if not finite.all():
            v_ids, v, v_norm = v_ids[finite], v[finite], v_norm[finite]
        some = self.open if only is None else self.open[only]
        if not some.all():
            only = np.flatnonzero(some) if only is None else only[some]
        n, b = len(self.q_ids) if only is None else len(only), len(v_ids)
        if b == 0 or n == 0:
            return
        self.pairs += n * b
        v_max = float(v_norm.max())
        kind = np.float32 if max(self.q_max, v_max) < _SINGLE else np.float64
        screen, other = self._screen(kind), np.concatenate([v, v_norm[:, None] * -0.5], 1).astype(kind).T
        wide = False
        for at in range(0, n, _SUB_QUERIES):
            part = slice(at, min(n, at + _SUB_QUERIES)) if only is None else only[at:at + _SUB_QUERIES]
            mine = screen[part]
            if self.products.dtype != kind or self.products.size < len(mine) * b:
                self.products = np.empty(max(len(mine) * b, _SUB_QUERIES * _SUB_BLOCK), kind)
            s = np.matmul(mine, other, out=self.products[:len(mine) * b].reshape(len(mine), b))
            wide |= self._meet(part, s, v_ids, v, v_max)
        # ranked together once they are an eighth of what is kept: until then the k-th is
        # larger than need be, so nothing is lost
        if rank and (wide or self.waiting > len(self.rows) // 8):
            self._rank()

    def add_all(self, v_ids: np.ndarray, v_mat: np.ndarray) -> None:
        if min(len(self.q_ids), len(v_ids)) >= _GROUPS_FROM and v_mat.shape[1] > _AXES:
            norm = np.einsum("ij,ij->i", v_mat, v_mat, dtype=np.float64)
            # others have no distance to anything, or squares near overflow
            if norm.max() < _SINGLE and self.q_max < _SINGLE:
                return self._add_groups(v_ids, v_mat, float(norm.max()))
        for s in range(0, len(v_ids), _SUB_BLOCK):
            self.add(v_ids[s:s + _SUB_BLOCK], v_mat[s:s + _SUB_BLOCK])

    def _places(self, m: np.ndarray) -> np.ndarray:
        """Where vectors lie: their coordinates along the axes and their distance from the
        plane of these.  Two places are no further apart than their vectors."""
        mean, axes = self.axes
        out = np.empty((len(m), axes.shape[1] + 1))
        step = max(1, _BLOCK_CELLS // 8 // m.shape[1])
        for s in range(0, len(m), step):
            x = m[s:s + step] - mean
            along = x @ axes
            out[s:s + step, :-1] = along
            out[s:s + step, -1] = np.sqrt(np.square(x - along @ axes.T).sum(axis=1))
        return out

    def _add_groups(self, v_ids: np.ndarray, v_mat: np.ndarray, v_max: float) -> None:
        """Meet many vectors, group by group.  A group is a box of places; a query whose
        place is further from the box than its k-th neighbour so far does not meet it."""
        if self.axes is None:
            some = v_mat[::-(-len(v_mat) // 8192)].astype(np.float64)
            mean = some.mean(axis=0)
            self.axes = mean, np.linalg.eigh((some - mean).T @ (some - mean))[1][:, -_AXES:]
            q = self.q if self.open.all() else np.where(self.open[:, None], self.q, 0.0)
            self.at = np.ascontiguousarray(self._places(q).T)
        at = self._places(v_mat)
        groups, todo = [], [np.arange(len(at))]
        while todo:
            rows = todo.pop()
            if len(rows) <= _GROUP:
                groups.append(rows)
                continue
            wide = np.argmax(np.ptp(at[rows], axis=0))
            half = len(rows) // 2
            rows = rows[np.argpartition(at[rows, wide], half)]
            todo += [rows[half:], rows[:half]]
        # queries without a k-th yet meet the group nearest to them before all others
        first = np.full(len(self.q_ids), -1)
        new = np.flatnonzero(np.isinf(self.kth) & self.open)
        if len(new):
            here, nearest = self.at[:, new], np.full(len(new), np.inf)
            for g, rows in enumerate(groups):
                d = sum(np.square(x - c) for x, c in zip(here, at[rows].mean(axis=0)))
                closer = d < nearest
                nearest[closer], first[new[closer]] = d[closer], g
            for g, rows in enumerate(groups):
                self.add(v_ids[rows], v_mat[rows], np.flatnonzero(first == g), rank=False)
            self._rank()
        slack = self.gap + 1e-11 * (self.q_norm + v_max)        # rounding of places and of keys
        for g, rows in enumerate(groups):
            low, high = at[rows].min(axis=0), at[rows].max(axis=0)
            apart = sum(np.square(x - np.clip(x, lo, hi)) for x, lo, hi in zip(self.at, low, high))
            self.add(v_ids[rows], v_mat[rows], np.flatnonzero((apart <= self.kth + slack) & (first != g)))

    def _meet(self, part, s: np.ndarray, v_ids: np.ndarray, v: np.ndarray, v_max: float) -> bool:
        """Note what may be nearest to the queries ``part`` by their products ``s``; whether
        some of them found vectors without a k-th yet."""
        k, b, kind = self.k, len(v_ids), s.dtype.type
        info = np.finfo(kind)
        q_norm, kth = self.q_norm[part], self.kth[part]
        # of the squared distance: rounded inputs, products and sums
        tol = 4 * (v.shape[1] + 8) * (float(info.eps) * (q_norm + v_max) + float(info.tiny))
        limit = kth
        wide = np.flatnonzero(np.isinf(kth))
        if len(wide) and b > k:
            # without a k-th yet: the k-th of this block, the query itself not counted
            want = k + 1 if self.exclude_self else k
            if b > want:
                best = np.partition(s[wide], b - want, axis=1)[:, b - want].astype(np.float64)
                limit = kth.copy()
                limit[wide] = q_norm[wide] - 2.0 * best + tol[wide]
        # distance <= limit, said of the product; rounded down, so that none is lost
        least = (q_norm - (limit + tol + self.gap)) * 0.5
        least = np.nextafter(least.astype(kind), kind(-np.inf))
        some = np.flatnonzero(s.max(axis=1) >= least)
        if len(some) == 0:
            return False
        s, least = s[some], least[some]
        flat = np.flatnonzero(s >= least[:, None])
        rows = flat // b
        want = k + 1 if self.exclude_self else k
        if b > 2 * want and len(flat) > 2 * want:
            many = np.flatnonzero(np.bincount(rows) > 2 * want)
            if len(many):
                # none beyond the k-th of this block
                best = np.partition(s[many], b - want, axis=1)[:, b - want].astype(np.float64)
                bar = best - (tol[some[many]] + 0.5 * self.gap)
                least[many] = np.maximum(least[many], np.nextafter(bar.astype(kind), kind(-np.inf)))
                near = s.ravel()[flat] >= least[rows]
                flat, rows = flat[near], rows[near]
        rows, cols = some[rows], flat % b
        rows = rows + part.start if isinstance(part, slice) else part[rows]
        ids = v_ids[cols]
        if self.exclude_self:
            other = self.q_ids[rows] != ids
            rows, cols, ids = rows[other], cols[other], ids[other]
        dist = self._exact(v, rows, cols)
        key = dist if self.tie_digits is None else np.round(dist, self.tie_digits)
        near = np.isfinite(dist) & (key <= self.kth[rows])
        rows, dist, key, ids = rows[near], dist[near], key[near], ids[near]
        if len(rows) == 0:
            return False
        if self.ids is None:
            self.ids = ids[:0]
        self.found.append((rows, dist, key, ids))
        self.waiting += len(rows)
        return len(wide) > 0

    def _rank(self) -> None:
        """Merge what was found since; only the queries that found something are ranked anew."""
        if not self.found:
            return
        k = self.k
        rows, dist, key, ids = (np.concatenate(c) for c in zip(*self.found))
        self.found, self.waiting = [], 0
        met = np.zeros(len(self.q_ids), bool)
        met[rows] = True
        again = met[self.rows]
        rest = ~again
        rows, dist = np.concatenate([self.rows[again], rows]), np.concatenate([self.dist[again], dist])
        key, ids = np.concatenate([self.key[again], key]), np.concatenate([self.ids[again], ids])
        order = np.lexsort((key, rows))
        # ids, which may be strings, are compared only where distances are equal
        same = (np.diff(rows[order]) == 0) & (np.diff(key[order]) == 0)
        tied = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))
        if len(tied):
            among = order[tied]
            order[tied] = among[np.lexsort((ids[among], key[among], rows[among]))]
        rows = rows[order]
        pos = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = pos < k
        order, rows, last = order[keep], rows[keep], pos[keep] == k - 1
        dist, key, ids = dist[order], key[order], ids[order]
        self.kth[rows[last]] = np.minimum(self.kth[rows[last]], key[last])
        self.rows, self.dist = np.concatenate([self.rows[rest], rows]), np.concatenate([self.dist[rest], dist])
        self.key, self.ids = np.concatenate([self.key[rest], key]), np.concatenate([self.ids[rest], ids])

    def result(self) -> pa.RecordBatch | None:
        self._rank()
        if len(self.rows) == 0:
            return None
        order = np.argsort(self.rows, kind="stable")
        rows = self.rows[order]
        return pa.RecordBatch.from_arrays(
            [pa.array(self.q_ids[rows]), pa.array(self.ids[order]), pa.array(self.dist[order]),
             pa.array(self.key[order])],
            names=["query_id", "vec_id", "distance", "key"])


def _arrow_matrix(col: pa.Array) -> np.ndarray:
    """list<float> column (no nulls, equal lengths) -> 2-D numpy array."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return np.zeros((0, 0), dtype=np.float32)
    sizes = pc.list_value_length(col)
    if pc.min(sizes).as_py() != pc.max(sizes).as_py():
        raise ValueError("vectors of different lengths in one column")
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1)


def _ids(col) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.to_numpy(zero_copy_only=False)


# ---------------------------------------------------------------------------
# public operators
# ---------------------------------------------------------------------------

def _empty_hits(spark, qid_type, vid_type) -> DataFrame:
    schema = T.StructType([
        T.StructField("query_id", qid_type), T.StructField("vec_id", vid_type),
        T.StructField("rank", T.IntegerType()),
        T.StructField("distance", T.DoubleType())])
    return spark.createDataFrame([], schema)


def _cand_schema(qid_type, vid_type) -> T.StructType:
    """Candidates of one task; ``key`` is the distance they are ranked on."""
    return T.StructType([
        T.StructField("query_id", qid_type), T.StructField("vec_id", vid_type),
        T.StructField("distance", T.DoubleType()), T.StructField("key", T.DoubleType())])


def _final_topk(cands: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("key", "vec_id")
    return (cands.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k)
            .select("query_id", "vec_id", "rank", "distance"))


def knn_exact(queries: DataFrame, vectors: DataFrame, k: int = 5, *,
              query_id: str = "query_id", query_vector: str = "embedding",
              vec_id: str = "vec_id", vector: str = "embedding",
              exclude_self: bool = False, dim: int | None = None,
              broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
              query_block: int | None = None,
              shard_vectors: int | None = None,
              strategy: str = "auto", tie_digits: int | None = None) -> DataFrame:
    """Exact top-k by squared L2 for every query row.

    Returns ``query_id, vec_id, rank INT (1-based), distance DOUBLE``.
    ``k < 0`` raises; ``k == 0`` or an empty side gives no rows; ``k > n``
    gives ``n`` rows per query.  ``dim`` makes a wrong-length vector a
    runtime error (``assert_true``), as the reference's dimension check.
    ``tie_digits`` ranks on the distance rounded to that many decimals (ties
    then go to the smaller id), for vectors with exact duplicates.
    """
    if k < 0:
        raise ValueError(f"k must be non-negative, got {k}")
    spark = queries.sparkSession
    q = queries.select(F.col(query_id).alias("query_id"),
                       F.col(query_vector).alias("qv")).filter(F.col("qv").isNotNull())
    v = vectors.select(F.col(vec_id).alias("vec_id"),
                       F.col(vector).alias("vv")).filter(F.col("vv").isNotNull())
    qid_type = q.schema["query_id"].dataType
    vid_type = v.schema["vec_id"].dataType
    if k == 0:
        return _empty_hits(spark, qid_type, vid_type)
    if dim is not None:
        q = q.filter(F.assert_true(F.size("qv") == dim,
                                   f"query dimension must be {dim}").isNull())
        v = v.filter(F.assert_true(F.size("vv") == dim,
                                   f"vector dimension must be {dim}").isNull())

    # The size check and the broadcast read the same rows: keep them so an
    # expensive query side (e.g. freshly embedded questions) is computed once.
    q = q.persist(StorageLevel.MEMORY_AND_DISK)
    stats = q.agg(F.count(F.lit(1)).alias("n"),
                  F.coalesce(F.sum(F.size("qv")), F.lit(0)).alias("floats")).first()
    n_queries, n_floats = int(stats["n"]), int(stats["floats"])
    if n_queries == 0:
        q.unpersist()
        return _empty_hits(spark, qid_type, vid_type)
    out_schema = _cand_schema(qid_type, vid_type)

    use_broadcast = (strategy == "broadcast" or
                     (strategy == "auto" and n_floats * 8 <= broadcast_bytes))
    if use_broadcast:
        cands = _broadcast_candidates(spark, q, v, k, exclude_self, out_schema, tie_digits)
        q.unpersist()
    else:
        cands = _tiled_candidates(q, v, k, exclude_self, out_schema, n_queries, max(1, n_floats // n_queries),
                                  query_block, shard_vectors, tie_digits)
    return _final_topk(cands, k)


def _broadcast_candidates(spark, q, v, k, exclude_self, out_schema, tie_digits):
    # The query side was counted and is below the broadcast bound.
    table = q.toArrow()
    q_ids = _ids(table.column("query_id"))
    q_mat = _arrow_matrix(table.column("qv"))
    bc = spark.sparkContext.broadcast((q_ids, q_mat))

    def kernel(batches):
        ids, mat = bc.value
        top = _TopK(ids, mat, k, exclude_self, tie_digits)
        for batch in batches:
            top.add_all(_ids(batch.column(0)), _arrow_matrix(batch.column(1)))
        out = top.result()
        if out is not None:
            yield out

    return v.mapInArrow(kernel, out_schema)


def _tile(k: int, exclude_self: bool, tie_digits: int | None = None):
    """Cogroup function: top-k of one block of queries over one shard."""
    def run(vpdf, qpdf):
        import pandas as pd
        empty = pd.DataFrame(columns=["query_id", "vec_id", "distance", "key"], dtype=object)
        if len(vpdf) == 0 or len(qpdf) == 0:
            return empty
        top = _TopK(qpdf["query_id"].to_numpy(), np.stack(qpdf["qv"].to_numpy()), k,
                    exclude_self, tie_digits)
        top.add_all(vpdf["vec_id"].to_numpy(), np.stack(vpdf["vv"].to_numpy()))
        out = top.result()
        if out is None:
            return empty
        # plain numpy columns: string ids stay objects, which Arrow takes in one piece
        cols = {c: out.column(c).to_numpy(zero_copy_only=False) for c in out.schema.names}
        return pd.DataFrame({c: pd.Series(x, dtype=x.dtype) for c, x in cols.items()})

    return run


def _tile_size(least: int, rows: int, dim: int, cores: int) -> int:
    """Rows of one side of a tile: as many as leave each core a few tiles, within
    ``TILE_FLOATS`` numbers.  Each side is copied once per tile of the other, so
    larger tiles keep the copies few where the tables are large."""
    return max(least, min(TILE_FLOATS // dim, -(-rows // max(1, math.isqrt(4 * cores)))))


def _shards(n_vectors: int, blocks: int, cores: int) -> int:
    """Shards that meet ``blocks`` blocks of queries.  A task reads its shard piece by piece,
    so a shard's size bounds no memory: a few tiles a core are enough.  Queries are copied
    and give k candidates once a shard."""
    shards = max(1, min(math.ceil(n_vectors / DEFAULT_SHARD_VECTORS), math.ceil(4 * cores / blocks)), cores // blocks)
    # the last round of tiles leaves few cores idle
    while shards * blocks > cores and -(-shards * blocks // cores) * cores > 1.1 * shards * blocks:
        shards += 1
    return shards


def _tiled_candidates(q, v, k, exclude_self, out_schema, n_queries, dim,
                      query_block, shard_vectors, tie_digits):
    v = v.persist(StorageLevel.MEMORY_AND_DISK)   # counted, then tiled
    n_vectors = v.count()
    cores = q.sparkSession.sparkContext.defaultParallelism
    query_block = query_block or _tile_size(DEFAULT_QUERY_BLOCK, n_queries, dim, cores)
    blocks = max(1, math.ceil(n_queries / query_block))
    shards = max(math.ceil(n_vectors / shard_vectors), cores // blocks, 1) if shard_vectors \
        else _shards(n_vectors, blocks, cores)
    kinds = ["<f4" if x.dataType.elementType == T.FloatType() else "<f8" for x in (q.schema["qv"], v.schema["vv"])]
    # of equal vectors only the k smallest ids can be hits (none is a query's own)
    vp = _packed(v, shards, kinds[1], None if exclude_self else k)
    qp = _packed(q, blocks, kinds[0])

    def tiles(packs: DataFrame, tile, vectors: bool) -> DataFrame:
        ids = [F.col("ids") if x == vectors else F.lit(None).cast(y.schema["ids"].dataType)
               for x, y in ((False, qp), (True, vp))]
        return packs.select(tile.cast("int").alias("tile"), F.lit(vectors).alias("vectors"),
                            ids[0].alias("q_ids"), ids[1].alias("v_ids"), "numbers")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    both = (tiles(qp.select("*", each(shards).alias("o")), F.col("piece") * shards + F.col("o"), False)
            .unionByName(tiles(vp.select("*", each(blocks).alias("o")), F.col("o") * shards + F.col("piece"), True)))

    def run(batches):
        now, top, asked, id_types = None, None, [], None
        held, size = [], 0                      # packs that wait to meet the queries together

        def meet():
            nonlocal top, held, size
            if held:
                if top is None:
                    top = _TopK(*map(np.concatenate, zip(*asked)), k, exclude_self, tie_digits)
                    asked.clear()
                ids, m = map(np.concatenate, zip(*held))
                held, size = [], 0
                top.add_all(ids, m)

        for batch in batches:
            id_types = [batch.column(c).type.value_type for c in ("q_ids", "v_ids")]
            for i, (tile, vectors) in enumerate(zip(batch.column("tile").to_pylist(),
                                                    batch.column("vectors").to_pylist())):
                if tile != now:
                    meet()
                    if top is not None:
                        yield from _hits_of(top, id_types)
                    now, top, asked = tile, None, []
                ids = _ids(batch.column("v_ids" if vectors else "q_ids")[i].values)
                m = np.frombuffer(batch.column("numbers")[i].as_buffer(), kinds[vectors]).reshape(len(ids), -1)
                if not vectors:                 # they come first
                    asked.append((ids, np.array(m)))
                elif asked or top is not None:
                    held.append((ids, np.array(m)))
                    size += m.size
                    if size >= TILE_FLOATS:
                        meet()
        meet()
        if top is not None:
            yield from _hits_of(top, id_types)

    # a partition is a tile, so no task gets several while others get none
    return (both.repartitionById(blocks * shards, "tile").sortWithinPartitions("tile", "vectors")
            .mapInArrow(run, out_schema))


def _hits_of(top: _TopK, id_types: list):
    out = top.result()
    if out is not None:
        yield pa.RecordBatch.from_arrays([out.column(0).cast(id_types[0]), out.column(1).cast(id_types[1]),
                                          *out.columns[2:]], names=out.schema.names)


def _packed(rows: DataFrame, pieces: int, kind: str, copies: int | None = None) -> DataFrame:
    """``piece, ids, numbers``: rows of (id, vector) dealt to ``pieces`` by the hash of their id,
    up to ``PACK_ROWS`` of one piece together, their numbers as one matrix of ``kind``.  Of
    equal vectors in a pack no more than ``copies`` are kept, those of the smallest ids."""
    name, vec = rows.columns
    schema = T.StructType([T.StructField("piece", T.IntegerType()),
                           T.StructField("ids", T.ArrayType(rows.schema[name].dataType)),
                           T.StructField("numbers", T.BinaryType())])

    def packs(held):
        table = pa.Table.from_batches(held).combine_chunks()
        m = np.ascontiguousarray(_arrow_matrix(table.column(1)), dtype=kind)
        piece = table.column(2).to_numpy()
        for p in np.unique(piece):
            of = np.flatnonzero(piece == p)
            for s in range(0, len(of), PACK_ROWS):
                at = of[s:s + PACK_ROWS]
                ids = table.column(0).take(pa.array(at)).combine_chunks()
                if copies is not None and len(at) > copies and not ids.null_count:
                    keep = _first_copies(m[at], _ids(ids), copies)
                    at, ids = at[keep], ids.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), ids),
                     pa.array([m[at].tobytes()], pa.binary())], schema.names)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= PACK_BYTES:
                yield from packs(held)
                held, size = [], 0
        if held:
            yield from packs(held)

    piece = F.pmod(F.xxhash64(name), F.lit(pieces)).cast("int")
    return rows.select(name, vec, piece.alias("piece")).mapInArrow(run, schema)


def _first_copies(m: np.ndarray, ids: np.ndarray, copies: int) -> np.ndarray:
    """Row numbers of ``m`` without those that equal ``copies`` or more rows of smaller ids."""
    if not m.shape[1]:
        return np.arange(len(m))
    whole = np.ascontiguousarray(m).view(np.dtype((np.void, m.dtype.itemsize * m.shape[1]))).ravel()
    _, group, count = np.unique(whole, return_inverse=True, return_counts=True)
    keep = count[group] <= copies
    at = np.flatnonzero(~keep)
    if len(at):
        at = at[np.lexsort((ids[at], group[at]))]
        pos = np.arange(len(at)) - np.searchsorted(group[at], group[at])
        keep[at[pos < copies]] = True
    return np.flatnonzero(keep)


def with_similarity(hits: DataFrame, distance: str = "distance") -> DataFrame:
    """``similarity = 1 / (1 + distance)``."""
    return hits.withColumn("similarity", F.lit(1.0) / (F.lit(1.0) + F.col(distance)))


def hit_metadata(hits: DataFrame, metadata: DataFrame, vec_id: str = "vec_id",
                 n_vectors: int | None = None) -> DataFrame:
    """Attach each hit's metadata row (equi-join on the vector id).

    Ids outside ``[0, n_vectors)`` are dropped, as the reference drops
    positions outside its metadata list.
    """
    out = hits.join(metadata, on=vec_id, how="inner")
    if n_vectors is not None:
        out = out.filter((F.col(vec_id) >= 0) & (F.col(vec_id) < n_vectors))
    return out


# ---------------------------------------------------------------------------
# approximate search: IVF (k-means cells, probe the nprobe nearest cells)
# ---------------------------------------------------------------------------

MAX_CELLS_BYTES = 64 << 20       # centroid matrix must fit a broadcast


def default_cells(n_vectors: int, dim: int) -> int:
    """``sqrt(n)`` cells, or as many as ``MAX_CELLS_BYTES`` of centroids hold
    (cells are then larger and cut into more tiles)."""
    room = MAX_CELLS_BYTES // (8 * max(dim, 1))
    return max(1, min(int(round(math.sqrt(max(n_vectors, 1)))), room))


def train_cells(vectors: DataFrame, n_cells: int, vector: str = "embedding",
                seed: int = 7, max_iter: int = 20) -> np.ndarray:
    """Centroids of MLlib k-means (k-means|| init) over the vector table."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    feats = vectors.select(array_to_vector(F.col(vector)).alias("features"))
    model = KMeans(k=n_cells, seed=seed, maxIter=max_iter, featuresCol="features").fit(feats)
    return np.asarray(model.clusterCenters(), dtype=np.float64)


def nearest_cells(df: DataFrame, centers: np.ndarray, nprobe: int, id_col: str,
                  vector: str) -> DataFrame:
    """(id, vector, cell, cell_rank) for the ``nprobe`` nearest centroids.

    The centroid matrix is broadcast; its size is bounded by ``n_cells``
    and checked against ``MAX_CELLS_BYTES``.
    """
    if centers.nbytes > MAX_CELLS_BYTES:
        raise ValueError("centroid matrix too large to broadcast; use fewer cells")
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast(centers)
    nprobe = min(nprobe, len(centers))
    src = df.select(F.col(id_col).alias("_id"), F.col(vector).alias("_v"))
    out_schema = T.StructType([
        T.StructField("_id", src.schema["_id"].dataType),
        T.StructField("_v", src.schema["_v"].dataType),
        T.StructField("cell", T.IntegerType()), T.StructField("cell_rank", T.IntegerType())])

    def run(batches):
        c = bc.value
        cn = np.einsum("ij,ij->i", c, c)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column(0)
            vecs = batch.column(1)
            m = _arrow_matrix(vecs).astype(np.float64)
            order = np.empty((len(m), nprobe), dtype=np.int64)
            step = max(1, _BLOCK_CELLS // len(c))
            for s in range(0, len(m), step):
                # |m|^2 is the same for all cells of a row
                d = cn[None, :] - 2.0 * (m[s:s + step] @ c.T)
                order[s:s + step] = np.argsort(d, axis=1, kind="stable")[:, :nprobe]
            rows = np.repeat(np.arange(len(m)), nprobe)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [ids.take(take), vecs.take(take), pa.array(order.reshape(-1).astype(np.int32)),
                 pa.array(np.tile(np.arange(1, nprobe + 1, dtype=np.int32), len(m)))],
                schema=pa.schema([pa.field("_id", ids.type), pa.field("_v", vecs.type),
                                  pa.field("cell", pa.int32()), pa.field("cell_rank", pa.int32())]))

    return src.mapInArrow(run, out_schema)


def knn_approx(queries: DataFrame, vectors: DataFrame, k: int = 5, *,
               n_cells: int | None = None, nprobe: int = 4,
               query_id: str = "query_id", query_vector: str = "embedding",
               vec_id: str = "vec_id", vector: str = "embedding",
               exclude_self: bool = False, shard_vectors: int = DEFAULT_SHARD_VECTORS,
               centers: np.ndarray | None = None, seed: int = 7) -> DataFrame:
    """Approximate top-k (squared L2) through an IVF index.

    Vectors are assigned to their nearest k-means cell; each query probes
    its ``nprobe`` nearest cells (``nprobe`` plays the role of an HNSW
    ``efSearch``: higher = better recall, more work; ``nprobe = n_cells`` is
    exact).  The probe is an equi-join on (cell, shard): a cell larger than
    ``shard_vectors`` is split into hash shards and its queries copied to
    each shard, so a crowded cell never lands in one task.
    """
    if k < 0:
        raise ValueError(f"k must be non-negative, got {k}")
    spark = queries.sparkSession
    if centers is None:
        if not n_cells:
            size = vectors.agg(F.count(vector).alias("n"), F.max(F.size(vector)).alias("d")).first()
            n_cells = default_cells(size["n"], size["d"] or 1)
        centers = train_cells(vectors.filter(F.col(vector).isNotNull()), n_cells, vector, seed)
    vcell = nearest_cells(vectors.filter(F.col(vector).isNotNull()), centers, 1, vec_id, vector)
    qcell = nearest_cells(queries.filter(F.col(query_vector).isNotNull()), centers, nprobe,
                          query_id, query_vector)
    return _probe_cells(vcell.select("_id", "_v", "cell"), qcell, k, exclude_self,
                        shard_vectors)


def _probe_cells(vcell: DataFrame, qcell: DataFrame, k: int, exclude_self: bool,
                 shard_vectors: int, query_block: int = DEFAULT_QUERY_BLOCK) -> DataFrame:
    """Exact top-k of each query over the vectors of its probed cells.

    ``vcell``: _id, _v, cell (one row per vector); ``qcell``: _id, _v, cell
    (one row per probed cell of a query).  Vectors of unprobed cells are
    dropped by a semi-join on the probed cell ids first (on a table
    partitioned by cell this prunes whole partitions).  A cell is cut into
    tiles of about ``shard_vectors`` vectors by ``query_block`` queries, so
    neither a crowded nor a popular cell becomes one task.
    """
    spark = qcell.sparkSession
    probed = qcell.select("cell").distinct()
    vcell = vcell.join(probed, "cell", "left_semi")
    qid_type, vid_type = qcell.schema["_id"].dataType, vcell.schema["_id"].dataType
    if k == 0:
        return _empty_hits(spark, qid_type, vid_type)

    def pieces(rows: DataFrame, size: int, out: str) -> DataFrame:
        return rows.groupBy("cell").agg(
            F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias(out))

    # one row per probed cell
    grid = pieces(vcell, shard_vectors, "_nv").join(pieces(qcell, query_block, "_nq"), "cell")

    def tiles(rows: DataFrame, own: str, other: str, id_name: str, vec_name: str) -> DataFrame:
        j = rows.join(grid, "cell")
        return j.select(F.col("_id").alias(id_name), F.col("_v").alias(vec_name), "cell",
                        F.pmod(F.xxhash64("_id"), F.col(own)).cast("int").alias(own[1:]),
                        F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[1:]))

    # key columns in one order and of one type on both cogroup sides
    keys = ["cell", "nv", "nq"]
    vt = tiles(vcell, "_nv", "_nq", "vec_id", "vv").select("vec_id", "vv", *keys)
    qt = tiles(qcell, "_nq", "_nv", "query_id", "qv").select("query_id", "qv", *keys)
    cands = (vt.groupBy(*keys).cogroup(qt.groupBy(*keys))
             .applyInPandas(_tile(k, exclude_self), _cand_schema(qid_type, vid_type)))
    return _final_topk(cands, k)


# --- persisted IVF index ------------------------------------------------------

def build_ivf_index(vectors: DataFrame, path: str, n_cells: int, *,
                    vec_id: str = "vec_id", vector: str = "embedding",
                    seed: int = 7) -> None:
    """Train cells and write ``<path>/vectors`` partitioned by ``cell`` plus
    ``<path>/centers`` (one row per cell)."""
    spark = vectors.sparkSession
    src = vectors.filter(F.col(vector).isNotNull())
    centers = train_cells(src, n_cells, vector, seed)
    assigned = nearest_cells(src, centers, 1, vec_id, vector)
    (assigned.select(F.col("_id").alias(vec_id), F.col("_v").alias(vector), "cell")
     .write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors"))
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
    spark.createDataFrame(rows, "cell int, centroid array<double>") \
        .write.mode("overwrite").parquet(f"{path}/centers")


def search_ivf_index(spark, path: str, queries: DataFrame, k: int = 5, *, nprobe: int = 4,
                     query_id: str = "query_id", query_vector: str = "embedding",
                     vec_id: str = "vec_id", vector: str = "embedding",
                     exclude_self: bool = False,
                     shard_vectors: int = DEFAULT_SHARD_VECTORS) -> DataFrame:
    """Search a persisted IVF index; only the probed cells' files are read
    (the semi-join on probed cells prunes the ``cell`` partitions)."""
    if k < 0:
        raise ValueError(f"k must be non-negative, got {k}")
    cdf = spark.read.parquet(f"{path}/centers").orderBy("cell")
    size = cdf.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("centroid")).alias("d")).first()
    if (size["n"] or 0) * (size["d"] or 0) * 8 > MAX_CELLS_BYTES:
        raise ValueError("centroid table too large to broadcast; use fewer cells")
    centers = np.asarray([r.centroid for r in cdf.collect()], dtype=np.float64)
    qcell = nearest_cells(queries.filter(F.col(query_vector).isNotNull()), centers, nprobe,
                          query_id, query_vector).persist(StorageLevel.MEMORY_AND_DISK)
    # the probed cell ids are at most n_cells values: used as a static
    # partition filter, so unprobed cells' files are never listed or read
    cells = sorted(r.cell for r in qcell.select("cell").distinct().collect())
    vcell = (spark.read.parquet(f"{path}/vectors").filter(F.col("cell").isin(cells))
             .select(F.col(vec_id).alias("_id"), F.col(vector).alias("_v"),
                     F.col("cell").cast("int")))
    return _probe_cells(vcell, qcell, k, exclude_self, shard_vectors)


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact (query, vec) hits that the approximate search found."""
    j = exact.select("query_id", "vec_id").join(
        approx.select("query_id", "vec_id", F.lit(1).alias("_f")), ["query_id", "vec_id"], "left")
    return j.agg(F.avg(F.coalesce("_f", F.lit(0)).cast("double")).alias("recall"))
