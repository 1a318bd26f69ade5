"""Approximate search over navigable neighbour graphs, one for each cell.

*Build*: vectors are assigned to cells (k-means centroids of a bounded sample), a
cell of more than ``cell_size`` vectors is dealt in parts by hash.  In each part,
a bounded group, every vector is tied to its nearest ones, thinned so that no edge
is kept which a kept edge already points along (a neighbour nearer to a kept
neighbour than to the vector itself goes), and back edges are added.  The result is
one table: ``cell, part, node, id, vector, neighbours``, plus a row for each cell
(``node = -1``) with its centroid.

*Search*: each query goes to its ``nprobe`` nearest cells.  In a part, a block of
queries walks the graph together: each keeps a beam of the ``beam`` nearest nodes
seen, and every round joins the nearest unexpanded nodes of the beam with their
adjacency rows, measures the neighbours not yet seen and merges them, until the
whole beam is expanded or ``rounds`` are over.  Work per query follows the beam, not
the number of vectors.  A part's queries are dealt in blocks of ``query_block``, so
neither a crowded cell nor a popular one becomes one task.

``recall_at_k`` of ``skein.operators.knn`` measures what the beam misses.
``knn_bounded`` searches the same table exactly, past the cells and members that the
triangle inequality rules out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.knn import (MAX_CELLS_BYTES, _empty_hits, nearest_cells, train_cells)

CELL_SIZE = 2048            # vectors in one graph
DEGREE = 16                 # neighbours kept before back edges; twice that with them
ALPHA = 1.2                 # > 1 keeps some longer edges
BEAM = 32
NPROBE = 8
EXPAND = 4                  # beam nodes expanded in one round
ROUNDS = 64
ENTRIES = 24                # first nodes of a walk, spread over the part
QUERY_BLOCK = 512
MAX_SAMPLE = 100_000        # documented bound of the rows that train the centroids


# --- one part's graph -------------------------------------------------------------

def neighbour_lists(m: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Thinned nearest neighbours of each row of ``m``, with back edges."""
    n = len(m)
    if n <= 1:
        return [np.empty(0, np.int32)] * n
    x = m.astype(np.float32)
    norm = np.einsum("ij,ij->i", x, x)
    d = norm[:, None] + norm[None, :] - 2 * (x @ x.T)
    np.fill_diagonal(d, np.inf)
    near = min(n - 1, 3 * degree)
    cand = np.argpartition(d, near - 1, axis=1)[:, :near]
    rows = np.arange(n)[:, None]
    cand = np.take_along_axis(cand, np.argsort(d[rows, cand], axis=1, kind="stable"), 1)
    kept = np.full((n, degree), -1, np.int64)
    count = np.zeros(n, np.int64)
    every = np.arange(n)
    for j in range(near):
        c = cand[:, j]
        own = d[every, c]
        open_ = count < degree
        for s in range(int(count.max())):       # against those kept before
            held = kept[:, s]
            other = d[np.maximum(held, 0), c]
            open_ &= (held < 0) | (alpha * other > own)
        at = np.flatnonzero(open_)
        kept[at, count[at]] = c[at]
        count[at] += 1
    src = np.repeat(every, degree)[(kept >= 0).ravel()]
    dst = kept[kept >= 0]
    edges = np.unique(np.concatenate([src * n + dst, dst * n + src]))
    a, b = edges // n, edges % n
    order = np.lexsort((d[a, b], a))            # nearest first, at most twice the degree
    a, b = a[order], b[order]
    starts = np.searchsorted(a, np.arange(n + 1))
    return [b[s:min(e, s + 2 * degree)].astype(np.int32) for s, e in zip(starts, starts[1:])]


def walk(m: np.ndarray, links: np.ndarray, q: np.ndarray, beam: int, expand: int = EXPAND,
         rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Beam search of the queries ``q`` over one graph: node numbers and squared
    distances (-1, inf where there are fewer), and distances measured.

    ``links`` is the adjacency, padded with -1."""
    n, b = len(m), len(q)
    x, y = m.astype(np.float32), q.astype(np.float32)
    xn, yn = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True                           # the padding
    links = np.where(links < 0, n, links)
    width = min(beam, n)
    first = np.unique(np.linspace(0, n - 1, min(n, max(ENTRIES, 1))).astype(np.int64))
    seen[:, first] = True
    ids = np.full((b, width), n, np.int64)
    dist = np.full((b, width), np.inf, np.float32)
    done = np.ones((b, width), bool)
    measured = np.full(b, len(first))

    def merge(rows, new_ids, new_dist):
        """The ``width`` nearest of the beams ``rows`` and the new nodes."""
        i = np.concatenate([ids[rows], new_ids], 1)
        d = np.concatenate([dist[rows], new_dist], 1)
        e = np.concatenate([done[rows], ~np.isfinite(new_dist)], 1)
        at = np.argpartition(d, width - 1, axis=1)[:, :width]
        ids[rows], dist[rows], done[rows] = (np.take_along_axis(v, at, 1) for v in (i, d, e))

    every = np.arange(b)
    merge(every, np.broadcast_to(first, (b, len(first))), yn[:, None] + xn[first][None, :] - 2 * (y @ x[first].T))
    for _ in range(rounds):
        live = np.flatnonzero(~done.all(1))
        if not len(live):
            break
        open_ = np.where(done[live], np.inf, dist[live])
        k = min(expand, width)
        at = np.argpartition(open_, k - 1, axis=1)[:, :k]
        real = np.isfinite(np.take_along_axis(open_, at, 1))
        nodes = np.where(real, np.take_along_axis(ids[live], at, 1), n)
        flags = done[live]
        np.put_along_axis(flags, at, True, 1)
        done[live] = flags
        found = np.where(nodes[:, :, None] < n, links[np.minimum(nodes, n - 1)], n).reshape(len(live), -1)
        found.sort(axis=1)                      # a node met twice counts once
        found[:, 1:][found[:, 1:] == found[:, :-1]] = n
        fresh = ~seen[live[:, None], found]
        r, c = np.nonzero(fresh)
        hit = found[r, c]
        seen[live[r], hit] = True
        measured[live] += fresh.sum(1)
        got = np.full(found.shape, np.inf, np.float32)
        who = live[r]
        got[r, c] = yn[who] + xn[hit] - 2 * np.einsum("ij,ij->i", y[who], x[hit])
        most = int(fresh.sum(1).max(initial=0))
        if most:
            keep = np.argsort(~fresh, axis=1, kind="stable")[:, :most]
            merge(live, np.take_along_axis(found, keep, 1), np.take_along_axis(got, keep, 1))
    ids[~np.isfinite(dist)] = -1
    return ids, dist, measured


# --- the index table -----------------------------------------------------------------

def _index_schema(ids: T.StructField, vectors: T.StructField) -> T.StructType:
    return T.StructType([
        T.StructField("cell", T.IntegerType()), T.StructField("part", T.IntegerType()),
        T.StructField("node", T.IntegerType()), T.StructField("id", ids.dataType),
        T.StructField("vector", vectors.dataType), T.StructField("neighbours", T.ArrayType(T.IntegerType()))])


def graph_index(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding",
                cell_size: int = CELL_SIZE, degree: int = DEGREE, seed: int = 7) -> DataFrame:
    """The index table of all non-null ``vectors``; write it before searching it."""
    src = vectors.select(F.col(vec_id).alias("_id"), F.col(vector).alias("_v")).where("_v is not null")
    schema = _index_schema(src.schema["_id"], src.schema["_v"])
    spark = vectors.sparkSession
    size = src.agg(F.count("*").alias("n"), F.max(F.size("_v")).alias("d"), F.min(F.size("_v")).alias("d0")).first()
    if not size["n"]:
        return spark.createDataFrame([], schema)
    if size["d"] != size["d0"]:
        raise ValueError("vectors of different lengths in one column")
    cells = max(1, min(-(-size["n"] // cell_size), MAX_CELLS_BYTES // (8 * max(size["d"], 1))))
    if cells == 1:
        centers = np.zeros((1, size["d"]))
    else:
        share = MAX_SAMPLE / size["n"]
        sample = src if share >= 1 else src.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
        centers = train_cells(sample, cells, "_v", seed, max_iter=8)
    assigned = nearest_cells(src, centers, 1, "_id", "_v")
    many = assigned.groupBy(F.col("cell").alias("_c")).agg(
        F.ceil(F.count("*") / F.lit(cell_size)).cast("int").alias("_p"))
    dealt = assigned.join(F.broadcast(many), F.col("cell") == F.col("_c")).select(
        "_id", "_v", "cell", F.pmod(F.xxhash64("_id", F.lit(seed)), "_p").cast("int").alias("part"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id", kind="stable")
        lists = neighbour_lists(np.stack(pdf["_v"].to_numpy()), degree)
        return pd.DataFrame({"cell": pdf["cell"], "part": pdf["part"], "node": np.arange(len(pdf), dtype=np.int32),
                             "id": pdf["_id"], "vector": pdf["_v"], "neighbours": lists})
    nodes = dealt.groupBy("cell", "part").applyInPandas(build, schema)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centers)]
    heads = spark.createDataFrame(rows, "cell int, vector array<double>").select(
        "cell", F.lit(0).alias("part"), F.lit(-1).alias("node"), F.lit(None).cast(src.schema["_id"].dataType).alias("id"),
        F.col("vector").cast(src.schema["_v"].dataType).alias("vector"),
        F.array().cast("array<int>").alias("neighbours"))
    return nodes.unionByName(heads)


def tiles(nodes: DataFrame, routed: DataFrame, query_block: int, *carry: str) -> tuple[DataFrame, DataFrame]:
    """The nodes of every part asked and the queries that ask it, dealt to
    ``cell, part, block``.  ``routed``: ``query_id, qv, cell`` and ``carry``."""
    # a small row for each part and each cell asked: how many blocks meet
    parts = nodes.groupBy(F.col("cell").alias("_c"), F.col("part").alias("_p")).agg(F.lit(1).alias("_x"))
    asked = routed.groupBy(F.col("cell").alias("_c")).agg(
        F.ceil(F.count("*") / F.lit(query_block)).cast("int").alias("_b"))
    grid = F.broadcast(parts.join(asked, "_c").select("_c", "_p", "_b"))
    block = F.pmod(F.xxhash64("query_id"), F.col("_b")).cast("int").alias("block")
    qt = routed.join(grid, F.col("cell") == F.col("_c")).select(
        "query_id", "qv", *carry, "cell", F.col("_p").alias("part"), block)
    own = [c for c in nodes.columns if c not in ("cell", "part")]
    vt = nodes.join(grid, (F.col("cell") == F.col("_c")) & (F.col("part") == F.col("_p"))).select(
        *own, "cell", "part", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("block"))
    return vt, qt


def search_graph(queries: DataFrame, index: DataFrame, k: int = 5, *, beam: int = BEAM, nprobe: int = NPROBE,
                 query_id: str = "query_id", query_vector: str = "embedding", exclude_self: bool = False,
                 query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, vec_id, rank, distance, scanned``: approximate top-k by squared
    L2 over a stored ``graph_index``; ``scanned`` is the number of distances that
    the query measured in all its cells.

    Distances of what is returned are exact (double precision); ties go to the
    smaller id.  ``k < 0`` raises; ``k = 0`` or an empty side gives no rows."""
    if k < 0:
        raise ValueError(f"k must be non-negative, got {k}")
    spark = queries.sparkSession
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("qv")).where("qv is not null")
    heads = index.where("node = -1").select("cell", "vector").orderBy("cell").collect()
    qid_type, vid_type = q.schema["query_id"].dataType, index.schema["id"].dataType
    if k == 0 or not heads:
        return _empty_hits(spark, qid_type, vid_type).withColumn("scanned", F.lit(0).cast("long"))
    centers = np.array([r["vector"] for r in heads], np.float64)
    routed = nearest_cells(q, centers, nprobe, "query_id", "qv").select(
        F.col("_id").alias("query_id"), F.col("_v").alias("qv"), "cell")
    vt, qt = tiles(index.where("node >= 0"), routed, query_block)
    schema = T.StructType([T.StructField("query_id", qid_type), T.StructField("vec_id", vid_type),
                           T.StructField("distance", T.DoubleType()), T.StructField("scanned", T.LongType())])
    want = k + 1 if exclude_self else k

    def run(vpdf: pd.DataFrame, qpdf: pd.DataFrame) -> pd.DataFrame:
        if not len(vpdf) or not len(qpdf):
            return pd.DataFrame(columns=schema.names, dtype=object)
        vpdf = vpdf.sort_values("node")
        m, asked = np.stack(vpdf["vector"].to_numpy()), np.stack(qpdf["qv"].to_numpy())
        if m.shape[1] != asked.shape[1]:
            raise ValueError(f"vector dimension {m.shape[1]} differs from query dimension {asked.shape[1]}")
        wide = max(1, max(map(len, vpdf["neighbours"])))
        links = np.full((len(m), wide), -1, np.int64)
        for i, own in enumerate(vpdf["neighbours"]):
            links[i, :len(own)] = own
        found, _, measured = walk(m, links, asked, max(beam, want))
        r, c = np.nonzero(found >= 0)
        node = found[r, c]
        q_ids, v_ids = qpdf["query_id"].to_numpy(), vpdf["id"].to_numpy()
        if exclude_self:
            other = q_ids[r] != v_ids[node]
            r, node = r[other], node[other]
        exact = np.square(asked[r].astype(np.float64) - m[node].astype(np.float64)).sum(1)
        order = np.lexsort((v_ids[node], exact, r))
        r, node, exact = r[order], node[order], exact[order]
        pos = np.arange(len(r)) - np.searchsorted(r, np.arange(len(q_ids)))[r]
        r, node, exact = r[pos < k], node[pos < k], exact[pos < k]
        return pd.DataFrame({"query_id": q_ids[r], "vec_id": v_ids[node], "distance": exact,
                             "scanned": np.where(pos[pos < k] == 0, measured[r], 0)})
    keys = ["cell", "part", "block"]
    cands = vt.groupBy(*keys).cogroup(qt.groupBy(*keys)).applyInPandas(run, schema)
    # a query has at most k candidates from each part that it asked
    got = cands.groupBy("query_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("distance", "vec_id"))), 1, k).alias("h"),
        F.sum("scanned").alias("scanned"))
    return got.select("query_id", F.posexplode("h").alias("pos", "h"), "scanned").select(
        "query_id", F.col("h.vec_id").alias("vec_id"), (F.col("pos") + 1).alias("rank"),
        F.col("h.distance").alias("distance"), "scanned")


# --- exact search with bounds ------------------------------------------------------------

GROUP_VECTORS = 16_384      # vectors of one tile: a group of neighbouring cells
BOUND_BLOCK = 16_384        # queries of one tile
_SLICE = 256                # queries measured against all centroids at once


def cell_groups(centers: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """A group for each cell: runs of about ``most`` vectors along the direction in
    which the centroids differ most."""
    off = centers - centers.mean(0)
    order = np.argsort(off @ np.linalg.eigh(off.T @ off)[1][:, -1], kind="stable")
    before = np.cumsum(sizes[order]) - sizes[order]
    group = np.empty(len(centers), np.int64)
    group[order] = before // max(1, most)
    return np.unique(group, return_inverse=True)[1].astype(np.int32)


def knn_bounded(queries: DataFrame, index: DataFrame, k: int = 5, *, query_id: str = "query_id",
                query_vector: str = "embedding", exclude_self: bool = False, query_block: int = BOUND_BLOCK,
                tie_digits: int | None = None, group_vectors: int = GROUP_VECTORS) -> tuple[DataFrame, DataFrame]:
    """Exact top-k over a stored ``graph_index`` that skips what cannot win.

    A query first measures its nearest cell; the k-th distance found bounds the rest.
    By the triangle inequality a cell whose sphere (centroid, largest distance of a
    member) lies beyond that distance holds no better vector: it is never met by
    this query; inside a cell, vectors go whose distance from the centroid differs from
    the query's by more.  Cells of one query are met in two rounds, so that the
    bound of the first prunes all others.

    Cells are small, so queries are not copied to each of them: neighbouring cells form
    groups of about ``group_vectors`` vectors, queries blocks of about ``query_block``
    with their nearest cells in one group, and a tile is a block and a group that one of
    its queries reaches.  Where nothing can be ruled out, that is the tiled plan of
    ``knn_exact``, with as many copies of a row as there are tiles on the other side.

    Returns the hits (``query_id, vec_id, rank, distance``) and, per query, how many
    vectors it ``measured``.  Ranks, ties and edge cases are those of ``knn_exact``."""
    from skein.operators.knn import _final_topk, _TopK
    from skein.session import write_shared
    if k < 0:
        raise ValueError(f"k must be non-negative, got {k}")
    spark = queries.sparkSession
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("qv")).where("qv is not null")
    heads = index.where("node = -1").select("cell", "vector").orderBy("cell").collect()
    qid_type, vid_type = q.schema["query_id"].dataType, index.schema["id"].dataType
    none = q.select("query_id", F.lit(0).cast("long").alias("measured")).limit(0)
    if k == 0 or not heads:
        return _empty_hits(spark, qid_type, vid_type), none
    centers = np.array([r["vector"] for r in heads], np.float64)
    shared = spark.sparkContext.broadcast(centers)          # bounded by MAX_CELLS_BYTES
    far_schema = T.StructType([*index.schema, T.StructField("far", T.DoubleType())])

    def from_center(batches):
        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.stack(batch.column("vector").to_numpy(zero_copy_only=False)).astype(np.float64)
            c = shared.value[batch.column("cell").to_numpy()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.sqrt(np.square(m - c).sum(1)))],
                                             far_schema.names)
    nodes = (index.where("node >= 0").mapInArrow(from_center, far_schema)
             .select("id", "vector", "far", "cell"))
    nodes = write_shared(nodes, "bounded")
    # one row a cell: its radius, how near the centroid its nearest member is, its members
    radius = {r["cell"]: (r["low"], r["high"], r["n"]) for r in nodes.groupBy("cell").agg(
        F.min("far").alias("low"), F.max("far").alias("high"), F.count("*").alias("n")).collect()}
    spheres = np.array([radius.get(i, (np.inf, -np.inf, 0)) for i in range(len(centers))])
    held = spheres[:, 2].sum()
    most = int(max(1, min(group_vectors, -(-held // (2 * spark.sparkContext.defaultParallelism)))))
    group_of = cell_groups(centers, spheres[:, 2], most)
    # a group holds more only where one cell does; it is cut in pieces by hash
    pieces = np.maximum(1, np.ceil(np.bincount(group_of, spheres[:, 2]) / group_vectors)).astype(int)
    slack = 1e-6

    def reaches(m: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance of some queries from each centroid, and whether its sphere is within ``bound``."""
        c = shared.value
        d = np.sqrt(np.maximum(np.square(m).sum(1)[:, None] + np.square(c).sum(1)[None] - 2 * m @ c.T, 0))
        return d, np.maximum(d - spheres[None, :, 1], spheres[None, :, 0] - d) <= bound[:, None] + slack

    schema = T.StructType([T.StructField("query_id", qid_type), T.StructField("vec_id", vid_type),
                           T.StructField("distance", T.DoubleType()), T.StructField("key", T.DoubleType()),
                           T.StructField("measured", T.LongType())])

    def tile(first_round: bool):
        def run(vpdf: pd.DataFrame, qpdf: pd.DataFrame) -> pd.DataFrame:
            empty = pd.DataFrame(columns=schema.names, dtype=object)
            if not len(vpdf) or not len(qpdf):
                return empty
            vpdf = vpdf.sort_values(["cell", "far"])
            far, m, v_ids = vpdf["far"].to_numpy(), np.stack(vpdf["vector"].to_numpy()), vpdf["id"].to_numpy()
            cells, starts = np.unique(vpdf["cell"].to_numpy(), return_index=True)
            asked = np.stack(qpdf["qv"].to_numpy()).astype(np.float64)
            q_ids, home, bound = (qpdf[c].to_numpy() for c in ("query_id", "home", "bound"))
            bound = bound.astype(float)
            top = _TopK(q_ids, asked, k, exclude_self, tie_digits, np.square(bound + slack))
            measured = np.zeros(len(q_ids), np.int64)
            for cell, s, e in zip(cells, starts, np.append(starts[1:], len(far))):
                rows = np.flatnonzero(home == cell if first_round else home != cell)
                if not len(rows):
                    continue
                # what the k-th found so far still leaves of the cell
                left = np.minimum(bound[rows], np.sqrt(top.kth[rows] + top.gap))
                c = shared.value[cell]
                own = np.sqrt(np.maximum(top.q_norm[rows] + c @ c - 2 * (top.q[rows] @ c), 0))
                # queries with like bounds share one slice of the members, sorted by distance
                first = s + np.searchsorted(far[s:e], own - left - slack, "left")
                last = s + np.searchsorted(far[s:e], own + left + slack, "right")
                some = last > first
                rows, first, last = rows[some], first[some], last[some]
                order = np.argsort(first, kind="stable")
                step = max(64, len(rows) // 4)
                for at in range(0, len(order), step):
                    mine = order[at:at + step]
                    a, b = int(first[mine].min()), int(last[mine].max())
                    width = max(64, 4_000_000 // len(mine))
                    for x in range(a, b, width):
                        top.add(v_ids[x:min(b, x + width)], m[x:min(b, x + width)], rows[mine])
                    measured[rows[mine]] += b - a
            # a row of its own for each query that measured something
            tried = np.flatnonzero(measured)
            counts = pd.DataFrame({"query_id": q_ids[tried], "vec_id": None, "distance": np.nan, "key": np.nan,
                                   "measured": measured[tried]})
            got = top.result()
            if got is None:
                return counts
            found = pd.DataFrame({c: got.column(c).to_numpy(zero_copy_only=False) for c in got.schema.names})
            return pd.concat([found.assign(measured=0), counts], ignore_index=True)
        return run

    q = write_shared(q, "queries")
    near = nearest_cells(q, centers, 1, "query_id", "qv").select(
        F.col("_id").alias("query_id"), F.col("_v").alias("qv"), F.col("cell").alias("home"))
    near = write_shared(near, "near")
    asked = {r["home"]: r["n"] for r in near.groupBy("home").agg(F.count("*").alias("n")).collect()}
    of = np.bincount(group_of, [asked.get(i, 0) for i in range(len(centers))])
    cuts = np.maximum(1, np.ceil(of / query_block)).astype(int)
    base = np.cumsum(cuts) - cuts                    # blocks are numbered by group
    asked_schema = T.StructType([near.schema["query_id"], near.schema["qv"], near.schema["home"],
                                 T.StructField("bound", T.DoubleType()), T.StructField("group", T.IntegerType()),
                                 T.StructField("groups", T.ArrayType(T.IntegerType()))])

    def routes(first_round: bool):
        def run(batches):
            import pyarrow as pa
            for batch in batches:
                home = batch.column("home").to_numpy()
                bound = np.asarray(batch.column("bound"), float)
                own = group_of[home].astype(np.int32)
                groups = [[int(g)] for g in own]
                if not first_round:
                    groups = []
                    for at in range(0, batch.num_rows, _SLICE):
                        m = np.stack(batch.column("qv").slice(at, _SLICE).to_numpy(zero_copy_only=False)).astype(np.float64)
                        reach = reaches(m, bound[at:at + _SLICE])[1]
                        reach[np.arange(len(m)), home[at:at + _SLICE]] = False
                        groups += [np.unique(group_of[r]) for r in reach]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in ("query_id", "qv", "home")], pa.array(bound), pa.array(own),
                     pa.array(groups, pa.list_(pa.int32()))], asked_schema.names)
        return run

    def met(rows: DataFrame, first_round: bool) -> DataFrame:
        """``rows``: query_id, qv, home, bound."""
        asked = rows.mapInArrow(routes(first_round), asked_schema)
        # small tables: one number for each group
        of_group = spark.createDataFrame([(g, int(base[g]), int(cuts[g]), int(pieces[g])) for g in range(len(base))],
                                         "g int, base int, cuts int, pieces int")
        block = (F.col("base") + F.pmod(F.xxhash64("query_id"), "cuts").cast("int")).alias("block")
        asked = write_shared(asked.join(F.broadcast(of_group), F.col("group") == F.col("g")).select(
            "query_id", "qv", "home", "bound", "groups", block), "asked")
        number = F.broadcast(of_group.select(F.col("g").alias("_g"), F.col("pieces").alias("_n")))
        # no more rows than tiles
        pairs = asked.select(F.col("block").alias("_b"), F.explode("groups").alias("_a")).distinct()
        cell_rows = spark.createDataFrame([(c, int(g)) for c, g in enumerate(group_of)], "_c int, _g int")
        vt = (nodes.join(F.broadcast(cell_rows), F.col("cell") == F.col("_c")).join(number, "_g")
              .select("id", "vector", "far", "cell", F.col("_g").alias("group"),
                      F.pmod(F.xxhash64("id"), "_n").cast("int").alias("piece"))
              .join(F.broadcast(pairs), F.col("group") == F.col("_a"))
              .select("id", "vector", "far", "cell", F.col("_b").alias("block"), "group", "piece"))
        qt = (asked.select("query_id", "qv", "home", "bound", "block", F.explode("groups").alias("group"))
              .join(number, F.col("group") == F.col("_g"))
              .select("query_id", "qv", "home", "bound", "block", "group",
                      F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("piece")))
        keys = ["block", "group", "piece"]
        return vt.groupBy(*keys).cogroup(qt.groupBy(*keys)).applyInPandas(tile(first_round), schema)

    hit = F.col("distance").isNotNull()
    one = write_shared(met(near.withColumn("bound", F.lit(float("inf"))), True), "hits")
    kth = (_final_topk(one.where(hit).select("query_id", "vec_id", "distance", "key"), k).groupBy("query_id")
           .agg(F.when(F.count("*") == k, F.sqrt(F.max("distance"))).alias("kth")))
    step = 10.0 ** -tie_digits if tie_digits is not None else 0.0
    left = near.join(kth, "query_id", "left").select("query_id", "qv", "home", F.sqrt(
        F.pow(F.coalesce("kth", F.lit(float("inf"))), F.lit(2.0)) + F.lit(step)).alias("bound"))
    cands = write_shared(one.unionByName(met(left, False)), "hits")
    return (_final_topk(cands.where(hit).select("query_id", "vec_id", "distance", "key"), k),
            cands.groupBy("query_id").agg(F.sum("measured").alias("measured")))
