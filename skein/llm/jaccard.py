"""N-gram Jaccard join with prefix trees.

Documents whose sets of distinct word 5-grams have a Jaccard similarity of
``T / 100`` or more are linked; ``classes`` returns the connected classes.

1. Equal sets collapse: a set is known by two 64-bit digests of its sorted gram
   hashes, and one *node* stands for all documents that hold it.
2. Grams have one global order, rare first: by a counting sketch, then by hash.
   Every task counts every gram of its sets in a table of ``COUNTERS`` numbers;
   the tables' sum, of the same size for any corpus, is broadcast.  A gram's
   counter is never below its frequency, so hot grams are known and their rows
   dealt in parts.  The order decides how much work there is, never the result.
3. Two linked sets share a gram within their prefixes of
   ``n - ceil(T n / 100) + 1`` grams.  Prefix grams held by one node only are
   dropped, and so are rows too late in their set to be the first gram common
   to a linked pair; what is left are *cells* of nodes that share a gram.
4. Sets of a cell are stored, in the global order with frequent grams first, in
   prefix trees whose paths are shared.  A probe walks a tree carrying partial
   overlaps and leaves a subtree when the grams that remain cannot reach the
   overlap wanted: the sets where it arrives are its links.
5. First each node meets one leader of its cells (that which most of its cells
   name).  Links join nodes into classes, so a large group of near copies needs one
   probe per copy, not one per pair.
6. Then cells of several classes are compared: of their nodes those stay that some
   node of another class can reach by place and size.  In cells of at most ``FEW``
   nodes each probes the tree of its partners of all such cells.  Larger cells, with
   the classes joined so far, meet in families (the cells of one shared passage), each
   with one tree of all their nodes: all but the commonest class probe it, past
   subtrees of their own class, and classes that a link joins count as one from then on.

Skipping pairs inside a class loses no link between classes, so classes are
exact.  Gram collisions of 64-bit hashes are the one approximation; a digest
collision between different sets of one size is found and raises.

Defined results: ids may be of any type that sorts; documents without a word
(null, empty, blank) have an empty set and are their own class; rows with a null
id are not linked and get a null class; rows that repeat an id count as one
document with all their links; repeated rows are equal sets; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T_

from skein.llm.components import components
from skein.llm.memory import trimmed
from skein.session import write_shared

SHINGLE = 5
T = 75
#: counters of the frequency sketch (4 bytes each)
COUNTERS = 1 << 19
#: rows of a hot gram in one part, and sets in one tree
CELL, PART = 1024, 64
#: probes that walk one tree in one group
SLICE = 2048
#: cells of at most so many nodes name each node's partners
FEW = 16
#: gram hashes counted at once, and digests remembered, inside a task
_RUN, _SEEN = 1 << 20, 1 << 20

_WEIGHTS = np.random.default_rng(11).integers(1, 2**63, SHINGLE + 1, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bit mixing of 64-bit sums (the finaliser of a public generator)."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def grams(raw: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word n-grams (A-Z lower-cased, words
    between ASCII white space; a shorter text is one gram)."""
    words = (raw or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64) * _WEIGHTS[size]
    for k in range(width):
        out += h[k:k + n] * _WEIGHTS[k]
    return np.unique(_mixed(out))


def digest(found: np.ndarray) -> tuple[int, int]:
    raw = found.tobytes()
    return (xxhash.xxh64_intdigest(raw, 1) - (1 << 63), xxhash.xxh64_intdigest(raw, 2) - (1 << 63))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def prefix(n: int) -> int:
    return n - (T * n + 99) // 100 + 1


class Order:
    """The global order: by the sketch's counters, then by hash."""

    def __init__(self, table: np.ndarray, cell: int = CELL):
        self.table, self.cell = table, cell
        self.shift = np.uint64(65 - len(table).bit_length())
        self.noise = 2 * float(table.mean())        # what other grams may add to a counter

    def counts(self, found: np.ndarray) -> np.ndarray:
        return self.table[(found >> self.shift).astype(np.int64)]

    def sort(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A sorted set in the global order, and its counters."""
        n = self.counts(found)
        at = np.argsort(n, kind="stable")
        return found[at], n[at]

    def parts(self, n: np.ndarray) -> np.ndarray:
        """Parts in which the rows of grams with counters ``n`` are dealt."""
        return np.maximum(1, np.ceil((n - self.noise) / self.cell)).astype(np.int32)


# --- passes over the texts -----------------------------------------------------

_CHUNK = 1 << 14


def _sketch(docs: DataFrame, counters: int) -> DataFrame:
    """Per document its set's digests and size (``slot`` null); per task its
    counters, in chunks (``slot`` and ``counts``)."""
    schema = T_.StructType([T_.StructField("id", docs.schema["id"].dataType)] + [
        T_.StructField(c, k) for c, k in (("h", T_.LongType()), ("h2", T_.LongType()), ("n", T_.IntegerType()),
                                          ("slot", T_.IntegerType()), ("counts", T_.BinaryType()))])
    shift, chunk = np.uint64(65 - counters.bit_length()), min(_CHUNK, counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, kind = np.zeros(counters, np.int32), None
        seen: set[int] = set()
        held, size = [], 0

        def count(held: list) -> None:
            at = (np.concatenate(held) >> shift).astype(np.int64)
            table[:] += np.bincount(at, minlength=counters).astype(np.int32)
        for batch in batches:
            rows, kind = [], batch.column(0).type
            for raw in batch.column(1).to_pylist():
                found = grams(raw)
                h, h2 = digest(found)
                rows.append((h, h2, len(found)))
                if len(found) and h not in seen:    # copies count once
                    seen.add(h)
                    held.append(found)
                    size += len(found)
                    if size >= _RUN:
                        count(held)
                        held, size = [], 0
                    if len(seen) > _SEEN:
                        seen.clear()
            h, h2, n = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(h, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int32()),
                 pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], schema.names)
        if held:
            count(held)
        if kind is not None:
            k = counters // chunk
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, kind), *[pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.int32())],
                 pa.array(range(k), pa.int32()),
                 pa.array([table[i * chunk:(i + 1) * chunk].tobytes() for i in range(k)], pa.binary())], schema.names)
    return docs.mapInArrow(trimmed(run), schema)


def _order(sketch: DataFrame, counters: int, cell: int = CELL) -> Order:
    """The order of the tasks' summed counters."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[slot] = sums.get(slot, 0) + np.frombuffer(raw, np.int32).astype(np.int64)
        if sums:
            most = np.iinfo(np.int32).max
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()),
                 pa.array([np.minimum(v, most).astype(np.int32).tobytes() for v in sums.values()], pa.binary())],
                ["slot", "counts"])
    rows = (sketch.where("slot is not null").select("slot", "counts").repartition("slot")
            .mapInArrow(add, "slot int, counts binary").collect())
    table = b"".join(bytes(r["counts"]) for r in sorted(rows, key=lambda r: r["slot"]))
    return Order(np.frombuffer(table, np.int32) if table else np.zeros(counters, np.int32), cell)


def _prefixes(docs: DataFrame, order) -> DataFrame:
    """``g, h, n, at, parts``: the prefix grams of every set, with their place and
    the number of parts in which the gram's rows are dealt."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, seen = order.value, set()
        for batch in batches:
            out, counts, sizes, keys, held = [], [], [], [], 0

            def rows() -> pa.RecordBatch:
                p = np.array([s[0] for s in sizes])
                return pa.RecordBatch.from_arrays(
                    [_signed(np.concatenate(out)), pa.array(np.repeat(np.array(keys, np.int64), p)),
                     pa.array(np.repeat(np.array([s[1] for s in sizes], np.int32), p)),
                     pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in p])),
                     pa.array(by.parts(np.concatenate(counts)))], ["g", "h", "n", "at", "parts"])
            for raw in batch.column(0).to_pylist():
                found = grams(raw)
                n = len(found)
                if not n:
                    continue
                h = digest(found)[0]
                if h in seen:
                    continue
                if len(seen) > _SEEN:
                    seen.clear()
                seen.add(h)
                p = prefix(n)
                ordered, times = by.sort(found)
                out.append(ordered[:p])
                counts.append(times[:p])
                sizes.append((p, n))
                keys.append(h)
                held += p
                if held >= _RUN:
                    yield rows()
                    out, counts, sizes, keys, held = [], [], [], [], 0
            if out:
                yield rows()
    return docs.select("t").mapInArrow(trimmed(run), "g long, h long, n int, at int, parts int")


def small_side(ids: DataFrame, most: int = 500_000, most_bytes: int = 32 << 20) -> DataFrame:
    """A stored table of a few numbers or short texts a row, broadcast if it has at
    most ``most`` rows (under 40 MB) and ``most_bytes`` of text; a larger one is
    shuffled by the join."""
    texts = [F.octet_length(f.name) for f in ids.schema if isinstance(f.dataType, (T_.StringType, T_.BinaryType))]
    size = ids.agg(F.count("*"), *[F.coalesce(F.sum(t), F.lit(0)) for t in texts]).first()
    return F.broadcast(ids) if size[0] <= most and sum(size[1:]) <= most_bytes else ids


# --- the prefix tree ------------------------------------------------------------

class Groups:
    """Classes of one tree, joined as links are found."""

    def __init__(self):
        self.up: dict = {}

    def root(self, c):
        while c in self.up:
            c = self.up[c]
        return c

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[b] = a
        return True


class Tree:
    """Path-compressed prefix tree over gram sequences in the global order,
    frequent grams first.  ``kinds`` names the class of each sequence."""

    def __init__(self, sequences: list[np.ndarray], kinds: list | None = None):
        self.kinds = kinds
        order = sorted(range(len(sequences)), key=lambda i: sequences[i].tobytes())
        # node: [grams of its edge, depth at its end, children, entries, least and most size, class]
        self.root = [sequences[0][:0], 0, [], [], 0, 0, None]
        path = [self.root]
        last = None
        for i in order:
            seq = sequences[i]
            common = 0
            if last is not None:
                m = min(len(last), len(seq))
                differ = np.flatnonzero(last[:m] != seq[:m])
                common = int(differ[0]) if len(differ) else m
            while path[-1][1] > common:
                child = path.pop()
                above = path[-1][1]
                if above < common:          # split the edge where the paths part
                    upper = [child[0][:common - above], common, [child], [], 0, 0, None]
                    child[0] = child[0][common - above:]
                    path[-1][2][-1] = upper
                    path.append(upper)
            if len(seq) > path[-1][1]:
                leaf = [seq[path[-1][1]:], len(seq), [], [i], 0, 0, None]
                path[-1][2].append(leaf)
                path.append(leaf)
            else:
                path[-1][3].append(i)
            last = seq
        self._bounds()

    def _bounds(self) -> None:
        order, stack = [], [self.root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack += node[2]
        for node in reversed(order):
            sizes = [node[1]] * bool(node[3]) + [c[k] for c in node[2] for k in (4, 5)]
            node[4], node[5] = (min(sizes), max(sizes)) if sizes else (node[1], node[1])
            if self.kinds is not None:      # the one class below, if there is one only
                below = {self.kinds[i] for i in node[3]} | {c[6] for c in node[2]}
                node[6] = below.pop() if len(below) == 1 else None

    def links(self, probe: np.ndarray, kind=None, groups: Groups | None = None) -> list[int]:
        """Entries whose similarity with ``probe`` (sorted hashes) is enough.  With
        ``groups``: one entry of each class not yet joined with ``kind``, which joins."""
        n, out = len(probe), []
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            if groups and node[6] is not None and groups.root(node[6]) == groups.root(kind):
                continue
            if len(node[0]):
                at = np.minimum(np.searchsorted(probe, node[0]), n - 1)
                overlap += int((probe[at] == node[0]).sum())
            if overlap + min(node[5] - node[1], n - overlap) < _wanted(n, node[4]):
                continue                    # nothing below can reach the overlap
            if node[3] and 100 * overlap >= T * (n + node[1] - overlap):
                out += [i for i in node[3] if not groups or groups.join(kind, self.kinds[i])]
            stack += [(child, overlap) for child in node[2]]
        return out


def _wanted(n: int, m: int) -> int:
    """Least overlap of linked sets of ``n`` and ``m`` grams."""
    return -(-T * (n + m) // (100 + T))


WORK = ["k1", "k2", "block", "slice", "role", "cls", "h", "n"]


def _compare(texts: DataFrame, work: DataFrame, nodes: DataFrame, order, grouped: bool) -> DataFrame:
    """Links among the sets that ``work`` brings together, as documents ``u, v``.

    Rows with one key ``k1, k2, block, slice`` meet: those of role 0 build a
    tree, those of role 1 probe it one after the other (if ``grouped``, past their
    own class ``cls``).  Sets are made from the texts on the way."""
    need = write_shared(work.join(nodes, ["h", "n"]).select(*WORK, "doc"), "work")
    rows = texts.join(small_side(need), F.col("id") == F.col("doc")).select("t", *WORK, "doc")
    names = [*WORK, "doc", "grams"]
    id_type = nodes.schema["doc"].dataType

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, max(b.num_rows, 1), 256)):
            wanted = batch.column(1 + WORK.index("h")).to_pylist()
            found = [grams(raw) for raw in batch.column(0).to_pylist()]
            # a row that repeats the id with another text is not the node's
            own = pa.array([len(f) > 0 and digest(f)[0] == h for f, h in zip(found, wanted)], pa.bool_())
            out = pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([f.tobytes() for f in found], pa.binary())], names)
            yield out.filter(own)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tree, groups, by = None, [], None, None, order.value
        for batch in batches:
            u, v, doc_type = [], [], batch.column(names.index("doc")).type
            cols = [batch.column(names.index(c)).to_pylist()
                    for c in ("k1", "k2", "block", "slice", "role", "cls", "doc", "grams")]
            for *now, role, cls, doc, g in zip(*cols):
                if now != key:
                    key, held, tree = now, [], None
                found = np.frombuffer(g, np.uint64)
                if role == 0:
                    held.append((doc, found, cls))
                elif held:
                    if tree is None:
                        tree = Tree([by.sort(f)[0][::-1] for _d, f, _c in held],
                                    [c for _d, _f, c in held] if grouped else None)
                        groups = Groups() if grouped else None
                    for i in tree.links(found, cls, groups):
                        u.append(doc)
                        v.append(held[i][0])
            yield pa.RecordBatch.from_arrays([pa.array(u, doc_type), pa.array(v, doc_type)], ["u", "v"])
    loaded = T_.StructType([*need.schema, T_.StructField("grams", T_.BinaryType())])
    ends = T_.StructType([T_.StructField("u", id_type), T_.StructField("v", id_type)])
    return (rows.mapInArrow(trimmed(load), loaded).repartition("k1", "k2", "block", "slice")
            .sortWithinPartitions("k1", "k2", "block", "slice", "role", "h", "n")
            .mapInArrow(trimmed(probe), ends))


# --- the join --------------------------------------------------------------------

def _reach(n, at):
    """Largest partner with which the gram at place ``at`` of a set of ``n`` can
    be the first common one: ``n - at`` grams are left for the overlap wanted."""
    return F.floor(((100 + T) * (n - at) - T * n) / T)


def _met(a, b):
    """Whether two rows of one cell may be linked with its gram as their first
    common one: by sizes and places, enough grams are left in both."""
    n, m = a["n"], b["n"]
    return F.least(n - a["at"], m - b["at"]) >= F.ceil(T * (n + m) / (100 + T))


def _cells(prefixes: DataFrame) -> DataFrame:
    """``g, part, parts, h, n, at``: prefix rows that may be the first gram common
    to a linked pair.

    Rows of a gram meet in a window; those of hot grams, which any share of all
    nodes may hold, are dealt in parts there and summed up map-side.  Rows go that
    are alone in their cell or cannot pair with any size there."""
    node = F.struct("h", "n")
    cell = Window.partitionBy("g", "part")
    sides = [F.min(node).alias("lo"), F.max(node).alias("hi"), F.min("n").alias("least"), F.max("reach").alias("far")]
    fits = "lo != hi and least <= reach and n <= far"
    names = ["g", "part", "parts", "h", "n", "at"]
    met = (prefixes.withColumn("part", F.pmod("h", "parts").cast("int")).repartition("g", "part")
           .withColumn("reach", _reach(F.col("n"), F.col("at"))).select(
               *names, "reach", *[c.over(cell).alias(x) for c, x in zip(
                   (F.min(node), F.max(node), F.min("n"), F.max("reach")), ("lo", "hi", "least", "far"))])
           .where(f"parts > 1 or {fits}").dropDuplicates(["g", "part", "h", "n", "at"]))
    met = write_shared(met.select(*names, "reach"), "met")
    hot = met.where("parts > 1")
    whole = hot.groupBy(F.col("g").alias("k")).agg(*sides)
    hot = hot.join(whole, F.col("g") == F.col("k")).where(fits)
    return met.where("parts = 1").select(*names).unionByName(hot.select(*names))


def _stars(cells: DataFrame) -> DataFrame:
    """Work that compares each node with one leader of its cells: the one that
    most of its cells name.  Parts of a hot cell have their own leaders, and these
    the cell's."""
    own = F.struct("h", "n", "at")
    led = cells.withColumn("lo", F.min(own).over(Window.partitionBy("g", "part")))
    follows = (own != F.col("lo")) & _met({"n": F.col("n"), "at": F.col("at")}, F.col("lo"))
    heads = led.where((F.col("parts") > 1) & (own == F.col("lo"))).select("g", "h", "n", "at")
    top = heads.groupBy(F.col("g").alias("k")).agg(F.min(own).alias("lo"))
    named = [F.col("lo.h").alias("ah"), F.col("lo.n").alias("an"), "h", "n"]
    told = (led.where(follows).select(*named)
            .unionByName(heads.join(top, F.col("g") == F.col("k")).where(follows).select(*named)))
    led = write_shared(
        told.groupBy("ah", "an", "h", "n").count()
        .groupBy("h", "n").agg(F.max(F.struct("count", "ah", "an")).alias("m"))
        .select(F.col("m.ah").alias("k1"), F.col("m.an").alias("k2"), "h", "n"), "led")
    return _around(led.withColumn("cls", F.lit(0)).withColumn("by", F.lit(0)))


def _around(named: DataFrame) -> DataFrame:
    """Work for ``k1, k2, by, h, n, cls``: the node ``k1, k2`` (of class ``by``)
    probes the trees of the nodes that name it, dealt in blocks."""
    load = named.groupBy(F.col("k1").alias("x1"), F.col("k2").alias("x2")).agg(
        F.ceil(F.count("*") / PART).cast("int").alias("blocks"))
    entries = named.join(load, (F.col("k1") == F.col("x1")) & (F.col("k2") == F.col("x2"))).select(
        "k1", "k2", F.pmod(F.xxhash64("h", "n"), "blocks").cast("int").alias("block"),
        F.lit(0).alias("slice"), F.lit(0).alias("role"), "cls", "h", "n", "by")
    probes = entries.select("k1", "k2", "block", "slice", "by").distinct().select(
        "k1", "k2", "block", "slice", F.lit(1).alias("role"), F.col("by").alias("cls"),
        F.col("k1").alias("h"), F.col("k2").alias("n"))
    return entries.drop("by").unionByName(probes)


def _mixed_cells(cells: DataFrame, named: DataFrame) -> DataFrame:
    """``g, part, parts, h, n, at, cls``: rows of cells that hold several classes,
    but those beyond all sizes there."""
    rows = (cells.join(named.select(F.col("h").alias("kh"), F.col("n").alias("kn"), "cls"),
                       (F.col("h") == F.col("kh")) & (F.col("n") == F.col("kn")))
            .select("g", "part", "parts", "h", "n", "at", "cls", _reach(F.col("n"), F.col("at")).alias("reach")))
    mixed = (rows.groupBy(F.col("g").alias("k")).agg(
        F.min("cls").alias("x"), F.max("cls").alias("y"), F.min("n").alias("least"), F.max("reach").alias("far"))
             .where("x != y"))
    return write_shared(
        rows.join(mixed, F.col("g") == F.col("k")).where("least <= reach and far >= n")
        .select("g", "part", "parts", "h", "n", "at", "cls"), "cells")


def _reachable(rows: DataFrame) -> DataFrame:
    """The rows of mixed cells that a node of another class can reach, with their
    gram as the first common one; with the number ``all`` of such rows of the cell
    and its commonest class ``common``.

    Each cell is summed up, map-side first, by the two classes that have most grams
    left for each size; the summary goes to all parts of the cell."""
    left = rows.groupBy("g", "n", "cls").agg(F.min(F.col("at") - F.col("n")).alias("at"),
                                             F.max("parts").alias("parts"))
    first = Window.partitionBy("g", "n").orderBy("at", "cls")
    summary = left.withColumn("k", F.row_number().over(first)).where("k <= 2")
    dealt = (summary.select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts",
                            F.lit(0).alias("role"), F.lit(0).cast("long").alias("h"), "n",
                            (F.col("at") + F.col("n")).alias("at"), "cls")
             .unionByName(rows.withColumn("role", F.lit(1))))
    names = dealt.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sizes = None, []
        for batch in batches:
            keep = []
            cols = [batch.column(names.index(c)).to_pylist() for c in ("g", "part", "role", "n", "at", "cls")]
            for i, (g, part, role, n, at, cls) in enumerate(zip(*cols)):
                if (g, part) != key:
                    key, sizes = (g, part), []
                if role == 0:
                    sizes.append((n, n - at, cls))
                elif any(c != cls and min(n - at, left) >= _wanted(n, m) for m, left, c in sizes):
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64()))
    found = write_shared(dealt.repartition("g", "part").sortWithinPartitions("g", "part", "role")
                         .mapInArrow(run, dealt.schema).drop("role"), "reachable")
    load = (found.groupBy("g", "cls").agg(F.count("*").alias("size"))
            .groupBy(F.col("g").alias("x")).agg(F.sum("size").alias("all"), F.max(F.struct("size", "cls")).alias("top"))
            .where("all > top.size").select("x", "all", "top.size", F.col("top.cls").alias("common")))
    return write_shared(found.join(load, F.col("g") == F.col("x")).drop("x"), "met")


def _partners(met: DataFrame) -> DataFrame:
    """Work for cells of at most ``FEW`` rows: each node names its partners, so that
    two nodes that share a hundred cells meet once."""
    few = met.where(F.col("all") <= FEW).select("g", "h", "n", "at", "cls")
    probe, entry = (few.select(*[F.col(c).alias(c + k) for c in few.columns]) for k in "12")
    one, two = ({c: F.col(c + k) for c in ("n", "at")} for k in "12")
    pairs = (probe.join(entry, (F.col("g1") == F.col("g2")) & (F.col("cls1") != F.col("cls2"))
                        & (F.struct("h1", "n1") < F.struct("h2", "n2")) & _met(one, two))
             .select(F.col("h1").alias("k1"), F.col("n1").alias("k2"), F.col("cls1").alias("by"),
                     F.col("h2").alias("h"), F.col("n2").alias("n"), F.col("cls2").alias("cls")).distinct())
    return _around(write_shared(pairs, "pairs"))


def _walks(met: DataFrame) -> DataFrame:
    """Work for the larger cells, in trees of whole families.

    A node's home is the largest of its cells, a cell's family is the commonest home of
    its nodes: the grams of one shared passage are one family, though edited copies
    lack some.  All nodes of a family's cells are entries of its tree, once each and
    dealt in blocks; those outside its commonest class probe it."""
    large = met.where(F.col("all") > FEW).select("g", "h", "n", "cls", "all")
    home = large.groupBy(F.col("h").alias("lh"), F.col("n").alias("ln")).agg(F.max(F.struct("all", "g")).alias("m"))
    rows = write_shared(large.join(home, (F.col("h") == F.col("lh")) & (F.col("n") == F.col("ln")))
                        .select("g", "h", "n", "cls", F.col("m.g").alias("home")), "homes")
    family = (rows.groupBy("g", "home").agg(F.count("*").alias("k"))
              .groupBy(F.col("g").alias("x")).agg(F.max(F.struct("k", "home")).alias("top"))
              .select("x", F.col("top.home").alias("k1")))
    members = write_shared(rows.join(family, F.col("g") == F.col("x")).select("k1", "h", "n", "cls").distinct(), "family")
    load = (members.groupBy("k1", "cls").agg(F.count("*").alias("size"))
            .groupBy(F.col("k1").alias("x")).agg(F.sum("size").alias("all"), F.max(F.struct("size", "cls")).alias("top"))
            .where("all > top.size")
            .select("x", F.col("top.cls").alias("common"), F.ceil(F.col("all") / SLICE).cast("int").alias("blocks"),
                    F.ceil((F.col("all") - F.col("top.size")) / SLICE).cast("int").alias("slices")))
    spot = F.xxhash64("h", "n")
    dealt = members.join(load, F.col("k1") == F.col("x"))
    entries = dealt.select("k1", F.lit(0).alias("k2"), F.pmod(spot, "blocks").cast("int").alias("block"),
                           F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"),
                           F.lit(0).alias("role"), "cls", "h", "n")
    probes = dealt.where("cls != common").select(
        "k1", F.lit(0).alias("k2"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(spot, "slices").cast("int").alias("slice"), F.lit(1).alias("role"), "cls", "h", "n")
    return entries.unionByName(probes)


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", counters: int = COUNTERS,
            cell: int = CELL) -> DataFrame:
    """Per row of ``docs``: ``id_col, n_shingles, component_id``."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").cast("binary").alias("t"))
    sketch = write_shared(_sketch(texts, counters), "sketch")
    order = spark.sparkContext.broadcast(_order(sketch, counters, cell))
    own = sketch.where("slot is null").select("id", "h", "h2", "n")
    nodes = write_shared(
        own.where("n > 0 and id is not null").groupBy("h", "n")
        .agg(F.min("id").alias("doc"), F.min("h2").alias("x"), F.max("h2").alias("y"))
        .select("h", "n", F.when(F.col("x") == F.col("y"), F.col("doc")).otherwise(
            F.raise_error(F.lit("two sets of one size share a digest")).cast(kind)).alias("doc")), "nodes")
    cells = write_shared(_cells(_prefixes(texts.where("id is not null"), order)), "cells")
    # rows that repeat an id with another text tie that text's node to the id
    several = (own.where("n > 0 and id is not null").groupBy(F.col("id").alias("k"))
               .agg(F.min(F.struct("h", "n")).alias("x"), F.max(F.struct("h", "n")).alias("y"))
               .where("x != y").select("k"))
    repeats = (own.join(several, F.col("id") == F.col("k"), "left_semi").where("n > 0")
               .join(nodes, ["h", "n"]).select(F.col("id").alias("u"), F.col("doc").alias("v")))
    first = write_shared(_compare(texts, _stars(cells), nodes, order, False).unionByName(repeats), "links")
    members = cells.select("h", "n").distinct().join(nodes, ["h", "n"])

    def named(joined: DataFrame) -> DataFrame:
        return members.join(joined, F.col("doc") == F.col("node"), "left").select(
            "h", "n", F.coalesce("component", "doc").alias("cls"))

    def with_links(joined: DataFrame, work: DataFrame) -> DataFrame:
        more = write_shared(_compare(texts, work, nodes, order, True), "links")
        if more.isEmpty():
            return joined
        # the stars found so far with the links between them
        return components(joined.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    joined = components(first)
    met = _reachable(_mixed_cells(cells, named(joined)))
    joined = with_links(joined, _partners(met))
    # what the small cells have joined need not meet in the large ones
    met = _reachable(_mixed_cells(met.where(F.col("all") > FEW).drop("cls"), named(joined)))
    joined = write_shared(with_links(joined, _partners(met).unionByName(_walks(met))), "classes")
    order.destroy()
    by_node = nodes.join(joined, F.col("doc") == F.col("node"), "left").select(
        F.col("h").alias("kh"), F.col("n").alias("kn"), F.coalesce("component", "doc").alias("cls"))
    out = own.join(by_node, (F.col("h") == F.col("kh")) & (F.col("n") == F.col("kn")), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
                      F.when(F.col("id").isNotNull(), F.coalesce("cls", "id")).alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id
    (one of its rows, if they repeat); rows with a null id stay."""
    found = write_shared(classes(docs, id_col, text), "classes")
    dropped = write_shared(found.where(F.col(id_col) != F.col("component_id"))
                           .select(F.col(id_col).alias("_gone")).distinct(), "dropped")
    kept = docs.join(small_side(dropped), F.col(id_col) == F.col("_gone"), "left_anti")
    repeated = found.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1")
    if repeated.isEmpty():
        return kept
    return kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(
        kept.where(F.col(id_col).isNull()))
