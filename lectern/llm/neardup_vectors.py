"""Links among vectors of one label at a cosine of at least a threshold, by a subspace pigeonhole join.

Unit vectors are rotated onto their principal axes and cut into low-dimensional blocks.  cos >= t means a squared
distance of at most 2 - 2t; a block's budget is its share of that, in proportion to its variance.  If every
block were over its budget, so would be the sum, so each link shows in at least one block.  A block is range-joined on a
grid over its first two coordinates with cells twice as wide as the radius: a vector meets its own cell and those
neighbours within its radius.  Only a block's coordinates go there.  What a cell finds within budget are candidates; they meet their whole
vectors by joins and are verified by the cosine in double precision, in the first block that has them, so a pair is found once.

Cells where candidates are many for the vectors they have (near copies) don't give them pair by pair: their vectors are sent whole, and links
are counted there.  Equal vectors are one node.  A cell with more than `TILE` vectors is dealt out in tiles, pair of tiles by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.shipping import map_arrow
from lectern.llm.common import Forest, checkpoint, components

THRESHOLD, BLOCK_DIMS, TILE = 0.93, 8, 2048
#: Room for rounding in the candidate search; verification is exact.
SLACK = 1e-6
#: A group of vectors gives its candidates pair by pair if they are at most so many times its vectors.
SPARSE = 4


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def rotation(vectors: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Principal axes (columns) of the unit vectors, and their variances; only dims x dims sums reach the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for b in batches:
            x = _matrix(b.column("v"))
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["row", "sums"])

    parts = map_arrow(vectors.select("v"), sums, "row int, sums array<double>")
    total = parts.groupBy("row").agg(F.array(*[F.sum(F.col("sums")[k]) for k in range(dims)]).alias("sums")).toArrow()
    matrix = np.zeros((dims, dims))
    for row, values in zip(total.column("row").to_pylist(), total.column("sums").to_pylist(), strict=True):
        matrix[row] = values
    values, axes = np.linalg.eigh(matrix)
    return axes[:, ::-1], np.maximum(values[::-1], 0)


class Blocks:
    """The dimensions of each block (dealt out by variance, largest first) and its squared-distance budget."""

    def __init__(self, axes: np.ndarray, variance: np.ndarray, threshold: float, block_dims: int = BLOCK_DIMS) -> None:
        n = max(1, len(variance) // block_dims)
        self.axes, self.threshold = axes, threshold
        self.dims = [np.arange(k, len(variance), n) for k in range(n)]
        share = np.array([variance[d].sum() for d in self.dims]) + 1e-9 * max(variance.sum(), 1e-300)
        self.budget = (2 - 2 * threshold) * share / share.sum() + SLACK

    def rotated(self, x: np.ndarray) -> np.ndarray:
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) @ self.axes

    def cells(self, y: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, cell and whether it is the row's own, for each cell that a vector goes to."""
        radius = np.sqrt(self.budget[block])
        rows, cells, own = [], [], []
        at = y[:, self.dims[block][:2]] / (2 * radius)
        home = np.floor(at).astype(np.int64)
        low, high = np.floor(at - 0.5).astype(np.int64), np.floor(at + 0.5).astype(np.int64)
        for pick in np.ndindex(*(2,) * home.shape[1]):
            # Each axis has the own cell and the one neighbour within half a cell.
            other = np.where(low < home, low, high)
            cell = np.where(np.array(pick) == 1, other, home)
            rows.append(np.arange(len(y)))
            cells.append(cell @ np.array([1, 1 << 20])[: home.shape[1]])
            own.append(np.full(len(y), not any(pick)))
        return np.concatenate(rows), np.concatenate(cells), np.concatenate(own)

    def near(self, ya: np.ndarray, yb: np.ndarray, block: int, most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of ya and yb, a block's coordinates, that are within its budget."""
        sb = (yb**2).sum(axis=1)
        step = max(1, most // max(1, len(yb)))
        for at in range(0, len(ya), step):
            part = ya[at : at + step]
            i, j = np.nonzero((part**2).sum(axis=1)[:, None] + sb - 2 * part @ yb.T <= self.budget[block] + SLACK)
            for k in range(0, len(i), 1 << 16):
                yield i[k : k + (1 << 16)] + at, j[k : k + (1 << 16)]

    def linked(self, xa: np.ndarray, xb: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Which pairs of whole vectors are linked, and have their block as the first within its budget."""
        apart = (self.rotated(xa) - self.rotated(xb)) ** 2
        within = np.stack([apart[:, d].sum(axis=1) <= b for d, b in zip(self.dims, self.budget, strict=True)], axis=1)
        good = within.any(axis=1) & (within.argmax(axis=1) == block)
        good[good] = cosine(xa[good], xb[good]) >= self.threshold
        return good


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


KEY = ("label", "dims", "block", "cell")
GROUP = (*KEY, "i", "j")
Pairs = Iterator[tuple[np.ndarray, np.ndarray]]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows sorted by GROUP, group by group, with the numbers of those that are compared as a and as b."""
    held: pa.Table | None = None

    def group(t: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
        a, b = (np.flatnonzero(t.column(c).to_numpy().astype(bool)) for c in ("as_a", "as_b"))
        if len(a) and len(b):
            yield t, a, b

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        if not t.num_rows:
            continue
        marks = np.zeros(t.num_rows, bool)
        marks[0] = True
        for k in GROUP:
            c = t.column(k).to_numpy()
            marks[1:] |= c[1:] != c[:-1]
        starts = [*np.flatnonzero(marks).tolist(), t.num_rows]
        for s, e in zip(starts[:-2], starts[1:-1], strict=True):
            yield from group(t.slice(s, e - s))
        held = t.slice(starts[-2])
    if held is not None:
        yield from group(held)


def _ordered(rid: np.ndarray, a: np.ndarray, b: np.ndarray, found: Pairs) -> Pairs:
    for p, q in found:
        p, q = a[p], b[q]
        first = rid[p] < rid[q]
        yield p[first], q[first]


def _candidates(batches: Iterator[pa.RecordBatch], blocks: Blocks, sparse: float) -> Iterator[pa.RecordBatch]:
    """first, second, block of each candidate of a group with few; the group's key alone (first is -1) of one with many."""
    names = ["first", "second", *GROUP]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    for t, a, b in _groups(batches):
        rid, y, block = t.column("rid").to_numpy(), _matrix(t.column("y").combine_chunks()), t.column("block")[0].as_py()
        got, many = [], 0
        for p, q in _ordered(rid, a, b, blocks.near(y[a], y[b], block)):
            got.append((rid[p], rid[q]))
            many += len(p)
            if many > sparse * t.num_rows:
                got = [(np.array([-1]), np.array([-1]))]
                break
        first, second = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in (0, 1))
        key = [t.column(k)[0].as_py() for k in GROUP]
        if len(first):
            yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second), *(pa.array([v] * len(first), x) for v, x in zip(key, types[2:], strict=True))], names)


def _told(degree: dict[int, int], edges: list[tuple[int, int]]) -> pa.RecordBatch:
    rows = [(k, -1, n) for k, n in degree.items()] + [(x, y, 0) for x, y in edges]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["a", "b", "n"])


def _verified(batches: Iterator[pa.RecordBatch], blocks: Blocks) -> Iterator[pa.RecordBatch]:
    """Of candidates with their vectors: for each vector its linked rows so far (a, -1, n), and a forest of the links (a, b, 0)."""
    forest, degree, edges = Forest(), {}, []
    for whole in batches:
        for at in range(0, whole.num_rows, 8192):
            t = whole.slice(at, 8192)
            good = np.flatnonzero(blocks.linked(_matrix(t.column("x")), _matrix(t.column("z")), t.column("block").to_numpy()))
            for x, y, m, n in zip(*(t.column(c).to_numpy()[good].tolist() for c in ("first", "second", "m", "n")), strict=True):
                degree[x] = degree.get(x, 0) + n
                degree[y] = degree.get(y, 0) + m
                if forest.join(x, y):
                    edges.append((x, y))
    yield _told(degree, edges)


def _group_links(batches: Iterator[pa.RecordBatch], blocks: Blocks) -> Iterator[pa.RecordBatch]:
    """The same for groups of whole vectors."""
    forest, degree, edges = Forest(), {}, []
    for t, a, b in _groups(batches):
        rid, n, v, block = t.column("rid").to_numpy(), t.column("n").to_numpy(), _matrix(t.column("v").combine_chunks()), t.column("block")[0].as_py()
        y = blocks.rotated(v)[:, blocks.dims[block]]
        for p, q in _ordered(rid, a, b, blocks.near(y[a], y[b], block)):
            good = blocks.linked(v[p], v[q], np.full(len(p), block))
            p, q = p[good], q[good]
            for x, z in ((p, q), (q, p)):
                total = np.bincount(x, weights=n[z], minlength=len(rid)) if len(x) else np.zeros(len(rid))
                for k in np.flatnonzero(total):
                    degree[int(rid[k])] = degree.get(int(rid[k]), 0) + int(total[k])
            edges.extend((x, z) for x, z in zip(rid[p].tolist(), rid[q].tolist(), strict=True) if forest.join(x, z))
    yield _told(degree, edges)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, block_dims: int = BLOCK_DIMS, sparse: float = SPARSE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label).

    Rows are linked if their labels are equal and not null and the cosine in double precision is at least threshold
    (at most 1, over 0).  Null, empty or zero vectors, and those with null or non-finite components, link with
    nothing, nor do vectors of different lengths.  n_links counts other rows, copies included;
    component_id is the smallest vec_id reachable.  Rows may repeat a vec_id: each is a vector of its
    own.  Other columns aren't used; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"))
    fine = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: F.coalesce(x != 0, F.lit(False))), F.lit(False))
    fine = fine & ~F.coalesce(F.exists("v", lambda x: F.isnan(x)), F.lit(False))
    rows = rows.withColumn("hash", F.when(fine, F.xxhash64("label", "v")))
    nodes = rows.where("hash is not null").groupBy("hash", "label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    nodes = checkpoint(nodes.withColumn("rid", F.monotonically_increasing_id()))
    dims = nodes.agg(F.max(F.size("v"))).first()[0] or 0
    if not dims:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    kind = nodes.schema["v"].dataType.elementType.simpleString()
    padded = F.concat("v", F.array_repeat(F.lit(0).cast(kind), F.lit(dims) - F.size("v")))
    flat = nodes.select("rid", "n", "label", F.size("v").alias("dims"), padded.alias("v"))
    blocks = Blocks(*rotation(flat, dims), threshold, block_dims)
    kept = spark.sparkContext.broadcast(blocks)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = kept.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                y = blocks.rotated(_matrix(b.column("v")))
                for k in range(len(blocks.dims)):
                    row, cell, own = blocks.cells(y, k)
                    taken, d = b.take(pa.array(row)), blocks.dims[k]
                    at_block = pa.FixedSizeListArray.from_arrays(pa.array(y[row][:, d].astype(np.float32).ravel()), len(d)).cast(pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in ("rid", "label", "dims")), at_block, pa.array(np.full(len(row), k, np.int32)), pa.array(cell), pa.array(own)], ["rid", "label", "dims", "y", "block", "cell", "own"])

    key = list(KEY)
    cells = map_arrow(flat.select("rid", "label", "dims", "v"), spread, "rid long, label long, dims int, y array<float>, block int, cell long, own boolean")
    # Cells with one vector at most, or no vector of their own, have no pair.
    full = cells.groupBy(*key).agg(F.count("*").alias("size"), F.max("own").alias("owned")).where("size > 1 and owned").select(*key, F.expr(f"(size + {tile - 1}) div {tile}").alias("tiles"))
    cells = cells.join(full, key).withColumn("tile", F.pmod(F.xxhash64(F.lit(7), "rid"), F.col("tiles")))
    # An own vector meets, as a, the vectors of each tile; every vector meets, as b, the own ones of each tile.
    pairs = F.expr("""if(tiles = 1, array(struct(0L as i, 0L as j, own as as_a, true as as_b)),
        concat(array(struct(tile as i, tile as j, own as as_a, true as as_b)),
               transform(filter(sequence(0L, tiles - 1), t -> t <> tile), t -> struct(t as i, tile as j, false as as_a, true as as_b)),
               if(own, transform(filter(sequence(0L, tiles - 1), t -> t <> tile), t -> struct(tile as i, t as j, true as as_a, false as as_b)), array())))""")
    dealt = cells.withColumn("to", F.explode(pairs)).select("rid", "y", *key, "to.i", "to.j", "to.as_a", "to.as_b")
    fields = "first long, second long, label long, dims int, block int, cell long, i long, j long"
    near = checkpoint(map_arrow(dealt.repartition(*GROUP).sortWithinPartitions(*GROUP), lambda it: _candidates(it, kept.value, sparse), fields))
    left = flat.select(F.col("rid").alias("first"), F.col("n").alias("m"), F.col("v").alias("x"))
    right = flat.select(F.col("rid").alias("second"), "n", F.col("v").alias("z"))
    both = near.where("first >= 0").select("first", "second", "block").join(left, "first").join(right, "second")
    found = map_arrow(both, lambda it: _verified(it, kept.value), "a long, b long, n long")
    dense = near.where("first < 0").select(*GROUP)
    if not dense.isEmpty():
        whole = dealt.drop("y").join(dense, list(GROUP), "left_semi").join(flat.select("rid", "n", "v"), "rid")
        found = found.union(map_arrow(whole.repartition(*GROUP).sortWithinPartitions(*GROUP), lambda it: _group_links(it, kept.value), "a long, b long, n long"))
    found = checkpoint(found)
    degree = found.where("b = -1").groupBy("a").agg(F.sum("n").alias("degree"))
    parts = components(found.where("b >= 0").select("a", "b"))
    done = nodes.join(degree.withColumnRenamed("a", "rid"), "rid", "left").join(parts.withColumnRenamed("node", "rid"), "rid", "left")
    done = done.select("hash", F.col("label").alias("l"), F.col("v").alias("w"), "first", (F.col("n") - 1 + F.coalesce("degree", F.lit(0))).alias("links"), F.coalesce("component", "rid").alias("part"))
    least = done.groupBy("part").agg(F.min("first").alias("component"))
    done = checkpoint(done.join(least, "part").select(F.col("hash").alias("h"), "l", "w", "links", "component"))
    same = (F.col("hash") == F.col("h")) & (F.col("label") == F.col("l")) & (F.col("v") == F.col("w"))
    out = rows.join(done, same, "left")
    component = F.when(F.col("h").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
