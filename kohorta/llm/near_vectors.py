"""Near-duplicate vectors: all pairs with a cosine of ``threshold`` or more, by tiles of int8 products.

Equal vectors are one node with a number of copies.  Nodes are laid out along the order of their nearest pivot and
cut into *tiles* of about ``tile_rows`` nodes; a *cell* is a pair of tiles.  A cell goes without a look only if the
boxes around the tiles' unit vectors are farther apart than two linked vectors can be.

In a cell every unit vector u is quantised to int8, u = s q + e, and the norm of its own error e is measured.  As
|u.w - s_u s_w (q_u.q_w)| <= |e_u| + |e_w| + |e_u| |e_w|, the integer product decides all pairs but those within that bound of the
threshold, and only those are computed again in double precision.  The products are exact: sums of
int8 products stay below 2^24, so single precision holds them.

A cell returns no pairs: how many vectors each node links to there, and links that connect the nodes that its
links connect (fewer than it has nodes).  So a group of near copies costs products, not rows.

Defined results: vectors that are null or empty, hold null or non-finite components or only zeros link with nothing,
equal ones included; vectors of different lengths don't link; equal vectors link, and every row counts, with
repeated ids too; a null id counts in ``n_links`` and names a component only if no other id is in it; ``kept`` is
true of all rows with the component's id; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, frugal, shared_dir, small_batches
from .components import components

THRESHOLD = 0.95
TILE_ROWS = 8192
#: Nodes whose neighbourhoods order the others; those with the least hashes.  They decide speed only.
PIVOTS = 64
#: What rounding may add to a bound or take from a product.
SLACK = 1e-6
#: Components whose int8 products are sure to be exact when summed in single precision.
EXACT_DIMS = 1024
#: Pairs of a block of a cell; of those that are computed in double precision at a time.
BLOCK_PAIRS, DOUBLE_PAIRS = 1 << 21, 1 << 16


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors, their scales, and the norms of what they leave out."""
    scale = np.abs(u).max(axis=1) / 127
    q = np.rint(u / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((u - q * scale[:, None]) ** 2).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact products of int8 rows."""
    if a.shape[1] <= EXACT_DIMS:
        return a.astype(np.float32) @ b.astype(np.float32).T
    parts = range(0, a.shape[1], EXACT_DIMS)
    return sum((a[:, i : i + EXACT_DIMS].astype(np.float32) @ b[:, i : i + EXACT_DIMS].astype(np.float32).T).astype(np.float64) for i in parts)


def linked(u: np.ndarray, w: np.ndarray, threshold: float, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Blocks (i, j, n): the pairs of rows with a cosine of ``threshold`` or more, and how many were computed again.

    ``own``: the rows are the same, so that only pairs i < j are asked for.
    """
    a, s, e = quantised(u)
    b, r, f = (a, s, e) if own else quantised(w)
    if not len(a) or not len(b):
        return
    rows = max(1, BLOCK_PAIRS // len(b))
    for low in range(0, len(a), rows):
        first = low if own else 0
        made = products(a[low : low + rows], b[first:])
        # what a product must reach whatever the other's scale and error; exact bounds follow for those that do
        reach = (threshold - SLACK - e[low : low + rows] - f[first:].max() * (1 + e[low : low + rows])) / s[low : low + rows]
        reach = np.where(reach > 0, reach / r[first:].max(), reach / r[first:].min())
        i, j = np.nonzero(made >= (reach * (1 - SLACK * np.sign(reach)))[:, None].astype(made.dtype))
        product = made[i, j].astype(np.float64)
        i, j = i + low, j + first
        if own:
            later = j > i
            i, j, product = i[later], j[later], product[later]
        about, bound = product * s[i] * r[j], e[i] + f[j] + e[i] * f[j] + SLACK
        link = about - bound >= threshold
        open_ = np.flatnonzero(~link & (about + bound >= threshold))
        for k in range(0, len(open_), DOUBLE_PAIRS):
            part = open_[k : k + DOUBLE_PAIRS]
            link[part] = np.einsum("ij,ij->i", u[i[part]], w[j[part]]) >= threshold
        yield i[link], j[link], len(open_)


class _Forest:
    """Connected nodes, and the links that connected them."""

    def __init__(self, n: int):
        self.root, self.label, self.links = list(range(n)), np.arange(n), []

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            apart = np.flatnonzero(self.label[i] != self.label[j])
            if not len(apart):
                return
            i, j = i[apart], j[apart]
            some = np.unique(np.r_[np.unique(i, return_index=True)[1], np.unique(j, return_index=True)[1]])
            for a, b in zip(i[some].tolist(), j[some].tolist(), strict=True):
                x, y = self.find(a), self.find(b)
                if x != y:
                    self.root[max(x, y)] = min(x, y)
                    self.links.append((a, b))
            label = np.array(self.root)
            while not np.array_equal(label, up := label[label]):
                label = up
            self.label = label


_CELL = "node binary, links bigint, other binary"


def _cell(table: pa.Table, threshold: float) -> pa.Table:
    """Of a cell's nodes (side, node, copies, v): (node, links, null) of those with links, and (node, 0, other) that connect."""
    side = table.column("side").to_numpy()
    order = np.argsort(side, kind="stable")
    table = table.take(pa.array(order)).combine_chunks()
    n = int((side == 0).sum())
    u = unit(matrix(table.column("v").combine_chunks()))
    own = n == len(u)
    copies = table.column("copies").to_numpy().astype(np.float64)
    counts, forest = np.zeros(len(u)), _Forest(len(u))
    for i, j, _ in linked(u[:n], u if own else u[n:], threshold, own):
        if not len(i):
            continue
        j = j if own else j + n
        counts += np.bincount(i, weights=copies[j], minlength=len(u)) + np.bincount(j, weights=copies[i], minlength=len(u))
        forest.join(i, j)
    node = table.column("node").combine_chunks()
    some = np.flatnonzero(counts)
    a, b = np.array(forest.links, dtype=np.int64).reshape(-1, 2).T
    names = pa.concat_arrays([node.take(pa.array(some)), node.take(pa.array(a))])
    links = pa.array(np.r_[counts[some].astype(np.int64), np.zeros(len(a), dtype=np.int64)])
    others = pa.concat_arrays([pa.nulls(len(some), node.type), node.take(pa.array(b))])
    return pa.table([names, links, others], ["node", "links", "other"])


@frugal
def _by_pivot(batches: Iterator[pa.RecordBatch], pivots: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The nodes with the pivot of their length nearest to them, and how near it is."""
    for batch in batches:
        size = batch.column("dims").to_numpy()
        pivot, near = np.zeros(len(size), dtype=np.int32), np.zeros(len(size))
        for d in np.unique(size).tolist():
            if d in pivots:
                own = np.flatnonzero(size == d)
                cosine = unit(matrix(batch.column("v").take(pa.array(own)))) @ pivots[d].T
                pivot[own], near[own] = cosine.argmax(axis=1), cosine.max(axis=1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(near)], [*batch.schema.names, "pivot", "near"])


@frugal
def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dims, tile, low, high): the boxes around the unit vectors of each tile in a batch."""
    for batch in batches:
        size, tile = batch.column("dims").to_numpy(), batch.column("tile").to_numpy()
        rows = []
        for d, t in sorted(set(zip(size.tolist(), tile.tolist(), strict=True))):
            u = unit(matrix(batch.column("v").take(pa.array(np.flatnonzero((size == d) & (tile == t))))))
            rows.append((d, t, u.min(axis=0), u.max(axis=0)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        types = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["dims", "tile", "low", "high"])


def usable(v: Column) -> Column:
    """Whether a vector can link: some components, all finite, not all of them zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _node(v: Column) -> Column:
    """A 128-bit name of a vector's components."""
    return F.unhex(F.md5(F.concat_ws(",", F.transform(v, lambda x: x.cast("string")))))


def chained(pivots: np.ndarray) -> np.ndarray:
    """The pivots in an order in which each is followed by the nearest of those that are left, so that tiles hold neighbours."""
    order, left = [0], list(range(1, len(pivots)))
    while left:
        order.append(left.pop(int((pivots[left] @ pivots[order[-1]]).argmax())))
    return pivots[order]


def _tiles(nodes: DataFrame, scratch: Scratch, tile_rows: int) -> DataFrame:
    """``nodes`` with ``tile``, numbered from 0 in each length: those with near pivots lie together."""
    n = nodes.count()
    lead = nodes.orderBy("node").limit(PIVOTS).select("dims", "v").collect()
    pivots = {d: chained(unit(np.array([r.v for r in lead if r.dims == d], dtype=np.float64))) for d in {r.dims for r in lead}}
    schema = T.StructType([*nodes.schema.fields, T.StructField("pivot", T.IntegerType()), T.StructField("near", T.DoubleType())])
    keyed = nodes.mapInArrow(lambda it: _by_pivot(it, pivots), schema)
    laid = keyed.repartitionByRange(max(1, -(-n // tile_rows)), "dims", "pivot", "near", "node").drop("pivot", "near")
    laid = scratch.stored(laid.withColumn("part", F.spark_partition_id()), "laid")
    sizes = laid.groupBy("dims", "part").agg(F.count("*").alias("n"))  # a row a tile, about
    before = F.coalesce(F.sum("n").over(Window.partitionBy("dims").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return laid.join(sizes.select("dims", "part", F.floor(before / tile_rows).alias("tile")), ["dims", "part"]).drop("part")


def _cells(tiles: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(dims, a, b) of the pairs of tiles whose boxes are near enough for a link."""
    made = tiles.select("dims", "tile", "v").mapInArrow(_boxes, "dims int, tile bigint, low array<double>, high array<double>")  # a row a batch and tile
    sides = made.select("dims", "tile", F.posexplode(F.arrays_zip("low", "high")).alias("at", "x")).groupBy("dims", "tile", "at").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    whole = sides.groupBy("dims", "tile").agg(F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("s"))
    boxes = scratch.stored(whole.select("dims", "tile", F.col("s.low").alias("low"), F.col("s.high").alias("high")), "boxes")
    last = boxes.groupBy("dims").agg(F.max("tile").alias("last"))
    pairs = boxes.join(last, "dims").select("dims", F.col("tile").alias("a"), "low", "high", F.explode(F.sequence("tile", "last")).alias("b"))
    other = boxes.select("dims", F.col("tile").alias("b"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    zero = F.lit(0.0)
    gaps = F.zip_with(F.arrays_zip("low", "high"), F.arrays_zip("other_low", "other_high"), lambda x, y: F.greatest(x["low"] - y["other_high"], y["other_low"] - x["high"], zero))
    apart = F.aggregate(gaps, zero, lambda total, g: total + g * g)
    return pairs.join(other, ["dims", "b"]).where(apart <= 2 - 2 * threshold + SLACK).select("dims", "a", "b")


def near_vectors(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(``key``, n_links, component_id, kept) of every row; a vector's component are those that links lead to."""
    if not 0 < threshold <= 1:
        raise ValueError(f"the threshold must be above 0 and at most 1; got {threshold}")
    spark = vectors.sparkSession
    shared_dir(spark)
    small_batches(spark)
    scratch = Scratch(spark)
    kind = vectors.schema[vector].dataType.elementType
    v = F.col(vector) if isinstance(kind, T.FloatType) else F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).alias("id"), v.alias("v")).select("id", F.when(usable(F.col("v")), _node(F.col("v"))).alias("node"), "v")
    found = rows.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("v").alias("v"))
    nodes = scratch.stored(found.withColumn("dims", F.size("v")), "nodes")
    tiles = scratch.stored(_tiles(nodes.drop("least"), scratch, tile_rows), "tiles")
    cells = _cells(tiles, threshold, scratch)
    sides = cells.select("dims", "a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("tile"))
    dealt = tiles.join(sides, ["dims", "tile"]).select("dims", "a", "b", (F.col("tile") != F.col("a")).cast("int").alias("side"), "node", "copies", "v")
    made = scratch.stored(dealt.groupBy("dims", "a", "b").applyInArrow(lambda t: _cell(t, threshold), _CELL), "links")

    links = made.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    part = components(made.where("other IS NOT NULL").select(F.col("node").alias("u"), F.col("other").alias("v")))
    named = nodes.select("node", "copies", "least").join(links, "node", "left").join(part, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    named = scratch.stored(named, "named")
    scratch.release("named")
    alone = rows.where("node IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = rows.where("node IS NOT NULL").select("id", "node").join(named, "node").select("id", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
