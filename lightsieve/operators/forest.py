"""Edges by similarity: the maximum spanning forest, and the components at any threshold that follow from it.

Boruvka rounds as joins: every component takes its best edge to another one, components that are linked so become one,
and edges inside a component go. Each round at least halves the components that still have edges. Two components may
be linked by many edges; only the best of each two goes on, so a round's table holds no more rows than component pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lightsieve.operators import tiles
from lightsieve.operators.components import connected_components
from lightsieve.operators.similarity import BITS, hash_arrays, least_product
from lightsieve.operators.skew import splittable_join
from lightsieve.session import discard, materialize


def _key(weight: str = "weight", a: str = "id_a", b: str = "id_b") -> Column:
    """Best first when least: heaviest, then by the ids; no two edges tie."""
    return F.struct((-F.col(weight)).alias("lighter"), F.col(a).alias("a"), F.col(b).alias("b"))


def _roots(best: DataFrame) -> DataFrame:
    """(node, root) of (node, to): the tree that each node's best edge leads into, rooted in its mutual pair's smaller node."""
    back = best.select(F.col("node").alias("to"), F.col("to").alias("back"))
    current = materialize(splittable_join(best, back, ["to"], "left").select("node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("to")), F.col("node")).otherwise(F.col("to")).alias("root")), "forest-roots")
    while True:
        nexts = current.select(F.col("node").alias("root"), F.col("root").alias("next"))
        followed = materialize(splittable_join(current, nexts, ["root"]).select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "forest-roots")
        discard(current)
        if followed.filter("moved").isEmpty():
            return followed
        current = followed


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(id_a, id_b, weight): of edges (id_a, id_b, weight) those of the maximum spanning forest, id_a < id_b.

    Of equal weights the edge of smaller ids comes first, so the forest is one and the same however the rows lie.
    Direction, loops, repeated edges (the heaviest counts) and rows with a null are of no account.
    """
    a, b = F.col("id_a"), F.col("id_b")
    plain = edges.filter(a != b).filter("weight is not null").groupBy(F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b")).agg(F.max("weight").alias("weight"))
    return _spanning(plain.select(F.col("id_a").alias("u"), F.col("id_b").alias("v"), "id_a", "id_b", "weight"))


def _spanning(edges: DataFrame) -> DataFrame:
    """(id_a, id_b, weight): of edges (u, v, id_a, id_b, weight), each between two components u and v, those of the maximum spanning forest."""
    current = materialize(edges, "forest-edges")
    forest = None
    while not current.isEmpty():
        ends = current.select(F.col("u").alias("node"), F.col("v").alias("to"), "id_a", "id_b", "weight").unionByName(current.select(F.col("v").alias("node"), F.col("u").alias("to"), "id_a", "id_b", "weight"))
        best = materialize(ends.groupBy("node").agg(F.min(F.struct(_key().alias("key"), "to", "weight")).alias("m")).select("node", "m.to", F.col("m.key.a").alias("id_a"), F.col("m.key.b").alias("id_b"), "m.weight"), "forest-best")
        taken = materialize(best.select("id_a", "id_b", "weight").distinct(), "forest")
        forest = taken if forest is None else forest.unionByName(taken)
        roots = _roots(best.select("node", "to")).select("node", "root")
        moved = splittable_join(current.withColumnRenamed("u", "node"), roots, ["node"]).drop("node").withColumnRenamed("root", "u")
        moved = splittable_join(moved.withColumnRenamed("v", "node"), roots, ["node"]).drop("node").withColumnRenamed("root", "v").filter("u <> v")
        heaviest = moved.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min(F.struct(_key().alias("key"), "weight")).alias("m"))
        before, current = current, materialize(heaviest.select("u", "v", F.col("m.key.a").alias("id_a"), F.col("m.key.b").alias("id_b"), "m.weight"), "forest-edges")
        discard(before, best)
    return current.select("id_a", "id_b", "weight") if forest is None else forest


FOREST_TILE_ROWS = 1 << 14
FIRST_BLOCK_ROWS = 1 << 12
BLOCK_GROWTH = 8
_HASH_PARTS = 1 << 30


def hash_components(hashes: DataFrame, threshold: float, least_width_ratio: float = 0.5, first_block_rows: int = FIRST_BLOCK_ROWS, tile_rows: int = tiles.TILE_ROWS, far_tile_rows: int = FOREST_TILE_ROWS) -> DataFrame:
    """(node, component) as connected_components of the pairs of hash_pairs, from (id, hash, width), without pairs or a forest.

    All rows meet a small block of them, which leaves most in one component, the core, where rows are alike at all. In
    further rounds those outside the core meet the next, larger block, until they have met all rows. Two rows that never
    met are both in the core, which only grows, so nothing is lost; at worst every two rows meet, once from each side.
    """
    rows = hashes.filter("id is not null and hash is not null and width is not null").select("id", "hash", "width")
    kind = rows.schema["id"].dataType.simpleString()
    placed = materialize(rows.withColumn("component", F.col("id")).withColumn("_part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(_HASH_PARTS))), "linked-placed")
    kernel, core = _link_kernel(least_product(threshold), least_width_ratio), None
    begin, end = 0, max(1, _HASH_PARTS * first_block_rows // max(1, placed.count()))
    while begin < _HASH_PARTS:
        outside = placed if core is None else placed.join(core, "component", "left_anti").select(placed.columns)
        if outside.isEmpty():
            break
        block = placed.filter((F.col("_part") >= begin) & (F.col("_part") < end))
        links = tiles.cross_pairs(outside, block, kernel, f"node {kind}, to {kind}", tile_rows=tile_rows, right_tile_rows=far_tile_rows)
        joined = connected_components(links, "node", "to").select(F.col("node").alias("component"), F.col("component").alias("_into"))
        before, placed = placed, materialize(splittable_join(placed, joined, ["component"], "left").select("id", "hash", "width", F.coalesce("_into", "component").alias("component"), "_part"), "linked-placed")
        if core is None:
            core = placed.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
        else:  # a component's name is one of its rows
            core = placed.join(core.select(F.col("component").alias("id")), "id").select("component").distinct()
        core = materialize(core, "linked-core")
        discard(before)
        begin, end = end, end * BLOCK_GROWTH
    several = placed.groupBy("component").agg((F.min("id") < F.max("id")).alias("several")).filter("several").select("component")
    return splittable_join(placed, several, ["component"]).select(F.col("id").alias("node"), "component").distinct()


def _link_kernel(least: int, least_width_ratio: float) -> tiles.Kernel:
    """Components that rows of left and right link, as links of each to one of them: no more than there are components, however many pairs are alike."""

    def kernel(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        (a, wide_a), (b, wide_b) = hash_arrays(left), hash_arrays(right)
        names, of_a, of_b = _coded(left["component"], right["component"])
        root = np.arange(len(names))
        for rows in tiles.chunks(len(a), len(b)):
            i, j = np.nonzero(a[rows] @ b.T >= least)
            i += rows.start
            apart = root[of_a[i]] != root[of_b[j]]
            i, j = i[apart], j[apart]
            fine = _pair_ratio(wide_a[i], wide_b[j]) >= least_width_ratio
            root = _united(root, of_a[i[fine]], of_b[j[fine]])
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table([names.take(pa.array(x, pa.int64())) for x in (moved, root[moved])], names=["node", "to"])

    return kernel


def _coded(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(the different values in order, the place of each value of left among them, that of each of right)."""
    both = pa.chunked_array([*left.chunks, *right.chunks]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(both.dictionary)
    place = np.empty(len(order), int)
    place[order.to_numpy()] = np.arange(len(order))
    codes = place[both.indices.to_numpy()]
    return both.dictionary.take(order), codes[: len(left)], codes[len(left) :]


def _pair_ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """width_ratio of each a with the b at its place alone."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.minimum(a / b, b / a)


def _united(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each node's set after the links (u, v), from those before."""
    while len(u):
        root = root.copy()
        np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
        while (root[root] != root).any():
            root = root[root]
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    return root


LINKS_A_ROW = 2
SAMPLE_ROWS = 1024
_SAMPLE_SHARE = 0.9
_FEW_OUTSIDE = 8
_KEPT_EDGES = 1 << 20


def hash_forest(hashes: DataFrame, threshold: float, least_width_ratio: float = 0.5, links_a_row: float = LINKS_A_ROW, tile_rows: int = tiles.TILE_ROWS, far_tile_rows: int = FOREST_TILE_ROWS) -> DataFrame:
    """spanning_forest of the pairs of hash_pairs, from (id, hash, width), without a table of them.

    Rows of equal hash and width but the first are leaves of the forest. The others meet in tiles, and each two tiles
    give out the forest of their own pairs alone: what is not in that is not in the whole one. At first only pairs at a
    tight threshold count, at which most rows have a few links. They mostly make one large component; the rows outside
    it then meet all rows, for their links to other components. If it is not that large, a next threshold comes
    between. Thresholds come from a sample, which bears on the work alone; how few rows there are outside, too.
    """
    rows = materialize(hashes.filter("id is not null and hash is not null and width is not null").select("id", "hash", F.col("width").cast("double").alias("width")), "forest-rows")
    kind = rows.schema["id"].dataType.simpleString()
    schema, least = f"u {kind}, v {kind}, id_a {kind}, id_b {kind}, weight double", least_product(threshold)
    several, leaves = _leaves(rows, least_width_ratio)
    forest = materialize(leaves if least <= BITS else leaves.limit(0), "forest")
    placed = materialize(several.withColumn("component", F.col("id")), "forest-placed")
    discard(rows)
    outside, n, n_outside = placed, placed.count(), None
    while True:
        level = least if n_outside is not None and n_outside * _FEW_OUTSIDE <= n else max(least, _next_product(outside, placed, least, least_width_ratio, links_a_row, tile_rows, far_tile_rows))
        kernel = _forest_kernel(level, least_width_ratio)
        if n_outside is None:
            found = tiles.self_pairs(placed, kernel, schema, tile_rows=tile_rows)
        else:
            found = tiles.cross_pairs(outside, placed, kernel, schema, tile_rows=tile_rows, right_tile_rows=far_tile_rows)
        taken = materialize(_spanning(found), "forest")
        forest = forest.unionByName(taken)
        if level <= least:
            discard(placed)
            return forest
        ends = lambda x: placed.select(F.col("id").alias(f"id_{x}"), F.col("component").alias(x))
        joined = connected_components(taken.join(ends("a"), "id_a").join(ends("b"), "id_b"), "a", "b").select(F.col("node").alias("component"), F.col("component").alias("_into"))
        before, placed = placed, materialize(splittable_join(placed, joined, ["component"], "left").select("id", "hash", "width", F.coalesce("_into", "component").alias("component")), "forest-placed")
        discard(before)
        core = materialize(placed.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component"), "forest-core")
        outside = placed.join(core, "component", "left_anti").select(placed.columns)
        n_outside = outside.count()


def _leaves(rows: DataFrame, least_width_ratio: float) -> tuple[DataFrame, DataFrame]:
    """(rows without the later ones of equal hash and width, edges of those).

    Each later one is alike to whom the first is. So whatever links it to another but the first of all that have its
    hash and a width that goes with it closes a ring of edges that come before, and it is a leaf at that one.
    Rows whose width doesn't go with itself are all left.
    """
    own = F.coalesce(F.try_divide("width", "width") == 1.0, F.lit(False))
    first = rows.filter(own).groupBy("hash", "width").agg(F.min("id").alias("id"), F.max("id").alias("_last"))
    left = materialize(first.select("id", "hash", "width", "_last").unionByName(rows.filter(~own).withColumn("_last", F.col("id"))), "forest-rows")
    ratio = F.least(F.try_divide("width", "_width"), F.try_divide("_width", "width"))
    other = left.filter(~F.isnan("width")).select("hash", F.col("width").alias("_width"), F.col("id").alias("_first"))
    to = left.filter("_last > id").select("id", "hash", "width").join(other, "hash").filter(ratio >= least_width_ratio).groupBy("hash", "width").agg(F.min("_first").alias("id_a"))
    later = splittable_join(rows.filter(own), first.filter("_last > id").select("hash", "width", F.col("id").alias("_first")), ["hash", "width"]).filter("id > _first").distinct()
    edges = splittable_join(later, to, ["hash", "width"]).select("id_a", F.col("id").alias("id_b"), F.lit(1.0).alias("weight"))
    return left.select("id", "hash", "width"), edges


def _next_product(outside: DataFrame, placed: DataFrame, least: int, least_width_ratio: float, links_a_row: float, tile_rows: int, far_tile_rows: int) -> int:
    """The greatest product at which most of a sample of the rows outside have links_a_row links to other components; least if there is none."""
    kind = placed.schema["id"].dataType.simpleString()

    def kernel(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        (a, wide_a), (b, wide_b) = hash_arrays(left), hash_arrays(right)
        _, of_a, of_b = _coded(left["component"], right["component"])
        n = np.zeros((len(a), BITS + 1), np.int64)
        for rows in tiles.chunks(len(a), len(b)):
            product = a[rows] @ b.T
            i, j = np.nonzero(product >= max(0, least))
            fine = (of_a[i + rows.start] != of_b[j]) & (_pair_ratio(wide_a[i + rows.start], wide_b[j]) >= least_width_ratio)
            i, j = i[fine], j[fine]
            n[rows] += np.bincount(i * (BITS + 1) + product[i, j].astype(int), minlength=(rows.stop - rows.start) * (BITS + 1)).reshape(-1, BITS + 1)
        i, at = np.nonzero(n)
        return pa.table([left["id"].take(pa.array(i, pa.int64())), pa.array(at), pa.array(n[i, at])], names=["id", "product", "n"])

    sample = materialize(outside.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS), "forest-sample")
    counts = tiles.cross_pairs(sample, placed, kernel, "id " + kind + ", product long, n long", tile_rows=tile_rows, right_tile_rows=far_tile_rows).groupBy("id", "product").agg(F.sum("n").alias("n"))
    links = F.sum("n").over(Window.partitionBy("id").orderBy(F.desc("product")))
    levels = counts.withColumn("links", links).filter(F.col("links") >= links_a_row).groupBy("id").agg(F.max("product").alias("product"))
    wanted, rows_at = _SAMPLE_SHARE * sample.count(), {r["product"]: r["n"] for r in levels.groupBy("product").agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    discard(sample)
    seen = 0
    for product in sorted(rows_at, reverse=True):
        seen += rows_at[product]
        if seen >= wanted:
            return product
    return least


def _forest_kernel(least: int, least_width_ratio: float) -> tiles.Kernel:
    """The maximum spanning forest of the components of two tiles by the pairs between these: fewer edges than there are components."""

    def kernel(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        (a, wide_a), (b, wide_b) = hash_arrays(left), hash_arrays(right)
        names, of_a, of_b = _coded(left["component"], right["component"])
        ids, id_a, id_b = _coded(left["id"], right["id"])
        parts, n_parts = [np.empty((3, 0), np.int64)], 0
        for rows in tiles.chunks(len(a), len(b)):
            product = a[rows] @ b.T
            i, j = np.nonzero(product >= least)
            lighter = BITS - product[i, j].astype(np.int64)
            i += rows.start
            fine = (of_a[i] != of_b[j]) & (_pair_ratio(wide_a[i], wide_b[j]) >= least_width_ratio)
            if same:  # each two rows once
                fine &= j > i
            i, j, lighter = i[fine], j[fine], lighter[fine]
            x, y = np.minimum(id_a[i], id_b[j]), np.maximum(id_a[i], id_b[j])
            key = (lighter * len(ids) + x) * len(ids) + y  # best first: heaviest, then by the ids
            parts.append(np.stack([key, of_a[i], of_b[j]]))
            n_parts += len(key)
            if n_parts > _KEPT_EDGES:
                parts = [_forest_of(np.concatenate(parts, axis=1), len(names))]
                n_parts = 0
        key, u, v = _forest_of(np.concatenate(parts, axis=1), len(names))
        key, y = np.divmod(key, max(1, len(ids)))
        lighter, x = np.divmod(key, max(1, len(ids)))
        columns = [values.take(pa.array(at, pa.int64())) for values, at in ((names, u), (names, v), (ids, x), (ids, y))]
        return pa.table([*columns, pa.array((BITS - lighter) / (2 * BITS) + 0.5)], names=["u", "v", "id_a", "id_b", "weight"])

    return kernel


def _forest_of(edges: np.ndarray, nodes: int) -> np.ndarray:
    """Of edges (key, u, v), the columns of a matrix, those of the forest of least keys; no two edges have a key in common."""
    edges = edges[:, np.argsort(edges[0])]
    _, u, v = edges
    root, open_, taken = np.arange(nodes), np.arange(len(u)), []
    while True:
        open_ = open_[root[u[open_]] != root[v[open_]]]
        if not len(open_):
            return edges[:, np.sort(np.concatenate(taken))] if taken else edges[:, :0]
        best = np.full(nodes, len(u))
        np.minimum.at(best, root[u[open_]], open_)
        np.minimum.at(best, root[v[open_]], open_)
        best = np.unique(best[best < len(u)])
        taken.append(best)
        root = _united(root, u[best], v[best])


def components_at(forest: DataFrame, threshold: float) -> DataFrame:
    """(node, component) of all edges of at least the threshold, from the forest alone: it holds a best path between any two nodes."""
    return connected_components(forest.filter(F.col("weight") >= threshold), "id_a", "id_b")


def merge_levels(forest: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, n_links, weakest): how many links hold at each of a few thresholds; each one more makes one component less."""
    levels = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    return forest.select("weight", levels).filter("weight >= threshold").groupBy("threshold").agg(F.count("*").alias("n_links"), F.min("weight").alias("weakest"))
