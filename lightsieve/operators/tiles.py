"""Exact all-pairs work in bounded tiles, for thresholds too wide for bands.

Rows are dealt to tiles by a hash of their id, and every two tiles of a key meet in one group that numpy multiplies
out. A key gets a tile for each ``tile_rows`` rows up to TILES of them, enough to keep a cluster's cores busy; beyond
that its tiles grow, up to ``most_rows`` rows, since every row is sent to as many groups as its key has tiles. A group
never holds more than two tiles, whatever a key's share of the rows, and gives out only what its kernel keeps. A key's work grows with the square of its rows, as any exact comparison of
all pairs does; the tiles spread it evenly. Tight thresholds belong to ``similarity.banded_pairs``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE_ROWS = 4000
TILES = 64
#: rows of 64 bits take 256 bytes in a kernel, a vector of 64 numbers 512
MOST_ROWS = 1 << 16
_CHUNK_PAIRS = 4 << 20
_BATCH_ROWS = 1 << 16

#: (left rows, right rows, whether both are the same tile) to the rows that the group gives out, as one table or in parts
Kernel = Callable[[pa.Table, pa.Table, bool], pa.Table | Iterator[pa.Table]]


def _with_tiles(rows: DataFrame, keys: list[str], tile_rows: int, most_rows: int) -> DataFrame:
    """Adds the row's tile and the number of tiles of its key."""
    few = F.least(F.ceil(F.count("*") / tile_rows), F.lit(TILES))
    counts = rows.groupBy(*keys).agg(F.greatest(F.lit(1), few, F.ceil(F.count("*") / most_rows)).cast("int").alias("_tiles"))
    return rows.join(counts, keys).withColumn("_tile", F.pmod(F.xxhash64(F.col("id")), F.col("_tiles")).cast("int"))


def _run(dealt: DataFrame, keys: list[str], kernel: Kernel, schema: str, same_side: bool) -> DataFrame:
    """Groups are of a struct of the keys: by the keys alone, Spark leaves all tiles of a key in the task where the join with the key's counts has put them."""

    def meet(batches):
        part = pa.Table.from_batches(batches)
        side = part["_side"].to_numpy()
        left, right = part.filter(pa.array(side == 0)), part.filter(pa.array(side == 1))
        same = same_side and part["_a"][0].as_py() == part["_b"][0].as_py()
        found = kernel(left, left if same else right, same)
        for table in [found] if isinstance(found, pa.Table) else found:
            yield from table.combine_chunks().to_batches(max_chunksize=_BATCH_ROWS)

    meet.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return dealt.withColumn("_key", F.struct(*keys)).drop(*keys).groupBy("_key", "_a", "_b").applyInArrow(meet, schema)


def self_pairs(rows: DataFrame, kernel: Kernel, schema: str, keys: list[str] | None = None, tile_rows: int = TILE_ROWS, most_rows: int = MOST_ROWS) -> DataFrame:
    """Each two rows of equal keys meet once. rows: (id, keys, what the kernel reads); rows with a null key meet none."""
    rows, keys = _keyed(rows, keys)
    tiled = _with_tiles(rows, keys, tile_rows, most_rows)
    other = F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_other")
    dealt = tiled.select("*", other).select(*rows.columns, F.least("_tile", "_other").alias("_a"), F.greatest("_tile", "_other").alias("_b"), (F.col("_tile") > F.col("_other")).cast("int").alias("_side"))
    return _run(dealt, keys, kernel, schema, True)


def cross_pairs(left: DataFrame, right: DataFrame, kernel: Kernel, schema: str, keys: list[str] | None = None, tile_rows: int = TILE_ROWS, most_rows: int = MOST_ROWS, right_tile_rows: int | None = None) -> DataFrame:
    """Each row of left meets each row of right of equal keys once; both have the same columns. ``right_tile_rows``: for another size of the right tiles."""
    left, names = _keyed(left, keys)
    right, names = _keyed(right.select(*[c for c in left.columns if c != "_all"]), keys)
    a, b = _with_tiles(left, names, tile_rows, most_rows), _with_tiles(right, names, right_tile_rows or tile_rows, most_rows)
    n_a, n_b = (x.select(*names, F.col("_tiles").alias("_n")).distinct() for x in (a, b))
    columns = left.columns
    to_b = a.join(n_b, names).select(*columns, F.col("_tile").alias("_a"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_b"), F.lit(0).alias("_side"))
    to_a = b.join(n_a, names).select(*columns, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_a"), F.col("_tile").alias("_b"), F.lit(1).alias("_side"))
    return _run(to_b.unionByName(to_a), names, kernel, schema, False)


def _keyed(rows: DataFrame, keys: list[str] | None) -> tuple[DataFrame, list[str]]:
    return (rows, keys) if keys else (rows.withColumn("_all", F.lit(0)), ["_all"])


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of equally long vectors as doubles; those of another length than the first are zeros."""
    array = vectors.combine_chunks()
    array = array.chunk(0) if isinstance(array, pa.ChunkedArray) else array
    if not len(array):
        return np.zeros((0, 0))
    sizes = array.value_lengths().to_numpy(zero_copy_only=False)
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (sizes == sizes[0]).all():
        return flat.reshape(len(array), -1)
    out = np.zeros((len(array), int(sizes[0])))
    ends = np.cumsum(sizes)
    for i in np.flatnonzero(sizes == sizes[0]):
        out[i] = flat[ends[i] - sizes[i] : ends[i]]
    return out


def padded(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors as doubles of length 1 with zeros behind them, their sizes)."""
    array = vectors.combine_chunks()
    array = array.chunk(0) if isinstance(array, pa.ChunkedArray) else array
    sizes = array.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return unit(out), sizes


def sign_matrix(hashes: pa.ChunkedArray) -> np.ndarray:
    """64-bit hashes as rows of -1 and 1: a product of two rows is 64 less twice the differing bits."""
    bits = np.unpackbits(hashes.to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.float32) * 2 - 1


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows without length stay zero."""
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def chunks(n: int, others: int):
    """Slices of n rows, each of which gives some million pairs with the others at most."""
    step = max(1, min(1024, _CHUNK_PAIRS // max(1, others)))
    return (slice(i, min(i + step, n)) for i in range(0, n, step))


def found_where(left: pa.Table, right: pa.Table, same: bool, values: Callable[[slice], tuple], keep: Callable[..., np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(rows of left, rows of right, values) of the kept pairs, chunk by chunk. values(rows of left) gives matrices, one row each."""
    for rows in chunks(left.num_rows, right.num_rows) if right.num_rows else ():
        mats = values(rows)
        mask = keep(*mats)
        if same:  # each two rows once
            mask &= np.arange(right.num_rows)[None, :] > np.arange(rows.start, rows.stop)[:, None]
        a, b = np.nonzero(mask)
        yield a + rows.start, b, [m[a, b] for m in mats]


def pairs_where(left: pa.Table, right: pa.Table, same: bool, values: Callable[[slice], tuple], keep: Callable[..., np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """found_where in one piece, for kernels that keep few pairs."""
    parts = list(found_where(left, right, same, values, keep))
    if not parts:
        return np.empty(0, int), np.empty(0, int), []
    found_a, found_b, found = zip(*parts)
    return np.concatenate(found_a), np.concatenate(found_b), [np.concatenate(x) for x in zip(*found)]


def pair_tables(left: pa.Table, right: pa.Table, found: Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]], names: list[str]) -> Iterator[pa.Table]:
    """The ids and values of found_where, under names, a table a chunk."""
    for i, j, values in found:
        yield pa.table([left["id"].take(pa.array(i, pa.int64())), right["id"].take(pa.array(j, pa.int64())), *(pa.array(x, pa.float64()) for x in values)], names=names)
