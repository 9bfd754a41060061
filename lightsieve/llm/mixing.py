"""Mixing sources to target weights by systematic sampling, with built-in functions only.

Within a source every document expects target / size copies. The running sum of the expected copies, plus one
random offset for the source, crosses an integer boundary once for each copy that is emitted. Documents are laid
out by size, so that the words taken come near the target too. The running sum is a rank times a constant, and
the rank is added up from counts of small blocks; no window ever holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lightsieve.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3


def hash32(value: Column) -> Column:
    """The first 32 bits of the MD5, as a long; the same in any SQL engine."""
    return F.conv(F.substring(F.md5(value.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Adds weight and target to (source, source_size): all sizes are shared by weight, none above 3 times its own.

    Sources that reach their bound first are those of the least bound for their weight; after sorting by it, what
    is left for the others is a running difference. One row a source, so the windows over all sources stay small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*map(F.lit, WEIGHTS))
    ranked = sizes.withColumn("weight", F.element_at(weights, ((F.row_number().over(order) - 1) % len(WEIGHTS)).cast("int") + 1)).withColumn("bound", F.col("source_size") * MOST_COPIES)
    by_bound = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    left = (
        ranked.withColumn("left_size", F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    share = F.col("left_size").cast("double") * F.col("weight") / F.col("left_weight")
    level = left.withColumn("capped", share >= F.col("bound"))
    # the first source under its bound sets the level of all that follow
    first = F.min(F.when(~F.col("capped"), F.struct((F.col("bound") / F.col("weight")).alias("r"), F.col("source").isNull().alias("n"), F.col("source").alias("s"), "left_size", "left_weight"))).over(everything)
    return level.withColumn("f", first).select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("capped"), F.col("bound").cast("double")).otherwise(F.col("f.left_size").cast("double") * F.col("weight") / F.col("f.left_weight")).alias("target"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, rows_per_block: int = 1000) -> DataFrame:
    """(id_col, source, size, source_size, target, copies, taken), one row for each input row.

    Null texts and texts without words have size 0 and take nothing, whatever their copies. The null source is a
    source of its own, the last one. Rows that repeat an id are separate documents; they follow each other in the
    layout. An empty table gives no rows. Other columns are ignored. Reruns agree: the offset of a source is a hash
    of its name and ``seed``.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")), "sizes")
    by_size = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "by-size")

    # ranks before each size of a source: as many rows as a source has different sizes
    of_source = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    slices = F.greatest(F.lit(1), F.ceil(F.col("n") / rows_per_block)).cast("long")
    steps = by_size.withColumn("before_size", F.coalesce(F.sum("n").over(of_source), F.lit(0))).withColumn("slices", slices)
    wanted = targets(by_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")))

    # rows of one source and size are cut into slices of their hash, about rows_per_block rows each
    placed = (
        _join(rows, steps, ["source", "size"])
        .withColumn("hash", hash32(F.col("id")))
        .withColumn("slice", F.floor(F.col("hash") * F.col("slices") / F.lit(1 << 32)).cast("long"))
    )
    blocks = placed.groupBy("source", "size", "slice").agg(F.count("*").alias("n_slice"))
    of_size = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("before_slice", F.coalesce(F.sum("n_slice").over(of_size), F.lit(0))).drop("n_slice")
    in_slice = Window.partitionBy("source", "size", "slice").orderBy("hash", "id")
    ranked = _join(placed.withColumn("rn", F.row_number().over(in_slice)), offsets, ["source", "size", "slice"])
    ranked = _join(ranked, F.broadcast(wanted) if wanted.limit(100_001).count() <= 100_000 else wanted, ["source"])

    rank = F.col("before_size") + F.col("before_slice") + F.col("rn")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(expected)
    part = expected - whole
    offset = hash32(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("")))) / F.lit(float(1 << 32))
    crossed = F.floor(offset + part * rank) - F.floor(offset + part * (rank - 1))
    copies = (whole + crossed).cast("long")
    return ranked.withColumn("copies", copies).select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that takes null keys as equal; the keys stay once."""
    renamed = right.select(*[F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = left.join(renamed, on[0] if len(on) == 1 else on, "inner")
    return joined.drop(*[f"_{k}" for k in keys])
