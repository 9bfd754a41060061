"""A Bloom filter of a manifest, asked before the exact anti join of a long run.

The filter is a table of blocks, built by aggregation: a key picks a block by one hash and sets bits of it by others,
so a key is looked up in one row. Keys that miss are new for sure and never shuffled; the others, a small share of new
ones among them, meet the manifest in the exact join. All of it is built-in functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lightsieve.operators.lookup import unprocessed
from lightsieve.session import materialize

BLOCK_WORDS = 64
WORD_BITS = 64
PROBES = 6
BITS_PER_KEY = 12
#: of all blocks; larger filters are joined by shuffle on the block instead of being sent to every executor
MOST_BROADCAST_BYTES = 64 << 20


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """Places in a block, from two hashes that don't depend on the block's."""
    a, b = F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)
    step = F.lit(BLOCK_WORDS * WORD_BITS)
    return [F.pmod(F.pmod(a, step) + k * (F.pmod(b, step) + (k if k else 0)), step).cast("int") for k in range(PROBES)]


def build(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, words): the filter of the non-null keys, as many rows at most as there are blocks. Repeated keys set the same bits."""
    bit = keys.filter(F.col(key).isNotNull()).select(_block(F.col(key), blocks).alias("block"), F.explode(F.array(*_bits(F.col(key)))).alias("bit"))
    word = bit.groupBy("block", F.floor(F.col("bit") / WORD_BITS).cast("int").alias("place")).agg(F.bit_or(F.expr(f"shiftleft(1L, bit % {WORD_BITS})")).alias("word"))
    entries = F.map_from_entries(F.collect_list(F.struct("place", "word")))  # BLOCK_WORDS entries at most
    filled = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_WORDS - 1)), lambda i: F.coalesce(F.element_at(F.col("entries"), i), F.lit(0).cast("long")))
    return word.groupBy("block").agg(entries.alias("entries")).select("block", filled.alias("words"))


def _holds(words: Column, key: Column) -> Column:
    """Whether all bits of a key are set."""
    found = F.lit(True)
    for bit in _bits(key):
        word = F.element_at(words, F.floor(bit / WORD_BITS).cast("int") + 1)
        found = found & (F.call_function("getbit", word, bit % WORD_BITS) == 1)
    return found


def maybe_known(rows: DataFrame, key: str, filter_: DataFrame, blocks: int, most_bytes: int = MOST_BROADCAST_BYTES) -> DataFrame:
    """Adds ``known``: false for keys that were never put in, true for all that were and for few others; null keys are not known."""
    fits = blocks * BLOCK_WORDS * WORD_BITS // 8 <= most_bytes
    side = F.broadcast(filter_) if fits else filter_
    asked = rows.withColumn("block", _block(F.col(key), blocks)).join(side, "block", "left")
    return asked.withColumn("known", F.col("words").isNotNull() & F.coalesce(_holds(F.col("words"), F.col(key)), F.lit(False))).drop("block", "words")


def blocks_for(n_keys: int, bits_per_key: int = BITS_PER_KEY) -> int:
    return max(1, math.ceil(n_keys * bits_per_key / (BLOCK_WORDS * WORD_BITS)))


def unprocessed_filtered(rows: DataFrame, manifest: DataFrame, key: str, bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """What lookup.unprocessed gives, and the new rows that the filter let by without a shuffle are marked: (rows' columns, skipped).

    The manifest is counted, and its filter built and written, before the rows are read; these are scanned twice, and
    only keys that may be known are shuffled. Null keys are in no manifest.
    """
    blocks = blocks_for(manifest.count(), bits_per_key)
    asked = maybe_known(rows, key, materialize(build(manifest, key, blocks), "bloom"), blocks)
    new = asked.filter(~F.col("known")).drop("known").withColumn("skipped", F.lit(True))
    rest = unprocessed(asked.filter("known").drop("known"), manifest, key).withColumn("skipped", F.lit(False))
    return new.unionByName(rest)
