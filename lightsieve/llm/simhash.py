"""SimHash near-duplicates through covering locality-sensitive hashing.

Each of the 64 bit positions gets a nonzero vector of radius + 1 bits. A table stands for one nonzero vector v and
keeps the positions whose vector has an odd inner product with v. For up to ``radius`` differing positions some v
is orthogonal to all of their vectors, so that table masks every difference: the pair shares a bucket for certain.

Buckets are not expanded into pairs. Two fingerprints differ in two bits or fewer exactly when they have a common
neighbour one flip or less away from both, so within the buckets each fingerprint announces itself and its one-flip
neighbours in the masked positions. At most 65 fingerprints can meet at such a neighbour, whatever the bucket holds,
and all of them are linked, which is the exact check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lightsieve.operators.components import connected_components
from lightsieve.operators.skew import splittable_join
from lightsieve.session import materialize

BITS = 64
RADIUS = 2
SEED = 42


def shingle_hashes(text: bytes, shingle_words: int = 3) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased text; bytes.lower and bytes.split know ASCII only, as is wanted."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle_words + 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[b:e], SEED) for b, e in zip(begins[:n].tolist(), ends[shingle_words - 1 :].tolist())), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """As a signed 64-bit number. A bit is set when more than half of the hashes have it."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(id, fp), one row for each input row; null texts have no words and fingerprint 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), shingle_words)) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(fps, pa.int64())], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fp long")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """2 ** (radius + 1) - 1 masks, one a table; the vectors of the positions are dealt round."""
    vectors = range(1, 1 << (radius + 1))
    return [sum(1 << i for i in range(BITS) if (vectors[i % len(vectors)] & v).bit_count() % 2) for v in vectors]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def links(fps: DataFrame) -> DataFrame:
    """(src, dst): links that connect the distinct fingerprints ``fp`` of RADIUS or fewer differing bits."""
    masks = covering_masks()
    tables = F.array(*[F.struct(F.lit(t).alias("table"), F.lit(_signed(m)).alias("mask")) for t, m in enumerate(masks)])
    dealt = fps.select("fp", F.explode(tables).alias("t")).select("fp", "t.table", F.col("fp").bitwiseAND(F.col("t.mask")).alias("bucket"))
    shared = dealt.groupBy("table", "bucket").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    members = splittable_join(dealt, shared, ["table", "bucket"])
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in masks])
    meeting = members.select("fp", F.explode(F.element_at(flips, F.col("table") + 1)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    met = meeting.groupBy("at").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    return met.select(F.array_min("fps").alias("src"), F.explode("fps").alias("dst")).filter("src <> dst").distinct()


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(id_col, fingerprint, component_id), one row for each input row.

    component_id is the smallest id among the documents that links reach, itself included; null only where none of
    them has an id. Texts without words, null ones included, have fingerprint zero and are linked with each other.
    Fewer words than a shingle make one shingle. Rows that repeat an id are documents of their own with that id.
    An empty table gives no rows. Other columns are ignored.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    component = connected_components(links(distinct.select("fp")))
    placed = distinct.join(component, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = splittable_join(placed, named, ["component"]).select("fp", "component_id")
    return splittable_join(marked, of_fp, ["fp"]).select(F.col("id").alias(id_col), hex64(F.col("fp")).alias("fingerprint"), "component_id")
