"""Similarity joins over hashes, embeddings and texts.

All rows are compared. Tight thresholds go by bands: hashes that differ in d bits at most agree in one of d + 1 bands,
so only those that do are compared. Wide ones, for which nearly every pair would share a band, go by tiles alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lightsieve.operators import tiles
from lightsieve.operators.leaders import Alike
from lightsieve.session import materialize

BITS = 64
BUCKET_ROWS = 1000
_CHUNK_PAIRS = 1 << 17  # so that a chunk stays in a core's cache
_BATCH_PAIRS = 1 << 16


def sign_bits(embedding: Column) -> Column:
    """The signs of the first 64 dimensions as a signed long; bit i is set when dimension i is above 0."""
    flags = F.transform(F.slice(embedding, 1, BITS), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(flags, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_similarity(a: Column, b: Column) -> Column:
    return 1 - hamming(a, b) / F.lit(float(BITS))


def cosine(a: Column, b: Column) -> Column:
    """In doubles; 0 when either side is null or has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(length > 0, dot(a, b) / length), F.lit(0.0))


def hash_pairs(hashes: DataFrame, threshold: float, least_width_ratio: float = 0.5, tile_rows: int = tiles.TILE_ROWS) -> DataFrame:
    """(id_a, id_b, similarity) of all similar pairs, the first in rank order as id_a, from (id, rank, hash, width).

    Exact over all rows, in tiles. rank may be of any ordered type; null hashes are similar to none.
    """

    def kernel(left: pa.Table, right: pa.Table, same: bool) -> Iterator[pa.Table]:
        a, b = tiles.sign_matrix(left["hash"]), tiles.sign_matrix(right["hash"])
        found = tiles.found_where(left, right, same, lambda rows: ((a[rows] @ b.T).astype(float) / (2 * BITS) + 0.5,), lambda s: s >= threshold)
        return tiles.pair_tables(left, right, found, ["id_a", "id_b", "similarity"])

    kind = hashes.schema["id"].dataType.simpleString()
    rows = hashes.filter("hash is not null")
    near = tiles.self_pairs(rows.select("id", "hash"), kernel, f"id_a {kind}, id_b {kind}, similarity double", tile_rows=tile_rows)
    side = lambda s: rows.select(F.col("id").alias(f"id_{s}"), F.col("rank").alias(f"rank_{s}"), F.col("width").alias(f"width_{s}"))
    both = near.join(side("a"), "id_a").join(side("b"), "id_b")
    widths = F.least(F.col("width_a") / F.col("width_b"), F.col("width_b") / F.col("width_a"))
    first = F.col("rank_a") < F.col("rank_b")
    return both.filter(widths >= least_width_ratio).select(F.when(first, F.col("id_a")).otherwise(F.col("id_b")).alias("id_a"), F.when(first, F.col("id_b")).otherwise(F.col("id_a")).alias("id_b"), "similarity")


def least_product(threshold: float) -> int:
    """The least product of two rows of signs whose similarity reaches the threshold; 65 if none does."""
    return next((d for d in range(-BITS, BITS + 1) if d / (2 * BITS) + 0.5 >= threshold), BITS + 1)


def width_ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smaller of each two widths by the larger one; not a number where one is missing."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.minimum(a[:, None] / b[None, :], b[None, :] / a[:, None])


def hash_arrays(rows: pa.Table) -> tuple[np.ndarray, ...]:
    """(signs, widths)."""
    return tiles.sign_matrix(rows["hash"]), rows["width"].cast(pa.float64()).to_numpy()


def alike_hashes(threshold: float, least_width_ratio: float = 0.5) -> Alike:
    """The pairs of hash_pairs, for rows with hash and width; hashes are not null."""
    least = least_product(threshold)
    return Alike(["hash", "width"], hash_arrays, lambda a, b: (a[0] @ b[0].T >= least) & (width_ratio(a[1], b[1]) >= least_width_ratio))


def _vector_arrays(rows: pa.Table) -> tuple[np.ndarray, ...]:
    return tiles.padded(rows["vector"])


def alike_vectors(threshold: float) -> Alike:
    """The pairs of cosine_pairs, for rows with a vector that is not null."""
    return Alike(["vector"], _vector_arrays, lambda a, b: (a[0] @ b[0].T >= threshold) & (a[1][:, None] == b[1][None, :]) if len(a[0]) and a[0].shape[1] == b[0].shape[1] else _unequal(a, b, threshold))


def _unequal(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], threshold: float) -> np.ndarray:
    """Two sides whose longest vectors are not equally long."""
    size = min(a[0].shape[1], b[0].shape[1])
    return (a[0][:, :size] @ b[0][:, :size].T >= threshold) & (a[1][:, None] == b[1][None, :])


def band_masks(most_differing: int, rows: int) -> list[int]:
    """most_differing + 1 masks of different bits: whoever differs in most_differing bits at most agrees in one of them.

    A mask has as many bits as leave about BUCKET_ROWS of so many rows to one of its values, if there are so many bits.
    """
    bands = most_differing + 1
    size = min(BITS // bands, max(0, math.ceil(math.log2(max(1, rows) / BUCKET_ROWS))))
    return [((1 << size) - 1) << (size * k) for k in range(bands)] if size else [0]


def banded_pairs(hashes: DataFrame, most_differing: int, tile_rows: int = tiles.TILE_ROWS) -> DataFrame:
    """(hash_a, hash_b, differing) of different hashes, hash_a < hash_b, that differ in most_differing bits at most.

    Pairs of hash values, so that copies of a hash, however many, count once; join the rows back by hash; nulls are in
    no pair. A hash is dealt to its value in each band and meets the others there in tiles, so a bucket of many close
    hashes is bounded as well. A pair leaves the first band in which it agrees alone, so pairs are never shuffled.
    Spark takes rows that are dealt to bands for as few as the hashes and would broadcast them through the driver, so
    the hint has them shuffled.
    """
    distinct = materialize(hashes.select("hash").filter("hash is not null").distinct(), "hashes")
    masks = band_masks(most_differing, distinct.count())
    own = np.array(masks, np.uint64)

    def kernel(left: pa.Table, right: pa.Table, same: bool) -> Iterator[pa.Table]:
        a, b = (np.sort(t["id"].to_numpy()) for t in (left, right))
        band, kept, n_kept = left["_key"][0].as_py()["band"] if len(a) else 0, [], 0
        step = max(1, _CHUNK_PAIRS // max(1, len(b)))
        for begin in range(0, len(a), step):
            rows = a[begin : begin + step]
            apart = (rows[:, None] ^ b[None, :]).view(np.uint64)
            near = np.bitwise_count(apart) <= most_differing
            if same:  # each two rows once
                near &= np.arange(len(b))[None, :] > np.arange(begin, begin + len(rows))[:, None]
            i, j = np.nonzero(near)
            apart = apart[i, j]
            first = np.ones(len(i), bool)
            for mask in own[:band]:
                first &= (apart & mask) != 0
            x, y = rows[i[first]], b[j[first]]
            kept.append(pa.table([np.minimum(x, y), np.maximum(x, y), np.bitwise_count(apart[first]).astype(np.int32)], names=["hash_a", "hash_b", "differing"]))
            n_kept += len(x)
            if n_kept >= _BATCH_PAIRS:
                yield pa.concat_tables(kept)
                kept, n_kept = [], 0
        if kept:
            yield pa.concat_tables(kept)

    signed = lambda m: F.lit(m - (1 << BITS) if m >> (BITS - 1) else m).cast("long")
    bands = F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col("hash").bitwiseAND(signed(m)).alias("bits")) for k, m in enumerate(masks)])).alias("b")
    dealt = distinct.select(F.col("hash").alias("id"), bands).select("id", "b.band", "b.bits")
    return tiles.self_pairs(dealt.hint("merge"), kernel, "hash_a long, hash_b long, differing int", ["band", "bits"], tile_rows)


def token_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash): each bit of a document is the majority over the first 64 bits of its tokens' MD5.

    Two counters share a long, so 32 sums do; a document may have up to 2 ** 31 tokens.
    """
    tokens = docs.select(F.col(id_col).alias("id"), F.explode(F.split(text_col, " ")).alias("t")).select("id", F.md5(F.col("t").cast("binary")).alias("m"))
    half = lambda at: F.conv(F.substring("m", at, 8), 16, 10).cast("long")
    bits = tokens.select("id", F.shiftleft(half(1), 32).bitwiseOR(half(9)).alias("h"))
    votes = bits.groupBy("id").agg(F.count("*").alias("n"), *[F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(0x1_0000_0001))).alias(f"s{i}") for i in range(BITS // 2)])
    packed = F.lit(0).cast("long")
    for i in range(BITS):
        count = F.col(f"s{i}").bitwiseAND(F.lit(0xFFFF_FFFF)) if i < 32 else F.shiftrightunsigned(f"s{i - 32}", 32)
        packed = packed.bitwiseOR(F.when(count * 2 > F.col("n"), F.lit((1 << i) if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long"))
    return votes.select("id", packed.alias("hash"))


def cosine_pairs(vectors: DataFrame, threshold: float, keys: list[str] | None = None, tile_rows: int = tiles.TILE_ROWS) -> DataFrame:
    """(id_a, id_b, cosine) of all pairs of equal keys, id_a < id_b, exact and in tiles; null vectors are similar to none."""

    def kernel(left: pa.Table, right: pa.Table, same: bool) -> Iterator[pa.Table]:
        a, b = tiles.unit(tiles.matrix(left["vector"])), tiles.unit(tiles.matrix(right["vector"]))
        found = tiles.found_where(left, right, same, lambda rows: (a[rows] @ b.T,), lambda s: s >= threshold)
        return tiles.pair_tables(left, right, found, ["id_a", "id_b", "cosine"])

    kind = vectors.schema["id"].dataType.simpleString()
    rows = vectors.filter("vector is not null").select("id", "vector", *(keys or []))
    near = tiles.self_pairs(rows.withColumn("_size", F.size("vector")), kernel, f"id_a {kind}, id_b {kind}, cosine double", [*(keys or []), "_size"], tile_rows)
    return near.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "cosine")


def mutual_nearest(left: DataFrame, right: DataFrame, tile_rows: int = tiles.TILE_ROWS) -> DataFrame:
    """(id_a, id_b, cosine): pairs where each is the other's nearest; ties (to 12 digits) go to the smaller id.

    A tile gives out the best partner of each of its rows, and the best of those is an aggregate: no pairs are ranked.
    """

    def kernel(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        left, right = left.sort_by("id"), right.sort_by("id")
        a, b = tiles.unit(tiles.matrix(left["vector"])), tiles.unit(tiles.matrix(right["vector"]))
        if not len(a) or not len(b):
            return pa.table({"side": pa.array([], pa.int32()), "id": left["id"].slice(0, 0), "other": left["id"].slice(0, 0), "cosine": pa.array([], pa.float64())})
        best_b, value_b = np.empty(len(a), int), np.empty(len(a))
        best_a, value_a = np.zeros(len(b), int), np.full(len(b), -2.0)
        for rows in tiles.chunks(len(a), len(b)):
            s = np.round(a[rows] @ b.T, 12)
            best_b[rows], value_b[rows] = s.argmax(axis=1), s.max(axis=1)
            better = s.max(axis=0) > value_a
            best_a[better], value_a[better] = s.argmax(axis=0)[better] + rows.start, s.max(axis=0)[better]
        own = pa.chunked_array([*left["id"].chunks, *right["id"].chunks])
        other = pa.chunked_array([*right["id"].take(pa.array(best_b)).chunks, *left["id"].take(pa.array(best_a)).chunks])
        return pa.table([pa.array(np.repeat([0, 1], [len(a), len(b)]), pa.int32()), own, other, pa.array(np.concatenate([value_b, value_a]))], names=["side", "id", "other", "cosine"])

    kind = left.schema["id"].dataType.simpleString()
    rows = lambda df: df.filter("vector is not null").select("id", "vector", F.size("vector").alias("_size"))
    best = tiles.cross_pairs(rows(left), rows(right), kernel, f"side int, id {kind}, other {kind}, cosine double", ["_size"], tile_rows)
    # of equal cosines the smallest other id: the greatest cosine first, then the least id among those that have it
    top = best.groupBy("side", "id").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "other")).alias("t")).select("side", "id", "t.other", (-F.col("t.c")).alias("cosine"))
    a = top.filter("side = 0").select(F.col("id").alias("id_a"), F.col("other").alias("id_b"), "cosine")
    b = top.filter("side = 1").select(F.col("other").alias("id_a"), F.col("id").alias("id_b"))
    return a.join(b, ["id_a", "id_b"])


def without_near(new: DataFrame, existing: DataFrame, most_differing: int, tile_rows: int = tiles.TILE_ROWS) -> DataFrame:
    """Rows of new with no existing hash within most_differing bits."""

    def kernel(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        a, b = tiles.sign_matrix(left["hash"]), tiles.sign_matrix(right["hash"])
        near = np.zeros(len(a), bool)
        if len(b):
            for rows in tiles.chunks(len(a), len(b)):
                near[rows] = (a[rows] @ b.T).max(axis=1) >= BITS - 2 * most_differing
        return pa.table([left["id"].filter(pa.array(near))], names=["id"])

    kind = new.schema["id"].dataType.simpleString()
    rows = lambda df: df.filter("hash is not null").select("id", "hash")
    near = tiles.cross_pairs(rows(new), rows(existing), kernel, f"id {kind}", tile_rows=tile_rows).distinct()
    return new.join(near, "id", "left_anti")


WORD_CHUNKS = (1 << 14, 1 << 7)  # a place in a string is found from its start, so long words are cut twice
GRAMS = (1, 2, 4, 8, 16)


def containing(docs: DataFrame, items: DataFrame, text_col: str = "text", item_text: str = "text", anchor_words: int = 3) -> DataFrame:
    """Documents whose text contains the text of some item, as an equi join on anchors; rows that repeat stay.

    The words of an item after its first and before its last stand in a document between the same spaces. Items with
    anchor_words such words meet documents at the first of them, shorter ones at a single word; the substring test
    decides. Items of one or two words have none: of two, the first ends a document's word, which is met by its last
    characters; one lies inside a word, which is met by grams. Both are of a few fixed lengths, so a document gives as
    many anchors as it has characters, times a constant, however long its words are. The empty item is in every text.
    """
    words = F.split(F.col(item_text), " ")
    n, size = F.size(words), F.length(item_text)
    first = F.element_at(words, 1)
    gram = F.greatest(*[F.when(size >= g, g) for g in GRAMS])
    how = F.when(size == 0, "empty").when(n >= anchor_words + 2, "many").when(n >= 3, "one").when(n == 2, "two").otherwise("part")
    anchor = F.when(n >= anchor_words + 2, F.array_join(F.slice(words, 2, anchor_words), " ")).when(n >= 3, F.element_at(words, 2)).when(n == 2, F.right(first, F.lit(GRAMS[-1]))).otherwise(F.substring(F.col(item_text), F.lit(1), gram))
    marked = items.filter(F.col(item_text).isNotNull()).select(F.col(item_text).alias("_item"), how.alias("_how"), anchor.alias("_anchor")).distinct()
    keyed = docs.filter(F.col(text_col).isNotNull()).withColumn("_row", F.monotonically_increasing_id())
    kinds = {r["_how"] for r in marked.select("_how").distinct().collect()}  # five values at most
    if "empty" in kinds:
        return keyed.select(docs.columns)
    spots = F.split(F.col(text_col), " ")
    sequences = spots  # word by word: each split array is walked once, not once a place
    for k in range(1, anchor_words):
        sequences = F.zip_with(sequences, F.slice(spots, k + 1, F.size(spots)), lambda a, b: F.concat(a, F.lit(" "), b))
    anchors = {"many": lambda: _exploded(keyed, F.filter(sequences, lambda x: x.isNotNull())), "one": lambda: _exploded(keyed, spots), "two": lambda: _suffixes(keyed, spots), "part": lambda: _word_grams(keyed, spots)}
    found = None
    for kind in sorted(kinds):
        met = anchors[kind]().join(marked.filter(F.col("_how") == kind), "_anchor").select("_row", "_item").distinct()
        found = met if found is None else found.unionByName(met)
    if found is None:
        return docs.limit(0)
    inside = keyed.select("_row", text_col).join(found, "_row").filter(F.contains(F.col(text_col), F.col("_item"))).select("_row").distinct()
    return keyed.join(inside, "_row", "left_semi").select(docs.columns)


def _exploded(keyed: DataFrame, spots: Column) -> DataFrame:
    return keyed.select("_row", F.explode(F.array_distinct(spots)).alias("_anchor"))


def _suffixes(keyed: DataFrame, spots: Column) -> DataFrame:
    """The last characters of each different word, none to as many as the longest gram has."""
    lengths = [F.when(F.length("_word") >= k, F.right("_word", F.lit(k))) for k in range(GRAMS[-1] + 1)]
    word = keyed.select("_row", F.explode(F.array_distinct(spots)).alias("_word"))
    return word.select("_row", F.explode(F.array(*lengths)).alias("_anchor")).filter("_anchor is not null").distinct()


def _word_grams(keyed: DataFrame, spots: Column) -> DataFrame:
    """Grams of the few lengths at every place of each different word; long words are cut into overlapping parts."""
    word = keyed.select("_row", F.explode(F.array_distinct(spots)).alias("_word")).filter("_word <> ''")
    part = word.withColumnRenamed("_word", "_part")
    for size in WORD_CHUNKS:
        begin = F.explode(F.sequence(F.lit(1), F.length("_part"), F.lit(size))).alias("_begin")
        part = part.select("_row", "_part", begin).select("_row", F.substring(F.col("_part"), F.col("_begin"), F.lit(size + GRAMS[-1] - 1)).alias("_part"))
    part = part.distinct()
    cut = lambda g: F.when(F.length("_part") >= g, F.transform(F.sequence(F.lit(1), F.length("_part") - g + 1), lambda i: F.substring(F.col("_part"), i, F.lit(g)))).otherwise(F.array().cast("array<string>"))
    return part.select("_row", F.explode(F.array_distinct(F.concat(*map(cut, GRAMS)))).alias("_anchor")).distinct()
