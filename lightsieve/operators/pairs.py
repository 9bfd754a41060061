"""Pair rules that combine several signals, matching of faces between photos, and verification of group merges."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lightsieve.operators import tiles
from lightsieve.operators.skew import splittable_join
from lightsieve.session import discard, materialize


def weighted_hash_similarity(a: Column, d: Column, w: Column) -> Column:
    """From the Hamming distances of three 64-bit hashes."""
    return 1 - (a * 0.4 + d * 0.3 + w * 0.3) / 64.0


def comprehensive_similarity(hash_sim: Column, face_sim: Column, background_sim: Column) -> Column:
    return 0.30 * hash_sim + 0.40 * face_sim + 0.30 * background_sim


def four_signals(same_face_count: Column, hash_sim: Column, face_sim: Column, feature_sim: Column, hash_min: float = 0.80, face_min: float = 0.70, feature_min: float = 0.70, joint_min: float = 0.70) -> Column:
    joint = 0.4 * hash_sim + 0.3 * face_sim + 0.3 * feature_sim
    return same_face_count & ((hash_sim >= hash_min) | (face_sim >= face_min) | (feature_sim >= feature_min) | (joint >= joint_min))


def pair_reason(hash_sim: Column, face_sim: Column, faces_verified: Column, feature_sim: Column, background_sim: Column, hash_min: float = 0.85, face_min: float = 0.70, feature_min: float = 0.70, background_min: float = 0.60) -> Column:
    """The first signal that makes a pair similar; null if none does."""
    return F.when(hash_sim >= hash_min, "hash").when((face_sim >= face_min) & faces_verified, "face").when(feature_sim >= feature_min, "feature").when(background_sim >= background_min, "background")


def signal_pairs(photos: DataFrame, rule: Callable[..., np.ndarray], tile_rows: int = tiles.TILE_ROWS) -> DataFrame:
    """(id_a, id_b, h, f, s) of the pairs of one face count that a rule of four_signals' form takes, in tiles.

    photos: (id, face_count, hash, vector, feature). h: share of equal bits; f: cosine, to 6 digits; s: 1 less the
    distance of the features (0 to 1). rule(same, h, f, s) works on matrices.
    """

    def kernel(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        (ha, va, sa), (hb, vb, sb) = ((tiles.sign_matrix(t["hash"]), tiles.unit(tiles.matrix(t["vector"])), t["feature"].to_numpy()) for t in (left, right))

        def signals(rows: slice) -> tuple[np.ndarray, ...]:
            return (ha[rows] @ hb.T).astype(float) / 128 + 0.5, np.round(va[rows] @ vb.T, 6), 1 - np.abs(sa[rows][:, None] - sb[None, :])

        i, j, found = tiles.pairs_where(left, right, same, signals, lambda h, f, s: rule(True, h, f, s)) if len(ha) and len(hb) else ([], [], ([], [], []))
        i, j = pa.array(i, pa.int64()), pa.array(j, pa.int64())
        return pa.table([left["id"].take(i), right["id"].take(j), *(pa.array(x, pa.float64()) for x in found)], names=["id_a", "id_b", "h", "f", "s"])

    kind = photos.schema["id"].dataType.simpleString()
    near = tiles.self_pairs(photos.select("id", "face_count", "hash", "vector", "feature").dropna(), kernel, f"id_a {kind}, id_b {kind}, h double, f double, s double", ["face_count"], tile_rows)
    return near.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "h", "f", "s")


def matched_faces(left: Column, right: Column, similarity: Callable[[Column, Column], Column], match_min: float = 0.85) -> Column:
    """How many left faces have a match among the right ones, each by its best."""
    best = F.transform(left, lambda a: F.array_max(F.transform(right, lambda b: similarity(a, b))))
    return F.size(F.filter(best, lambda x: x >= match_min))


def same_faces(photos: DataFrame, similarity: Callable[[Column, Column], Column], match_min: float = 0.85, share_min: float = 0.80) -> DataFrame:
    """(id_a, id_b, n_faces, matched) of the pairs of an album with equal face counts that show the same faces.

    photos: (id, album, faces array). The test is part of the join, so pairs that fail are never rows; Spark splits
    the partitions of large albums.
    """
    side = lambda s: photos.filter(F.size("faces") > 0).select(F.col("id").alias(f"id_{s}"), "album", F.size("faces").alias("n_faces"), F.col("faces").alias(f"_{s}")).alias(s)
    matched = matched_faces(F.col("_a"), F.col("_b"), similarity, match_min)
    on = (F.col("a.album") == F.col("b.album")) & (F.col("a.n_faces") == F.col("b.n_faces")) & (F.col("id_a") < F.col("id_b")) & (matched >= share_min * F.col("a.n_faces"))
    return side("a").join(side("b"), on).select("id_a", "id_b", F.col("a.n_faces").cast("long").alias("n_faces"), matched.cast("long").alias("matched"))


def greedy_matches(left: Column, right: Column, similarity: Callable[[Column, Column], Column], match_min: float = 0.70) -> Column:
    """Number of one-to-one matches: each left face in turn takes its best free right face, if that is similar enough."""

    def step(used: Column, v: Column) -> Column:
        free = F.filter(F.sequence(F.lit(1), F.size(right)), lambda j: ~F.array_contains(used, j))
        best = F.array_max(F.transform(free, lambda j: F.struct(similarity(v, F.element_at(right, j)).alias("s"), (-j).alias("j"))))
        return F.when(best["s"] >= match_min, F.array_append(used, -best["j"])).otherwise(used)

    matched = F.aggregate(left, F.array().cast("array<int>"), step)
    return F.when((F.size(left) > 0) & (F.size(right) > 0), F.size(matched)).otherwise(0)


def _samples(members: DataFrame, samples: int) -> DataFrame:
    """The first members of each group by ord; Spark keeps no more than these of a group in any task before it shuffles."""
    return members.withColumn("_rn", F.row_number().over(Window.partitionBy("group").orderBy("ord"))).filter(F.col("_rn") <= samples)


def _voters(first: DataFrame, samples: int) -> DataFrame:
    """(id, hashes of the samples): one row a group."""
    return first.groupBy(F.col("group").alias("id")).pivot("_rn", list(range(1, samples + 1))).agg(F.first("hash"))


def _vote_kernel(samples: int, least_similarity: float, ratio_min: float) -> tiles.Kernel:
    names = [str(k) for k in range(1, samples + 1)]

    def kernel(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        def side(t: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
            return [(tiles.sign_matrix(t[c].fill_null(0)), np.asarray(t[c].is_valid())) for c in names]

        a, b = side(left), side(right)

        def ratio(at: slice) -> tuple[np.ndarray]:
            yes, total = 0.0, 0.0
            for x, in_x in a:
                for y, in_y in b:
                    both = in_x[at][:, None] & in_y[None, :]
                    yes, total = yes + (both & (x[at] @ y.T >= 128 * least_similarity - 64)), total + both
            return (yes / total,)

        i, j, (found,) = tiles.pairs_where(left, right, same, ratio, lambda r: r >= ratio_min) if left.num_rows and right.num_rows else ([], [], ([],))
        return pa.table([left["id"].take(pa.array(i, pa.int64())), right["id"].take(pa.array(j, pa.int64())), pa.array(found, pa.float64())], names=["group_a", "group_b", "ratio"])

    return kernel


def _by_number(votes: DataFrame) -> DataFrame:
    return votes.select(F.least("group_a", "group_b").alias("group_a"), F.greatest("group_a", "group_b").alias("group_b"), "ratio")


def merge_votes(groups: DataFrame, least_similarity: float, samples: int = 3, ratio_min: float = 0.70, tile_rows: int = tiles.TILE_ROWS) -> DataFrame:
    """(group_a, group_b, ratio) of all pairs of groups whose samples, at most 3 x 3 a pair, agree often enough.

    groups: (group, ord, hash); a group's samples are its first members by ord. Two samples agree when enough of
    their bits do. All groups meet all groups, in tiles.
    """
    rows = _voters(_samples(groups, samples), samples)
    kind = rows.schema["id"].dataType.simpleString()
    return _by_number(tiles.self_pairs(rows, _vote_kernel(samples, least_similarity, ratio_min), f"group_a {kind}, group_b {kind}, ratio double", tile_rows=tile_rows))


def merge_groups(members: DataFrame, least_similarity: float, samples: int = 3, ratio_min: float = 0.70, tile_rows: int = tiles.TILE_ROWS) -> DataFrame:
    """(group, merged, size): the group that each group ends up in, and that one's members, when no vote passes any more.

    members: (group, ord, hash). The larger group comes first, of equal ones the smaller number. In each round the
    groups vote by their samples. A group that votes with no earlier one takes in those that vote with it; each of
    these goes to the first such group. A group that has grown draws new samples, the first of all its members, and
    votes with all others again; other votes stand. Rounds end when no vote passes. Each of them takes in one group at
    least, and they work on one row a group and its samples, never on members again: the first members of a merged
    group are among the first ones of its parts.
    """
    kind = members.schema["group"].dataType.simpleString()
    kernel, schema = _vote_kernel(samples, least_similarity, ratio_min), f"group_a {kind}, group_b {kind}, ratio double"
    sampled = materialize(_samples(members.select("group", "ord", "hash"), samples), "samples")
    sizes = materialize(members.groupBy("group").agg(F.count("*").alias("size")), "sizes")
    placed = materialize(sizes.select("group", F.col("group").alias("merged")), "merged")
    votes = materialize(_by_number(tiles.self_pairs(_voters(sampled, samples), kernel, schema, tile_rows=tile_rows)), "votes")
    while not votes.isEmpty():
        side = lambda s: sizes.select(F.col("group").alias(f"group_{s}"), F.col("size").alias(f"size_{s}"))
        a_first = F.col("size_a") >= F.col("size_b")  # group_a is the smaller number
        pairs = votes.join(side("a"), "group_a").join(side("b"), "group_b").select(
            F.when(a_first, F.col("group_a")).otherwise(F.col("group_b")).alias("first"), F.when(a_first, F.col("group_b")).otherwise(F.col("group_a")).alias("later"), F.greatest("size_a", "size_b").alias("size")
        )
        free = pairs.join(pairs.select(F.col("later").alias("first")).distinct(), "first", "left_anti")
        moves = materialize(free.groupBy(F.col("later").alias("group")).agg(F.min_by("first", F.struct(-F.col("size"), F.col("first"))).alias("into")), "moves")
        old = (sampled, sizes, placed, votes)
        goes = lambda rows, column: splittable_join(rows, moves.withColumnRenamed("group", column), [column], "left").withColumn(column, F.coalesce("into", column)).drop("into")
        placed = materialize(goes(placed, "merged").select("group", "merged"), "merged")
        sizes = materialize(goes(sizes, "group").groupBy("group").agg(F.sum("size").alias("size")), "sizes")
        sampled = materialize(_samples(goes(sampled.drop("_rn"), "group"), samples), "samples")
        grown = moves.select(F.col("into").alias("id")).distinct()
        touched = grown.unionByName(moves.select(F.col("group").alias("id")))
        standing = votes.join(touched.withColumnRenamed("id", "group_a"), "group_a", "left_anti").join(touched.withColumnRenamed("id", "group_b"), "group_b", "left_anti")
        voters = materialize(_voters(sampled, samples), "voters")
        anew, others = voters.join(grown, "id", "left_semi"), voters.join(grown, "id", "left_anti")
        fresh = tiles.self_pairs(anew, kernel, schema, tile_rows=tile_rows).unionByName(tiles.cross_pairs(anew, others, kernel, schema, tile_rows=tile_rows))
        votes = materialize(standing.unionByName(_by_number(fresh)), "votes")
        discard(*old, moves, voters)
    return splittable_join(placed, sizes.withColumnRenamed("group", "merged"), ["merged"]).select("group", "merged", "size")
