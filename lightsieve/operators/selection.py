"""Tiered selection for delivery and the coverage it is steered by, per album, without loops.

A photo table has (ord, album, ts, score, ok, faces, moments). ``ord`` is the file order and unique in an album;
every ranking breaks ties by it. Missing scores count as 45.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lightsieve.config import Selection
from lightsieve.session import materialize

DEFAULT_SCORE = 45.0


def tier_label(score, s: Selection = Selection()):
    return F.when(score >= s.tier_1, "tier_1").when(score >= s.tier_2, "tier_2").when(score >= s.tier_3, "tier_3").otherwise("none")


def _scored(photos: DataFrame) -> DataFrame:
    return photos.withColumn("score", F.coalesce("score", F.lit(DEFAULT_SCORE)))


def targets(photos: DataFrame, s: Selection) -> DataFrame:
    return photos.groupBy("album").agg(F.floor(F.count("*") * s.target_pct / 100).alias("target"))


def _room(target: DataFrame, *selected: DataFrame) -> DataFrame:
    """(album, room): what the parts selected so far leave of each album's target."""
    room = target.withColumn("taken", F.lit(0))
    for part in selected:
        counted = part.groupBy("album").agg(F.count("*").alias("n"))
        room = room.join(counted, "album", "left").withColumn("taken", F.col("taken") + F.coalesce("n", F.lit(0))).drop("n")
    return room.select("album", F.greatest(F.lit(0), F.col("target") - F.col("taken")).alias("room"))


def _fill(candidates: DataFrame, room: DataFrame, *order) -> DataFrame:
    """The first rows of each album's candidates, as many as there is room for."""
    ranked = candidates.withColumn("_rn", F.row_number().over(Window.partitionBy("album").orderBy(*order)))
    return ranked.join(room, "album").filter("_rn <= room").drop("_rn", "room")


def base_selection(photos: DataFrame, s: Selection = Selection()) -> DataFrame:
    """Tiers 1 and 2: all of tier 1, then tier 2 in file order up to the target."""
    photos = _scored(photos)
    good = photos.filter("ok")
    first = good.filter(F.col("score") >= s.tier_1)
    second = _fill(good.filter((F.col("score") >= s.tier_2) & (F.col("score") < s.tier_1)), _room(targets(photos, s), first), *([F.desc("score")] if s.tier_2_by_score else []), "ord")
    return first.withColumn("tier", F.lit("tier_1")).unionByName(second.withColumn("tier", F.lit("tier_2")))


def appearances(photos: DataFrame) -> DataFrame:
    return photos.select("album", "ord", "score", F.posexplode("faces").alias("pos", "person"))


def people_counts(photos: DataFrame, selected: DataFrame) -> DataFrame:
    """(album, person, total, selected, first): appearances in all photos and in the selection."""
    marked = appearances(photos).join(selected.select("album", "ord", F.lit(True).alias("hit")), ["album", "ord"], "left")
    return marked.groupBy("album", "person").agg(F.count("*").alias("total"), F.count("hit").alias("selected"), F.min(F.struct("ord", "pos")).alias("first"))


def missing_people(photos: DataFrame, selected: DataFrame, s: Selection) -> DataFrame:
    w = Window.partitionBy("album").orderBy("first")
    lacking = people_counts(photos, selected).filter((F.col("total") >= s.least_appearances) & (F.col("selected") == 0))
    return lacking.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= s.most_people)


def people_coverage(photos: DataFrame, selected: DataFrame) -> DataFrame:
    counted = people_counts(photos, selected).groupBy("album").agg(F.count("*").alias("n_people"), F.count_if(F.col("selected") > 0).alias("n_covered"))
    return counted.withColumn("pct", F.col("n_covered") * 100.0 / F.greatest(F.col("n_people"), F.lit(1)))


def moment_coverage(photos: DataFrame, selected: DataFrame, s: Selection) -> DataFrame:
    """(album, moment, v, total, selected) for every album and every moment of the vocabulary."""
    vocabulary = F.array(*map(F.lit, dict.fromkeys(s.moments)))
    grid = photos.select("album").distinct().select("album", F.posexplode(vocabulary).alias("v", "moment"))
    counted = lambda df, name: df.select("album", F.explode("moments").alias("moment")).groupBy("album", "moment").agg(F.count("*").alias(name))
    full = grid.join(counted(photos, "total"), ["album", "moment"], "left").join(counted(selected, "selected"), ["album", "moment"], "left")
    return full.fillna(0, ["total", "selected"])


def time_gaps(selected: DataFrame, s: Selection) -> DataFrame:
    """(album, k, gap_start, gap_end): the first gaps of an album between consecutive selected photos."""
    w = Window.partitionBy("album").orderBy("ts", "ord")
    gaps = selected.select("album", F.col("ts").alias("gap_start"), F.lead("ts").over(w).alias("gap_end"))
    long = gaps.filter(F.unix_micros("gap_end") - F.unix_micros("gap_start") > int(s.gap_seconds * 1e6))
    return long.withColumn("k", F.row_number().over(Window.partitionBy("album").orderBy("gap_start"))).filter(F.col("k") <= s.most_gaps)


def in_gaps(photos: DataFrame, selected: DataFrame, s: Selection) -> DataFrame:
    """The best photos strictly inside each gap and outside the selection."""
    free = photos.join(selected.select("album", "ord"), ["album", "ord"], "left_anti")
    inside = free.join(time_gaps(selected, s), "album").filter((F.col("ts") > F.col("gap_start")) & (F.col("ts") < F.col("gap_end")))
    w = Window.partitionBy("album", "k").orderBy(F.desc("score"), "ord")
    return inside.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= s.per_gap)


def _best(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("album", key).orderBy(F.desc("score"), "ord"))).filter("r = 1")


def missing_people_best(photos: DataFrame, selected: DataFrame, s: Selection) -> DataFrame:
    return _best(appearances(photos).join(missing_people(photos, selected, s).select("album", "person", "k"), ["album", "person"]), "person")


def recommendations(photos: DataFrame, selected: DataFrame, s: Selection = Selection()) -> DataFrame:
    """(album, ord, score, boost, kind, k, r): people, then moments, then gaps; kind, k, r give the order."""
    photos = _scored(photos)
    people = missing_people_best(photos, selected, s).withColumn("boost", F.lit(s.boost_person)).withColumn("kind", F.lit(1))
    w = Window.partitionBy("album").orderBy("v")
    lacking = moment_coverage(photos, selected, s).filter("selected = 0").withColumn("k", F.row_number().over(w)).filter(F.col("k") <= s.most_moments)
    of_moment = photos.select("album", "ord", "score", F.explode("moments").alias("moment")).join(lacking.select("album", "moment", "k"), ["album", "moment"])
    moments = _best(of_moment, "moment").withColumn("boost", F.lit(s.boost_moment)).withColumn("kind", F.lit(2))
    gaps = in_gaps(photos, selected, s).withColumn("boost", F.lit(s.boost_gap)).withColumn("kind", F.lit(3))
    columns = ["album", "ord", "score", "boost", "kind", "k", "r"]
    return people.select(columns).unionByName(moments.select(columns)).unionByName(gaps.select(columns))


def select_for_delivery(photos: DataFrame, s: Selection = Selection()) -> DataFrame:
    """(album, ord, score, tier) of the delivered photos.

    Tiers 1 and 2, then recommended photos whose boosted score qualifies, then tier 3 by score: each up to the
    target, which tier 1 and the solo photos at the end may exceed.
    """
    photos = _scored(photos)
    target = targets(photos, s)
    # each phase reads the selection of the phases before it many times over, so it is written once
    base = materialize(base_selection(photos, s), "base")
    recommended = recommendations(photos, base, s).filter(F.col("score") + F.col("boost") >= s.key_moment)
    if s.strict_coverage:
        recommended = recommended.join(photos.filter("ok").select("album", "ord"), ["album", "ord"], "left_semi")
    first = recommended.withColumn("_f", F.row_number().over(Window.partitionBy("album", "ord").orderBy("kind", "k", "r"))).filter("_f = 1").drop("_f")
    coverage = _fill(first, _room(target, base), "kind", "k", "r")
    columns = ["album", "ord", "score", "tier"]
    chosen = materialize(base.select(columns).unionByName(coverage.withColumn("tier", F.lit("coverage")).select(columns)), "covered")
    rest = photos.filter(F.col("ok") & (F.col("score") >= s.tier_3) & (F.col("score") < s.tier_2)).join(chosen.select("album", "ord"), ["album", "ord"], "left_anti")
    third = _fill(rest, _room(target, chosen), F.desc("score"), "ord")
    chosen = materialize(chosen.unionByName(third.withColumn("tier", F.lit("tier_3")).select(columns)), "tiered")
    solo = photos.filter(F.size("faces") == 1).withColumn("person", F.element_at("faces", 1))
    shown = solo.join(chosen.select("album", "ord"), ["album", "ord"], "left_semi").select("album", "person").distinct()
    new = solo.filter(F.col("score") >= s.solo).join(chosen.select("album", "ord"), ["album", "ord"], "left_anti").join(shown, ["album", "person"], "left_anti")
    if s.strict_coverage:
        new = new.filter("ok")
    new = new.withColumn("_rn", F.row_number().over(Window.partitionBy("album", "person").orderBy("ord"))).filter("_rn = 1")
    return chosen.unionByName(new.withColumn("tier", F.lit("coverage")).select(columns))


def time_buckets(photos: DataFrame, selected: DataFrame, buckets: int = 20) -> DataFrame:
    """(album, all_buckets, hit_buckets, pct): share of time buckets that the selection reaches; 100 for a range of 0."""
    span = photos.groupBy("album").agg(F.min(F.unix_micros("ts")).alias("t0"), F.max(F.unix_micros("ts")).alias("t1"))
    placed = photos.select("album", "ord", F.unix_micros("ts").alias("t")).join(span, "album").withColumn("bucket", F.floor((F.col("t") - F.col("t0")) / ((F.col("t1") - F.col("t0")) / buckets)))
    marked = placed.join(selected.select("album", "ord", F.lit(True).alias("hit")), ["album", "ord"], "left")
    counted = marked.groupBy("album").agg(F.countDistinct("bucket").alias("all_buckets"), F.countDistinct(F.when(F.col("hit"), F.col("bucket"))).alias("hit_buckets"))
    return counted.withColumn("pct", F.when(F.col("all_buckets") == 0, 100.0).otherwise(F.col("hit_buckets") * 100.0 / F.col("all_buckets")))


def variety(rows: DataFrame, key: str, composition: str, orientation: str, shot_type: str) -> DataFrame:
    score = 10 * F.countDistinct(composition) + 20 * F.countDistinct(orientation) + 15 * F.countDistinct(shot_type)
    return rows.groupBy(key).agg(F.least(F.lit(100), score).alias("variety"))


def tier_distribution(photos: DataFrame, selected: DataFrame, s: Selection) -> DataFrame:
    """(album, total, target, delivered, pct, and one count a tier)."""
    counts = selected.groupBy("album").pivot("tier", ["tier_1", "tier_2", "tier_3", "coverage"]).count()
    out = photos.groupBy("album").agg(F.count("*").alias("total")).join(targets(photos, s), "album").join(counts, "album", "left").fillna(0, ["tier_1", "tier_2", "tier_3", "coverage"])
    delivered = F.col("tier_1") + F.col("tier_2") + F.col("tier_3") + F.col("coverage")
    return out.withColumn("delivered", delivered).withColumn("pct", F.coalesce(F.try_divide(F.col("delivered") * 100.0, F.col("total")), F.lit(0.0)))
