"""Recommendations for an album as a table function: one pass over its photos in time order.

The function sees the photos of one album after the other and keeps what it needs of them: a count and the best photo
of each person and moment, and the best few photos since the last selected one. Its state grows with the people of an
album, not with its photos.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lightsieve.config import Selection

SCHEMA = "album string, ord long, score double, boost double, kind int, k int, r int"


class Photo(NamedTuple):
    ord: int
    score: float

    def better(self, other: Photo | None) -> Photo:
        return self if other is None or (-self.score, self.ord) < (-other.score, other.ord) else other


class Tally:
    """Photos of a person or a moment: how many, whether one is selected, when first seen, and the best."""

    __slots__ = ("total", "selected", "first", "best")

    def __init__(self) -> None:
        self.total, self.selected, self.first, self.best = 0, False, None, None

    def add(self, photo: Photo, selected: bool, place: tuple[int, int]) -> None:
        self.total += 1
        self.selected |= selected
        self.first = place if self.first is None else min(self.first, place)
        self.best = photo.better(self.best)


def best(photos: list[Photo], most: int) -> list[Photo]:
    return sorted(photos, key=lambda p: (-p.score, p.ord))[:most]


class Gaps:
    """The best unselected photos strictly between neighbouring selected ones that are far enough apart."""

    def __init__(self, most: int, least_us: int, per_gap: int):
        self.most, self.least_us, self.per_gap = most, least_us, per_gap
        self.found: list[tuple[int, list[Photo]]] = []
        self.last: int | None = None
        self.before: list[Photo] = []  # of earlier times than now
        self.now: int | None = None
        self.at_now: list[Photo] = []

    def add(self, photo: Photo, selected: bool, at: int) -> None:
        if at != self.now:
            self.before, self.at_now, self.now = best(self.before + self.at_now, self.per_gap), [], at
        if selected:
            if self.last is not None and at - self.last > self.least_us and len(self.found) < self.most:
                self.found.append((self.last, self.before))
            self.last, self.before, self.at_now = at, [], []
        elif self.last is not None and at > self.last:
            self.at_now = best([*self.at_now, photo], self.per_gap)


def table_function(s: Selection = Selection()):
    """The function for a selection's settings; call it on a table partitioned by album and ordered by time and ord."""
    moments, boosts = tuple(s.moments), (s.boost_person, s.boost_moment, s.boost_gap)
    least_total, most_people, most_moments = s.least_appearances, s.most_people, s.most_moments
    gaps = (s.most_gaps, int(s.gap_seconds * 1e6), s.per_gap)

    @udtf(returnType=SCHEMA)
    class Recommend:
        def __init__(self) -> None:
            self.album: Any = None
            self.people: dict[Any, Tally] = {}
            self.moments = {m: Tally() for m in moments}
            self.gaps = Gaps(*gaps)

        def eval(self, row: Any) -> None:
            self.album = row["album"]
            photo, selected = Photo(row["ord"], row["score"]), row["selected"]
            for place, person in enumerate(row["faces"] or (), 1):
                self.people.setdefault(person, Tally()).add(photo, selected, (row["ord"], place))
            for moment in row["moments"] or ():
                if moment in self.moments:
                    self.moments[moment].add(photo, selected, (0, 0))
            self.gaps.add(photo, selected, row["at"])

        def terminate(self) -> Iterator[tuple]:
            missing = sorted((t.first, t.best) for t in self.people.values() if t.total >= least_total and not t.selected)
            for k, (_, photo) in enumerate(missing[:most_people], 1):
                yield self.album, photo.ord, photo.score, boosts[0], 1, k, 1
            lacking = [t for t in self.moments.values() if not t.selected]
            for k, t in enumerate(lacking[:most_moments], 1):
                if t.best is not None:
                    yield self.album, t.best.ord, t.best.score, boosts[1], 2, k, 1
            for k, (_, photos) in enumerate(self.gaps.found, 1):
                for r, photo in enumerate(photos, 1):
                    yield self.album, photo.ord, photo.score, boosts[2], 3, k, r

    return Recommend


def recommend(photos: DataFrame, selected: DataFrame, s: Selection = Selection()) -> DataFrame:
    """What selection.recommendations gives, by the table function. photos: (ord, album, ts, score, faces, moments); selected: (album, ord)."""
    chosen = selected.select("album", "ord").distinct().withColumn("selected", F.lit(True))
    rows = photos.join(chosen, ["album", "ord"], "left").select("album", "ord", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"), "faces", "moments", F.unix_micros("ts").alias("at"), F.coalesce("selected", F.lit(False)).alias("selected"))
    return table_function(s)(rows.asTable().partitionBy("album").orderBy("at", "ord"))
