"""Thresholds and vocabularies with their default values."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

# Fixed values.
CATEGORIES = ("best_quality", "duplicates", "closed_eyes", "blurry", "in_focus")
MOMENTS = (
    "aisle", "vows", "rings", "kiss", "recessional",
    "entrance", "first_dance", "speeches", "cake", "bouquet",
    "bride", "groom", "couple", "family", "wedding_party",
    "dress", "rings", "flowers", "venue", "decorations",
)
FOCUS_REJECTION_TERMS = ("back turned", "backs turned", "distracting", "unclear moment", "no clear subject", "poor composition", "obscures", "foreground obstruction")
QUALITY_REJECTION_TERMS = ("back to camera", "backs turned", "distracting", "unclear moment", "no clear subject", "walking through", "poor composition")
FINAL_REJECTION_TERMS = ("back to camera", "distracting", "unclear moment", "no clear subject")
NO_FACE_REASONS = ("No faces detected", "Face too small - likely venue/decor shot", "No significant faces - skip eye detection")
STANDARD_FORMATS = ("jpg", "jpeg", "png", "bmp", "tiff")
RAW_FORMATS = ("cr2", "nef", "arw", "orf", "raf")
QUALITY_WEIGHTS = {"resolution": 0.15, "face_detection": 0.20, "contrast": 0.15, "sharpness": 0.20, "noise": 0.15, "exposure": 0.15}
# End of fixed values.


@dataclass(frozen=True)
class Selection:
    """Settings of the tiered selection; scores are on a scale up to 100."""

    target_pct: int = 50
    tier_1: float = 80
    tier_2: float = 60
    tier_3: float = 45
    solo: float = 40
    key_moment: float = 35
    gap_seconds: float = 600
    least_appearances: int = 3
    most_people: int = 5
    most_moments: int = 5
    most_gaps: int = 3
    per_gap: int = 2
    boost_person: float = 15.0
    boost_moment: float = 20.0
    boost_gap: float = 10.0
    moments: tuple[str, ...] = MOMENTS
    strict_coverage: bool = False  # coverage photos must pass the basic checks, too
    tier_2_by_score: bool = False  # instead of in file order


@dataclass(frozen=True)
class Rules:
    overexposed_share: float = 0.30
    blur_threshold: float = 20
    blur_combined: float = 40
    blur_confidence: float = 90
    focus_threshold: float = 45
    in_focus_confidence: float = 75
    eye_confidence: float = 85
    least_face_share: float = 0.05
    venue_confidence: float = 85
    venue_skip_confidence: float = 75


def load(spark: SparkSession, path: str) -> tuple[Selection, Rules]:
    """Settings of a JSON file, {"selection": {...}, "rules": {...}}; what it does not name keeps its default.

    Spark reads the file, so it may lie wherever tables do. Unknown names and values of another type raise ValueError.
    """
    found = json.loads("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect()) or "{}")
    return tuple(_filled(kind, found.get(name, {})) for name, kind in (("selection", Selection), ("rules", Rules)))


def _filled(kind: type, values: dict):
    known = {f.name: f.default for f in fields(kind)}
    for name, value in values.items():
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        good = name in known and (isinstance(value, list) if isinstance(known[name], tuple) else isinstance(value, bool) if isinstance(known[name], bool) else number)
        if not good:
            raise ValueError(f"{kind.__name__} has no setting {name!r} of value {value!r}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
