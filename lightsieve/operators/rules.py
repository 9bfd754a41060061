"""Per-photo decisions as column expressions: blur, focus, eyes, venue, replies of a scoring model, exclusions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lightsieve.config import FINAL_REJECTION_TERMS, FOCUS_REJECTION_TERMS, NO_FACE_REASONS, QUALITY_REJECTION_TERMS, QUALITY_WEIGHTS, Rules


def combined_blur(laplacian: Column, fft: Column) -> Column:
    """Half each; both are clamped from above only."""
    return 0.5 * F.least(laplacian / 1000 * 100, F.lit(100.0)) + 0.5 * F.least(fft / 20 * 100, F.lit(100.0))


def blur_rule(status: Column, confidence: Column, combined: Column, rules: Rules = Rules()) -> Column:
    """The effective rule: flagged by the model with confidence, and not clearly sharp."""
    return (status == "BLURRY") & (confidence >= rules.blur_confidence) & (combined < rules.blur_combined)


def blur_rule_full(status: Column, confidence: Column, combined: Column, rules: Rules = Rules()) -> Column:
    """The rule as a cascade of cases; it decides as blur_rule does."""
    sure = confidence >= rules.blur_confidence
    decided = (
        F.when((status == "BLURRY") & (combined < rules.blur_threshold) & sure, True)
        .when((status == "BLURRY") & (combined < rules.blur_combined) & sure, True)
        .when((status == "CLEAR") | (combined >= rules.blur_combined), False)
        .otherwise(False)
    )
    return decided


def local_blur_rule(combined: Column, rules: Rules = Rules()) -> Column:
    """Without a model."""
    return combined < rules.blur_threshold


def exposure_or_blur(overexposed_share: Column, blurred: Column, rules: Rules = Rules()) -> Column:
    return F.when(overexposed_share > rules.overexposed_share, "exposure").when(blurred, "blur").otherwise("clear")


def any_term(text: Column, terms: Iterable[str]) -> Column:
    lowered = F.lower(text)
    return reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(t)) for t in terms))


def focus_rule(score: Column, status: Column, confidence: Column, detail: Column, rules: Rules = Rules(), batch: bool = False) -> Column:
    """error, no_subject, in_focus or off_focus; the batch variant knows no rejection terms."""
    sharp = (score >= rules.focus_threshold) & (confidence >= rules.in_focus_confidence) & (status == "IN_FOCUS")
    if not batch:
        sharp = sharp & ~any_term(detail, (*FOCUS_REJECTION_TERMS, "foreground"))
    missing = score.isNull() | status.isNull() | confidence.isNull()
    return F.when(missing, "error").when(status == "NO_SUBJECT", "no_subject").when(sharp, "in_focus").otherwise("off_focus")


def eye_rule(venue: Column, venue_confidence: Column, largest_face_share: Column, closed_probability: Column, rules: Rules = Rules()) -> tuple[Column, Column]:
    """(closed, reason); largest_face_share is null without faces."""
    is_venue = venue & (venue_confidence >= rules.venue_skip_confidence)
    no_face, small, _ = NO_FACE_REASONS
    reason = F.when(is_venue, "Venue shot").when(largest_face_share.isNull(), no_face).when(largest_face_share < rules.least_face_share, small)
    reason = reason.when(closed_probability >= rules.eye_confidence, "Closed eyes").otherwise("Open eyes")
    return reason == "Closed eyes", reason


def eye_category(closed: Column, reason: Column) -> Column:
    return F.when(closed, "closed_eyes").when(reason.isin(*NO_FACE_REASONS), "no_face").otherwise("open")


def decor(white_share: Column, edge_share: Column) -> Column:
    return (white_share > 25) & (edge_share > 5) & (edge_share < 35)


def venue_rule(has_person: Column, white_share: Column, edge_share: Column, status: Column, confidence: Column, rules: Rules = Rules()) -> Column:
    return ~has_person & (decor(white_share, edge_share) | ((status == "VENUE") & (confidence >= rules.venue_confidence)))


def parse_reply(reply: Column) -> Column:
    """struct<status, confidence, reason> of STATUS|confidence|reason; anything else is ERROR. Fractions become percent."""
    parts = F.split(reply, r"\|")
    number = F.coalesce(F.try_to_number(F.trim(parts[1]), F.lit("999999.99999")).cast("double"), F.lit(0.0))
    percent = F.when((number > 0) & (number <= 1), number * 100).otherwise(number)
    good = F.size(parts) == 3
    return F.struct(
        F.when(good, F.upper(F.trim(parts[0]))).otherwise("ERROR").alias("status"),
        F.when(good, percent).otherwise(0.0).alias("confidence"),
        F.when(good, F.trim(parts[2])).otherwise("Invalid reply").alias("reason"),
    )


def reject_terms(decision: Column, score: Column, detail: Column, terms: Iterable[str] = QUALITY_REJECTION_TERMS) -> tuple[Column, Column]:
    """A term in the detail turns the decision into REJECT and bounds the score by 74."""
    hit = any_term(detail, terms)
    return F.when(hit, "REJECT").otherwise(decision), F.when(hit, F.least(score, F.lit(74.0))).otherwise(score)


def exclusion_reason(closed_eyes: Column, blurry: Column, duplicate: Column, allowed: Column, off_focus: Column) -> Column:
    return F.when(closed_eyes, "eyes").when(blurry, "blur").when(duplicate & ~allowed, "duplicate").when(off_focus, "focus")


def overall_quality(parts: dict[str, Column]) -> Column:
    """Weighted sum of boosted parts, boosted again; both bounded by 1."""
    total = reduce(lambda a, b: a + b, (F.least(parts[k] * 1.15, F.lit(1.0)) * w for k, w in QUALITY_WEIGHTS.items()))
    return F.least(total * 1.1, F.lit(1.0))


def resolution_score(pixels: Column) -> Column:
    return F.least(pixels / 6e6, F.lit(1.0))


def face_score(n_faces: Column) -> Column:
    return F.when(n_faces > 0, F.least(n_faces, F.lit(3)) / 3.0).otherwise(0.5)


def exposure_score(mean_gray: Column) -> Column:
    return 1 - F.abs(127.5 - mean_gray) / 127.5


def backoff_seconds(attempt: Column, first: float = 1.0, most: float = 60.0, jitter_by: Column | None = None, jitter: float = 0.2) -> Column:
    """Delay before a retry. With jitter_by it is longer by up to ``jitter`` of itself, the same for the same key and attempt."""
    delay = F.least(F.lit(first) * F.pow(F.lit(2.0), attempt - 1), F.lit(most))
    if jitter_by is None:
        return delay
    part = F.conv(F.substring(F.md5(F.concat_ws(":", jitter_by.cast("string"), attempt.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return delay + delay * jitter * part


def confident_venues(is_venue: Column, confidence: Column, least: float = 90) -> Column:
    """Venue photos that are sure enough to be set aside before the other stages."""
    return is_venue & (confidence >= least)


def best_decision(decision: Column, score: Column, from_in_focus: Column, rejected: Column, least: float = 75) -> Column:
    """best_quality, rejected or other: photos of the in-focus stage count as BEST by their score alone."""
    best = ((decision == "BEST") | (from_in_focus & (score >= least))) & (score >= least)
    return F.when(F.coalesce(best, F.lit(False)) & rejected, "rejected").when(best, "best_quality").otherwise("other")


def final_check(decision: Column, score: Column, detail: Column, least: float = 75, terms: Iterable[str] = FINAL_REJECTION_TERMS) -> Column:
    """PASS with a high enough score and no term in the detail."""
    return F.coalesce((F.trim(decision) == "PASS") & (score >= least) & ~any_term(detail, terms), F.lit(False))


def disqualified_reason(duplicate: Column, is_best: Column, closed_eyes: Column, blurry: Column, off_focus: Column) -> Column:
    """As exclusion_reason, in the older order: duplicates first."""
    return F.when(duplicate & ~is_best, "duplicate").when(closed_eyes, "closed_eyes").when(blurry, "blurry").when(off_focus, "out_of_focus")


def worth_logging(level: Column, message: Column, phrases: Iterable[str]) -> Column:
    """Warnings and worse, and messages with one of the phrases."""
    return level.isin("WARNING", "ERROR", "CRITICAL") | any_term(message, [p.lower() for p in phrases])


def error_class(message: Column) -> Column:
    lowered = F.lower(message)
    return F.when(F.contains(lowered, F.lit("quota")) | F.contains(lowered, F.lit("rate limit")), "quota").when(F.contains(lowered, F.lit("api key")), "key").otherwise("other")
