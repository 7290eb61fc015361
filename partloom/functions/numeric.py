"""Order-preserving buckets and numerically stable scalar forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LOWEST, HIGHEST = -1_000_000, 1_000_000


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def half_even(value: Column) -> Column:
    """Nearest whole number, halves to the even one."""
    return F.rint(value)


def score_bucket(prob: Column, steps: int = 256) -> Column:
    """A bucket number that never falls as `prob` rises, fine near 0 and near 1.

    Steps of the logit keep buckets small even when most scores crowd at one end.
    """
    inside = (prob > 0) & (prob < 1)
    safe = F.when(inside, prob).otherwise(F.lit(0.5))
    step = F.floor(F.ln(safe / (1 - safe)) * steps)
    return F.when(prob <= 0, F.lit(LOWEST)).when(prob >= 1, F.lit(HIGHEST)).otherwise(step).cast("bigint")


def size_bucket(value: Column, steps: int = 256) -> Column:
    """Like `score_bucket` for non-negative sizes such as distances."""
    safe = F.when(value > 0, value).otherwise(F.lit(1.0))
    return F.when(value <= 0, F.lit(LOWEST)).otherwise(F.floor(F.log2(safe) * steps)).cast("bigint")


def log_sigmoid(logit: Column) -> Column:
    return F.least(logit, F.lit(0.0)) - F.log1p(F.exp(-F.abs(logit)))


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def bce_with_logits(logit: Column, label: Column, pos_weight: Column | float = 1.0) -> Column:
    weight = pos_weight if isinstance(pos_weight, Column) else F.lit(pos_weight)
    return -(weight * label * log_sigmoid(logit) + (1 - label) * log_sigmoid(-logit))


def focal_with_logits(logit: Column, label: Column, alpha: float, gamma: float) -> Column:
    prob = sigmoid(logit)
    hit = prob * label + (1 - prob) * (1 - label)
    weight = alpha * label + (1 - alpha) * (1 - label)
    return weight * F.pow(1 - hit, F.lit(gamma)) * bce_with_logits(logit, label)


def floored_ratio(top: Column, bottom: Column, floor: float) -> Column:
    return top / F.greatest(bottom, F.lit(floor))
