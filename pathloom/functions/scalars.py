"""Numbers and texts as column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(p / (1 - p))


def sigmoid(x: Column) -> Column:
    """Stable on both sides."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def safe_ln(x: Column) -> Column:
    return F.ln(F.greatest(x, F.lit(TINY)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def combine_confidence(raw: Column, posterior: Column, calibrated: Column, weights=(0.5, 0.4, 0.1)) -> Column:
    """Weighted mean of logits of what is there, as a probability; null if nothing is."""
    pairs = list(zip((raw, posterior, calibrated), weights, strict=True))
    total = reduce(lambda a, b: a + b, [F.when(p.isNotNull(), F.lit(w)).otherwise(0.0) for p, w in pairs])
    mean = reduce(lambda a, b: a + b, [F.coalesce(logit(p) * w, F.lit(0.0)) for p, w in pairs]) / F.when(total > 0, total)
    return sigmoid(mean)


def power_mean(values: Column, rho: float) -> Column:
    """Of an array; 0 if empty, the geometric mean for rho 0."""
    floor = F.transform(values, lambda v: F.greatest(v, F.lit(TINY)))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(values)
    if rho == 0:
        out = F.exp(mean(F.transform(floor, F.ln)))
    else:
        out = F.pow(mean(F.transform(floor, lambda v: F.pow(v, F.lit(rho)))), F.lit(1 / rho))
    return F.when(F.size(values) > 0, out).otherwise(0.0)


def geometric_mean(values: Column) -> Column:
    """Of an array, each value clamped to [1e-6, 1]; 0 if empty."""
    logs = F.transform(values, lambda v: F.ln(clamp(v, 1e-6, 1.0)))
    return F.when(F.size(values) > 0, F.exp(F.aggregate(logs, F.lit(0.0), lambda x, y: x + y) / F.size(values))).otherwise(0.0)


def product(values: Column) -> Column:
    return F.aggregate(values, F.lit(1.0), lambda x, y: x * y)


def recency_factor(ages: Column, tau_days: float = 30.0, low: float = 0.5, high: float = 1.0) -> Column:
    """Of an array of ages in days: the product of decays, clamped; 1 without any."""
    return F.when(F.size(ages) > 0, clamp(F.exp(-F.aggregate(ages, F.lit(0.0), lambda x, y: x + y) / tau_days), low, high)).otherwise(1.0)


def age_days(created: Column, as_of: Column | str) -> Column:
    at = F.to_timestamp(F.lit(as_of)) if isinstance(as_of, str) else as_of
    return (F.unix_seconds(at) - F.unix_seconds(created)) / F.lit(86400.0)


def decay(created: Column, as_of: Column | str, half_life: float) -> Column:
    """2 ** -(age / half life); 1 where the time is missing. Ages count from 0, so the future doesn't grow."""
    return F.coalesce(F.pow(F.lit(2.0), -F.greatest(age_days(created, as_of), F.lit(0.0)) / half_life), F.lit(1.0))


def fused_confidence(raw: Column, posterior: Column, calibrated: Column, prior: float = 0.5) -> Column:
    return F.coalesce(raw, F.lit(prior)) * F.coalesce(posterior, F.lit(prior)) * F.coalesce(calibrated, F.lit(prior))


def bridge_factor(strength: Column, boost: float = 1.5) -> Column:
    return F.when(strength > 0, 1 + F.log1p(strength) * 0.1 * boost).otherwise(1.0)


def affinity_factor(score: Column, boost: float = 1.5) -> Column:
    return F.when(score > 0, 1 + score * boost).otherwise(1.0)


def parse_timestamp(text: Column) -> Column:
    """ISO 8601 or epoch seconds, in UTC; null if neither."""
    return F.coalesce(F.try_to_timestamp(text), F.timestamp_seconds(text.try_cast("double")))


def half_life_of_window(start: Column, end: Column) -> Column:
    """1.5 times the window in days, from 14 to 60; 30 without a window."""
    return F.coalesce(clamp(1.5 * age_days(start, end), 14.0, 60.0), F.lit(30.0))


# What counts as a mail address and as a telephone number.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"


def redact_pii(text: Column) -> Column:
    """Mail addresses, then telephone numbers, replaced by a mark."""
    return F.regexp_replace(F.regexp_replace(text, F.lit(EMAIL), F.lit("[EMAIL_REDACTED]")), F.lit(PHONE), F.lit("[PHONE_REDACTED]"))


def edge_hash(src: Column, rel: Column, dst: Column) -> Column:
    """An id for an edge without one: the hash of its JSON list."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    return F.concat(F.lit("kg/"), F.sha2(F.concat(F.lit("["), quoted(src), F.lit(", "), quoted(rel), F.lit(", "), quoted(dst), F.lit("]")), 256))


def bernoulli_entropy(p: Column) -> Column:
    p = clamp(p, TINY, 1 - TINY)
    return -(p * F.ln(p) + (1 - p) * F.ln(1 - p))


def kl_bernoulli(p: Column, q: Column) -> Column:
    p, q = clamp(p, TINY, 1 - TINY), clamp(q, TINY, 1 - TINY)
    return p * F.ln(p / q) + (1 - p) * F.ln((1 - p) / (1 - q))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(TINY))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, v: s + v))


def temperature_sigmoid(x: Column, log_temperature: Column) -> Column:
    """Probability of a logit under a temperature of softplus(log T)."""
    return sigmoid(x / F.log1p(F.exp(log_temperature)))


def insight_score(evidence: Column, community: Column, explanation: Column, impact: Column, weights=(0.5, 0.2, 0.2, 0.1)) -> Column:
    total = math.fsum(weights)
    return reduce(lambda a, b: a + b, [clamp(c, 0.0, 1.0) * (w / total) for c, w in zip((evidence, community, explanation, impact), weights, strict=True)])


def past_days(created: Column, as_of: Column | str) -> Column:
    """Age in days, 0 for what lies ahead; null stays null."""
    age = age_days(created, as_of)
    return F.when(age < 0, 0.0).otherwise(age)
