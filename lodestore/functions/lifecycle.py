"""Column functions of entry lifecycle: half-lives, decay, expiry, importance, quality grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import TYPE_COMPLEXITY, Search
from .text import let


def instant(col: Column) -> Column:
    """ISO-8601 text with any offset, or without one (UTC); null if it can't be read."""
    return F.try_to_timestamp(F.nullif(F.trim(F.coalesce(col, F.lit(""))), F.lit("")))


def epoch(col: Column) -> Column:
    """Seconds of a number or an ISO text; a text without offset is taken at +08:00."""
    text = F.trim(F.coalesce(col, F.lit("")))
    number = text.try_cast("double")
    offset = text.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    stamp = F.unix_timestamp(instant(text)).cast("double")
    return F.coalesce(number, F.when(offset, stamp).otherwise(stamp - 8 * 3600))


def half_life_days(col: Column) -> Column:
    """Days of 30d, 8w, 6m (30 days each), 2y (365 days each); null for permanent and all else."""
    n = F.regexp_extract(col, r"^(\d+)[dwmy]$", 1).try_cast("int")
    unit = F.regexp_extract(col, r"^\d+([dwmy])$", 1)
    return F.when(unit == "d", n).when(unit == "w", n * 7).when(unit == "m", n * 30).when(unit == "y", n * 365)


def half_life_decay(base: Column, days: Column, half_life: Column) -> Column:
    return F.round(F.greatest(F.lit(0.05), base * F.pow(F.lit(0.5), days / half_life)), 2)


def trust_decay(score: Column, days: Column) -> Column:
    return F.round(F.greatest(F.lit(0.1), score * F.pow(F.lit(0.95), days)), 2)


def linear_decay(confidence: Column, importance: Column) -> tuple[Column, Column]:
    return F.round(F.greatest(F.lit(0.1), confidence - 0.1), 2), F.greatest(F.lit(1), importance - 1)


def normal_importance(col: Column) -> Column:
    return F.least(F.lit(10), F.greatest(F.lit(1), F.ceil(F.coalesce(col, F.lit(5))))).cast("int")


def usage_target(uses: Column, days_ago: Column) -> Column:
    """Importance that use has earned: 5, more for 2, 5, 10, 20 uses, one more within a week; 10 at most."""
    more = F.when(uses >= 20, 4).when(uses >= 10, 3).when(uses >= 5, 2).when(uses >= 2, 1).otherwise(0)
    return F.least(F.lit(10), F.lit(5) + more + F.when(days_ago <= 7, 1).otherwise(0))


def default_expiry_days(kind: Column) -> Column:
    return F.when(kind.isin("fact", "correction"), 90).when(kind.isin("record", "info", "context"), 30)


def type_half_life(kind: Column) -> Column:
    return F.when(kind.isin("principle", "rule", "insight", "decision"), "permanent").when(kind.isin("fact", "correction"), "90d").when(kind.isin("record", "info", "context"), "30d")


def entropy(col: Column) -> Column:
    """Shannon entropy of the first 500 characters over its largest possible value."""
    text = F.substring(F.coalesce(col, F.lit("")), 1, 500)

    def of(chars: Column) -> Column:
        n = F.size(chars)
        counts = F.transform(F.array_distinct(chars), lambda c: n - F.size(F.array_remove(chars, c)))

        def bits(k: Column) -> Column:
            total = F.aggregate(k, F.lit(0.0), lambda acc, x: acc - (x / n) * F.log2(x / n))
            most = F.log2(F.least(n, F.size(k)).cast("double"))
            return F.when(n == 0, 0.0).when(most > 0, total / most).otherwise(0.0)

        return let(counts, bits)

    return let(F.filter(F.split(text, ""), lambda c: c != ""), of)


def length_axis(col: Column) -> Column:
    n = F.length(F.coalesce(col, F.lit("")))
    return F.least(F.lit(1.0), F.log2(F.lit(1.0) + n) / F.log2(F.lit(501.0)))


def type_complexity(kind: Column) -> Column:
    out = F.lit(None).cast("double")
    for level in sorted(set(TYPE_COMPLEXITY.values())):
        out = F.coalesce(out, F.when(F.lower(kind).isin(*[k for k, v in TYPE_COMPLEXITY.items() if v == level]), F.lit(level)))
    return F.coalesce(out, F.lit(0.5))


def complexity_axis(text: Column, kind: Column) -> Column:
    return 0.4 * entropy(text) + 0.3 * length_axis(text) + 0.3 * type_complexity(kind)


def confidence_base(confidence: Column) -> Column:
    c = F.coalesce(confidence, F.lit(0.7))
    return F.when(c >= 0.9, 8).when(c >= 0.7, 6).when(c >= 0.5, 4).otherwise(2)


def curated_score(importance: Column, confidence: Column) -> Column:
    """Importance, one more at a confidence of 0.9, one less below 0.5; 1 to 10."""
    step = F.when(confidence >= 0.9, 1).when(confidence < 0.5, -1).otherwise(0)
    return F.least(F.lit(10), F.greatest(F.lit(1), importance + step))


def quality_of(score: Column, cfg: Search) -> Column:
    high, medium, low = cfg.quality
    return F.when(score >= high, "high").when(score >= medium, "medium").when(score >= low, "low").otherwise("weak")


def grade_of(score: Column, fallback: Column, cfg: Search) -> Column:
    high, medium, _ = cfg.quality
    return F.when(fallback, "weak").when(score >= high, "strong").when(score >= medium, "medium").otherwise("weak")


def stability_axis(verified: Column, labelled: Column, expires_at: Column, distilled_at: Column, now: Column) -> Column:
    """How settled an entry is, 0 to 1: a quarter each for its verification, who labelled it, whether it has expired, and how lately it was distilled."""
    v, g = F.lower(F.trim(F.coalesce(verified, F.lit("")))), F.lower(F.trim(F.coalesce(labelled, F.lit(""))))
    proof = F.when(v == "verified", 1.0).when(v == "pending", 0.5).otherwise(0.3)
    label = F.when(g.isin("", "none", "missing", "l3_missing"), 0.3).when(g == "auto", 0.5).otherwise(1.0)
    end, age = epoch(expires_at), epoch(now) - epoch(distilled_at)
    alive = F.when(F.coalesce(expires_at, F.lit("")) == "", 0.7).when(end.isNull(), 0.5).when(end > epoch(now), 1.0).otherwise(0.1)
    fresh = F.when(age.isNull(), 0.5).when(age <= 86400, 1.0).when(age <= 7 * 86400, 0.8).when(age <= 30 * 86400, 0.6).otherwise(0.4)
    return 0.25 * proof + 0.25 * label + 0.25 * alive + 0.25 * fresh


def peak_anchor(hours: Column, people: Column, systems: Column, forced: Column) -> Column:
    """1 for an event of weight: longer than two hours, more than three people, two systems or more, or asked to be remembered."""
    signs = (hours > 2, people > 3, systems >= 2, forced)
    return F.greatest(*[F.coalesce(c.cast("int"), F.lit(0)) for c in signs])


def end_anchor(completed_at: Column, milestone: Column, done: Column) -> Column:
    """1 where something came to its end: completed, a milestone, or a task done."""
    return ((F.coalesce(completed_at, F.lit("")) != "") | F.coalesce(milestone, F.lit(False)) | F.coalesce(done, F.lit(False))).cast("int")


def dual_axis_score(confidence: Column, complexity: Column, stability: Column, peak: Column, end: Column) -> Column:
    """Importance by confidence, anchors and both axes, 10 at most."""
    return F.least(F.lit(10.0), confidence_base(confidence) + peak + end + complexity + stability)
