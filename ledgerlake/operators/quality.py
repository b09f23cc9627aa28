"""Five quality dimensions and their weighted total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlake.functions.dates import STRICT_FORMATS, formats_of, is_date_column, is_typed_date, parse_date
from ledgerlake.operators.profile import Profile
from ledgerlake.staging import together

# Weight of each dimension in the total, and the score from which
# a report calls it good.
WEIGHTS = {"completeness": 0.30, "consistency": 0.20, "validity": 0.20, "uniqueness": 0.15, "accuracy": 0.15}
GOOD_FROM = {
    "completeness": 95,
    "consistency": 90,
    "validity": 95,
    "uniqueness": 95,
    "accuracy": 90,
    "overall": 92,
}


def _score(profile: Profile, value: Column) -> DataFrame:
    return profile.source.sparkSession.range(1).select(F.round(value, 2).alias("score"))


def _mean_share(shares: DataFrame) -> DataFrame:
    """Mean of the per-column shares as a rounded percentage; 100 when no column applies."""
    return shares.agg(F.coalesce(F.round(F.avg("share") * 100, 2), F.lit(100.0)).alias("score"))


def _shares(profile: Profile, conditions: dict[str, Column]) -> DataFrame:
    """(share): of each column's values, those that meet its condition; no row for a column without values."""
    parts = [F.try_divide(F.count_if(met), F.count(f"`{c}`")) for c, met in conditions.items()]
    one_row = profile.source.agg(F.array(*[p.cast("double") for p in parts] or [F.lit(None).cast("double")]).alias("shares"))
    return one_row.select(F.explode("shares").alias("share"))


def completeness(profile: Profile) -> DataFrame:
    cells = profile.row_count * len(profile.value_counts)
    return _score(profile, F.lit(sum(profile.value_counts.values())) / F.lit(cells) * 100)


def consistency(profile: Profile, formats: Sequence[str] | None = STRICT_FORMATS) -> DataFrame:
    """Share of date texts that parse, averaged over the date and time columns.

    Without ``formats`` a text counts if standardising dates would read it.
    """
    source, conditions = profile.source, {}
    for c in filter(is_date_column, source.columns):
        text = F.col(f"`{c}`").cast("string")
        if is_typed_date(source, c):
            conditions[c] = text.isNotNull()
        elif formats is None:
            conditions[c] = parse_date(F.trim(text), formats_of(source, c), with_time=True).isNotNull()
        else:
            conditions[c] = parse_date(text, formats).isNotNull()
    return _mean_share(_shares(profile, conditions))


def validity(profile: Profile) -> DataFrame:
    """Share of values that are not negative, averaged over the sales and quantity columns."""
    checked = [c for c in profile.numeric if "sales" in c.lower() or "quantity" in c.lower()]
    return _mean_share(_shares(profile, {c: F.col(f"`{c}`") >= 0 for c in checked}))


def uniqueness(profile: Profile) -> DataFrame:
    return _score(profile, F.lit(profile.row_count - profile.duplicates) / F.lit(profile.row_count) * 100)


def accuracy(profile: Profile) -> DataFrame:
    """Share of values that are no outliers, averaged over the numeric columns."""
    inside = (F.col("value_count") - F.col("outlier_count")) / F.col("value_count")
    return _mean_share(profile.outliers().select(inside.alias("share")))


def quality_scores(profile: Profile, formats: Sequence[str] = STRICT_FORMATS) -> DataFrame:
    """(dimension, score, status) for the five dimensions and ``overall``."""
    profile.require_rows()
    together(profile.source.sparkSession, lambda: profile.duplicates, lambda: profile._outlier_counts)
    parts = {
        "completeness": completeness(profile),
        "consistency": consistency(profile, formats),
        "validity": validity(profile),
        "uniqueness": uniqueness(profile),
        "accuracy": accuracy(profile),
    }
    scores = None
    for name, part in parts.items():
        row = part.select(F.lit(name).alias("dimension"), F.col("score").cast("double").alias("score"))
        scores = row if scores is None else scores.unionByName(row)
    weighted = None
    for name, weight in WEIGHTS.items():
        score = F.max(F.when(F.col("dimension") == name, F.col("score")))
        weighted = score * weight if weighted is None else weighted + score * weight
    # One row whose array holds five scores and the total built from them.
    all_scores = scores.agg(
        F.collect_list(F.struct("dimension", "score")).alias("scores"), F.round(weighted, 2).alias("overall")
    ).select(
        F.inline(
            F.concat(
                "scores",
                F.array(F.struct(F.lit("overall").alias("dimension"), F.col("overall").alias("score"))),
            )
        )
    )
    return all_scores.withColumn("status", quality_status(F.col("dimension"), F.col("score")))


def quality_status(dimension: Column, score: Column) -> Column:
    floor = F.lit(None)
    for name, value in GOOD_FROM.items():
        floor = F.when(dimension == name, F.lit(value)).otherwise(floor)
    good = score >= floor
    return F.when(dimension == "overall", F.when(good, "Excellent").otherwise("Needs Clean")).otherwise(
        F.when(good, "Satisfactory").otherwise("Caution")
    )
