"""Ordered visibility tiers as column expressions: an unknown label has a null rank and is visible to nobody."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tiers, lowest first.
TIERS = ("public", "resident", "staff")


def tier_rank(tier: Column) -> Column:
    """0, 1, 2 or null."""
    out = F.when(tier == TIERS[0], 0)
    for n, name in enumerate(TIERS[1:], 1):
        out = out.when(tier == name, n)
    return out


def caller_rank(tier: str) -> int:
    """Rank of a caller's tier; an unknown one is refused before any data is read."""
    if tier not in TIERS:
        raise ValueError(f"unknown tier {tier!r}, expected one of {', '.join(TIERS)}")
    return TIERS.index(tier)


def visible(tier: Column, caller: Column | str) -> Column:
    """Whether a row of ``tier`` may be seen by the caller; null (so: no) for broken labels."""
    rank = F.lit(caller_rank(caller)) if isinstance(caller, str) else tier_rank(caller)
    return tier_rank(tier) <= rank


def tier_table(spark: SparkSession) -> DataFrame:
    """The three-row dimension ``(tier, rank)``."""
    return spark.createDataFrame([(t, n) for n, t in enumerate(TIERS)], "tier string, rank int")


def default_tier(tier: Column) -> Column:
    """A user's tier, or the lowest one where it is missing or unknown."""
    return F.when(tier.isin(*TIERS), tier).otherwise(TIERS[0])
