"""From findings to verdicts: bands, ranked adjudication, policy, counts and exit codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The bands of confidence, how many ambiguous findings of a unit are adjudicated, and the result's confidence.
LOW, HIGH, ADJUDICATED, LEAK_CONFIDENCE, BLOCK_FROM = 0.4, 0.8, 3, 0.85, 0.7
#: Findings of equal confidence keep the order in which the detectors come to them.
ORDER = ("phase", "file", "line_no", "match_ord")


def band(confidence: Column) -> Column:
    return F.when(confidence >= HIGH, "confirmed").when(confidence >= LOW, "ambiguous").otherwise("dropped")


def to_adjudicate(findings: DataFrame) -> DataFrame:
    """The first ambiguous findings of each unit, with rank from 1."""
    w = Window.partitionBy("unit_id").orderBy(F.desc("confidence"), *ORDER)
    unsure = findings.where(band(F.col("confidence")) == "ambiguous")
    return unsure.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= ADJUDICATED)


KEY = ("unit_id", "file", "line_no", "rule_id", "phase", "match_ord")


def routed(findings: DataFrame, labels: DataFrame | None = None, fallback: str = "report") -> DataFrame:
    """The findings to report. ``labels`` (KEY and label) are what an adjudicator said of ``to_adjudicate``.

    leak: reported as semantic, with its own confidence; clean: gone; no answer: reported as skipped, or
    gone where ``fallback`` is "clean". Ambiguous findings past the adjudicated are reported as they are.
    """
    d = findings.where(band(F.col("confidence")) != "dropped")
    if labels is None:
        return d
    # who is asked is at most three rows of a unit, which each task cuts down to before they meet
    asked = to_adjudicate(findings).select(*KEY)
    said = asked.join(labels.select(*(F.col(k).alias(f"_{k}") for k in KEY), F.lower("label").alias("_label")), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY], "left")
    said = said.select(*(F.col(k).alias(f"_{k}") for k in KEY), "_label", F.lit(True).alias("_asked"))
    d = d.join(said, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY], "left")
    answer = F.coalesce("_label", F.lit(""))
    was_asked = F.coalesce("_asked", F.lit(False))
    leak, clean = was_asked & answer.startswith("leak"), was_asked & answer.startswith("clean")
    skipped = was_asked & ~leak & ~clean
    gone = clean | skipped if fallback == "clean" else clean
    return d.where(~gone).withColumns({
        "confidence": F.when(leak, LEAK_CONFIDENCE).otherwise(F.col("confidence")), "layer": F.when(leak, "semantic").otherwise(F.col("layer")), "ai_skipped": F.when(skipped, True).otherwise(F.col("ai_skipped")),
    }).select(*findings.columns)


def in_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc("confidence"), "unit_id", *ORDER)


def verdict(tier: Column, confidence: Column) -> Column:
    blocks = (tier == "T0") | (tier == "T1") & (confidence >= BLOCK_FROM)
    return F.when((confidence == 0) | tier.isNull(), "allow").when(blocks, "block").when(tier.isin("T1", "T2"), "warn").otherwise("allow")


def tier_counts(findings: DataFrame, *by: str) -> DataFrame:
    return findings.groupBy(*by, "tier").agg(F.count(F.lit(1)).alias("n"))


def fails_build(findings: DataFrame, tiers: Sequence[str] = ()) -> DataFrame:
    """One row, fails: any finding, or any of the tiers."""
    return findings.agg(fails(tiers).alias("fails"))


def fails(tiers: Sequence[str] = ()) -> Column:
    """``fails_build`` as an aggregate, so that several can be had of one scan."""
    hit = F.upper("tier").isin(*(t.upper() for t in tiers)) if tiers else F.lit(True)
    return F.coalesce(F.max(hit), F.lit(False))


def exit_codes(findings: DataFrame, tiers: Sequence[str] = (), shadow: bool = False) -> DataFrame:
    """unit_id, exit_code: 1 where a tier to fail on was found, or something is blocked outside shadow mode."""
    named = F.upper("tier").isin(*(t.upper() for t in tiers)) if tiers else F.lit(False)
    blocked = F.lit(not shadow) & (verdict(F.col("tier"), F.col("confidence")) == "block")
    return findings.groupBy("unit_id").agg(F.max(F.coalesce(named | blocked, F.lit(False)).cast("int")).alias("exit_code"))
