"""Accuracy over labelled samples, and percentiles by nearest rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(n: Column, d: Column) -> Column:
    """n / d, 0 where d is 0."""
    return F.coalesce(n / F.nullif(d, F.lit(0)), F.lit(0.0))


def confusion(samples: DataFrame, flagged: DataFrame, by: str | None = None) -> DataFrame:
    """One row: counts and ratios. ``samples`` has unit_id, label and category; ``flagged`` a unit_id with any finding.

    Labels compare without case; a leak's category is "secret" or else counts as ip.
    """
    hit = flagged.select("unit_id").distinct().withColumn("_hit", F.lit(True))
    d = samples.join(hit, "unit_id", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    leak = F.lower("label") == "leak"
    secret = leak & F.coalesce(F.col("category") == "secret", F.lit(False))
    ip = leak & ~secret
    count = lambda c: F.count_if(c)
    d = (d.groupBy(by) if by else d.groupBy()).agg(
        count(leak & F.col("_hit")).alias("tp"), count(leak & ~F.col("_hit")).alias("fn"), count(~leak & F.col("_hit")).alias("fp"), count(~leak & ~F.col("_hit")).alias("tn"),
        count(secret).alias("n_secret"), count(secret & F.col("_hit")).alias("tp_secret"), count(ip).alias("n_ip"), count(ip & F.col("_hit")).alias("tp_ip"),
    )
    r = lambda n, m: F.round(ratio(n, m), 3)
    c = F.col
    return d.withColumns({
        "precision": r(c("tp"), c("tp") + c("fp")), "recall": r(c("tp"), c("tp") + c("fn")), "fpr": r(c("fp"), c("fp") + c("tn")),
        "secret_recall": r(c("tp_secret"), c("n_secret")), "ip_recall": r(c("tp_ip"), c("n_ip")),
    })


#: Ranges of values that a group is cut into, of about as many distinct values each.
RANGES = 256


def nearest_rank(values: DataFrame, value: str, quantiles: dict[str, float], by: str | None = None) -> DataFrame:
    """sorted[round((n - 1) * q)] of a number column for each quantile: exact, whatever a group's size.

    Equal values are counted first. A group's values fall into ranges between approximate quantiles; the
    ranges' counts tell which one holds a rank, and only that one is sorted. Nulls don't count; a group of
    nulls alone is left out.
    """
    from pyspark.sql import Window

    key = F.struct(F.col(f"`{by}`") if by else F.lit(0)).alias("_key")  # structs compare null keys as equal
    counts = values.select(key, F.col(f"`{value}`").alias("_v")).where("_v is not null").groupBy("_key", "_v").agg(F.count(F.lit(1)).alias("_n"))
    bounds = counts.groupBy("_key").agg(F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)], 10_000).alias("_bounds"))
    placed = counts.join(bounds, "_key").select("_key", "_v", "_n", F.size(F.filter("_bounds", lambda b: b < F.col("_v"))).alias("_range"))
    ranges = placed.groupBy("_key", "_range").agg(F.sum("_n").alias("_n"))  # at most RANGES rows of a group
    upto = F.sum("_n").over(Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    ranges = ranges.withColumns({"_upto": upto, "_total": F.sum("_n").over(Window.partitionBy("_key"))})
    ranks = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.floor((F.col("_total") - 1) * F.lit(float(q)) + 0.5).alias("rank")) for name, q in quantiles.items()))).alias("_q")
    start = F.col("_upto") - F.col("_n")
    wanted = ranges.select("_key", "_range", start.alias("_start"), "_upto", ranks).where("_q.rank >= _start and _q.rank < _upto").select("_key", "_range", "_start", "_q.*")
    within = Window.partitionBy("_key", "name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = placed.join(wanted, ["_key", "_range"]).withColumn("_reached", F.col("_start") + F.sum("_n").over(within))
    picks = [F.min(F.when((F.col("name") == name) & (F.col("_reached") > F.col("rank")), F.col("_v"))).alias(name) for name in quantiles]
    out = near.groupBy("_key").agg(*picks)
    return out.select(*([F.col("_key")[by].alias(by)] if by else []), *quantiles)
