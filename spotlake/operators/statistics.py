"""Summaries, bins and kinetics of localization tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graphs import checkpointed


def optimal_bins(df: DataFrame, column: str, max_bins: int = 1000) -> DataFrame:
    """(n, low, high, width, bins) by the rule of Freedman and Diaconis: width 2 IQR n^(-1/3)."""
    c = F.col(column)
    s = df.where(c.isNotNull()).agg(F.count("*").alias("n"), F.min(c).alias("low"), F.max(c).alias("high"), (F.percentile(c, 0.75) - F.percentile(c, 0.25)).alias("iqr"))
    s = s.withColumn("width", 2 * F.col("iqr") * F.pow(F.col("n").cast("double"), F.lit(-1 / 3)))
    bins = F.least(F.greatest(F.ceil((F.col("high") - F.col("low")) / F.col("width")), F.lit(1)), F.lit(max_bins)).cast("long")
    return s.where("width > 0").select("n", "low", "high", "width", bins.alias("bins"))


def summary(locs: DataFrame, columns: list[str], key: str) -> DataFrame:
    """One row per key: counts, rows per present frame, mean and deviation of each column."""
    aggs = [f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    per = locs.groupBy(key, "frame").agg(F.count("*").alias("_n")).groupBy(key).agg(F.avg("_n").alias("locs_per_frame"))
    return locs.groupBy(key).agg(F.count("*").alias("n_locs"), *aggs).join(per, key)


def common_histogram(locs: DataFrame, key: str, column: str, bins: int, low: float, high: float) -> DataFrame:
    """(key, bin, n) on edges that all keys share; values outside low..high are skipped, the last bin holds high."""
    at = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("long")
    return locs.where(F.col(column).between(low, high)).groupBy(key, at.alias("bin")).agg(F.count("*").alias("n"))


def filter_z_fits(locs: DataFrame, column: str, k: float) -> DataFrame:
    """Rows whose residual is at most k root mean squares."""
    limit = locs.agg((k * F.sqrt(F.avg(F.col(column) * F.col(column)))).alias("_limit"))
    return locs.join(F.broadcast(limit)).where(F.col(column) <= F.col("_limit")).drop("_limit")


def combine_clusters(locs: DataFrame) -> DataFrame:
    """One row per (group, cluster): mean frame, centre weighted by photons, standard errors, count."""
    mass = F.sum("photons")
    center = [(F.sum(F.col(a) * F.col("photons")) / mass).alias(a) for a in "xy"]
    error = [(F.stddev_pop(a) / F.sqrt(F.count("*"))).alias(f"lp{a}") for a in "xy"]
    return locs.groupBy("group", "cluster").agg(F.avg("frame").alias("frame"), *center, *error, F.count("*").alias("n"))


def kinetic_rates(events: DataFrame, key: str, column: str, folds: int | None = None, points: int = 33, rounds: int = 8) -> DataFrame:
    """(key, rate): the time constant t of a column of times in each key, by the least squares fit of
    a(1 - exp(-x/t)) + c to the ranks of all its values; a and c are not negative, t lies between the least and the
    largest value. Keys with at most two or only equal values get their mean, those with negative values null; nulls and
    NaN are no values, and keys without any give no row. Of the many t that fit two distinct values alike, the one
    nearest to their mean is taken.

    Equal values are counted first. Ranges of (key, value) get the first rank from a running sum over the ranges, so
    that no task holds a key. For given t the best a and c follow from sums over the key; these are taken at `points`
    values of t by partial sums in each task, and the bracket around the best shrinks in `rounds`. folds: number of the
    ranges, on which the result does not depend.
    """
    v = F.col(column).cast("double")
    counted = events.where(v.isNotNull() & ~F.isnan(v)).groupBy(F.col(key).alias("_key"), v.alias("_v")).agg(F.count("*").alias("_n"))
    dealt = counted.repartitionByRange(*[folds] if folds else [], "_key", "_v")
    rows = checkpointed(dealt.withColumn("_part", F.spark_partition_id()))

    def same(a: DataFrame, b: DataFrame, *on: str, how: str = "inner") -> DataFrame:
        """A join in which null keys are equal."""
        b = b.withColumnsRenamed({c: f"{c}_r" for c in on})
        return a.join(b, [F.col(c).eqNullSafe(F.col(f"{c}_r")) for c in on], how).drop(*[f"{c}_r" for c in on])

    whole, before = Window.partitionBy("_key"), Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_key", "_part").agg(F.sum("_n").alias("_own"), F.sum(F.col("_n") * F.col("_v")).alias("_sum"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.count("*").alias("_some"))
    parts = parts.select("_key", "_part", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_before"), F.sum("_own").over(whole).alias("_all"), (F.sum("_sum").over(whole) / F.sum("_own").over(whole)).alias("_mean"), F.min("_min").over(whole).alias("_min"), F.max("_max").over(whole).alias("_max"), F.sum("_some").over(whole).alias("_kinds"))
    parts = checkpointed(parts)
    fits = (F.col("_all") > 2) & (F.col("_min") < F.col("_max")) & (F.col("_min") >= 0)
    fitted = parts.where(fits).select("_key", "_part", "_all", "_mean", "_before")

    n, all_ = F.col("_n"), F.col("_all")
    earlier = Window.partitionBy("_key", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_before") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    ranked = same(rows, fitted, "_key", "_part")
    # a run's ranks less their mean over the key, summed; ranks are divided by their number
    ranked = ranked.select("_key", "_part", "_v", "_n", (n * (2 * below + n - all_) / (2 * all_)).alias("_w"))
    ranked = checkpointed(ranked)

    at = lambda j: F.col("_low") * F.pow(F.col("_high") / F.col("_low"), j / (points - 1))
    bracket = parts.where(fits).select("_key", "_all", "_mean", "_kinds", F.least(F.greatest("_min", F.lit(1e-9)), "_max").alias("_low"), F.col("_max").alias("_high")).distinct()
    for _ in range(rounds):
        grid = same(fitted.select("_key", "_part"), bracket, "_key")
        sums = same(ranked, grid, "_key", "_part").withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        sums = sums.withColumn("_t", at(F.col("_j")))
        # from the value at the mean, as the sums of small differences keep their digits
        sums = sums.withColumn("_d", F.exp(-F.col("_v") / F.col("_t")) - F.exp(-F.col("_mean") / F.col("_t")))
        first = [F.first(c).alias(c) for c in ("_all", "_mean", "_kinds", "_low", "_high")]
        sums = sums.groupBy("_key", "_j").agg(F.first("_t").alias("_t"), *first, F.sum(n * F.col("_d")).alias("_d1"), F.sum(n * F.col("_d") * F.col("_d")).alias("_d2"), F.sum(-F.col("_d") * F.col("_w")).alias("_gy"))
        sums = sums.withColumn("_gg", F.col("_d2") - F.col("_d1") * F.col("_d1") / all_).withColumn("_g", 1 - F.exp(-F.col("_mean") / F.col("_t")) - F.col("_d1") / all_)
        yy, y = (all_ * all_ - 1.0) / (12 * all_), (all_ + 1) / (2 * all_)
        a = F.greatest(F.lit(0.0), F.col("_gy") / F.greatest("_gg", F.lit(1e-300)))
        gg, gy = F.col("_gg") + all_ * F.col("_g") * F.col("_g"), F.col("_gy") + all_ * y * F.col("_g")
        b = F.greatest(F.lit(0.0), gy / F.greatest(gg, F.lit(1e-300)))
        free, flat = yy - 2 * a * F.col("_gy") + a * a * F.col("_gg"), yy + all_ * y * y - 2 * b * gy + b * b * gg
        loss = F.when(y - a * F.col("_g") < 0, flat).otherwise(free)
        loss = F.when(F.col("_kinds") == 2, F.round(loss / yy, 9)).otherwise(loss)
        best = sums.groupBy("_key").agg(*first, F.min(F.struct(loss.alias("loss"), F.abs(F.log(F.col("_t") / F.col("_mean"))).alias("off"), F.col("_j").alias("j"))).alias("_best"))
        j = F.col("_best.j")
        bracket = best.select("_key", "_all", "_mean", "_kinds", at(F.greatest(j - 1, F.lit(0))).alias("_low"), at(F.least(j + 1, F.lit(points - 1))).alias("_high"))
    found = same(parts.select("_key", "_all", "_mean", "_min", "_max").distinct(), bracket.select("_key", ((F.col("_low") + F.col("_high")) / 2).alias("_t")), "_key", how="left")
    plain = (F.col("_all") <= 2) | (F.col("_min") == F.col("_max"))
    return found.select(F.col("_key").alias(key), F.when(plain, F.col("_mean")).otherwise(F.col("_t")).alias("rate"))
