"""Resolution by the correlation of Fourier rings, and a test of two distributions by permutations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .images import hash_half, tukey_window
from .shared import checkpointed
from .tables import render_histogram

SPECTRUM = "iy long, k long, ar double, ai double, br double, bi double"


def loess(values: np.ndarray, span: int, rounds: int = 3) -> np.ndarray:
    """Local lines through the `span` (made odd) nearest values, by tricube weights; values far off the lines count less in each
    further round."""
    n = len(values)
    k = min(span + 1 - span % 2, n)
    x, trust, out = np.arange(n, dtype=float), np.ones(n), np.asarray(values, float).copy()
    for _ in range(rounds + 1):
        for i in range(n):
            low = min(max(i - k // 2, 0), n - k)
            own = slice(low, low + k)
            far = np.abs(x[own] - x[i])
            reach = far.max()
            w = np.where(far <= 0.001 * reach, 1.0, np.where(far < 0.999 * reach, (1 - (far / max(reach, 1e-300)) ** 3) ** 3, 0.0)) * trust[own]
            if w.sum() <= 0:
                continue
            w = w / w.sum()
            mean = (w * x[own]).sum()
            spread = (w * (x[own] - mean) ** 2).sum()
            if math.sqrt(spread) > 0.001 * max(n - 1, 1):
                w = w * (1 + (x[i] - mean) * (x[own] - mean) / spread)
            out[i] = (w * values[own]).sum()
        off = np.abs(values - out)
        limit = 6 * np.median(off)
        if limit <= 0:
            break
        trust = np.where(off < 0.999 * limit, np.where(off <= 0.001 * limit, 1.0, (1 - (off / limit) ** 2) ** 2), 0.0)
    return out


def ring_sums(image: DataFrame, n: int) -> DataFrame:
    """(ring, cross, power_a, power_b): for two images (iy, ix, a, b) of n x n pixels, n odd, the products of their Fourier
    transforms over the rings of radius up to n / 2.

    One task transforms a row, then another a column, so no task holds more than n values a transform. Of real images half of
    the columns tell all.
    """

    def along_rows(rows: pd.DataFrame) -> pd.DataFrame:
        line = np.zeros((2, n))
        line[0, rows["ix"]], line[1, rows["ix"]] = rows["a"], rows["b"]
        a, b = np.fft.rfft(line)
        return pd.DataFrame({"iy": rows["iy"].iloc[0], "k": np.arange(len(a)), "ar": a.real, "ai": a.imag, "br": b.real, "bi": b.imag})

    def along_columns(rows: pd.DataFrame) -> pd.DataFrame:
        line = np.zeros((2, n), complex)
        line[0, rows["iy"]], line[1, rows["iy"]] = rows["ar"] + 1j * rows["ai"], rows["br"] + 1j * rows["bi"]
        a, b = np.fft.fft(line)
        k = int(rows["k"].iloc[0])
        away = np.rint(np.fft.fftfreq(n) * n)
        ring, weight = np.floor(np.sqrt(away * away + k * k)).astype(np.int64), 2.0 if k else 1.0
        out = pd.DataFrame({"ring": ring, "cross": weight * (a * b.conj()).real, "power_a": weight * np.abs(a) ** 2, "power_b": weight * np.abs(b) ** 2})
        return out[out["ring"] <= n // 2].groupby("ring", as_index=False).sum()

    rows = image.groupBy("iy").applyInPandas(along_rows, SPECTRUM)
    parts = rows.groupBy("k").applyInPandas(along_columns, "ring long, cross double, power_a double, power_b double")
    return parts.groupBy("ring").agg(*[F.sum(c).alias(c) for c in ("cross", "power_a", "power_b")])


def ring_correlation(locs: DataFrame, view: tuple[float, float, float, float], precision: float, pixelsize: float, seed: int = 42) -> tuple[DataFrame, float | None]:
    """((ring, frequency, frc, smooth), resolution in nm): of rows inside x0, y0, x1, y1, cut to a square about its middle.

    The rows are split in halves by a hash of loc_id, rendered at half the precision (in pixels), faded out at the edges and
    correlated. The resolution is where the smoothed curve first falls below 1/7; None if it never does. The driver sees one
    value a ring.
    """
    x0, y0, x1, y1 = view
    side, cx, cy = min(x1 - x0, y1 - y0), (x0 + x1) / 2, (y0 + y1) / 2
    x0, x1, y0, y1 = cx - side / 2, cx + side / 2, cy - side / 2, cy + side / 2
    bin_size = precision / 2
    n = math.ceil((y1 - y0) / bin_size)
    n -= 1 - n % 2
    half = lambda h: render_histogram(locs.where(hash_half(F.col("loc_id"), seed) == h), 1 / bin_size, x0, y0, x1, y1).where((F.col("iy") < n) & (F.col("ix") < n))
    a, b = (tukey_window(half(h), n).withColumnRenamed("value", name) for h, name in ((0, "a"), (1, "b")))
    both = a.join(b, ["iy", "ix"], "full").select("iy", "ix", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in "ab"])
    sums = {r["ring"]: r for r in ring_sums(both, n).collect()}
    curve = np.zeros(n // 2 + 1)
    for ring, r in sums.items():
        scale = math.sqrt(r["power_a"] * r["power_b"])
        curve[ring] = r["cross"] / scale if scale else 0.0
    smooth = loess(curve, max(math.ceil((n // 2) / 20), 5))
    frequency = np.arange(len(curve)) / n / (pixelsize * bin_size)
    found = None
    for i in range(1, len(curve)):
        if smooth[i - 1] >= 1 / 7 > smooth[i]:
            found = 1 / float(np.interp(-1 / 7, [-smooth[i - 1], -smooth[i]], frequency[i - 1 : i + 1]))
            break
    rows = [(i, *map(float, v)) for i, v in enumerate(zip(frequency, curve, smooth, strict=True))]
    return locs.sparkSession.createDataFrame(rows, "ring long, frequency double, frc double, smooth double"), found


def permutation_test(rows: DataFrame, label: str, value: str, a, b, iterations: int = 1000, seed: int = 0) -> DataFrame:
    """(ks, p_permutation, p_asymptotic): the largest distance between the distributions of two labels, the share of random
    permutations of the labels with at least that distance, and the limit law's probability. Nulls if a label has no rows.

    Values are counted first. A permutation then deals the first label's rows over the values without replacement: the driver
    deals them over ranges of values, the tasks over the values of their range, so rows are neither copied nor ordered again.
    numpy deals at most 1e9 rows; more are an error.
    """
    spark = rows.sparkSession
    counts = rows.where(F.col(label).isin(a, b) & F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.sum((F.col(label) == a).cast("long")).alias("na"), F.count("*").alias("n"))
    dealt = checkpointed(counts.repartitionByRange(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "value").withColumn("part", F.spark_partition_id()))
    sums = sorted(dealt.groupBy("part").agg(F.sum("na"), F.sum("n")).collect())
    n, first = sum(r[2] for r in sums), sum(r[1] for r in sums)
    if not 0 < first < n:
        return spark.range(1).select(*[F.lit(None).cast("double").alias(c) for c in ("ks", "p_permutation", "p_asymptotic")])
    if n >= 10**9:
        raise ValueError(f"{n} rows are too many to permute")
    shares = np.vstack([[r[1] for r in sums], np.random.default_rng(seed).multivariate_hypergeometric([r[2] for r in sums], first, size=iterations)])
    before = np.cumsum(shares, axis=1) - shares
    earlier = np.cumsum([0, *[r[2] for r in sums]])
    plan = [(r[0], int(earlier[i]), shares[:, i].tolist(), before[:, i].tolist()) for i, r in enumerate(sums)]
    side = spark.createDataFrame(plan, "part int, earlier long, shares array<long>, before array<long>")

    def deal(own: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        own, row = own.sort_values("value"), plan.iloc[0]
        size, rng = own["n"].to_numpy(), np.random.default_rng([seed, int(row["part"]), 1])
        upto = row["earlier"] + np.cumsum(size)
        far = np.zeros(len(row["shares"]), np.int64)
        for i, (share, start) in enumerate(zip(row["shares"], row["before"], strict=True)):
            mine = rng.multivariate_hypergeometric(size, share, method="marginals") if i else own["na"].to_numpy()
            upto_a = start + np.cumsum(mine)
            far[i] = np.abs(upto_a * (n - first) - (upto - upto_a) * first).max()
        return pd.DataFrame({"turn": np.arange(len(far)), "far": far})

    far = dealt.groupBy("part").cogroup(side.groupBy("part")).applyInPandas(deal, "turn long, far long").groupBy("turn").agg(F.max("far").alias("far"))
    seen = far.where("turn = 0").select(F.col("far").alias("seen"))
    found = far.where("turn > 0").join(F.broadcast(seen)).agg(F.first("seen").alias("seen"), F.avg((F.col("far") >= F.col("seen")).cast("double")).alias("p_permutation"))  # one row
    ks = F.col("seen") / (first * (n - first))
    lam = math.sqrt(first * (n - first) / n)
    terms = [2 * (-1) ** (j - 1) * F.exp(-2 * j * j * F.pow(ks * lam, 2)) for j in range(1, 101)]
    tail = F.when(ks * lam < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(sum(terms[1:], terms[0]), F.lit(0.0)), F.lit(1.0)))
    return found.select(ks.alias("ks"), "p_permutation", tail.alias("p_asymptotic"))
