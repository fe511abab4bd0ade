"""Operators on sampled signals and window embeddings, in long form (series_id, i, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def downmix_normalize(samples: DataFrame) -> DataFrame:
    """Mean over channels, divided by the peak where that is above 1."""
    mono = samples.groupBy("series_id", "i").agg(F.avg("value").alias("value"))
    peak = mono.groupBy("series_id").agg(F.max(F.abs("value")).alias("peak"))
    return mono.join(peak, "series_id").select("series_id", "i", F.when(F.col("peak") > 1, F.col("value") / F.col("peak")).otherwise(F.col("value")).alias("value"))


def resample_linear(samples: DataFrame, from_rate: int, to_rate: int) -> DataFrame:
    """Linear interpolation at (j+0.5)*n/m-0.5. Every sample makes the outputs between it and
    the next one, which it meets by equi-join, so no row holds more than a few of them."""
    if from_rate <= 0 or to_rate <= 0:
        raise ValueError("rates must be positive")
    if from_rate == to_rate:
        return samples.select("series_id", "i", "value")
    sizes = samples.groupBy("series_id").agg((F.max("i") + 1).alias("n")).withColumn("m", F.greatest(F.lit(1), F.rint(F.col("n") * to_rate / from_rate).cast("long")))
    low = samples.select("series_id", "i", F.col("value").alias("v0"))
    high = samples.select("series_id", (F.col("i") - 1).alias("i"), F.col("value").alias("v1"))
    pairs = low.join(high, ["series_id", "i"], "left").join(sizes, "series_id")
    # outputs near the sample, of which those between it and the next stay
    near = lambda i: F.floor((i + 0.5) * F.col("m") / F.col("n") - 0.5)
    first = F.when(F.col("i") == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), near(F.col("i")) - 1))
    last = F.when(F.col("i") == F.col("n") - 1, F.col("m") - 1).otherwise(F.least(F.col("m") - 1, near(F.col("i") + 1) + 1))
    at = pairs.where(first <= last).withColumn("j", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    at = at.withColumn("pos", F.greatest(F.lit(0.0), F.least(F.col("n") - 1.0, (F.col("j") + 0.5) * F.col("n") / F.col("m") - 0.5)))
    out = at.where(F.floor("pos") == F.col("i"))
    part = F.col("pos") - F.col("i")
    return out.select("series_id", F.col("j").alias("i"), (F.col("v0") * (1 - part) + F.coalesce("v1", "v0") * part).alias("value"))


def l2_normalize(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def hop_windows(samples: DataFrame, rate: float, window: float = 1.5, hop: float = 0.75, min_rms: float = 0.01, min_seconds: float = 0.4) -> DataFrame:
    """``win_ix, center, rms, n_samples`` of overlapping windows by sample index; short and quiet ones are left out."""
    w, h = max(1, int(window * rate)), max(1, int(hop * rate))
    sizes = samples.groupBy("series_id").agg((F.max("i") + 1).alias("n"))
    x = samples.join(sizes, "series_id")
    last = F.floor((F.greatest(F.lit(1), F.col("n") - w + 1) - 1) / h)
    first = F.greatest(F.lit(0), F.floor((F.col("i") - w) / h) + 1)
    x = x.withColumn("_last", F.least(F.floor(F.col("i") / h), last)).withColumn("_first", first).where("_first <= _last")
    x = x.withColumn("win_ix", F.explode(F.sequence(F.col("_first"), F.col("_last"))))
    out = x.groupBy("series_id", "win_ix").agg(F.count("*").alias("n_samples"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.max("n").alias("n"))
    end = F.least(F.col("n"), F.col("win_ix") * h + w)
    out = out.withColumn("center", (F.col("win_ix") * h + end) / 2.0 / rate).where((F.col("n_samples") >= min_seconds * rate) & (F.col("rms") >= min_rms))
    return out.select("series_id", "win_ix", "center", "rms", "n_samples")


def silhouette_by_group(df: DataFrame, group: list[str], vector: str = "embedding", label: str = "label") -> DataFrame:
    """Mean silhouette by cosine distance per group, exact and linear: the mean distance of a
    unit vector x to a cluster is 1 - x·(sum of its members)/n. A group's sums (one vector for
    each label) meet its rows by one join; rows need no id and are shuffled once."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    x = df.select(*group, F.col(label).alias("_label"), l2_normalize(F.col(vector).cast("array<double>")).alias("_x"))
    sums = x.groupBy(*group, "_label").agg(vector_to_array(Summarizer.sum(array_to_vector("_x"))).alias("sum"), F.count("*").alias("n"))
    all_ = sums.groupBy(*group).agg(F.collect_list(F.struct(F.col("_label").alias("label"), "n", "sum")).alias("_all"), F.count("*").alias("k"))
    dot = lambda s: F.aggregate(F.zip_with("_x", s["sum"], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    far = F.transform("_all", lambda s: F.struct((s["label"] == F.col("_label")).alias("own"), s["n"].alias("n"), (1 - dot(s) / s["n"]).alias("mean")))
    each = x.join(all_, group).withColumn("_far", far)
    own = F.get(F.filter("_far", lambda s: s["own"] & (s["n"] > 1)), F.lit(0))
    a = own["n"] * own["mean"] / (own["n"] - 1)
    b = F.array_min(F.transform(F.filter("_far", lambda s: ~s["own"]), lambda s: s["mean"]))
    score = F.when(a.isNull() | b.isNull(), 0.0).otherwise((b - a) / F.greatest(a, b))
    return each.withColumn("_score", score).groupBy(*group).agg(F.avg("_score").alias("silhouette"), F.max("k").alias("k"))


def choose_k(scores: DataFrame, least: int = 2, most: int = 4) -> DataFrame:
    """``rec_id, k``: the count of best silhouette, ties to the smaller. ``scores``: rec_id, n, k, score."""
    hi = F.least(F.lit(most), F.col("n"))
    lo = F.greatest(F.lit(1), F.least(F.lit(least), hi))
    ok = (F.col("k") >= lo) & (F.col("k") <= hi) & (F.col("k") < F.col("n"))
    best = scores.groupBy("rec_id", "n").agg(F.max_by("k", F.when(ok, F.struct("score", (-F.col("k")).alias("neg")))).alias("best"))
    return best.select("rec_id", F.when(F.col("n") < 2, 1).when(lo == hi, lo).when(lo == 1, 1).otherwise(F.coalesce("best", lo)).cast("int").alias("k"))


def k_floor(k: Column, windows: Column, least: int) -> Column:
    raised = F.when((F.lit(least) >= 2) & (k < 2) & (windows >= 4), 2).otherwise(k)
    return F.greatest(F.lit(1), F.least(raised, windows))
