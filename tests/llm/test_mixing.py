"""Mixing to given targets: the deviation is measured from the targets, not from rounded weights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import mixing


def _sources(spark, n, names):
    name = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("id") % len(names) + 1).cast("int"))
    return spark.range(n).select(F.col("id").alias("doc_id"), name.alias("source"))


def _deviations(out, targets):
    """Greatest deviation in blocks of each source from its target over all slots, and the number of slots."""
    blocks = out.select("source", "mix_slot", "mix_release", "mix_deadline").distinct().toPandas().sort_values("mix_slot")
    assert blocks.mix_slot.tolist() == list(range(len(blocks)))
    assert ((blocks.mix_release <= blocks.mix_slot) & (blocks.mix_slot < blocks.mix_deadline)).all()
    t, total = np.arange(1, len(blocks) + 1), sum(targets.values())
    return {k: np.abs((blocks.source == k).cumsum().to_numpy() - t * v / total).max() for k, v in targets.items()}, len(blocks)


@pytest.mark.parametrize("share", [1, 1 / 3, 0.1 + 0.2])
def test_equal_targets_stay_within_a_block_at_any_length(spark, share):
    targets = dict.fromkeys("abc", share)
    off, slots = _deviations(mixing.mix(_sources(spark, 12_000, "abc"), block_rows=1, targets=targets), targets)
    assert slots == 12_000 and max(off.values()) < 1


@pytest.mark.parametrize("targets", [{"a": 1 / 3, "b": 1 / 7, "c": 11 / 21}, {"a": 0.123, "b": 0.4567, "c": 0.4203}, {"a": 2, "b": 3, "c": 1e-3}])
def test_uneven_targets_stay_within_a_block(spark, targets):
    off, slots = _deviations(mixing.mix(_sources(spark, 3000, "abc"), block_rows=1 if targets["c"] > 0.01 else 500, targets=targets), targets)
    assert slots > 2000 and max(off.values()) < 1


def test_very_small_target(spark):
    targets = {"small": 1e-5, "large": 1 - 1e-5}
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "small").otherwise("large").alias("source"))
    weights = {r.source: r.w for r in mixing.target_weights(rows.groupBy("source").agg(F.count("*").alias("n")), targets).collect()}
    assert weights == {"small": 1, "large": 99_999}
    off, slots = _deviations(mixing.mix(rows, block_rows=1, targets=targets), targets)
    assert slots >= 29_999 and max(off.values()) < 1


def test_targets_without_a_short_common_denominator(spark):
    targets = {"a": np.pi, "b": np.e, "c": np.sqrt(2)}
    assert mixing._whole_numbers(targets) is None
    counts = _sources(spark, 30, "abc").groupBy("source").agg(F.count("*").alias("n"))
    weights = {r.source: r.w for r in mixing.target_weights(counts, targets).collect()}
    assert sum(weights.values()) == mixing.MOST_SLOTS
    assert all(abs(w / mixing.MOST_SLOTS - targets[k] / sum(targets.values())) <= 1.5 / mixing.MOST_SLOTS for k, w in weights.items())


def test_odd_targets(spark):
    counts = _sources(spark, 30, "abc").groupBy("source").agg(F.count("*").alias("n"))
    of = lambda targets: {r.source: r.w for r in mixing.target_weights(counts, targets).collect()}
    assert of({"a": 1, "b": 1, "c": 2, "elsewhere": 5}) == {"a": 1, "b": 1, "c": 2}
    assert of({"a": 1e-300, "b": 1e-300, "c": 2e-300}) == {"a": 1, "b": 1, "c": 2}
    assert of({"a": 1, "b": 1, "c": 0}) == of({"a": 1, "b": 1}) == {"a": 500, "b": 499, "c": 1}
    for bad in (-1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            of({"a": 1, "b": bad})
