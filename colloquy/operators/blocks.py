"""Operators on sampled signals in blocks: ``series_id, channel, start, n, samples``.

A block holds the samples from ``start`` on of a series of ``n`` samples; blocks of a series
don't overlap and may differ in length. A recording of an hour at 16 kHz is some hundred
rows, where the long form of :mod:`colloquy.operators.signal` has 57 million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZE = 1 << 16


def to_blocks(samples: DataFrame, size: int = SIZE) -> DataFrame:
    """Blocks of long rows (series_id, channel, i, value). What a channel lacks within its blocks
    is null; of repeated samples the greatest counts."""
    kinds = dict(samples.dtypes)
    n = samples.groupBy("series_id").agg((F.max("i") + 1).cast("long").alias("n"))

    def fill(table: pa.Table) -> pa.Table:
        start = table.column("b")[0].as_py() * size
        x = np.full(min(size, table.column("n")[0].as_py() - start), np.nan)
        at, values = table.column("i").to_numpy() - start, table.column("value").to_numpy()
        np.fmax.at(x, at, values)
        one = lambda c: table.column(c).slice(0, 1)
        return pa.table({"series_id": one("series_id"), "channel": one("channel"), "start": pa.array([start], pa.int64()), "n": one("n"), "samples": _lists([x])})

    dealt = samples.join(n, "series_id").select("series_id", "channel", F.floor(F.col("i") / size).alias("b"), F.col("i").cast("long").alias("i"), F.col("value").cast("double").alias("value"), "n")
    return dealt.groupBy("series_id", "channel", "b").applyInArrow(fill, f"series_id {kinds['series_id']}, channel {kinds['channel']}, start long, n long, samples array<double>")


def to_samples(blocks: DataFrame) -> DataFrame:
    """Long rows of blocks: the columns but ``start, n, samples``, and ``i, value``."""
    rest = [c for c in blocks.columns if c not in ("start", "n", "samples")]
    return blocks.select(*rest, "start", F.posexplode("samples").alias("_p", "value")).where("value is not null").select(*rest, (F.col("start") + F.col("_p")).alias("i"), "value")


def _rows(batch: pa.RecordBatch):
    """Series, start, length and samples (doubles, null as nan) of each row of a batch; rows are numbered."""
    for k in range(batch.num_rows):
        values = batch.column("samples")[k].values
        if values is not None:
            yield k, batch.column("start")[k].as_py(), batch.column("n")[k].as_py(), values.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.float64(), from_pandas=True))  # nan: null


def downmix_blocks(blocks: DataFrame) -> DataFrame:
    """``series_id, start, n, samples``: the mean over the channels that have a sample, divided by
    the series' peak where that is above 1. The channels of a block meet by one shuffle; channels
    must be cut at the same places. A series of one channel isn't needed in one place."""
    kind = dict(blocks.dtypes)["series_id"]

    def mean(table: pa.Table) -> pa.Table:
        rows = [r for b in table.to_batches() for r in _rows(b)]
        length = max((len(r[3]) for r in rows), default=0)
        total, count = np.zeros(length), np.zeros(length)
        for *_, x in rows:
            have = ~np.isnan(x)
            total[: len(x)][have] += x[have]
            count[: len(x)] += have
        with np.errstate(invalid="ignore", divide="ignore"):
            out = total / count
        return pa.table({"series_id": table.column("series_id").slice(0, 1), "start": table.column("start").slice(0, 1), "n": table.column("n").slice(0, 1), "samples": _lists([out])})

    mono = blocks.groupBy("series_id", "start").applyInArrow(mean, f"series_id {kind}, start long, n long, samples array<double>")
    peak = mono.groupBy("series_id").agg(F.max(F.greatest(F.array_max("samples"), -F.array_min("samples"))).alias("_peak"))
    scaled = F.when(F.col("_peak") > 1, F.transform("samples", lambda x: x / F.col("_peak"))).otherwise(F.col("samples"))
    return mono.join(peak, "series_id").select("series_id", "start", "n", scaled.alias("samples"))


def resample_blocks(blocks: DataFrame, from_rate: int, to_rate: int) -> DataFrame:
    """Linear interpolation at (j+0.5)*n/m-0.5, in blocks that start at the outputs behind each
    block's first sample. A block takes one sample of the next one, so only that many meet
    beside the one shuffle by series."""
    if from_rate <= 0 or to_rate <= 0:
        raise ValueError("rates must be positive")
    if from_rate == to_rate:
        return blocks.select("series_id", "start", "n", F.col("samples").cast("array<double>").alias("samples"))
    kind = dict(blocks.dtypes)["series_id"]
    following = F.lead(F.get("samples", F.lit(0))).over(Window.partitionBy("series_id").orderBy("start"))
    halo = blocks.select("series_id", "start", "n", F.col("samples").cast("array<double>").alias("samples")).withColumn("next", following.cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            took, starts, sizes, lists = [], [], [], []
            for k, start, n, x in _rows(batch):
                m = max(1, int(np.rint(n * to_rate / from_rate)))
                end, after = start + len(x), batch.column("next")[k].as_py()
                # outputs near the block, of which those between its first sample and the next block's stay
                near = lambda i, n=n, m=m: int(np.floor((i + 0.5) * m / n - 0.5))
                j = np.arange(0 if start == 0 else max(0, near(start) - 1), m if end >= n else min(m, near(end) + 2))
                at = np.clip((j + 0.5) * n / m - 0.5, 0, n - 1.0)
                low = np.floor(at).astype(np.int64)
                inside = (low >= start) & (low < end)
                if not inside.any():
                    continue
                low, part = low[inside] - start, (at - low)[inside]
                wide = np.append(x, x[-1] if after is None else after)
                took.append(k)
                starts.append(int(j[inside][0]))
                sizes.append(m)
                lists.append(wide[low] * (1 - part) + wide[low + 1] * part)
            yield pa.RecordBatch.from_arrays([batch.column("series_id").take(pa.array(took, pa.int64())), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), _lists(lists)], names=["series_id", "start", "n", "samples"])

    return halo.mapInArrow(run, f"series_id {kind}, start long, n long, samples array<double>")


def hop_window_blocks(blocks: DataFrame, rate: float, window: float = 1.5, hop: float = 0.75, min_rms: float = 0.01, min_seconds: float = 0.4) -> DataFrame:
    """``win_ix, center, rms, n_samples`` of overlapping windows; short and quiet ones are left out.
    A block gives counts and squares for each window it has a part in; only these are shuffled."""
    w, h = max(1, int(window * rate)), max(1, int(hop * rate))
    kind = dict(blocks.dtypes)["series_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            took, wins, counts, squares, sizes = [], [], [], [], []
            for k, start, n, x in _rows(batch):
                have = ~np.isnan(x)
                count, square = (np.concatenate([[0], np.cumsum(v)]) for v in (have, np.where(have, x, 0.0) ** 2))
                most = (max(1, n - w + 1) - 1) // h
                ix = np.arange(max(0, (start - w) // h + 1), min(most, (start + len(x) - 1) // h) + 1)
                a, b = np.clip(ix * h - start, 0, len(x)), np.clip(ix * h + w - start, 0, len(x))
                took.append(np.full(len(ix), k))
                wins.append(ix)
                counts.append(count[b] - count[a])
                squares.append(square[b] - square[a])
                sizes.append(np.full(len(ix), n))
            join = lambda parts, t: np.concatenate(parts).astype(t) if parts else np.zeros(0, t)
            yield pa.RecordBatch.from_arrays([batch.column("series_id").take(pa.array(join(took, np.int64))), *(pa.array(join(p, t)) for p, t in ((wins, np.int64), (counts, np.int64), (squares, np.float64), (sizes, np.int64)))], names=["series_id", "win_ix", "c", "s", "n"])

    parts = blocks.select("series_id", "start", "n", "samples").mapInArrow(run, f"series_id {kind}, win_ix long, c long, s double, n long")
    out = parts.groupBy("series_id", "win_ix").agg(F.sum("c").alias("n_samples"), F.sum("s").alias("s"), F.max("n").alias("n")).where("n_samples > 0")
    out = out.withColumn("rms", F.sqrt(F.greatest(F.lit(0.0), F.col("s") / F.col("n_samples"))))
    center = (F.col("win_ix") * h + F.least(F.col("n"), F.col("win_ix") * h + w)) / 2.0 / rate
    return out.where((F.col("n_samples") >= min_seconds * rate) & (F.col("rms") >= min_rms)).select("series_id", "win_ix", center.alias("center"), "rms", "n_samples")
