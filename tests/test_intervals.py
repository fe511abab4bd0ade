"""The overlap join against the rule taken literally."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.operators import intervals as I

WORDS, SEGMENTS = "rec_id string, word_ix int, word string, start double, end double", "rec_id string, seg_ix int, start double, end double, speaker string"


def by_hand(words, segs):
    out = []
    for rec, _, word, a, b in words:
        mine = sorted((s for s in segs if s[0] == rec and s[2] is not None and s[3] is not None), key=lambda s: s[1])
        if a is None or b is None or not mine:
            out.append((rec, word, "SPEAKER_01"))
            continue
        best = max(mine, key=lambda s: (max(0, min(b, s[3]) - max(a, s[2])), -s[1]))
        if min(b, best[3]) - max(a, best[2]) <= 0:
            best = min(mine, key=lambda s: (abs((s[2] + s[3]) / 2 - (a + b) / 2), s[1]))
        out.append((rec, word, best[4]))
    return sorted(out)


@pytest.mark.parametrize("slice_seconds", [4.0, 30.0, I.SLICE_SECONDS])
def test_equals_brute_force(spark, slice_seconds):
    """Slices shorter than words and segments, hour-long segments, ties, equal midpoints, empty and reversed segments, gaps, nulls."""
    rnd = random.Random(int(slice_seconds))
    words, segs = [], []
    for r in range(12):
        rec, span = f"r{r}", rnd.choice([5, 40, 200])
        for i in range(rnd.randrange(0, 14)):
            a = rnd.randrange(0, 8 * span) / 8
            segs.append((rec, i, a, a + rnd.choice([0, -1, 0.25, 1, 3, 20, 3600]), f"S{rnd.randrange(4)}"))
        for i in range(60):
            a = rnd.randrange(-16, 8 * span + 80) / 8
            words.append((rec, i, f"{rec}w{i}", a, a + rnd.choice([0, 0.125, 0.25, 1, 30])))
    words += [("r0", 90, "n1", None, 1.0), ("r0", 91, "n2", 1.0, None), (None, 0, "n3", 1.0, 2.0), ("none", 0, "n4", 1.0, 2.0), *words[:3]]
    segs += [("r0", 50, None, 3.0, "S9"), (None, 1, 0.0, 9.0, "S9"), ("r3", 60, 4.0, 6.0, "S1"), ("r3", 61, 3.0, 7.0, "S2"), ("r3", 62, 5.0, 5.0, "S3")]
    df = spark.createDataFrame(words, WORDS).withColumn("more", F.array("word"))
    got = I.assign_speakers_by_overlap(df, spark.createDataFrame(segs, SEGMENTS), renumber=False, slice_seconds=slice_seconds)
    assert got.columns == [*df.columns, "speaker"]
    assert sorted(((r.rec_id, r.word, r.speaker) for r in got.collect()), key=str) == sorted(by_hand([w for w in words if w[0]], segs) + [(None, "n3", "SPEAKER_01")], key=str)


def test_words_are_shuffled_once(spark):
    df = spark.createDataFrame([("r", 0, "w", 0.0, 1.0)], WORDS).repartition(3)
    plan = I.assign_speakers_by_overlap(df, spark.createDataFrame([("r", 0, 0.0, 1.0, "S")], SEGMENTS))._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("FlatMapCoGroupsInArrow")
    assert len(above) == 2 and "Join" not in above[0] and "Aggregate" not in above[0]
    words = above[1].split("\n:- ")[1].split("\n+- ")[0]
    assert "Generate" not in words and "Join" not in words and "Window" not in words


def test_an_hour_long_segment_costs_no_more():
    rnd = np.random.default_rng(1)
    ws = np.sort(rnd.uniform(0, 3600, 20_000))
    short = np.sort(rnd.uniform(0, 3600, 5000))
    ends = short + rnd.uniform(0.5, 3, 5000)
    took = []
    for ss, se in ((short, ends), (np.append(short, 0.0), np.append(ends, 3600.0))):
        best = []
        for _ in range(3):
            t = time.perf_counter()
            I.most_overlapping(ws, ws + 0.3, ss, se)
            best.append(time.perf_counter() - t)
        took.append(min(best))
    assert took[1] < 3 * took[0] + 0.05


def test_nearest_places():
    middle, t = np.array([5.0, 1.0, 5.0, 9.0]), np.array([0.0, 3.0, 4.0, 5.0, 7.0, 100.0])
    assert I.nearest_places(t, middle).tolist() == [1, 0, 0, 0, 0, 3]
