"""Interval and nearest-time joins between words and segments of the same recording.

An overlap join cogroups words and segments by recording and long slices of time, and finds
the segments of a slice's words by binary search; a nearest join is two window functions
over one sort. No theta join is planned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SPEAKER = "SPEAKER_01"
#: Words of a recording that start within so many seconds meet in one task.
SLICE_SECONDS = 6 * 3600.0
#: Pairs of a word and a segment that are compared at once.
PAIRS = 1 << 20


def interval_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def most_overlapping(ws: np.ndarray, we: np.ndarray, ss: np.ndarray, se: np.ndarray) -> np.ndarray:
    """For each word the place of the segment that overlaps it most, ties to the first one; -1
    where none does.

    Segments are taken by classes of length, each twice as long as the last. In a class sorted
    by start those that can overlap a word are neighbours: they start before it ends and no
    earlier than the class's longest segment before it starts. So a long segment is looked at
    for the words it covers and hides no short ones."""
    best, gain = np.full(len(ws), -1), np.zeros(len(ws))
    length = se - ss
    kind = np.where(length > 0, np.frexp(np.where(length > 0, length, 1.0))[1], np.iinfo(np.int32).max)
    for c in np.unique(kind[length > 0]):
        some = np.flatnonzero(kind == c)
        some = some[np.argsort(ss[some], kind="stable")]
        starts, longest = ss[some], length[some].max()
        # a margin for the rounding of the difference; what doesn't overlap gives no gain
        first = np.searchsorted(starts, ws - longest - 1e-9 * (np.abs(ws) + longest), "left")
        count = np.maximum(np.searchsorted(starts, we, "left") - first, 0)
        total = np.concatenate([[0], np.cumsum(count)])
        at = 0
        while at < len(ws):
            end = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
            n = count[at:end]
            if n.any():
                word = np.repeat(np.arange(at, end), n)
                seg = some[np.arange(len(word)) - np.repeat(total[at:end] - total[at], n) + np.repeat(first[at:end], n)]
                over = np.minimum(we[word], se[seg]) - np.maximum(ws[word], ss[seg])
                order = np.lexsort((seg, -over, word))
                top = order[np.concatenate([[True], np.diff(word[order]) > 0])]
                w, s, o = word[top], seg[top], over[top]
                wins = (o > gain[w]) | ((o > 0) & (o == gain[w]) & (s < best[w]))
                best[w[wins]], gain[w[wins]] = s[wins], o[wins]
            at = end
    return best


def nearest_places(t: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """For each time the place of the nearest midpoint, ties to the first one; there is one at least."""
    order = np.argsort(middle, kind="stable")
    sorted_, first = np.unique(middle[order], return_index=True)
    place = order[first]
    after = np.searchsorted(sorted_, t, "left")
    a, b = np.minimum(after, len(place) - 1), np.maximum(after - 1, 0)
    da, db = np.abs(sorted_[a] - t), np.abs(t - sorted_[b])
    return np.where((db < da) | ((db == da) & (place[b] < place[a])), place[b], place[a])


def nearest(times: DataFrame, centers: DataFrame) -> DataFrame:
    """``rec_id, t, ix, speaker`` of the center nearest to each time.

    ``times`` have (rec_id, t), ``centers`` (rec_id, ix, t, speaker). Ties go to the lowest ix;
    recordings without centers give null."""
    one = centers.groupBy("rec_id", "t").agg(F.min_by(F.struct("ix", "speaker"), "ix").alias("c"))
    both = one.select("rec_id", "t", F.struct(F.col("t").alias("t"), F.col("c.ix").alias("ix"), F.col("c.speaker").alias("speaker")).alias("c"), F.lit(False).alias("asked"))
    both = both.unionByName(times.select("rec_id", "t", F.lit(None).cast(both.schema["c"].dataType).alias("c"), F.lit(True).alias("asked")))
    order = Window.partitionBy("rec_id").orderBy("t")
    # frames that end at the partition's end are scanned anew for each row, so the centers ahead are found in descending order
    down = Window.partitionBy("rec_id").orderBy(F.desc("t"))
    back = F.last("c", ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.last("c", ignorenulls=True).over(down.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    both = both.withColumn("b", back).withColumn("a", ahead).where("asked")
    db, da = F.abs(F.col("t") - F.col("b.t")), F.abs(F.col("a.t") - F.col("t"))
    pick = F.when(F.col("b").isNull() | (da < db) | ((da == db) & (F.col("a.ix") < F.col("b.ix"))), F.col("a")).otherwise(F.col("b"))
    return both.withColumn("p", pick).select("rec_id", "t", F.col("p.ix").alias("ix"), F.col("p.speaker").alias("speaker"))


def renumber_first_seen(df: DataFrame, label: str = "speaker", order: str = "ix", out: str = "speaker") -> DataFrame:
    """Labels as SPEAKER_01, SPEAKER_02, ... in the order in which a recording first shows them."""
    first = df.groupBy("rec_id", F.col(label).alias("_label")).agg(F.min(order).alias("_first"))
    ranked = first.withColumn("_name", F.format_string("SPEAKER_%02d", F.dense_rank().over(Window.partitionBy("rec_id").orderBy("_first"))))
    joined = df.join(ranked, (df["rec_id"] == ranked["rec_id"]) & df[label].eqNullSafe(ranked["_label"])).drop(ranked["rec_id"])
    return joined.drop("_label", "_first").withColumn(out, F.col("_name")).drop("_name")


def assign_speakers_by_overlap(words: DataFrame, segments: DataFrame, renumber: bool = True, slice_seconds: float = SLICE_SECONDS) -> DataFrame:
    """Words with ``speaker`` of the segment of greatest overlap, else of the nearest midpoint;
    SPEAKER_01 in recordings without segments and for words without times. Ties go to the lowest
    seg_ix. Words may repeat and have any other columns; segments without times count for none.

    Words are shuffled once, by recording and the slice of time in which they start, and meet the
    segments there (see :func:`most_overlapping`). A segment goes to each slice with a word that
    could overlap it or have the nearest midpoint in it: those from its start, or the midpoint
    before its own, less the recording's longest word, to its end, or the midpoint behind it.
    That is one slice for all but the longest recordings, whatever the segment's length."""
    named = renumber_first_seen(segments, order="seg_ix") if renumber else segments.withColumn("speaker", F.when(F.coalesce("speaker", F.lit("")) == "", DEFAULT_SPEAKER).otherwise(F.col("speaker")))
    words = words.drop("speaker")
    at = lambda t: F.floor(t / slice_seconds)
    extent = words.groupBy("rec_id").agg(F.min("start").alias("_min"), F.max("start").alias("_max"), F.greatest(F.lit(0.0), F.max(F.col("end") - F.col("start"))).alias("_long"))
    s = named.select("rec_id", F.col("seg_ix").alias("_ix"), F.col("start").cast("double").alias("_s"), F.col("end").cast("double").alias("_e"), F.col("speaker").alias("_speaker")).where("_s is not null and _e is not null")
    s = s.withColumn("_t", (F.col("_s") + F.col("_e")) / 2)
    # of segments with the same midpoint the first one borders on the midpoints on both sides
    before = F.lag("_t").over(Window.partitionBy("rec_id").orderBy("_t", "_ix"))
    after = F.lead("_t").over(Window.partitionBy("rec_id").orderBy("_t", F.desc("_ix")))
    s = s.withColumn("_b", before).withColumn("_a", after).join(extent, "rec_id")
    low = F.when(F.col("_b").isNull(), at(F.col("_min"))).otherwise(at(F.least("_s", "_b") - F.col("_long")))
    high = F.when(F.col("_a").isNull(), at(F.greatest("_max", "_e"))).otherwise(at(F.greatest("_e", "_a")))
    low, high = F.greatest(low, at(F.col("_min"))), F.least(high, at(F.col("_max")))
    s = s.where(low <= high).select("rec_id", F.explode(F.sequence(low, high)).alias("_slice"), "_ix", "_s", "_e", "_t", "_speaker")
    out = words.withColumn("speaker", F.lit(""))
    names = out.columns

    def assign(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return left.append_column("speaker", pa.array([DEFAULT_SPEAKER] * left.num_rows, pa.string())).select(names)
        ss, se, st = (right.column(c).to_numpy() for c in ("_s", "_e", "_t"))
        order = np.lexsort((se, ss, right.column("_ix").to_numpy()))
        ws, we = (left.column(c).cast(pa.float64()).to_numpy() for c in ("start", "end"))
        timed = np.flatnonzero(~np.isnan(ws) & ~np.isnan(we))
        place = most_overlapping(ws[timed], we[timed], ss[order], se[order])
        lost = place < 0
        place[lost] = nearest_places((ws[timed] + we[timed])[lost] / 2, st[order])
        # one more name, for words without times
        who = np.full(left.num_rows, len(order))
        who[timed] = order[place]
        speakers = pa.chunked_array([*right.column("_speaker").chunks, pa.array([DEFAULT_SPEAKER], pa.string())]).take(pa.array(who))
        return left.append_column("speaker", speakers).select(names)

    keyed = words.withColumn("_slice", at(F.col("start").cast("double")))
    return keyed.groupBy("rec_id", "_slice").cogroup(s.groupBy("rec_id", "_slice")).applyInArrow(assign, out.schema)


def assign_nearest(words: DataFrame, windows: DataFrame) -> DataFrame:
    """Words with the renumbered label of the window whose center is nearest to their midpoint.

    Only the distinct midpoints of a recording are sorted with its centers; words find theirs by
    recording and midpoint, so the words of a recording don't meet in one task."""
    named = renumber_first_seen(windows.select("rec_id", "win_ix", "center", "label"), label="label", order="win_ix")
    centers = named.select("rec_id", F.col("win_ix").alias("ix"), F.col("center").alias("t"), "speaker")
    words = words.drop("speaker").withColumn("_t", (F.col("start") + F.col("end")) / 2)
    near = nearest(words.select("rec_id", F.col("_t").alias("t")).distinct(), centers).select(F.col("rec_id").alias("_rec"), F.col("t").alias("_at"), "speaker")
    met = words.join(near, (F.col("rec_id") == F.col("_rec")) & F.col("_t").eqNullSafe(F.col("_at")), "left").drop("_t", "_rec", "_at")
    return met.withColumn("speaker", F.coalesce("speaker", F.lit(DEFAULT_SPEAKER)))


def inherit_speaker(words: DataFrame, old_turns: DataFrame) -> DataFrame:
    """As by overlap, against turns, whose names are kept."""
    return assign_speakers_by_overlap(words, old_turns.select("rec_id", F.col("turn_ix").alias("seg_ix"), "start", "end", "speaker"), renumber=False)


def _touched(turns: DataFrame, edits: DataFrame, how: str) -> DataFrame:
    e = edits.select(F.col("rec_id").alias("_rec"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = (F.col("rec_id") == F.col("_rec")) & (F.least("end", "_e") - F.greatest("start", "_s") > 0)
    return turns.join(e, hit, how)


def turns_inside_ranges(turns: DataFrame, edits: DataFrame) -> DataFrame:
    return _touched(turns, edits, "left_semi")


def turns_outside_ranges(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """Turns that overlap no range; turns that only touch one are outside."""
    return _touched(turns, edits, "left_anti")
