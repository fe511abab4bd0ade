"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Rows of a source are put in a shuffled order that starts again when it is through (an
epoch), and this endless sequence is cut into blocks of equal size. With integer weights
w that add up to Q, block j (from 1) of a source has the release time floor((j-1)*Q/w)
and the deadline ceil(j*Q/w); every slot goes to the released block of the earliest
deadline. As the weights fill the slots exactly, every block meets its window, so after
any number t of slots a source has had more than t*w/Q - 1 and less than t*w/Q + 1
blocks, and as all blocks are full, the same holds of rows. The schedule repeats after Q
slots; those are computed once.

Given targets are taken as fractions, and Q is the sum of their multiples by the common
denominator: three equal targets have Q = 3, and 0.00001 beside 0.99999 has Q = 100,000. So
the bound holds for the targets themselves at every slot. Only where that takes more than
``MOST_SLOTS`` are they rounded, to ``1 / MOST_SLOTS``. Without targets they are defined as
n**power in parts of ``PERIOD``.

Sources of equal weight have equal windows, so they take turns as one class: the
schedule is over classes, of which there are at most sqrt(2Q), however many sources
there are. The schedule's rows (Q in all) meet the documents through a join, as a broadcast
while they are MOST_SLOTS at most.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import cut

#: Slots of one period: the precision of the weights. It is lengthened to so many for each source.
PERIOD, SLOTS_EACH = 1000, 4
#: Slots of the longest period of given targets, and the greatest denominator of one.
MOST_SLOTS = 1 << 18
#: Natural shares to this power are the default targets (1 keeps them, 0 makes them equal).
POWER = 0.7
BLOCK_ROWS = 16
#: Slots whose classes are found in one step of the schedule.
_STRETCH = 1000
PLACES = ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_epoch")


def integer_weights(counts: DataFrame, power: float = POWER, period: int = PERIOD, targets: dict | None = None) -> DataFrame:
    """``source, n, w``: weights that add up to ``period`` (or more with many sources), at least 1 for every source, in
    proportion to ``targets`` (source to share, of any sum) or else to n**power, by largest
    remainders (ties to the smaller source). A source without a target gets the least weight."""
    alone = Window.partitionBy()
    if targets is None:
        share = counts.withColumn("x", F.pow("n", F.lit(power)))
    else:
        schema = T.StructType([T.StructField("_of", T.StringType()), T.StructField("x", T.DoubleType())])
        given = counts.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], schema)
        share = counts.join(given, F.col("source").cast("string").eqNullSafe(F.col("_of")), "left").select("source", "n", F.coalesce("x", F.lit(0.0)).alias("x"))
    share = share.withColumn("m", F.count("*").over(alone)).withColumn("slots", F.greatest(F.lit(period), SLOTS_EACH * F.col("m")))
    share = share.withColumn("exact", F.round(F.col("slots") * F.col("x") / F.greatest(F.sum("x").over(alone), F.lit(1e-300)), 9))
    # every source has one slot; those with a claim to more share what the slots of the others leave
    more = F.greatest(F.col("exact") - 1, F.lit(0.0))
    share = share.withColumn("extra", F.round((F.col("slots") - F.col("m")) * more / F.greatest(F.sum(more).over(alone), F.lit(1e-300)), 9))
    share = share.withColumn("whole", F.floor("extra").cast("long"))
    left = F.col("slots") - F.col("m") - F.sum("whole").over(alone)
    order = F.row_number().over(Window.orderBy(F.desc(F.col("extra") - F.col("whole")), F.asc_nulls_first("source")))
    # more than one for each is left only if no source has a claim
    w = 1 + F.col("whole") + F.floor(left / F.col("m")) + F.when(order <= left % F.col("m"), 1).otherwise(0)
    return share.withColumn("w", w.cast("long")).select("source", "n", "w")


def _whole_numbers(targets: dict) -> dict[str, int] | None:
    """Whole numbers in exact proportion to the targets above zero, or None if their sum is over MOST_SLOTS."""
    shares = {}
    for k, v in targets.items():
        if not (math.isfinite(v) and v >= 0):
            raise ValueError(f"target of {k!r} must be a finite number of 0 or more")
        if v > 0:
            # the whole of it, so that a target of any size keeps its first digits
            scale = Fraction(10) ** max(0, -math.floor(math.log10(v)) - 1)
            shares[k] = Fraction(v * scale).limit_denominator(MOST_SLOTS) / scale if scale < 10**300 else Fraction(v)
    common = math.lcm(*[f.denominator for f in shares.values()])
    numbers = {k: int(f * common) for k, f in shares.items()}
    least = math.gcd(*numbers.values()) or 1
    numbers = {k: n // least for k, n in numbers.items()}
    return numbers if sum(numbers.values()) <= MOST_SLOTS else None


def target_weights(counts: DataFrame, targets: dict, period: int = PERIOD) -> DataFrame:
    """``source, n, w`` in exact proportion to ``targets`` (source to share, of any sum).
    Weights are rounded (``integer_weights``) where a source of the table has no target above
    zero, for then it gets one slot of ``period``, and where they take more than MOST_SLOTS,
    to parts of MOST_SLOTS. Negative or non-finite targets are a ValueError; targets of
    sources that the table doesn't have are ignored."""
    numbers = _whole_numbers(targets)
    schema = T.StructType([T.StructField("_of", T.StringType()), T.StructField("w", T.LongType())])
    given = counts.sparkSession.createDataFrame([(k, (numbers or {}).get(k, 1)) for k, v in targets.items() if v > 0], schema)
    met = counts.join(given, F.col("source").cast("string").eqNullSafe(F.col("_of")), "left").select("source", "n", "w")
    if not met.where("w is null").isEmpty():
        return integer_weights(counts, period=period, targets=targets)
    return met if numbers else integer_weights(counts, period=MOST_SLOTS, targets=targets)


def _classes(weights: DataFrame) -> DataFrame:
    """``given``: one row with the class (place among the distinct weights) of each slot of a period."""
    kinds = weights.groupBy("w").agg(F.count("*").alias("c"))
    all_ = kinds.agg(F.array_sort(F.collect_list(F.struct("w", "c"))).alias("s"), F.sum(F.col("w") * F.col("c")).alias("period"))
    q = F.col("period")

    def step(state: Column, t: Column) -> Column:
        def next_(x, i):
            turn = F.floor(F.element_at(state["had"], (i + 1).cast("int")) / x["c"])  # blocks that each source of the class has had
            # (deadline, place of the class) of the next block, if released
            return F.when(F.floor(turn * q / x["w"]) <= t, F.struct(F.ceil((turn + 1) * q / x["w"]).alias("deadline"), i.cast("int").alias("i")))

        best = F.array_min(F.filter(F.transform("s", next_), lambda c: c.isNotNull()))["i"]
        return F.struct(F.transform(state["had"], lambda h, i: h + F.when(i == best, 1).otherwise(0)).alias("had"), F.concat(state["given"], F.array(best)).alias("given"))

    # stretches keep the list that grows short; a finished stretch is added to the others whole
    def stretch(state: Column, a: Column) -> Column:
        none = F.array().cast("array<int>")
        inner = F.aggregate(F.sequence(a, F.least(a + _STRETCH, q) - 1), F.struct(state["had"].alias("had"), none.alias("given")), step)
        return F.struct(inner["had"].alias("had"), F.concat(state["given"], F.array(inner["given"])).alias("given"))

    start = F.struct(F.transform("s", lambda x: F.lit(0).cast("long")).alias("had"), F.array().cast("array<array<int>>").alias("given"))
    firsts = F.sequence(F.lit(0).cast("long"), q - 1, F.lit(_STRETCH).cast("long"))
    return all_.select("period", "s", F.flatten(F.aggregate(firsts, start, stretch, lambda x: x["given"])).alias("given"))


def schedule(weights: DataFrame) -> DataFrame:
    """``source, n, w, period, slots``: the slots (from 0) that a source has in one period."""
    given = cut(_classes(weights))
    kind = F.element_at("s", F.col("i") + 1)
    slots = given.select("period", "s", F.posexplode("given").alias("slot", "i")).select("period", F.col("slot").cast("long").alias("slot"), kind["w"].alias("of"), kind["c"].alias("c"))
    turn = F.row_number().over(Window.partitionBy("of").orderBy("slot")) - 1
    own = slots.withColumn("seat", turn % F.col("c")).groupBy("period", "of", "seat").agg(F.array_sort(F.collect_list("slot")).alias("slots"))
    place = F.row_number().over(Window.partitionBy("w").orderBy(F.asc_nulls_first("source"))) - 1
    placed = weights.withColumn("place", place)
    return placed.join(own, (F.col("w") == F.col("of")) & (F.col("place") == F.col("seat"))).select("source", "n", "w", "period", "slots")


def _lengths(plan: DataFrame, block_rows: int) -> DataFrame:
    """``plan`` with ``rows``: how many rows of its sequence a source has in the mixture,
    which ends with the slot in which the last source is through for the first time."""
    last_turn = F.floor((F.col("n") - 1) / block_rows)
    last = F.floor(last_turn / F.col("w")) * F.col("period") + F.element_at("slots", (last_turn % F.col("w") + 1).cast("int"))
    plan = plan.withColumn("last", last).withColumn("end", F.max("last").over(Window.partitionBy()) + 1)
    over = F.col("end") % F.col("period")
    turns = F.floor(F.col("end") / F.col("period")) * F.col("w") + F.size(F.filter("slots", lambda x: x < over))
    return plan.withColumn("rows", F.when(F.col("last") + 1 == F.col("end"), F.col("n")).otherwise(turns * block_rows))


def mix(documents: DataFrame, power: float = POWER, period: int = PERIOD, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", whole: bool = True, targets: dict | None = None) -> DataFrame:
    """The rows of ``documents`` with their place in the mixture: ``mix_block`` (from 1, of
    the source), ``mix_release``, ``mix_deadline``, ``mix_slot`` (from 0) and ``mix_epoch``.

    ``targets`` gives the weights by source (``target_weights``); without it they are n**power. With ``whole``
    the mixture is so long that every source is used up once; sources that run out earlier
    start again (epochs from 0) within the same block, so no row is lost, and the rows of
    a source stay within a block of its weight at every slot; only the last block of all can be
    short. Without it each row has its first place only. Rows of a source are ordered by a
    hash of the id, then by the id; equal ids in any order. A null source is a source of
    its own; an empty table gives an empty mixture. Input columns keep their values
    whatever their names, except that one named as a column of the place is replaced.
    """
    source = F.col("source").cast("string")
    rows = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), source.isNotNull().alias("named"), F.coalesce(source, F.lit("")).alias("of"),
        F.xxhash64(F.col(id_col), F.lit(4)).alias("key"), F.col(id_col).alias("id"),
    )
    counts = cut(rows.groupBy("named", "of").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    counts = counts.select(F.when(F.col("named"), F.col("of")).alias("source"), "n")
    weights = integer_weights(counts, power, period) if targets is None else target_weights(counts, targets, period)
    plan = _lengths(schedule(weights), block_rows)
    first = F.sum("w").over(Window.orderBy(F.asc_nulls_first("source")).rowsBetween(Window.unboundedPreceding, -1))
    plan = cut(plan.select(F.col("source").isNotNull().alias("named"), F.coalesce("source", F.lit("")).alias("of"), "n", "rows", "w", "period", F.coalesce(first, F.lit(0)).alias("first"), "slots"))
    # a row for each slot of a period: the slots of a source have numbers from ``first``
    slots = plan.select("first", F.posexplode("slots").alias("turn", "slot")).select((F.col("first") + F.col("turn")).alias("number"), F.col("slot").alias("of_period"))
    if (plan.agg(F.max("period")).first()[0] or 0) <= MOST_SLOTS:
        slots = F.broadcast(slots)
    # the order of a source is cut into parts by hash, so that no source is sorted in one place;
    # a part starts after those before it, so neither parts nor the rows of one are more than the root
    parts = max(1, math.isqrt(total))
    rows = rows.withColumn("part", F.floor((F.col("key") / 2.0**64 + 0.5) * parts))
    sizes = rows.groupBy("named", "of", "part").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("named", "of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("before", F.coalesce(before, F.lit(0))).drop("size").join(plan.drop("slots"), ["named", "of"])
    rank = F.row_number().over(Window.partitionBy("named", "of", "part").orderBy("key", "id"))
    placed = rows.withColumn("rank", rank).drop("key", "id").join(sizes, ["named", "of", "part"])
    at = F.col("before") + F.col("rank") - 1
    epochs = F.greatest(F.floor((F.col("rows") - 1 - at) / F.col("n")), F.lit(0)) if whole else F.lit(0).cast("long")
    placed = placed.withColumn("at", at).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), epochs)))
    placed = placed.withColumn("turn", F.floor((F.col("epoch") * F.col("n") + F.col("at")) / block_rows))
    turn = F.col("turn")
    placed = placed.withColumn("number", F.col("first") + turn % F.col("w")).join(slots, "number")
    slot = F.floor(turn / F.col("w")) * F.col("period") + F.col("of_period")
    place = (turn + 1, F.floor(turn * F.col("period") / F.col("w")), F.ceil((turn + 1) * F.col("period") / F.col("w")), slot, F.col("epoch"))
    return placed.select(*[F.col("row")[c].alias(c) for c in documents.columns if c not in PLACES], *[p.alias(c) for p, c in zip(place, PLACES)])
