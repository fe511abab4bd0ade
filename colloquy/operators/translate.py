"""Translation of turns: short answers, then a memory of pieces, then a translator for the misses."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.text import STRAY_MARKS, STRAY_PHRASES, TIDY, glossary, is_contaminated, scrub_zh, strip, translation_pieces


def _clean(zh, piece):
    """Scrubbed; what is still contaminated loses the marks; what is empty is a short answer or stays English."""
    once = scrub_zh(scrub_zh(zh))
    bare = scrub_zh(scrub_zh(F.replace(F.replace(once, F.lit(STRAY_MARKS[0]), F.lit("")), F.lit(STRAY_MARKS[1]), F.lit(""))))
    text = F.when(is_contaminated(once), bare).otherwise(once)
    return F.when(text != "", text).otherwise(F.coalesce(glossary(piece), piece))


def _doubtful(zh: str) -> bool:
    """Whether a translation is empty or contaminated after scrubbing, so that it is asked for again."""
    out = zh.strip()
    for pattern, to in (*((p, "") for p in STRAY_PHRASES), *TIDY):
        out = re.sub(pattern, to.replace("$1", r"\1"), out)
    return not out.strip() or any(m in out for m in STRAY_MARKS)


def translate_turns(turns: DataFrame, memory: DataFrame | None = None, translate: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """``turns`` with ``text_zh`` and ``untranslated``, the number of pieces that the
    translator failed on; these stay English. ``memory`` has (piece, zh); ``translate`` maps
    a list of pieces, and only distinct pieces that the memory lacks reach it. A list that it
    fails on is tried piece by piece. A translation that is empty or contaminated is asked
    for once more. Without memory and translator the old text_zh is kept."""
    if memory is None and translate is None:
        return turns.withColumn("text_zh", F.coalesce(glossary(F.col("text")), F.col("text_zh"), F.lit(""))).withColumn("untranslated", F.lit(0))
    t = turns.withColumn("_whole", glossary(F.col("text")))
    pieces = t.where("_whole is null").select("rec_id", "turn_ix", F.posexplode(translation_pieces(F.col("text"))).alias("ix", "piece"))
    known = pieces.select("piece").distinct().withColumn("zh", glossary(F.col("piece"))).withColumn("failed", F.lit(False))
    if memory is not None:
        known = known.join(memory.groupBy("piece").agg(F.min("zh").alias("_m")), "piece", "left").select("piece", F.coalesce("zh", "_m").alias("zh"), "failed")
    if translate is not None:

        def ask(some: list[str]) -> list[str | None]:
            try:
                return list(translate(some))
            except Exception:  # which piece it was is found out one by one; those that fail are counted
                return [None] if len(some) == 1 else [z for p in some for z in ask([p])]

        def run(frames):
            for pdf in frames:
                some = list(pdf["piece"])
                out = [None if z is None else z.strip() or p for p, z in zip(some, ask(some))] if some else []
                again = [i for i, z in enumerate(out) if z is not None and _doubtful(z)]
                for i, z in zip(again, ask([some[i] for i in again]) if again else []):
                    out[i] = out[i] if z is None else z.strip()
                yield pdf.assign(zh=[p if z is None else z for p, z in zip(some, out)], failed=[z is None for z in out])[["piece", "zh", "failed"]]

        missing = known.where("zh is null").select("piece").mapInPandas(run, "piece string, zh string, failed boolean")
        known = known.where("zh is not null").unionByName(missing)
    # a piece is cleaned once, however often it occurs
    known = known.withColumn("zh", F.when(F.col("failed"), F.col("piece")).otherwise(_clean(F.coalesce("zh", "piece"), F.col("piece"))))
    done = pieces.join(known, "piece", "left")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ix", "zh"))), lambda p: p["zh"])
    whole = done.groupBy("rec_id", "turn_ix").agg(scrub_zh(F.array_join(listed, "")).alias("_made"), F.count_if("failed").cast("int").alias("_failed"))
    out = t.drop("text_zh").join(whole, ["rec_id", "turn_ix"], "left").withColumn("text_zh", strip(F.coalesce("_whole", "_made", F.lit(""))))
    return out.withColumn("untranslated", F.coalesce("_failed", F.lit(0))).drop("_whole", "_made", "_failed")
