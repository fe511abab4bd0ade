"""Exports: subtitles, plain text, Markdown, documents and the notes table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.text import format_ts, note_lemmas, punctuate, srt_ts, strip

BOM = "﻿"


def _ready(turns: DataFrame) -> DataFrame:
    t = turns.withColumn("text", punctuate(F.col("text"))).withColumn("text_zh", strip(F.coalesce("text_zh", F.lit(""))))
    return t.withColumn("header", F.concat(F.lit("["), format_ts(F.col("start")), F.lit(" → "), format_ts(F.col("end")), F.lit("] "), "speaker"))


def _documents(cues: DataFrame, head=None) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn_ix", "cue"))), lambda c: c["cue"])
    out = cues.groupBy("rec_id").agg(F.array_join(listed, "\n").alias("body"))
    return out.select("rec_id", F.concat(F.regexp_replace("body", r"(?U)\s+$", ""), F.lit("\n")).alias("content"))


def srt_cues(turns: DataFrame) -> DataFrame:
    t = _ready(turns).withColumn("cue_ix", F.row_number().over(Window.partitionBy("rec_id").orderBy("turn_ix")))
    zh = F.when(F.col("text_zh") != "", F.concat(F.lit("\n"), "text_zh")).otherwise("")
    cue = F.concat(F.col("cue_ix").cast("string"), F.lit("\n"), srt_ts(F.col("start")), F.lit(" --> "), srt_ts(F.col("end")), F.lit("\n"), "speaker", F.lit(": "), "text", zh, F.lit("\n"))
    return t.select("rec_id", "turn_ix", cue.alias("cue"))


def render_srt(turns: DataFrame) -> DataFrame:
    return _documents(srt_cues(turns))


def txt_cues(turns: DataFrame) -> DataFrame:
    zh = F.when(F.col("text_zh") != "", F.concat("text_zh", F.lit("\n"))).otherwise("")
    return _ready(turns).select("rec_id", "turn_ix", F.concat("header", F.lit("\n"), "text", F.lit("\n"), zh).alias("cue"))


def render_txt(turns: DataFrame) -> DataFrame:
    return _documents(txt_cues(turns))


def render_markdown(turns: DataFrame, docs: DataFrame) -> DataFrame:
    zh = F.when(F.col("text_zh") != "", F.concat("text_zh", F.lit("\n\n"))).otherwise("")
    body = _ready(turns).select("rec_id", "turn_ix", F.concat(F.lit("### "), "header", F.lit("\n\n"), "text", F.lit("\n\n"), zh).alias("cue"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("turn_ix", "cue"))), lambda c: c["cue"])
    stats = turns.groupBy("rec_id").agg(F.countDistinct("speaker").alias("n_speakers"), F.count("*").alias("n_turns"))
    out = body.groupBy("rec_id").agg(F.array_join(listed, "").alias("body")).join(stats, "rec_id").join(docs.select("rec_id", "language"), "rec_id", "left")
    head = F.concat(F.lit("# Transcript: "), F.col("rec_id").cast("string"), F.lit("\n\n- Language: "), F.coalesce("language", F.lit("en")), F.lit("\n- Speakers: "), F.col("n_speakers").cast("string"), F.lit("\n- Segments: "), F.col("n_turns").cast("string"), F.lit("\n- Bilingual: English + 中文翻譯\n\n---\n\n"))
    return out.select("rec_id", F.concat(F.regexp_replace(F.concat(head, "body"), r"(?U)\s+$", ""), F.lit("\n")).alias("content"))


WORDS = "array<struct<word:string,start:double,end:double,probability:double,speaker:string>>"


def transcript_words(turns: DataFrame):
    """The words of a turn in their exported form: an empty list if there are none, fields that are missing null."""
    if "words" not in turns.columns:
        return F.array().cast(WORDS)
    have = {f.name for f in turns.schema["words"].dataType.elementType.fields}
    kinds = (("word", "string"), ("start", "double"), ("end", "double"), ("probability", "double"), ("speaker", "string"))
    word = lambda w: F.struct(*[(w[f] if f in have else F.lit(None)).cast(t).alias(f) for f, t in kinds])
    return F.coalesce(F.transform("words", word), F.array().cast(WORDS))


def to_transcript_docs(turns: DataFrame, docs: DataFrame) -> DataFrame:
    """One document per recording with its turns, and their words, in order."""
    listed = F.array_sort(F.collect_list(F.struct("turn_ix", "speaker", "start", "end", "text", "text_zh", transcript_words(turns).alias("words"))))
    texts = F.array_join(F.transform(listed, lambda t: strip(t["text"])), " ")
    out = _ready(turns).groupBy("rec_id").agg(listed.alias("turns"), strip(texts).alias("text"))
    return out.join(docs.select("rec_id", "language"), "rec_id", "left").withColumn("bilingual", F.lit(True))


def notes_csv(notes: DataFrame, *more: str) -> DataFrame:
    """Columns of the exported table, and ``more`` columns of the notes; write it with :func:`write_notes_csv` or as files of recordings."""
    lemmas = note_lemmas(F.col("lemmas"), F.col("dict"), F.coalesce("word", F.lit("")))
    gloss = F.transform("_l", lambda e: strip(F.coalesce(F.nullif(F.get(e["senses"], F.lit(0))["zh"], F.lit("")), F.get(e["senses"], F.lit(0))["en"], F.lit(""))))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return notes.withColumn("_l", lemmas).select(
        F.col("rec_id").cast("string").alias("stem"), text("word").alias("word"), text("text_en").alias("text_en"), text("text_zh").alias("text_zh"), F.array_join(F.transform("_l", lambda e: e["lemma"]), "; ").alias("dict_lemma"),
        F.array_join(F.filter(gloss, lambda g: g != ""), " | ").alias("dict_gloss"), text("start").alias("start"), text("end").alias("end"), text("source").alias("source"), text("created_at").alias("created_at"), *more,
    )


def write_notes_csv(notes: DataFrame, path: str) -> None:
    """UTF-8 with a byte-order mark, which the first column's name carries."""
    notes_csv(notes).withColumnRenamed("stem", BOM + "stem").write.csv(path, header=True, escape='"', emptyValue="")
