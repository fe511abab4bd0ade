"""Views ``fx_*`` over the driver's tables, once as DataFrames and once as SQL for the oracle.
Times are multiples of 0.125, so doubles are exact and ties are reproducible."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tasks by recording for each part of the conversations.
TASKS = 16


class Fixtures:
    """The views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def folder(self, name: str) -> str:
        """A new folder for files that a query writes and reads: in the session's shared folder, or a temporary one where Spark runs in one process."""
        shared = self.spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not self.spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        return f"{(shared or tempfile.mkdtemp(prefix='spark-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def words(self) -> DataFrame:
        """Words by (turn, role, text, position); those of equal rows alternate. They are numbered by the
        counts of the rows before, so that no word is sorted. A row gives many words, so recordings
        are dealt to TASKS parts for each part that is read, more than their bytes alone would need."""
        c = self.table("conversations").groupBy(F.col("conv_id").alias("rec_id"), "turn", "role", "text").agg(F.count("*").cast("int").alias("copies"))
        c = c.withColumn("w", F.filter(F.split("text", "[ \n\t]+"), lambda w: w != "")).withColumn("n", F.size("w") * F.col("copies"))
        c = c.repartition(TASKS * self.table("conversations").rdd.getNumPartitions(), "rec_id")
        before = F.sum("n").over(Window.partitionBy("rec_id").orderBy("turn", "role", "text")) - F.col("n")
        c = c.withColumn("before", before).select("rec_id", "turn", "role", "copies", "before", F.posexplode("w").alias("pos", "word"))
        c = c.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        swapped = F.when(F.length("word") % 7 == 0, F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "user").otherwise(F.col("role"))).otherwise(F.col("role"))
        c = c.withColumn("word_ix", (F.col("before") + F.col("pos") * F.col("copies") + F.col("copy")).cast("int"))
        return c.select("rec_id", "word_ix", "word", (0.25 * F.col("word_ix") + F.col("turn")).alias("start"), (0.25 * F.col("word_ix") + F.col("turn") + 0.25).alias("end"), swapped.alias("speaker"), "turn", "role")

    def segments(self) -> DataFrame:
        g = self.words().groupBy("rec_id", "turn").agg((F.min("start") - 0.125).alias("start"), (F.max("end") - 0.375).alias("end"), F.min("role").alias("speaker"))
        return g.select("rec_id", F.col("turn").cast("int").alias("seg_ix"), "start", "end", "speaker")

    def turns(self) -> DataFrame:
        c = self.table("conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("speaker"), F.min("text").alias("text"))
        return c.select(F.col("conv_id").alias("rec_id"), F.col("turn").cast("int").alias("turn_ix"), "speaker", (8.0 * F.col("turn")).alias("start"), (8.0 * F.col("turn") + 7).alias("end"), "text", F.replace("text", F.lit(". "), F.lit("。")).alias("text_zh"))

    def edits(self) -> DataFrame:
        r = self.table("conversations").select(F.col("conv_id").alias("rec_id")).distinct()
        return r.select(F.concat(F.lit("e"), F.col("rec_id").cast("string")).alias("edit_id"), "rec_id", F.lit(4.0).alias("start"), F.when(F.col("rec_id") % 3 == 0, 2.0).otherwise(20.0).alias("end"), F.lit(1.5).alias("padding"))

    def series(self) -> DataFrame:
        e = self.table("events")
        i = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")) - 1
        return e.select(F.col("event_type").alias("series_id"), i.cast("long").alias("i"), (F.col("value") / 100).alias("value"), (F.col("event_id") % 2).alias("channel"))

    def log(self) -> DataFrame:
        e = self.table("events")
        seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
        return e.select(F.col("user_id").alias("job_id"), seq.cast("long").alias("seq"), F.least(F.lit(100), F.col("value").cast("int")).alias("pct"), F.col("event_type").alias("line"))

    def dictionary(self) -> DataFrame:
        w = self.table("benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), 1)).alias("word")).distinct()
        return w.select("word", F.concat(F.lit("/"), "word", F.lit("/")).alias("phonetic"), F.concat(F.lit("the "), "word").alias("definition"), F.when(F.length("word") % 5 == 0, "").otherwise(F.concat(F.lit("n. "), "word")).alias("translation"), F.lit("n:60/v:40").alias("pos"))

    def fallback(self) -> DataFrame:
        """Payloads of a second dictionary: two entries, blank phonetics and definitions, more senses than are kept."""
        text = lambda *c: F.concat(*[F.lit(x) if x != "word" else F.col(x) for x in c])
        means = lambda d, e=None: F.struct(d.alias("definition"), F.lit(e).cast("string").alias("example") if e is None else e.alias("example"))
        meaning = lambda pos, *ds: F.struct(F.lit(pos).alias("partOfSpeech"), F.array(*ds).alias("definitions"))
        first = F.struct(
            F.when(F.length("word") % 2 == 0, " ").otherwise(text("[", "word", "]")).alias("phonetic"), F.array(F.struct(F.lit("").alias("text")), F.struct(text("/", "word").alias("text"))).alias("phonetics"),
            F.array(meaning("noun", means(text("a ", "word"), text("as in ", "word")), means(F.lit(" "))), meaning("verb", means(text("to ", "word")), means(text("to ", "word", " it")))).alias("meanings"),
        )
        second = F.struct(F.lit("later").alias("phonetic"), F.array(F.struct(F.lit("x").alias("text"))).alias("phonetics"), F.array(meaning("noun", *[means(text(n, "word")) for n in ("one ", "two ", "three ", "four ")])).alias("meanings"))
        return self.dictionary().where(F.length("word") % 3 != 0).select(F.col("word").alias("lemma"), F.array(first, second).alias("payload"))

    def windows(self) -> DataFrame:
        return self.table("embeddings").select((F.col("vec_id") % 5).alias("rec_id"), F.col("vec_id").cast("int").alias("win_ix"), (0.75 * F.col("vec_id")).alias("center"), "embedding", "label")


VIEWS = r"""
fx_words AS (
  SELECT rec_id, word_ix, word, 0.25::DOUBLE * word_ix + turn AS "start", 0.25::DOUBLE * word_ix + turn + 0.25::DOUBLE AS "end", turn, role,
         CASE WHEN length(word) % 7 = 0 THEN CASE role WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'user' ELSE role END ELSE role END AS speaker
  FROM (SELECT rec_id, turn, role, word, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY turn, role, text, pos) - 1 AS INTEGER) AS word_ix
        FROM (SELECT conv_id AS rec_id, turn, role, text, unnest(string_split_regex(text, '[ \n\t]+')) AS word, generate_subscripts(string_split_regex(text, '[ \n\t]+'), 1) AS pos FROM conversations) WHERE word <> '')),
fx_segments AS (SELECT rec_id, CAST(turn AS INTEGER) AS seg_ix, min("start") - 0.125::DOUBLE AS "start", max("end") - 0.375::DOUBLE AS "end", min(role) AS speaker FROM fx_words GROUP BY rec_id, turn),
fx_turns AS (SELECT rec_id, turn_ix, speaker, 8.0::DOUBLE * turn_ix AS "start", 8.0::DOUBLE * turn_ix + 7 AS "end", text, replace(text, '. ', '。') AS text_zh
             FROM (SELECT conv_id AS rec_id, CAST(turn AS INTEGER) AS turn_ix, min(role) AS speaker, min(text) AS text FROM conversations GROUP BY conv_id, turn)),
fx_edits AS (SELECT 'e' || rec_id AS edit_id, rec_id, 4.0::DOUBLE AS "start", CASE WHEN rec_id % 3 = 0 THEN 2.0::DOUBLE ELSE 20.0::DOUBLE END AS "end", 1.5::DOUBLE AS padding FROM (SELECT DISTINCT conv_id AS rec_id FROM conversations)),
fx_series AS (SELECT event_type AS series_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS BIGINT) AS i, value / 100 AS value, event_id % 2 AS channel FROM events),
fx_log AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, least(100, CAST(trunc(value) AS INTEGER)) AS pct, event_type AS line FROM events),
fx_dict AS (SELECT word, '/' || word || '/' AS phonetic, 'the ' || word AS definition, CASE WHEN length(word) % 5 = 0 THEN '' ELSE 'n. ' || word END AS translation, 'n:60/v:40' AS pos
            FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM benchmark)),
fx_windows AS (SELECT vec_id % 5 AS rec_id, CAST(vec_id AS INTEGER) AS win_ix, 0.75::DOUBLE * vec_id AS center, embedding, label FROM embeddings)
"""
