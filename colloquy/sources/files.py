"""Readers of transcript, recogniser, diarizer, note and dictionary files, recordings, and stage checkpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions.text import LEMMA_ENTRY, SENSES, SUFFIXES, media_stem, strip
from colloquy.sources.names import last_part, metadata_name

WORD = "struct<word:string,start:double,end:double,probability:double,speaker:string>"
TURN = f"struct<speaker:string,start:double,end:double,text:string,text_zh:string,words:array<{WORD}>>"
TRANSCRIPT = f"language string, bilingual boolean, text string, turns array<{TURN}>, _corrupt_record string"
ASR = f"language string, text string, segments array<struct<start:double,end:double,text:string,words:array<{WORD}>>>, _corrupt_record string"
SEGMENTS = "mode string, segments array<struct<start:double,end:double,speaker:string>>, _corrupt_record string"
NOTE = f"struct<id:string,word:string,text_en:string,text_zh:string,start:double,end:double,source:string,created_at:double,updated_at:double,lemmas:array<{LEMMA_ENTRY}>,dict:{LEMMA_ENTRY}>"
NOTES = f"stem string, notes array<{NOTE}>, updated_at double, _corrupt_record string"
DICTIONARY = "word string, phonetic string, definition string, translation string, pos string"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON; broken files and those that are no objects are left out."""
    texts = spark.read.text(path, wholetext=True).select(metadata_name().alias("file_name"), strip(F.regexp_replace("value", "^\ufeff", "")).alias("_text"))
    parsed = texts.where(F.startswith("_text", F.lit("{"))).withColumn("_d", F.from_json("_text", schema, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    return parsed.where("_d._corrupt_record is null").select("_d.*", "file_name").drop("_corrupt_record")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Documents with turns; recogniser results and checkpoints beside them are skipped."""
    df = _json(spark, path, TRANSCRIPT)
    df = df.where(~F.col("file_name").rlike(r"\.(whisper|turns)\.json$")).where(F.coalesce(F.size("turns"), F.lit(0)) > 0)
    return df.withColumn("rec_id", media_stem("file_name"))


def explode_turns(docs: DataFrame) -> DataFrame:
    return docs.select("rec_id", F.posexplode("turns").alias("turn_ix", "t")).select("rec_id", "turn_ix", "t.*")


def read_asr(spark: SparkSession, path: str) -> DataFrame:
    """Recogniser results; without segments the text, if any, is one segment at 0."""
    return asr_segments(_json(spark, path, ASR)).withColumn("rec_id", F.regexp_replace("file_name", r"(\.whisper)?\.json$", ""))


def asr_segments(df: DataFrame) -> DataFrame:
    """Recogniser documents whose text is one segment at 0 where they have no segments; language in lower case, ``en`` if blank."""
    segments = dict(df.dtypes)["segments"]
    one = F.array(F.struct(F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), F.col("text"), F.array().cast(f"array<{WORD}>").alias("words"))).cast(segments)
    none = F.coalesce(F.size("segments"), F.lit(0)) <= 0
    df = df.withColumn("segments", F.when(none & (strip(F.coalesce("text", F.lit(""))) != ""), one).otherwise(F.coalesce("segments", F.array().cast(segments))))
    lang = F.lower(strip(F.coalesce("language", F.lit(""))))
    return df.withColumn("language", F.when(lang == "", "en").otherwise(lang))


def read_speaker_segments(spark: SparkSession, path: str) -> DataFrame:
    """Diarizer output: the object on the last line of each file, exploded in list order."""
    lines = spark.read.text(path, wholetext=True).withColumn("rec_id", media_stem(metadata_name()))
    last = F.element_at(F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n"), -1)
    found = lines.select("rec_id", F.from_json(last, SEGMENTS.replace(", _corrupt_record string", "")).alias("d"))
    return found.select("rec_id", F.posexplode("d.segments").alias("seg_ix", "s")).select("rec_id", "seg_ix", "s.*")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    df = _json(spark, path, NOTES)
    return df.select(F.coalesce("stem", media_stem("file_name")).alias("rec_id"), F.explode("notes").alias("n")).select("rec_id", "n.*")


def read_dictionary(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Dictionary rows with the lookup key, the word in lower case."""
    reader = spark.read.schema(DICTIONARY)
    df = reader.option("header", True).option("escape", '"').option("multiLine", True).csv(path) if format == "csv" else reader.format(format).load(path)
    return df.withColumn("key", F.lower("word"))


def scan_recordings(spark: SparkSession, path: str, workdir: str | None = None) -> DataFrame:
    """Recording files with their ``priority``: WAVs directly in ``workdir`` (0), then files directly
    in ``path`` by kind (WAV 1, M4A 2, MP3 3), then all others (9); within it by lower-cased name.
    A ``recording.wav`` directly in ``path`` is left out. Contents are not read."""
    files = lambda p: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p).select("path", "length")
    df = files(path)
    if workdir is not None and not f"{workdir.rstrip('/')}/".startswith(f"{path.rstrip('/')}/"):
        df = df.unionAll(files(workdir))
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/*", "/")
    folder = plain(F.regexp_replace("path", "/[^/]*$", ""))
    inside = lambda p: folder == plain(F.lit(p.rstrip("/")))
    df = df.withColumn("name", last_part(F.col("path"))).withColumn("suffix", F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)))
    df = df.where(F.col("suffix").isin(*SUFFIXES)).where(~(inside(path) & (F.col("name") == "recording.wav")))
    worked = inside(workdir) & (F.col("suffix") == ".wav") if workdir is not None else F.lit(False)
    kinds = F.when(F.col("suffix") == ".wav", 1).when(F.col("suffix") == ".m4a", 2).when(F.col("suffix") == ".mp3", 3).otherwise(9)
    priority = F.when(worked, 0).when(inside(path), kinds).otherwise(9)
    return df.withColumn("rec_id", media_stem("name")).withColumn("priority", priority).orderBy("priority", F.lower("name"), "path")


def wav_header_audit(files: DataFrame) -> DataFrame:
    """``reason`` why a WAV is not 16 kHz mono 16-bit, from the fixed places of its header (null: it is)."""
    little = lambda at, n: F.conv(F.concat(*[F.hex(F.substring("content", at + n - 1 - i, 1)) for i in range(n)]), 16, 10).cast("long")
    out = files.withColumns({"channels": little(23, 2), "sample_rate": little(25, 4), "bits": little(35, 2)})
    reason = F.when(F.octet_length("content") < 44, "too short").when(F.col("channels") != 1, "not mono").when(F.col("sample_rate") != 16000, "not 16 kHz").when(F.col("bits") != 16, "not 16-bit")
    return out.withColumn("reason", reason).drop("content")


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether the job that wrote a folder came to its end: Spark leaves ``_SUCCESS`` then."""
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file)


def checkpoint_stage(spark: SparkSession, path: str, compute: Callable[[DataFrame | None], DataFrame], inputs: DataFrame | None = None, key: str = "rec_id") -> DataFrame:
    """A stage's rows, computed once: a finished table is read, and only inputs whose key it
    lacks are computed and appended. A folder without ``_SUCCESS`` is written anew; an error
    in reading a finished one is raised and nothing is overwritten."""
    if not _finished(spark, path):
        compute(inputs).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
    done = spark.read.parquet(path)
    if inputs is not None:
        missing = inputs.join(done.select(key).distinct(), key, "left_anti")
        if not missing.isEmpty():
            compute(missing).write.mode("append").parquet(path)
    return spark.read.parquet(path)
