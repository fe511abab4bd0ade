"""Sinks, versioned tables and streams: commits, conflicts, restarts."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from colloquy.sources import files, outputs
from colloquy.sources.store import Conflict, VersionedTable
from colloquy.streaming import jobs


def tree(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(path) for f in names if not f.startswith(".")}


TURN = "rec_id string, turn_ix int, speaker string, start double, end double, text string, text_zh string, words array<struct<word:string,start:double,end:double,probability:double,speaker:string>>"


def some_turns(spark):
    w = [{"word": "hi", "start": 0.0, "end": 0.5, "probability": 0.9, "speaker": "A"}]
    return spark.createDataFrame([("a b", 0, "A", 0.0, 1.5, "hi", " 嗨 ", w), ("a b", 1, "B", 1.5, 3.0, "you there?", None, None), ("c%d", 0, "A", 0.0, 2.0, "one", "", [])], TURN)


def test_four_files_of_each_recording(spark, tmp_path):
    turns, docs = some_turns(spark), spark.createDataFrame([("a b", "en"), ("c%d", None)], "rec_id string, language string")
    outputs.write_outputs(turns, docs, str(tmp_path / "out"))
    got = tree(tmp_path / "out")
    assert sorted(got) == sorted(f"{s}.{x}" for s in ("a b", "c%d") for x in ("json", "md", "srt", "txt"))
    assert got["a b.srt"].decode() == "1\n00:00,000 --> 00:01,500\nA: hi.\n嗨\n\n2\n00:01,500 --> 00:03,000\nB: you there?\n"
    assert got["a b.txt"].decode() == "[00:00.000 → 00:01.500] A\nhi.\n嗨\n\n[00:01.500 → 00:03.000] B\nyou there?\n"
    assert got["c%d.md"].decode().startswith("# Transcript: c%d\n\n- Language: en\n- Speakers: 1\n- Segments: 1\n")
    text = got["a b.json"].decode()
    doc = json.loads(text)
    assert text == json.dumps(doc, ensure_ascii=False, indent=2) + "\n" and list(doc) == ["language", "bilingual", "text", "turns"]
    assert doc["turns"][0] == {"speaker": "A", "start": 0.0, "end": 1.5, "text": "hi.", "text_zh": "嗨", "words": [{"word": "hi", "start": 0.0, "end": 0.5, "probability": 0.9, "speaker": "A"}]}
    assert doc["turns"][1]["words"] == [] and json.loads(got["c%d.json"])["language"] is None
    # they are read again as they were, and written again over themselves
    back = files.explode_turns(files.read_transcripts(spark, str(tmp_path / "out/*.json")))
    assert sorted((r.rec_id, r.turn_ix, r.text, len(r.words)) for r in back.collect()) == [("a b", 0, "hi.", 1), ("a b", 1, "you there?", 0), ("c%d", 0, "one.", 0)]
    outputs.write_outputs(turns, docs, str(tmp_path / "out"))
    assert tree(tmp_path / "out") == got


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    rows = spark.range(40, numPartitions=8).select(F.concat(F.lit("f"), "id").alias("name"), F.col("id").cast("string").alias("content"))
    outputs.write_files(rows.limit(2), str(tmp_path))
    before = tree(tmp_path)
    broken = rows.withColumn("name", F.when(F.col("name") == "f33", "../f33").otherwise(F.col("name")))
    with pytest.raises(Exception, match="not a file name"):
        outputs.write_files(broken, str(tmp_path))
    with pytest.raises(Exception, match="two rows for one file"):
        outputs.write_files(rows.unionAll(rows.limit(1)), str(tmp_path))
    assert tree(tmp_path) == before and len(os.listdir(tmp_path)) == 2


def test_a_repeated_task_writes_once(tmp_path):
    """Two attempts of a task stage apart; only the files of the attempt that is committed are moved."""
    writer = outputs._Writer(str(tmp_path))
    first, second = writer.write(iter([{"name": "x", "content": "1"}])), writer.write(iter([{"name": "x", "content": "1"}]))
    assert first.files != second.files
    writer.commit([second, None])
    assert tree(tmp_path) == {"x": b"1"} and os.listdir(tmp_path) == ["x"]
    other = outputs._Writer(str(tmp_path))
    other.write(iter([{"name": "y", "content": b"\xff"}]))
    other.abort([None])
    assert os.listdir(tmp_path) == ["x"]


def test_notes_tables(spark, tmp_path):
    from tests.test_golden import NOTE

    rows = [("s", "2", 'say "hi"', "a, b", "", 2.5, None, "manual", 7.0, None, None, None), ("s", "1", "go", "x", "z", 1.0, 2.0, None, None, None, None, None), ("t", "3", "", "line\nbreak", "", None, None, "", 1.0, None, None, None)]
    outputs.write_notes_files(spark.createDataFrame(rows, NOTE), str(tmp_path))
    got = tree(tmp_path)
    assert got["s.notes.csv"].decode("utf-8-sig") == 'stem,word,text_en,text_zh,dict_lemma,dict_gloss,start,end,source,created_at\r\ns,go,x,z,go,,1.0,2.0,,\r\ns,"say ""hi""","a, b",,"say ""hi""",,2.5,,manual,7.0\r\n'
    assert got["t.notes.csv"].startswith(b"\xef\xbb\xbfstem,") and b't,,"line\nbreak",' in got["t.notes.csv"]


# ----------------------------------------------------------------- versioned tables


def recs(spark, *pairs):
    return spark.createDataFrame(pairs, "rec_id string, v int")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_versions_and_undo(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "rec_id", 8)
    assert t.version() == 0
    assert t.replace(recs(spark, *[(f"r{i}", i) for i in range(40)])) == 1
    kept = {b: p for b, p in t.entry()["parts"].items()}
    keys = recs(spark, ("r3", 0))
    assert t.update(keys, lambda old: old.withColumn("v", F.when(F.col("rec_id") == "r3", -1).otherwise(F.col("v")))) == 2
    now = t.entry()["parts"]
    assert len(now) == len(kept) and sum(now[b] != kept[b] for b in kept) == 1  # files of other buckets stay
    assert dict(rows(t.read()))["r3"] == -1 and dict(rows(t.read(1)))["r3"] == 3 and t.read().count() == 40
    assert t.undo() == 3 and rows(t.read()) == rows(t.read(1)) and t.entry()["parts"] == kept
    with pytest.raises(ValueError, match="nothing to restore"):
        t.restore(9)
    assert t.update(recs(spark), lambda old: old) == 3  # nothing touched, nothing written


def test_of_two_writers_one_is_refused(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "rec_id", 4)
    seen = t.replace(recs(spark, ("a", 1)))
    t.upsert(recs(spark, ("a", 2)), expected=seen)
    with pytest.raises(Conflict):
        t.upsert(recs(spark, ("a", 3)), expected=seen)
    # the same between the check and the entry
    entry = t.entry()
    t.upsert(recs(spark, ("b", 4)))
    with pytest.raises(Conflict):
        t.log.append(entry["version"] + 1, entry)
    assert rows(t.read()) == [("a", 2), ("b", 4)] and t.log.versions() == [1, 2, 3]
    assert [f for f in os.listdir(tmp_path / "t/_log") if not f.endswith(".json") and not f.endswith(".crc")] == []


def test_upsert_adds_files_or_rewrites_buckets(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "rec_id", 1)
    t.upsert(recs(spark, ("a", 1), ("a", 2), ("b", 1)), ("in", 0))
    first = t.entry()["parts"]["0"]
    assert t.upsert(recs(spark, ("c", 1)), ("in", 1)) == 2 and t.entry()["parts"]["0"][:1] == first  # added beside
    assert t.upsert(recs(spark, ("c", 9)), ("in", 1)) == 2  # seen already
    t.upsert(recs(spark, ("a", 5)), ("in", 2))
    assert rows(t.read()) == [("a", 5), ("b", 1), ("c", 1)]
    for i in range(9):
        t.upsert(recs(spark, (f"n{i}", i)))
    many = rows(t.read())
    assert len(t.entry()["parts"]["0"]) > 8
    t.compact()
    assert len(t.entry()["parts"]["0"]) == 1 and rows(t.read()) == many


def test_range_edits_of_a_table(spark, tmp_path):
    """Apply, read, and go back: the snapshot before is untouched, other recordings' files stay."""
    from colloquy.operators import edits as E

    turns = some_turns(spark)
    t = VersionedTable(spark, str(tmp_path / "t"), "rec_id", 16)
    t.replace(turns)
    edit = spark.createDataFrame([("e", "a b", 1.5, 3.0, 0.0)], "edit_id string, rec_id string, start double, end double, padding double")
    clip = spark.createDataFrame([("e", "a b", 0, "new.", 0.25, 0.5, 1.5)], "edit_id string, rec_id string, word_ix int, word string, start double, end double, offset double")
    version, report = E.edit_table(t, clip, edit)
    assert version == 2 and [(r.status, r.replaced_turns, r.new_turns, r.kept_words) for r in report.collect()] == [("applied", 1, 1, 1)]
    after = {(r.rec_id, r.turn_ix): r for r in t.read().collect()}
    assert after["a b", 1].text == "new." and after["a b", 1].words[0].start == 1.75 and after["a b", 0].words[0].word == "hi" and ("c%d", 0) in after
    t.undo()
    assert sorted(r.text for r in t.read().collect()) == ["hi", "one", "you there?"]


# ------------------------------------------------------------------------- streams


def say(text):
    return json.dumps({"language": "en", "segments": [{"start": 0, "end": 1, "text": text, "words": [{"word": text, "start": 0, "end": 0.4, "probability": 0.9}]}]})


def ingest(spark, tmp_path):
    q = jobs.stream_ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), buckets=4)
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_ingest_is_exactly_once(spark, tmp_path, monkeypatch):
    """A stop before the entry of the log, and one behind it, lead to the same table; a recording that comes again is replaced."""
    src = tmp_path / "in"
    src.mkdir()
    (src / "r 1%.whisper.json").write_text(say("hi"))
    (src / "r+2.whisper.json").write_text(json.dumps({"language": "en", "text": "Only a text. With four. Short ones. Here."}))
    commit, upsert = VersionedTable._commit, VersionedTable.upsert

    def stop(self, *args):
        raise RuntimeError("stopped before")

    monkeypatch.setattr(VersionedTable, "_commit", stop)
    with pytest.raises(Exception, match="stopped before"):
        ingest(spark, tmp_path)
    monkeypatch.setattr(VersionedTable, "_commit", commit)
    assert VersionedTable(spark, str(tmp_path / "out")).version() == 0

    def late(self, *args, **kw):
        upsert(self, *args, **kw)
        raise RuntimeError("stopped behind")

    monkeypatch.setattr(VersionedTable, "upsert", late)
    with pytest.raises(Exception, match="stopped behind"):
        ingest(spark, tmp_path)
    monkeypatch.setattr(VersionedTable, "upsert", upsert)
    ingest(spark, tmp_path)
    texts = lambda: sorted((r.rec_id, r.text) for r in jobs.ingested(spark, str(tmp_path / "out")).collect())
    assert texts() == [("r 1%", "hi."), ("r+2", "Only a text. With four. Short ones. Here.")] and VersionedTable(spark, str(tmp_path / "out")).version() == 1
    (src / "r 1%.json").write_text(say("again"))
    ingest(spark, tmp_path)
    assert texts() == [("r 1%", "again."), ("r+2", "Only a text. With four. Short ones. Here.")]


def test_throttled_jobs_leave_no_state(spark, tmp_path):
    """Ticks in several batches, shuffled within each, pass as they do in one; silent jobs are closed by a timer."""
    from colloquy.operators import edits as E

    key = "spark.sql.streaming.stateStore.providerClass"
    ticks = {1: [0, 3, 5, 7, 10, 9, 95, 100, 100], 2: [40, 41, 46], 3: [7, None]}
    rows = [(job, i, p) for job, ps in ticks.items() for i, p in enumerate(ps)]
    schema = "job_id long, seq long, pct int"
    src = tmp_path / "ticks"
    for part in (rows[:4] + rows[9:11], rows[4:9] + rows[11:]):
        spark.createDataFrame(part[::-1], schema).coalesce(1).write.mode("append").parquet(str(src))
        time.sleep(1.1)
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    with pytest.raises(RuntimeError, match="RocksDB"):
        jobs.stream_throttle(live)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = jobs.stream_throttle(live, silence_seconds=1).writeStream.format("memory").queryName("throttled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            until = time.time() + 60
            while time.time() < until and (2, 3, 100) not in {tuple(r) for r in spark.table("throttled").collect()}:
                time.sleep(0.5)
            # timers keep batches coming, so there is no point at which all is processed
            states = []
            while time.time() < until and (not states or states[-1]):
                time.sleep(0.5)
                states = [s.numRowsTotal for p in q.recentProgress for s in p.stateOperators]
        finally:
            q.stop()
    finally:
        spark.conf.unset(key)
    got = sorted(tuple(r) for r in spark.table("throttled").collect())
    log = spark.createDataFrame([(j, s, 100 if p is None else p) for j, s, p in rows], schema)
    want = sorted(tuple(r) for r in E.throttle_progress(log).where("emit").select("job_id", "seq", "pct").collect()) + [(2, 3, 100)]
    assert got == sorted(want) and max(states) > 0 and states[-1] == 0


def test_notes_and_cache_of_tables(spark, tmp_path):
    """Only buckets with changes are rewritten; results are those of the operators on whole tables."""
    from colloquy.operators import edits as E
    from tests.test_golden import CHANGE, NOTE

    notes = VersionedTable(spark, str(tmp_path / "notes"), "rec_id", 16)
    rows_ = [(f"r{i}", "n", "w", "t", "", 1.0, None, "manual", 5.0, None, None, None) for i in range(20)]
    notes.replace(spark.createDataFrame(rows_, NOTE))
    change = spark.createDataFrame([("r3", "c", "n", "x", "new", "", "", "", "", None, False, "", 9.0), ("new", "c", None, "y", "fresh", "", "", "", "", None, False, "", 9.0), ("r3", "d", "absent", "", "t", "", "", "", "", None, False, "", 9.0)], CHANGE)
    before = notes.entry()["parts"]
    version, failed = E.upsert_notes_table(notes, change)
    after = notes.entry()["parts"]
    assert version == 2 and [(r.id, r.error) for r in failed.collect()] == [("absent", "unknown note")]
    assert sum(after.get(b) != before.get(b) for b in set(before) | set(after)) <= 2
    want = E.upsert_notes(notes.read(1), change)[0]
    assert sorted(map(str, notes.read().collect())) == sorted(map(str, want.select(*notes.read().columns).collect()))
    version, missed = E.delete_notes_table(notes, spark.createDataFrame([("r3", "n"), ("r4", "zz")], "rec_id string, id string"))
    assert version == 3 and notes.read().count() == 20 and [tuple(r) for r in missed.collect()] == [("r4", "zz")]

    cache = VersionedTable(spark, str(tmp_path / "cache"), "lemma", 8)
    entries = lambda *pairs: spark.createDataFrame([(f"l{i:02}", {"v": v}, s) for i, v, s in pairs], "lemma string, entry struct<v:string>, inserted_seq long")
    old, found = entries(*[(i, "old", i) for i in range(30)]), entries((5, "new", 100), (40, "new", 101), (41, "new", 102))
    cache.replace(old)
    E.upsert_cache_table(cache, found, most=25)
    assert rows(cache.read()) == rows(E.upsert_cache(old, found, 25).select("lemma", "entry", "inserted_seq"))
    assert cache.read().count() == 25


def test_key_filter_lets_all_keys_pass(spark):
    from colloquy.operators import edits as E

    keys = spark.range(2000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    found = E.key_filter(keys, "key")
    probes = keys.unionAll(spark.range(20_000).select(F.concat(F.lit("other"), F.col("id")).alias("key")))
    left = E.may_hold(probes, "key", found)
    assert left.where("key like 'k%'").count() == 2000 and left.count() < 2200 and found.count() <= E.PIECES
