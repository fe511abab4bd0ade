"""Stated results of single operators."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import edits as E
from colloquy.operators import intervals as I
from colloquy.operators import signal as S
from colloquy.operators import translate as X
from colloquy.operators import turns as W
from colloquy.sources import files

L = F.lit


@pytest.fixture
def ev(spark):
    return lambda c: spark.range(1).select(c.alias("x")).first()[0]


def test_scalars(ev):
    assert [ev(T.media_stem(L(x))) for x in ("meeting.work.wav", "interview.m4a", "a.work.json", ".x")] == ["meeting", "interview", "a.work", ".x"]
    assert [ev(T.format_ts(L(float(x)))) for x in (0, 717.25, 1.9996, 3600, -3)] == ["00:00.000", "11:57.250", "00:01.1000", "01:00:00.000", "00:00.000"]
    assert [ev(T.glossary(L(x))) for x in ("Yeah.", "Mm-hmm", "Thank you.", "That sounds expensive.", "Yeah 42")] == ["嗯。", "嗯嗯。", "謝謝。", None, "嗯。"]
    assert [ev(T.punctuate(L(x))) for x in ("hello", "Hello!", "U.S.")] == ["hello.", "Hello!", "U. S."]
    assert ev(T.split_sentences(L("pi 3.14 is"))) == ["pi 3.", "14 is"]
    assert [ev(T.normalize_query(L(x))) for x in ("  Reluctant! ", "don't", "well-known", "look up", "", "123")] == ["reluctant", "don't", "well-known", None, None, None]
    assert ev(T.lemma_variants(L("pastries"))) == ["pastries", "pastry", "pastri", "pastrie"]
    assert [ev(T.progress_pct(L(float(a)), L(float(b)))) for a, b in ((0, 100), (50, 100), (100, 100), (120, 100), (1, 0))] == [0, 50, 100, 100, 0]
    stray = "嗯。沒有任何樓盤符合您的搜尋結果。"
    assert ev(T.is_contaminated(L(stray))) and "樓盤" not in ev(T.scrub_zh(L(stray)))


def test_split_turns_with_words(spark):
    words = "array<struct<word:string,start:double,end:double>>"
    turn = spark.createDataFrame([("r", 0, "S", 0.0, 2.0, "One. Two. Three. Four.", "一。二。三。四。", [("One.", 0.0, 0.4), ("Two.", 0.5, 0.9), ("Three.", 1.0, 1.4), ("Four.", 1.5, 2.0)])], f"rec_id string, turn_ix int, speaker string, start double, end double, text string, text_zh string, words {words}")
    a, b = W.split_turns(turn).orderBy("part_ix").collect()
    assert (a.text, a.text_zh, a.end) == ("One. Two. Three.", "一。二。三。", 1.4) and (b.text, b.text_zh, b.start) == ("Four.", "四。", 1.5)


def test_smoothing_equals_the_scan(spark):
    rnd, rows = random.Random(3), []
    for rec in range(60):
        for i in range(rnd.randrange(1, 14)):
            rows.append((rec, i, rnd.choice("AB"), float(i), i + rnd.choice([0.5, 0.9]), "w"))
    got = {(r.rec_id, r.word_ix): r.speaker for r in W.smooth_speakers(spark.createDataFrame(rows, "rec_id int, word_ix int, speaker string, start double, end double, word string")).collect()}
    for rec in range(60):
        mine = [list(r) for r in rows if r[0] == rec]
        for i in range(1, len(mine) - 1):
            if mine[i][4] - mine[i][3] < 0.6 and mine[i - 1][2] == mine[i + 1][2] != mine[i][2]:
                mine[i][2] = mine[i - 1][2]
        assert [got[rec, r[1]] for r in mine] == [r[2] for r in mine]


def test_overlap_then_nearest(spark):
    rnd = random.Random(5)
    segs = [("r", i, s := rnd.randrange(0, 400) / 8, s + rnd.randrange(1, 40) / 8, rnd.choice("xyz")) for i in range(12)]
    words = [("r", i, "w", s := rnd.randrange(0, 500) / 8, s + 0.25) for i in range(200)]
    got = {r.word_ix: r.speaker for r in I.assign_speakers_by_overlap(spark.createDataFrame(words, "rec_id string, word_ix int, word string, start double, end double"), spark.createDataFrame(segs, "rec_id string, seg_ix int, start double, end double, speaker string"), renumber=False).collect()}
    for _, ix, _, a, b in words:
        over = max(segs, key=lambda s: (max(0, min(b, s[3]) - max(a, s[2])), -s[1]))
        if min(b, over[3]) - max(a, over[2]) <= 0:
            over = min(segs, key=lambda s: (abs((s[2] + s[3]) / 2 - (a + b) / 2), s[1]))
        assert got[ix] == over[4]


def test_splice_keeps_touching_turns(spark):
    turns = "rec_id string, turn_ix int, speaker string, start double, end double"
    old = spark.createDataFrame([("r", 0, "A", 0.0, 2.0), ("r", 1, "B", 2.0, 5.0), ("r", 2, "C", 5.0, 8.0)], turns)
    new = spark.createDataFrame([("r", 0, "B2", 2.1, 4.8)], turns)
    edits = spark.createDataFrame([("e", "r", 2.0, 5.0)], "edit_id string, rec_id string, start double, end double")
    assert [r.speaker for r in E.splice_turns(old, new, edits).orderBy("turn_ix").collect()] == ["A", "B2", "C"]


def test_resample_lengths(spark):
    x = spark.range(8000).select(L("s").alias("series_id"), F.col("id").alias("i"), L(0.0).alias("value"))
    assert S.resample_linear(x, 8000, 16000).count() == 16000 and S.resample_linear(x, 16000, 16000).count() == 8000


def test_translation_asks_only_for_misses(spark):
    turns = spark.createDataFrame([("r", 0, "Yeah.", ""), ("r", 1, "Known one. New one.", ""), ("r", 2, "New one.", "")], "rec_id string, turn_ix int, text string, text_zh string")
    memory = spark.createDataFrame([("Known one.", "知。")], "piece string, zh string")
    out = {r.turn_ix: r.text_zh for r in X.translate_turns(turns, memory, lambda p: [f"<{x}>" for x in p]).collect()}
    assert out == {0: "嗯。", 1: "知。<New one.>", 2: "<New one.>"}


def test_translation_is_asked_again_once(spark, tmp_path):
    """An empty or contaminated answer is asked for once more; what the translator fails on stays English and is counted."""
    turns = spark.createDataFrame([("r", i, t, "") for i, t in enumerate(["Good one.", "Bad one.", "Always bad.", "Empty one.", "Broken one. Good one."])], "rec_id string, turn_ix int, text string, text_zh string")
    log = tmp_path / "asked"

    def translate(pieces):
        with open(log, "a") as f:
            f.writelines(p + "\n" for p in pieces)
        if "Broken one." in pieces:
            raise RuntimeError("broken")
        # the first list failed as a whole, so a piece's second turn is its first answer
        first = log.read_text().split("\n").count("Bad one.") <= 2
        answers = {"Good one.": "好的。", "Bad one.": "樓盤" if first else "壞的。", "Always bad.": "這樓盤的。", "Empty one.": ""}
        return [answers[p] for p in pieces]

    out = {r.turn_ix: (r.text_zh, r.untranslated) for r in X.translate_turns(turns.coalesce(1), None, translate).collect()}
    assert out == {0: ("好的。", 0), 1: ("壞的。", 0), 2: ("這的。", 0), 3: ("Empty one.", 0), 4: ("Broken one.好的。", 1)}


def test_range_edits_take_their_own_clip(spark):
    """Two touching edits with padding: a word in both clips is taken once, and edits don't share turns."""
    turns = spark.createDataFrame([("r", 0, "A", 0.0, 2.0, "one.", ""), ("r", 1, "B", 2.0, 4.0, "two.", ""), ("r", 2, "A", 5.0, 6.0, "three.", "")], "rec_id string, turn_ix int, speaker string, start double, end double, text string, text_zh string")
    edits = spark.createDataFrame([("e1", "r", 0.0, 2.0, 1.0), ("e2", "r", 2.0, 4.0, 1.0), ("e3", "r", 3.0, 4.5, 1.0), ("e4", "r", 9.0, 9.5, 0.0)], "edit_id string, rec_id string, start double, end double, padding double")
    words = [("e1", 0.5, 1.0, "alpha"), ("e1", 1.75, 2.25, "beta"), ("e1", 2.25, 2.75, "spill"), ("e2", 0.75, 1.25, "beta"), ("e2", 1.25, 1.75, "gamma")]
    clips = spark.createDataFrame([(e, "r", i, w, s, t, 1.0 if e == "e2" else 0.0) for i, (e, s, t, w) in enumerate(words)], "edit_id string, rec_id string, word_ix int, word string, start double, end double, offset double")
    after, report = E.apply_range_edits(turns, clips, edits)
    assert "is_new" not in after.columns
    assert [(r.speaker, r.text) for r in after.orderBy("turn_ix").collect()] == [("A", "alpha."), ("A", "beta."), ("B", "gamma."), ("A", "three.")]
    got = {r.edit_id: (r.status, r.reason, r.kept_words) for r in report.collect()}
    assert got == {"e1": ("applied", None, 1), "e2": ("applied", None, 2), "e3": ("rejected", "overlaps another edit", 0), "e4": ("rejected", "no words", 0)}


def test_split_turns_between_words(spark):
    """Turns with words are cut behind every third sentence, at word times; the last word closes one anyway."""
    w = [("One.", 0.0, 0.4), ("Two.", 0.5, 0.9), ("Three.", 1.0, 1.4), ("Four", 1.5, 1.8), ("more.", 1.8, 2.0)]
    words = [{"word": a, "start": b, "end": c} for a, b, c in w]
    schema = "rec_id string, turn_ix int, speaker string, start double, end double, text string, text_zh string, words array<struct<word:string,start:double,end:double>>"
    rows = [("r", 0, "A", 0.0, 2.0, "One. Two. Three. Four more.", "一。二。三。四。", words), ("r", 1, "A", 2.0, 3.0, "One. Two. Three.", "", words[:3]), ("r", 2, "A", 3.0, 4.0, "", "", [])]
    got = [(r.turn_ix, r.part_ix, r.start, r.end, r.text, r.text_zh) for r in W.split_turns(spark.createDataFrame(rows, schema)).orderBy("turn_ix", "part_ix").collect()]
    assert got == [(0, 0, 0.0, 1.4, "One. Two. Three.", "一。二。三。"), (0, 1, 1.5, 2.0, "Four more.", "四。"), (1, 0, 2.0, 3.0, "One. Two. Three.", ""), (2, 0, 3.0, 4.0, "", "")]


NOTE = "rec_id string, id string, word string, text_en string, text_zh string, start double, end double, source string, created_at double, updated_at double, lemmas array<" + T.LEMMA_ENTRY + ">, dict " + T.LEMMA_ENTRY


CHANGE = "rec_id string, change_id string, id string, word string, text_en string, text_zh string, start string, end string, source string, dict " + T.LEMMA_ENTRY + ", has_dict boolean, remove_lemma string, now double"


def test_note_changes_are_folded(spark):
    """Lemmas through two changes of one note: merge, then remove; and a note that is made and changed in one batch."""
    from colloquy.functions.text import LEMMA_ENTRY

    note = "rec_id string, id string, word string, text_en string, text_zh string, start double, end double, source string, created_at double, updated_at double, lemmas array<" + LEMMA_ENTRY + ">, dict " + LEMMA_ENTRY
    notes = spark.createDataFrame([("r", "n", "Old", "t", "", 1.0, None, "manual", 5.0, None, None, None)], note)
    expensive = {"lemma": "expensive", "phonetic": "", "senses": [], "source": "x"}
    rows = [
        ("r", "c1", "n", "", "t1", "", "", "", "", expensive, True, "", 10.0), ("r", "c2", "n", "", "t2", "", "2", "", "", None, False, "EXPENSIVE", 11.0), ("r", "c3", "n", "", "t3", "", "", "", "", None, False, "missing", 12.0),
        ("r", "m", None, "apple", "u", "", "", "", "", None, False, "", 1.0), ("r", "c5", "m", "", "v", "", "", "", "", expensive, True, "", 2.0),
    ]
    after, failed = E.upsert_notes(notes, spark.createDataFrame(rows, CHANGE))
    got = {r.id: (r.word, r.text_en, [e.lemma for e in r.lemmas], r.dict and r.dict.lemma, r.updated_at) for r in after.collect()}
    assert got == {"n": ("Old", "t2", ["Old"], "Old", 11.0), "m": ("expensive", "v", ["apple", "expensive"], "expensive", 2.0)}
    assert [(r.id, r.change_id, r.error) for r in failed.collect()] == [("n", "c3", "no such lemma")]


def test_notes_and_dictionary_files(spark, tmp_path):
    d = tmp_path / "notes"
    d.mkdir()
    (d / "a.json").write_text(json.dumps({"stem": "a", "notes": [{"id": "1", "text_en": "x", "start": 2.5, "lemmas": [{"lemma": "go", "senses": [{"pos": "v", "zh": "去"}]}]}, {"id": "2"}]}))
    (d / "b.json").write_text(json.dumps({"notes": [{"id": "3"}]}))
    for name, text in (("c.json", "{broken"), ("d.json", json.dumps({"stem": "d"})), ("e.json", json.dumps({"stem": "e", "notes": "none"}))):
        (d / name).write_text(text)
    got = {(r.rec_id, r.id): r for r in files.read_notes(spark, str(d)).collect()}
    assert set(got) == {("a", "1"), ("a", "2"), ("b", "3")} and got["a", "1"].start == 2.5 and got["a", "1"].lemmas[0].senses[0].zh == "去"
    table = tmp_path / "dict.csv"
    table.write_text('word,phonetic,definition,translation,pos\nApple,/a/,"a ""round"" fruit","n. 蘋果\nn. 樹",n:9\nbe,,,,\n')
    rows = {r.key: r for r in files.read_dictionary(spark, str(table), "csv").collect()}
    assert set(rows) == {"apple", "be"} and rows["apple"].translation == "n. 蘋果\nn. 樹" and rows["apple"].definition == 'a "round" fruit'
    out = {r.query: r for r in E.lookup_words(spark.createDataFrame([("Apples!",), ("be",), ("two words",)], "query string"), files.read_dictionary(spark, str(table), "csv")).collect()}
    assert out["Apples!"].ok and out["Apples!"].entry.lemma == "Apple" and [x.zh for x in out["Apples!"].entry.senses] == ["蘋果", "樹"]
    assert not out["be"].ok and out["two words"].lemma is None


def test_recordings_of_the_work_folder_come_first(spark, tmp_path):
    work = tmp_path / "work"
    work.mkdir()
    for f in ("recording.wav", "b.m4a", "A.wav", "c.txt", "d.flac", "work/z.work.wav", "work/recording.wav", "work/y.mp3"):
        (tmp_path / f).write_bytes(b"x")
    got = [(r.priority, r.name) for r in files.scan_recordings(spark, str(tmp_path), str(work)).collect()]
    assert got == [(0, "recording.wav"), (0, "z.work.wav"), (1, "A.wav"), (2, "b.m4a"), (9, "d.flac"), (9, "y.mp3")]


def test_files(spark, tmp_path):
    d = tmp_path / "t"
    d.mkdir()
    good = {"language": "en", "turns": [{"speaker": "A", "start": 0, "end": 1.5, "text": "hi"}]}
    for name, text in (("a.json", json.dumps(good)), ("b.json", "{"), ("c.json", "{}"), ("d.turns.json", json.dumps(good)), ("e.whisper.json", json.dumps(good))):
        (d / name).write_text(text)
    docs = files.read_transcripts(spark, str(d))
    assert [r.rec_id for r in docs.collect()] == ["a"] and files.explode_turns(docs).first().end == 1.5
    asr = tmp_path / "asr"
    asr.mkdir()
    (asr / "x.whisper.json").write_text(json.dumps({"text": " all of it ", "language": " EN "}))
    row = files.read_asr(spark, str(asr)).first()
    assert (row.rec_id, row.language, row.segments[0].text) == ("x", "en", " all of it ")
    seg = tmp_path / "seg"
    seg.mkdir()
    (seg / "y.json").write_text('log line\n{"mode":"m","segments":[{"start":0,"end":1,"speaker":"S"},{"start":1,"end":2,"speaker":"T"}]}\n')
    assert [(r.rec_id, r.seg_ix, r.speaker) for r in files.read_speaker_segments(spark, str(seg)).collect()] == [("y", 0, "S"), ("y", 1, "T")]
    wav = tmp_path / "wav"
    wav.mkdir()
    head = lambda ch, rate, bits: b"RIFF" + b"\0" * 18 + struct.pack("<HIIHH", ch, rate, 0, 0, bits) + b"\0" * 20
    for name, data in (("ok.wav", head(1, 16000, 16)), ("stereo.wav", head(2, 16000, 16)), ("slow.wav", head(1, 8000, 16)), ("short.wav", b"RIFF")):
        (wav / name).write_bytes(data)
    found = files.wav_header_audit(spark.read.format("binaryFile").load(str(wav)))
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in found.collect()} == {"ok.wav": None, "stereo.wav": "not mono", "slow.wav": "not 16 kHz", "short.wav": "too short"}
    assert [r.name for r in files.scan_recordings(spark, str(wav)).collect()] == ["ok.wav", "short.wav", "slow.wav", "stereo.wav"]


def test_checkpoint_computes_missing_only(spark, tmp_path):
    asked = []

    def compute(df):
        asked.append(df.count())
        return df

    ids = lambda n: spark.range(n).withColumnRenamed("id", "rec_id")
    path = str(tmp_path / "stage")
    assert files.checkpoint_stage(spark, path, compute, ids(3)).count() == 3
    assert files.checkpoint_stage(spark, path, compute, ids(5)).count() == 5
    assert files.checkpoint_stage(spark, path, compute, ids(5)).count() == 5 and asked == [3, 2]
    # a folder whose job did not end is written anew; one that can't be read is left alone
    (tmp_path / "stage" / "_SUCCESS").unlink()
    assert files.checkpoint_stage(spark, path, compute, ids(4)).count() == 4 and asked == [3, 2, 4]
    for f in (tmp_path / "stage").glob("*.parquet"):
        f.write_bytes(b"broken")
    with pytest.raises(Exception):  # noqa: B017
        files.checkpoint_stage(spark, path, compute, ids(4)).count()
    assert asked == [3, 2, 4]


NAMES = ("a+b", "50% off", "c%20d", "e f", "g#h", "i?j", "k&l", "ü", "m,n", "o[p]", "q{r}", "s;t=u")


def test_names_are_as_they_are(spark, tmp_path):
    """Names with what paths escape, through every reader; a list at the top of a file is no document."""
    for n in NAMES:
        (tmp_path / f"{n}.json").write_text(json.dumps({"turns": [{"text": "x", "start": 0}], "notes": [{"id": "1"}], "segments": [{"start": 0, "end": 1, "speaker": "S"}], "text": "y"}))
        (tmp_path / f"{n}.wav").write_bytes(b"x")
    (tmp_path / "list.json").write_text(json.dumps([{"turns": [{"text": "x"}]}]))
    here = f"{tmp_path}/*.json"
    read = {"transcripts": files.read_transcripts(spark, here), "asr": files.read_asr(spark, here), "segments": files.read_speaker_segments(spark, here), "notes": files.read_notes(spark, here)}
    for name, df in read.items():
        assert sorted(r.rec_id for r in df.collect()) == sorted(NAMES), name
    assert sorted(r.rec_id for r in files.scan_recordings(spark, str(tmp_path)).collect()) == sorted(NAMES)


def test_transcripts_are_chosen_by_their_whole_stem(spark):
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    got = {r.name: r.transcript_name for r in E.library(names("a.m4a", "a.v2.m4a", "b.wav", "c.work.wav", "d.wav"), names("a.v2.json", "b.whisper.json", "b.turns.json", "c.work.json", "d.work.json", "d.json", "d.txt")).collect()}
    assert got == {"a.m4a": None, "a.v2.m4a": "a.v2.json", "b.wav": None, "c.work.wav": "c.work.json", "d.wav": "d.json"}


def test_rescrub_translates_what_was_contaminated(spark):
    turns = spark.createDataFrame([("r", 0, "Good one.", "好。沒有任何樓盤符合您的搜尋結果。"), ("r", 1, "Yeah.", "樓盤"), ("r", 2, "Fine.", "好。"), ("r", 3, "", "樓盤")], "rec_id string, turn_ix int, text string, text_zh string")
    got = {r.turn_ix: (r.text_zh, r.changed, r.to_translate) for r in E.rescrub(turns, translate=lambda pieces: [f"<{p}>" for p in pieces]).collect()}
    assert got[0] == ("<Good one.>", True, True) and got[1] == ("嗯。", True, False) and got[2] == ("好。", False, False) and got[3][2] is False
    assert {r.turn_ix: r.text_zh for r in E.rescrub(turns).collect()}[0].startswith("好。")


def test_deletion_by_stem(spark):
    files_ = spark.createDataFrame([("recording", "a.wav"), ("recording", "a.work.wav"), ("recording", "recording.wav"), ("out", "a.v2.json"), ("notes", "a.json"), ("notes", "a.v2.json"), ("out", "ab.json")], "kind string, name string")
    stems = spark.createDataFrame([("a",), ("recording",), ("none",)], "stem string")
    gone = E.delete_recordings(files_, stems)
    assert {(r.kind, r.name) for r in gone.where("deleted").collect()} == {("recording", "a.wav"), ("recording", "a.work.wav"), ("out", "a.v2.json"), ("notes", "a.json")}
    assert {r.stem: (r.n_deleted, r.n_notes, r.names) for r in E.deletion_report(gone, stems).collect()} == {"a": (4, 1, ["a.json", "a.v2.json", "a.wav", "a.work.wav"]), "recording": (0, 0, []), "none": (0, 0, [])}
