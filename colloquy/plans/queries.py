"""Registered queries over the driver's tables, with their SQL.

Each query applies operators of the library to a view of :mod:`colloquy.plans.fixtures`;
its SQL states the same result in another way where it can.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import blocks as K
from colloquy.operators import clusters as C
from colloquy.operators import edits as E
from colloquy.operators import intervals as I
from colloquy.operators import render as R
from colloquy.operators import signal as S
from colloquy.operators import translate as X
from colloquy.operators import turns as W
from colloquy.plans.fixtures import VIEWS, Fixtures
from colloquy.sources import files, outputs, wav
from colloquy.streaming import jobs

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__
        _QUERIES[name] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql:
            with_, _, body = sql.partition("SELECT-> ")
            _SQL[name] = "WITH " + VIEWS.strip() + ("," + with_ if with_.strip() else "") + "\nSELECT " + body if body else "WITH " + VIEWS.strip() + "\n" + sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return w1_turn_stats(Fixtures(spark, sf_dir))


_r6 = lambda c: F.round(F.col(c), 6).alias(c)

# ------------------------------------------------------------- words, speakers, turns

_SMOOTH = """
sm_b AS (SELECT *, lag(speaker) OVER w AS before, coalesce(lag(speaker) OVER w = lead(speaker) OVER w AND speaker <> lag(speaker) OVER w AND "end" - "start" < 0.6, FALSE) AS base
         FROM fx_words WINDOW w AS (PARTITION BY rec_id ORDER BY word_ix)),
sm_r AS (SELECT *, sum(CASE WHEN base THEN 0 ELSE 1 END) OVER (PARTITION BY rec_id ORDER BY word_ix) AS run FROM sm_b),
sm_n AS (SELECT *, sum(CAST(base AS INTEGER)) OVER (PARTITION BY rec_id, run ORDER BY word_ix) AS nth FROM sm_r),
smooth AS (SELECT rec_id, word_ix, word, "start", "end", CASE WHEN base AND nth % 2 = 1 THEN before ELSE speaker END AS speaker FROM sm_n)"""

_TURNS = _SMOOTH + """,
tn_f AS (SELECT *, CASE WHEN lag(speaker) OVER w <> speaker OR "start" - lag("end") OVER w > 0.8 THEN 1 ELSE 0 END AS fresh FROM smooth WINDOW w AS (PARTITION BY rec_id ORDER BY word_ix)),
tn_i AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY rec_id ORDER BY word_ix) AS INTEGER) AS turn_ix FROM tn_f),
tn AS (SELECT rec_id, turn_ix, min(speaker) AS speaker, arg_min("start", word_ix) AS "start", arg_max("end", word_ix) AS "end",
              regexp_replace(string_agg(CASE WHEN regexp_matches(word, '^[,.;:!?]') THEN word ELSE ' ' || word END, '' ORDER BY word_ix), '^ +', '') AS text
       FROM tn_i GROUP BY rec_id, turn_ix)"""


@query(_SMOOTH + " SELECT-> rec_id, word_ix, speaker FROM smooth")
def w2_smooth_speakers(fx):
    return W.smooth_speakers(fx.words()).select("rec_id", "word_ix", "speaker")


@query(_TURNS + ' SELECT-> rec_id, turn_ix, speaker, "start", "end", text FROM tn')
def w1_turns(fx):
    return W.words_to_turns(W.smooth_speakers(fx.words())).select("rec_id", "turn_ix", "speaker", "start", "end", "text")


@query(_TURNS + " SELECT-> rec_id, count(DISTINCT speaker) AS n_speakers, count(*) AS n_turns, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS speakers FROM tn GROUP BY rec_id")
def w1_turn_stats(fx):
    return W.transcript_stats(W.make_turns(fx.words()))


@query(""" fs AS (SELECT rec_id, speaker, min(word_ix) AS f FROM fx_words GROUP BY ALL), nm AS (SELECT *, printf('SPEAKER_%02d', dense_rank() OVER (PARTITION BY rec_id ORDER BY f)) AS name FROM fs)
SELECT-> w.rec_id, w.word_ix, nm.name AS speaker FROM fx_words w JOIN nm ON w.rec_id = nm.rec_id AND w.speaker = nm.speaker""")
def w5_renumber(fx):
    return I.renumber_first_seen(fx.words(), order="word_ix").select("rec_id", "word_ix", "speaker")


@query("""SELECT rec_id, word_ix, CAST(coalesce(sum(CAST(regexp_matches(word, '[.!?。！？]["''”’)\\]]*$') AS INTEGER)) OVER (PARTITION BY rec_id ORDER BY word_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS sentence_ix FROM fx_words""".replace("\\\\", "\\"))
def w3_sentences(fx):
    return W.sentence_groups(fx.words()).select("rec_id", "word_ix", "sentence_ix")


_SENT = "list_filter(list_transform(regexp_extract_all({}, '[^.!?。！？]*[.!?。！？]|[^.!?。！？]+$'), lambda s: trim(s, E' \\n\\t\\r')), lambda s: s <> '')"


@query(f""" st AS (SELECT *, {_SENT.format('text')} AS s, {_SENT.format('text_zh')} AS z FROM fx_turns), sn AS (SELECT *, len(s) AS n, len(z) AS m FROM st),
sp AS (SELECT *, unnest(range(0, CASE WHEN n <= 3 THEN 1 ELSE (n - 1) // 3 + 1 END)) AS p FROM sn), sq AS (SELECT *, p * 3 AS i, least(p * 3 + 3, n) AS j FROM sp),
sz AS (SELECT *, greatest(0, least(m - 1, CAST(round_even(i::DOUBLE * m / greatest(n, 1), 0) AS INTEGER))) AS z0, CAST(round_even(j::DOUBLE * m / greatest(n, 1), 0) AS INTEGER) AS zj FROM sq)
SELECT-> rec_id, turn_ix, CAST(p AS INTEGER) AS part_ix, round(CASE WHEN n <= 3 THEN "start" ELSE "start" + greatest(0.05, "end" - "start") * i / n END, 6) AS "start", round(CASE WHEN n <= 3 THEN "end" ELSE "start" + greatest(0.05, "end" - "start") * j / n END, 6) AS "end",
  CASE WHEN n <= 3 THEN text ELSE array_to_string(s[i + 1 : j], ' ') END AS text,
  CASE WHEN n <= 3 THEN text_zh WHEN m = 0 THEN '' WHEN m = n THEN array_to_string(z[i + 1 : j], '') ELSE array_to_string(z[z0 + 1 : greatest(z0 + 1, least(m, greatest(zj, z0 + 1)))], '') END AS text_zh FROM sz""")
def w4_split_turns(fx):
    return W.split_turns(fx.turns()).select("rec_id", "turn_ix", "part_ix", _r6("start"), _r6("end"), "text", "text_zh")


@query((_TURNS + """, sx AS (SELECT *, regexp_matches(word, '[.!?。！？]["''”’)\\]]*$') AS closes FROM tn_i),
sy AS (SELECT *, coalesce(sum(CAST(closes AS INTEGER)) OVER (PARTITION BY rec_id, turn_ix ORDER BY word_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM sx),
ch AS (SELECT *, CASE WHEN max(sentence) OVER (PARTITION BY rec_id, turn_ix) < 2 THEN 0 ELSE sentence // 2 END AS part FROM sy)
SELECT-> rec_id, turn_ix, CAST(part AS INTEGER) AS part_ix, any_value(speaker) AS speaker, arg_min("start", word_ix) AS "start", arg_max("end", word_ix) AS "end",
  regexp_replace(string_agg(CASE WHEN regexp_matches(word, '^[,.;:!?]') THEN word ELSE ' ' || word END, '' ORDER BY word_ix), '^ +', '') AS text, count(*) AS n_words FROM ch GROUP BY rec_id, turn_ix, part"""))
def w4_split_spoken_turns(fx):
    t = W.words_to_turns(W.smooth_speakers(fx.words())).withColumn("text_zh", F.lit(""))
    return W.split_turns(t, 2).select("rec_id", "turn_ix", "part_ix", "speaker", "start", "end", "text", F.size("words").cast("long").alias("n_words"))


@query("SELECT rec_id, count(DISTINCT speaker) AS n_speakers, count(*) AS n_turns, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS speakers FROM fx_turns GROUP BY rec_id")
def a3_transcript_stats(fx):
    return W.transcript_stats(fx.turns())


@query("""SELECT rec_id, trim(string_agg(trim(text, E' \n\t\r'), ' ' ORDER BY "start", "end", turn_ix), E' \n\t\r') AS text FROM fx_turns GROUP BY rec_id""")
def a4_doc_text(fx):
    return W.doc_text(fx.turns())


def _asr(fx) -> DataFrame:
    w = fx.words().withColumn("p", F.lit(0.5))
    seg = w.groupBy("rec_id", "turn").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("word_ix", F.concat(F.lit(" "), "word").alias("word"), "start", "end", F.col("p").alias("probability")))).alias("w"))
    words = F.when(F.col("turn") % 4 == 3, F.array().cast("array<struct<word:string,start:double,end:double,probability:double>>")).otherwise(F.transform("w", lambda x: F.struct(x["word"], x["start"], F.when(F.length(x["word"]) == 4, None).otherwise(x["end"]).alias("end"), x["probability"])))
    text = F.concat(F.lit(" "), F.array_join(F.transform("w", lambda x: F.trim(x["word"])), " "))
    seg = seg.select("rec_id", "turn", F.struct("start", "end", text.alias("text"), words.alias("words")).alias("s"))
    return seg.groupBy("rec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "s"))), lambda x: x["s"]).alias("segments")).withColumn("language", F.lit(" EN ")).withColumn("text", F.lit(""))


@query(""" ps AS (SELECT rec_id, turn, min("start") AS "start", max("end") AS "end", string_agg(word, ' ' ORDER BY word_ix) AS word FROM fx_words WHERE turn % 4 = 3 GROUP BY rec_id, turn),
al AS (SELECT rec_id, turn, 0 AS pos, word, "start", "end", 0.0::DOUBLE AS probability FROM ps UNION ALL SELECT rec_id, turn, word_ix, word, "start", "end", 0.5::DOUBLE FROM fx_words WHERE turn % 4 <> 3 AND length(word) <> 3)
SELECT-> rec_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY "start", "end", turn, pos) - 1 AS INTEGER) AS word_ix, word, "start", "end", probability FROM al""")
def a1_a2_collect_words(fx):
    return W.collect_words(W.normalize_asr(_asr(fx)))


# ------------------------------------------------------------------------------ joins

_NAMED = """
sg_f AS (SELECT rec_id, speaker, min(seg_ix) AS f FROM fx_segments GROUP BY ALL), sg_n AS (SELECT *, printf('SPEAKER_%02d', dense_rank() OVER (PARTITION BY rec_id ORDER BY f)) AS name FROM sg_f),
sg AS (SELECT s.rec_id, s.seg_ix, s."start", s."end", n.name FROM fx_segments s JOIN sg_n n ON s.rec_id = n.rec_id AND s.speaker = n.speaker),
"""


@query(_NAMED + """ pr AS (SELECT w.rec_id, w.word_ix, g.name, g.seg_ix, greatest(0, least(w."end", g."end") - greatest(w."start", g."start")) AS o, abs((w."start" + w."end") / 2 - (g."start" + g."end") / 2) AS d FROM fx_words w JOIN sg g ON w.rec_id = g.rec_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY rec_id, word_ix ORDER BY o DESC, CASE WHEN o > 0 THEN 0 ELSE d END, seg_ix) AS r FROM pr) SELECT-> rec_id, word_ix, name AS speaker FROM rk WHERE r = 1""")
def j1_speakers_by_overlap(fx):
    return I.assign_speakers_by_overlap(fx.words(), fx.segments()).select("rec_id", "word_ix", "speaker")


@query(""" c0 AS (SELECT rec_id, label, min(win_ix) AS f FROM fx_windows GROUP BY ALL), c1 AS (SELECT *, printf('SPEAKER_%02d', dense_rank() OVER (PARTITION BY rec_id ORDER BY f)) AS name FROM c0),
c AS (SELECT w.rec_id, w.win_ix, w.center, c1.name FROM fx_windows w JOIN c1 ON w.rec_id = c1.rec_id AND w.label = c1.label),
pw AS (SELECT rec_id % 7 AS rec_id, rec_id * 100000 + word_ix AS word_ix, ("start" + "end") / 2 AS t FROM fx_words WHERE rec_id < 70 AND word_ix < 100),
rk AS (SELECT pw.rec_id, pw.word_ix, c.name, row_number() OVER (PARTITION BY pw.rec_id, pw.word_ix ORDER BY abs(c.center - pw.t), c.win_ix) AS r FROM pw LEFT JOIN c ON pw.rec_id = c.rec_id)
SELECT-> rec_id, word_ix, coalesce(name, 'SPEAKER_01') AS speaker FROM rk WHERE r = 1""".replace(" WHERE rec_id < 70 AND word_ix < 100", ""))
def j2_nearest(fx):
    w = fx.words().withColumn("word_ix", F.col("rec_id") * 100000 + F.col("word_ix")).withColumn("rec_id", F.col("rec_id") % 7)
    return I.assign_nearest(w, fx.windows()).select("rec_id", "word_ix", "speaker")


@query(""" pr AS (SELECT w.rec_id, w.word_ix, g.speaker AS name, g.turn_ix, greatest(0, least(w."end", g."end") - greatest(w."start", g."start")) AS o, abs((w."start" + w."end") / 2 - (g."start" + g."end") / 2) AS d FROM fx_words w JOIN fx_turns g ON w.rec_id = g.rec_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY rec_id, word_ix ORDER BY o DESC, CASE WHEN o > 0 THEN 0 ELSE d END, turn_ix) AS r FROM pr) SELECT-> rec_id, word_ix, name AS speaker FROM rk WHERE r = 1""")
def j3_inherit_speaker(fx):
    return I.inherit_speaker(fx.words(), fx.turns()).select("rec_id", "word_ix", "speaker")


@query("""SELECT t.rec_id, t.turn_ix FROM fx_turns t WHERE NOT EXISTS (SELECT 1 FROM fx_edits e WHERE e.rec_id = t.rec_id AND least(t."end", e."end") - greatest(t."start", e."start") > 0)""")
def j6_turns_outside(fx):
    return I.turns_outside_ranges(fx.turns(), fx.edits()).select("rec_id", "turn_ix")


@query("""SELECT t.rec_id, t.turn_ix FROM fx_turns t WHERE EXISTS (SELECT 1 FROM fx_edits e WHERE e.rec_id = t.rec_id AND least(t."end", e."end") - greatest(t."start", e."start") > 0)""")
def j6_turns_inside(fx):
    return I.turns_inside_ranges(fx.turns(), fx.edits()).select("rec_id", "turn_ix")


@query("""SELECT t.rec_id, t.turn_ix, greatest(0.0, least(t."end", e."end") - greatest(t."start", e."start")) AS overlap FROM fx_turns t JOIN fx_edits e ON t.rec_id = e.rec_id""")
def j7_interval_overlap(fx):
    e = fx.edits().select("rec_id", F.col("start").alias("s"), F.col("end").alias("e"))
    return fx.turns().join(e, "rec_id").select("rec_id", "turn_ix", I.interval_overlap(F.col("start"), F.col("end"), F.col("s"), F.col("e")).alias("overlap"))


_Q = " lq AS (SELECT DISTINCT lower(word) AS query FROM fx_words WHERE regexp_matches(word, '^[A-Za-z]+$'))"


_VARIANTS = """ vr AS (SELECT query, query AS key, 0 AS ix FROM lq
  UNION ALL SELECT query, query[:-4] || 'y', 1 FROM lq WHERE suffix(query, 'ies') AND length(query) > 4
  UNION ALL SELECT query, query[:-4], 2 FROM lq WHERE suffix(query, 'ing') AND length(query) > 5
  UNION ALL SELECT query, query[:-4] || 'e', 3 FROM lq WHERE suffix(query, 'ing') AND length(query) > 5
  UNION ALL SELECT query, query[:-5], 4 FROM lq WHERE suffix(query, 'ing') AND length(query) > 5 AND query[-4] = query[-5]
  UNION ALL SELECT query, query[:-3], 5 FROM lq WHERE suffix(query, 'ed') AND length(query) > 4
  UNION ALL SELECT query, query[:-3] || 'e', 6 FROM lq WHERE suffix(query, 'ed') AND length(query) > 4
  UNION ALL SELECT query, query[:-4], 7 FROM lq WHERE suffix(query, 'ed') AND length(query) > 4 AND query[-3] = query[-4]
  UNION ALL SELECT query, query[:-3], 8 FROM lq WHERE suffix(query, 'es') AND length(query) > 3
  UNION ALL SELECT query, query[:-2], 9 FROM lq WHERE suffix(query, 'es') AND length(query) > 3
  UNION ALL SELECT query, query[:-2], 10 FROM lq WHERE suffix(query, 's') AND NOT suffix(query, 'es') AND NOT suffix(query, 'ss') AND length(query) > 3)"""


def _cache(fx) -> DataFrame:
    """Cached entries of some words: of either source, and some without senses."""
    w = fx.words().where(F.col("word").rlike("^[A-Za-z]+$")).select(F.lower("word").alias("lemma")).distinct().where(F.length("lemma") % 4 == 0)
    sense = F.struct(F.lit("c").alias("pos"), F.lit("").alias("zh"), F.concat(F.lit("cached "), "lemma").alias("en"), F.lit("").alias("example"))
    senses = F.when(F.col("lemma").rlike("^[a-m]"), F.array(sense)).otherwise(F.array().cast(T.SENSES))
    source = F.when(F.length("lemma") % 8 == 0, "free-dictionary").otherwise("ecdict")
    return w.select("lemma", F.struct("lemma", F.lit("").alias("phonetic"), senses.alias("senses"), source.alias("source")).cast(T.LEMMA_ENTRY).alias("entry"))


_LOOKUP = _Q + "," + _VARIANTS + """,
ht AS (SELECT vr.query, arg_min(d.word, vr.ix) AS headword FROM vr JOIN fx_dict d ON d.word = vr.key AND d.translation <> '' GROUP BY vr.query),
fb AS (SELECT word FROM fx_dict WHERE length(word) % 3 <> 0),
al AS (SELECT lq.query, ht.headword, fb.word IS NOT NULL AS other, length(lq.query) % 4 = 0 AND regexp_matches(lq.query, '^[a-m]') AND NOT (length(lq.query) % 8 = 0 AND ht.headword IS NOT NULL) AS stays
       FROM lq LEFT JOIN ht ON lq.query = ht.query LEFT JOIN fb ON lq.query = fb.word)
SELECT-> query, query AS lemma, stays OR headword IS NOT NULL OR other AS ok, stays AS cached,
  CASE WHEN stays THEN CASE WHEN length(query) % 8 = 0 THEN 'free-dictionary' ELSE 'ecdict' END WHEN headword IS NOT NULL THEN 'ecdict' WHEN other THEN 'free-dictionary' END AS source,
  CASE WHEN stays THEN query WHEN headword IS NOT NULL THEN headword WHEN other THEN query END AS headword,
  CASE WHEN stays THEN 'c::cached ' || query WHEN headword IS NOT NULL THEN 'n:' || headword || ':the ' || headword WHEN other THEN 'noun::a ' || query || '|verb::to ' || query || '|verb::to ' || query || ' it|noun::one ' || query || '|noun::two ' || query || '|noun::three ' || query END AS senses FROM al"""


@query(_LOOKUP)
def j4_lookup_words(fx, filtered: bool = False):
    q = fx.words().where(F.col("word").rlike("^[A-Za-z]+$")).select(F.lower("word").alias("query"))
    out = E.lookup_words(q, fx.dictionary(), fx.fallback(), _cache(fx), filtered)
    senses = F.array_join(F.transform("entry.senses", lambda x: F.concat_ws(":", x["pos"], x["zh"], x["en"])), "|")
    return out.select("query", "lemma", "ok", "cached", "source", F.col("entry.lemma").alias("headword"), senses.alias("senses"))


@query(_LOOKUP)
def j4_lookup_words_filtered(fx):
    return j4_lookup_words(fx, filtered=True)


def _names(fx) -> DataFrame:
    return fx.table("orders").select(F.concat(F.lit("rec"), (F.col("o_orderkey") % 5000).cast("string"), F.when(F.col("o_orderkey") % 3 == 0, ".work.wav").when(F.col("o_orderkey") % 3 == 1, ".m4a").otherwise(".v2.wav")).alias("name")).distinct()


_NAMES = " nm AS (SELECT DISTINCT 'rec' || (o_orderkey % 5000) || CASE o_orderkey % 3 WHEN 0 THEN '.work.wav' WHEN 1 THEN '.m4a' ELSE '.v2.wav' END AS name FROM orders), ns AS (SELECT name, CASE WHEN suffix(name, '.work.wav') THEN name[:-10] ELSE regexp_replace(name, '\\.[^./]+$', '') END AS stem FROM nm)"


@query(_NAMES + " SELECT-> name, stem FROM ns")
def f1_media_stem(fx):
    return _names(fx).withColumn("stem", T.media_stem("name"))


def _docs_of(fx) -> DataFrame:
    return fx.table("customer").select(F.concat(F.lit("rec"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 4 == 0, ".work.json").when(F.col("c_custkey") % 4 == 1, ".json").when(F.col("c_custkey") % 4 == 2, ".v2.json").otherwise(".whisper.json")).alias("name"))


@query(_NAMES + """, dn AS (SELECT 'rec' || c_custkey || CASE c_custkey % 4 WHEN 0 THEN '.work.json' WHEN 1 THEN '.json' WHEN 2 THEN '.v2.json' ELSE '.whisper.json' END AS t FROM customer),
bs AS (SELECT ns.name, ns.stem, arg_min(t, CASE WHEN t = ns.stem || '.json' THEN '0' WHEN t = ns.stem || '.work.json' THEN '1' ELSE '2' || t END) AS transcript_name FROM ns JOIN dn ON t IN (ns.stem || '.json', ns.stem || '.work.json') GROUP BY ns.name, ns.stem)
SELECT-> ns.name, ns.stem, bs.transcript_name, bs.transcript_name IS NOT NULL AS has_transcript FROM ns LEFT JOIN bs ON ns.name = bs.name""")
def j5_library(fx):
    return E.library(_names(fx), _docs_of(fx)).select("name", "stem", "transcript_name", "has_transcript")


@query(_NAMES + """, sd AS (SELECT 'rec' || (c_custkey * 3) AS stem FROM customer), h AS (SELECT ns.name, min(sd.stem) AS stem FROM ns JOIN sd ON ns.stem = sd.stem OR starts_with(ns.name, sd.stem || '.') GROUP BY ns.name)
SELECT-> ns.name, h.stem, h.stem IS NOT NULL AS deleted FROM ns LEFT JOIN h ON ns.name = h.name""")
def u6_delete_recordings(fx):
    stems = fx.table("customer").select(F.concat(F.lit("rec"), (F.col("c_custkey") * 3).cast("string")).alias("stem"))
    return E.delete_recordings(_names(fx).withColumn("kind", F.lit("recording")), stems).select("name", "stem", "deleted")


@query(_NAMES + """, sd AS (SELECT DISTINCT 'rec' || (c_custkey * 3) AS stem FROM customer), fl AS (SELECT 'recording' AS kind, name, stem FROM ns UNION ALL SELECT DISTINCT 'notes', stem || '.json', stem FROM ns),
h AS (SELECT fl.kind, fl.name, min(sd.stem) AS stem FROM fl JOIN sd ON fl.stem = sd.stem OR (fl.kind = 'recording' AND starts_with(fl.name, sd.stem || '.')) GROUP BY ALL)
SELECT-> sd.stem, count(h.name) AS n_deleted, count(h.name) FILTER (WHERE h.kind = 'notes') AS n_notes, coalesce(string_agg(h.name, ',' ORDER BY h.name), '') AS names FROM sd LEFT JOIN h ON sd.stem = h.stem GROUP BY sd.stem""")
def u6_deletion_report(fx):
    stems = fx.table("customer").select(F.concat(F.lit("rec"), (F.col("c_custkey") * 3).cast("string")).alias("stem"))
    notes = _names(fx).select(F.lit("notes").alias("kind"), F.concat(T.media_stem("name"), F.lit(".json")).alias("name")).distinct()
    gone = E.delete_recordings(_names(fx).select(F.lit("recording").alias("kind"), "name").unionAll(notes), stems)
    return E.deletion_report(gone, stems).withColumn("names", F.array_join("names", ","))


# ---------------------------------------------------------------- scalars and filters


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN h > 0 THEN printf('%02d:%02d:%02d.%03d', h, m, s, ms) ELSE printf('%02d:%02d.%03d', m, s, ms) END AS ts FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, CAST(w // 3600 AS INTEGER) AS h, CAST(w % 3600 // 60 AS INTEGER) AS m, CAST(w % 60 AS INTEGER) AS s, CAST(round_even((x - w) * 1000, 0) AS INTEGER) AS ms FROM (SELECT *, l_extendedprice / 8 AS x, CAST(floor(l_extendedprice / 8) AS BIGINT) AS w FROM lineitem))""")
def f2_format_ts(fx):
    return fx.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.format_ts(F.col("l_extendedprice") / 8).alias("ts"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN h > 0 THEN printf('%02d:%02d:%02d,%03d', h, m, s, ms) ELSE printf('%02d:%02d,%03d', m, s, ms) END AS ts FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, CAST(w // 3600 AS INTEGER) AS h, CAST(w % 3600 // 60 AS INTEGER) AS m, CAST(w % 60 AS INTEGER) AS s, CAST(round_even((x - w) * 1000, 0) AS INTEGER) AS ms FROM (SELECT *, l_extendedprice / 16 AS x, CAST(floor(l_extendedprice / 16) AS BIGINT) AS w FROM lineitem))""")
def f3_srt_ts(fx):
    return fx.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.srt_ts(F.col("l_extendedprice") / 16).alias("ts"))


@query("""SELECT rec_id, turn, regexp_replace(string_agg(CASE WHEN regexp_matches(w, '^[,.;:!?]') THEN w ELSE ' ' || w END, '' ORDER BY word_ix), '^ +', '') AS joined FROM (SELECT rec_id, turn, word_ix, CASE WHEN word_ix % 5 = 4 THEN ',' ELSE word END AS w FROM fx_words) GROUP BY rec_id, turn""")
def f4_join_words(fx):
    w = fx.words().withColumn("w", F.when(F.col("word_ix") % 5 == 4, ",").otherwise(F.col("word")))
    return w.groupBy("rec_id", "turn").agg(T.join_words(F.transform(F.array_sort(F.collect_list(F.struct("word_ix", "w"))), lambda x: x["w"])).alias("joined"))


@query("""SELECT rec_id, word_ix, regexp_matches(word, '[.!?。！？]["''”’)\\]]*$') AS ends FROM fx_words""".replace("\\\\", "\\"))
def f5_ends_sentence(fx):
    return fx.words().select("rec_id", "word_ix", T.ends_sentence(F.col("word")).alias("ends"))


@query("SELECT doc_id, len(s) AS n, array_to_string(s, '|') AS sentences FROM (SELECT doc_id, " + _SENT.format("text") + " AS s FROM documents)")
def f6_split_sentences(fx):
    return fx.table("documents").select("doc_id", T.split_sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").cast("long").alias("n"), F.array_join("s", "|").alias("sentences"))


@query("SELECT rec_id, turn_ix, array_to_string(" + _SENT.format("text_zh") + ", '|') AS sentences FROM fx_turns")
def f7_split_zh(fx):
    return fx.turns().select("rec_id", "turn_ix", F.array_join(T.split_zh_sentences(F.col("text_zh")), "|").alias("sentences"))


@query("""SELECT p_partkey, CASE WHEN m = n THEN array_to_string(a[i + 1 : j], '') ELSE array_to_string(a[z0 + 1 : greatest(z0 + 1, least(m, greatest(zj, z0 + 1)))], '') END AS part FROM (
  SELECT *, greatest(0, least(m - 1, CAST(round_even(i::DOUBLE * m / n, 0) AS INTEGER))) AS z0, CAST(round_even(j::DOUBLE * m / n, 0) AS INTEGER) AS zj FROM (
  SELECT p_partkey, range(0, 1 + p_size % 9) AS a, 1 + p_size % 9 AS m, 1 + CAST(p_partkey % 7 AS INTEGER) AS n, CAST(p_partkey % 7 AS INTEGER) // 2 AS i, 1 + CAST(p_partkey % 7 AS INTEGER) AS j FROM part))""")
def f8_zh_slice(fx):
    k = (F.col("p_partkey") % 7).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.col("p_size") % 9), lambda x: x.cast("string"))
    return fx.table("part").select("p_partkey", T.zh_slice(parts, F.floor(k / 2).cast("int"), k + 1, k + 1).alias("part"))


_PUNCT = r"""regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({0}, E' \n\t\r'), '\s+([,.;:!?])', '\1', 'g'), '([,.;:!?])([A-Za-z])', '\1 \2', 'g'), '\bMm\s*-\s*hmm\b', 'Mm-hmm', 'gi'), '\s+', ' ', 'g')), '([^.?!…"'')])$', '\1.')"""


@query("SELECT doc_id, " + _PUNCT.format("text") + " AS text FROM documents")
def f9_punctuate(fx):
    return fx.table("documents").select("doc_id", T.punctuate(F.col("text")).alias("text"))


_STRAY = "CASE WHEN turn_ix % 3 = 0 THEN text_zh || ' 沒有任何樓盤符合您的搜尋結果.。。 。' WHEN turn_ix % 3 = 1 THEN '，沒有任何樓盤符合您的搜尋 - ' || text_zh ELSE text_zh END"
_SCRUB = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({0}, E' \n\t\r'), '沒有任何樓盤符合您的搜尋結果\.?', '', 'g'), '沒有任何樓盤符合您的搜尋\s*[-—–-]?\s*', '', 'g'), '沒有任何樓盤符合您的搜尋\.?', '', 'g'), '[ \t]{{2,}}', ' ', 'g'), '^[。，、；：\s]+', ''), '[。]{{2,}}', '。', 'g'), '\s+([。，、])', '\1', 'g'), E' \n\t\r')"""


def _stray(fx) -> DataFrame:
    z = F.when(F.col("turn_ix") % 3 == 0, F.concat("text_zh", F.lit(" 沒有任何樓盤符合您的搜尋結果.。。 。"))).when(F.col("turn_ix") % 3 == 1, F.concat(F.lit("，沒有任何樓盤符合您的搜尋 - "), "text_zh")).otherwise(F.col("text_zh"))
    answer = F.when(F.col("turn_ix") % 4 == 1, F.lit("Yeah, thank you.")).otherwise(F.col("text"))
    return fx.turns().withColumn("text_zh", z).withColumn("text", answer)


@query("SELECT rec_id, turn_ix, " + _SCRUB.format(_STRAY) + " AS text_zh FROM fx_turns")
def f10_scrub_zh(fx):
    return _stray(fx).select("rec_id", "turn_ix", T.scrub_zh(F.col("text_zh")).alias("text_zh"))


@query("SELECT rec_id, turn_ix, contains(z, '樓盤') OR contains(z, '搜尋結果') AS contaminated FROM (SELECT *, " + _STRAY + " AS z FROM fx_turns)")
def p6_contaminated(fx):
    return _stray(fx).select("rec_id", "turn_ix", T.is_contaminated(F.col("text_zh")).alias("contaminated"))


_ANSWERS = "CASE word_ix % 6 WHEN 0 THEN 'Yeah 42' WHEN 1 THEN 'Thank you. No' WHEN 2 THEN 'you' WHEN 3 THEN 'Mm-hmm, ' || word WHEN 4 THEN 'OK right, thanks you' ELSE word END"
_SHORT = ", ".join(f"('{k}', '{v}')" for k, v in T.SHORT_ANSWERS.items())


@query(f""" gl AS (SELECT * FROM (VALUES {_SHORT}) g(w, v)), tx AS (SELECT rec_id, word_ix, regexp_extract_all({_ANSWERS}, '[A-Za-z]+(?:-[A-Za-z]+)?') AS t FROM fx_words),
tk AS (SELECT rec_id, word_ix, lower(unnest(t)) AS w, generate_subscripts(t, 1) AS pos FROM tx), tv AS (SELECT tk.*, gl.v, last_value(gl.v IGNORE NULLS) OVER (PARTITION BY rec_id, word_ix ORDER BY pos) AS said FROM tk LEFT JOIN gl ON tk.w = gl.w),
ag AS (SELECT rec_id, word_ix, bool_and(v IS NOT NULL OR (w = 'you' AND coalesce(said, '') = '謝謝。')) AS ok, string_agg(v, '' ORDER BY pos) AS zh FROM tv GROUP BY ALL)
SELECT-> tx.rec_id, tx.word_ix, CASE WHEN ag.ok AND ag.zh <> '' THEN ag.zh END AS zh FROM tx LEFT JOIN ag ON tx.rec_id = ag.rec_id AND tx.word_ix = ag.word_ix""")
def f11_glossary(fx):
    ix = F.col("word_ix") % 6
    t = F.when(ix == 0, "Yeah 42").when(ix == 1, "Thank you. No").when(ix == 2, "you").when(ix == 3, F.concat(F.lit("Mm-hmm, "), "word")).when(ix == 4, "OK right, thanks you").otherwise(F.col("word"))
    return fx.words().select("rec_id", "word_ix", T.glossary(t).alias("zh"))


@query(r""" sn AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS six FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents)),
cu AS (WITH RECURSIVE c AS (SELECT doc_id, six, 0 AS k, '' AS piece, trim(s, E' \n\t\r') AS rest FROM sn
  UNION ALL SELECT doc_id, six, k + 1, trim(left(rest, n), E' \n\t\r'), substr(rest, n + 1) FROM (SELECT *, CAST(CASE WHEN length(rest) <= 350 THEN length(rest) WHEN contains(left(rest, 350)[2:], ' ') THEN 350 - instr(reverse(left(rest, 350)), ' ') ELSE 350 END AS INTEGER) AS n FROM c WHERE rest <> ''))
  SELECT * FROM c WHERE piece <> '')
SELECT-> doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY six, k) - 1 AS INTEGER) AS piece_ix, piece FROM cu""")
def f12_translation_pieces(fx):
    return fx.table("documents").select("doc_id", F.posexplode(T.translation_pieces(F.col("text"))).alias("piece_ix", "piece"))


@query(r"""SELECT rec_id, word_ix, CASE WHEN regexp_matches(w, '^[a-z]+(''[a-z]+)?(-[a-z]+)*$') THEN w END AS lemma FROM (SELECT rec_id, word_ix, trim(replace(lower(regexp_replace(word, '^[^A-Za-z'']+|[^A-Za-z'']+$', '', 'g')), '’', ''''), '''') AS w FROM fx_words)""")
def f13_normalize_query(fx):
    return fx.words().select("rec_id", "word_ix", T.normalize_query(F.col("word")).alias("lemma"))


@query(" lq AS (SELECT word AS query FROM fx_dict)," + _VARIANTS + """, fs AS (SELECT query, key, min(ix) AS ix FROM vr GROUP BY ALL)
SELECT-> query AS word, CAST(row_number() OVER (PARTITION BY query ORDER BY ix) - 1 AS INTEGER) AS variant_ix, key AS variant FROM fs""")
def f14_lemma_variants(fx):
    return fx.dictionary().select("word", F.posexplode(T.lemma_variants(F.col("word"))).alias("variant_ix", "variant"))


@query(r"SELECT doc_id, len(l) AS n, array_to_string(l, '|') AS lines FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(replace(text, 'e ', '\n') || '\n' || chr(13) || chr(10) || lang, '\n', chr(10)), '[\r\n]+'), lambda x: trim(x, E' \t')), lambda x: x <> '') AS l FROM documents)")
def f15_dict_lines(fx):
    raw = F.concat(F.replace("text", F.lit("e "), F.lit("\\n")), F.lit("\\n\r\n"), "lang")
    return fx.table("documents").select("doc_id", T.dict_lines(raw).alias("l")).select("doc_id", F.size("l").cast("long").alias("n"), F.array_join("l", "|").alias("lines"))


_LINES = "['n. ' || word, 'vt. ' || word || ' 1', '一 ' || word, 'adj ' || word || ' 2', '', 'v.' || word, 'n.  ' || word || ' 3', 'n. ' || word || ' 4', 'n. ' || word || ' 5']"


@query(f""" dl AS (SELECT word, phonetic, CASE WHEN length(word) % 3 = 0 THEN {_LINES} WHEN translation = '' THEN [] ELSE ['n. ' || word] END AS l FROM fx_dict), dn AS (SELECT word, phonetic, unnest(list_filter(l, lambda x: x <> '')) AS line, generate_subscripts(list_filter(l, lambda x: x <> ''), 1) AS ix FROM dl)
SELECT-> word AS lemma, phonetic, CAST(ix - 1 AS INTEGER) AS sense_ix, CASE WHEN regexp_matches(line, '^[A-Za-z]{{1,5}}\\.?\\s+\\S') THEN regexp_extract(line, '^([A-Za-z]{{1,5}})', 1) ELSE 'n' END AS pos,
  CASE WHEN regexp_matches(line, '^[A-Za-z]{{1,5}}\\.?\\s+\\S') THEN regexp_replace(line, '^[A-Za-z]{{1,5}}\\.?\\s+', '') ELSE line END AS zh, CASE WHEN ix = 1 THEN 'the ' || word ELSE '' END AS en FROM dn WHERE ix <= 6""")
def f16_parse_dict_row(fx):
    w = F.col("word")
    many = F.concat_ws("\\n", F.concat(F.lit("n. "), w), F.concat(F.lit("vt. "), w, F.lit(" 1")), F.concat(F.lit("一 "), w), F.concat(F.lit("adj "), w, F.lit(" 2")), F.lit(" "), F.concat(F.lit("v."), w), *[F.concat(F.lit("n.  " if i == 3 else "n. "), w, F.lit(f" {i}")) for i in (3, 4, 5)])
    d = fx.dictionary().withColumn("translation", F.when(F.length("word") % 3 == 0, many).otherwise(F.col("translation")))
    e = d.select(T.parse_dict_row(*[F.col(c) for c in ("word", "phonetic", "definition", "translation", "pos")]).alias("e")).where("e is not null")
    return e.select("e.lemma", "e.phonetic", F.posexplode("e.senses").alias("sense_ix", "s")).select("lemma", "phonetic", "sense_ix", "s.pos", "s.zh", "s.en")


@query(""" fb AS (SELECT word FROM fx_dict WHERE length(word) % 3 <> 0), sn AS (SELECT word, unnest(['noun', 'verb', 'verb', 'noun', 'noun', 'noun']) AS pos, unnest(['a ' || word, 'to ' || word, 'to ' || word || ' it', 'one ' || word, 'two ' || word, 'three ' || word]) AS en, unnest(['as in ' || word, '', '', '', '', '']) AS example, unnest(range(0, 6)) AS ix FROM fb)
SELECT-> word AS lemma, CASE WHEN length(word) % 2 = 0 THEN '/' || word ELSE '[' || word || ']' END AS phonetic, 'free-dictionary' AS source, CAST(ix AS INTEGER) AS sense_ix, pos, '' AS zh, en, example FROM sn""")
def f17_fallback_entry(fx):
    e = fx.fallback().select(T.flatten_fallback_entry(F.col("lemma"), F.col("payload")).alias("e"))
    return e.select("e.lemma", "e.phonetic", "e.source", F.posexplode("e.senses").alias("sense_ix", "s")).select("lemma", "phonetic", "source", "sense_ix", "s.pos", "s.zh", "s.en", "s.example")


_ENTRY = "CASE word_ix % 4 WHEN 0 THEN word WHEN 1 THEN 'given ' || word WHEN 2 THEN NULL ELSE word END"


@query(f"SELECT rec_id, word_ix, {_ENTRY} AS lemma, CASE WHEN word_ix % 4 = 1 THEN '/p/' WHEN word_ix % 4 = 2 THEN NULL ELSE '' END AS phonetic, CASE WHEN word_ix % 4 = 1 THEN 1 WHEN word_ix % 4 = 2 THEN NULL ELSE 0 END AS n_senses, CASE WHEN word_ix % 4 = 2 THEN NULL WHEN word_ix % 4 = 1 THEN 's' ELSE '' END AS source FROM fx_words")
def f18_lemma_entry(fx):
    ix = F.col("word_ix") % 4
    sense = F.array(F.struct(F.lit("n").alias("pos"), F.lit("z").alias("zh"), F.lit("").alias("en"), F.lit("").alias("example")))
    entry = F.when(ix == 1, F.struct(F.concat(F.lit(" given "), "word").alias("lemma"), F.lit(" /p/ ").alias("phonetic"), sense.alias("senses"), F.lit("s ").alias("source"))).when(ix == 3, F.struct(F.lit("").alias("lemma"), F.lit(None).cast("string").alias("phonetic"), F.lit(None).cast(T.SENSES).alias("senses"), F.lit(None).cast("string").alias("source")))
    word = F.when(ix == 2, " ").otherwise(F.concat(F.lit(" "), "word"))
    return fx.words().select("rec_id", "word_ix", T.lemma_entry(entry.cast(T.LEMMA_ENTRY), word).alias("e")).select("rec_id", "word_ix", "e.lemma", "e.phonetic", F.when(F.col("e").isNotNull(), F.size("e.senses")).alias("n_senses"), "e.source")


@query("""SELECT word, CASE WHEN length(word) % 2 = 0 THEN upper(word) || ';b' ELSE word || ';b;c' END AS merged, CASE WHEN length(word) % 2 = 0 THEN upper(word) ELSE word || ';c' END AS removed, CASE WHEN length(word) % 2 = 0 THEN 'b' ELSE 'b;c' END AS other FROM fx_dict""")
def f20_merge_remove_lemma(fx):
    entry = lambda c: F.struct(c.alias("lemma"), F.lit("").alias("phonetic"), F.array().cast(T.SENSES).alias("senses"), F.lit("").alias("source")).cast(T.LEMMA_ENTRY)
    names = lambda c: F.array_join(F.transform(c, lambda e: e["lemma"]), ";")
    merged = T.merge_lemma(F.array(entry(F.col("word")), entry(F.lit("b"))), entry(F.when(F.length("word") % 2 == 0, F.upper("word")).otherwise("c")))
    return fx.dictionary().select("word", merged.alias("m")).select("word", names(F.col("m")).alias("merged"), names(T.remove_lemma(F.col("m"), F.lit(" B "))).alias("removed"), names(T.remove_lemma(T.remove_lemma(F.col("m"), F.col("word")), F.lit("absent"))).alias("other"))


@query("""SELECT job_id, seq, CASE WHEN d <= 0 THEN 0 ELSE greatest(0, least(100, CAST(floor(100 * e / nullif(d, 0)) AS INTEGER))) END AS pct FROM (SELECT job_id, seq, CAST(pct AS DOUBLE) AS e, CAST(seq % 50 AS DOUBLE) AS d FROM fx_log)""")
def f21_progress_pct(fx):
    return fx.log().select("job_id", "seq", T.progress_pct(F.col("pct").cast("double"), (F.col("seq") % 50).cast("double")).alias("pct"))


@query("SELECT rec_id, word_ix, try_cast(CASE WHEN word_ix % 3 = 0 THEN '' WHEN word_ix % 3 = 1 THEN CAST(word_ix AS VARCHAR) || '.5' ELSE word END AS DOUBLE) AS t FROM fx_words")
def f22_coerce_time(fx):
    x = F.when(F.col("word_ix") % 3 == 0, "").when(F.col("word_ix") % 3 == 1, F.concat(F.col("word_ix").cast("string"), F.lit(".5"))).otherwise(F.col("word"))
    return fx.words().select("rec_id", "word_ix", T.coerce_time(x).alias("t"))


@query("SELECT doc_id, lower(lang) IN ('en', 'english') AS accepted, CASE WHEN lower(lang) NOT IN ('en', 'english') THEN lower(lang) END AS detected FROM documents")
def p1_language_gate(fx):
    return E.language_gate(fx.table("documents").withColumnRenamed("lang", "language")).select("doc_id", "accepted", "detected")


@query('SELECT rec_id, count(*) AS n FROM fx_words WHERE "start" < 45 GROUP BY rec_id')
def p2_probe_prefix(fx):
    return W.probe_prefix(fx.words()).groupBy("rec_id").agg(F.count("*").alias("n"))


_SUFFIX = "CASE p_partkey % 12 WHEN 0 THEN '.wav' WHEN 1 THEN '.M4A' WHEN 2 THEN '.mp3' WHEN 3 THEN '.aac' WHEN 4 THEN '.flac' WHEN 5 THEN '.ogg' WHEN 6 THEN '.caf' WHEN 7 THEN '.aiff' WHEN 8 THEN '.Aif' WHEN 9 THEN '.txt' WHEN 10 THEN '.wav.json' ELSE '' END"


@query(f"SELECT p_partkey, 'rec' || p_partkey || {_SUFFIX} AS name, p_partkey % 12 < 9 AS supported FROM part")
def p4_supported_suffix(fx):
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".wav", ".M4A", ".mp3", ".aac", ".flac", ".ogg", ".caf", ".aiff", ".Aif", ".txt", ".wav.json", "")]), (F.col("p_partkey") % 12 + 1).cast("int"))
    return fx.table("part").select("p_partkey", F.concat(F.lit("rec"), F.col("p_partkey").cast("string"), suffix).alias("name")).withColumn("supported", T.supported_suffix(F.col("name")))


@query("""SELECT e.edit_id, w.rec_id, w.word_ix FROM fx_words w JOIN fx_edits e ON w.rec_id = e.rec_id WHERE (w."start" + w."end") / 2 BETWEEN e."start" AND e."end" """)
def p5_words_in_range(fx):
    return E.words_in_range(fx.words(), fx.edits()).select("edit_id", "rec_id", "word_ix")


@query(""" ed AS (SELECT rec_id, CASE rec_id % 5 WHEN 1 THEN NULL WHEN 4 THEN 5000.0::DOUBLE ELSE 4.0::DOUBLE END AS s, CASE rec_id % 5 WHEN 2 THEN 2.0::DOUBLE WHEN 3 THEN 400.0::DOUBLE WHEN 4 THEN 5010.0::DOUBLE ELSE 20.0::DOUBLE END AS e, CASE WHEN rec_id % 2 = 0 THEN 1.5::DOUBLE ELSE 0.0::DOUBLE END AS pad FROM (SELECT DISTINCT rec_id FROM fx_turns)),
dr AS (SELECT rec_id, max("end") + 30 AS duration FROM fx_turns GROUP BY rec_id)
SELECT-> ed.rec_id, CASE rec_id % 5 WHEN 1 THEN 'not a number' WHEN 2 THEN 'empty range' WHEN 3 THEN 'too long' WHEN 4 THEN 'empty clip' END AS reason, CASE WHEN s IS NULL THEN 0.0 ELSE greatest(0.0, s - pad) END AS clip_start, least(duration, e + pad) AS clip_end FROM ed JOIN dr USING (rec_id)""")
def p7_validate_edits(fx):
    durations = fx.turns().groupBy("rec_id").agg((F.max("end") + 30).alias("duration"))
    kind = F.col("rec_id") % 5
    edits = fx.turns().select("rec_id").distinct().select(
        "rec_id", F.when(kind == 1, "soon").when(kind == 4, "5000").otherwise("4").alias("start"), F.when(kind == 2, "2").when(kind == 3, "400").when(kind == 4, "5010").otherwise("20.0").alias("end"), F.when(F.col("rec_id") % 2 == 0, "1.5").otherwise("-3").alias("padding")
    )
    return E.validate_edits(edits, durations).select("rec_id", "reason", "clip_start", "clip_end")


@query('SELECT rec_id, word_ix, "start" + 12.5::DOUBLE AS "start", "end" + 12.5::DOUBLE AS "end" FROM fx_words')
def p9_shift_times(fx):
    return E.shift_times(fx.words(), 12.5).select("rec_id", "word_ix", "start", "end")


# ------------------------------------------------------------------- edits and exports


def _fresh(fx) -> DataFrame:
    return fx.turns().where("turn_ix = 1").withColumns({"start": F.col("start") + 0.5, "end": F.col("end") - 0.5, "text": F.lit("new.")})


@query(""" nw AS (SELECT rec_id, turn_ix, "start" + 0.5::DOUBLE AS "start", "end" - 0.5::DOUBLE AS "end", 'new.' AS text, 1 AS is_new FROM fx_turns WHERE turn_ix = 1),
al AS (SELECT rec_id, turn_ix, "start", "end", text, 0 AS is_new FROM fx_turns t WHERE NOT EXISTS (SELECT 1 FROM fx_edits e WHERE e.rec_id = t.rec_id AND least(t."end", e."end") - greatest(t."start", e."start") > 0) UNION ALL SELECT * FROM nw)
SELECT-> rec_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY "start", "end", is_new, turn_ix) - 1 AS INTEGER) AS turn_ix, "start", "end", text FROM al""")
def u1_splice_turns(fx):
    return E.splice_turns(fx.turns(), _fresh(fx), fx.edits()).select("rec_id", "turn_ix", "start", "end", "text")


_U2 = """ ed AS (SELECT 'a' || rec_id AS edit_id, rec_id, 4.0::DOUBLE AS s, 8.0::DOUBLE AS e FROM (SELECT DISTINCT rec_id FROM fx_turns) UNION ALL SELECT 'b' || rec_id, rec_id, 8.0::DOUBLE, 12.0::DOUBLE FROM (SELECT DISTINCT rec_id FROM fx_turns)),
kw AS (SELECT edit_id, w.rec_id, w.word_ix, w.word, w."start", w."end" FROM fx_words w JOIN ed ON w.rec_id = ed.rec_id AND (w."start" + w."end") / 2 >= s AND ((w."start" + w."end") / 2 < e OR (e = 12 AND (w."start" + w."end") / 2 = e))),
pr AS (SELECT k.*, g.speaker, row_number() OVER (PARTITION BY k.rec_id, k.word_ix ORDER BY greatest(0, least(k."end", g."end") - greatest(k."start", g."start")) DESC, CASE WHEN least(k."end", g."end") - greatest(k."start", g."start") > 0 THEN 0 ELSE abs((k."start" + k."end") / 2 - (g."start" + g."end") / 2) END, g.turn_ix) AS r FROM kw k JOIN fx_turns g ON k.rec_id = g.rec_id),
fl AS (SELECT *, CASE WHEN lag(speaker) OVER w <> speaker OR "start" - lag("end") OVER w > 0.8 THEN 1 ELSE 0 END AS fresh FROM pr WHERE r = 1 WINDOW w AS (PARTITION BY edit_id ORDER BY "start", "end", word_ix)),
tn AS (SELECT *, sum(fresh) OVER (PARTITION BY edit_id ORDER BY "start", "end", word_ix) AS t, regexp_matches(word, '[.!?。！？]["''”’)\\]]*$') AS closes FROM fl),
sx AS (SELECT *, coalesce(sum(CAST(closes AS INTEGER)) OVER (PARTITION BY edit_id, t ORDER BY "start", "end", word_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM tn),
ch AS (SELECT *, CASE WHEN max(sentence) OVER (PARTITION BY edit_id, t) < 3 THEN 0 ELSE sentence // 3 END AS part, max(sentence) OVER (PARTITION BY edit_id, t) < 3 AS whole FROM sx),
nt AS (SELECT edit_id, any_value(rec_id) AS rec_id, t, part, any_value(speaker) AS speaker, arg_min("start", word_ix) AS "start", arg_max("end", word_ix) AS "end", any_value(whole) AS whole,
       regexp_replace(string_agg(CASE WHEN regexp_matches(word, '^[,.;:!?]') THEN word ELSE ' ' || word END, '' ORDER BY word_ix), '^ +', '') AS text, string_agg(word || '@' || "start" || '-' || "end", ' ' ORDER BY word_ix) AS words FROM ch GROUP BY edit_id, t, part)"""


def _spoken(fx) -> DataFrame:
    """The turns with words: the first word of the text, for the whole turn."""
    first = F.struct(F.element_at(F.split("text", "[ \n\t]+"), 1).alias("word"), "start", "end", F.lit(1.0).alias("probability"), "speaker")
    return fx.turns().withColumn("words", F.array(first)).withColumn("reviewed", F.col("turn_ix") % 2 == 0)


def _told(words) -> object:
    return F.array_join(F.transform(words, lambda w: F.concat(w["word"], F.lit("@"), w["start"].cast("string"), F.lit("-"), w["end"].cast("string"))), " ")


_FIRST_WORD = "string_split_regex(text, '[ \\n\\t]+')[1] || '@' || \"start\" || '-' || \"end\""


def _touching(fx) -> tuple[DataFrame, DataFrame]:
    """Two touching edits with padding for each recording, and the words of their clips in clip time."""
    r = fx.turns().select("rec_id").distinct()
    edit = lambda name, s: r.select(F.concat(F.lit(name), F.col("rec_id").cast("string")).alias("edit_id"), "rec_id", F.lit(s).alias("start"), F.lit(s + 4.0).alias("end"), F.lit(1.5).alias("padding"))
    edits = edit("a", 4.0).unionAll(edit("b", 8.0))
    e = edits.select("edit_id", "rec_id", (F.col("start") - 1.5).alias("offset"), (F.col("end") + 1.5).alias("until"))
    w = fx.words().join(e, "rec_id").where("end > offset and start < until")
    return edits, w.select("edit_id", "rec_id", "word_ix", "word", (F.col("start") - F.col("offset")).alias("start"), (F.col("end") - F.col("offset")).alias("end"), "offset")


@query((_U2 + """,
al AS (SELECT rec_id, speaker, "start", "end", CASE WHEN whole THEN PUNCT ELSE text END AS text, 1 AS is_new, edit_id || printf('%09d', CAST(t * 1000 + part AS INTEGER)) AS o, words, NULL AS reviewed FROM nt
  UNION ALL SELECT rec_id, speaker, "start", "end", text, 0, printf('%09d', turn_ix), FIRST, turn_ix % 2 = 0 FROM fx_turns t WHERE NOT EXISTS (SELECT 1 FROM ed JOIN nt ON ed.edit_id = nt.edit_id WHERE ed.rec_id = t.rec_id AND least(t."end", ed.e) - greatest(t."start", ed.s) > 0))
SELECT-> rec_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY "start", "end", is_new, o) - 1 AS INTEGER) AS turn_ix, speaker, "start", "end", text, words, reviewed FROM al""").replace("PUNCT", _PUNCT.format("text")).replace("FIRST", _FIRST_WORD))
def u2_apply_range_edits(fx):
    edits, clips = _touching(fx)
    return E.apply_range_edits(_spoken(fx), clips, edits)[0].select("rec_id", "turn_ix", "speaker", "start", "end", "text", _told(F.col("words")).alias("words"), "reviewed")


@query(_U2 + """, bad AS (SELECT 'c' || rec_id AS edit_id, rec_id, CASE WHEN rec_id % 2 = 0 THEN 'overlaps another edit' ELSE 'empty range' END AS reason FROM (SELECT DISTINCT rec_id FROM fx_turns)),
al AS (SELECT ed.edit_id, ed.rec_id, (SELECT count(*) FROM nt WHERE nt.edit_id = ed.edit_id) AS new_turns, (SELECT count(*) FROM kw WHERE kw.edit_id = ed.edit_id) AS kept_words, (SELECT count(*) FROM fx_turns t WHERE t.rec_id = ed.rec_id AND least(t."end", ed.e) - greatest(t."start", ed.s) > 0) AS hit FROM ed)
SELECT-> edit_id, rec_id, CASE WHEN kept_words = 0 THEN 'no words' END AS reason, CASE WHEN kept_words = 0 THEN 0 ELSE hit END AS replaced_turns, new_turns, kept_words, CASE WHEN kept_words = 0 THEN 'rejected' ELSE 'applied' END AS status FROM al
UNION ALL SELECT edit_id, rec_id, reason, 0, 0, 0, 'rejected' FROM bad""")
def u2_a6_edit_report(fx):
    edits, clips = _touching(fx)
    bad = edits.where(F.col("start") == 8).select(F.concat(F.lit("c"), F.col("rec_id").cast("string")).alias("edit_id"), "rec_id", F.when(F.col("rec_id") % 2 == 0, 10.0).otherwise(20.0).alias("start"), F.when(F.col("rec_id") % 2 == 0, 14.0).otherwise(20.0).alias("end"), "padding")
    return E.apply_range_edits(fx.turns(), clips, edits.unionAll(bad))[1]


@query("""SELECT rec_id, CAST(turn_ix AS INTEGER) AS turn_ix, text, NULL AS error FROM fx_turns WHERE rec_id % 3 = 0 UNION ALL SELECT DISTINCT rec_id, NULL, NULL, 'nothing to restore' FROM fx_turns WHERE rec_id % 3 <> 0""")
def u3_restore_version(fx):
    turns = fx.turns().groupBy("rec_id").agg(F.collect_list(F.struct("turn_ix", "text")).alias("turns"))
    # the version before the current one; an older one, one that has no turns, and one above are not taken
    version = lambda keep, n, v: turns.where(keep).withColumn("turns", F.slice("turns", 1, n)).withColumn("version", F.lit(v))
    versions = version("rec_id % 3 = 0", 1, 1).unionAll(version("rec_id % 3 = 0", 100_000, 2)).unionAll(version("rec_id % 3 = 1", 0, 2)).unionAll(version("true", 1, 3)).unionAll(version("true", 1, 4))
    out = E.restore_version(versions, turns.select("rec_id", F.lit(3).alias("current")))
    return out.select("rec_id", "error", F.explode_outer("turns").alias("t")).select("rec_id", "t.turn_ix", "t.text", "error")


@query("""SELECT e.edit_id, e.rec_id, (SELECT count(*) FROM fx_turns t WHERE t.rec_id = e.rec_id AND least(t."end", e."end") - greatest(t."start", e."start") > 0) AS replaced_turns,
 (SELECT count(*) FROM fx_turns t WHERE t.turn_ix = 1 AND t.rec_id = e.rec_id AND least(t."end" - 0.5, e."end") - greatest(t."start" + 0.5, e."start") > 0) AS new_turns,
 (SELECT count(*) FROM fx_words w WHERE w.rec_id = e.rec_id AND (w."start" + w."end") / 2 BETWEEN e."start" AND e."end") AS kept_words,
 CASE WHEN EXISTS (SELECT 1 FROM fx_words w WHERE w.rec_id = e.rec_id AND (w."start" + w."end") / 2 BETWEEN e."start" AND e."end") THEN 'applied' ELSE 'rejected' END AS status FROM fx_edits e""")
def a6_edit_report(fx):
    return E.edit_report(fx.turns(), _fresh(fx), E.words_in_range(fx.words(), fx.edits()), fx.edits())


_RESCRUBBED = " rz AS (SELECT rec_id, turn_ix, text, " + _STRAY + " AS z FROM fx_turns), rs AS (SELECT *, turn_ix % 4 = 1 AS known, CASE WHEN turn_ix % 4 = 1 THEN '嗯。謝謝。' ELSE " + _SCRUB.format("z") + r" END AS n, contains(z, '樓盤') OR contains(z, '搜尋結果') AS stray, trim(text, E' \n\t\r') <> '' AS spoken FROM rz)"


@query(_RESCRUBBED + " SELECT-> rec_id, turn_ix, n AS text_zh, n <> z AS changed, NOT known AND stray AND spoken AS to_translate FROM rs")
def u7_rescrub(fx):
    return E.rescrub(_stray(fx)).select("rec_id", "turn_ix", "text_zh", "changed", "to_translate")


@query(_RESCRUBBED + """ SELECT-> rec_id, count(*) FILTER (WHERE stray OR known) AS candidates, count(*) FILTER (WHERE CASE WHEN turn_ix % 5 = 0 THEN z ELSE n END <> z) AS changed, count(*) FILTER (WHERE contains(CASE WHEN turn_ix % 5 = 0 THEN z ELSE n END, '樓盤')) AS remaining FROM rs GROUP BY rec_id""")
def a5_scrub_report(fx):
    before = _stray(fx)
    after = E.rescrub(before).join(before.select("rec_id", "turn_ix", F.col("text_zh").alias("old")), ["rec_id", "turn_ix"])
    # some turns are left as they were, so that something remains
    return E.scrub_report(before, after.withColumn("text_zh", F.when(F.col("turn_ix") % 5 == 0, F.col("old")).otherwise(F.col("text_zh"))))


_CUE = """CAST(row_number() OVER (PARTITION BY rec_id ORDER BY turn_ix) AS VARCHAR)"""
_TS = """replace(printf('%02d:%02d.%03d', CAST({0} AS INTEGER) // 60, CAST({0} AS INTEGER) % 60, 0), '.', '{1}')"""
_READY = " rd AS (SELECT rec_id, turn_ix, speaker, " + _TS.format('"start"', "{0}") + " AS a, " + _TS.format('"end"', "{0}") + " AS b, " + _PUNCT.format("text").replace("{", "{{").replace("}", "}}") + r""" AS text, trim(text_zh, E' \n\t\r') AS zh FROM fx_turns)"""


@query(_READY.format(",").replace("{{", "{").replace("}}", "}") + f" SELECT-> rec_id, turn_ix, {_CUE} || E'\\n' || a || ' --> ' || b || E'\\n' || speaker || ': ' || text || CASE WHEN zh <> '' THEN E'\\n' || zh ELSE '' END || E'\\n' AS cue FROM rd")
def k2_srt_cues(fx):
    return R.srt_cues(fx.turns())


@query(_READY.format(".").replace("{{", "{").replace("}}", "}") + r""" SELECT-> rec_id, regexp_replace(string_agg('[' || a || ' → ' || b || '] ' || speaker || E'\n' || text || E'\n' || CASE WHEN zh <> '' THEN zh || E'\n' ELSE '' END, E'\n' ORDER BY turn_ix), '\s+$', '') || E'\n' AS content FROM rd GROUP BY rec_id""")
def k3_txt(fx):
    return R.render_txt(fx.turns())


@query(_READY.format(".").replace("{{", "{").replace("}}", "}") + r""" SELECT-> rec_id, regexp_replace('# Transcript: ' || rec_id || E'\n\n- Language: en\n- Speakers: ' || count(DISTINCT speaker) || E'\n- Segments: ' || count(*) || E'\n- Bilingual: English + 中文翻譯\n\n---\n\n' || string_agg('### [' || a || ' → ' || b || '] ' || speaker || E'\n\n' || text || E'\n\n' || CASE WHEN zh <> '' THEN zh || E'\n\n' ELSE '' END, '' ORDER BY turn_ix), '\s+$', '') || E'\n' AS content FROM rd GROUP BY rec_id""")
def k4_markdown(fx):
    return R.render_markdown(fx.turns(), fx.turns().select("rec_id", F.lit("en").alias("language")).distinct())


@query(" pd AS (SELECT rec_id, " + _FIRST_WORD + ' AS "first", turn_ix, speaker, "start", "end", ' + _PUNCT.format("text") + r""" AS text, trim(text_zh, E' \n\t\r') AS text_zh FROM fx_turns), dt AS (SELECT rec_id, trim(string_agg(trim(text, E' \n\t\r'), ' ' ORDER BY turn_ix), E' \n\t\r') AS doc_text FROM pd GROUP BY rec_id)
SELECT-> pd.rec_id, 'en' AS language, TRUE AS bilingual, doc_text, turn_ix, speaker, "start", "end", text, text_zh, CASE WHEN turn_ix % 3 = 2 THEN '' ELSE "first" END AS words FROM pd JOIN dt ON pd.rec_id = dt.rec_id""")
def k1_transcript_docs(fx):
    turns = _spoken(fx).withColumn("words", F.when(F.col("turn_ix") % 3 != 2, F.col("words")))
    d = R.to_transcript_docs(turns, fx.turns().select("rec_id", F.lit("en").alias("language")).distinct())
    return d.select("rec_id", "language", "bilingual", F.col("text").alias("doc_text"), F.explode("turns").alias("t")).select("rec_id", "language", "bilingual", "doc_text", "t.*").withColumn("words", _told(F.col("words")))


def _notes(fx) -> DataFrame:
    t = fx.turns().where("speaker = 'user'")
    first = F.transform(F.slice(F.split("text", "[ \n\t]+"), 1, 2), lambda w: F.struct(w.alias("lemma"), F.lit("").alias("phonetic"), F.array(F.struct(F.lit("n").alias("pos"), F.lit("").alias("zh"), w.alias("en"), F.lit("").alias("example"))).alias("senses"), F.lit("x").alias("source")))
    return t.select("rec_id", F.concat(F.col("rec_id").cast("string"), F.lit("-"), F.col("turn_ix").cast("string")).alias("id"), F.lit("w").alias("word"), F.col("text").alias("text_en"), F.lit("").alias("text_zh"), F.when(F.col("turn_ix") == 2, None).otherwise(F.col("start")).alias("start"), F.lit(None).cast("double").alias("end"), F.lit("manual").alias("source"), (100.0 + F.col("turn_ix")).alias("created_at"), F.lit(None).cast("double").alias("updated_at"), first.alias("lemmas"), F.lit(None).cast(T.LEMMA_ENTRY).alias("dict"))


_NOTES = " nt AS (SELECT rec_id, rec_id || '-' || turn_ix AS id, turn_ix, text, CASE WHEN turn_ix <> 2 THEN \"start\" END AS \"start\", string_split_regex(text, '[ \\n\\t]+') AS w FROM fx_turns WHERE speaker = 'user')"


@query(_NOTES + ' SELECT-> rec_id, id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY "start" IS NULL, coalesce("start", 0), turn_ix) - 1 AS INTEGER) AS note_ix FROM nt')
def l3_note_order(fx):
    return E.note_order(_notes(fx)).select("rec_id", "id", "note_ix")


@query(_NOTES + r""", nl AS (SELECT *, list_filter(CASE WHEN lower(trim(w[1])) = lower(trim(coalesce(w[2], ''))) THEN [w[1]] ELSE [w[1], w[2]] END, lambda x: x IS NOT NULL AND x <> '') AS l FROM nt), ne AS (SELECT *, CASE WHEN len(l) > 0 THEN l ELSE ['w'] END AS lemmas, len(l) > 0 AS own FROM nl)
SELECT-> CAST(rec_id AS VARCHAR) AS stem, 'w' AS word, text AS text_en, '' AS text_zh, array_to_string(lemmas, '; ') AS dict_lemma, CASE WHEN own THEN array_to_string(lemmas, ' | ') ELSE '' END AS dict_gloss,
  coalesce(CAST("start" AS VARCHAR), '') AS "start", '' AS "end", 'manual' AS source, CAST(100.0::DOUBLE + turn_ix AS VARCHAR) AS created_at FROM ne""")
def k5_notes_csv(fx):
    return R.notes_csv(_notes(fx))


def _note_changes(fx) -> DataFrame:
    """For the first note of a recording two changes and one that fails, a new note with a word
    and a second change of it, a change of no note, and one without texts."""
    r = _notes(fx).groupBy("rec_id").agg(F.min(F.struct("created_at", "id")).alias("m")).select("rec_id", F.col("m.id").alias("first"))
    new = F.concat(F.lit("new-"), F.col("rec_id").cast("string"))

    def change(n, id_, en, start, remove="", word=""):
        own = new if n == 3 else F.concat(F.lit(f"c{n}-"), F.col("rec_id").cast("string"))
        return r.select(
            "rec_id", own.alias("change_id"), id_.alias("id"), F.lit(word).alias("word"), F.lit(en).alias("text_en"), F.lit("").alias("text_zh"), F.lit(start).alias("start"), F.lit("").alias("end"), F.lit("").alias("source"),
            F.lit(None).cast(T.LEMMA_ENTRY).alias("dict"), F.lit(False).alias("has_dict"), F.lit(remove).alias("remove_lemma"), F.lit(200.0 + n).alias("now"),
        )

    none = F.lit(None).cast("string")
    parts = [change(2, F.col("first"), "twice", "2.5", word="other"), change(1, F.col("first"), "once", "1.5"), change(4, F.col("first"), "never", "9", remove="no such word"), change(3, none, "added", "x", word="Apple"), change(5, new, "added again", "7"), change(6, F.lit("absent"), "lost", "1"), change(7, none, "  ", "1")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query(_NOTES + r""", nf AS (SELECT rec_id, arg_min(id, turn_ix) AS first FROM nt GROUP BY rec_id)
SELECT-> nt.rec_id, nt.id, CASE WHEN id = first THEN 'other' ELSE 'w' END AS word, CASE WHEN id = first THEN 'twice' ELSE text END AS text_en, CASE WHEN id = first THEN 2.5::DOUBLE ELSE "start" END AS "start", 'manual' AS source, 100.0::DOUBLE + turn_ix AS created_at, CASE WHEN id = first THEN 202.0::DOUBLE END AS updated_at FROM nt JOIN nf ON nt.rec_id = nf.rec_id
UNION ALL SELECT rec_id, 'new-' || rec_id, 'Apple', 'added again', 7.0::DOUBLE, 'manual', 203.0::DOUBLE, 205.0::DOUBLE FROM nf""")
def u4_upsert_notes(fx):
    return E.upsert_notes(_notes(fx), _note_changes(fx))[0].select("rec_id", "id", "word", "text_en", "start", "source", "created_at", "updated_at")


@query(_NOTES + """, nf AS (SELECT rec_id, arg_min(id, turn_ix) AS first FROM nt GROUP BY rec_id)
SELECT-> rec_id, first AS id, 'c4-' || rec_id AS change_id, 'no such lemma' AS error FROM nf UNION ALL SELECT rec_id, 'absent', 'c6-' || rec_id, 'unknown note' FROM nf UNION ALL SELECT rec_id, 'c7-' || rec_id, 'c7-' || rec_id, 'no text' FROM nf""")
def u4_failed_changes(fx):
    return E.upsert_notes(_notes(fx), _note_changes(fx))[1]


@query(_NOTES + " SELECT-> rec_id, id, 'left' AS what FROM nt WHERE turn_ix <> 0 UNION ALL SELECT DISTINCT rec_id, 'absent-' || rec_id, 'missed' FROM nt")
def u5_delete_notes(fx):
    n = _notes(fx)
    ids = n.where(F.col("id").endswith("-0")).select("rec_id", "id").unionAll(n.select("rec_id", F.concat(F.lit("absent-"), F.col("rec_id").cast("string"))).distinct())
    left, missed = E.delete_notes(n, ids)
    return left.select("rec_id", "id", F.lit("left").alias("what")).unionAll(missed.select("rec_id", "id", F.lit("missed")))


@query("""SELECT job_id, seq, line FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS r FROM fx_log) WHERE r <= 5""")
def l4_tail_per_key(fx):
    return E.tail_per_key(fx.log(), 5).select("job_id", "seq", "line")


@query("SELECT event_id AS inserted_seq FROM events ORDER BY event_id DESC LIMIT 2000")
def l5_trim_cache(fx):
    return E.trim_cache(fx.table("events").select(F.col("event_id").cast("string").alias("lemma"), F.col("event_id").alias("inserted_seq"))).select("inserted_seq")


@query(""" ca AS (SELECT 'u' || user_id AS lemma, min(event_id) AS s FROM events GROUP BY user_id) SELECT-> lemma, s AS inserted_seq, CASE WHEN s % 2 = 0 THEN 'new' ELSE 'old' END AS entry FROM ca ORDER BY s DESC, lemma LIMIT 2000""")
def u8_upsert_cache(fx):
    rows = fx.table("events").groupBy("user_id").agg(F.min("event_id").alias("inserted_seq")).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("lemma"), F.struct(F.lit("old").alias("v")).alias("entry"), "inserted_seq")
    found = rows.where("inserted_seq % 2 = 0").withColumn("entry", F.struct(F.lit("new").alias("v"))).withColumn("inserted_seq", F.col("inserted_seq") + 1_000_000_000)
    return E.upsert_cache(rows, found).select("lemma", "inserted_seq", F.col("entry.v").alias("entry"))


@query(""" pr AS (SELECT *, max(pct) OVER w AS m, max(pct // 5) OVER w AS f FROM fx_log WINDOW w AS (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT-> job_id, seq, (m IS NULL OR pct // 5 > f OR (pct >= 100 AND m < 100)) AS emit FROM pr""")
def w6_throttle_progress(fx):
    return E.throttle_progress(fx.log()).select("job_id", "seq", "emit")


@query("""SELECT job_id, max(seq) + 1 AS seq, CAST(100 AS INTEGER) AS pct FROM fx_log WHERE job_id % 3 <> 0 GROUP BY job_id HAVING max(CASE WHEN job_id % 2 = 0 THEN pct * 9 // 10 ELSE pct END) < 100""")
def w6_closing_ticks(fx):
    log = fx.log().withColumn("pct", F.when(F.col("job_id") % 2 == 0, F.floor(F.col("pct") * 9 / 10)).otherwise(F.col("pct")).cast("int"))
    jobs = log.select("job_id", F.when(F.col("job_id") % 3 == 0, 0.0).otherwise(60.0).alias("duration")).distinct()
    return E.closing_ticks(log, jobs)


# --------------------------------------------------------------------------- signals


@query(""" mo AS (SELECT series_id, i, avg(value) AS v FROM fx_series GROUP BY ALL), pk AS (SELECT series_id, max(abs(v)) AS p FROM mo GROUP BY series_id) SELECT-> mo.series_id, i, round(CASE WHEN p > 1 THEN v / p ELSE v END, 6) AS value FROM mo JOIN pk ON mo.series_id = pk.series_id""")
def m1_downmix(fx):
    return S.downmix_normalize(fx.series()).select("series_id", "i", _r6("value"))


#: Samples of a block in the queries: small, so that series have many.
_BLOCK = 4096


@query(""" st AS (SELECT *, CASE WHEN i % 3 = 0 THEN value * 2 ELSE value END AS v FROM fx_series UNION ALL SELECT *, -value FROM fx_series WHERE i % 3 = 0), mo AS (SELECT series_id, i, avg(v) AS v FROM st GROUP BY ALL), pk AS (SELECT series_id, max(abs(v)) AS p FROM mo GROUP BY series_id)
SELECT-> mo.series_id, i, round(CASE WHEN p > 1 THEN v / p ELSE v END, 6) AS value FROM mo JOIN pk ON mo.series_id = pk.series_id""")
def m1_downmix_blocks(fx):
    """A second channel that has every third sample."""
    x, third = fx.series(), F.col("i") % 3 == 0
    two = x.withColumn("channel", F.lit(0)).withColumn("value", F.when(third, F.col("value") * 2).otherwise(F.col("value"))).unionAll(x.where(third).withColumn("channel", F.lit(1)).withColumn("value", -F.col("value")))
    return K.to_samples(K.downmix_blocks(K.to_blocks(two, _BLOCK))).select("series_id", "i", _r6("value"))


_RESAMPLED = """ sz AS (SELECT series_id, max(i) + 1 AS n, greatest(1, CAST(round_even((max(i) + 1) * 3 / 2, 0) AS BIGINT)) AS m FROM fx_series GROUP BY series_id), gj AS (SELECT *, unnest(range(0, m)) AS j FROM sz),
ps AS (SELECT *, greatest(0.0, least(n - 1.0::DOUBLE, (j + 0.5::DOUBLE) * n / m - 0.5::DOUBLE)) AS pos FROM gj)
SELECT-> ps.series_id, j AS i, round(a.value * (1 - (pos - floor(pos))) + coalesce(b.value, a.value) * (pos - floor(pos)), 6) AS value FROM ps JOIN fx_series a ON a.series_id = ps.series_id AND a.i = CAST(floor(pos) AS BIGINT) LEFT JOIN fx_series b ON b.series_id = ps.series_id AND b.i = CAST(floor(pos) AS BIGINT) + 1"""


@query(_RESAMPLED)
def m2_resample(fx):
    return S.resample_linear(fx.series(), 2, 3).select("series_id", "i", _r6("value"))


@query(_RESAMPLED)
def m2_resample_blocks(fx):
    blocks = K.to_blocks(fx.series().withColumn("channel", F.lit(0)), _BLOCK).drop("channel")
    return K.to_samples(K.resample_blocks(blocks, 2, 3)).select("series_id", "i", _r6("value"))


@query("""SELECT vec_id, CAST(d - 1 AS INTEGER) AS d, round(v[d] / n, 6) AS x FROM (SELECT vec_id, embedding AS v, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS n, unnest(range(1, len(embedding) + 1)) AS d FROM embeddings)""")
def m3_l2_normalize(fx):
    v = S.l2_normalize(F.col("embedding").cast("array<double>"))
    return fx.table("embeddings").select("vec_id", F.posexplode(v).alias("d", "x")).select("vec_id", "d", _r6("x"))


_WINDOWS = """ sz AS (SELECT series_id, max(i) + 1 AS n FROM fx_series GROUP BY series_id), wn AS (SELECT *, unnest(range(0, (greatest(1, n - 30 + 1) - 1) // 15 + 1)) AS win_ix FROM sz)
SELECT-> wn.series_id, win_ix, count(*) AS n_samples, round(sqrt(avg(value * value)), 6) AS rms, (win_ix * 15 + least(n, win_ix * 15 + 30)) / 40 AS center
FROM wn JOIN fx_series s ON s.series_id = wn.series_id AND s.i >= win_ix * 15 AND s.i < least(n, win_ix * 15 + 30) GROUP BY wn.series_id, win_ix, n HAVING count(*) >= 8 AND sqrt(avg(value * value)) >= 0.01"""


@query(_WINDOWS)
def w7_hop_windows(fx):
    return S.hop_windows(fx.series(), rate=20.0).select("series_id", "win_ix", "n_samples", _r6("rms"), "center")


@query(_WINDOWS)
def w7_hop_window_blocks(fx):
    return K.hop_window_blocks(K.to_blocks(fx.series().withColumn("channel", F.lit(0)), _BLOCK), rate=20.0).select("series_id", "win_ix", "n_samples", _r6("rms"), "center")


@query(""" nv AS (SELECT vec_id % 5 AS rec_id, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM embeddings),
ds AS (SELECT a.rec_id, a.vec_id, a.label, b.label AS ob, sum(1 - list_dot_product(a.v, b.v)) AS t, count(*) AS n FROM nv a JOIN nv b ON a.rec_id = b.rec_id AND a.vec_id <> b.vec_id GROUP BY ALL),
ab AS (SELECT rec_id, vec_id, max(CASE WHEN label = ob THEN t / n END) AS a, min(CASE WHEN label <> ob THEN t / n END) AS b FROM ds GROUP BY ALL)
SELECT-> rec_id, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab GROUP BY rec_id""")
def a7_silhouette(fx):
    return S.silhouette_by_group(fx.windows().select("rec_id", "embedding", "label"), ["rec_id"]).select("rec_id", _r6("silhouette"))


@query(""" sc AS (SELECT p_brand AS rec_id, 5 AS n, 2 + CAST(p_partkey % 3 AS INTEGER) AS k, p_retailprice AS score FROM part), mx AS (SELECT rec_id, n, k, max(score) AS score FROM sc GROUP BY ALL)
SELECT-> rec_id, arg_max(k, score * 100 - k) AS k FROM mx GROUP BY rec_id""")
def m4_choose_k(fx):
    p = fx.table("part").select(F.col("p_brand").alias("rec_id"), F.lit(5).alias("n"), (2 + F.col("p_partkey") % 3).cast("int").alias("k"), F.col("p_retailprice").alias("score"))
    return S.choose_k(p.groupBy("rec_id", "n", "k").agg(F.max("score").alias("score")))


@query("SELECT p_partkey, greatest(1, least(CASE WHEN p_size % 5 < 2 AND p_partkey % 10 >= 4 THEN 2 ELSE p_size % 5 END, CAST(p_partkey % 10 AS INTEGER))) AS k FROM part")
def m5_k_floor(fx):
    return fx.table("part").select("p_partkey", S.k_floor(F.col("p_size") % 5, (F.col("p_partkey") % 10).cast("int"), 2).alias("k"))


@query(""" m6_v AS (SELECT CAST(vec_id // 10 AS BIGINT) AS rec, CAST(vec_id AS INTEGER) AS win, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM embeddings),
m6_d AS (SELECT a.rec, a.win AS a, b.win AS b, 1 - list_dot_product(a.v, b.v) AS d FROM m6_v a JOIN m6_v b ON a.rec = b.rec AND a.win <> b.win),
m6_s AS (WITH RECURSIVE st AS (SELECT rec, win, win AS cl, count(*) OVER (PARTITION BY rec) AS k FROM m6_v
  UNION ALL SELECT rec, win, CASE WHEN cl = drop_ THEN into_ ELSE cl END, k - 1 FROM (
    WITH cur AS (SELECT * FROM st WHERE k > 2),
    pr AS (SELECT x.rec, x.cl AS p, y.cl AS q, avg(m6_d.d) AS d FROM cur x JOIN m6_d ON x.rec = m6_d.rec AND x.win = m6_d.a JOIN cur y ON y.rec = x.rec AND y.win = m6_d.b WHERE x.cl < y.cl GROUP BY ALL),
    mn AS (SELECT rec, arg_min({'p': p, 'q': q}, d) AS m FROM pr GROUP BY rec)
    SELECT cur.*, mn.m.p AS into_, mn.m.q AS drop_ FROM cur JOIN mn ON cur.rec = mn.rec)) SELECT * FROM st)
SELECT-> rec AS rec_id, win AS win_ix, CAST(k AS INTEGER) AS k, min(win) OVER (PARTITION BY rec, k, cl) AS first_win FROM m6_s WHERE k IN (2, 3)""")
def m6_cluster_windows(fx):
    """The partitions by average linkage of recordings of ten windows: each window with the first of its cluster."""
    w = fx.windows().withColumn("rec_id", F.floor(F.col("win_ix") / 10))
    out = C.cluster_windows(w, [2, 3], spectral=False)
    return out.withColumn("first_win", F.min("win_ix").over(Window.partitionBy("rec_id", "k", "label"))).select("rec_id", "win_ix", "k", "first_win")


@query()
def m6_window_speakers(fx):
    """The number of speakers of each recording, by silhouette, and the labels of its windows."""
    return C.window_speakers(fx.windows())


# ------------------------------------------------------- files, written from the tables and read again


def _written(fx, name: str, files: DataFrame) -> str:
    """The folder of (name, content) rows written as files."""
    path = fx.folder(name)
    outputs.write_files(files, path)
    return path


def _odd(c) -> object:
    """Stems of recordings with characters that paths escape."""
    return F.concat(F.lit("r+ %"), c.cast("string"))


@query(" pd AS (SELECT rec_id, turn_ix, speaker, \"start\", \"end\", " + _PUNCT.format("text") + r""" AS text, trim(text_zh, E' \n\t\r') AS text_zh FROM fx_turns)
SELECT-> 'r+ %' || rec_id AS rec_id, turn_ix, speaker, "start", "end", text, text_zh FROM pd""")
def s1_read_transcripts(fx):
    """The four files of each recording, of which the documents are read."""
    path = fx.folder("outputs")
    turns = fx.turns().withColumn("rec_id", _odd(F.col("rec_id")))
    outputs.write_outputs(turns, turns.select("rec_id", F.lit("en").alias("language")).distinct(), path)
    return files.explode_turns(files.read_transcripts(fx.spark, path + "/*.json")).select("rec_id", "turn_ix", "speaker", "start", "end", "text", "text_zh")


@query(""" ps AS (SELECT rec_id, turn, min("start") AS "start", max("end") AS "end", string_agg(word, ' ' ORDER BY word_ix) AS word FROM fx_words WHERE turn % 4 = 3 GROUP BY rec_id, turn),
al AS (SELECT rec_id, turn, 0 AS pos, word, "start", "end" FROM ps UNION ALL SELECT rec_id, turn, word_ix, word, "start", "end" FROM fx_words WHERE turn % 4 <> 3 AND length(word) <> 3)
SELECT-> 'r+ %' || rec_id AS rec_id, 'en' AS language, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY "start", "end", turn, pos) - 1 AS INTEGER) AS word_ix, word, "start", "end" FROM al""")
def s2_read_asr(fx):
    docs = _asr(fx).select(F.concat(_odd(F.col("rec_id")), F.lit(".whisper.json")).alias("name"), F.to_json(F.struct("language", "text", "segments")).alias("content"))
    read = files.read_asr(fx.spark, _written(fx, "asr", docs))
    return W.collect_words(W.normalize_asr(read)).join(read.select("rec_id", "language"), "rec_id").select("rec_id", "language", "word_ix", "word", "start", "end")


@query("SELECT 'r+ %' || rec_id AS rec_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY seg_ix) - 1 AS INTEGER) AS seg_ix, \"start\", \"end\", speaker FROM fx_segments")
def s3_read_speaker_segments(fx):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seg_ix", "start", "end", "speaker"))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["speaker"].alias("speaker")))
    docs = fx.segments().groupBy("rec_id").agg(listed.alias("segments"))
    text = F.concat(F.lit("loading {model}\n"), F.to_json(F.struct(F.lit("cpu").alias("mode"), "segments")), F.lit("\n"))
    return files.read_speaker_segments(fx.spark, _written(fx, "segments", docs.select(F.concat(_odd(F.col("rec_id")), F.lit(".json")).alias("name"), text.alias("content"))))


@query(_NOTES + " SELECT-> 'r+ %' || rec_id AS rec_id, id, text AS text_en, \"start\", 100.0::DOUBLE + turn_ix AS created_at, len(list_filter(w[1:2], lambda x: x IS NOT NULL)) AS n_lemmas FROM nt")
def s4_read_notes(fx):
    n = _notes(fx)
    docs = n.groupBy("rec_id").agg(F.collect_list(F.struct(*[c for c in n.columns if c != "rec_id"])).alias("notes"))
    text = F.when(F.col("rec_id") % 2 == 0, F.to_json(F.struct(_odd(F.col("rec_id")).alias("stem"), "notes"))).otherwise(F.to_json(F.struct("notes")))
    read = files.read_notes(fx.spark, _written(fx, "notes", docs.select(F.concat(_odd(F.col("rec_id")), F.lit(".json")).alias("name"), text.alias("content"))))
    return read.select("rec_id", "id", "text_en", "start", "created_at", F.size("lemmas").cast("long").alias("n_lemmas"))


@query("SELECT upper(word) AS word, word AS key, phonetic, 'the \"' || word || '\"' || chr(10) || 'x, y' AS definition, nullif(translation, '') AS translation FROM fx_dict")
def s5_read_dictionary(fx):
    path = fx.folder("dictionary")
    d = fx.dictionary().select(F.upper("word").alias("word"), "phonetic", F.concat(F.lit('the "'), "word", F.lit('"\nx, y')).alias("definition"), F.nullif("translation", F.lit("")).alias("translation"), "pos")
    d.write.option("header", True).option("escape", '"').csv(path)
    return files.read_dictionary(fx.spark, path, "csv").select("word", "key", "phonetic", "definition", "translation")


_FILES = " fl AS (SELECT 'a+ %' || s_suppkey || CASE s_suppkey % 5 WHEN 0 THEN '.WAV' WHEN 1 THEN '.m4a' WHEN 2 THEN '.mp3' WHEN 3 THEN '.flac' ELSE '.txt' END AS name, s_suppkey FROM supplier)"


@query(_FILES + " SELECT-> name, regexp_replace(name, '\\.[^.]+$', '') AS rec_id, CAST(CASE s_suppkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 9 END AS INTEGER) AS priority, CAST(length(name) AS BIGINT) AS length FROM fl WHERE s_suppkey % 5 <> 4")
def s6_scan_recordings(fx):
    k = F.col("s_suppkey") % 5
    name = F.concat(F.lit("a+ %"), F.col("s_suppkey").cast("string"), F.when(k == 0, ".WAV").when(k == 1, ".m4a").when(k == 2, ".mp3").when(k == 3, ".flac").otherwise(".txt"))
    path = _written(fx, "recordings", fx.table("supplier").select(name.alias("name"), name.alias("content")))
    return files.scan_recordings(fx.spark, path).select("name", "rec_id", "priority", "length")


@query("""SELECT 'a+ %' || s_suppkey || '.wav' AS name, CAST(44 + 2000 AS BIGINT) AS length, CAST(44 AS BIGINT) AS bytes_read,
  CASE WHEN s_suppkey % 5 = 1 THEN 'not mono' WHEN s_suppkey % 5 = 2 THEN 'not 16 kHz' WHEN s_suppkey % 5 = 3 THEN 'not 16-bit' END AS reason FROM supplier""")
def s7_wav_headers(fx):
    k = F.col("s_suppkey") % 5
    little = lambda v, n: F.to_binary(F.concat(*[F.lpad(F.hex(F.shiftright(v, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(n)]), F.lit("hex"))
    zeros = lambda n: F.to_binary(F.repeat(F.lit("00"), F.lit(n)), F.lit("hex"))
    channels, rate, bits = F.when(k == 1, 2).otherwise(1), F.when(k == 2, 8000).otherwise(16000), F.when(k == 3, 24).otherwise(16)
    content = F.concat(zeros(22), little(channels, 2), little(rate, 4), zeros(6), little(bits, 2), zeros(8 + 2000))
    rows = fx.table("supplier").select(F.concat(F.lit("a+ %"), F.col("s_suppkey").cast("string"), F.lit(".wav")).alias("name"), content.alias("content"))
    return wav.read_wav_headers(fx.spark, _written(fx, "wav", rows)).select("name", "length", "bytes_read", "reason")


@query("SELECT CAST(rec_id AS BIGINT) AS rec_id, count(*) AS n FROM fx_turns GROUP BY rec_id")
def k6_checkpoint_stage(fx):
    """A stage over some recordings, then over all: only those that are missing are computed and appended."""
    path = fx.folder("stage")
    compute = lambda some: some.groupBy("rec_id").agg(F.count("*").alias("n"))
    files.checkpoint_stage(fx.spark, path, compute, fx.turns().where("rec_id % 3 = 0"))
    return files.checkpoint_stage(fx.spark, path, compute, fx.turns())


@query("""SELECT rec_id, word_ix AS turn_ix, '譯A' || word_ix || '.' || CASE WHEN word_ix % 7 % 2 = 0 THEN '記' || (word_ix % 7) || '。' ELSE '譯B' || (word_ix % 7) || '.' END AS text_zh, CAST(0 AS INTEGER) AS untranslated FROM fx_words""")
def x1_translate_turns(fx):
    """Two sentences a turn: a translator is asked for the distinct ones that a memory lacks."""
    n = (F.col("word_ix") % 7).cast("string")
    turns = fx.words().select("rec_id", F.col("word_ix").alias("turn_ix"), F.concat(F.lit("A"), F.col("word_ix").cast("string"), F.lit(". B"), n, F.lit(".")).alias("text"), F.lit("").alias("text_zh"))
    memory = fx.words().where("word_ix % 7 % 2 = 0").select(F.concat(F.lit("B"), n, F.lit(".")).alias("piece"), F.concat(F.lit("記"), n, F.lit("。")).alias("zh")).distinct()
    return X.translate_turns(turns, memory, lambda pieces: ["譯" + p for p in pieces]).select("rec_id", "turn_ix", "text_zh", "untranslated")


@query(""" ps AS (SELECT rec_id, turn, min("start") AS "start", max("end") AS "end", string_agg(word, ' ' ORDER BY word_ix) AS word FROM fx_words WHERE turn % 4 = 3 GROUP BY rec_id, turn),
al AS (SELECT rec_id, word, "start", "end" FROM ps UNION ALL SELECT rec_id, word, "start", "end" FROM fx_words WHERE turn % 4 <> 3 AND length(word) <> 3)
SELECT-> 'r+ %' || rec_id AS rec_id, min("start") AS "start", max("end") AS "end", count(*) AS n_words FROM al GROUP BY rec_id""")
def st1_stream_ingest(fx):
    """Recogniser files as a stream, in one batch or several, into a versioned table of turns."""
    docs = _asr(fx).select(F.concat(_odd(F.col("rec_id")), F.lit(".whisper.json")).alias("name"), F.to_json(F.struct("language", "text", "segments")).alias("content"))
    out = fx.folder("ingested")
    q = jobs.stream_ingest(fx.spark, _written(fx, "arriving", docs), out, fx.folder("progress"), buckets=8, available_now=True)
    q.awaitTermination()
    return jobs.ingested(fx.spark, out).groupBy("rec_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum(F.size("words")).alias("n_words"))
