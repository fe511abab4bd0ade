"""Edits of transcripts, notes and caches, as functions from old rows and changes to new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.functions.text import LEMMA_ENTRY, coerce_time, flatten_fallback_entry, glossary, is_contaminated, lemma_entry, lemma_variants, media_stem, merge_lemma, normalize_query, note_lemmas, parse_dict_row, path_stem, remove_lemma, same_stem, scrub_zh, strip
from colloquy.operators.intervals import turns_outside_ranges
from colloquy.operators.render import WORDS

RANGE_LIMIT = 180.0


def language_gate(docs: DataFrame, force: bool = False) -> DataFrame:
    """``accepted`` and, for others, ``detected``; with ``force`` all pass as ``en``."""
    lang = F.lower(F.coalesce("language", F.lit("")))
    if force:
        return docs.withColumn("language", F.lit("en")).withColumn("accepted", F.lit(True)).withColumn("detected", F.lit(None).cast("string"))
    ok = lang.isin("en", "english")
    return docs.withColumn("accepted", ok).withColumn("detected", F.when(~ok, F.when(lang == "", "unknown").otherwise(lang)))


def validate_edits(edits: DataFrame, durations: DataFrame) -> DataFrame:
    """``reason`` (null if accepted) and the clip, padded and kept inside the recording."""
    e = edits.join(durations, "rec_id", "left")
    s, t, pad = (F.col(c).try_cast("double") for c in ("start", "end", "padding"))
    pad = F.greatest(F.lit(0.0), F.coalesce(pad, F.lit(0.0)))
    e = e.withColumn("clip_start", F.greatest(F.lit(0.0), s - pad)).withColumn("clip_end", F.least(F.coalesce("duration", t + pad), t + pad))
    reason = F.when(s.isNull() | t.isNull(), "not a number").when(t <= s, "empty range").when(t - s > RANGE_LIMIT, "too long").when(F.col("clip_end") <= F.col("clip_start"), "empty clip")
    return e.withColumn("reason", reason)


def words_in_range(words: DataFrame, edits: DataFrame) -> DataFrame:
    """Words whose midpoint lies in the edit's range, both ends included."""
    e = edits.select("edit_id", "rec_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    return words.join(e, "rec_id").where(((F.col("start") + F.col("end")) / 2).between(F.col("_s"), F.col("_e"))).drop("_s", "_e")


def shift_times(words: DataFrame, offset="offset") -> DataFrame:
    by = F.col(offset) if isinstance(offset, str) else F.lit(float(offset))
    return words.withColumns({"start": F.col("start") + by, "end": F.col("end") + by})


def splice_turns(old: DataFrame, new: DataFrame, edits: DataFrame) -> DataFrame:
    """Old turns outside the ranges with the new ones, numbered by time, old before new on ties."""
    both = turns_outside_ranges(old, edits).withColumn("is_new", F.lit(0)).unionByName(new.withColumn("is_new", F.lit(1)), allowMissingColumns=True)
    ix = F.row_number().over(Window.partitionBy("rec_id").orderBy("start", "end", "is_new", "turn_ix")) - 1
    return both.withColumn("_ix", ix).drop("turn_ix", "is_new").withColumnRenamed("_ix", "turn_ix")


def edit_report(old: DataFrame, new: DataFrame, kept_words: DataFrame, edits: DataFrame) -> DataFrame:
    """Per edit: replaced turns, new turns, kept words and whether there was anything to put in."""
    e = edits.select("edit_id", "rec_id", F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = F.least("end", "_e") - F.greatest("start", "_s") > 0
    replaced = old.join(e, "rec_id").where(hit).groupBy("edit_id").agg(F.count("*").alias("replaced_turns"))
    fresh = new.join(e, "rec_id").where(hit).groupBy("edit_id").agg(F.count("*").alias("new_turns"))
    kept = kept_words.groupBy("edit_id").agg(F.count("*").alias("kept_words"))
    out = edits.select("edit_id", "rec_id").join(replaced, "edit_id", "left").join(fresh, "edit_id", "left").join(kept, "edit_id", "left").na.fill(0)
    return out.withColumn("status", F.when(F.col("kept_words") == 0, "rejected").otherwise("applied"))


def _words_like(turns: DataFrame, words):
    """Words with the fields that the turns' words have, or those of an export if the turns have none."""
    kind = turns.schema["words"].dataType if "words" in turns.columns else T._parse_datatype_string(WORDS)
    return lambda have: F.transform(words, lambda w: F.struct(*[(w[f.name] if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.elementType.fields]))


def apply_range_edits(turns: DataFrame, clip_words: DataFrame, edits: DataFrame, durations: DataFrame | None = None, memory: DataFrame | None = None, translate=None) -> tuple[DataFrame, DataFrame]:
    """Turns after re-transcription of the ranges, and a report with a row for each edit.

    ``clip_words`` have (edit_id, rec_id, word_ix, word, start, end) in clip time and
    ``offset``; an edit takes words of its own clip only, those with a text and their midpoint
    in its range. Where two ranges touch, a word at the shared end belongs to the later one. Each
    edit makes its own turns, translated if a memory or a translator is given. Edits that
    are not valid, that overlap an earlier one of the batch on the same recording, or that
    have no words change nothing; the report gives the ``reason``.

    Turns keep all their columns, ``words`` among them; new turns have their words in the
    recording's time, and null in columns that only old ones have. Both results come from one
    table of old and new turns with the edits that each belongs to."""
    from colloquy.functions.text import punctuate
    from colloquy.operators.intervals import inherit_speaker
    from colloquy.operators.translate import translate_turns
    from colloquy.operators.turns import split_turns, words_to_turns

    if durations is None:
        durations = edits.select("rec_id").distinct().withColumn("duration", F.lit(None).cast("double"))
    checked = validate_edits(edits.select("edit_id", "rec_id", "start", "end", "padding"), durations)
    checked = checked.withColumns({c: F.col(c).try_cast("double") for c in ("start", "end")}).withColumn("ok", F.col("reason").isNull())
    by_time = Window.partitionBy("rec_id", "ok").orderBy("start", "edit_id")
    until = F.max("end").over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    checked = checked.withColumn("apart", F.col("ok") & (until.isNull() | (F.col("start") >= until)))
    following = F.lead("start").over(Window.partitionBy("rec_id", "apart").orderBy("start", "edit_id"))
    checked = checked.withColumn("shared_end", F.coalesce(following == F.col("end"), F.lit(False)))
    apart = checked.where("apart")
    own = apart.select("edit_id", F.col("start").alias("_s"), F.col("end").alias("_e"), "shared_end")
    middle = (F.col("start") + F.col("end")) / 2
    kept = shift_times(clip_words.where(strip(F.col("word")) != "")).drop("offset").join(own, "edit_id").where(middle.between(F.col("_s"), F.col("_e")) & ~(F.col("shared_end") & (middle == F.col("_e"))))
    ix = F.row_number().over(Window.partitionBy("edit_id").orderBy("start", "end", "word_ix")) - 1
    kept = kept.withColumn("word_ix", ix).drop("_s", "_e", "shared_end")
    # turns are made within an edit, so its id stands for the recording until they are
    new = words_to_turns(inherit_speaker(kept, turns).drop("rec_id").withColumnRenamed("edit_id", "rec_id")).withColumn("text", punctuate(F.col("text")))
    new = split_turns(new.withColumn("text_zh", F.lit("")))
    new = new.withColumn("turn_ix", F.row_number().over(Window.partitionBy("rec_id").orderBy("turn_ix", "part_ix")) - 1)
    if memory is not None or translate is not None:
        new = translate_turns(new, memory, translate)
    have = {f.name for f in new.schema["words"].dataType.elementType.fields}
    new = new.withColumn("words", _words_like(turns, F.col("words"))(have)).withColumnRenamed("rec_id", "edit_id").join(apart.select("edit_id", "rec_id"), "edit_id")
    columns = [*turns.columns, *(["words"] if "words" not in turns.columns else [])]
    ranges = apart.groupBy("rec_id").agg(F.collect_list(F.struct("edit_id", F.col("start").alias("s"), F.col("end").alias("e"))).alias("_ranges"))
    hit = F.transform(F.filter("_ranges", lambda r: F.least("end", r["e"]) - F.greatest("start", r["s"]) > 0), lambda r: r["edit_id"])
    id_type = dict(edits.dtypes)["edit_id"]
    none = F.array().cast(f"array<{id_type}>")
    old = turns.join(ranges, "rec_id", "left").select(*turns.columns, F.coalesce(hit, none).alias("_hit"), F.lit(None).cast(id_type).alias("_edit"))
    both = old.unionByName(new.select(*[c for c in new.columns if c in columns], none.alias("_hit"), F.col("edit_id").alias("_edit")), allowMissingColumns=True)
    # edits with words: only these replace
    spoken = F.collect_set("_edit").over(Window.partitionBy("rec_id"))
    both = both.withColumn("_hit", F.array_intersect("_hit", spoken))
    ix = F.row_number().over(Window.partitionBy("rec_id").orderBy("start", "end", F.col("_edit").isNotNull(), "turn_ix")) - 1
    after = both.where(F.size("_hit") == 0).withColumn("_ix", ix).select(*[F.col("_ix").alias(c) if c == "turn_ix" else F.col(c) for c in columns])

    each = both.select(F.explode(F.when(F.col("_edit").isNotNull(), F.array("_edit")).otherwise(F.col("_hit"))).alias("edit_id"), F.col("_edit").isNotNull().alias("fresh"), F.size("words").alias("n"))
    counts = each.groupBy("edit_id").agg(F.count_if(~F.col("fresh")).alias("replaced_turns"), F.count_if("fresh").alias("new_turns"), F.sum(F.when(F.col("fresh"), F.col("n"))).alias("kept_words"))
    report = checked.select("edit_id", "rec_id", "reason", "apart").join(counts, "edit_id", "left").na.fill(0, ["replaced_turns", "new_turns", "kept_words"])
    why = F.coalesce("reason", F.when(~F.col("apart"), "overlaps another edit"), F.when(F.col("kept_words") == 0, "no words"))
    return after, report.select("edit_id", "rec_id", why.alias("reason"), "replaced_turns", "new_turns", "kept_words", F.when(why.isNull(), "applied").otherwise("rejected").alias("status"))


def edit_table(table, clip_words: DataFrame, edits: DataFrame, durations: DataFrame | None = None, memory: DataFrame | None = None, translate=None) -> tuple[int, DataFrame]:
    """Applies range edits to the turns of a :class:`colloquy.sources.store.VersionedTable` by
    recording: the new version, and the report. Only buckets of edited recordings are rewritten;
    ``table.undo()`` goes back. The report reads the snapshot before, whose files stay."""
    seen = table.version()
    change = lambda old: apply_range_edits(old, clip_words, edits, durations, memory, translate)
    version = table.update(edits.select("rec_id"), lambda old: change(old)[0], expected=seen)
    return version, change(table.read(seen))[1]


def restore_version(versions: DataFrame, current: DataFrame) -> DataFrame:
    """The last version below the current one of each recording; ``error`` if none has turns."""
    before = versions.join(current, "rec_id").where(F.col("version") < F.col("current")).groupBy("rec_id").agg(F.max_by("turns", "version").alias("turns"))
    out = current.select("rec_id").join(before, "rec_id", "left")
    return out.withColumn("error", F.when(F.coalesce(F.size("turns"), F.lit(0)) <= 0, "nothing to restore"))


def rescrub(turns: DataFrame, memory: DataFrame | None = None, translate=None) -> DataFrame:
    """``text_zh`` set from the glossary, else scrubbed; ``changed`` and ``to_translate`` (it was
    contaminated and has English). With a memory or a translator the turns to translate are
    translated anew; without, they keep what the scrubbing left."""
    from colloquy.operators.translate import translate_turns

    old, known = F.coalesce("text_zh", F.lit("")), glossary(F.col("text"))
    out = turns.withColumn("_old", old).withColumn("to_translate", known.isNull() & is_contaminated(old) & (strip(F.coalesce("text", F.lit(""))) != "")).withColumn("text_zh", F.coalesce(known, scrub_zh(old)))
    if memory is not None or translate is not None:
        again = translate_turns(out.where("to_translate"), memory, translate).select(*out.columns)
        out = out.where(~F.col("to_translate")).unionByName(again)
    return out.withColumn("changed", F.col("text_zh") != F.col("_old")).drop("_old")


def scrub_report(before: DataFrame, after: DataFrame) -> DataFrame:
    b = before.select("rec_id", "turn_ix", F.coalesce("text_zh", F.lit("")).alias("old"), (is_contaminated(F.col("text_zh")) | glossary(F.col("text")).isNotNull()).alias("candidate"))
    a = after.select("rec_id", "turn_ix", F.coalesce("text_zh", F.lit("")).alias("new"))
    return b.join(a, ["rec_id", "turn_ix"]).groupBy("rec_id").agg(F.count_if("candidate").alias("candidates"), F.count_if(F.col("old") != F.col("new")).alias("changed"), F.count_if(F.col("new").contains("樓盤")).alias("remaining"))


# ------------------------------------------------------------------------- notes


def note_order(notes: DataFrame, out: str = "note_ix") -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    order = Window.partitionBy("rec_id").orderBy(F.col("start").isNull(), zero(F.col("start")), zero(F.col("created_at")), "id")
    return notes.withColumn(out, F.row_number().over(order) - 1)


NOTE_STATE = f"struct<word:string,text_en:string,text_zh:string,start:double,end:double,source:string,created_at:double,updated_at:double,lemmas:array<{LEMMA_ENTRY}>,dict:{LEMMA_ENTRY}>"


def _changed(note, c):
    """``(note, error)`` of a note (null: there is none) after one change."""
    none = F.array().cast(f"array<{LEMMA_ENTRY}>")
    old = F.when(note.isNull(), none).otherwise(note_lemmas(note["lemmas"], note["dict"], F.coalesce(note["word"], F.lit(""))))
    entry = lemma_entry(c["dict"], c["word"])
    removes, left = ~c["is_new"] & (c["remove"] != ""), remove_lemma(old, c["remove"])
    # a new note has its dictionary entry or word merged, an old one if the change brings an entry
    merges = ~removes & entry.isNotNull() & F.when(c["is_new"], c["dict"].isNotNull() | (c["word"] != "")).otherwise(c["has_dict"])
    named = F.when(c["word"] != "", c["word"]).otherwise(F.coalesce(note["word"], F.lit("")))
    last = F.try_element_at(left, F.lit(-1))
    plain = F.when(c["is_new"], none).when(c["has_dict"] | (F.coalesce(F.size(note["lemmas"]), F.lit(0)) > 0), old).otherwise(note_lemmas(none, note["dict"], named))
    error = F.when((c["text_en"] == "") & (c["text_zh"] == ""), "no text").when(~c["is_new"] & note.isNull(), "unknown note").when(c["is_new"] & note.isNotNull(), "id in use").when(removes & (F.size(left) == F.size(old)), "no such lemma")
    after = F.struct(
        F.when(removes, F.coalesce(last["lemma"], F.lit(""))).when(merges, entry["lemma"]).when(c["has_dict"] & ~c["is_new"], F.coalesce(note["word"], F.lit(""))).otherwise(named).alias("word"),
        c["text_en"].alias("text_en"), c["text_zh"].alias("text_zh"), c["start"].alias("start"), c["end"].alias("end"),
        F.when(c["source"] != "", c["source"]).when(c["is_new"] | (F.coalesce(note["source"], F.lit("")) == ""), "manual").otherwise(note["source"]).alias("source"),
        F.when(c["is_new"], c["now"]).otherwise(note["created_at"]).alias("created_at"), F.when(~c["is_new"], c["now"]).alias("updated_at"),
        F.when(removes, left).when(merges, merge_lemma(old, entry)).otherwise(plain).alias("lemmas"),
        F.when(removes, last).when(merges, entry).when(~c["is_new"], note["dict"]).alias("dict"),
    ).cast(NOTE_STATE)
    return F.when(error.isNull(), after).otherwise(note), error


def upsert_notes(notes: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes after the changes, and the changes that failed with their ``error``.

    ``changes``: rec_id, change_id (id of a new note), id (null for new), word, text_en,
    text_zh, start, end (strings), source, dict, has_dict, remove_lemma, now. The changes
    of one note are applied one after the other, by ``now`` and then change_id; one that
    fails leaves the note as it was."""
    blank = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    is_new = blank("id") == ""
    change = F.struct(
        F.col("now").cast("double").alias("now"), "change_id", is_new.alias("is_new"), blank("word").alias("word"), blank("text_en").alias("text_en"), blank("text_zh").alias("text_zh"), coerce_time(F.col("start")).alias("start"),
        coerce_time(F.col("end")).alias("end"), blank("source").alias("source"), F.col("dict").cast(LEMMA_ENTRY).alias("dict"), F.coalesce("has_dict", F.lit(False)).alias("has_dict"), blank("remove_lemma").alias("remove"),
    )
    c = changes.select("rec_id", F.when(is_new, F.col("change_id")).otherwise(blank("id")).alias("id"), change.alias("c")).groupBy("rec_id", "id").agg(F.array_sort(F.collect_list("c"), lambda x, y: _earlier(x, y)).alias("cs"))
    fields = ["word", "text_en", "text_zh", "start", "end", "source", "created_at", "updated_at", "lemmas", "dict"]
    old = notes.select("rec_id", "id", F.struct(*[F.col(f) for f in fields]).cast(NOTE_STATE).alias("note"))
    errors = "array<struct<change_id:string,error:string>>"
    start = F.struct(F.col("note"), F.array().cast(errors).alias("errors"))

    def step(state, c):
        note, error = _changed(state["note"], c)
        failed = F.array(F.struct(c["change_id"].cast("string").alias("change_id"), error.alias("error")))
        return F.struct(note.alias("note"), F.when(error.isNull(), state["errors"]).otherwise(F.concat(state["errors"], failed)).cast(errors).alias("errors"))

    both = old.join(c, ["rec_id", "id"], "full").withColumn("state", F.aggregate(F.coalesce("cs", F.array().cast(dict(c.dtypes)["cs"])), start, step))
    after = both.where("state.note is not null").select("rec_id", "id", "state.note.*")
    return after, both.select("rec_id", "id", F.explode("state.errors").alias("e")).select("rec_id", "id", "e.change_id", "e.error")


def _earlier(x, y):
    key = lambda a: F.struct(a["now"], a["change_id"])
    return F.when(key(x) < key(y), -1).when(key(x) > key(y), 1).otherwise(0)


def upsert_notes_table(table, changes: DataFrame) -> tuple[int, DataFrame]:
    """:func:`upsert_notes` on a :class:`colloquy.sources.store.VersionedTable` of notes by recording:
    the new version, and the changes that failed. Buckets without a changed note keep their files."""
    seen = table.version()
    version = table.update(changes.select("rec_id"), lambda old: upsert_notes(old, changes)[0], expected=seen)
    return version, upsert_notes(table.read(seen), changes)[1]


def delete_notes_table(table, ids: DataFrame) -> tuple[int, DataFrame]:
    """:func:`delete_notes` on a versioned table of notes: the new version, and the ids that matched none."""
    seen = table.version()
    version = table.update(ids.select("rec_id"), lambda old: delete_notes(old, ids)[0], expected=seen)
    return version, delete_notes(table.read(seen), ids)[1]


def delete_notes(notes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The notes left, and the ids that matched none."""
    key = ["rec_id", "id"]
    return notes.join(ids, key, "left_anti"), ids.join(notes, key, "left_anti")


def delete_recordings(files: DataFrame, stems: DataFrame) -> DataFrame:
    """``kind, name, stem, deleted``; recording.wav is never deleted. A name is met under its stems
    and under each of its dotted prefixes, so the join is an equi-join; of several stems the first
    one counts. Files of the kind ``notes`` belong to one recording, whose stem is the name
    without ``.json``."""
    parts = F.split("name", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    keys = F.when(F.col("kind") == "notes", F.array(F.regexp_replace("name", r"\.json$", ""))).otherwise(F.array_distinct(F.concat(prefixes, F.array(media_stem("name")))))
    met = files.select("kind", "name", F.explode(keys).alias("stem")).join(stems.select("stem").distinct(), "stem")
    hits = met.where((F.col("kind") == "notes") | same_stem(F.col("name"), F.col("stem"))).where("name <> 'recording.wav'")
    hits = hits.groupBy("kind", "name").agg(F.min("stem").alias("stem"))
    return files.join(hits, ["kind", "name"], "left").withColumn("deleted", F.col("stem").isNotNull())


def deletion_report(deleted: DataFrame, stems: DataFrame) -> DataFrame:
    """``stem, n_deleted, n_notes, names`` of every stem asked for: how many files went, how many of
    them were notes, and their names in order. ``deleted`` is what :func:`delete_recordings` gives."""
    gone = deleted.where("deleted").groupBy("stem").agg(F.count("*").alias("n_deleted"), F.count_if(F.col("kind") == "notes").alias("n_notes"), F.array_sort(F.collect_list("name")).alias("names"))
    return stems.select("stem").distinct().join(gone, "stem", "left").na.fill(0, ["n_deleted", "n_notes"]).withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


# ------------------------------------------------------------------------- lookup


#: Bits of a piece of a key filter, and the pieces: 4 MB in all, whatever the number of keys.
PIECE, PIECES = 1 << 15, 1024


def _places(key, salt: int):
    """Piece and bit of a key in a filter."""
    at = F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(PIECE * PIECES))
    return F.floor(at / PIECE), at % PIECE


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """``piece, bits``: a Bloom filter of a column by two hashes, as bitmaps built by an aggregate, of
    which the shuffle sees one for each task and piece. It has PIECES rows of 4 KB at most."""
    at = keys.select(F.explode(F.array(*[F.struct(*[c.alias(n) for c, n in zip(_places(F.col(key), salt), ("piece", "bit"))]) for salt in (0, 1)])).alias("p")).select("p.*")
    return at.groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))


def may_hold(rows: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """The rows whose ``key`` is in the filter, and a few more; the filter's size is bounded, so it is broadcast."""
    out = rows
    for salt in (0, 1):
        piece, bit = _places(F.col(key), salt)
        byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("_bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        met = out.withColumn("piece", piece).withColumn("_bit", bit).join(F.broadcast(found), "piece")
        out = met.where(F.call_function("getbit", byte, (F.col("_bit") % 8).cast("int")) == 1).select(*rows.columns)
    return out


def lookup_words(queries: DataFrame, dictionary: DataFrame, fallback: DataFrame | None = None, cache: DataFrame | None = None, filtered: bool = False) -> DataFrame:
    """``query, lemma, ok, cached, source, entry`` of every distinct query: a cached entry with
    senses, unless it is the fallback's and the dictionary has the word; else the dictionary over
    the variants of the word, the first with a translation; else the ``fallback`` (lemma,
    payload), if it has senses. What is no single word has no lemma. Rows of one key go by word.
    With ``filtered`` variants that the dictionary can't have are left out before the join by a filter
    of its keys, which pays for a dictionary too large to be broadcast."""
    q = queries.select("query").distinct().withColumn("lemma", normalize_query(F.col("query")))
    row = F.struct("word", "phonetic", "definition", "translation", "pos")
    d = dictionary.where(strip(F.coalesce("translation", F.lit(""))) != "").groupBy(F.lower("word").alias("key")).agg(F.min_by(row, "word").alias("row"))
    each = q.where("lemma is not null").select("lemma").distinct().select("lemma", F.posexplode(lemma_variants(F.col("lemma"))).alias("variant_ix", "key"))
    each = may_hold(each, "key", key_filter(d, "key")) if filtered else each
    hit = each.join(d, "key").groupBy("lemma").agg(F.min_by("row", "variant_ix").alias("row"))
    main = parse_dict_row(*[F.col(f"row.{c}") for c in ("word", "phonetic", "definition", "translation", "pos")])
    out = q.join(hit, "lemma", "left").withColumn("main", main.cast(LEMMA_ENTRY)).drop("row")
    senses = lambda e: F.coalesce(F.size(e), F.lit(0)) > 0
    none = F.lit(None).cast(LEMMA_ENTRY)
    if fallback is None:
        out = out.withColumn("other", none)
    else:
        entry = flatten_fallback_entry(F.col("lemma"), F.col("payload")).cast(LEMMA_ENTRY)
        other = fallback.groupBy("lemma").agg(F.min("payload").alias("payload")).withColumn("other", entry).where(senses("other.senses"))
        out = out.join(other.select("lemma", "other"), "lemma", "left")
    if cache is None:
        out = out.withColumn("known", none)
    else:
        good = cache.where(senses("entry.senses") & (F.col("entry.lemma") != "")).select("lemma", F.col("entry").cast(LEMMA_ENTRY).alias("known"))
        out = out.join(good, "lemma", "left")
    stays = F.col("known").isNotNull() & ~((F.col("known.source") == "free-dictionary") & F.col("main").isNotNull())
    entry = F.when(stays, F.col("known")).otherwise(F.coalesce("main", "other"))
    return out.select("query", "lemma", entry.isNotNull().alias("ok"), stays.alias("cached"), entry["source"].alias("source"), entry.alias("entry"))


def trim_cache(cache: DataFrame, most: int = 2000) -> DataFrame:
    """The entries inserted last; a sort and limit, so no window over the whole table."""
    return cache.orderBy(F.desc("inserted_seq"), "lemma").limit(most)


def merge_cache(cache: DataFrame, found: DataFrame) -> DataFrame:
    """New entries replace those of the same lemma at their old place."""
    both = cache.withColumn("_turn", F.lit(0)).unionByName(found.withColumn("_turn", F.lit(1)))
    return both.groupBy("lemma").agg(F.max_by("entry", F.struct("_turn", "inserted_seq")).alias("entry"), F.min("inserted_seq").alias("inserted_seq"))


def upsert_cache(cache: DataFrame, found: DataFrame, most: int = 2000) -> DataFrame:
    """New entries replace those of the same lemma at their old place, then the oldest go."""
    return trim_cache(merge_cache(cache, found), most)


def upsert_cache_table(table, found: DataFrame, most: int = 2000) -> int:
    """:func:`upsert_cache` on a :class:`colloquy.sources.store.VersionedTable` by lemma: buckets of the
    new entries are rewritten, and then those that hold an entry older than the ``most`` last ones,
    if there are any."""
    version = table.update(found.select("lemma"), lambda old: merge_cache(old, found).select(*old.columns))
    order = table.read(version).select("inserted_seq", "lemma").orderBy(F.desc("inserted_seq"), "lemma")
    last = order.limit(most).orderBy("inserted_seq", F.desc("lemma")).first()
    if last is None:
        return version
    stays = (F.col("inserted_seq") > last["inserted_seq"]) | ((F.col("inserted_seq") == last["inserted_seq"]) & (F.col("lemma") <= last["lemma"]))
    return table.update(table.read(version).where(~stays).select("lemma"), lambda old: old.where(stays), expected=version)


def library(recordings: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Recordings with the transcript that fits best: its stem, its stem as work file, else the first
    by name whose stem is the recording's. Recogniser results and checkpoints are no transcripts."""
    r = recordings.withColumn("stem", media_stem("name"))
    name = F.col("transcript_name")
    keys = F.array_distinct(F.array(media_stem(name), path_stem(name), F.regexp_replace(name, r"\.work\.json$", "")))
    t = transcripts.select(F.col("name").alias("transcript_name")).where(name.endswith(".json") & ~name.rlike(r"\.(whisper|turns)\.json$")).withColumn("stem", F.explode(keys))
    rank = F.when(name == F.concat("stem", F.lit(".json")), 0).when(name == F.concat("stem", F.lit(".work.json")), 1).otherwise(2)
    best = t.groupBy("stem").agg(F.min(F.struct(rank.alias("rank"), "transcript_name")).alias("b")).select("stem", F.col("b.transcript_name").alias("transcript_name"))
    return r.join(best, "stem", "left").withColumn("has_transcript", F.col("transcript_name").isNotNull())


def tail_per_key(log: DataFrame, n: int = 400) -> DataFrame:
    return log.withColumn("_back", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("seq")))).where(F.col("_back") <= n).drop("_back")


def throttle_progress(log: DataFrame, step: int = 5) -> DataFrame:
    """``emit``: the first tick of a job, each new multiple of ``step``, and 100 once."""
    earlier = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    most, floors = F.max("pct").over(earlier), F.max(F.floor(F.col("pct") / step)).over(earlier)
    return log.withColumn("emit", most.isNull() | (F.floor(F.col("pct") / step) > floors) | ((F.col("pct") >= 100) & (most < 100)))


def closing_ticks(log: DataFrame, durations: DataFrame) -> DataFrame:
    """``job_id, seq, pct``: a tick of 100 behind the last one of each job (``durations``:
    job_id, duration) that has a duration and did not reach 100."""
    most = log.groupBy("job_id").agg(F.max("pct").alias("most"), F.max("seq").alias("last"))
    open_ = durations.where("duration > 0").select("job_id").join(most, "job_id", "left").where(F.coalesce("most", F.lit(-1)) < 100)
    return open_.select("job_id", (F.coalesce("last", F.lit(0)) + 1).alias("seq"), F.lit(100).alias("pct"))
