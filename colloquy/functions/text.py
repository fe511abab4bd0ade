"""Scalar text functions as Column expressions; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The short answers with their translations. "you" only follows a thanks.
SHORT_ANSWERS = {
    "yeah": "嗯。", "yes": "對。", "yep": "對。", "yup": "對。", "ok": "好。", "okay": "好。", "right": "對。", "oh": "哦。", "ah": "啊。",
    "um": "嗯。", "uh": "呃。", "hmm": "嗯。", "mm": "嗯。", "mm-hmm": "嗯嗯。", "mmhmm": "嗯嗯。", "mhm": "嗯嗯。", "uh-huh": "嗯嗯。", "uhhuh": "嗯嗯。",
    "sure": "好。", "thanks": "謝謝。", "thank": "謝謝。", "no": "不。", "nope": "不。", "wow": "哇。", "hello": "你好。", "hi": "嗨。",
}
THANKS = "謝謝。"
# Phrases that a translator adds, removed in this order, and what marks them.
STRAY_PHRASES = (r"沒有任何樓盤符合您的搜尋結果\.?", r"沒有任何樓盤符合您的搜尋\s*[-—–-]?\s*", r"沒有任何樓盤符合您的搜尋\.?")
STRAY_MARKS = ("樓盤", "搜尋結果")
# Suffixes of recordings.
SUFFIXES = (".wav", ".m4a", ".mp3", ".aac", ".flac", ".ogg", ".caf", ".aiff", ".aif")
# The form of a single word, and what is cleaned after the phrases are removed, in this order.
LEMMA = r"^[a-z]+(?:'[a-z]+)?(?:-[a-z]+)*$"
TIDY = ((r"[ \t]{2,}", " "), (r"^[。，、；：\s]+", ""), (r"。{2,}", "。"), (r"\s+([。，、])", r"$1"))


def strip(c) -> Column:
    """Trim of all Unicode white space (Spark's trim takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def media_stem(name) -> Column:
    """Without ``.work.wav``, else without the last suffix; a leading dot starts no suffix."""
    name = F.col(name) if isinstance(name, str) else name
    return F.when(name.endswith(".work.wav"), F.regexp_replace(name, r"\.work\.wav$", "")).otherwise(F.regexp_replace(name, r"(?<=[^/])\.[^./]+$", ""))


def path_stem(name: Column) -> Column:
    """Without the last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(name, r"(?<=[^/])\.[^./]+$", "")


def same_stem(name: Column, stem: Column) -> Column:
    return (media_stem(name) == stem) | (path_stem(name) == stem) | F.startswith(name, F.concat(stem, F.lit(".")))


def format_ts(seconds: Column) -> Column:
    """``[HH:]MM:SS.mmm``; milliseconds are rounded half to even and not carried."""
    s = F.greatest(seconds, F.lit(0.0))
    whole = F.floor(s)
    ms = F.rint((s - whole) * 1000).cast("int")
    h, m, r = F.floor(whole / 3600).cast("int"), F.floor(whole % 3600 / 60).cast("int"), (whole % 60).cast("int")
    return F.when(h > 0, F.format_string("%02d:%02d:%02d.%03d", h, m, r, ms)).otherwise(F.format_string("%02d:%02d.%03d", m, r, ms))


def srt_ts(seconds: Column) -> Column:
    return F.translate(format_ts(seconds), ".", ",")


def join_words(words: Column) -> Column:
    """Joined by spaces, but none before a piece that starts with a closing mark."""
    return F.ltrim(F.array_join(F.transform(words, lambda w: F.when(w.rlike("^[,.;:!?]"), w).otherwise(F.concat(F.lit(" "), w))), ""))


def ends_sentence(word: Column) -> Column:
    return F.coalesce(word.rlike("[.!?。！？][\"'”’)\\]]*$"), F.lit(False))


def split_sentences(text: Column) -> Column:
    """Parts that end after every sentence mark and the white space behind it; blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[.!?。！？])\s*"), strip), lambda s: s != "")


split_zh_sentences = split_sentences


def zh_slice(parts: Column, i: Column, j: Column, n: Column) -> Column:
    """The part of a translation for sentences i..j of n, in proportion where counts differ."""
    m = F.size(parts)
    round_ = lambda a: F.rint(a.cast("double") * m / n).cast("int")
    z0 = F.greatest(F.lit(0), F.least(m - 1, round_(i)))
    z1 = F.greatest(z0 + 1, F.least(m, F.greatest(round_(j), z0 + 1)))
    take = F.when(m == n, F.slice(parts, i + 1, F.greatest(j - i, F.lit(0)))).otherwise(F.slice(parts, z0 + 1, z1 - z0))
    return F.when((n <= 0) | (m <= 0) | (i >= j), "").otherwise(strip(F.array_join(take, "")))


def punctuate(text: Column) -> Column:
    t = strip(text)
    t = F.regexp_replace(t, r"(?U)\s+([,.;:!?])", "$1")
    t = F.regexp_replace(t, r"([,.;:!?])([A-Za-z])", "$1 $2")
    t = F.regexp_replace(t, r"(?iU)\bMm\s*-\s*hmm\b", "Mm-hmm")
    t = strip(F.regexp_replace(t, r"(?U)\s+", " "))
    return F.when((t == "") | t.rlike(r"""[.?!…"')]$"""), t).otherwise(F.concat(t, F.lit(".")))


def is_contaminated(zh: Column) -> Column:
    zh = F.coalesce(zh, F.lit(""))
    return zh.contains(STRAY_MARKS[0]) | zh.contains(STRAY_MARKS[1])


def scrub_zh(zh: Column) -> Column:
    out = strip(F.coalesce(zh, F.lit("")))
    for pattern, to in (*((p, "") for p in STRAY_PHRASES), *TIDY):
        out = F.regexp_replace(out, "(?U)" + pattern, to)
    return strip(out)


def supported_suffix(name: Column) -> Column:
    """Whether a file has a suffix of recordings; a flag only, nothing is dropped by it."""
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).isin(*SUFFIXES)


def glossary(text: Column) -> Column:
    """Translation of an utterance that holds short answers only, else null."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z]+(?:-[A-Za-z]+)?)"), 1), F.lower)
    table = F.create_map(*[F.lit(x) for kv in SHORT_ANSWERS.items() for x in kv])
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("last"), F.lit(True).alias("ok"))

    def step(s, w):
        skip = (w == "you") & (s["last"] == THANKS)
        value = F.try_element_at(table, w)
        return F.struct(
            F.when(skip | value.isNull(), s["out"]).otherwise(F.concat(s["out"], value)).alias("out"),
            F.when(skip | value.isNull(), s["last"]).otherwise(value).alias("last"),
            (s["ok"] & (skip | value.isNotNull())).alias("ok"),
        )

    return F.aggregate(words, start, step, lambda s: F.when(s["ok"] & (s["out"] != ""), s["out"]))


def translation_pieces(text: Column, most: int = 350) -> Column:
    """Sentences for a translator, each of ``most`` characters at most, cut at spaces if any."""
    sentences = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")
    cut = rf"(?s)(.{{1,{most}}}\z|.{{1,{most - 1}}}(?= )|.{{{most}}})"
    pieces = F.flatten(F.transform(sentences, lambda s: F.regexp_extract_all(s, F.lit(cut), 1)))
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


def normalize_query(q: Column) -> Column:
    """One English word in lower case, or null."""
    raw = strip(F.coalesce(q, F.lit("")))
    word = F.regexp_replace(raw, r"^[^A-Za-z']+|[^A-Za-z']+$", "")
    word = F.regexp_replace(F.lower(F.translate(word, "’", "'")), r"^'+|'+$", "")
    return F.when(~raw.rlike(r"(?U)\s") & word.rlike(LEMMA), word)


def lemma_variants(w: Column) -> Column:
    """The word, then forms it may be derived from, in order, without repeats."""
    cut = lambda k: F.left(w, F.length(w) - k)

    def stems(k: int) -> list[Column]:
        stem = cut(k)
        double = (F.length(stem) >= 2) & (F.right(stem, F.lit(1)) == F.substring(stem, -2, 1))
        return [stem, F.concat(stem, F.lit("e")), F.when(double, cut(k + 1))]

    none = F.array().cast("array<string>")
    when = lambda ending, more, forms: F.when(w.endswith(ending) & (F.length(w) > more), F.array(*forms)).otherwise(none)
    es = w.endswith("es") & (F.length(w) > 3)
    s = F.when(es, F.array(cut(2), cut(1))).when(w.endswith("s") & (F.length(w) > 3) & ~w.endswith("ss"), F.array(cut(1))).otherwise(none)
    all_ = F.concat(F.array(w), when("ies", 4, [F.concat(cut(3), F.lit("y"))]), when("ing", 5, stems(3)), when("ed", 4, stems(2)), s)
    return F.array_distinct(F.filter(all_, lambda x: F.coalesce(x.rlike(LEMMA), F.lit(False))))


def dict_lines(text: Column) -> Column:
    raw = F.replace(F.coalesce(text, F.lit("")), F.lit("\\n"), F.lit("\n"))
    return F.filter(F.transform(F.split(raw, r"[\r\n]+"), strip), lambda s: s != "")


def parse_dict_row(word: Column, phonetic: Column, definition: Column, translation: Column, pos: Column) -> Column:
    """Entry of a dictionary row, or null without a translation; at most six senses."""
    blank = lambda c: strip(F.coalesce(c, F.lit("")))
    primary = strip(F.regexp_extract(blank(pos), "^([^/:]*)", 1))
    english = F.left(F.coalesce(F.get(dict_lines(definition), F.lit(0)), F.lit("")), F.lit(240))
    head = r"^([A-Za-z]{1,5})\.?(?U)\s+(.*)$"

    def sense(line, i):
        found = line.rlike(r"^[A-Za-z]{1,5}\.?(?U)\s+\S")
        return F.struct(
            F.when(found, F.regexp_extract(line, head, 1)).otherwise(primary).alias("pos"),
            F.when(found, strip(F.regexp_extract(line, head, 2))).otherwise(line).alias("zh"),
            F.when(i == 0, english).otherwise("").alias("en"),
            F.lit("").alias("example"),
        )

    senses = F.transform(F.slice(dict_lines(translation), 1, 6), sense)
    return F.when(F.size(senses) > 0, F.struct(blank(word).alias("lemma"), blank(phonetic).alias("phonetic"), senses.alias("senses"), F.lit("ecdict").alias("source")))


FALLBACK = "array<struct<phonetic:string,phonetics:array<struct<text:string>>,meanings:array<struct<partOfSpeech:string,definitions:array<struct<definition:string,example:string>>>>>>"


def flatten_fallback_entry(lemma: Column, payload: Column) -> Column:
    """Entry of a nested payload: the first phonetic, and the first six definitions."""
    blank = lambda c: strip(F.coalesce(c, F.lit("")))
    none = F.array().cast("array<struct<text:string>>")
    spoken = F.flatten(F.transform(payload, lambda e: F.concat(F.array(blank(e["phonetic"])), F.transform(F.coalesce(e["phonetics"], none), lambda p: blank(p["text"])))))
    senses = F.flatten(F.transform(payload, lambda e: F.flatten(F.transform(F.coalesce(e["meanings"], F.array().cast("array<struct<partOfSpeech:string,definitions:array<struct<definition:string,example:string>>>>")), lambda m: F.transform(
        F.coalesce(m["definitions"], F.array().cast("array<struct<definition:string,example:string>>")),
        lambda d: F.struct(blank(m["partOfSpeech"]).alias("pos"), F.lit("").alias("zh"), blank(d["definition"]).alias("en"), blank(d["example"]).alias("example")),
    )))))
    senses = F.slice(F.filter(senses, lambda s: s["en"] != ""), 1, 6)
    return F.struct(lemma.alias("lemma"), F.coalesce(F.get(F.filter(spoken, lambda p: p != ""), F.lit(0)), F.lit("")).alias("phonetic"), senses.alias("senses"), F.lit("free-dictionary").alias("source"))


SENSES = "array<struct<pos:string,zh:string,en:string,example:string>>"
LEMMA_ENTRY = f"struct<lemma:string,phonetic:string,senses:{SENSES},source:string>"


def lemma_entry(entry: Column, word: Column) -> Column:
    blank = lambda c: strip(F.coalesce(c, F.lit("")))
    named = F.when(F.coalesce(entry["lemma"], F.lit("")) != "", entry["lemma"]).otherwise(word)
    made = F.struct(blank(named).alias("lemma"), blank(entry["phonetic"]).alias("phonetic"), F.coalesce(entry["senses"], F.array().cast(SENSES)).alias("senses"), blank(entry["source"]).alias("source"))
    return F.when(blank(named) != "", made)


def note_lemmas(lemmas: Column, entry: Column, word: Column) -> Column:
    """Saved entries, the first of each lemma in any case; else one from ``dict`` or ``word``."""
    none = F.array().cast(f"array<{LEMMA_ENTRY}>")
    clean = F.filter(F.transform(F.coalesce(lemmas, none), lambda e: lemma_entry(e, F.lit(""))), lambda e: e.isNotNull())
    keys = F.transform(clean, lambda e: F.lower(e["lemma"]))
    first = F.filter(clean, lambda e, i: F.array_position(keys, F.lower(e["lemma"])) == i + 1)
    return F.when(F.size(first) > 0, first).otherwise(F.filter(F.array(lemma_entry(entry, word)), lambda e: e.isNotNull()))


def merge_lemma(lemmas: Column, entry: Column) -> Column:
    """Replaces the entry of the same lemma in place, else appends; a null entry changes nothing."""
    key = F.lower(entry["lemma"])
    known = F.exists(lemmas, lambda e: F.lower(e["lemma"]) == key)
    put = F.transform(lemmas, lambda e: F.when(F.lower(e["lemma"]) == key, entry).otherwise(e))
    return F.when(entry.isNull(), lemmas).when(known, put).otherwise(F.concat(lemmas, F.array(entry)))


def remove_lemma(lemmas: Column, lemma: Column) -> Column:
    key = F.lower(strip(F.coalesce(lemma, F.lit(""))))
    return F.when(key == "", lemmas).otherwise(F.filter(lemmas, lambda e: F.lower(e["lemma"]) != key))


def progress_pct(end: Column, duration: Column) -> Column:
    return F.when(duration <= 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.floor(100 * end / F.nullif(duration, F.lit(0)))))).cast("int")


def coerce_time(x: Column) -> Column:
    return F.when(strip(x) == "", None).otherwise(strip(x).try_cast("double"))
