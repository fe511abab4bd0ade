"""Training-data operators against brute force, exact round trips and odd rows."""

import base64
import hashlib
import io
import random
import re
import time
import zipfile

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from colloquy.llm import bpe, html_extract, mixing, pii, simhash, suffixes, toxicity, vectors, warc
from colloquy.llm import queries as llm_queries
from colloquy.llm.common import components

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))], DOC)


ODD = [None, "", " \n\t", "a", "word " * 30_000, "é" * 500, "\x00\x1c", "same text here", "same text here", "<|endoftext|> x", "😀 'll  \n"]


def roots(links, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 440)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*links, (None, 1)], "a long, b long")).collect()}
    want = roots(links, {x for p in links for x in p})
    assert got == {n: c for n, c in want.items() if n != c}


# -------------------------------------------------------------------------- op1


def base_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, f"email:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, f"ip:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            out.append((m.start(), 2, f"card:{m.start()}:{m.end()}"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(digits(m[0])) <= 15:
            out.append((m.start(), 3, f"phone:{m.start()}:{m.end()}"))
    return ",".join(s for *_, s in sorted(out))


def test_pii_base_spans(spark):
    rnd = random.Random(2)
    parts = ["a@b.c", "x@y@z.com", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+44 (20) 7946-0958", "+1", ".", "-", "é", " ", "_", "9", "@", "GB82 WEST 1234 5698 7654 32", "call 555-123-4567"]
    texts = ODD + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 14))) for _ in range(400)]
    for r in pii.pii_report(docs(spark, texts)).collect():
        base = base_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), texts[r.doc_id]
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        assert r.n_email + r.n_ip + r.n_card + r.n_phone == len([x for x in base.split(",") if x])


def test_pii_context_and_redaction():
    kinds = lambda t: [k for k, *_ in pii.find_spans(t)]
    assert kinds("GB82 WEST 1234 5698 7654 32") == ["iban"] and kinds("GB83 WEST 1234 5698 7654 32") == []
    assert kinds("call 555-123-4567") == ["local_phone"] and kinds("part 555-123-4567") == []
    assert pii.redact("mail a@b.co now") == "mail <EMAIL> now" and pii.redact(None) is None


# --------------------------------------------------------------------- op2, op6


def embeddings(spark, n=240, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[40:80] = x[39] + rng.normal(size=(40, dim)).astype(np.float32) * 0.03
    x[100:110] = x[99]
    rows = [(i, [float(v) for v in r], int(i % 3) if i < 30 else 1) for i, r in enumerate(x)]
    odd = [(1000, None, 1), (1001, [float("nan")] * dim, 1), (1002, [None] * dim, 1), (1003, [0.0] * dim, 1), (1004, rows[5][1], None), (1020, [1.0], 1)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")


def test_top_k(spark, monkeypatch):
    for name, value in (("DATA_BLOCK", 30), ("QUERY_BLOCK", 5)):
        monkeypatch.setattr(vectors, name, value)
    df = embeddings(spark)
    good = {r.vec_id: np.floor(64 * np.pad(np.array(r.embedding, float), (0, 8 - len(r.embedding)))).astype(int) for r in df.collect() if r.embedding and all(v is not None and np.isfinite(v) for v in r.embedding)}
    want = []
    for q in good:
        if q % 20 == 0:
            order = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q))[:20]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(order)]
    assert sorted(tuple(r) for r in vectors.top_k(df).collect()) == sorted(want)
    assert vectors.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("sample, cells", [(4096, 256), (25, 3)])
def test_top_k_equals_its_sql(spark, monkeypatch, sample, cells):
    """Repeated ids and rows, ties at the last place, few distinct values, clashing columns."""
    import duckdb

    for name, value in (("DATA_BLOCK", 30), ("QUERY_BLOCK", 5), ("SAMPLE", sample), ("STEP", 2), ("CELLS", cells)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(v) for v in rng.integers(-2, 3, 6) / 4]) for i in rng.integers(-40, 160, 300)]
    rows += rows[:20] + [(0, rows[0][1])] * 25 + [(7, None), (20, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("copies", F.lit(2))
    got = sorted(tuple(r) for r in vectors.top_k(df).collect())
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    assert got == sorted(con.execute(llm_queries.oracle_sql()["op2_top_k"]).fetchall())


def test_near_duplicate_vectors_repeated_rows(spark):
    df = embeddings(spark).where("vec_id < 70")
    df = df.unionAll(df.limit(20)).withColumn("cell", F.lit(1)).withColumn("key", F.lit("k")).withColumn("least", F.lit(0))
    got = vectors.near_duplicate_vectors(df).collect()
    assert len(got) == df.count()
    first = {r.vec_id for r in df.limit(20).collect()}
    assert all(r.n_links >= 1 for r in got if r.vec_id in first and r.vec_id < 30)


def test_near_duplicate_vectors(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("ROWS_PER_CELL", 40)):
        monkeypatch.setattr(vectors, name, value)
    df = embeddings(spark)
    rows = df.collect()
    unit = {}
    for r in rows:
        v = np.array([x if x is not None else np.nan for x in r.embedding or []], float)
        if r.label is not None and len(v) and np.isfinite(v).all() and v.any():
            unit[r.vec_id] = (r.label, np.pad(v, (0, 8 - len(v))) / np.linalg.norm(v))
    links = [(a, b) for a in unit for b in unit if a < b and unit[a][0] == unit[b][0] and unit[a][1] @ unit[b][1] >= 0.98]
    comp = roots(links, [r.vec_id for r in rows])
    want = {r.vec_id: (sum(r.vec_id in p for p in links), comp[r.vec_id], comp[r.vec_id] == r.vec_id) for r in rows}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicate_vectors(df).collect()}
    assert len(links) > 100 and got == want
    assert vectors.near_duplicate_vectors(df.limit(0)).count() == 0


# -------------------------------------------------------------------------- op3


def test_simhash_links(spark, monkeypatch):
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = {f ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for f in base for _ in range(6)} | set(base)
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    near = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2]
    for most in (32, 2):
        monkeypatch.setattr(simhash, "MAX_POSTING", most)
        got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
        assert all(((a ^ b) % (1 << 64)).bit_count() <= 2 for a, b in got)
        assert roots(got, fps) == roots(near, fps)


def test_simhash_rows(spark):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, ODD)).collect()}
    assert len(got) == len(ODD) and got[0].fingerprint == "0" * 16 and got[1].component_id == got[2].component_id == 0
    assert got[8].component_id == 7


def test_similar_texts_keep_one(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(12):
        w = [word() for _ in range(300)]
        texts += [" ".join(w), " ".join(w[:100] + ["other"] + w[101:]), " ".join(word() for _ in range(300))]
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs(spark, texts)).collect()}
    assert kept == {i for i in range(36) if i % 3 != 1}


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_against_brute_force(spark):
    rnd = random.Random(21)
    texts = [t for t in ODD if len(t or "") < 9000] + ["".join(rnd.choice("aB é\u00a0\x0b\x85\n中") for _ in range(rnd.randrange(90))) for _ in range(80)]
    texts += [t.swapcase() for t in texts[-10:]] + [texts[-1] + " tail"]
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    comp = roots([(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2], fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert got == {i: (f"{f:016x}", comp[i]) for i, f in fps.items()}


@pytest.mark.parametrize("each, rounds", [(4, 6), (0, 2), (0, 0)])
def test_large_group_of_near_copies(spark, monkeypatch, each, rounds):
    """Members of one large group whose texts are at 0.7 to 1, and strangers that share its words."""
    monkeypatch.setattr(simhash, "PAIRS_EACH", each)
    monkeypatch.setattr(simhash, "ROUNDS", rounds)
    rnd = random.Random(22)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(60)]
    texts = []
    for k in range(160):
        w = list(base)
        for _ in range(rnd.randrange(3)):
            w[rnd.randrange(60)] = word()
        texts.append(" ".join(w if k % 8 else w[:30] + [word() for _ in range(30)]))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs(spark, texts)).collect()}
    assert got == base_groups(texts)


def test_small_sets_are_compared_as_sets(spark):
    rnd = random.Random(9)
    texts = []
    for _ in range(30):  # 4 of 5 shingles shared; 3 of 5
        w = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(9)]
        texts += [" ".join(w[:8]), " ".join(w)]
    pairs = {r.doc_id: r.component_id for r in simhash.similar_groups(docs(spark, [*texts, "a b c d e f g", "a b c d e x y"])).collect()}
    assert all(pairs[i + 1] == i for i in range(0, 60, 2)) and pairs[61] == 61
    assert all(pairs[i] == i for i in range(0, 61, 2))


def base_groups(texts, words=5):
    """Components of all pairs at 0.8 or more."""
    sets = [{tuple(t.split()[i : i + words]) for i in range(max(1, len(t.split()) - words + 1))} for t in texts]
    return roots([(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])], range(len(sets)))


def test_all_small_pairs_are_found(spark):
    rnd = random.Random(9)
    texts = []
    for k in range(60):  # 4 of 5 shingles shared; 12 of 15
        w = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(19)]
        texts += [" ".join(w[:8]), " ".join(w[:9])] if k % 2 else [" ".join(w[:16]), " ".join(w)]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs(spark, texts)).collect()}
    assert got == base_groups(texts) == {i: i - i % 2 for i in range(120)}


@pytest.mark.parametrize("common, each", [(1, 64), (16, 64), (16, 0)])
def test_copies_among_texts_of_one_template(spark, monkeypatch, common, each):
    """Many texts share a passage and are at about 0.72; the copies among them are found."""
    monkeypatch.setattr(simhash, "ORDER_SAMPLE", common)
    monkeypatch.setattr(simhash, "PAIRS_EACH", each)
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(252)]
    own = [[word() for _ in range(48)] for _ in range(200)]
    texts = [" ".join(passage + w) for w in own] + [" ".join(passage + w[:20] + [word() for _ in range(28)]) for w in own[::4]]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs(spark, texts)).collect()}
    assert got == base_groups(texts) and len(set(got.values())) == 200


def test_one_shingle_in_many_unlike_texts(spark, monkeypatch):
    """A shingle that 20,000 unlike texts post parts into keys with few pairs; their near copies are found."""
    monkeypatch.setattr(simhash, "ORDER_MOST", 1)
    rnd = random.Random(5)
    memo, word = simhash._WordHash(), lambda: "".join(rnd.choice("abcdefgh") for _ in range(7))
    shared = min((" ".join(word() for _ in range(5)) for _ in range(3000)), key=lambda t: simhash._shingles(t, 5, memo)[0])
    texts = [" ".join([shared, *(word() for _ in range(9 + i % 40))]) for i in range(20_000)]
    near = {20_000 + k: i for k, i in enumerate(range(0, 20_000, 50))}
    texts += [texts[i] + " tail" for i in near.values()]
    pairs = []
    across = simhash.rest_pairs

    def counted(*args):
        out = across(*args)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(simhash, "rest_pairs", counted)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs(spark, texts)).collect()}
    assert got == {i: near.get(i, i) for i in range(len(texts))}
    assert sum(pairs) < len(texts)


@pytest.mark.parametrize("seed", range(3))
def test_splits_of_postings_lose_no_pair(spark, monkeypatch, seed):
    """Texts of a few words in many orders, where every posting is split as far as it goes."""
    monkeypatch.setattr(simhash, "PAIRS_EACH", 0)
    monkeypatch.setattr(simhash, "ROUNDS", 0)
    rnd = random.Random(seed)
    lines = [" ".join(rnd.choice("abcdefghijklmn") for _ in range(8)) for _ in range(14)]
    texts = [" ".join(rnd.sample(lines, rnd.choice([2, 5, 6, 7]))) for _ in range(250)]
    texts += [t + " x" * rnd.randrange(4) for t in texts[:60]]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs(spark, texts)).collect()}
    assert got == base_groups(texts)


# -------------------------------------------------------------------------- op4


def test_mixing(spark):
    rows = spark.range(1500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"))
    out = mixing.mix(rows, block_rows=4).toPandas()
    weights = {r.source: r.w for r in mixing.integer_weights(rows.groupBy("source").agg(F.count("*").alias("n"))).collect()}
    assert out.doc_id.nunique() == 1500 and sum(weights.values()) == mixing.PERIOD
    out["source"] = out.source.where(out.source.notna(), None)
    blocks = out.drop_duplicates(["source", "mix_block"]).sort_values("mix_slot")
    assert blocks.mix_slot.tolist() == list(range(len(blocks)))
    assert ((blocks.mix_release <= blocks.mix_slot) & (blocks.mix_slot < blocks.mix_deadline)).all()
    had = dict.fromkeys(weights, 0)
    for t, s in enumerate(blocks.source, 1):
        had[s] += 1
        assert all(abs(had[k] - t * w / mixing.PERIOD) < 1 for k, w in weights.items())
    # rows, not only blocks: every block but the last of all is full, also where an epoch ends
    sizes = out.groupby("mix_slot").size()
    assert (sizes.iloc[:-1] == 4).all() and (out.groupby(["source", "doc_id"], dropna=False).mix_epoch.max() > 0).any()
    assert mixing.mix(rows.limit(0)).count() == 0


def test_mixing_small_source_keeps_its_share_of_rows(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 17, "few").otherwise("many").alias("source"))
    out = mixing.mix(rows, targets={"few": 0.04, "many": 0.96}).toPandas().sort_values(["mix_slot", "doc_id"])
    assert out.doc_id.nunique() == 2000
    had = (out.source == "few").cumsum().to_numpy()
    assert np.abs(had - 0.04 * np.arange(1, len(had) + 1)).max() <= 16 and abs(had[-1] / len(had) - 0.04) < 0.01
    # a source without a target has the least weight
    weights = {r.source: r.w for r in mixing.integer_weights(rows.groupBy("source").agg(F.count("*").alias("n")), targets={"many": 3}).collect()}
    assert weights == {"few": 1, "many": 999}


def test_mixing_more_sources_than_slots(spark):
    rows = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "hot").otherwise(F.col("id").cast("string")).alias("source"))
    out = mixing.mix(rows, block_rows=2, period=100).select("doc_id", "source", "mix_slot", "mix_release", "mix_deadline").toPandas()
    assert out.doc_id.nunique() == 9000
    assert ((out.mix_release <= out.mix_slot) & (out.mix_slot < out.mix_deadline)).all()
    assert sorted(out.mix_slot.unique()) == list(range(out.mix_slot.max() + 1))


def test_mixing_clashing_columns(spark):
    names = ["_key", "_rank", "_block", "_source", "_before", "row", "of", "part", "rank", "n", "w", "period", "slots", "mix_slot", "a.b"]
    rows = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), *[F.concat(F.lit(f"{c}-"), "id").alias(c) for c in names])
    out = mixing.mix(rows)
    assert out.columns == ["doc_id", "source", *[c for c in names if c != "mix_slot"], *mixing.PLACES]
    for r in out.collect():
        assert all(r[c] == f"{c}-{r.doc_id}" for c in names if c != "mix_slot")


# -------------------------------------------------------------------------- op5


@pytest.mark.parametrize("local", [1000, 1])
def test_repeats(spark, monkeypatch, local):
    monkeypatch.setattr(suffixes, "MOST_LOCAL", local)
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    passage, line = text(180), text(60)
    texts = ODD[:4] + ["z" * 400, "ab" * 300] + [text(rnd.randrange(0, 300)) + rnd.choice([passage, line, passage[:130], ""]) + text(rnd.randrange(0, 200)) for _ in range(80)]
    texts += texts[10:14]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(raw[p : p + 100])
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        want[i] = (len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(docs(spark, texts)).collect()}
    assert got == want
    twice = suffixes.remove_repeats(docs(spark, ["q" * 150, "q" * 150], [5, 5])).collect()
    assert sorted(r.n_removed for r in twice) == [149, 150]


def test_repeats_of_rows_without_an_id(spark):
    """Many rows of one id, null ids beside the least one, and equal rows."""
    many = spark.range(70_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("n"), F.col("id") % 9).alias("text"))
    few = spark.createDataFrame([(None, "w" * 99 + "v" * 120), (-(1 << 63), "w" * 99 + "v" * 120), (3, "x" + "v" * 120), (3, "y" + "v" * 120)] + [(None, "u" + "v" * 110)] * 5, "doc_id long, text string")
    out = suffixes.remove_repeats(many.unionAll(few).withColumn("copy", F.lit(1)).withColumn("place", F.lit(1)), keep_text=True)
    assert out.count() == 70_009
    long_ = out.where("n_bytes > 9").collect()
    # each string starts first in one row of the null and least ids; the rows of id 3 keep their first byte
    assert sum(r.doc_id is None for r in long_) == 6 and [bytes(r.kept) for r in long_ if r.doc_id == 3] in ([b"x", b"y"], [b"y", b"x"])
    assert sorted(r.n_removed for r in long_ if r.n_bytes == 111)[1:] == [111] * 4 and out.where("n_bytes <= 9 and n_removed > 0").count() == 0


# -------------------------------------------------------------------------- op7


@pytest.mark.parametrize("most", [html_extract.BROADCAST_BYTES, 0])
def test_html(spark, monkeypatch, most):
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", most)
    page = lambda i: f"<html><head><title>T</title></head><body><header>Site</header><nav><a>Home</a></nav><div class='cookie-notice'>OK?</div><article><h1>Head {i}</h1><p>One&amp;two\n  {i}<br>x<p>Last &eacute;</p><form>f</form><div id=comments>bad</div></article><aside>s</aside><footer>&copy;</footer><script>var a='<p>';</script></body></html>"
    rows = [(i, "http://h.example/x", page(i)) for i in range(4)] + [(10, None, None), (11, "u", ""), (12, "http://z.example/", "<div>plain <b>text</b></div>"), (13, "http://z.example/", "<p>cut <a href='")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert got[2][0] == "Head 2\nOne&two 2 x\nLast é" and got[10] == got[11] == ("", 0) and got[12] == ("plain text", 10) and got[13][0].startswith("cut")


def news(i, rnd):
    """A page of a host whose elements have neither standard names nor marked classes."""
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    paragraphs = [words(30) for _ in range(rnd.randrange(2, 6))]
    links = "".join(f"<li><a href=/{k}>{words(3)}</a></li>" for k in range(8))
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    html = (
        f"<html><body><div class=top>Daily {words(2)}</div><div class=x1><ul>{links}</ul></div><div class=wrap><div class=x2><h2>Story {i}</h2><p class=share-line>Tell your friends</p>"
        f"{body}<p class='related work'>kept {i}</p><section id=search>found {i}</section><div class=comments><p>says {words(9)}</p></div></div></div><div class=x3>{words(6)}</div></body></html>"
    )
    return html, "\n".join([f"Story {i}", *paragraphs, f"kept {i}", f"found {i}"])


@pytest.mark.parametrize("most", [html_extract.BROADCAST_BYTES, 0])
def test_html_template_of_a_host(spark, monkeypatch, most):
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", most)
    rnd = random.Random(31)
    made = [news(i, rnd) for i in range(20)]
    rows = [(i, "http://n.example/", h) for i, (h, _) in enumerate(made)] * 2 + [(99, "http://few.example/", made[0][0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("h")).withColumn("path", F.lit(1)).withColumn("token", F.lit(2))
    out = html_extract.extract(df).collect()
    assert len(out) == 41 and all(r.text == made[r.page_id][1] for r in out if r.page_id != 99)
    # without its host's template the page can't be told from its frame
    alone = html_extract.main_text(made[0][0])
    assert next(r.text for r in out if r.page_id == 99) == alone != made[0][1] and "Tell your friends" in alone and "Daily" in alone


def test_html_pages_of_one_text_keep_it(spark):
    rows = [(i, "http://s.example/", f"<body><div class=a><a>{i}</a></div><article><p>the same</p></article></body>") for i in range(12)]
    got = {r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {"the same"}


def test_html_broken_pages_take_linear_time():
    for part in ("<a ", "<a <a", "<select>", "<!-", "<a href='", "<svg x=\"", "</", "<p <p", "<iframe "):
        began = time.process_time()
        html_extract.main_text(part * (120_000 // len(part)))
        assert time.process_time() - began < 2, part


def test_html_attributes_by_name():
    text = html_extract.main_text
    for attrs in ('style="overflow:hidden"', 'title="hidden gems"', "data-x='id=menu'", "data-hidden", 'title="class=nav"'):
        assert text(f"<body {attrs}><div {attrs}><p>one</p></div></body>") == "one"
    for attrs in ("hidden", 'HIDDEN=""', "aria-hidden=true", 'style="a" hidden', "class='x nav'", "id=menu"):
        assert text(f"<body><div {attrs}><p>one</p></div><p>two</p></body>") == "two"
    assert text('<article><div class="article-header"><h1 class="entry-header">T</h1></div><p>one</p></article>') == "T\none"
    assert text('<body><div class="page-header">T</div><p>one</p></body>') == "one"


# -------------------------------------------------------------------------- op8


def plain_kneser_ney(classes, everything):
    """P(word | before, class) by dictionaries: a function of (class, before, word)."""
    words = lambda t: re.findall(r"\w+", (t or "").lower())

    def discounts(counts):
        c = [1 + sum(1 for n in counts if min(n, 5) == k) for k in (1, 2, 3, 4)]
        y = c[0] / (c[0] + 2 * c[1])
        return [min(max(d, 0.5), top) for d, top in ((1 - 2 * y * c[1] / c[0], 1), (2 - 3 * y * c[2] / c[1], 2), (3 - 4 * y * c[3] / c[2], 3))]

    def cut(n, d):
        return max(n - d[min(n, 3) - 1], 0.0) if n else 0.0

    trigrams = [{(a, b, c) for t in texts for w in [["<", "<", *words(t)]] for a, b, c in zip(w, w[1:], w[2:])} for texts in classes]
    pairs = [{} for _ in range(3)]
    for c, seen in enumerate(trigrams):
        for _, b, w in seen:
            for table in (pairs[c], pairs[2]):
                table[b, w] = table.get((b, w), 0) + 1
    vocabulary = {w for _, w in pairs[2]}
    common, total = {}, 0
    for t in everything:
        for w in words(t):
            total += 1
            common[w] = common.get(w, 0) + 1
    even = toxicity.EVEN / (len(vocabulary) + 1)
    last = {w: (1 - toxicity.EVEN) * common.get(w, 0) / total + even for w in vocabulary}

    def bigram(table, d, b, w, below):
        follow = {x: n for (y, x), n in table.items() if y == b}
        if not follow:
            return below
        all_ = sum(follow.values())
        return cut(follow.get(w, 0), d) / all_ + (1 - sum(cut(n, d) for n in follow.values()) / all_) * below

    tops = [discounts(t.values()) for t in pairs]
    contexts = [{} for _ in range(2)]
    for c in (0, 1):
        for _, w in pairs[c]:
            contexts[c][w] = contexts[c].get(w, 0) + 1
    lows = [discounts(t.values()) for t in contexts]

    def p(c, b, w):
        all_ = sum(contexts[c].values())
        left = 1 - sum(cut(n, lows[c]) for n in contexts[c].values()) / all_
        one = cut(contexts[c].get(w, 0), lows[c]) / all_ + left * last[w]
        return bigram(pairs[c], tops[c], b, w, bigram(pairs[2], tops[2], b, w, one))

    return p, vocabulary


def test_toxicity_model_is_kneser_ney(spark):
    rnd = random.Random(17)
    texts = [" ".join(rnd.choice("abcdefghij") + rnd.choice("xy") for _ in range(rnd.randrange(1, 40))) for _ in range(50)]
    learnt = [i for i in range(50) if 1 <= toxicity.fold(i) <= 3]
    labels = [(i, i % 2) for i in range(50) if toxicity.fold(i)]
    model = toxicity.Model(**toxicity.fit(docs(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")).model.value)
    p, vocabulary = plain_kneser_ney([[texts[i] for i in learnt if i % 2 == c] for c in (0, 1)], [t for i, t in enumerate(texts) if toxicity.fold(i)])
    memo = toxicity._Hash()
    for t in texts:
        w = [x for x in t.split() if x in vocabulary]
        got = model.evidence(toxicity._words(" ".join(w), memo), np.array([0]))
        want = [np.log(p(1, b, x)) - np.log(p(0, b, x)) for b, x in zip(["<", *w], w)]
        assert np.allclose(got, want, atol=1e-5)


def test_toxicity(spark):
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        w = ["w" + str(rnd.randrange(400)) for _ in range(rnd.randrange(5, 200))]
        toxic = rnd.random() < 0.3
        if toxic:
            for bad in rnd.sample(["badone", "badtwo", "badthree"], 2):
                w.insert(rnd.randrange(len(w)), bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    d = spark.createDataFrame(rows + [(9000, None), (9001, "")], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(d, lab).collect()}
    held = [i for i, _ in rows if got[i].held_out]
    assert 0.1 < len(held) / 600 < 0.3 and sum(got[i].predicted == labels[i][1] for i in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and got[9000].score == got[9001].score
    assert toxicity.score_toxicity(d, lab.limit(0)).count() == 602


# -------------------------------------------------------------------------- op9


@pytest.fixture(scope="module")
def coder():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, tokenizers.Tokenizer.from_file(path)


def test_bpe_equals_the_library(spark, coder):
    path, ref = coder
    rnd = random.Random(10)
    texts = ODD + ["".join(rnd.choice("ab éü中😀\n'st1_ 9²") for _ in range(200)) for _ in range(100)] + ["".join(rnd.choice("abcdefgh") for _ in range(40_000)), "=" * 30_000, " " * 9000]
    for r in bpe.encode_documents(docs(spark, texts), path).collect():
        want = ref.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == ref.decode(want, skip_special_tokens=False) == (texts[r.doc_id] or "")
    for r in bpe.encoding_digest(docs(spark, texts), path).collect():
        want = ref.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())


def test_pipeline_decodes_and_compares(spark, coder):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    texts = [*ODD, "x �\ud7ff 中 é'll"]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.doc_id: r for r in corpus_pipeline.encode(spark, docs(spark, texts), "").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = coder[1].encode(t or "", add_special_tokens=False).ids
        assert (got[i].ids, got[i].n_tokens, got[i].ids_sha256) == (want, len(want), sha(np.array(want, "<u4").tobytes()))
        assert got[i].decoded_sha256 == sha((t or "").encode()) and got[i].same
    wrong = bpe.Bpe(coder[0])
    wrong.token[wrong.byte_id[ord("a")]] = b"b"
    assert bpe._digests(wrong, "a")[2] == sha(b"b")


def test_bpe_window_of_the_lookahead(coder):
    path, ref = coder
    small = bpe.Bpe(path)
    small.window = small.lookahead + max(map(len, small.token.values()))
    rnd = random.Random(11)
    for alphabet in ("ab", "the", "abcdefghijklmnop", "="):
        text = "".join(rnd.choice(alphabet) for _ in range(5000))
        assert list(np.frombuffer(b"".join(small.encode(text)), "<u4")) == ref.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("chars", [20, 64, 1000])
def test_bpe_windows_of_text(coder, monkeypatch, chars):
    """Pieces, contractions, white space and special tokens at the windows' ends."""
    path, ref = coder
    monkeypatch.setattr(bpe, "WINDOW_CHARS", chars)
    one = bpe.Bpe(path)
    rnd = random.Random(19)
    parts = ["it's", "we'll", "'re", "  \n\n ", " " * 70, "word", "12345", "...", "é中", "<|endoftext|>", "x" * 150, "'", "l", "_a", "\t", " I'd"]
    for _ in range(150):
        text = "".join(rnd.choice(parts) + rnd.choice(["", " "]) for _ in range(rnd.randrange(60)))
        ids = np.frombuffer(b"".join(one.encode(text)), "<u4")
        assert ids.tolist() == ref.encode(text, add_special_tokens=False).ids and "".join(one.decode(ids)) == text


def test_bpe_memory_is_constant(coder):
    """A text of 50 MB, with one piece of 2 MB in it: what encoding and decoding hold doesn't follow its length."""
    import tracemalloc

    one = bpe.Bpe(coder[0])
    text = "an unremarkable sentence about internationalisation " * 480_000 + "z" * 2_000_000 + " and so characteristically on " * 800_000
    assert len(text) > 48_000_000
    n, ids, back = bpe._digests(one, text[:500_000])
    tracemalloc.start()
    n, ids, back = bpe._digests(one, text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20 and n > 4_000_000 and back == hashlib.sha256(text.encode()).hexdigest()


# ------------------------------------------------------------------------- op10


@pytest.mark.parametrize("most", [0, 100_000])
def test_warc(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", most)
    monkeypatch.setattr(warc, "ARCHIVES_EACH", 1)
    html = ["<p>a</p>", "", None, "<p>a</p>", "é\r\n\r\nz", "x" * 200_000]
    rows = [(i, f"http://e/{i}", h) for i, h in enumerate(html)] + [(None, None, "<p>a</p>")]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    first = {}
    for i, h in enumerate(html):
        raw = (h or "").encode()
        f = first.setdefault(raw, i)
        assert got[i] == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if f == i else "revisit", None if f == i else f)
    assert got[None][2:] == ("revisit", 0)


@pytest.mark.parametrize("zip64", [True, False])
def test_zip_is_a_zip(zip64):
    out = io.BytesIO()
    w = warc.ZipWriter(out, zip64)
    w.add("one", b"1" * 70_000)
    w.add("zwei/ü", b"two")
    w.close()
    data = out.getvalue()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and z.read("zwei/ü") == b"two"
    r = warc.ZipReader(lambda at, n: data[at : at + n], len(data))
    at, n = r.locate("zwei/ü")
    assert data[at : at + n] == b"two" and r.locate("one")[1] == 70_000
    with pytest.raises(ValueError):
        warc.ZipReader(lambda at, n: b"x" * n, 100)


def test_pipeline(spark, tmp_path, coder):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("bcdefghi") for _ in range(5))
    texts, toxic = {}, {}
    for i in range(400):
        w = [word() for _ in range(rnd.randrange(60, 120))]
        toxic[i] = i % 4 == 0
        if toxic[i]:
            for _ in range(12):
                w.insert(rnd.randrange(len(w)), rnd.choice(["badone", "badtwo"]))
        texts[i] = " ".join(w) + (" mail a@b.co" if i % 5 == 0 else "")
    texts |= {500: texts[1], 501: texts[1] + " more", 502: None, 503: ""}
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(x)) for i, x in toxic.items()]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in got}
    assert {i for i in toxic if not toxic[i]} <= kept and not {i for i in toxic if toxic[i]} & kept
    assert not {500, 501, 503} & kept and 502 in kept
    for r in got:
        assert r.ids == coder[1].encode(pii.redact(texts[r.doc_id]) or "", add_special_tokens=False).ids


def test_pipeline_keeps_the_order_of_the_mixture(spark, tmp_path, coder):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(14)
    rows = [(i, "word " * rnd.randrange(1, 400), "en", "hot" if i % 3 == 0 else f"s{i % 7}", 1) for i in range(3000)]
    spark.createDataFrame(rows, DOC).repartition(8).write.parquet(f"{tmp_path}/in")
    corpus_pipeline.mix_sources(spark, spark.read.parquet(f"{tmp_path}/in"), "").write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    assert mixed.columns == corpus_pipeline.COLUMNS
    want = [r.doc_id for r in mixing.mix(spark.read.parquet(f"{tmp_path}/in")).orderBy("mix_slot", "doc_id").collect()]
    got = [r.doc_id for r in corpus_pipeline.encode(spark, mixed, "").collect()]
    assert got == want
    source = {r[0]: r[3] for r in rows}
    weights = {r.source: r.w for r in mixing.integer_weights(mixed.select("doc_id", "source").distinct().groupBy("source").agg(F.count("*").alias("n"))).collect()}
    had = dict.fromkeys(weights, 0)
    for t, i in enumerate(got, 1):
        had[source[i]] += 1
        assert all(abs(had[k] - t * w / mixing.PERIOD) <= 2 * mixing.BLOCK_ROWS for k, w in weights.items())


def test_clashing_columns_and_empty_tables(spark):
    d = docs(spark, ["some words here", "more"]).withColumn("fp", F.lit(1)).withColumn("key", F.lit("k")).withColumn("place", F.lit(2))
    empty = d.limit(0)
    for op in (pii.pii_report, simhash.near_duplicates, suffixes.remove_repeats, mixing.mix, simhash.drop_near_duplicates, pii.redact_pii):
        assert {r.doc_id for r in op(d).collect()} == {0, 1} and op(empty).count() == 0
