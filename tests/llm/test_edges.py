"""Odd tables: empty ones, columns whose names clash, repeated rows, very long texts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from colloquy.llm import bpe, html_extract, simhash, toxicity, warc

LABELS = "doc_id long, toxic int"


def toxic_table(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice("abcdefghij") + rnd.choice("xyz") for _ in range(40)) + (" vile words" if i % 4 == 0 else "")) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], LABELS)


def test_toxicity_edges(spark):
    d, labels = toxic_table(spark)
    model = toxicity.fit(d, labels)
    long_ = "plain " * 400_000
    odd = spark.createDataFrame([(900, None), (901, ""), (902, long_), (903, long_ + "vile words"), (None, "vile words"), (904, "vile words"), (904, "vile words")], "doc_id long, text string")
    for c in ("score", "predicted", "held_out", "fold", "toxic", "at"):
        odd = odd.withColumn(c, F.lit("own"))
    got = [(r.doc_id, r.score) for r in toxicity.score_toxicity(odd, labels, model).collect()]
    score = dict(got)
    assert len(got) == 7 and score[900] == score[901] and score[903] > score[902] and score[904] == score[None] and sum(i == 904 for i, _ in got) == 2
    kept = toxicity.reject_toxic(odd, labels, model)
    assert kept.columns == odd.columns and {r.score for r in kept.collect()} == {"own"}
    # no documents, no labels
    assert toxicity.score_toxicity(d.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(d, labels.limit(0)).collect()} == {toxicity.score_toxicity(d.limit(1), labels.limit(0)).first().score}


def test_bpe_edges(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    d = spark.createDataFrame([(1, "one"), (1, "one"), (None, "two"), (2, None), (3, "")], "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("n_tokens", F.lit("y"))
    got = sorted((r.doc_id or -1, r.n_tokens, r.decoded_sha256) for r in bpe.encoding_digest(d, path).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert [g[2] for g in got] == [sha("two"), sha("one"), sha("one"), sha(""), sha("")] and [g[1] for g in got][-2:] == [0, 0]
    assert bpe.encoding_digest(d.limit(0), path).count() == 0 and bpe.encode_and_check(d.limit(0), path).count() == 0


@pytest.mark.parametrize("most", [0, 100_000])
def test_warc_edges(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", most)
    d = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (2, "u", "a")], "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("record_type", F.lit(2)).withColumn("member", F.lit(3))
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(d).collect())
    assert got == [(1, "response", None), (2, "revisit", 1), (2, "revisit", 1)]
    assert warc.round_trip(d.limit(0)).count() == 0


def test_html_of_a_very_long_page(spark):
    html = "<body><nav>" + "<a>x</a>" * 20_000 + "</nav><article>" + "<p>word word</p>" * 60_000 + "</article></body>"
    row = html_extract.extract(spark.createDataFrame([(1, None, html)], "page_id long, url string, html string")).first()
    assert row.n_chars == 60_000 * 10 - 1


def test_near_duplicates_edges(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (1, text + " more"), (2, text), (None, text), (None, None), (3, None), (4, ""), (5, "x " * 300_000), (5, "x " * 300_000), (6, "x " * 200_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("id", "mark", "n", "first", "node", "component", "shingle", "component_id"):
        d = d.withColumn(c, F.lit("own"))
    out = simhash.drop_near_duplicates(d)
    assert out.columns == d.columns and sorted(r.doc_id or -1 for r in out.collect()) == [-1, -1, 1, 3, 5]
    assert simhash.drop_near_duplicates(d.limit(0)).count() == 0


def test_pipeline_edges(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, mix_slot string, ids string"
    rows = [(1, None, None, None, None, "a", "b", "c"), (None, "some words", None, None, None, "a", "b", "c"), (2, "", "en", "s", 0, "a", "b", "c"), (3, "mail a@b.co " * 50_000, "en", "s", 1, "a", "b", "c"), (3, "mail a@b.co " * 50_000, "en", "s", 1, "a", "b", "c")]
    for name, some in (("some", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(some, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        # texts without words are one group, and the repeated row is one document; the mixture may repeat rows
        assert {r.doc_id for r in got} == ({None, 1, 3} if some else set()) and all(r.same for r in got)


def test_a_very_long_text_leaves_its_class_the_others(spark, monkeypatch):
    """A text over the sample's bytes is taken last, so the class keeps its other texts; alone it still stands for its class."""
    monkeypatch.setattr(toxicity, "FIT_BYTES", 5_000)
    monkeypatch.setattr(toxicity, "FIT_TEXT", 1_000)
    d, labels = toxic_table(spark)
    first = labels.where("toxic = 1 and crc32(cast(doc_id as string)) % 5 <> 0").orderBy(F.xxhash64("doc_id"), "doc_id").first().doc_id
    d = d.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("vile words "), F.lit(1000))).otherwise(F.col("text")))
    taken = {c: [r.text for r in toxicity._sample(d, labels).where(F.col("toxic") == c).collect()] for c in (0, 1)}
    assert len(taken[1]) > 20 and len(taken[0]) > 20 and max(map(len, taken[1])) < 1_000
    only = toxicity._sample(d.where(F.col("doc_id") == first), labels).collect()
    assert [r.toxic for r in only] == [1]


def test_of_a_repeated_id_the_same_row_stays(spark):
    rows = [(1, " ".join(f"{c}{i}" for i in range(40))) for c in "abcdef"]
    kept = {simhash.drop_near_duplicates(spark.createDataFrame(some, "doc_id long, text string").repartition(n)).first().text for n, some in ((1, rows), (3, rows[::-1]), (5, rows[3:] + rows[:3]))}
    assert len(kept) == 1
