"""What larger tables showed: wide numbers, rare segments, memory and plans."""

import tracemalloc

import duckdb
import numpy as np
import pytest

from colloquy.operators import clusters as C
from colloquy.operators import intervals as I
from colloquy.operators import translate as X
from colloquy.operators import turns as W
from colloquy.plans import queries as Q
from colloquy.plans.fixtures import Fixtures
from colloquy.sources import outputs


def test_nearest_takes_numbers_over_an_integer(spark):
    big = 5_000_000_000
    words = spark.createDataFrame([(0, big, 1.0, 2.0), (0, big + 1, 8.0, 9.0), (1, big, 1.0, 2.0), (0, big, 5.0, 5.0)], "rec_id long, word_ix long, start double, end double")
    windows = spark.createDataFrame([(0, 0, 1.0, 7), (0, 1, 9.0, 8)], "rec_id long, win_ix int, center double, label int")
    got = sorted((r.rec_id, r.word_ix, r.start, r.speaker) for r in I.assign_nearest(words, windows).collect())
    # a midpoint between two centers goes to the first window; a recording without windows has one speaker
    assert got == [(0, big, 1.0, "SPEAKER_01"), (0, big, 5.0, "SPEAKER_01"), (0, big + 1, 8.0, "SPEAKER_02"), (1, big, 1.0, "SPEAKER_01")]


@pytest.mark.parametrize("name", ["a1_a2_collect_words", "s2_read_asr", "st1_stream_ingest"])
def test_a_segment_whose_words_all_lack_times(spark, tmp_path, name):
    """Every word of three letters lacks its end in these views; the text of such a segment isn't taken for a word."""
    rows = [(1, 0, "user", "the cat sat"), (1, 1, "assistant", "well, the cat slept."), (1, 3, "user", "one two"), (2, 0, "user", "and now"), (3, 0, "user", "yes more words")]
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(path)
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{path}/*.parquet'")
    want = con.sql(Q.oracle_sql()[name])
    got = Q.queries()[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_neighbour_graph_holds_few_products_at_once():
    x = C.units(np.random.default_rng(3).normal(size=(3000, 8)))
    tracemalloc.start()
    got = C._graph(x, C.NEIGHBOURS)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # all products of two windows are 72 MB
    assert most < 40 << 20
    near = np.argsort(-(x @ x.T - 3 * np.eye(len(x))), axis=1, kind="stable")[:, : C.NEIGHBOURS - 1]
    want = {}
    for i, row in enumerate(near.tolist()):
        for j in row:
            want[i, j], want[j, i] = want.get((i, j), 0) + 0.5, want.get((j, i), 0) + 0.5
    assert {(a, b): w for a, b, w in zip(*(v.tolist() for v in got))} == want


def test_smoothing_sorts_words_once_and_words_are_dealt_to_many_tasks(spark, tmp_path):
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame([(c, 0, "user", "some words of a turn") for c in range(50)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(path)
    words = spark.createDataFrame([("r", 0, "a", 0.0, 0.1)], "rec_id string, word_ix int, speaker string, start double, end double")
    plan = W.smooth_speakers(words)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1
    assert Fixtures(spark, str(tmp_path)).words().rdd.getNumPartitions() >= 16


def test_files_are_written_by_small_batches(spark, tmp_path):
    def sized(frames):
        for pdf in frames:
            yield pdf.assign(content=str(len(pdf)))

    rows = spark.range(450).coalesce(1).selectExpr("concat(id, '.txt') name", "'x' content")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    outputs.write_files(rows.mapInPandas(sized, "name string, content string"), str(tmp_path))
    sizes = {int(f.read_text()) for f in tmp_path.glob("*.txt")}
    assert len(list(tmp_path.glob("*.txt"))) == 450 and max(sizes) <= outputs.BATCH_ROWS and spark.conf.get(key) == before


def test_a_piece_is_cleaned_before_it_meets_the_turns(spark):
    turns = spark.createDataFrame([("r", i, "Same words here. Same words here.", "") for i in range(3)], "rec_id string, turn_ix int, text string, text_zh string")
    out = X.translate_turns(turns, None, lambda some: ["譯。。。 沒有任何樓盤符合您的搜尋結果" for _ in some])
    assert [r.text_zh for r in out.collect()] == ["譯。譯。"] * 3
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joined = next(line for line in plan.splitlines() if "collect_list" in line)
    assert "regexp_replace" not in plan[plan.index(joined) + len(joined) :].split("Join LeftOuter")[0]
