"""What the pipeline's near-duplicates write: texts and whole sets of shingles don't go to disk more than they must."""

import random

import pytest

from colloquy.llm import simhash


def corpus(spark):
    rnd = random.Random(5)
    texts = [" ".join(f"{k}w{rnd.randrange(10_000)}" for _ in range(60)) for k in range(20)]
    return spark.createDataFrame([(i, t + (" more" if i >= 20 else "")) for i, t in enumerate([*texts, *texts])], "doc_id long, text string")


def test_near_duplicates_checkpoint_no_whole_sets(spark, monkeypatch):
    """Sets of proposed pairs are only shuffled to their pairs; before, all were shuffled and checkpointed first."""
    seen, cut = [], simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df: seen.append(df.columns) or cut(df))
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(corpus(spark)).collect()) == list(range(20))
    assert seen and not any("set" in c or "text" in c for c in seen)


def test_near_duplicates_shuffle_no_texts(spark):
    """Where few documents go, the rest are returned without a shuffle of their texts; before, all texts were sorted by id."""
    plan = simhash.drop_near_duplicates(corpus(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Window" not in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("most", [0, 250_000])
def test_near_duplicates_by_shuffle_and_by_broadcast(spark, monkeypatch, most):
    """The same rows stay where ids and pairs are too many for a broadcast; an id of two rows is one document."""
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", most)
    d = corpus(spark)
    again = d.where("doc_id in (3, 7, 21)").unionAll(spark.createDataFrame([(4, "words that no other text has"), (None, "words that no other text has")], d.schema))
    kept = sorted((-1 if r.doc_id is None else r.doc_id) for r in simhash.drop_near_duplicates(d.unionAll(again)).collect())
    assert kept == [-1, *range(20)]
