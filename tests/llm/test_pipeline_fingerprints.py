"""The pipeline's near-duplicates come through the fingerprints of op3 as well."""

from colloquy.llm import simhash


def test_documents_linked_by_fingerprints_alone_keep_one(spark):
    line = " ".join(f"w{i}" for i in range(13))
    texts = [" ".join([line] * 60 + [f"{c}{i}" for i in range(8)]) for c in "ab"] + ["other words than those of the lines above"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in simhash.near_duplicates(d).where("doc_id = component_id").orderBy("doc_id").collect()] == [0, 2]
    assert [r.doc_id for r in simhash.similar_groups(d).where("doc_id = component_id").orderBy("doc_id").collect()] == [0, 1, 2]
    assert [r.doc_id for r in simhash.drop_near_duplicates(d).orderBy("doc_id").collect()] == [0, 2]
