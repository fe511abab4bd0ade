"""The registered queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm import bpe, fim, html_extract, mixing, periodic, pii, simhash, suffixes, toxicity, vectors, vptree, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii(spark, sf_dir):
    return pii.pii_report(_table(spark, sf_dir, "documents"))


def op2_top_k(spark, sf_dir):
    return vectors.top_k(_table(spark, sf_dir, "embeddings"))


def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_mixing(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"))


def op5_suffixes(spark, sf_dir):
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"), keep_text=False)


def op6_embedding_dups(spark, sf_dir):
    return vectors.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op7_html(spark, sf_dir):
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op8_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_bpe(spark, sf_dir):
    return bpe.encoding_digest(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_warc(spark, sf_dir):
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op11_nearest(spark, sf_dir):
    return vptree.nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op12_fim(spark, sf_dir):
    return fim.digest(_table(spark, sf_dir, "documents"))


def op13_periodic(spark, sf_dir):
    return periodic.digest(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_pii, op2_top_k, op3_simhash, op4_mixing, op5_suffixes, op6_embedding_dups, op7_html, op8_toxicity, op9_bpe, op10_warc, op11_nearest, op12_fim, op13_periodic)}


_OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 20
"""

_OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, payload, sha1(payload) AS h,
             min(page_id) OVER (PARTITION BY payload) AS first_id FROM p),
b AS (SELECT *, list_reduce(list_transform(range(0, 160), lambda i: CAST(
        (instr('0123456789abcdef', substr(h, CAST(i // 4 + 1 AS INTEGER), 1)) - 1) >> CAST(3 - i % 4 AS INTEGER) & 1 AS VARCHAR)), lambda x, y: x || y) AS bits FROM d),
e AS (SELECT *, list_reduce(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
        16 * CAST(substr(bits, CAST(5*k+1 AS INTEGER), 1) AS INTEGER) + 8 * CAST(substr(bits, CAST(5*k+2 AS INTEGER), 1) AS INTEGER) + 4 * CAST(substr(bits, CAST(5*k+3 AS INTEGER), 1) AS INTEGER) +
        2 * CAST(substr(bits, CAST(5*k+4 AS INTEGER), 1) AS INTEGER) + CAST(substr(bits, CAST(5*k+5 AS INTEGER), 1) AS INTEGER) AS INTEGER), 1)), lambda x, y: x || y) AS payload_digest FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to FROM e
"""


_OP12_SQL = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
         list_transform(range(0, 4), lambda i: CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), CAST(8 * i + 1 AS INTEGER), 8) AS BIGINT)) AS h FROM documents),
r AS (SELECT *, CAST(len(w) AS BIGINT) AS n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS b FROM h),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
             array_to_string(w[1 : a], '') AS p, array_to_string(w[a + 1 : b], '') AS m, array_to_string(w[b + 1 : n], '') AS s FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_top_k": _OP2_SQL, "op10_warc": _OP10_SQL, "op12_fim": _OP12_SQL}
