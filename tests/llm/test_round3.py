"""Nearest neighbours, fill-in-the-middle and periodic runs against brute force, and odd rows."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import fim, periodic, vptree
from colloquy.llm import queries as llm_queries

DATA = "/root/testdata/sf0.01"
ODD = [None, "", " \n\t", "a", "word " * 30_000, "é" * 500, "\x00\x1c", "same text here", "same text here", "a <P> b c", "<S", "M> <", " lead", "trail ", "😀 'll  \n x\x0by\x0cz\x85q r"]


# ------------------------------------------------------------------------- op11


def nearest_by_hand(rows, k=10, every=100):
    """``{(query_id, vector): [(vec_id, distance)]}`` over all rows of another id."""
    rows = [(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    dim = max((len(v) for _, v in rows), default=0)
    x, ids = np.array([v + (0.0,) * (dim - len(v)) for _, v in rows]), np.array([i for i, _ in rows])
    out = {}
    for i, q in {(i, tuple(p)) for i, p in zip(ids.tolist(), x.tolist()) if i % every == 0}:
        d = np.sqrt(((x - np.array(q)) ** 2).sum(1))
        best = sorted((dist, c) for dist, c in zip(d.tolist(), ids.tolist()) if c != i)[:k]
        out[i, q] = [(c, dist) for dist, c in best]
    return out


def check_nearest(got, want):
    lists = {}
    for r in got:
        lists.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(lists) == {i for i, _ in want}
    for i, rows in lists.items():
        expected = sorted((n + 1, c, d) for (j, _), best in want.items() if j == i for n, (c, d) in enumerate(best))
        rows.sort()
        assert [r[:2] for r in rows] == [e[:2] for e in expected] and np.allclose([r[2] for r in rows], [e[2] for e in expected], rtol=1e-12)


def test_factor_one_is_exact(spark):
    """Many shards, clusters, ties, groups of copies over a third of the rows, and rows that take no part."""
    rnd = np.random.default_rng(4)
    middle = rnd.normal(size=(12, 8)) * 4
    rows = [(i, (middle[i % 12] + rnd.normal(size=8)).tolist()) for i in range(2500)]
    rows += [(i, [1.0] * 8) for i in range(2500, 3900)] + [(i, np.round(rnd.normal(size=8)).tolist()) for i in range(3900, 4600)]
    rows += [(4600, None), (4700, []), (4800, [0.0] * 8), (4900, [1.0, None]), (5000, [float("nan")] * 8), (5100, [float("inf")] * 8), (5200, [2.0, 3.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("own")).withColumn("cell", F.lit(1)).repartition(7)
    got = vptree.nearest_neighbours(df, factor=1.0, shard_bytes=64 * 200)
    check_nearest(got.collect(), nearest_by_hand(rows))


def test_copies_are_ranked_by_id_with_any_factor(spark):
    rows = [(i, [3.0, 4.0]) for i in range(900)] + [(i, [float(i), 1.0]) for i in range(900, 1100)]
    got = vptree.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5), shard_bytes=8 * 128).where("query_id = 300").orderBy("rank").collect()
    assert [(r.rank, r.vec_id, r.score) for r in got] == [(n + 1, n, 0.0) for n in range(10)]


def test_nearest_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert vptree.nearest_neighbours(spark.createDataFrame([], schema)).count() == 0
    assert vptree.nearest_neighbours(spark.createDataFrame([(100, [1.0])], schema)).count() == 0
    # a repeated id: other vectors ask on their own, equal rows once, and none is a candidate of the other
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (100, [0.0, 1.0]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [0.0, 2.0])]
    got = [(r.rank, r.vec_id) for r in vptree.nearest_neighbours(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got) == sorted([(1, 1), (2, 1), (3, 2)] + [(1, 2), (2, 1), (3, 1)])
    # what squares can't hold
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e199]), (2, [-1e200, 0.0]), (100, [1e-200, 1e-200]), (3, [1e-200, 3e-200])]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in vptree.nearest_neighbours(spark.createDataFrame(rows, schema)).collect()}
    assert got[0, 1] == (1, pytest.approx(1e199)) and got[100, 1] == (3, pytest.approx(2e-200)) and got[0, 4] == (2, pytest.approx(2e200))


@pytest.mark.parametrize("shard_bytes", [vptree.SHARD_BYTES, 64 * 4 * 128])
def test_recall_on_the_given_table(spark, shard_bytes):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    want = nearest_by_hand([(r.vec_id, r.embedding) for r in df.collect()])
    got = {}
    for r in vptree.nearest_neighbours(df, shard_bytes=shard_bytes).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = [len({c for c, _ in best} & set(got[i])) / len(best) for (i, _), best in want.items()]
    assert np.mean(hits) >= 0.9 and all(len(v) == 10 for v in got.values())


def test_factor_saves_distances():
    rnd = np.random.default_rng(2)
    x = (rnd.normal(size=(40, 6)) * 5)[np.arange(4000) % 40] + rnd.normal(size=(4000, 6))
    tree, q = vptree.Tree.of(x, np.arange(4000)), x[::100]
    exact, loose = (tree.search(np.arange(0, 4000, 100), q, np.full(40, np.inf), 10, f) for f in (1.0, 2.0))
    want = np.argsort(vptree.distances(q, x) + np.where(np.arange(4000) == np.arange(0, 4000, 100)[:, None], np.inf, 0), axis=1, kind="stable")[:, :10]
    assert (np.sort(exact[0]) == np.sort(want)).all()
    assert exact[2] < 0.5 * 40 * 4000 and loose[2] < exact[2] and np.mean([len(set(a) & set(b)) for a, b in zip(loose[0], want)]) >= 9


# ------------------------------------------------------------------------- op12

_TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def filled_by_hand(doc_id, text):
    text = text or ""
    w = _TOKEN.findall(text)
    h = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return (doc_id, len(w), "plain", None, None, sha(text), sha(text))
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    p, m, s = ("".join(x) for x in (w[:a], w[a:b], w[b:]))
    form = "spm" if h4 % 100 < 80 else "psm"
    return (doc_id, len(w), form, len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text))


def test_fim_equals_brute_force(spark):
    rnd = random.Random(3)
    texts = ODD + ["".join(rnd.choice(["a", "bé", " ", "\n", "😀", "<", "P>", "\t"]) for _ in range(rnd.randrange(0, 400))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit("own")).withColumn("form", F.lit(1))
    got = sorted(tuple(r) for r in fim.digest(df).collect())
    assert got == [filled_by_hand(i, t) for i, t in enumerate(texts)] and {g[2] for g in got} == {"plain", "psm", "spm"}
    outputs = {r.doc_id: r for r in fim.fill_in_middle(df, rate=100).collect()}
    assert all(fim.restore(outputs[i].output, outputs[i].form) == (t or "") for i, t in enumerate(texts)) and outputs[9].form == "plain"
    assert fim.digest(df.limit(0)).count() == 0
    rows = fim.digest(spark.createDataFrame([(None, "a b"), (1, "x y"), (1, "x y")], "doc_id long, text string")).collect()
    assert len(rows) == 3 and rows[1] == rows[2] and rows[0].n == 2


def test_skip_list_reaches_every_rank():
    rnd = random.Random(1)
    for n in (0, 1, 15, 16, 17, 256, 257, 3000):
        widths = np.array([rnd.randrange(0, 9) for _ in range(n)], np.int64)
        tokens, want = fim.SkipList(widths), np.concatenate([[0], np.cumsum(widths)])
        assert [tokens.offset(r) for r in range(n + 1)] == want.tolist() and len(tokens.lanes) <= 4
    for window in (1, 2, 3, 7):
        for t in ODD[1:4] + ODD[6:]:
            assert fim.token_widths(t, window).tolist() == [len(x) for x in _TOKEN.findall(t)]


def test_fim_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.sql(llm_queries.oracle_sql()["op12_fim"])
    got = llm_queries.op12_fim(spark, DATA).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


# ------------------------------------------------------------------------- op13


def runs_by_hand(w):
    """Every maximal stretch of every period, kept if that period is its smallest."""
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(24, 3 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed_by_hand(doc_id, text, plant=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def repetitive(rnd):
    """Texts of few words, with powers of powers, overlapping runs and runs that a word breaks."""
    words = [f"w{i}" for i in range(rnd.choice([1, 2, 3, 30]))]
    out = []
    while len(out) < rnd.randrange(1, 260):
        unit = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 5, 8, 13, 17, 33, 40]))]
        out += (unit * rnd.randrange(1, 6))[: rnd.randrange(1, 200)]
        if rnd.random() < 0.3:
            out.append(f"x{rnd.randrange(50)}")
    return out


def test_runs_equal_brute_force():
    rnd = random.Random(7)
    seen = 0
    for _ in range(400):
        w = repetitive(rnd)
        ids = periodic.words_of(" ".join(w))[0]
        got = periodic.runs_of(ids)
        assert got == runs_by_hand(w)
        seen += len(got)
    assert seen > 400


def test_collapse_equals_brute_force(spark):
    rnd = random.Random(9)
    texts = ODD + [" ".join(repetitive(rnd)) for _ in range(120)] + [" ".join(rnd.choice("abcdefghijklmnop") + rnd.choice("xyz") for _ in range(rnd.randrange(1, 150))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("start", F.lit("own")).withColumn("n_runs", F.lit(1))
    small = df.where("doc_id <> 4")
    got = {r.doc_id: tuple(r) for r in periodic.digest(df).collect()}
    assert len(got) == len(texts) and got[4][1:6] == (1, 0, 30_000, 1, 30_000_000)
    assert all(got[i] == collapsed_by_hand(i, t) for i, t in enumerate(texts) if i != 4)
    assert sum(g[1] > 0 for g in got.values()) > 60
    plain = {r.doc_id: (r.n_runs, hashlib.sha256(r.text.encode()).hexdigest()) for r in periodic.collapse(small).collect()}
    assert all(plain[i] == (w[1], w[7]) for i, t in enumerate(texts) if i != 4 for w in (collapsed_by_hand(i, t, False),))
    assert periodic.digest(df.limit(0)).count() == 0
    rows = periodic.digest(spark.createDataFrame([(None, "a b"), (1, "x y"), (1, "x y")], "doc_id long, text string")).collect()
    assert len(rows) == 3 and rows[1] == rows[2]


def test_words_in_windows():
    for window in (1, 3, 10):
        for t in ODD[1:4] + ODD[6:]:
            ids, starts, ends = periodic.words_of(t, window)
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            assert [t[a:b] for a, b in zip(starts, ends)] == w and [w.index(x) for x in w] == [w.index(w[ids.tolist().index(i)]) for i in ids.tolist()]


def test_runs_of_a_long_text_are_found_in_time():
    """200,000 words of a small vocabulary with one run of a long period: no quadratic scan."""
    rnd = np.random.default_rng(1)
    ids = rnd.integers(0, 40, 200_000)
    ids[50_000:140_000] = np.resize(ids[50_000:75_000], 90_000)
    runs = periodic.runs_of(ids)
    assert len(runs) == 1 and runs[0][2] == 25_000 and runs[0][0] <= 50_000 and runs[0][1] >= 90_000


# -------------------------------------------------------------------------- op2


def best_by_hand(rows, k=20, every=20):
    """``[(query_id, rank, vec_id, score)]`` with integers of any size; scores are given as the nearest long."""
    whole = [(i, [64 * n // d for n, d in (float(c).as_integer_ratio() for c in v)]) for i, v in rows]
    out = []
    for i, q in whole:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in whole if j != i)[:k]
            out += [(i, n + 1, j, min(max(-s, -(2**63)), 2**63 - 1)) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("size", [5e6, 2.0**58, 1e300])
def test_top_k_of_very_large_components(spark, size):
    """They take part as queries and as candidates; scores beyond a long rank by their exact value."""
    from colloquy.llm import vectors

    rnd = random.Random(8)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    for i in (0, 7, 20, 33, 100, 150):
        rows[i] = (i, [size * rnd.uniform(-1, 1), 1.0, -0.3, size if i % 2 else 0.0])
    got = vectors.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    assert sorted(map(tuple, got.collect())) == best_by_hand(rows)


def test_cells_are_coarse_and_spare_exact_vectors(spark):
    """On the given table every cell holds two integers or more, and few pairs are left by the bounds."""
    from colloquy.llm import vectors

    x = np.floor(64 * np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()], float))
    edges = vectors._edges(x, x.min(0), x.max(0))
    middle, half = vectors._decode(vectors._encode(x, edges), edges)
    assert (np.abs(x - middle) <= half).all() and (half[:, :] > 0).mean() > 0.99 and len(np.unique(middle[:, 0])) <= vectors.CELLS
    ids = np.arange(len(x))
    q = ids[::20]
    left = vectors._bounds(q, x[q], np.full(len(q), -np.inf), ids, middle, half, vectors.K)
    assert len(left[0]) < 0.1 * len(q) * len(x)
    scores = x[q] @ x.T
    assert (left[2] <= scores[np.searchsorted(q, left[0].astype(int)), left[1].astype(int)]).all() and (scores[np.searchsorted(q, left[0].astype(int)), left[1].astype(int)] <= left[3]).all()
