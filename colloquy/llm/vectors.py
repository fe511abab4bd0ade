"""Exact top-k by a vector-approximation file, and near-duplicate embeddings by spherical k-means.

Shared rules: vectors that are null or hold null or non-finite components take no part;
shorter vectors count as padded with zeros; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import components, cut, map_batches


def _valid(df: DataFrame, vector: str) -> DataFrame:
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.where(x.isNotNull() & ~F.coalesce(bad, F.lit(False))).withColumn(vector, x)


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of an array column, padded with zeros."""
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


# --------------------------------------------------------------------- exact top-k

K = 20
SCALE = 64
#: Cells of a dimension, at least two integers wide; a code is one byte.
CELLS = 32
#: Vectors of a block of codes, queries of a block, and of these so many at a time.
DATA_BLOCK, QUERY_BLOCK, STEP = 16_384, 8192, 128
#: Vectors that place the cells' edges; bounds from their codes give every query a first bar.
SAMPLE = 16_384
#: Scores of scaled components below this are exact in a long; vectors with larger ones are scored by integers of any size.
LARGEST = 1 << 28
#: Vectors of a block of those, digits of a score of doubles, and the ends of a long.
LARGE_BLOCK, DIGITS, LONG = 256, 640, (-(1 << 63), (1 << 63) - 1)


def _down(x: np.ndarray) -> np.ndarray:
    """Below any rounding of sums of large products (small sums of integers and halves are exact)."""
    return np.where(np.abs(x) < 2**51, x, x - np.abs(x) * 1e-12)


def _up(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 2**51, x, x + np.abs(x) * 1e-12)


def _edges(sample: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Ends of the cells, dimensions x (CELLS + 1), from the least to the greatest value: cells of
    an equal number of integers, two at least, if eight suffice, else cells of about equal filling."""
    inner = np.quantile(sample, np.arange(1, CELLS) / CELLS, axis=0).T if len(sample) else np.repeat(low[:, None], CELLS - 1, 1)
    width = np.maximum(2, np.ceil((high - low + 1) / CELLS))[:, None]
    even = low[:, None] + width * np.arange(1, CELLS)[None, :] - 1
    inner = np.where(width <= 8, even, np.floor(inner))
    return np.concatenate([low[:, None], np.clip(inner, low[:, None], high[:, None]), high[:, None]], axis=1)


def _encode(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Codes of integer vectors, a byte for each dimension: the number of inner ends below a value."""
    return np.stack([np.searchsorted(e[1:-1], v, side="left") for e, v in zip(edges, x.T)], axis=1).astype(np.uint8)


def _decode(codes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middle and half width of the cells of codes: integers above the lower end, up to the upper one."""
    dims = np.arange(len(edges))
    low, high = edges[dims, codes] + (codes > 0), edges[dims, codes.astype(np.int64) + 1]
    return (low + high) / 2, (high - low) / 2


def _bounds(q_ids, q, bar, d_ids, middle, half, k: int):
    """``(query_id, vec_id, lower, upper)`` of the pairs of two blocks that can be among the
    ``k`` best of a query: their upper bound reaches its bar and the kth lower bound here."""
    out = []
    for at in range(0, len(q_ids), STEP):
        part = slice(at, at + STEP)
        centre, spread = q[part] @ middle.T, np.abs(q[part]) @ half.T
        lower, upper = _down(centre - spread), _up(centre + spread)
        own = q_ids[part, None] == d_ids[None, :]
        lower[own], upper[own] = -np.inf, -np.inf
        least = bar[part].copy()
        if lower.shape[1] >= k:
            least = np.maximum(least, -np.partition(-lower, k - 1, axis=1)[:, k - 1])
        row, col = np.nonzero((upper >= least[:, None]) & ~own)
        out.append((q_ids[part][row], d_ids[col], lower[row, col], upper[row, col]))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 4


def top_k(embeddings: DataFrame, k: int = K, every: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose vec_id is divisible by
    ``every`` the ``k`` rows of another vec_id with the highest integer inner product, ties
    to the smaller vec_id; components are floor(64 * x).

    The approximation file holds a code of CELLS cells a dimension for every vector, a byte
    for each. Blocks of codes meet blocks of queries, give bounds of
    every score, and pairs whose upper bound reaches the kth lower bound of the query are
    kept. Exact vectors are then read for these alone, through joins on their ids: first
    those of the highest bounds, whose kth score is a new bar, then the rest that reaches it.

    Repeated rows are candidates of their own; rows that repeat a query's id are one query
    with the scores of each. Rows without an id take no part. Vectors with a scaled component of
    LARGEST or more in size are scored by integers of any size, in blocks, against all others;
    scores that a long can't hold rank by their exact value and are given as the nearest long."""
    rows = _valid(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")), "v").where("vec_id is not null")
    is_large = F.exists("v", lambda c: F.abs(SCALE * c) >= LARGEST)
    large = rows.where(is_large)
    if not large.isEmpty():
        return _ranked_exactly(_top_k(rows.where(~is_large), k, every), _large_scores(rows, large, is_large, k, every), k)
    return _ranked(_top_k(rows, k, every), k, F.desc("score"))


def _ranked(scored: DataFrame, k: int, by) -> DataFrame:
    """``query_id, rank, vec_id, score`` of scored pairs with ``copies``."""
    each = scored.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(by, "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _ranked_exactly(plain: DataFrame, large: DataFrame, k: int) -> DataFrame:
    """As :func:`_ranked`, by scores written out in digits: ``large`` has them in ``key``."""
    digits = F.lpad(F.regexp_replace(F.col("score").cast("string"), "^-", ""), DIGITS, "0")
    key = F.when(F.col("score") < 0, F.concat(F.lit("0"), F.translate(digits, "0123456789", "9876543210"))).otherwise(F.concat(F.lit("1"), digits))
    return _ranked(plain.withColumn("key", key).unionByName(large), k, F.desc("key"))


def _large_scores(rows: DataFrame, large: DataFrame, is_large, k: int, every: int) -> DataFrame:
    """``query_id, vec_id, score, copies, key`` of the pairs with a large vector on either side that
    can be among the ``k`` best: blocks of large vectors meet blocks of all others."""
    dim = rows.agg(F.max(F.size("v"))).first()[0]

    def blocks(df: DataFrame, name: str) -> DataFrame:
        n = max(1, math.ceil(df.count() / LARGE_BLOCK))
        pack = lambda pdf: pd.DataFrame({name: [pdf["at"].iloc[0]], f"{name}_ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], f"{name}_v": [_matrix(pdf["v"], dim).tobytes()]})
        return cut(df.withColumn("at", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n))).groupBy("at").applyInPandas(pack, f"{name} long, {name}_ids binary, {name}_v binary"))

    def score(batches):
        for batch in batches:
            for b in batch.to_pylist():
                ids, integers = {}, {}
                for c in ("q", "d"):
                    ids[c] = np.frombuffer(b[f"{c}_ids"], np.int64)
                    ratios = [x.as_integer_ratio() for x in np.frombuffer(b[f"{c}_v"], np.float64).tolist()]
                    integers[c] = np.array([SCALE * n // m for n, m in ratios] + [None], object)[:-1].reshape(len(ids[c]), dim)
                found = []
                for i, row in zip(ids["q"].tolist(), integers["q"] @ integers["d"].T):
                    best = sorted(((-int(x), j) for j, x in zip(ids["d"].tolist(), row) if j != i))[:k]
                    found += [(i, j, -x) for x, j in best]
                written = [f"{abs(x):0{DIGITS}}" for *_, x in found]
                turned = str.maketrans("0123456789", "9876543210")
                yield {"query_id": [f[0] for f in found], "vec_id": [f[1] for f in found], "score": [min(max(f[2], LONG[0]), LONG[1]) for f in found], "copies": [1] * len(found), "key": ["1" + w if f[2] >= 0 else "0" + w.translate(turned) for f, w in zip(found, written)]}

    asks = F.pmod("vec_id", F.lit(every)) == 0
    meets = ((rows.where(asks), large), (large.where(asks), rows.where(~is_large)))
    parts = []
    for queries, data in meets:
        q, d = blocks(queries, "q"), blocks(data, "d")
        # every block of queries meets every block of data: an equi-join on the number of the latter
        m = max(1, math.ceil(data.count() / LARGE_BLOCK))
        met = q.withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))).join(d, "d")
        parts.append(map_batches(met.select("q_ids", "q_v", "d_ids", "d_v"), score, "query_id long, vec_id long, score long, copies long, key string"))
    return parts[0].unionAll(parts[1])


def _top_k(rows: DataFrame, k: int, every: int) -> DataFrame:
    """``query_id, vec_id, score, copies`` of the ``k`` best of every query, and maybe more, by the approximation file."""
    scaled = rows.select("vec_id", F.transform("v", lambda c: F.floor(SCALE * c)).alias("x"))
    exact = cut(scaled.groupBy("vec_id", "x").agg(F.count("*").alias("copies")))
    n, dim = exact.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n or not dim:
        return exact.limit(0).select(F.col("vec_id").alias("query_id"), "vec_id", F.col("vec_id").alias("score"), "copies")
    at = lambda i: F.coalesce(F.get("x", F.lit(i)), F.lit(0))
    ends = exact.agg(*[f(at(i)).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(dim)]).first()
    sample = exact.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "x").toPandas()
    sample_ids, sample = sample["vec_id"].to_numpy(np.int64), _matrix(sample["x"], dim)
    edges = _edges(sample, np.array(ends[:dim], float), np.array(ends[dim:], float))
    sample_middle, sample_half = _decode(_encode(sample, edges), edges)

    def write(batches):
        ids, codes, held = [], [], 0
        for batch in batches:
            ids.append(batch.column("vec_id").to_numpy())
            codes.append(_encode(_matrix(batch.column("x").to_pylist(), dim), edges))
            held += batch.num_rows
            if held >= DATA_BLOCK:
                yield {"ids": [np.concatenate(ids).tobytes()], "codes": [np.concatenate(codes).tobytes()]}
                ids, codes, held = [], [], 0
        if held:
            yield {"ids": [np.concatenate(ids).tobytes()], "codes": [np.concatenate(codes).tobytes()]}

    file = cut(map_batches(exact.select("vec_id", "x"), write, "ids binary, codes binary"))
    query_blocks = max(1, math.ceil(n / every / QUERY_BLOCK))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, x = pdf["vec_id"].to_numpy(np.int64), _matrix(pdf["x"], dim)
        bar = np.full(len(ids), -np.inf)
        for at in range(0, len(ids) if len(sample_ids) > k else 0, STEP):
            part = slice(at, at + STEP)
            lower = _down(x[part] @ sample_middle.T - np.abs(x[part]) @ sample_half.T)
            bar[part] = -np.partition(-np.where(sample_ids[None, :] == ids[part, None], -np.inf, lower), k - 1, axis=1)[:, k - 1]
        return pd.DataFrame({"q_block": [pdf["q_block"].iloc[0]], "q_ids": [ids.tobytes()], "q": [x.astype(np.int32).tobytes()], "bar": [bar.tobytes()]})

    asked = exact.where(F.pmod("vec_id", F.lit(every)) == 0)
    queries = cut(asked.withColumn("q_block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks))).groupBy("q_block").applyInPandas(pack, "q_block long, q_ids binary, q binary, bar binary"))
    # every block of codes meets every block of queries: parts spread a block of queries over tasks
    parts = max(1, math.ceil(n / DATA_BLOCK))
    spread = file.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts))).withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))
    met = spread.join(queries.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))), ["q_block", "part"]).drop("q_block", "part")

    def scan(batches):
        for batch in batches:
            for b in batch.to_pylist():
                d_ids, q_ids = (np.frombuffer(b[c], np.int64) for c in ("ids", "q_ids"))
                middle, half = _decode(np.frombuffer(b["codes"], np.uint8).reshape(len(d_ids), -1), edges)
                found = _bounds(q_ids, np.frombuffer(b["q"], np.int32).reshape(-1, dim).astype(float), np.frombuffer(b["bar"], np.float64), d_ids, middle, half, k)
                yield dict(zip(("query_id", "vec_id", "lower", "upper"), (found[0].astype(np.int64), found[1].astype(np.int64), *found[2:])))

    bounded = cut(map_batches(met, scan, "query_id long, vec_id long, lower double, upper double"))
    kept = cut(_reach(bounded, "lower", k).groupBy("query_id", "vec_id").agg(F.max("upper").alias("upper")))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id"))
    best = cut(_scores(kept.withColumn("turn", first).where(F.col("turn") <= 2 * k).drop("turn"), exact, k))
    bars = best.groupBy("query_id").agg(F.sum("copies").alias("n"), F.min("score").alias("bar")).where(F.col("n") >= k)
    rest = kept.join(best.select("query_id", "vec_id").distinct(), ["query_id", "vec_id"], "left_anti").join(bars, "query_id", "left").where(F.col("bar").isNull() | (F.col("upper") >= F.col("bar")))
    return best.unionAll(_scores(rest, exact, k)).select("query_id", "vec_id", "score", "copies")


def _reach(bounded: DataFrame, lower: str, k: int) -> DataFrame:
    """Pairs whose upper bound reaches the kth lower bound of their query."""
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(lower)))
    bars = bounded.select("query_id", lower).withColumn("nth", nth).where(F.col("nth") <= k).groupBy("query_id").agg(F.count("*").alias("n"), F.min(lower).alias("bar")).where(F.col("n") >= k)
    return bounded.join(bars, "query_id", "left").where(F.col("bar").isNull() | (F.col("upper") >= F.col("bar"))).drop("n", "bar")


def _scores(pairs: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score, copies`` of the ``k`` best of the pairs by their exact vectors."""
    c, q = exact.select("vec_id", F.col("x").alias("c"), "copies"), exact.select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"), F.col("copies").alias("asked"))
    product = F.zip_with("c", "q", lambda a, b: F.coalesce(a * b, F.lit(0).cast("long")))
    score = F.aggregate(product, F.lit(0).cast("long"), lambda a, b: a + b)
    scored = pairs.select("query_id", "vec_id").join(c, "vec_id").join(q, "query_id").select("query_id", "vec_id", score.alias("score"), (F.col("copies") * F.col("asked")).alias("copies"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


# ------------------------------------------------------------------ near duplicates

SIMILAR = 0.98
#: Rows of a label for each of its cells, and the most cells of all labels together.
ROWS_PER_CELL, MOST_CELLS = 2000, 4096
#: Rows that fit the centroids, and rounds.
FIT_ROWS, FIT_ROUNDS = 20_000, 5
BLOCK = 2048
#: Rows of a small table that is broadcast (about 50 bytes each).
BROADCAST_ROWS = 500_000


def _units(blobs, dim: int, kind: str) -> np.ndarray:
    """Unit vectors, in double precision, of vectors as bytes."""
    x = np.frombuffer(b"".join(blobs), kind).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True) + 0.0


def _fit(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of spherical k-means."""
    centers = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(FIT_ROUNDS):
        own = (x @ centers.T).argmax(1)
        total = np.zeros_like(centers)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1)
        centers = np.where(norm[:, None] > 0, total / np.maximum(norm, 1e-300)[:, None], centers)
    return centers


def _centroids(distinct: DataFrame, dim: int, kind: str) -> dict:
    """Centroids by label, for labels with more than one cell: their number follows the
    label's rows, and each label is fitted on its part of a sample of FIT_ROWS rows."""
    sizes = cut(distinct.groupBy("label").agg(F.count("*").alias("n")))
    n = sizes.agg(F.sum("n")).first()[0]
    per = max(ROWS_PER_CELL, math.ceil(n / MOST_CELLS))
    large = sizes.where(F.col("n") > per).withColumn("k", F.ceil(F.col("n") / per).cast("int"))
    if large.isEmpty():
        return {}
    sample = distinct.select("label", "vec").sample(min(1.0, FIT_ROWS / n), seed=11).join(F.broadcast(large.select("label", "k")), "label")  # at most MOST_CELLS rows
    label_type = dict(distinct.dtypes)["label"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _units(pdf["vec"].sort_values(), dim, kind)
        centers = _fit(x, min(int(pdf["k"].iloc[0]), len(x)))
        return pd.DataFrame({"label": [pdf["label"].iloc[0]], "centers": [centers.tobytes()]})

    return {r["label"]: np.frombuffer(r["centers"], np.float64).reshape(-1, dim) for r in sample.groupBy("label").applyInPandas(fit, f"label {label_type}, centers binary").collect()}


def _local_links(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among rows of one block."""
    left, out = np.ones(len(linked), bool), []
    for root in np.flatnonzero(linked.any(1)).tolist():
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front:
            at = front.pop()
            for other in np.flatnonzero(linked[at] & left):
                left[other] = False
                out.append((at, int(other)))
                front.append(int(other))
    return out


def near_duplicate_vectors(embeddings: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors link if their labels are equal and not null and their cosine is at least
    ``similar``. Vectors of a label that are equal in direction (128 bits of hash) are
    merged first and counted. A label's vectors go to the cell of their nearest centroid.
    Links across cells are not lost: if x lies in cell i and y in cell j, x·(ci-cj) >= 0 >=
    y·(ci-cj), and |x-y| <= sqrt(2-2*similar), so x·(ci-cj) <= sqrt(2-2*similar)*|ci-cj|; x
    visits every earlier cell for which that holds, as a guest. Cells of more than BLOCK
    rows are compared block by block; a block reports counts and a spanning forest of its
    links, never the pairs. Rows that repeat a vec_id are vectors of their own. Vectors that
    take no part (null, zero, not finite, null label) have no links and are kept.
    """
    kind = "f4" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "f8"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").alias("v"))
    usable = _valid(rows.where("label is not null"), "v").where(F.exists("v", lambda c: c != 0))
    n, dim = usable.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    label_type = dict(rows.dtypes)["label"]

    def read(batches):
        for batch in batches:
            x = _matrix(batch.column("v").to_pylist(), dim).astype(kind)
            units = _units([x.tobytes()], dim, kind)
            labels = [repr(v).encode() for v in batch.column("label").to_pylist()]
            yield {
                "vec_id": batch.column("vec_id"), "label": batch.column("label"), "vec": pa.array([r.tobytes() for r in x], pa.binary()),
                "key": pa.array([xxhash.xxh3_128_digest(r.tobytes() + v) for r, v in zip(units, labels)], pa.binary()),
            }

    units = cut(map_batches(usable, read, f"vec_id long, label {label_type}, vec binary, key binary"))
    distinct = cut(units.groupBy("label", "key").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.min("vec").alias("vec")))
    centers = _centroids(distinct, dim, kind)
    reach = math.sqrt(2 - 2 * similar) + 1e-9

    def cells(batches):
        for batch in batches:
            x, labels = _units(batch.column("vec").to_pylist(), dim, kind), batch.column("label").to_pylist()
            row, cell, member = [], [], []
            for label in set(labels):
                at = np.flatnonzero([v == label for v in labels])
                c = centers.get(label)
                if c is None:
                    row, cell, member = [*row, at], [*cell, np.zeros(len(at), np.int32)], [*member, np.ones(len(at), bool)]
                    continue
                near = x[at] @ c.T
                own = near.argmax(1)
                gaps = np.sqrt(np.maximum(2 - 2 * c[own] @ c.T, 0))  # centroids have length one
                goes = (near[np.arange(len(at)), own][:, None] - near <= reach * gaps + 1e-7) & (np.arange(len(c))[None, :] < own[:, None])
                goes[np.arange(len(at)), own] = True
                i, j = np.nonzero(goes)
                row, cell, member = [*row, at[i]], [*cell, j.astype(np.int32)], [*member, own[i] == j]
            took = pa.array(np.concatenate(row) if row else np.zeros(0, np.int64))
            yield {c: batch.column(c).take(took) for c in ("label", "vec", "key", "copies")} | {"cell": np.concatenate(cell or [np.zeros(0, np.int32)]), "member": np.concatenate(member or [np.zeros(0, bool)])}

    placed = map_batches(distinct, cells, f"label {label_type}, vec binary, key binary, copies long, cell int, member boolean")
    sizes = cut(placed.groupBy("label", "cell").agg(F.ceil(F.count_if("member") / BLOCK).alias("blocks"), F.ceil(F.count_if(~F.col("member")) / BLOCK).alias("guests")))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    # blocks of members and of guests; a block of members meets itself together with the first
    # block of guests, the other blocks of guests, and the other blocks of members
    dealt = placed.join(sizes, ["label", "cell"]).where("blocks > 0")
    own = F.pmod(F.xxhash64("key"), F.when(F.col("member"), F.col("blocks")).otherwise(F.col("guests")))
    long = lambda c: F.lit(c).cast("long")
    pair = lambda a, b, g: F.struct(a.alias("a"), b.alias("b"), g.alias("g"))
    mates = F.transform(F.filter(F.sequence(long(0), F.col("blocks") - 1), lambda o: o != F.col("own")), lambda o: pair(F.least("own", o), F.greatest("own", o), long(-1)))
    with_guests = F.transform(F.sequence(long(0), F.greatest("guests", long(1)) - 1), lambda g: pair(F.col("own"), F.col("own"), g))
    visits = F.transform(F.sequence(long(0), F.col("blocks") - 1), lambda o: pair(o, o, F.col("own")))
    jobs = dealt.withColumn("own", own).withColumn("p", F.explode(F.when(F.col("member"), F.concat(with_guests, mates)).otherwise(visits)))
    jobs = jobs.select("label", "cell", "p", "key", "copies", "vec", "member", "own")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _units(pdf["vec"], dim, kind)
        key, copies, member, own_ = (pdf[c].to_numpy() for c in ("key", "copies", "member", "own"))
        guests, linked = pdf["p"].iloc[0]["g"], np.zeros((len(x), len(x)), bool)
        for at in range(0, len(x), 512):
            some = slice(at, at + 512)
            near = x[some] @ x.T >= similar
            if guests < 0:  # two blocks of members: pairs within one belong to its own job
                near &= own_[some, None] != own_[None, :]
            elif guests == 0:
                near &= member[some, None] | member[None, :]
            else:
                near &= member[some, None] != member[None, :]
            linked[some] = near
        np.fill_diagonal(linked, False)
        linked |= linked.T  # products of a pair are equal but for rounding
        counts = linked @ copies
        some, edges = np.flatnonzero(counts), _local_links(linked)
        return pd.DataFrame({
            "key": np.concatenate([key[some], key[[a for a, _ in edges]]]) if len(some) else np.zeros(0, object),
            "other": [None] * len(some) + [key[b] for _, b in edges],
            "n": np.concatenate([counts[some], np.zeros(len(edges), np.int64)]).astype(np.int64),
        })

    found = cut(jobs.groupBy("label", "cell", "p").applyInPandas(compare, "key binary, other binary, n long"))
    linked = components(found.where("other is not null"), "key", "other")
    counts = found.groupBy("key").agg(F.sum("n").alias("n"))
    roots = distinct.select("key", "least", "copies").join(linked, F.col("key") == F.col("node"), "left").join(counts, "key", "left")
    roots = roots.select("key", "least", F.coalesce("component", "key").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # groups of several vectors only, so that members of one group needn't meet in one place
    least = cut(roots.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size")).where("size > 1").drop("size"))
    least = F.broadcast(least) if least.count() <= BROADCAST_ROWS else least
    roots = roots.join(least, "root", "left").select("key", "n_links", F.coalesce("component_id", "least").alias("component_id"))
    result = units.select("vec_id", "key").join(roots, "key").select("vec_id", "n_links", "component_id")
    apart = rows.where("label is null").unionAll(rows.where("label is not null and v is null"))
    broken = rows.where("label is not null and v is not null").withColumn("v", F.col("v").cast("array<double>"))
    broken = broken.where(F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) | ~F.exists("v", lambda c: F.coalesce(c, F.lit(0.0)) != 0))
    rest = apart.select("vec_id").unionAll(broken.select("vec_id")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return result.unionAll(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
