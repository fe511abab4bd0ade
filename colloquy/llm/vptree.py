"""Approximate nearest neighbours by vantage-point trees, one for each shard.

Shared rules: vectors that are null, zero or hold null or non-finite components take no
part, nor do rows without an id; shorter vectors count as padded with zeros; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import cut, map_batches

K = 10
#: A subtree is left out if its distance bound times this exceeds the kth distance found: 1 is exact.
FACTOR = 6.0
#: Points of a leaf, and bytes of a shard's vectors.
LEAF, SHARD_BYTES = 64, 1 << 20
#: Bytes of the sample that places the cells, and the most cells; larger cells are several shards.
SAMPLE_BYTES, MOST_CELLS = 8 << 20, 256
#: Queries that meet a shard in one task.
QUERY_BLOCK = 1024
#: Of the points of a node so many may be its vantage point, judged by so many others.
CHOICES, JUDGES = 8, 64
#: Stands where no id was found.
NOBODY = np.iinfo(np.int64).max


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of two arrays of doubles, by differences, so that equal
    rows are at exactly zero; what squares can't hold is scaled first."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 19) // max(1, b.size))
    with np.errstate(over="ignore", under="ignore"):
        for at in range(0, len(a), step):
            gap = a[at : at + step, None, :] - b[None, :, :]
            out[at : at + step] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
        i, j = np.nonzero(~np.isfinite(out) | (out < 1e-140))
        if len(i):
            gap = np.abs(a[i] / 2 - b[j] / 2)
            most = gap.max(1)
            part = gap / np.where(most > 0, most, 1)[:, None]
            out[i, j] = np.where(most > 0, 2 * (most * np.sqrt((part * part).sum(1))), 0)
    return out


def _vantage(x: np.ndarray, part: np.ndarray) -> int:
    """Of a few points of a part the one whose distances to others are spread most."""
    some, judges = (part[np.linspace(0, len(part) - 1, min(n, len(part))).astype(int)] for n in (CHOICES, JUDGES))
    with np.errstate(all="ignore"):
        return int(some[np.nan_to_num(distances(x[some], x[judges]).std(1)).argmax()])


def plant(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(order, vantage, low, high)`` of a balanced tree: the order of the points in its
    leaves, the vantage point of every inner node (children of node i are 2i+1 and 2i+2), and
    for every node the least and greatest distance of its points to its parent's vantage point."""
    n, order = len(x), np.arange(len(x))
    vantage, low, high = np.zeros(2**depth - 1, np.int64), np.zeros(2 ** (depth + 1) - 1), np.zeros(2 ** (depth + 1) - 1)
    for level in range(depth):
        for j in range(2**level):
            start, mid, end = (n * (2 * j + k) >> level + 1 for k in range(3))
            node, part = 2**level - 1 + j, order[start:end]
            vantage[node] = _vantage(x, part)
            d = distances(x[vantage[node]][None], x[part])[0]
            by = np.argsort(d, kind="stable")
            order[start:end], d = part[by], d[by]
            for child, some in ((2 * node + 1, d[: mid - start]), (2 * node + 2, d[mid - start :])):
                low[child], high[child] = some[0], some[-1]
    return order, vantage, low, high


def _depth(n: int, leaf: int) -> int:
    return max(0, math.ceil(math.log2(max(1, n) / leaf)))


def _least(d: np.ndarray, low: float, high: float) -> np.ndarray:
    """The least distance that the triangle inequality leaves, below any rounding, from points
    at ``low`` to ``high`` of a vantage point that is at ``d``."""
    with np.errstate(invalid="ignore"):
        return np.nan_to_num(np.maximum(low - d, d - high) - 1e-12 * (d + low), nan=0.0, posinf=np.inf, neginf=0.0)


class Tree:
    """The vantage-point tree of a shard: points in the order of its leaves."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, vantage: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.x, self.ids, self.vantage, self.low, self.high = x, ids, vantage, low, high
        self.depth = (len(low) + 1).bit_length() - 2

    @classmethod
    def of(cls, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> Tree:
        order, vantage, low, high = plant(x, _depth(len(x), leaf))
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        return cls(x[order], ids[order], place[vantage], low, high)

    def leaves(self, q: np.ndarray, bar: np.ndarray, factor: float) -> np.ndarray:
        """Bounds of the distance from every query to every leaf; infinite where it was cut off."""
        least = np.zeros((len(q), 1))
        for level in range(self.depth):
            below = np.full((len(q), 2 ** (level + 1)), np.inf)
            for j in range(2**level):
                node = 2**level - 1 + j
                some = np.flatnonzero(np.isfinite(least[:, j]))
                if not len(some):
                    continue
                d = distances(q[some], self.x[self.vantage[node]][None])[:, 0]
                for side in (0, 1):
                    child = 2 * node + 1 + side
                    bound = np.maximum(least[some, j], _least(d, self.low[child], self.high[child]))
                    below[some, 2 * j + side] = np.where(factor * bound > bar[some], np.inf, bound)
            least = below
        return least

    def search(self, q_ids: np.ndarray, q: np.ndarray, bar: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, int]:
        """``(ids, distances, met)``: of each query the ``k`` nearest points of other ids that are
        no farther than ``bar``, by distance and then id, filled up with infinity; and the number
        of distances to points. Each query visits its leaves in the order of their bounds until
        a bound times ``factor`` exceeds its kth distance."""
        n, m, bar, met = len(self.x), len(q), bar.copy(), 0
        best, names = np.full((m, k), np.inf), np.full((m, k), NOBODY)
        least = self.leaves(q, bar, factor)
        turn = np.argsort(least, axis=1, kind="stable")
        for r in range(least.shape[1]):
            leaf = turn[:, r]
            bound = least[np.arange(m), leaf]
            going = np.flatnonzero(np.isfinite(bound) & (factor * bound <= bar))
            if not len(going):
                break
            for j in np.unique(leaf[going]):
                some, part = going[leaf[going] == j], slice(n * j >> self.depth, n * (j + 1) >> self.depth)
                d = distances(q[some], self.x[part])
                met += d.size
                out = (self.ids[None, part] == q_ids[some, None]) | (d > bar[some, None])
                d[out] = np.inf
                near = d.min(1) <= best[some, -1]
                some, d, out = some[near], d[near], out[near]
                if not len(some):
                    continue
                all_d, all_ids = np.concatenate([best[some], d], 1), np.concatenate([names[some], np.where(out, NOBODY, self.ids[None, part])], 1)
                first = np.lexsort((all_ids, all_d), axis=1)[:, :k]
                best[some], names[some] = np.take_along_axis(all_d, first, 1), np.take_along_axis(all_ids, first, 1)
                bar[some] = np.minimum(bar[some], best[some, -1])
        return names, best, met


class Cells:
    """The upper part of the tree, placed by a sample: a point goes to a cell by its distances
    to the vantage points, nearer ones to the left, so that bounds of cells hold for all points."""

    def __init__(self, sample: np.ndarray, depth: int):
        _, vantage, _, high = plant(sample, depth)
        self.depth, self.vantage, self.split = depth, sample[vantage], high[1::2]

    def place(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            right = np.zeros(len(x), bool)
            for at in np.unique(node):
                some = np.flatnonzero(node == at)
                right[some] = distances(x[some], self.vantage[at][None])[:, 0] > self.split[at]
            node = 2 * node + 1 + right
        return node - (2**self.depth - 1)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Bounds of the distance from every query to every cell."""
        least = np.zeros((len(q), 1))
        for level in range(self.depth):
            nodes = range(2**level - 1, 2 ** (level + 1) - 1)
            d = distances(q, self.vantage[nodes.start : nodes.stop])
            sides = [np.maximum(least[:, j], _least(d[:, j], *ends)) for j, at in enumerate(nodes) for ends in ((0.0, self.split[at]), (self.split[at], np.inf))]
            least = np.stack(sides, axis=1)
        return least


def _rows(blobs, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind).reshape(-1, dim).astype(np.float64)


def _fewest(batches: Iterator[pd.DataFrame], most: int, limit: int = 8 << 20) -> Iterator[pd.DataFrame]:
    """Of equal vectors that a task meets together only the ``most`` rows of the smallest ids."""

    def of(some: list[pd.DataFrame]) -> pd.DataFrame:
        df = pd.concat(some).sort_values("vec_id", kind="stable")
        return df[df.groupby("vec").cumcount() < most]

    held, size = [], 0
    for df in batches:
        held.append(df)
        size += int(df["vec"].str.len().sum())
        if size >= limit:
            yield of(held)
            held, size = [], 0
    if held:
        yield of(held)


def nearest_neighbours(embeddings: DataFrame, k: int = K, every: int = 100, factor: float = FACTOR, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose vec_id is divisible by ``every``
    the ``k`` nearest rows of another vec_id that are found, by Euclidean distance, ties to
    the smaller vec_id; with ``factor`` 1 they are exactly the nearest.

    A sample of SAMPLE_BYTES places the upper levels of one vantage-point tree; every row
    goes to one of its cells, and a cell is a shard or, by a hash of the vectors, several.
    Each shard of about ``shard_bytes`` becomes a vantage-point tree. A query first searches
    the shards of its own cell, which gives it a kth distance, and then those of every cell
    whose bound by the triangle inequality, times ``factor``, doesn't exceed that distance;
    within a shard subtrees and leaves are left out by the same rule. Blocks of queries meet
    shards, so no task holds more than a block and a shard.

    Of equal vectors only the ``k + 1`` rows of the smallest ids can be in a result, and a task
    passes on no more of them. Rows that repeat a query's id ask on their own if their vectors
    differ, and are no candidates of each other; repeated candidates are listed as often."""
    kind = "f4" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "f8"
    v = F.col("v").cast("array<double>")
    usable = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where("vec_id is not null and v is not null")
    usable = usable.where(~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0))
    n, dim = usable.agg(F.count("*"), F.max(F.size("v"))).first()
    out = "query_id long, q_no long, vec_id long, score double"
    if not n:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def pack(batches):
        for batch in batches:
            x = np.zeros((batch.num_rows, dim), kind)
            for i, row in enumerate(batch.column("v").to_pylist()):
                x[i, : len(row)] = row
            yield {"vec_id": batch.column("vec_id"), "vec": pa.array([r.tobytes() for r in x + 0], pa.binary())}

    packed = map_batches(usable, pack, "vec_id long, vec binary")
    shard_rows = max(LEAF, shard_bytes // (dim * int(kind[1])))
    sample_rows = max(4 * LEAF, SAMPLE_BYTES // (dim * 8))
    share = F.pmod(F.xxhash64("vec_id", "vec"), F.lit(1 << 30)) < math.ceil(min(1.0, 2 * sample_rows / n) * (1 << 30))
    sample = packed.where(share).distinct().orderBy(F.xxhash64("vec_id", "vec"), "vec").limit(sample_rows).select("vec").toPandas()["vec"]
    points = _rows(sorted(set(sample)), dim, kind)
    cells = Cells(points, max(0, min(round(math.log2(max(1, n / shard_rows))), int(math.log2(MOST_CELLS)), int(math.log2(max(1, len(points) / LEAF))))))

    def place(frames):
        for df in _fewest(frames, k + 1):
            yield df.assign(cell=cells.place(_rows(df["vec"], dim, kind)).astype("int32"))

    placed = cut(packed.mapInPandas(place, "vec_id long, vec binary, cell int"))
    subs = placed.groupBy("cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("subs"))
    subs = F.broadcast(cut(subs))  # a row for each cell, MOST_CELLS at most

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "vec"])
        pdf = pdf[pdf.groupby("vec").cumcount() < k + 1]
        tree = Tree.of(_rows(pdf["vec"], dim, kind), pdf["vec_id"].to_numpy(np.int64))
        blobs = (tree.x.astype(kind), tree.ids, tree.vantage, tree.low, tree.high)
        return pd.DataFrame({"cell": pdf["cell"].iloc[:1].to_numpy(), "sub": pdf["sub"].iloc[:1].to_numpy()} | {c: [b.tobytes()] for c, b in zip(("x", "ids", "vantage", "low", "high"), blobs)})

    shards = placed.join(subs, "cell").select("vec_id", "vec", "cell", F.pmod(F.xxhash64("vec"), "subs").cast("int").alias("sub"))
    trees = cut(shards.groupBy("cell", "sub").applyInPandas(grow, "cell int, sub int, x binary, ids binary, vantage binary, low binary, high binary"))
    asked = packed.where(F.pmod("vec_id", F.lit(every)) == 0).distinct().select(F.col("vec_id").alias("query_id"), F.xxhash64("vec").alias("q_no"), F.col("vec").alias("q"))

    def search(key: tuple, queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(shard):
            return pd.DataFrame({"query_id": [], "q_no": [], "vec_id": [], "score": []})
        row = shard.iloc[0]
        tree = Tree(_rows([row["x"]], dim, kind), *(np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("vantage", np.int64), ("low", float), ("high", float))))
        q_ids, no = queries["query_id"].to_numpy(np.int64), queries["q_no"].to_numpy(np.int64)
        names, best, _ = tree.search(q_ids, _rows(queries["q"], dim, kind), queries["bar"].to_numpy(float), k, factor)
        at, nth = np.nonzero(names < NOBODY)
        return pd.DataFrame({"query_id": q_ids[at], "q_no": no[at], "vec_id": names[at, nth], "score": best[at, nth]})

    def visit(visits: DataFrame) -> DataFrame:
        visits = cut(visits.join(subs, "cell").withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).drop("subs"))
        blocks = cut(visits.groupBy("cell", "sub").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks")))
        dealt = visits.join(blocks, ["cell", "sub"]).withColumn("block", F.pmod(F.xxhash64("query_id", "q_no"), "blocks")).drop("blocks")
        met = trees.join(blocks, ["cell", "sub"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        key = ("cell", "sub", "block")
        return cut(dealt.groupBy(*key).cogroup(met.groupBy(*key)).applyInPandas(search, out))

    def home(frames):
        for df in frames:
            yield df.assign(bar=np.inf, cell=cells.place(_rows(df["q"], dim, kind)).astype("int32"))

    def others(frames):
        for df in frames:
            q = _rows(df["q"], dim, kind)
            goes = factor * cells.bounds(q) <= df["bar"].to_numpy(float)[:, None]
            goes[np.arange(len(q)), cells.place(q)] = False
            at, cell = np.nonzero(goes)
            yield df.iloc[at].assign(cell=cell.astype("int32"))

    went = "query_id long, q_no long, q binary, bar double, cell int"
    first = visit(asked.mapInPandas(home, went))
    nth = Window.partitionBy("query_id", "q_no").orderBy("score", "vec_id")
    of = lambda df: df.withColumn("rank", F.row_number().over(nth)).where(F.col("rank") <= k)
    bars = of(first).where(F.col("rank") == k).select("query_id", "q_no", F.col("score").alias("bar"))
    rest = asked.join(bars, ["query_id", "q_no"], "left").withColumn("bar", F.coalesce("bar", F.lit(float("inf"))))
    found = first.unionAll(visit(rest.mapInPandas(others, went)))
    return of(found).select("query_id", "rank", "vec_id", "score")
