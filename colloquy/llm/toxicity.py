"""Toxicity by class-conditional Kneser-Ney bigram models.

Each class (toxic, ordinary) has an interpolated bigram model with discounts estimated
from its counts of counts. Both orders count distinct contexts, as Kneser and Ney count
the lower orders: passages are repeated across documents, and by occurrences they would
mark any text that shares them. Both orders back off through counts that the classes share: a class's
bigrams to the bigrams of both classes, these to the class's words, and those to the
words of all documents that aren't held out, labelled or not, mixed with an even share
of EVEN. So an expression that is
rare says little for or against a class, wherever it was seen. The evidence of a word is
the difference of its two log-likelihoods. A text is judged on length-normalised sums of
it: over the whole text and over its strongest window of WINDOW words, so a few toxic
words count in a long text too. A logistic curve over these, fitted on labelled texts
that the counts have not seen, gives a score from 0 to 1.

Only rows with crc32(doc_id) mod 5 other than 0 are learnt from: of labelled rows those
with 1 to 3 give the classes' counts, those with 4 the curve. The labelled rows are a
sample: those of the smallest hashed ids, at most FIT_ROWS of each class and as many whole
texts as FIT_BYTES hold. That bounds what the driver and each executor hold of the model
(at most 20 bytes for each of the sample's pairs of words). The shared words are counted
over every document, for the words of the model; other words are equal in both classes.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import cut, map_batches, slices

#: Labelled texts of a class that are learnt from, and bytes of them; texts are read whole. A text
#: of more than FIT_TEXT bytes would leave no place for others: such texts are taken after the rest.
FIT_ROWS, FIT_BYTES, FIT_TEXT = 2_000, 12 << 20, 1 << 20
#: Share of the last order that is the same for every word.
EVEN = 0.5
WINDOW = 48
FEATURES = 4
#: Bytes of text that are scored in one step.
STEP_BYTES = 1 << 20
_WORD = re.compile(r"\w+")
_START = np.uint64(1)


class _Hash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 5) | 2
        return out


def _words(text: str | None, memo: _Hash) -> np.ndarray:
    found = _WORD.findall((text or "").lower())
    return np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))


def _pairs(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of each word with the one before it; the first of a text follows the start mark."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[starts[starts < len(words)]] = _START
    return (before * np.uint64(0x9E3779B97F4A7C15)) ^ (words * np.uint64(0xC2B2AE3D27D4EB4F) + (words >> np.uint64(29)))


@dataclass
class Model:
    """Sorted hashes with their probabilities in the classes."""

    uni: np.ndarray
    uni_p: np.ndarray  # 2 x words: class unigram probabilities
    unseen: np.ndarray  # 2: probability of a word not seen in either class
    ctx: np.ndarray
    ctx_mass: np.ndarray  # 3 x contexts: backoff weight, the last of both classes together
    pair: np.ndarray
    pair_p: np.ndarray  # 3 x pairs: discounted probability before backoff

    def evidence(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Difference of the classes' log-likelihoods for each word."""
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[starts[starts < len(words)]] = _START
        mass = _lookup(self.ctx, self.ctx_mass, before, np.ones(3))
        pair = _lookup(self.pair, self.pair_p, _pairs(words, starts), np.zeros(3))
        p = pair[:2] + mass[:2] * (pair[2] + mass[2] * _lookup(self.uni, self.uni_p, words, self.unseen))
        return np.diff(np.log(p), axis=0)[0]

    def features(self, batch_words: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(w) for w in batch_words])
        ends = np.cumsum(sizes)
        words = np.concatenate(batch_words) if len(batch_words) else np.zeros(0, np.uint64)
        e = self.evidence(words, ends - sizes) if len(words) else np.zeros(0)
        total = np.concatenate([[0.0], np.cumsum(e)])
        out = np.zeros((len(sizes), FEATURES))
        for i, (n, end) in enumerate(zip(sizes, ends)):
            part = total[end - n : end + 1]
            w = min(WINDOW, n)
            strong = (part[w:] - part[:-w]).max() / WINDOW if n else 0.0
            strongest = e[end - n : end].max() if n else 0.0
            out[i] = 1.0, (part[-1] - part[0]) / max(n, 8), strong, strongest
        return out


@dataclass
class Fitted:
    """The model, broadcast once (its size is bounded by FIT_BYTES), and the curve's weights."""

    model: Broadcast
    weights: np.ndarray

    def score(self, batch_words: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(Model(**self.model.value).features(batch_words) @ self.weights, -50, 50)))


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.repeat(default[:, None], len(wanted), axis=1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[:, at], default[:, None])


def fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _sample(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, toxic, fold`` of the sample of learnable labelled rows, each distinct text once;
    of a repeated doc_id, and of texts that are equal, the largest label counts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("fold", F.crc32(F.col("doc_id").cast("string")) % 5).where("fold <> 0")
    place = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", "fold")
    few = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS) for c in (0, 1)]
    texts = _texts(documents).join(F.broadcast(few[0].unionAll(few[1])), "doc_id").where("text is not null")  # at most 2 * FIT_ROWS ids
    texts = texts.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min(place).alias("at"))
    # whole texts until the bytes are full, very long ones last; the first one of a class always stays
    order = Window.partitionBy("toxic").orderBy(F.octet_length("text") > FIT_TEXT, "at")
    texts = texts.withColumn("held", F.sum(F.octet_length("text")).over(order)).withColumn("nth", F.row_number().over(order))
    return cut(texts.where((F.col("held") <= FIT_BYTES) | (F.col("nth") == 1)).select("text", "toxic", "at.fold"))


def _shared(documents: DataFrame, words: np.ndarray) -> tuple[np.ndarray, int]:
    """Occurrences of each of ``words`` (ascending) in all documents that aren't held out, and of all words."""
    sent = documents.sparkSession.sparkContext.broadcast(words)

    def count(batches):
        memo, known = _Hash(), sent.value
        found, total = np.zeros(len(known), np.int64), 0
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                w = np.concatenate([_words(t, memo) for t in part.column("text").to_pylist()] or [np.zeros(0, np.uint64)])
                total += len(w)
                if len(known) and len(w):
                    at = np.minimum(np.searchsorted(known, w), len(known) - 1)
                    found += np.bincount(at[known[at] == w], minlength=len(known))
        some = np.flatnonzero(found)
        yield {"word": np.append(some, -1), "n": np.append(found[some], total)}

    learnt = _texts(documents).where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 0, F.lit(True))).select("text")
    counts = map_batches(learnt, count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    at, n = counts["word"].to_numpy(), counts["n"].to_numpy()
    out = np.zeros(len(words), np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return out, int(n[at < 0].sum())


def fit(documents: DataFrame, labels: DataFrame) -> Fitted:
    """Counts are made by Spark; the model is put together on the driver from a table of bounded size."""
    sample = _sample(documents, labels)

    def grams(batches):
        memo = _Hash()
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                for toxic, text in zip(part.column("toxic").to_pylist(), part.column("text").to_pylist()):
                    w = np.concatenate([[_START, _START], _words(text, memo)]).astype(np.uint64).view(np.int64)
                    yield {"toxic": np.full(len(w) - 2, toxic, np.int32), "second": w[:-2], "before": w[1:-1], "word": w[2:]}

    seen = map_batches(sample.where("fold <> 4").select("toxic", "text"), grams, "toxic int, second long, before long, word long").distinct()
    counts = seen.groupBy("before", "word").agg(*[F.count_if(F.col("toxic") == c).cast("int").alias(f"n{c}") for c in (0, 1)]).toArrow()
    columns = [counts[c].to_numpy() for c in ("before", "word", "n0", "n1")]
    del counts
    shared = _shared(documents, np.unique(columns[1].view(np.uint64)))
    model = documents.sparkSession.sparkContext.broadcast(vars(_kneser_ney(*columns[:2], *shared, *columns[2:])))
    del columns

    def measure(batches):
        memo = _Hash()
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                x = Model(**model.value).features([_words(t, memo) for t in part.column("text").to_pylist()])
                yield {"toxic": part.column("toxic"), "x": x.tolist()}

    seen = map_batches(sample.where("fold = 4").select("toxic", "text"), measure, "toxic int, x array<double>").toPandas()
    y = seen["toxic"].to_numpy(float)
    return Fitted(model, _logistic(np.array(seen["x"].tolist()).reshape(-1, FEATURES), y))


def _discounts(n: np.ndarray) -> np.ndarray:
    """Kneser-Ney discounts for counts of 1, 2 and more, from the counts of counts."""
    c = np.bincount(np.minimum(n[n > 0].astype(int), 5), minlength=6)[1:5] + 1.0
    y = c[0] / (c[0] + 2 * c[1])
    return np.clip([1 - 2 * y * c[1] / c[0], 2 - 3 * y * c[2] / c[1], 3 - 4 * y * c[3] / c[2]], 0.5, [1, 2, 3])


def _discounted(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.maximum(n - d[np.clip(n.astype(int), 1, 3) - 1], 0.0)


def _kneser_ney(before: np.ndarray, word: np.ndarray, common: np.ndarray, total: int, *n: np.ndarray) -> Model:
    """From one row for each pair of words, with its counts in the ordinary and the toxic
    texts; ``common`` has the count of each word (ascending) in all documents, ``total`` that of all words."""
    before, word = before.view(np.uint64), word.view(np.uint64)
    pair = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (word * np.uint64(0xC2B2AE3D27D4EB4F) + (word >> np.uint64(29)))
    order = np.argsort(pair)
    pair, n = pair[order], [x[order] for x in n]
    ctx, of = (x.astype(t) for x, t in zip(np.unique(before[order], return_inverse=True), (np.uint64, np.int32)))
    uni, w = (x.astype(t) for x, t in zip(np.unique(word[order], return_inverse=True), (np.uint64, np.int32)))

    def bigrams(count):
        left, follow = _discounted(count, _discounts(count)), np.bincount(of, weights=count, minlength=len(ctx))
        share = left / np.maximum(follow[of], 1)
        return 1 - np.bincount(of, weights=share, minlength=len(ctx)), share

    total_words = max(total, common.sum())
    # the last order: frequency in all documents, and evenly over the words
    even = 1 / (len(uni) + 1.0)
    shared = (1 - EVEN) * common / max(total_words, 1) + EVEN * even
    uni_p, ctx_mass, pair_p, unseen = np.zeros((2, len(uni))), np.ones((3, len(ctx)), np.float32), np.zeros((3, len(pair)), np.float32), np.zeros(2)
    for c in (0, 1):
        count = np.bincount(w[n[c] > 0], minlength=len(uni)).astype(float)  # continuation counts: distinct words before
        left, all_ = _discounted(count, _discounts(count)), max(count.sum(), 1.0)
        uni_p[c] = left / all_ + (1 - left.sum() / all_) * shared
        unseen[c] = (1 - left.sum() / all_) * EVEN * even
        ctx_mass[c], pair_p[c] = bigrams(n[c])
    # a word that neither class has seen says nothing
    unseen[:] = max(unseen.mean(), 1e-12)
    ctx_mass[2], pair_p[2] = bigrams(n[0] + n[1])
    return Model(uni, uni_p, unseen, ctx, ctx_mass, pair, pair_p)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton's method; without both classes the score is the share of toxic rows."""
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.25
        return np.eye(FEATURES)[0] * np.log(rate / (1 - rate))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_toxicity(documents: DataFrame, labels: DataFrame, model: Fitted | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``documents``. Null and
    empty texts have the score of no evidence; repeated rows are scored row by row; a
    null doc_id is never held out. Without labels every score is the same."""
    model = model or fit(documents, labels)
    return _score(_texts(documents), model, "doc_id long, held_out boolean, score double, predicted int")


def _score(rows: DataFrame, model: Fitted, schema: str) -> DataFrame:
    names = rows.columns

    def run(batches):
        memo = _Hash()
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                score = model.score([_words(t, memo) for t in part.column("text").to_pylist()])
                ids = part.column("doc_id").to_pylist()
                extra = {"held_out": [i is not None and fold(i) == 0 for i in ids], "score": score, "predicted": (score >= 0.5).astype(np.int32)}
                yield {n: part.column(n) for n in names} | {k: pa.array(v) for k, v in extra.items()}

    return map_batches(rows, run, schema)


def reject_toxic(documents: DataFrame, labels: DataFrame, model: Fitted | None = None) -> DataFrame:
    """Rows of ``documents`` that are not predicted toxic, with their columns, whatever their
    names. Null and empty texts stay as long as no evidence doesn't mean toxic; repeated rows
    stay or go together; a null doc_id makes no difference. Empty tables give no rows."""
    model = model or fit(documents, labels)

    def keep(batches):
        memo = _Hash()
        for batch in batches:
            for part in slices(batch, "text", STEP_BYTES):
                score = model.score([_words(t, memo) for t in part.column("text").to_pylist()])
                kept = part.filter(pa.array(score < 0.5))
                yield {n: kept.column(n) for n in kept.schema.names}

    return map_batches(documents.withColumn("text", F.col("text").cast("string")), keep, ", ".join(f"`{n}` {t}" for n, t in documents.dtypes))
