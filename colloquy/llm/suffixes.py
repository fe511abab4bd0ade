"""Exact removal of repeated byte strings through sampled suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (in a
smaller doc_id, or earlier in the document). Sorting all suffixes would shuffle a
hundred bytes for each byte of text, so the suffixes are thinned first, which loses
nothing: in every window of LENGTH bytes the GRAM-byte string with the smallest hash
(the leftmost of equals) is its anchor. Equal windows have their anchors at the same
offset, so windows need comparing only where their anchors' strings are equal, and
only anchored suffixes (about one in 35) are shuffled.

1. Every anchored suffix becomes a key: its leading bytes, a hash of its GRAM bytes,
   and a hash of its context, the bytes of all windows that it anchors. Keys are dealt
   to buckets by range, with splitters from a bounded sample of the documents, and are
   sorted inside a bucket. A suffix whose context stands earlier is repeated whole; one
   whose anchor string stands alone is not repeated; the rest are undecided.
2. The windows of undecided suffixes are treated the same, one key each.
3. The bytes that the repeated windows cover are removed.

Splitters are keys of the whole sort order (key, context, document, copy, position), so a
string that a third of the documents share is cut over many buckets. Neighbouring
buckets are compared through the splitter between them: it is a suffix of the corpus
itself, so what equals it on the right of the boundary has an earlier equal on the left.
A batch of documents keeps only the first of its equal contexts before the shuffle; the
others are known to be repeated.

Hashes are 64-bit polynomials over random byte values; two of them (104 bits) decide
that windows are equal; where windows of contexts are compared in one place, all that the
hashes call equal are compared by their bytes as well.

A document is a doc_id and a text. Rows that repeat both are counted, not sorted: the first
is as any document, the others stand in it whole. Rows that repeat the doc_id only are
ordered by a hash of their text, their copy number.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import cut, map_batches, slices

LENGTH = 100
GRAM = 32
#: Suffixes sampled for each bucket's splitters, and the most in all.
SAMPLE_PER_BUCKET, SAMPLE_MOST = 200, 200_000
#: Contexts of one anchor string that are compared in one place; windows of more common ones are dealt out singly.
MOST_LOCAL = 1000
#: Bytes of text in one vectorised step, and for each bucket (which holds about as many bytes of keys).
BATCH, BUCKET_BYTES = 1 << 20, 128 << 20

_U = np.uint64
_RNG = np.random.default_rng(20240229)
_VALUE = [_RNG.integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * _U(2) + _U(1) for _ in range(2)]
_BASE = [_U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Windows:
    """Hashes of any byte ranges of one joined text."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix, self.inverse = [], []
        for value, base in zip(_VALUE, _BASE):
            self.prefix.append(np.concatenate([np.zeros(1, _U), np.cumsum(value[data] * _powers(base, n)[:n], dtype=_U)]))
            self.inverse.append(_powers(_U(pow(int(base), -1, 1 << 64)), n))

    def hash(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        p = self.prefix[which]
        return _mix((p[end] - p[start]) * self.inverse[which][start] + (end - start).astype(_U))


def _slide(a: np.ndarray, width: int, op) -> np.ndarray:
    """op over every window of ``width``: out[i] covers a[i : i + width]."""
    have, cur = 1, a
    while have < width:
        step = min(have, width - have)
        cur = op(cur[:-step], cur[step:])
        have += step
    return cur


def join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and the start of each text (with the end of the last)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer(b"".join(texts), np.uint8), starts


def _anchor_of_windows(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of LENGTH bytes inside one text, and their anchors, ascending."""
    n, w = len(data), LENGTH - GRAM + 1
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, have, mult = _VALUE[0][data] >> _U(1), 1, _BASE[0]
    while have < GRAM:
        h = _mix(h[:-have] * mult + h[have:]) if have * 2 == GRAM else h[:-have] * mult + h[have:]
        have, mult = have * 2, _U(int(mult) ** 2 % (1 << 64))
    # the low bits carry the place, so that the minimum tells the leftmost of equals
    place = np.arange(len(h), dtype=_U)
    low = _slide((h & ~_U((1 << 32) - 1)) | place, w, np.minimum)
    ok = np.zeros(n - LENGTH + 1, bool)
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a >= LENGTH:
            ok[a : b - LENGTH + 1] = True
    at = np.flatnonzero(ok)
    return at, (low[at] & _U((1 << 32) - 1)).astype(np.int64)


def _runs(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each anchor with the first and last window that it anchors."""
    at, anchor = _anchor_of_windows(data, starts)
    if not len(at):
        return at, at, at
    new = np.flatnonzero(np.diff(anchor, prepend=-1))
    return anchor[new], at[new], at[np.append(new[1:], len(at)) - 1]


def _keys(win: _Windows, data: np.ndarray, at, lo, hi, context_from, context_to) -> np.ndarray:
    """Sort keys: leading three bytes over 40 bits of the hash of [lo, hi), and the context's hash."""
    lead = (data[at].astype(_U) << _U(16)) | (data[at + 1].astype(_U) << _U(8)) | data[at + 2].astype(_U)
    key = (lead << _U(40)) | (win.hash(0, lo, hi) >> _U(24))
    context = win.hash(1, context_from, context_to) + _mix((at - context_from).astype(_U))
    return np.stack([key, context])


def _signed(a: np.ndarray) -> np.ndarray:
    """Unsigned order as the order of signed longs."""
    return (a ^ _U(1 << 63)).view(np.int64)


# A place is one long: first window, number of windows less one (7 bits), offset of the
# anchor (7). Its order is that of starts.
def _place(first, more, offset):
    return (first << 7 | more) << 7 | offset


def _unplace(place: np.ndarray):
    return place >> 14, (place >> 7) & 127, place & 127


SUFFIX, WINDOW, CONTEXT, KNOWN = 0, 1, 2, 3
REPEATED, FEW, MANY = 1, 2, 3
ORDER = ("key", "context", "doc", "copy", "place")
ROWS = "bucket int, kind int, key long, context long, doc long, copy long, place long, data binary"


def _suffixes(texts: list[bytes], docs: np.ndarray, copies: np.ndarray):
    """``key, context, doc, copy, place`` of the anchored suffixes of a batch of texts."""
    data, starts = join(texts)
    anchor, first, last = _runs(data, starts)
    if not len(anchor):
        return (np.zeros(0, np.int64),) * 5
    keys = _keys(_Windows(data), data, anchor, anchor, anchor + GRAM, first, last + LENGTH)
    doc = np.searchsorted(starts, anchor, side="right") - 1
    return _signed(keys[0]), _signed(keys[1]), docs[doc], copies[doc], _place(first - starts[doc], last - first, anchor - first)


def _windows(contexts: list[bytes], docs: np.ndarray, copies: np.ndarray, firsts: np.ndarray):
    """``key, context, doc, copy, place`` of every window of the contexts (places hold single windows), and where the windows start in the joined contexts."""
    data, starts = join(contexts)
    at = np.concatenate([np.arange(a, b - LENGTH + 1) for a, b in zip(starts[:-1], starts[1:])])
    keys = _keys(_Windows(data), data, at, at, at + LENGTH, at, at + LENGTH)
    of = np.searchsorted(starts, at, side="right") - 1
    rows = _signed(keys[0]), _signed(keys[1]), docs[of], copies[of], _place(firsts[of] + at - starts[of], 0, 0)
    return rows, data, at


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the windows of bytes that start at ``a`` are those at ``b``, some at a time so that few are copied."""
    out = np.ones(len(a), bool)
    step = max(1, BATCH // LENGTH)
    for i in range(0, len(a), step):
        view = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
        out[i : i + step] = (view[a[i : i + step]] == view[b[i : i + step]]).all(1)
    return out


def _order(*columns: np.ndarray) -> np.ndarray:
    """Multikey quicksort: sort by the first column; only runs of equals go on to the next ones."""
    order = np.argsort(columns[0], kind="quicksort")
    if len(columns) == 1 or len(order) < 2:
        return order
    same = np.diff(columns[0][order]) == 0
    tied = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    at = np.flatnonzero(tied)
    if len(at):
        rows = order[at]
        order[at] = rows[np.lexsort([c[rows] for c in reversed(columns)])]
    return order


def _buckets(splitters: list[np.ndarray], *columns: np.ndarray) -> np.ndarray:
    """For each row the number of splitters below it."""
    out = np.searchsorted(splitters[0], columns[0], side="left")
    if len(splitters[0]):
        tuples = list(zip(*[x.tolist() for x in splitters]))
        met = np.flatnonzero(splitters[0][np.minimum(out, len(splitters[0]) - 1)] == columns[0])
        for i in met:
            out[i] = bisect_left(tuples, tuple(int(c[i]) for c in columns))
    return out


def _firsts(kind: int, rows, splitters, n: int) -> dict:
    """Rows to shuffle: the first of equal (key, context) in the batch stays to be decided, others are KNOWN repeated."""
    order = _order(*rows)
    key, context, doc, copy, place = (c[order] for c in rows)
    again = np.zeros(len(key), bool)
    again[1:] = (key[1:] == key[:-1]) & (context[1:] == context[:-1])
    bucket = _buckets(splitters, key, context, doc, copy, place)
    spread = (_mix(doc.view(_U) ^ copy.view(_U) ^ place.view(_U)) % _U(n)).astype(np.int64)
    return {
        "bucket": np.where(again, spread, bucket).astype(np.int32), "kind": np.where(again, KNOWN, kind).astype(np.int32),
        "key": np.where(again, 0, key), "context": np.where(again, 0, context), "doc": doc, "copy": copy, "place": place, "data": pa.nulls(len(key), pa.binary()),
    }


def _decide(splitters: list[np.ndarray]):
    """Decides one bucket: which places are repeated, and which need their windows compared."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        col = {c: table[c].to_numpy() for c in ("bucket", "kind", *ORDER)}
        for bucket in np.unique(col["bucket"]):
            here = col["bucket"] == bucket
            known = here & (col["kind"] == KNOWN)
            yield {"doc": col["doc"][known], "copy": col["copy"][known], "place": col["place"][known], "what": np.full(known.sum(), REPEATED, np.int32)}
            rows = np.flatnonzero(here & (col["kind"] <= WINDOW))
            if len(rows):
                yield _runs_of(col, rows, [s[bucket - 1] for s in splitters] if bucket else None, splitters[0][bucket] if bucket < len(splitters[0]) else None)
            rows = np.flatnonzero(here & (col["kind"] == CONTEXT))
            if len(rows):
                yield _compare({c: v[rows] for c, v in col.items()}, table["data"].take(pa.array(rows)).to_pylist())

    return run


def _runs_of(col, rows, left, right_key) -> dict:
    rows = rows[_order(*[col[c][rows] for c in ORDER])]
    kind, key, context, doc, copy, place = (col[c][rows] for c in ("kind", *ORDER))
    new_key = np.diff(key, prepend=key[0]) != 0
    new_key[0] = True
    new = new_key.copy()
    new[1:] |= context[1:] != context[:-1]
    group = np.cumsum(new_key) - 1
    contexts = np.bincount(group, weights=new).astype(np.int64)[group]
    repeated = ~new
    shared, large = contexts > 1, contexts > MOST_LOCAL
    if left is not None:  # the splitter is a suffix that stands before this bucket
        same = key == left[0]
        shared, large = shared | same, large | same
        repeated |= same & (context == left[1])
    if right_key is not None:
        same = key == right_key
        shared, large = shared | same, large | same
    what = np.where(repeated, REPEATED, np.where(shared & (kind == SUFFIX), np.where(large, MANY, FEW), 0)).astype(np.int32)
    keep = what > 0
    return {"doc": doc[keep], "copy": copy[keep], "place": place[keep], "what": what[keep]}


def _compare(col, contexts: list[bytes]) -> dict:
    """Windows of contexts with the same anchor string: all but the first of equals are repeated."""
    first, _, _ = _unplace(col["place"])
    rows, data, start = _windows(contexts, col["doc"], col["copy"], first)
    order = _order(*rows)
    key, context, doc, copy, place = (c[order] for c in rows)
    again = np.zeros(len(key), bool)
    again[1:] = (key[1:] == key[:-1]) & (context[1:] == context[:-1])
    at = np.flatnonzero(again)
    again[at] = _equal(data, start[order[at]], start[order[at - 1]])
    doc, copy, place = doc[again], copy[again], place[again]
    # neighbouring windows of one document as one place
    order = np.lexsort([place, copy, doc])
    doc, copy, place = doc[order], copy[order], place[order]
    if not len(doc):
        return {"doc": doc, "copy": copy, "place": place, "what": np.zeros(0, np.int32)}
    at = place >> 14
    cut = np.ones(len(at), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]) | (at[1:] != at[:-1] + 1)
    run = np.arange(len(at)) - np.flatnonzero(cut)[np.cumsum(cut) - 1]
    cut |= run % 128 == 0
    begin = np.flatnonzero(cut)
    length = np.diff(np.append(begin, len(at)))
    return {"doc": doc[begin], "copy": copy[begin], "place": place[begin] | (length - 1) << 7, "what": np.full(len(begin), REPEATED, np.int32)}


def _spans(places: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows of the places cover."""
    out: list[list[int]] = []
    first, more, _ = _unplace(np.array(places, np.int64))
    for a, b in sorted(zip(first.tolist(), (first + more + LENGTH).tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


NO_ID = -(1 << 63)


def _with_copies(documents: DataFrame, id_col: str, text: str) -> DataFrame:
    """``doc, copy, named, n, text``: each distinct pair of a doc_id and a text, with the
    number of its rows. Null ids (not ``named``) come first."""
    own = F.col(id_col).cast("long")
    docs = documents.select(F.coalesce(own, F.lit(NO_ID)).alias("doc"), own.isNotNull().alias("named"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    if docs.groupBy("doc").count().where("count > 1").isEmpty():
        return docs.select("doc", F.lit(0).cast("long").alias("copy"), "named", F.lit(1).cast("long").alias("n"), "text")
    once = docs.groupBy("doc", "named", "text").agg(F.count("*").alias("n")).withColumn("h", F.shiftright(F.xxhash64("named", "text"), 4))
    # texts of one id whose hashes are equal (none, as a rule) are told apart by the last bits
    tie = F.row_number().over(Window.partitionBy("doc", "h").orderBy("named", "text")) - 1
    return once.withColumn("copy", F.col("h") * 16 + tie).select("doc", "copy", "named", "n", "text")


def _splitters(docs: DataFrame, least: int) -> list[np.ndarray]:
    """Places of the sort order that part it into ``least`` buckets, or more by BUCKET_BYTES,
    from a sample of the documents, at most SAMPLE_MOST suffixes."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(least, -(-total // BUCKET_BYTES))
    wanted = min(SAMPLE_MOST, SAMPLE_PER_BUCKET * n)
    share = min(1.0, wanted * (LENGTH - GRAM) / 2 / max(1, total))

    def sample(batches):
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                rows = _suffixes([t.encode() for t in part.column("text").to_pylist()], part.column("doc").to_numpy(), part.column("copy").to_numpy())
                yield dict(zip(ORDER, rows))

    rows = map_batches(docs.sample(share, seed=7), sample, ", ".join(f"{c} long" for c in ORDER)).limit(SAMPLE_MOST).toPandas()
    order = np.lexsort([rows[c] for c in reversed(ORDER)])
    if len(order) < n:
        return [np.zeros(0, np.int64)] * 5
    at = order[np.linspace(0, len(order) - 1, n + 1).astype(int)[1:-1]]
    return [rows[c].to_numpy()[at] for c in ORDER]


def repeated_spans(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, copy, places``: for each document with repeated bytes the places that cover them."""
    spark = documents.sparkSession
    docs = _with_copies(documents, id_col, text)
    splitters = _splitters(docs, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    n = len(splitters[0]) + 1

    def suffixes(batches):
        for batch in batches:
            for part in slices(batch, "text", BATCH):
                rows = _suffixes([t.encode() for t in part.column("text").to_pylist()], part.column("doc").to_numpy(), part.column("copy").to_numpy())
                yield _firsts(SUFFIX, rows, splitters, n)

    def by_bucket(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(n, F.col("bucket"))

    found = map_batches(by_bucket(map_batches(docs, suffixes, ROWS)), _decide(splitters), "doc long, copy long, place long, what int")
    marks = cut(found.groupBy("doc", "copy").agg(F.collect_list(F.col("place") * 4 + F.col("what")).alias("marks")))

    def undecided(batches):
        for batch in batches:
            docs_, copies, data, sent = [], [], [], []
            for doc, c, blob, marks_ in zip(*[batch.column(x).to_pylist() for x in ("doc", "copy", "blob", "marks")]):
                raw = zstandard.decompress(blob)
                first, more, offset = _unplace(np.array(marks_, np.int64) >> 2)
                for m, f, e, o in zip(marks_, first.tolist(), (first + more + LENGTH).tolist(), offset.tolist()):
                    if m & 3 == FEW:
                        sent.append((doc, c, m >> 2, raw[f:e], o))
                    else:
                        docs_.append(doc)
                        copies.append((c, f))
                        data.append(raw[f:e])
            if sent:
                joined, starts = join([d for *_, d, _ in sent])
                at = starts[:-1] + np.array([o for *_, o in sent])
                key = _signed(_keys(_Windows(joined), joined, at, at, at + GRAM, at, at)[0])
                zero = np.zeros(len(key), np.int64)
                low = np.full(len(key), -(1 << 63), np.int64)
                yield {
                    "bucket": _buckets(splitters, key, low, low, low, low).astype(np.int32), "kind": np.full(len(key), CONTEXT, np.int32), "key": key, "context": zero,
                    "doc": np.array([d for d, *_ in sent], np.int64), "copy": np.array([c for _, c, *_ in sent], np.int64), "place": np.array([p for _, _, p, *_ in sent], np.int64), "data": pa.array([d for *_, d, _ in sent], pa.binary()),
                }
            for i in range(0, len(data), 4096):
                cf = np.array(copies[i : i + 4096], np.int64)
                yield _firsts(WINDOW, _windows(data[i : i + 4096], np.array(docs_[i : i + 4096], np.int64), cf[:, 0], cf[:, 1])[0], splitters, n)

    open_ = marks.select("doc", "copy", F.filter("marks", lambda m: m.bitwiseAND(3) > REPEATED).alias("marks")).where(F.size("marks") > 0)
    windows = map_batches(_packed(docs).join(open_, ["doc", "copy"]), undecided, ROWS)
    more = map_batches(by_bucket(windows), _decide(splitters), "doc long, copy long, place long, what int")
    settled = marks.select("doc", "copy", F.transform(F.filter("marks", lambda m: m.bitwiseAND(3) == REPEATED), lambda m: F.shiftright(m, 2)).alias("places"))
    later = more.groupBy("doc", "copy").agg(F.collect_list("place").alias("places"))
    return settled.unionAll(later).groupBy("doc", "copy").agg(F.flatten(F.collect_list("places")).alias("places")).where(F.size("places") > 0)


def _packed(docs: DataFrame) -> DataFrame:
    """Texts compressed for the shuffle."""

    def pack(batches):
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield {c: batch.column(c) for c in ("doc", "copy", "named", "n")} | {"blob": pa.array([z.compress(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())}

    return map_batches(docs, pack, "doc long, copy long, named boolean, n long, blob binary")


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if
    wanted, ``kept`` (the bytes that remain).

    A null text counts as empty; a null doc_id sorts before all others; rows that repeat
    a doc_id are documents of their own, ordered by a hash of their text. Texts under LENGTH
    bytes lose nothing. An empty table gives no rows; other columns are not returned."""
    docs = _with_copies(documents, id_col, text)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def finish(batches):
        for batch in batches:
            out = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for doc, named, n, blob, places in zip(*[batch.column(x).to_pylist() for x in ("doc", "named", "n", "blob", "places")]):
                raw = zstandard.decompress(blob)
                spans = _spans(places) if places else []
                kept = b"".join(raw[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(raw)]))
                # rows that repeat the document stand in it whole
                again = (b"", 1) if len(raw) >= LENGTH else (raw, 0)
                for i in range(n):
                    kept, runs = (kept, len(spans)) if i == 0 else again
                    for c, v in zip(out, (doc if named else None, len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept if keep_text else None)):
                        out[c].append(v)
                    if len(out["doc_id"]) >= 1000:
                        yield out
                        out = {c: [] for c in out}
            yield out

    return map_batches(_packed(docs).join(repeated_spans(documents, id_col, text), ["doc", "copy"], "left").select("doc", "named", "n", "blob", "places"), finish, schema)
