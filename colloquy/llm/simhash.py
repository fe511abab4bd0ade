"""SimHash near-duplicates through a byte-position inverted index.

A text is lower-cased (A-Z), cut into words ``[^\\x20\\x09-\\x0D]+`` and shingles of
consecutive words, repeats included. A fingerprint has 64 bits; a bit is 1 if set in
more than half of the shingles' XXH64 values (seed 42). Texts with fewer words than a
shingle have one shingle, those without words the fingerprint zero.

Fingerprints with at most two differing bits differ in at most two bytes, so six of their
eight positional bytes are shared: that is the guaranteed minimum. The inverted index posts
fingerprints by (position, byte). Lists of one byte would hold a 256th of all fingerprints,
so they are kept within buckets: cutting the positions into four groups of two, a pair at
the minimum shares two whole groups, and the bucket is the bytes of two groups (six buckets
for a fingerprint). In a bucket the lists are those of the four other positions. A pair's
tally is the number of positions, of buckets and lists, under which it meets; pairs that
reach six are verified by Hamming distance, others are never looked at.

Equal fingerprints are merged before the index. A list with more than ``MAX_POSTING``
fingerprints is not paired: each of its members is posted under itself and its 64 one-bit
neighbours instead. Two members with at most two differing bits meet under a neighbour of
both, and all that meet there are within two bits, so a link to the smallest is enough for
exact components. At most 65 distinct fingerprints meet under one neighbour, so no group of
any kind is unbounded.

``similar_groups`` links texts by the similarity of their sets of shingles instead, which
64 bits can't tell: postings are of shingles, with the same filter by guaranteed matches.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import components, cut, map_batches, slices

SEED = 42
MAX_BITS = 2
MAX_POSTING = 32
_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a whole text; null counts as empty."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    starts = np.zeros(len(tokens), np.int64)
    np.cumsum([len(t) + 1 for t in tokens[:-1]], out=starts[1:])
    n = max(1, len(tokens) - words + 1)
    begin = starts[:n].tolist()
    end = (starts[words:] - 1).tolist() + [len(joined)] if len(tokens) > words else [len(joined)]
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(begin[at : at + _CHUNK], end[at : at + _CHUNK])])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long. Map-only."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(t.as_py(), words) for t in batch.column("text")]
            yield {"doc_id": batch.column("doc_id"), "fp": np.array(found, np.uint64).view(np.int64)}

    return map_batches(documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, "doc_id long, fp long")


#: Places of the buckets: the two groups of positions whose bytes a bucket has.
PLACES = list(combinations(range(4), 2))


def _bytes(mask: int) -> Column:
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _buckets(fps: DataFrame) -> DataFrame:
    """``(place, bytes, fp)``: the six buckets of each fingerprint."""
    group = [0xFFFF << (16 * g) for g in range(4)]
    keys = F.array(*[F.struct(F.lit(i).alias("place"), _bytes(group[a] | group[b]).alias("bytes")) for i, (a, b) in enumerate(PLACES)])
    return fps.select("fp", F.explode(keys).alias("k")).select("k.place", "k.bytes", "fp")


def _lists(members: DataFrame) -> DataFrame:
    """``(place, bytes, position, byte, fp)``: postings of the four positions that a bucket leaves open."""
    posting = lambda p: F.struct(F.lit(p).alias("position"), F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)).alias("byte"))
    by_place = None
    for i, pair in enumerate(PLACES):
        postings = F.array(*[posting(2 * g + k) for g in range(4) if g not in pair for k in (0, 1)])
        by_place = F.when(F.col("place") == i, postings) if by_place is None else by_place.when(F.col("place") == i, postings)
    return members.select("place", "bytes", "fp", F.explode(by_place).alias("k")).select("place", "bytes", "k.position", "k.byte", "fp")


def links(fps: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints, each within MAX_BITS bits, whose
    components are those of all such pairs. ``fps`` has distinct fingerprints ``fp``."""
    bucket, key = ["place", "bytes"], ["place", "bytes", "position", "byte"]
    posts = _buckets(fps)
    several = posts.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1")
    lists = cut(_lists(posts.join(several.select(*bucket), bucket)))
    sizes = cut(lists.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"))
    small = lists.join(sizes.where(F.col("n") <= MAX_POSTING).select(*key), key).groupBy(*key).agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    met = small.select("place", "position", F.posexplode("fps").alias("i", "a"), "fps").select("place", "position", "a", F.explode(F.slice(F.col("fps"), F.col("i") + 2, F.size("fps"))).alias("b"))
    # positions under which a pair meets, as bits: those of the bucket's two groups and that of the list
    held = F.element_at(F.array(*[F.lit(3 << (2 * a) | 3 << (2 * b)) for a, b in PLACES]), F.col("place") + 1)
    tally = met.groupBy("a", "b").agg(F.bit_count(F.bit_or(held.bitwiseOR(F.call_function("shiftleft", F.lit(1), F.col("position"))))).alias("shared"))
    pairs = tally.where(F.col("shared") >= 8 - MAX_BITS).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b")
    hot = lists.join(sizes.where(F.col("n") > MAX_POSTING).select(*key), key).select("fp").distinct()
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    around = hot.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    stars = around.groupBy("middle").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    stars = stars.select("a", F.explode("all").alias("b")).where("a <> b")
    return pairs.unionAll(stars).distinct()


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest doc_id reachable over fingerprints at most two bits
    apart. Repeated doc_ids give repeated rows; a null doc_id has a component of null
    only if no document with an id is linked to it. An empty table gives no rows."""
    fps = cut(fingerprints(documents, id_col, text, words))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = components(links(distinct.select("fp")))
    roots = distinct.join(linked, distinct.fp == linked.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = roots.join(least, "root").select("fp", "component_id")
    return fps.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ------------------------------------------------------- similar texts, one of each group

#: Words of a shingle, and the Jaccard similarity of shingle sets that counts as near.
WORDS, SIMILAR = 5, 0.8
#: One text of so many is read for the order of shingles, of which so many at most are put last.
ORDER_SAMPLE, ORDER_MOST = 16, 200_000
#: Ids or keys up to this number are broadcast (16 bytes each), more are joined by a shuffle.
BROADCAST_ROWS = 250_000
#: Members of postings are joined one by one to the largest group there while more pairs than
#: this for each text would be left, for so many rounds at most, and as long as a round joins
#: at least one in so many that it tries.
PAIRS_EACH, ROUNDS, JOINED_OF = 64, 6, 8
#: Then postings with more pairs left than that are split: by size, and by so many further shingles.
DEEPER = 3
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word, SEED)
        return out


def _shingles(text: str | None, words: int, memo: _WordHash) -> np.ndarray:
    """64-bit hashes of the distinct shingles of a whole text, ascending; they are made of the words' hashes."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
    n = max(1, len(w) - words + 1)
    h = np.zeros(n, np.uint64)
    for i in range(min(words, len(w))):
        h = (h ^ w[i : i + n]) * _STEP
        h ^= h >> np.uint64(29)
    return np.unique(h)


def _needed(n):
    """Least number of a set's ``n`` shingles that a set at SIMILAR or more to it holds."""
    return np.ceil(SIMILAR * n - 1e-9).astype(np.int64)


def _common(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) and ranks (from 1, the rarer first) of shingles that several texts
    of a sample share. They only set the order of shingles: any order finds every pair, and
    one with common shingles last proposes few others."""

    def run(batches):
        memo = _WordHash()
        for batch in batches:
            yield {"shingle": np.concatenate([_shingles(t.as_py(), words, memo) for t in batch.column("text")] or [np.empty(0, np.uint64)]).view(np.int64)}

    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(ORDER_SAMPLE)) == 0).select("text")
    seen = map_batches(sample, run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    most = seen.orderBy(F.desc("n"), "shingle").limit(ORDER_MOST).toPandas()
    hashes = most["shingle"].to_numpy(np.int64).view(np.uint64)
    ranks = np.arange(len(hashes), 0, -1)
    order = np.argsort(hashes)
    return hashes[order], ranks[order]


def _rarest_first(hashes: np.ndarray, common: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The same hashes (ascending) in the order of postings."""
    if not len(common) or not len(hashes):
        return hashes
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    return hashes[np.argsort(np.where(common[at] == hashes, ranks[at], 0), kind="stable")]


def _possible(a: str, b: str, shared: int = 1) -> Column:
    """Whether two sets whose common shingle number ``shared`` is at places ``at`` (from 0) of
    their orders, with ``n`` shingles each, can reach SIMILAR: no other before is common. A
    pair at SIMILAR passes this where it meets first, so where no meeting passes, it isn't one."""
    n, m, i, j = (F.col(f"{x}.{c}") for c in ("n", "at") for x in (a, b))
    return (F.least(n, m) >= SIMILAR * F.greatest(n, m) - 1e-6) & (F.least(n - i, m - j) + (shared - 1) >= SIMILAR / (1 + SIMILAR) * (n + m) - 1e-6)


def _similar(x: bytes, y: bytes) -> bool:
    """Whether two sets of hashes, each ascending, reach SIMILAR."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared >= SIMILAR * (len(x) + len(y) - shared)


def _small(df: DataFrame) -> DataFrame:
    """``df`` marked for a broadcast if its rows are few. It is a checkpoint, so counting is cheap."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def set_postings(sets: DataFrame) -> DataFrame:
    """``shingle, m (id, n, at)`` of sets ``(id, n, first)``: postings of the first shingles
    of each set, so many that two sets at SIMILAR or more have one in common. Postings
    of one set alone are left out, as found by counts of their keys' 32 bits."""

    def run(batches):
        for batch in batches:
            n = batch.column("n").to_numpy().astype(np.int64)
            first = [np.frombuffer(k, np.int64)[: m - k_ + 1] for k, m, k_ in zip(batch.column("first").to_pylist(), n, _needed(n))]
            posted = np.array([len(f) for f in first], np.int64)
            at = np.concatenate([np.arange(p) for p in posted] or [np.empty(0)])
            yield {"shingle": np.concatenate(first or [np.empty(0, np.int64)]), "id": np.repeat(batch.column("id").to_numpy(), posted), "n": np.repeat(n, posted).astype(np.int32), "at": at.astype(np.int32)}

    posts = map_batches(sets.select("id", "n", "first"), run, "shingle long, id long, n int, at int")
    key = F.shiftright("shingle", 32).cast("int")
    shared = cut(posts.groupBy(key.alias("key")).agg(F.count("*").alias("c")).where("c > 1").select("key"))
    return posts.join(_small(shared), key == F.col("key"), "left_semi").select("shingle", F.struct("id", "n", "at").alias("m"))


def _best(pairs: DataFrame) -> DataFrame:
    """Of pairs ``(id, other)`` with repeats the one that occurs most for each ``id``."""
    tally = pairs.groupBy("id", "other").agg(F.count("*").alias("c"))
    return tally.groupBy("id").agg(F.max(F.struct("c", (-F.col("other")).alias("o"))).alias("b")).select("id", (-F.col("b.o")).alias("other"))


def similar_links(sets: DataFrame, verify) -> DataFrame:
    """Verified pairs ``(a, b)`` whose components are those of all pairs of sets ``(id, n,
    first)`` at SIMILAR or more; ``verify`` takes candidate pairs ``(id, other)``.

    Shared postings are tallied: every set is first compared with that smallest member of
    its postings that it shares most with, which joins most of a large group through as
    many pairs as it has members. Then, in postings that still hold several groups, the
    members outside the largest are compared with one member of it, round by round while
    many pairs would be left and such comparisons join many. Last, every pair of a posting
    whose ends are in different groups is compared, in the parts of ``rest_pairs``, so no
    link is lost."""
    met = cut(set_postings(sets))
    lead = met.groupBy("shingle").agg(F.min("m").alias("l"), F.count("*").alias("c")).where("c > 1").select("shingle", "l")
    star = met.join(lead, "shingle").where("m.id <> l.id").where(_possible("m", "l")).select(F.col("m.id").alias("id"), F.col("l.id").alias("other"))
    links = cut(verify(_best(star)))
    total = sets.count()
    for turn in range(ROUNDS + 1):
        # what is known to be joined: the smallest set that each is linked to, and what that one is linked to
        up = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
        up = up.join(up.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left").select("node", F.coalesce("top", "up").alias("top"))
        member = met.select("shingle", "m", F.col("m.id").alias("node")).join(_small(cut(up)), "node", "left").select("shingle", "m", F.coalesce("top", "node").alias("group"))
        sizes = member.groupBy("shingle", "group").agg(F.count("*").alias("c"), F.min_by("m", F.xxhash64("m.id", F.lit(turn))).alias("one"))
        most = sizes.groupBy("shingle").agg(F.count("*").alias("groups"), F.max(F.struct("c", "group", "one")).alias("top")).where("groups > 1")
        open_ = cut(member.join(most, "shingle").select("shingle", "m", "group", "top"))
        outside = open_.where("group <> top.group")
        tried = outside.where(_possible("m", "top.one")).select(F.col("m.id").alias("id"), F.col("top.one.id").alias("other"), "top.c")
        if turn == ROUNDS or (tried.agg(F.sum("c")).first()[0] or 0) <= PAIRS_EACH * total:
            break
        found = cut(verify(_best(tried)))
        links = links.unionAll(found)
        if found.count() * JOINED_OF < tried.select("id").distinct().count():  # others than these are what the postings hold
            break
    rest = rest_pairs(open_.select("shingle", "m", "group"), sets)
    return links.unionAll(verify(rest))


def _weighed(rows: DataFrame, shared: int) -> DataFrame:
    """``rows`` of keys with several groups, with the largest group ``top`` of the key, the
    ``pairs`` that members outside it make with all, the number ``many`` of members and the
    number ``ahead`` of rows that a split by a further shingle gives."""
    ahead = F.greatest(F.col("m.n") - F.ceil(SIMILAR * F.col("m.n") - 1e-9) + shared - F.col("m.at"), F.lit(0))
    sizes = rows.groupBy("key", "group").agg(F.count("*").alias("c"), F.sum(ahead).alias("a"))
    keys = sizes.groupBy("key").agg(F.count("*").alias("groups"), F.max(F.struct("c", "group")).alias("most"), F.sum("c").alias("many"), F.sum("a").alias("ahead")).where("groups > 1")
    return rows.join(keys.select("key", F.col("most.group").alias("top"), ((F.col("many") - F.col("most.c")) * F.col("many")).alias("pairs"), "many", "ahead"), "key")


def _by_size(rows: DataFrame) -> DataFrame:
    """Keys split by sizes: class k holds sizes from (just over) 1.25**k, so sets at SIMILAR are in one
    class or in neighbours. Each set is in its own class and in the next; ``own`` tells which."""
    k = F.floor(F.log(F.col("m.n").cast("double")) / F.log(F.lit(1 / SIMILAR + 1e-6)))
    either = F.explode(F.array(F.struct(k.alias("k"), F.lit(True).alias("own")), F.struct((k + 1).alias("k"), F.lit(False).alias("own"))))
    return rows.select("key", "m", "group", either.alias("e")).select(F.col("key").alias("parent"), F.xxhash64("key", "e.k").alias("key"), "m", "group", "e.own")


def _by_shingle(rows: DataFrame, sets: DataFrame, shared: int) -> DataFrame:
    """Keys split by the next common shingle: two sets at SIMILAR that have ``shared`` in
    common, up to places ``at``, have another one at a later place, of which the last is
    ``n - needed + shared``."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "first", 1 << 18):
                n, at = (part.column(c).to_numpy().astype(np.int64) for c in ("n", "at"))
                first = [np.frombuffer(f, np.int64)[a + 1 : m - k + shared + 1] for f, a, m, k in zip(part.column("first").to_pylist(), at, n, _needed(n))]
                many = [len(f) for f in first]
                held = {c: np.repeat(part.column(c).to_numpy(zero_copy_only=False), many) for c in ("key", "id", "n", "group", "own")}
                places = np.concatenate([np.arange(a + 1, a + 1 + c) for a, c in zip(at, many)])
                yield held | {"at": places.astype(np.int32), "shingle": np.concatenate(first)}

    met = rows.select("key", "m.id", "m.n", "m.at", "group", "own").join(sets.select("id", F.col("n").cast("int").alias("n"), "first"), ["id", "n"])
    out = map_batches(met.select("key", "id", "n", "at", "group", "own", "first"), run, "key long, id long, n int, at int, group long, own boolean, shingle long")
    return out.select(F.col("key").alias("parent"), F.xxhash64("key", "shingle").alias("key"), F.struct("id", "n", "at").alias("m"), "group", "own")


def _across(rows: DataFrame, shared: int) -> DataFrame:
    """Pairs ``(id, other)`` of a key whose ends are in different groups and can reach SIMILAR."""
    a = rows.where("group <> top").select("key", F.col("m").alias("x"), F.col("group").alias("group_x"), F.col("own").alias("own_x"))
    b = rows.select("key", F.col("m").alias("y"), F.col("group").alias("group_y"), F.col("own").alias("own_y"))
    met = a.join(b, "key").where("group_x <> group_y and (own_x or own_y)").where(_possible("x", "y", shared))
    return met.select(F.greatest("x.id", "y.id").alias("id"), F.least("x.id", "y.id").alias("other"))


def rest_pairs(postings: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``(id, other)`` of ``postings (shingle, m, group)`` whose ends are in different
    groups: all of those at SIMILAR, and others.

    A posting whose pairs are more than PAIRS_EACH for each member is split by the sizes of
    its sets, and then, while that at least halves its pairs and gives fewer rows than pairs,
    by a further shingle that sets at SIMILAR must have in common, DEEPER times at most. So
    unlike texts that share a frequent shingle are parted, and no pair at SIMILAR is."""
    now = cut(_weighed(postings.select(F.col("shingle").alias("key"), "m", "group", F.lit(True).alias("own")), 1))
    many = lambda rows, ahead: rows.where(F.col("pairs") > F.greatest(PAIRS_EACH * F.col("many"), 2 * F.col("ahead") if ahead else F.lit(0)))
    hot = many(now, False)
    if hot.isEmpty():
        return _across(now, 1).distinct()
    few = now.where(F.col("pairs") <= PAIRS_EACH * F.col("many"))
    out, now = _across(few, 1), cut(_weighed(_by_size(hot).drop("parent"), 1))
    for shared in range(1, DEEPER + 1):
        hot = many(now, True)
        if hot.isEmpty():
            break
        parts = cut(_weighed(_by_shingle(hot, sets, shared), shared + 1))
        after = parts.groupBy("key").agg(F.first("parent").alias("parent"), F.first("pairs").alias("pairs")).groupBy("parent").agg(F.sum("pairs").alias("after"))
        before = hot.groupBy("key").agg(F.first("pairs").alias("pairs"))
        split = cut(before.join(after, F.col("key") == F.col("parent"), "left").where(2 * F.coalesce("after", F.lit(0)) <= F.col("pairs")).select("key"))
        out = out.unionAll(_across(now.join(split, "key", "left_anti"), shared))
        now = parts.join(split.withColumnRenamed("key", "parent"), "parent", "left_semi").drop("parent")
    else:
        shared = DEEPER + 1
    return out.unionAll(_across(now, shared)).distinct()


def similar_groups(documents: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, linked: DataFrame | None = None) -> DataFrame:
    """``doc_id, component_id`` for every distinct doc_id: texts whose shingle sets have
    a similarity of SIMILAR or more are linked, and so are the ids ``(a, b)`` of ``linked``.
    Texts without words have equal (empty) sets. Rows that repeat a doc_id are one document,
    linked by each of their texts.

    Equal sets are merged first, by 128 bits of hash. Postings propose every other pair at
    SIMILAR or more (``similar_links``). Of a proposed pair the shared posted shingles are
    counted, and pairs that reach the least number of matches that SIMILAR guarantees are
    verified by the exact similarity of their sets, read again from the texts."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    common = rows.sparkSession.sparkContext.broadcast(_common(rows, words))

    def read(batches):
        memo = _WordHash()
        for batch in batches:
            out = {c: [] for c in ("n", "first", "mark")}
            for t in batch.column("text"):
                x = _shingles(t.as_py(), words, memo)
                first = _rarest_first(x, *common.value)[: len(x) - int(_needed(len(x))) + 1 + DEEPER] if len(x) else x
                for c, v in zip(out, (len(x), first.tobytes(), xxhash.xxh3_128_digest(x.tobytes()))):
                    out[c].append(v)
            yield out | {"doc_id": batch.column("doc_id")}

    read_ = cut(map_batches(rows, read, "doc_id long, n long, first binary, mark binary"))
    equal = cut(read_.groupBy("mark").agg(F.min("doc_id").alias("id")))
    sets = read_.withColumnRenamed("doc_id", "id").join(_small(equal), ["id", "mark"], "left_semi").select("id", "n", "first")
    if sets.count() > sets.select("id").distinct().count():  # rows that repeat an id
        sets = sets.distinct()
    if equal.count() > BROADCAST_ROWS:  # joined by a shuffle, which is made once
        sets = cut(sets)

    def sets_of(batches):
        memo = _WordHash()
        for batch in batches:
            for part in slices(batch, "text"):
                yield {"id": part.column("doc_id"), "set": [_shingles(t.as_py(), words, memo).tobytes() for t in part.column("text")]}

    def by_sets(batches):
        for batch in batches:
            near = pa.array([_similar(x.as_py(), y.as_py()) for x, y in zip(batch.column("x"), batch.column("y"))], pa.bool_())
            yield {"a": batch.column("a").filter(near), "b": batch.column("b").filter(near)}

    def by_counts(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            near = []
            for i, (x, y) in enumerate(zip(batch.column("first").to_pylist(), batch.column("y").to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                # what is behind the posted shingles of one of the two can be shared as well
                most = len(np.intersect1d(x, y, assume_unique=True)) + max(n[i] - len(x), m[i] - len(y))
                near.append(most >= SIMILAR / (1 + SIMILAR) * (n[i] + m[i]) - 1e-6)
            near = pa.array(near, pa.bool_())
            yield {"id": batch.column("id").filter(near), "other": batch.column("other").filter(near)}

    def named(pairs, end):
        return _small(cut(pairs.select(F.col(end).alias("id")).distinct()))

    def held(pairs, end):
        of = rows.join(named(pairs, end).withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
        return map_batches(of, sets_of, "id long, set binary")

    def verify(pairs):
        # few pairs go to the sets, so that only the sets of pairs are shuffled, once for each end
        pairs = cut(pairs)
        y = sets.join(named(pairs, "other"), "id", "left_semi").select(F.col("id").alias("other"), F.col("n").alias("m"), F.col("first").alias("y"))
        met = sets.join(_small(pairs), "id").join(y, "other")
        pairs = cut(map_batches(met.select("id", "other", "n", "m", "first", "y"), by_counts, "id long, other long").distinct())
        y = held(pairs, "other").select(F.col("id").alias("other"), F.col("set").alias("y"))
        met = held(pairs, "id").join(_small(pairs), "id").join(y, "other")
        return map_batches(met.select(F.col("id").alias("a"), F.col("other").alias("b"), F.col("set").alias("x"), "y"), by_sets, "a long, b long")

    links = similar_links(sets, verify).unionAll(read_.join(equal, "mark").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    joined = components(cut(links if linked is None else links.unionAll(linked.select("a", "b"))))
    return rows.select("doc_id").distinct().join(joined, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_duplicates(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``documents`` without all but the smallest id of each group of near-duplicates:
    those of :func:`near_duplicates`, by fingerprints, joined with those of similar sets of
    shingles, which fingerprints of 64 bits alone would leave; of rows that repeat an id, which are one document, the one of the least hash of
    its text stays. Rows without an id stay. Texts without words are equal to each other."""
    near = near_duplicates(documents, id_col, text).where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    groups = similar_groups(documents, id_col, text, linked=near)
    gone = _small(cut(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))))
    kept = documents.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
    twice = cut(documents.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_twice")).count().where("count > 1").select("_twice"))
    if twice.isEmpty():
        return kept
    # only rows that repeat an id are sorted with their texts
    repeated = F.col(id_col) == F.col("_twice")
    first = F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text), text))
    one = kept.join(_small(twice), repeated, "left_semi").withColumn("_nth", first).where("_nth = 1").drop("_nth")
    return one.unionAll(kept.join(_small(twice), repeated, "left_anti"))
