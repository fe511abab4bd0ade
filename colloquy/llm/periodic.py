"""Periodic runs of words: recursive splitting at rare words, then a scan of the lags at which words recur.

Words are runs of other characters between white space (blank, tab to carriage return). A
run is a stretch of words of smallest period q, at least 24 words and three periods long,
that no neighbour extends. Null texts count as empty, null ids as an empty number.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame

from colloquy.llm.common import map_batches, slices

#: A run has at least so many words and so many periods.
LEAST, PERIODS = 24, 3
#: Words that must recur: a run of a period up to BASE has so many behind its first period.
BASE = 16
#: Characters of a text that are cut into words together.
WINDOW = 1 << 20
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]")


def words_of(text: str, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(ids, starts, ends)`` of the words: equal words have equal ids; places in code points."""
    known, ids, starts, ends, at = {}, [], [], [], 0
    while at < len(text):
        cut = len(text)
        if at + window < len(text) and (found := _SPACE.search(text, at + window)):
            cut = found.start()
        part = text[at:cut]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        space = np.concatenate([[True], (codes == 32) | ((codes >= 9) & (codes <= 13)), [True]])
        turns = np.flatnonzero(space[1:] != space[:-1]) + at
        starts.append(turns[0::2])
        ends.append(turns[1::2])
        ids.append(np.fromiter((known.setdefault(w, len(known)) for w in _WORD.findall(part)), np.int64, len(turns) // 2))
        at = cut
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(ids), join(starts), join(ends)


def segments(ids: np.ndarray) -> np.ndarray:
    """Starts and ends, in rows, of the stretches that may hold runs. Every word of a run occurs
    in it PERIODS times, so a word rarer than that within its stretch splits it; what is left is
    split again until no word is too rare, and what is shorter than a run goes."""
    found, todo = [], np.array([[0, len(ids)]], np.int64)
    while True:
        todo = todo[todo[:, 1] - todo[:, 0] >= LEAST]
        if not len(todo):
            break
        size = todo[:, 1] - todo[:, 0]
        own = np.repeat(np.arange(len(todo)), size)
        place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(todo[:, 0], size)
        _, which, count = np.unique(own * (ids.max() + 1) + ids[place], return_inverse=True, return_counts=True)
        rare = count[which] < PERIODS
        stable = ~np.isin(np.arange(len(todo)), own[rare])
        found.append(todo[stable])
        # stretches of words that aren't rare, within those that have rare ones
        some = ~rare & ~stable[own]
        first = some & np.concatenate([[True], ~some[:-1] | (own[1:] != own[:-1])])
        last = some & np.concatenate([~some[1:] | (own[1:] != own[:-1]), [True]])
        todo = np.stack([place[first], place[last] + 1], axis=1)
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _next(ranks: np.ndarray) -> np.ndarray:
    """How far behind each place the same rank stands again; 0 where it doesn't."""
    order = np.argsort(ranks, kind="stable")
    gap = np.zeros(len(ranks), np.int64)
    same = ranks[order[1:]] == ranks[order[:-1]]
    gap[order[:-1][same]] = order[1:][same] - order[:-1][same]
    return gap


def lag_scan(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of a stretch.

    Lags are scanned by lengths m = BASE, 2 BASE, 4 BASE, ...: a run of a period q with m/2 < q
    <= m (q <= m for BASE) has m equal words behind each of the first places of two of its
    periods, and these m words stand again after q words and, as q is its smallest period, not
    before. So the places whose m words stand again first after q words, next to each other, are
    a whole run, and the stretch in which words q apart are equal needs no other scan. The m
    words at a place are known by a rank, made of the ranks of their halves; nothing is hashed."""
    out, m, ranks, n = [], 1, _ranks(ids), len(ids)
    while m < BASE or m <= n // PERIODS * 2:
        if m >= BASE and n > m:
            gap = _next(ranks)
            gap[(gap > m) | (gap <= (m // 2 if m > BASE else 0))] = 0
            edge = np.flatnonzero(np.diff(gap, prepend=0, append=0))
            for a, b in zip(edge[:-1], edge[1:]):
                q = int(gap[a])
                length = int(b - a) - 1 + m + q
                if q and length >= max(LEAST, PERIODS * q):
                    out.append((int(a), length, q))
        if n < 2 * m:
            break
        ranks = _ranks(ranks[:-m] * (n + 1) + ranks[m:])
        m *= 2
    return out


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs, by start and then period."""
    return sorted(((int(a) + s, n, q) for a, b in segments(ids) for s, n, q in lag_scan(ids[a:b])), key=lambda r: (r[0], r[2]))


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, compared exactly; ties to the smallest start, then period."""
    best = None
    for s, n, q in runs:
        if best is None or n * best[2] > best[1] * q or (n * best[2] == best[1] * q and (s, q) < (best[0], best[2])):
            best = (s, n, q)
    return best


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words are repeats: those of a run behind its first period."""
    steps = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        steps[s + q] += 1
        steps[s + length] -= 1
    return np.cumsum(steps[:-1]) > 0


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """Which original word stands at each place: every tenth document, by a checksum of its id,
    goes on with a period of its words from some place on; others are as they were."""
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    at = np.arange(n)
    if h % 10 == 0 and n > 0:
        g = h // 10
        a = g % n
        at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def _joined(text: str, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 16):
    """The words joined by blanks, in parts."""
    for at in range(0, len(starts), step):
        yield (" " if at else "") + " ".join(text[a:b] for a, b in zip(starts[at : at + step].tolist(), ends[at : at + step].tolist()))


def collapse(docs: DataFrame, plant: bool = False) -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs, text``: the run of the
    greatest exponent (nulls: no run), all runs as ``start,length,period`` lines, and the text
    without the words that repeat a run's first period, joined by blanks. With ``plant`` every
    tenth document is made periodic first. Rows are taken as they are, an empty table gives an
    empty one, other columns are left out. Nothing is shuffled; a task holds one batch, and of
    a text its words as numbers. Where nothing repeats, no lag is scanned."""

    def run(batches):
        for batch in batches:
            for i, runs, lines, parts in _each([batch], plant):
                yield {c: [v] for c, v in zip((*COLUMNS[:6], "runs", "text"), (i, *_summary(runs), lines, "".join(parts)))}

    return map_batches(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), run, _SCHEMA + ", runs string, text string")


_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long"


def _summary(runs) -> tuple:
    best = best_run(runs)
    return (len(runs), *best, 1000 * best[1] // best[2]) if best else (0, None, None, None, None)


def _each(batches, plant: bool):
    for batch in batches:
        for part in slices(batch, "text"):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                text = text.as_py() or ""
                ids, starts, ends = words_of(text)
                if plant:
                    at = planted(doc_id, len(ids))
                    ids, starts, ends = ids[at], starts[at], ends[at]
                runs = runs_of(ids)
                stay = ~dropped(len(ids), runs)
                yield doc_id, runs, "".join(f"{s},{n},{q}\n" for s, n, q in runs), _joined(text, starts[stay], ends[stay])


def digest(docs: DataFrame) -> DataFrame:
    """As :func:`collapse` on documents made periodic, with digests in place of runs and text."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, runs, lines, parts in _each([batch], True):
                kept = hashlib.sha256()
                for p in parts:
                    kept.update(p.encode("utf-8", "surrogatepass"))
                rows.append((doc_id, *_summary(runs), hashlib.sha256(lines.encode()).hexdigest(), kept.hexdigest()))
            yield {c: list(v) for c, v in zip(COLUMNS, zip(*rows))} if rows else {c: [] for c in COLUMNS}

    return map_batches(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), run, _SCHEMA + ", runs_sha256 string, collapsed_sha256 string")
