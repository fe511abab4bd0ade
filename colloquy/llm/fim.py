"""Fill-in-the-middle: texts are cut at two ranks of their tokens, found through an indexable skip list.

A token is a run of other characters with the white space before it, or the white space at
the end of a text. Null texts count as empty, null ids as an empty number.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from colloquy.llm.common import map_batches, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Texts in a hundred that are transformed, and of these those with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
SEED = 42
#: A node of a lane stands for so many of the lane below.
FANOUT = 16
#: Characters of a text that are looked at together.
WINDOW = 1 << 20


def _is_space(codes: np.ndarray) -> np.ndarray:
    return (codes == 32) | ((codes >= 9) & (codes <= 13))


def token_widths(text: str, window: int = WINDOW) -> np.ndarray:
    """Code points of each token. The text is looked at in windows; a token ends behind a
    character that is no white space where white space or the end of the text follows."""
    ends = []
    for at in range(0, len(text), window):
        # one character more tells whether the window's last one ends a token
        space = _is_space(np.frombuffer(text[at : at + window + 1].encode("utf-32-le", "surrogatepass"), np.uint32))
        if at + window >= len(text):
            space = np.append(space, True)
        ends.append(np.flatnonzero(~space[:-1] & space[1:]) + at + 1)
    last = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    if len(text) and (not len(last) or last[-1] < len(text)):
        last = np.append(last, len(text))
    return np.diff(last, prepend=0).astype(np.int64)


class SkipList:
    """Tokens of a text below express lanes. A node of a lane carries two widths, the tokens
    and the code points that its link passes over; a search descends by their sums, so any
    rank is reached in a few steps of each lane."""

    def __init__(self, widths: np.ndarray, fanout: int = FANOUT):
        self.fanout, self.size = fanout, len(widths)
        units, points = np.ones(len(widths), np.int64), widths
        self.lanes = [(units, points)]
        while len(units) > fanout:
            firsts = np.arange(0, len(units), fanout)
            units, points = np.add.reduceat(units, firsts), np.add.reduceat(points, firsts)
            self.lanes.append((units, points))

    def offset(self, rank: int) -> int:
        """The code points of the first ``rank`` tokens."""
        if not 0 <= rank <= self.size:
            raise IndexError(rank)
        node = passed = points = 0
        for units, widths in reversed(self.lanes):
            node *= self.fanout
            while node < len(units) and passed + units[node] <= rank:
                passed, points, node = passed + int(units[node]), points + int(widths[node]), node + 1
        return points


@dataclass
class Filled:
    n: int
    form: str
    output: str
    prefix_chars: int | None
    middle_chars: int | None


def transform(doc_id: int | None, text: str, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> Filled:
    """The text in its form: ``plain``, ``psm`` or ``spm``; form and cuts follow from the id's digest."""
    tokens = SkipList(token_widths(text))
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return Filled(tokens.size, "plain", text, None, None)
    a, b = (tokens.offset(rank) for rank in sorted((h1 % (tokens.size + 1), h2 % (tokens.size + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return Filled(tokens.size, "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", a, b - a)
    return Filled(tokens.size, "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", a, b - a)


def restore(output: str, form: str) -> str:
    """The text of an output: the parts of a text that holds no mark can't hide one, nor make one at a seam."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if not output.startswith(first):
        raise ValueError(f"no {form} text")
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(MIDDLE)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: every text in its form. Rows are
    taken as they are: repeated ids give the same cuts for their own texts, other columns are
    left out, an empty table gives an empty one. Nothing is shuffled; a task holds one batch."""

    def run(batches):
        for doc_id, out, _ in _each(batches, rate, suffix_first, seed):
            yield dict(zip(("doc_id", "n", "form", "prefix_chars", "middle_chars", "output"), ([v] for v in (doc_id, out.n, out.form, out.prefix_chars, out.middle_chars, out.output))))

    return map_batches(docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text"), run, SCHEMA + ", output string")


def _each(batches, rate: int, suffix_first: int, seed: int):
    for batch in batches:
        for part in slices(batch, "text"):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                text = text.as_py() or ""
                yield doc_id, transform(doc_id, text, rate, suffix_first, seed), text


def digest(docs: DataFrame) -> DataFrame:
    """As :func:`fill_in_middle`, with digests of the output and of the text restored from it
    in place of the output."""
    columns = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches):
        for batch in batches:
            rows = [(i, o.n, o.form, o.prefix_chars, o.middle_chars, sha(o.output), sha(restore(o.output, o.form))) for i, o, _ in _each([batch], RATE, SUFFIX_FIRST, SEED)]
            yield {c: list(v) for c, v in zip(columns, zip(*rows))} if rows else {c: [] for c in columns}

    return map_batches(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), run, SCHEMA + ", output_sha256 string, restored_sha256 string")
