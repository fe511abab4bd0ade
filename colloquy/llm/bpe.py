"""Byte-level BPE as a bounded-lookahead streaming transducer.

A text is read from left to right in windows of characters. Special tokens and the split
pattern cut it into pieces; merges never cross pieces, so the tokens of a piece are stable as
soon as its end is: pieces that later characters could still change wait for the next
window. A piece that fills a window is itself encoded in windows of bytes. A token is
emitted once no later byte can change it, and the window moves on from its end: the
encoding right of a token boundary doesn't depend on what is left of it.

How far later bytes reach back follows from the merge list. A merge that later bytes
make or prevent changes whether its left part, or its result, is there for another
merge, which must come later in the list and have that token as its right part; that
merge may pass the change on again. ``lookahead`` is the length of the longest such
chain, measured in bytes of the left parts, so tokens that end that far before the end
of the window are stable. Besides the text, memory is that of the windows and of the memo of
short pieces, however long the text or the piece is.

Decoding maps ids to bytes and feeds an incremental UTF-8 state machine, so a character
whose bytes are spread over tokens comes out when it is complete.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import map_batches, worker_state

#: The pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces up to this many bytes are remembered; at most so many of them.
MEMO_BYTES, MEMO_MOST = 64, 200_000
#: Bytes of a window in a long piece; characters of a window of text, and how far from
#: its end a piece must end to be stable (the longest look ahead of the split pattern).
WINDOW_BYTES, WINDOW_CHARS, MARGIN = 1 << 14, 1 << 16, 8
NONE = 1 << 62
#: PATTERN for texts in which the classes of ``re`` agree with it, and what those texts must not hold.
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?[^\s\w]+|\s+(?!\S)|\s+")
_NOT_PLAIN = re.compile("[_\x1c-\x1f²³¹¼½¾\u0250-\U0010ffff]")


def _byte_symbols() -> dict[str, int]:
    """Printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        symbols = _byte_symbols()
        raw = lambda s: bytes(symbols[c] for c in s)
        self.token = {i: raw(s) for s, i in model["model"]["vocab"].items()}
        ids = {s: i for i, s in self.token.items()}
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        pairs = [(raw(a), raw(b)) for a, b in merges]
        self.rank = {ids[a] << 32 | ids[b]: r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.result = [ids[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.token |= {i: s.encode() for s, i in self.special.items()}
        self.lookahead = self._lookahead(pairs)
        self.window = max(WINDOW_BYTES, 4 * self.lookahead)
        self._split = regex.compile(PATTERN)
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._memo = _Memo(self)

    @staticmethod
    def _lookahead(pairs: list[tuple[bytes, bytes]]) -> int:
        far: dict[bytes, int] = {}
        for a, b in pairs:
            reach = len(a) + max(far.get(b, 0), len(b))
            for t in (a, a + b):
                far[t] = max(far.get(t, 0), reach)
        return max(far.values(), default=0) + max((len(a) + len(b) for a, b in pairs), default=1)

    def _merge(self, data: bytes) -> list[int]:
        """Merges of one window: always the leftmost pair of the lowest rank."""
        get, parts = self.rank.get, [self.byte_id[b] for b in data]
        if len(parts) > 128:
            return self._merge_long(parts)
        ranks = [get(a << 32 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) < NONE:
            i = ranks.index(low)
            parts[i] = self.result[low]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | parts[i], NONE)
            if i < len(ranks):
                ranks[i] = get(parts[i] << 32 | parts[i + 1], NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap, for windows of many bytes."""
        rank, n = lambda a, b: self.rank.get(a << 32 | b, NONE), len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i], parts[i + 1])) < NONE]
        heapq.heapify(heap)
        while heap:
            low, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else n
            if j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = self.result[low], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(parts[i], parts[k])) < NONE:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := rank(parts[h], parts[i])) < NONE:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [p for p in parts if p >= 0]

    def piece(self, chunks: Iterable[bytes]) -> Iterator[list[int]]:
        """Runs of stable tokens of one piece that comes in chunks of bytes."""
        held, token, more, chunks = b"", self.token, True, iter(chunks)
        while True:
            while more and len(held) <= self.window:
                chunk = next(chunks, None)
                more = chunk is not None
                held += chunk or b""
            window = held[: self.window]
            parts = self._merge(window)
            if len(window) == len(held):
                yield parts
                return
            stable, end = [], 0
            for p in parts:
                if end + len(token[p]) > len(window) - self.lookahead:
                    break
                stable.append(p)
                end += len(token[p])
            if not end:
                raise ValueError("the window must hold the lookahead and the longest token")
            yield stable
            held = held[end:]

    def _part(self, text: str, at: int, end: int) -> Iterator[bytes]:
        """Ids of text[at:end], which holds no special token."""
        while at < end:
            stop = min(end, at + WINDOW_CHARS)
            split = self._split if _NOT_PLAIN.search(text, at, stop) else _PLAIN
            found = split.findall(text, at, stop)
            if stop < end:
                keep = stop - MARGIN
                while found and stop > keep:
                    stop -= len(found.pop())
            if not found:  # a piece longer than the window
                stop = self._split.match(text, at, end).end()
                chunks = (text[i : min(i + WINDOW_CHARS, stop)].encode("utf-8", "surrogatepass") for i in range(at, stop, WINDOW_CHARS))
                for run in self.piece(chunks):
                    yield array("I", run).tobytes()
            else:
                yield b"".join(map(self._memo.__getitem__, found))
            at = stop

    def encode(self, text: str | None) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, as soon as they are stable."""
        text, at = text or "", 0
        for m in chain(self._special.finditer(text) if self._special else (), (None,)):
            yield from self._part(text, at, m.start() if m else len(text))
            if m:
                yield np.array([self.special[m[0]]], "<u4").tobytes()
                at = m.end()

    def decode(self, ids: np.ndarray) -> Iterator[str]:
        """Text of a stream of ids; invalid bytes become U+FFFD."""
        utf8, token = codecs.getincrementaldecoder("utf-8")("replace"), self.token
        for at in range(0, len(ids), 4096):
            yield utf8.decode(b"".join(map(token.__getitem__, ids[at : at + 4096].tolist())))
        yield utf8.decode(b"", final=True)


class _Memo(dict):
    """Short pieces and their ids; emptied when full, so memory stays constant."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        out = b"".join([array("I", run).tobytes() for run in self.bpe.piece([data])])
        if len(data) <= MEMO_BYTES:
            if len(self) >= MEMO_MOST:
                self.clear()
            self[piece] = out
        return out


def encode_documents(documents: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", decoded: bool = True) -> DataFrame:
    """``doc_id, ids array<int>`` and, if wanted, ``decoded``, of every whole text. A null
    or empty text has no ids and decodes to the empty text. Map-only; rows are
    independent, so repeated ids and rows need no care."""

    def run(batches):
        bpe = worker_state(f"bpe {path}", lambda: Bpe(path))
        for batch in batches:
            ids = [np.frombuffer(b"".join(bpe.encode(t.as_py())), "<u4") for t in batch.column("text")]
            yield {"doc_id": batch.column("doc_id"), "ids": [i.astype(np.int32) for i in ids], "decoded": ["".join(bpe.decode(i)) if decoded else None for i in ids]}

    return map_batches(_columns(documents, id_col, text), run, "doc_id long, ids array<int>, decoded string")


def _digests(bpe: Bpe, text: str | None, keep: list | None = None) -> tuple[int, str, str]:
    """Number of tokens and digests of the ids and of the decoded text, both as a stream;
    runs of ids are added to ``keep``."""
    n, ids, back = 0, hashlib.sha256(), hashlib.sha256()
    utf8 = codecs.getincrementaldecoder("utf-8")("replace")
    for run_ in bpe.encode(text):
        ids.update(run_)
        n += len(run_) // 4
        bytes_ = b"".join(map(bpe.token.__getitem__, np.frombuffer(run_, "<u4").tolist()))
        back.update(utf8.decode(bytes_).encode())
        if keep is not None:
            keep.append(run_)
    back.update(utf8.decode(b"", final=True).encode())
    return n, ids.hexdigest(), back.hexdigest()


def encoding_digest(documents: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row, from a stream of ids
    for each text. A null or empty text has no tokens and the digests of nothing; repeated
    rows are repeated; an empty table gives no rows; other columns are not returned."""

    def run(batches):
        bpe = worker_state(f"bpe {path}", lambda: Bpe(path))
        for batch in batches:
            found = [_digests(bpe, t.as_py()) for t in batch.column("text")]
            yield {"doc_id": batch.column("doc_id")} | {c: [f[i] for f in found] for i, c in enumerate(("n_tokens", "ids_sha256", "decoded_sha256"))}

    return map_batches(_columns(documents, id_col, text), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_and_check(documents: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, n_tokens, ids_sha256, decoded_sha256, same``: every text is
    encoded and decoded again; ``same`` says whether the decoded text has the digest of its
    source. A null text counts as empty."""

    def run(batches):
        bpe = worker_state(f"bpe {path}", lambda: Bpe(path))
        for batch in batches:
            out = {c: [] for c in ("ids", "n_tokens", "ids_sha256", "decoded_sha256", "same")}
            for t in batch.column("text"):
                source, runs = t.as_py() or "", []
                n, ids, back = _digests(bpe, source, runs)
                for c, v in zip(out, (np.frombuffer(b"".join(runs), "<u4").astype(np.int32), n, ids, back, back == hashlib.sha256(source.encode()).hexdigest())):
                    out[c].append(v)
            yield out | {"doc_id": batch.column("doc_id")}

    return map_batches(_columns(documents, id_col, text), run, "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean")


def _columns(documents: DataFrame, id_col: str, text: str) -> DataFrame:
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
