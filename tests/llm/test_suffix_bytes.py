"""Windows of contexts are told apart by their bytes, whatever their number and their hashes."""

import numpy as np
import pytest

from colloquy.llm import suffixes


@pytest.mark.parametrize("batch", [1, 1 << 20])
def test_equal_hashes_of_unlike_bytes_are_no_repeats(monkeypatch, batch):
    monkeypatch.setattr(suffixes, "BATCH", batch)
    one, other = bytes(range(120)), bytes(range(100, 220))
    texts = [one, other, one, one[:100]]
    col = {"doc": np.arange(4), "copy": np.zeros(4, np.int64), "place": np.array([suffixes._place(0, len(t) - suffixes.LENGTH, 0) for t in texts], np.int64)}
    found = suffixes._compare(col, texts)
    assert sorted(set(found["doc"].tolist())) == [2, 3]
    # the same with hashes that are all equal: neighbours in the order are compared by bytes
    monkeypatch.setattr(suffixes, "_keys", lambda data, raw, at, *rest: (np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)))
    found = suffixes._compare({k: v[:2] for k, v in col.items()}, texts[:2])
    assert not len(found["doc"])


def test_no_windows():
    none = np.zeros(0, np.int64)
    assert not len(suffixes._equal(np.zeros(5, np.uint8), none, none))
