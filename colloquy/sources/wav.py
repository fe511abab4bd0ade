"""Data sources of WAV recordings: headers by a read of their first bytes, and samples by byte ranges.

``wav_headers`` and ``wav_blocks`` list files on the driver, metadata only; tasks open a
file and read ranges of it, never the whole recording for its header.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from colloquy.sources.stores import file_system

#: Bytes up to the samples of a plain file: its fields have fixed places.
HEAD = 44
FILES, BLOCK = 256, 1 << 16


class Reached(Exception):
    """The header can't be read; the message says why."""


def parse_head(head: bytes) -> dict | None:
    """Channels, rate and bits at their fixed places; None if the file is shorter than a header."""
    if len(head) < HEAD:
        return None
    little = lambda at, n: int.from_bytes(head[at : at + n], "little")
    return {"channels": little(22, 2), "sample_rate": little(24, 4), "bits": little(34, 2)}


def walk_chunks(read, size: int) -> dict:
    """Format and place of the samples, found by the heads of the chunks: ``fmt `` and ``data``
    may stand behind others. ``read(at, n)`` reads a range."""
    top = read(0, 12)
    if len(top) < 12 or top[:4] != b"RIFF" or top[8:] != b"WAVE":
        raise Reached("no RIFF file")
    at, found = 12, {}
    while at + 8 <= size:
        head = read(at, 8)
        name, n = head[:4], int.from_bytes(head[4:], "little")
        if name == b"fmt " and n >= 16:
            f = read(at + 8, 16)
            found |= {"kind": int.from_bytes(f[:2], "little"), "channels": int.from_bytes(f[2:4], "little"), "sample_rate": int.from_bytes(f[4:8], "little"), "bits": int.from_bytes(f[14:16], "little")}
        elif name == b"data":
            return found | {"data_at": at + 8, "data_bytes": min(n, size - at - 8)} if found else found
        at += 8 + n + n % 2
    return found


def reason_of(found: dict | None) -> str | None:
    """Why a recording isn't 16 kHz mono 16-bit; None if it is."""
    if found is None:
        return "too short"
    if not found:
        return "no format"
    if found["channels"] != 1:
        return "not mono"
    if found["sample_rate"] != 16000:
        return "not 16 kHz"
    return None if found["bits"] == 16 else "not 16-bit"


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.walk = options["path"], str(options.get("walk", "false")).lower() == "true"
        self.per_task = int(options.get("filesPerTask", FILES))

    def _files(self) -> list[tuple[str, int]]:
        fs, root = file_system(self.path)
        found = fs.get_file_info(root)
        infos = [found] if found.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        return sorted((i.path, i.size) for i in infos if i.type == pafs.FileType.File and i.path.lower().endswith(".wav"))

    def partitions(self) -> list[InputPartition]:
        files = self._files()
        return [_Files(files[i : i + self.per_task]) for i in range(0, len(files), self.per_task)] or [_Files([])]

    def _each(self, files):
        """``(path, size, what was found, bytes read)`` of files, by ranges."""
        fs = file_system(self.path)[0]
        for path, size in files:
            took = 0
            with fs.open_input_file(path) as f:

                def read(at: int, n: int) -> bytes:
                    nonlocal took
                    out = f.read_at(n, at)
                    took += len(out)
                    return out

                try:
                    found, error = walk_chunks(read, size) if self.walk else parse_head(read(0, HEAD)), None
                except Reached as e:
                    found, error = {}, str(e)
            yield path, size, found, error, took


class _Heads(_Reader):
    def read(self, partition: _Files) -> Iterator[tuple]:
        for path, size, found, error, took in self._each(partition.files):
            f = found or {}
            yield path, path.rsplit("/", 1)[-1], size, f.get("channels"), f.get("sample_rate"), f.get("bits"), error or reason_of(found), took


class WavHeaders(DataSource):
    """Options: ``path``; ``walk`` (true: chunks are walked, so ``fmt `` may stand behind others;
    else the fields' fixed places are read); ``filesPerTask``."""

    @classmethod
    def name(cls) -> str:
        return "wav_headers"

    def schema(self) -> str:
        return "path string, name string, length long, channels int, sample_rate long, bits int, reason string, bytes_read long"

    def reader(self, schema) -> DataSourceReader:
        return _Heads(self.options)


class _Samples(_Reader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.walk, self.block = True, int(options.get("block", BLOCK))

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs = file_system(self.path)[0]
        for path, _, found, error, _ in self._each(partition.files):
            if error or found.get("kind") != 1 or found.get("bits") != 16 or "data_at" not in found:
                continue
            channels = found["channels"]
            n = found["data_bytes"] // (2 * channels)
            with fs.open_input_file(path) as f:
                for start in range(0, n, self.block):
                    count = min(self.block, n - start)
                    raw = np.frombuffer(f.read_at(count * 2 * channels, found["data_at"] + start * 2 * channels), "<i2").reshape(-1, channels)
                    for c in range(channels):
                        values = pa.array([(raw[:, c] / np.float32(32768)).astype(np.float32)], pa.list_(pa.float32()))
                        yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[-1]]), pa.array([found["sample_rate"]], pa.int64()), pa.array([c], pa.int32()), pa.array([start], pa.int64()), pa.array([n], pa.int64()), values], names=["series_id", "rate", "channel", "start", "n", "samples"])


class WavBlocks(DataSource):
    """16-bit PCM as blocks of samples, a row for each channel of each; files of other kinds are
    left out. Options: ``path``; ``block``, the samples of a block; ``filesPerTask``."""

    @classmethod
    def name(cls) -> str:
        return "wav_blocks"

    def schema(self) -> str:
        return "series_id string, rate long, channel int, start long, n long, samples array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _Samples(self.options)


def read_wav_headers(spark: SparkSession, path: str, walk: bool = False) -> DataFrame:
    """``path, name, length, channels, sample_rate, bits, reason, bytes_read`` of the WAVs below a
    folder; ``reason`` says why one isn't 16 kHz mono 16-bit (null: it is)."""
    spark.dataSource.register(WavHeaders)
    return spark.read.format("wav_headers").option("path", path).option("walk", str(walk)).load()


def read_wav_blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Blocks of samples between -1 and 1 of the 16-bit WAVs below a folder, by ranges of bytes."""
    spark.dataSource.register(WavBlocks)
    return spark.read.format("wav_blocks").option("path", path).option("block", block).option("filesPerTask", 1).load()
