"""A sink of whole files: one for each row, moved into place when all tasks are done.

A task writes to a folder of its own below ``_staging-...``; the commit on the driver moves
the files of the tasks that were kept, so neither a repeated task nor a failed job leaves a
file twice or in part.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from colloquy.operators import render
from colloquy.operators.edits import note_order
from colloquy.sources.stores import file_system

#: Files in an Arrow batch.
BATCH_ROWS = 200


@dataclass
class Written(WriterCommitMessage):
    """What a task has staged: (staged path, name)."""

    files: list[tuple[str, str]] = field(default_factory=list)


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.staging = path, f"_staging-{uuid.uuid4().hex}"

    def _folder(self) -> tuple[pafs.FileSystem, str]:
        fs, root = file_system(self.path)
        return fs, f"{root.rstrip('/')}/{self.staging}"

    def write(self, iterator: Iterator) -> Written:
        fs, top = self._folder()
        folder, files = f"{top}/{uuid.uuid4().hex}", []
        fs.create_dir(folder, recursive=True)
        for i, row in enumerate(iterator):
            name, content = row["name"], row["content"]
            if not name or "/" in name or "\\" in name or name in (".", ".."):
                raise ValueError(f"not a file name: {name!r}")
            staged = f"{folder}/{i}"
            with fs.open_output_stream(staged) as f:
                f.write(content.encode() if isinstance(content, str) else bytes(content or b""))
            files.append((staged, name))
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, top = self._folder()
        root = top.rsplit("/", 1)[0]
        files = [f for m in messages if m is not None for f in m.files]
        names = [n for _, n in files]
        try:
            if len(set(names)) < len(names):
                raise ValueError(f"two rows for one file: {sorted(n for n in set(names) if names.count(n) > 1)[:5]}")
            for staged, name in files:
                fs.move(staged, f"{root}/{name}")
        finally:
            self._clear(fs, top)

    def abort(self, messages: list) -> None:
        self._clear(*self._folder())

    @staticmethod
    def _clear(fs: pafs.FileSystem, folder: str) -> None:
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


class WholeFiles(DataSource):
    """Rows of (name, content) as files of a folder; a file of the same name is replaced. Option: ``path``."""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("files are added or replaced by name; use mode('append')")
        return _Writer(self.options["path"])


def write_files(files: DataFrame, path: str) -> None:
    """Writes ``name, content`` (text in UTF-8, or bytes) rows as files of a folder, all or none."""
    spark = files.sparkSession
    spark.dataSource.register(WholeFiles)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    # a row is a whole file, and a task has a batch of them in memory several times
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    try:
        files.select("name", "content").write.format("whole_files").mode("append").option("path", path).save()
    finally:
        spark.conf.set(key, before)


def json_files(docs: DataFrame) -> DataFrame:
    """``name, content`` of documents as :func:`colloquy.operators.render.to_transcript_docs` makes
    them: indented JSON with words, in UTF-8."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            texts = [json.dumps(json.loads(body), ensure_ascii=False, indent=2) + "\n" for body in df["body"]]
            yield pd.DataFrame({"name": df["name"], "content": texts})

    stem = F.col("rec_id").cast("string")
    turn = lambda t: F.struct(t["speaker"].alias("speaker"), t["start"].alias("start"), t["end"].alias("end"), t["text"].alias("text"), t["text_zh"].alias("text_zh"), t["words"].alias("words"))
    body = F.to_json(F.struct("language", "bilingual", "text", F.transform("turns", turn).alias("turns")), {"ignoreNullFields": "false"})
    return docs.select(F.concat(stem, F.lit(".json")).alias("name"), body.alias("body")).mapInPandas(run, "name string, content string")


def transcript_files(turns: DataFrame, docs: DataFrame) -> DataFrame:
    """``name, content`` of the four files of each recording: ``.md``, ``.txt``, ``.srt`` and ``.json``."""
    named = lambda df, suffix: df.select(F.concat(F.col("rec_id").cast("string"), F.lit(suffix)).alias("name"), "content")
    out = named(render.render_markdown(turns, docs), ".md").unionAll(named(render.render_txt(turns), ".txt")).unionAll(named(render.render_srt(turns), ".srt"))
    return out.unionAll(json_files(render.to_transcript_docs(turns, docs)))


def write_outputs(turns: DataFrame, docs: DataFrame, path: str) -> None:
    """Four files for each recording, all of them or none."""
    write_files(transcript_files(turns, docs), path)


def notes_files(notes: DataFrame) -> DataFrame:
    """``name, content`` of a table of notes for each recording, ``<stem>.notes.csv``: a byte-order
    mark, lines that end in carriage return and line feed, notes in their order."""
    cell = lambda c: F.when(F.col(c).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    rows = render.notes_csv(note_order(notes), "note_ix")
    columns = [c for c in rows.columns if c != "note_ix"]
    line = F.concat(F.concat_ws(",", *[cell(c) for c in columns]), F.lit("\r\n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("note_ix", line.alias("line")))), lambda r: r["line"])
    head = render.BOM + ",".join(columns) + "\r\n"
    return rows.groupBy("stem").agg(F.concat(F.lit(head), F.array_join(listed, "")).alias("content")).select(F.concat("stem", F.lit(".notes.csv")).alias("name"), "content")


def write_notes_files(notes: DataFrame, path: str) -> None:
    write_files(notes_files(notes), path)
