"""Files as a sink: rows of (name, content) become files that are there whole or not at all.

Tasks write under a staging folder of the job. Only when all of them have ended well does the driver move
the files to their names; if any fails, the staging folder goes and nothing else has changed. A task that
runs twice writes a staging file twice, and only the one that counts is moved. Content is moved, not read,
by the driver, which handles names alone. The folder is one that pyarrow can open.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from hearken.sources import audio


def place(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    files, path = pyarrow.fs.FileSystem.from_uri(folder)
    return files, path.rstrip("/")


def put(files: pyarrow.fs.FileSystem, path: str, content: bytes) -> None:
    """Write a file under another name first, so that no reader sees half of it."""
    part = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        out.write(content)
    files.move(part, path)


@dataclass
class Staged(WriterCommitMessage):
    files: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite = folder, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Staged:
        files, path = place(self.folder)
        files.create_dir(f"{path}/{self.staging}")
        staged = []
        for row in iterator:
            name = row["name"]
            if not name or name.startswith(("_", ".", "/")) or ".." in name.split("/"):
                raise ValueError(f"not a name of a file: {name!r}")
            part = f"{self.staging}/{uuid.uuid4().hex}"
            with files.open_output_stream(f"{path}/{part}") as out:
                out.write(bytes(row["content"] or b""))
            staged.append((part, name))
        return Staged(staged)

    def commit(self, messages: list[Staged | None]) -> None:
        files, path = place(self.folder)
        staged = [f for m in messages if m for f in m.files]
        names = [name for _, name in staged]
        doubled = {n for n in names if names.count(n) > 1} if len(set(names)) < len(names) else set()
        there = set() if self.overwrite else {n for n in names if files.get_file_info(f"{path}/{n}").type != pyarrow.fs.FileType.NotFound}
        if doubled or there:
            self.abort(messages)
            raise ValueError(f"names that are taken: {sorted(doubled | there)[:5]}")
        for part, name in staged:
            if "/" in name:
                files.create_dir(f"{path}/{name.rpartition('/')[0]}")
            files.move(f"{path}/{part}", f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        files, path = place(self.folder)
        if files.get_file_info(f"{path}/{self.staging}").type != pyarrow.fs.FileType.NotFound:
            files.delete_dir(f"{path}/{self.staging}")


class Files(DataSource):
    """spark.dataSource.register(Files); df.write.format("wholefiles").mode("overwrite").save(folder), or
    mode append, which refuses names that are there."""

    @classmethod
    def name(cls) -> str:
        return "wholefiles"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if {f.name for f in schema} != {"name", "content"}:
            raise ValueError("columns name and content are asked for")
        return FileWriter(self.options["path"], overwrite)


def write_files(df: DataFrame, folder: str, replace: bool = False) -> None:
    """(name, content) as files of ``folder``. With ``replace`` a file of the same name gives way; others stay."""
    df.sparkSession.dataSource.register(Files)
    df.select("name", "content").write.format("wholefiles").mode("overwrite" if replace else "append").save(folder)


def write_json(df: DataFrame, folder: str, name: Column, replace: bool = True) -> None:
    """One JSON document a row, without the fields that are null."""
    write_files(df.select(name.alias("name"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).cast("binary").alias("content")), folder, replace)


def write_wav(clips: DataFrame, folder: str, name: Column, samples: Column, replace: bool = False) -> None:
    """Samples as sound files of 16 bits, 16 kHz; rows without samples make none."""
    sounds = clips.select(name.alias("name"), samples.alias("s")).filter(F.col("s").isNotNull())
    write_files(sounds.select("name", audio.wav_files("s").alias("content")), folder, replace)
