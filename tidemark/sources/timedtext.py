"""Timed-text files as a Spark data source, both ways, and the chain from their bytes to SRT text.

`spark.dataSource.register(TimedText)`, then `spark.read.format("timedtext").load(folder)`: a row for each file, and for each
entry of a zip archive; what can't be read is a row with an error. Tasks get files by bytes, and large archives by ranges of
their entries, so one archive is no single task's work. `df.write.format("timedtext").save(folder)` writes a file for each
row (name, content): tasks write aside, the commit renames, an abort leaves nothing. Paths are those of any file system
that pyarrow opens (a scheme in front, or a folder that all machines share).
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.text import TIMING
from .formats import MOST_ARCHIVE, MOST_FILE, ass_to_srt, choose_file, decoded, unpack, vtt_to_srt

#: Bytes of files, and of an archive's unpacked entries, that one task reads.
TASK_BYTES = 32 << 20
ROW = "path string, ordinal int, name string, content binary, error string"


@dataclass
class Part(InputPartition):
    """Whole files, or the entries first to last (from 1) of the one archive."""

    paths: list[str]
    first: int = 1
    last: int | None = None


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def entries(path: str, data: bytes, first: int, last: int | None) -> Iterator[tuple]:
    """The rows of one file."""
    name = path.rsplit("/", 1)[-1]
    if data[:2] != b"PK":
        yield path, 1, name, data, None
        return
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for k, e in list(enumerate(archive.infolist(), 1))[first - 1 : last]:
                if e.is_dir():
                    continue
                try:
                    yield (path, k, e.filename, archive.read(e), None) if e.file_size <= MOST_FILE else (path, k, e.filename, None, "entry too large")
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError) as error:
                    yield path, k, e.filename, None, f"entry unreadable: {error}"
    except zipfile.BadZipFile:
        yield path, 1, name, None, "archive unreadable"


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        store, root = opened(self.path)
        found = [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and not any(p.startswith(("_", ".")) for p in f.path[len(root) :].split("/"))]
        out, held, size = [], [], 0
        for file in sorted(found, key=lambda f: f.path):
            if held and size + file.size > TASK_BYTES:
                out.append(Part(held))
                held, size = [], 0
            if (turns := list(self.ranges(store, file))):
                out += turns
                continue
            held.append(file.path)
            size += file.size
        return out + ([Part(held)] if held else [])

    def ranges(self, store: fs.FileSystem, file: fs.FileInfo) -> Iterator[Part]:
        """Ranges of the entries of an archive that unpacks to more than one task's bytes: its directory is read, not its entries."""
        if file.size <= TASK_BYTES // 8 or file.size > MOST_ARCHIVE or not file.path.lower().endswith(".zip"):
            return
        try:
            with store.open_input_file(file.path) as data, zipfile.ZipFile(data) as archive:
                sizes = [e.file_size for e in archive.infolist()]
        except zipfile.BadZipFile:
            return
        first, size = 1, 0
        for k, more in enumerate(sizes, 1):
            if size and size + more > TASK_BYTES:
                yield Part([file.path], first, k - 1)
                first, size = k, 0
            size += more
        if first > 1:
            yield Part([file.path], first, len(sizes))

    def read(self, partition: Part) -> Iterator[tuple]:
        store, _ = opened(self.path)
        for path in partition.paths:
            if store.get_file_info(path).size > MOST_ARCHIVE:
                yield path, 1, path.rsplit("/", 1)[-1], None, "file too large"
                continue
            with store.open_input_stream(path) as data:
                yield from entries(path, data.read(), partition.first, partition.last)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.aside = path, overwrite, f"_aside-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        store, root = opened(self.path)
        done = []
        for row in iterator:
            if not row["name"] or row["name"].startswith(("/", "_", ".")) or ".." in row["name"].split("/"):
                raise ValueError(f"no name for a file: {row['name']!r}")
            here, there = f"{root}/{self.aside}/{uuid.uuid4().hex}", f"{root}/{row['name']}"
            store.create_dir(f"{root}/{self.aside}", recursive=True)
            content = row["content"]
            with store.open_output_stream(here) as out:
                out.write(content.encode() if isinstance(content, str) else bytes(content or b""))
            done.append((here, there))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        files = [f for m in messages if m for f in m.files]
        if len({there for _, there in files}) < len(files):
            self.abort(messages)
            raise ValueError("two rows have the same name")
        if not self.overwrite and any(f.type != fs.FileType.NotFound for f in store.get_file_info([there for _, there in files])):
            self.abort(messages)
            raise ValueError("a file of that name exists")
        for here, there in files:
            store.create_dir(there.rsplit("/", 1)[0], recursive=True)
            store.move(here, there)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """What was written aside goes, also of tasks that never reported."""
        store, root = opened(self.path)
        if store.get_file_info(f"{root}/{self.aside}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.aside}")


class TimedText(DataSource):
    """Options: path. Rows read: path, ordinal, name, content, error; rows written: name, content (text or bytes)."""

    @classmethod
    def name(cls) -> str:
        return "timedtext"

    def schema(self) -> str:
        return ROW

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"].rstrip("/"))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"].rstrip("/"), overwrite)


def srt_text(name: Column, content: Column) -> Column:
    """SRT text of a decoded file, by its extension or by what it begins with; null if it is no timed text."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(content, "^﻿", ""), r"\r\n?", "\n"), r"^[\s ﻿]+|[\s ﻿]+$", "")
    ass = F.lower(name).rlike(r"\.(ass|ssa)$") | plain.rlike(r"(?im)^\[Script Info\]")
    vtt = F.lower(name).rlike(r"\.vtt$") | plain.rlike(r"(?i)^WEBVTT")
    made = F.when(ass, ass_to_srt(plain)).when(vtt, vtt_to_srt(plain)).otherwise(F.concat(plain, F.lit("\n")))
    return F.when(made.rlike(TIMING.replace(r"\d{1,3}", r"\d{1,3}", 1)) | (~ass & ~vtt & plain.rlike(r"\d{1,2}:\d{2}:\d{2}[,.]\d{3}\s*-->")), made)


def prepared(files: DataFrame) -> DataFrame:
    """files (file_id, name, content, language, episode; the last two may be null) to (file_id, content, error): SRT text, or why there is none. Of an archive the entry that choose_file() names counts; bytes are decoded by their likely encoding."""
    asked = files.select("file_id", "language", "episode")
    opened_ = unpack(files.select("file_id", "name", "content")).join(asked, "file_id")
    archive = files.where(F.substring("content", 1, 2) == F.lit(b"PK")).select("file_id")
    inside = opened_.join(archive, "file_id", "left_semi")
    best = choose_file(inside.select("file_id", "ordinal", "name", F.length("content").alias("bytes"), "episode", "language"))
    one = inside.join(best.select("file_id", "ordinal"), ["file_id", "ordinal"], "left_semi").union(opened_.join(archive, "file_id", "left_anti"))
    read = one.select("file_id", F.coalesce("name", F.lit("")).alias("name"), decoded("content", "language").alias("text"))
    text = read.select("file_id", srt_text(F.col("name"), F.col("text")).alias("content"))
    told = asked.select("file_id").join(text.withColumn("found", F.lit(True)), "file_id", "left")
    error = F.when(F.col("found").isNull(), "no supported text").when(F.col("content").isNull(), "not a valid timed text")
    return told.select("file_id", "content", error.alias("error"))
