"""WAV (and, to read, AIFF and FLAC) files as a data source of Spark: blocks of frames, or heads alone; one WAV file for each track is
written."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tessitura.sources import wav

BLOCKS = "path string, rate int, first_frame long, channels int, samples array<double>"
#: Blocks that a partition of a file has.
SHARE = 16


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _head(store: fs.FileSystem, path: str) -> dict:
    with store.open_input_file(path) as f:
        return wav.header(lambda at, n: f.read_at(n, at), f.size())


@dataclass
class Stretch(InputPartition):
    """Frames of a file; its head where none are stated."""

    path: str
    first: int = 0
    count: int | None = None

    def __post_init__(self):
        super().__init__(self.path)


class WavReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.info = options["path"], options.get("info", "false") == "true"
        self.block, self.first, self.count = int(options.get("block", 65536)), int(options.get("first", 0)), options.get("count")

    def partitions(self) -> list[InputPartition]:
        """The driver lists files; it reads their heads to cut long ones, and none for `info`."""
        store, path = _store(self.path)
        root = store.get_file_info(path)
        found = [root] if root.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith((".wav", ".aif", ".aiff", ".aifc", ".flac")))
        if self.info:
            return [Stretch(f) for f in files]
        out: list[InputPartition] = []
        for f in files:
            last = _head(store, f)["frames"]
            last = min(last, self.first + int(self.count)) if self.count is not None else last
            out += [Stretch(f, a, min(SHARE * self.block, last - a)) for a in range(self.first, last, SHARE * self.block)]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if not partition:
            return
        store, _ = _store(self.path)
        about = _head(store, partition.path)
        if self.info:
            names = [c.split()[0] for c in wav.INFO.split(", ")]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([partition.path]), *[pa.array([about[n]], k) for n, k in zip(names, kinds)]], ["path", *names])
            return
        last = min(partition.first + partition.count, about["frames"])
        with store.open_input_file(partition.path) as f:
            for a in range(partition.first, last, self.block):
                x = wav.stretch(lambda at, n: f.read_at(n, at), about, a, min(self.block, last - a))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.path]), pa.array([about["rate"]], pa.int32()), pa.array([a], pa.int64()), pa.array([x.shape[1]], pa.int32()), pa.array([x.reshape(-1)], pa.list_(pa.float64()))],
                    ["path", "rate", "first_frame", "channels", "samples"],
                )


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (name while it is written, name)


class WavWriter(DataSourceWriter):
    """Rows of (key, frame, channels...), whose tracks must each be in one partition and sorted by key and frame. A file is written
    under a name of its own, and gets its name when the whole job has succeeded."""

    def __init__(self, options, schema):
        self.path, self.rate = options["path"], int(options.get("rate", 44100))
        self.columns = schema.names

    def write(self, rows) -> Written:
        store, path = _store(self.path)
        store.create_dir(path, recursive=True)
        files: list[tuple[str, str]] = []
        key, frames, values = None, [], []

        def close():
            if frames:
                x = np.zeros((frames[-1] + 1, len(self.columns) - 2))
                x[frames] = values
                name = posixpath.join(path, f"{key}.wav")
                part = f"{name}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as f:
                    f.write(wav.wav_bytes(x, self.rate))
                files.append((part, name))

        for row in rows:
            if frames and row[0] != key:
                close()
                frames, values = [], []
            key = row[0]
            frames.append(int(row[1]))
            values.append([float(v) for v in row[2:]])
        close()
        return Written(files)

    def commit(self, messages) -> None:
        store, _ = _store(self.path)
        for part, name in [f for m in messages if m for f in m.files]:
            store.move(part, name)

    def abort(self, messages) -> None:
        store, _ = _store(self.path)
        for part, _ in [f for m in messages if m for f in m.files]:
            store.delete_file(part)


class WavSource(DataSource):
    """Options to read: info (heads alone), block, first, count (frames). To write: rate."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return f"path string, {wav.INFO}" if self.options.get("info", "false") == "true" else BLOCKS

    def reader(self, schema) -> DataSourceReader:
        return WavReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WavWriter(self.options, schema)
